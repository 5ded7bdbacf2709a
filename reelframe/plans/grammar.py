"""Queries on option texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions import grammar
from reelframe.operators import clip, select
from reelframe.sources import adapters as a


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), "o_orderpriority")


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option texts of orders: values with escaped colons, in quotes, broken ones and flags."""
    k, c = F.col("k"), F.col("c").cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("a\\:b\\c\\:"), c, F.lit("\\d"))).when(k % 4 == 1, F.concat(F.lit(' "'), c, F.lit('" '))).when(k % 4 == 2, F.concat(F.lit("it's "), c)).otherwise("")
    text = F.concat(F.lit("for=best:name="), name, F.lit(":dur="), (k % 3).cast("string"), F.lit("h"), (k % 60).cast("string"), F.lit("s:range=x:keep"))
    x = _orders(spark, sf_dir).select(k.alias("id"), text.alias("text"))
    found = {n: grammar.option(F.col("text"), n) for n in ("name", "dur", "keep", "none")}
    return x.select("id", found["name"]["value"].alias("name"), found["name"]["error"].alias("error"), grammar.unit_seconds(found["dur"]["value"]).alias("seconds"), found["keep"]["value"].alias("keep"), found["none"]["value"].alias("none"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("k"), F.col("c").cast("string")
    text = F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit("-"), c)).when(k % 5 == 1, F.concat(F.lit("-"), c)).when(k % 5 == 2, F.concat(k.cast("string"), F.lit(":05-"))).when(k % 5 == 3, F.concat(F.lit("0:10 - 1:"), c)).otherwise("1-2-3")
    return _orders(spark, sf_dir).select(k.alias("id"), grammar.custom_range(text).alias("r")).select("id", "r.*")


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _orders(spark, sf_dir).select(k.alias("id"), grammar.signed_value(F.concat(F.lit("/p/"), F.col("c").cast("string")), F.lit("secret"), k * 1000, 5).alias("signed"),
                                         grammar.wait_until(F.concat(F.lit("202401"), F.lpad((k % 40).cast("string"), 2, "0"), F.lit("120000")), F.lit("20240115000000")).alias("wait"))


def by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams kept by a filter that is given as text."""
    s = clip.totals(a.read(spark, sf_dir, a.STREAMS), a.read(spark, sf_dir, a.SEGMENTS))
    f = grammar.stream_filter(r"codecs=^avc1|^hvc1:lang=en|fr:bwMin=50:segsMin=2:for=all")
    return select.filter_keep(s, f).select("manifest_id", "stream_pos")


QUERIES = {"option_texts": options, "custom_ranges": ranges, "signed_values": signed, "filter_texts": by_text}

SQL = {
    "option_texts": r"""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'a:bc:' || o_custkey || '\d' WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN '' END AS name, CASE WHEN o_orderkey % 4 = 2 THEN 'quotes' END AS error,
        CAST(o_orderkey % 3 * 3600 + o_orderkey % 60 AS DOUBLE) AS seconds, 'true' AS keep, NULL::VARCHAR AS none FROM orders""",
    "custom_ranges": """SELECT k AS id, CASE WHEN m < 2 THEN 'segment' WHEN m < 4 THEN 'time' END AS kind, CASE m WHEN 0 THEN k WHEN 1 THEN 0 END AS first, CASE WHEN m < 2 THEN c END AS last,
        CASE m WHEN 2 THEN CAST(k * 60 + 5 AS DOUBLE) WHEN 3 THEN 10.0 END AS start, CASE m WHEN 2 THEN 1.7976931348623157e308 WHEN 3 THEN CAST(60 + c AS DOUBLE) END AS "end", CASE WHEN m = 4 THEN 'start-end' END AS error
      FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 5 AS m FROM orders)""",
    "signed_values": """SELECT o_orderkey AS id, translate(to_base64(unhex(md5((o_orderkey * 1000 + 60005) || '/p/' || o_custkey || 'secret'))), '+/', '-_') || ',' || (o_orderkey * 1000 + 60005) AS signed,
        CASE WHEN o_orderkey % 40 BETWEEN 15 AND 31 THEN CAST((o_orderkey % 40 - 15) * 86400 + 43200 AS BIGINT) END AS wait FROM orders""",
    # a least number of segments is to be exceeded, unless a stream of the manifest has none
    "filter_texts": f"""WITH t AS (SELECT s.manifest_id, stream_pos, bandwidth, coalesce(n, 0) AS n, min(coalesce(n, 0)) OVER (PARTITION BY manifest_id) AS least
        FROM {a.as_sql(a.STREAMS)} s LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) g ON l_orderkey = stream_pos
        WHERE (codecs LIKE 'avc1%' OR codecs LIKE 'hvc1%') AND (language LIKE '%en%' OR language LIKE '%fr%'))
      SELECT manifest_id, stream_pos FROM t WHERE bandwidth >= 50000 AND (least <= 0 OR n > 2)""",
}
