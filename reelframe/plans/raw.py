"""Queries on raw bytes and on query parameters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions import boxes as make
from reelframe.functions import chacha, query
from reelframe.sources import raw


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def ciphers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document coded and decoded again, and whether the two differ."""
    d = _documents(spark, sf_dir)
    key, nonce = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), make.number(F.col("doc_id"), 8)
    x = d.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"), F.unhex(key).alias("key"), nonce.alias("nonce"))
    back = chacha.coded(chacha.coded(x), "coded", out="back")
    return back.select("doc_id", F.length("coded").cast("long").alias("n_bytes"), (F.col("coded") == F.col("data")).alias("same"), F.md5("back").alias("digest"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes of several codings, as transport streams and as other data."""
    d, k = _documents(spark, sf_dir), F.col("doc_id")
    name = F.concat(F.lit("é"), k.cast("string"))
    dash = F.concat(F.lit(" <MPD>"), name, F.lit("</MPD>\n"))
    data = (
        F.when(k % 7 == 0, F.encode(F.concat(F.lit("#EXTM3U\n"), name), "UTF-8")).when(k % 7 == 1, F.concat(make.raw("FFFE"), F.encode(dash, "UTF-16LE"))).when(k % 7 == 2, F.concat(F.encode(dash, "UTF-16BE"), make.raw("00")))
        .when(k % 7 == 3, F.unhex(F.concat(F.repeat(F.lit("01020380"), 9), F.hex(k)))).when(k % 7 == 4, F.encode(dash, "ISO-8859-1")).when(k % 7 == 5, F.unhex(F.repeat(F.concat(F.lit("47"), F.repeat(F.lit("00"), 187)), 4))).otherwise(F.encode("text", "UTF-8"))
    )
    told = F.when(k % 7 == 2, 'text/xml; charset="utf-16be"').when(k % 7 == 4, "text/xml;charset=ISO-8859-1")
    found = raw.source_texts(d.select(k.alias("id"), data.alias("data"), told.alias("content_type")))
    return found.select("id", "kind", F.when(F.col("kind").isNotNull(), F.col("text")).alias("text"), "error")


def transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transport stream of each order: some bytes before it, both tables, or one of them only."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    packet = lambda pid, body: F.concat(make.raw(f"47{0x4000 | pid:04X}10"), body, F.unhex(F.repeat(F.lit("FF"), (184 - F.length(body)).cast("int"))))
    programs = packet(0, F.concat(make.raw("0000B00D0001C10000"), make.number(k % 65_536, 2)))
    provider, name = make.ascii_(F.concat(F.lit("p"), (c % 100).cast("string"))), make.ascii_(F.col("o_orderpriority"))
    held = F.concat(make.raw("480001"), make.number(F.length(provider), 1), provider, make.number(F.length(name), 1), name)
    section = F.concat(make.zeros(11), make.number(F.length(held), 2), held)
    services = packet(0x11, F.concat(make.raw("0042"), make.number(F.length(section), 2), section))
    body = F.concat(F.unhex(F.repeat(F.lit("AA"), (k % 5).cast("int"))), services, packet(0x100, make.zeros(3)), F.when(k % 3 > 0, programs).otherwise(make.raw("")), packet(0x100, make.zeros(1)))
    return raw.services(o.select(k.alias("id"), body.alias("data")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of a session's events as chunks, up to 5,000 days."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 10).cast("long").alias("n_bytes"), (F.col("event_id") * 500).alias("elapsed_ms"))
    return raw.recordings(x, 2_000_000)


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    k = F.col("page_id").cast("string")
    source = F.concat(F.lit("http://s/x?page="), k, F.lit("&id=a+"), k, F.lit("&page=é&flag"))
    return p.select("page_id", query.with_query_of(F.col("url"), F.when(F.col("page_id") % 3 == 0, "http://s/none").otherwise(source)).alias("url"))


QUERIES = {"chacha_round_trip": ciphers, "source_texts": texts, "ts_services": transport, "ts_recordings": chunks, "query_parameters": parameters}

SQL = {
    "chacha_round_trip": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, coalesce(text, '') = '' AS same, md5(coalesce(text, '')) AS digest FROM documents",
    "source_texts": """SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN 'hls' WHEN 1 THEN 'dash' WHEN 2 THEN 'dash' WHEN 3 THEN 'binary' WHEN 4 THEN 'dash' WHEN 5 THEN 'ts' END AS kind,
        CASE doc_id % 7 WHEN 0 THEN e'#EXTM3U\\né' || doc_id WHEN 1 THEN '<MPD>é' || doc_id || '</MPD>' WHEN 2 THEN '<MPD>é' || doc_id || e'</MPD>\\n�' WHEN 4 THEN '<MPD>é' || doc_id || '</MPD>' END AS text,
        CASE WHEN doc_id % 7 < 6 THEN NULL WHEN trim(coalesce(text, ''), e' \\t\\r\\n') = '' THEN 'empty' ELSE 'unknown kind' END AS error FROM documents""",
    "ts_services": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 65536 AS VARCHAR) END AS program, CASE WHEN o_orderkey % 3 > 0 THEN 'p' || o_custkey % 100 END AS provider,
        CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS name FROM orders""",
    "ts_recordings": """SELECT session_id, seq, n_bytes, elapsed_ms, size_bytes, elapsed_ms // 1000 AS seconds, elapsed_ms >= 2000000 AS stop FROM (
        SELECT user_id AS session_id, event_id AS seq, CAST(floor(value * 10) AS BIGINT) AS n_bytes, event_id * 500 AS elapsed_ms, CAST(sum(CAST(floor(value * 10) AS BIGINT)) OVER w AS BIGINT) AS size_bytes,
          coalesce(max(event_id * 500) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE before < 2000000""",
    # the tables' URLs have page, ref and utm_source as parameters, none of them twice
    "query_parameters": r"""WITH p AS (SELECT page_id, url, page_id AS k, regexp_extract(url, '^[^?#]*') AS path, regexp_extract(url, '^[^?]*\?([^#]*)', 1) AS q FROM pages),
      l AS (SELECT *, CASE WHEN q = '' THEN [] ELSE string_split(q, '&') END AS own, 'page=' || k || '%2c%c3%a9' AS new FROM p)
      SELECT page_id, CASE WHEN k % 3 = 0 THEN url ELSE path || '?' || array_to_string(list_concat(list_transform(own, lambda x: CASE WHEN starts_with(x, 'page=') THEN new ELSE x END),
          CASE WHEN len(list_filter(own, lambda x: starts_with(x, 'page='))) > 0 THEN [] ELSE [new] END, ['id=a+' || k, 'flag']), '&') END AS url FROM l""",
}
