"""Queries on TTML subtitles, plain and in MP4 segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.functions import boxes as make
from reelframe.operators.cues import time_text
from reelframe.sources import ttml

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seg_pos, text): a TTML document of each order, a paragraph of each of its lines; four to a subtitle."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o, nth, part = F.col("l_orderkey"), F.col("nth"), F.col("l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    end = F.sum(F.col("l_quantity").cast("long") * 10).over(order)
    i = i.withColumns({"nth": F.row_number().over(order), "end": end}).withColumn("start", F.col("end") - F.col("l_quantity").cast("long") * 10)
    name = F.concat(F.lit("t"), (F.floor(nth / 2)).cast("string"))
    body = F.when(part % 4 == 0, F.concat(F.lit(" "), name, F.lit("<br/> <span tts:fontStyle='italic'>in<br/>side</span>\n"))).when(part % 4 == 1, F.concat(F.lit("<span>"), name, F.lit("</span>"))).otherwise(name)
    image = F.when(part % 7 == 0, ' smpte:backgroundImage="#i1"').otherwise("")
    line = F.concat(F.lit('<p region="r" begin="'), time_text(F.col("start"), "."), F.lit('" end="'), time_text(F.col("end"), "."), F.lit('"'), image, F.lit(">"), body, F.lit("</p>"))
    each = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("x"))
    head = F.lit('<tt xmlns="http://www.w3.org/ns/ttml" xmlns:tts="urn:s" xmlns:smpte="urn:m"><head><metadata><smpte:image xml:id="i1"> QUJD </smpte:image></metadata></head><body><div>')
    # a prefix that is not declared makes paragraphs that are repaired
    odd = F.when(o % 5 == 0, '<p region="x" begin="9s" end="9.5s">a <x:y z:w="1"> b</p>').when(o % 50 == 1, "<broken>").otherwise("")
    text = F.concat(head, F.array_join(F.transform("x", lambda x: x["line"]), "\n"), odd, F.lit("</div></body></tt>"))
    return each.select(F.floor(o / 4).alias("doc_id"), (o % 4).alias("seg_pos"), text.alias("text"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", "seg_pos", F.concat(make.box("moof"), make.box("mdat", make.raw("FFFE20"), make.ascii_(F.col("text")))).alias("data"))


def plain(spark, d):
    return ttml.images(ttml.ttml_cues(documents(spark, d), 10_000)[0]).withColumn("image", F.decode("image", "UTF-8"))


def in_files(spark, d):
    return ttml.ttml_cues(ttml.documents_in(segments(spark, d)), 10_000)[0]


def errors(spark, d):
    return ttml.ttml_cues(documents(spark, d))[1].drop("part")


QUERIES = {"ttml_cues": plain, "stpp_cues": in_files, "ttml_errors": errors}

_CUES = f"""n AS (SELECT l_orderkey AS o, l_orderkey // 4 AS doc_id, l_orderkey % 4 AS seg, row_number() OVER w AS nth, CAST(CAST(l_quantity AS BIGINT) * 10 AS BIGINT) AS d, l_partkey AS part,
        CAST(sum(CAST(l_quantity AS BIGINT) * 10) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)} ROWS UNBOUNDED PRECEDING) + l_orderkey % 4 * 10000 AS BIGINT) AS stop
      FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)})),
      p AS (SELECT o, doc_id, seg, nth, stop - d AS a, stop AS b, 'r' AS region, CASE WHEN part % 7 = 0 THEN 'Base64::QUJD' WHEN part % 4 = 0 THEN 't' || nth // 2 || e'\\r\\n<i>in\\r\\nside</i>' ELSE 't' || nth // 2 END AS payload FROM n WHERE o % 50 <> 1
        UNION ALL SELECT o, o // 4, o % 4, 100, 9000, 9500, 'x', 'a <x:y z:w="1"> b' FROM (SELECT DISTINCT o FROM n WHERE o % 5 = 0)),
      g AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(region) OVER w = region AND lag(payload) OVER w = payload THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY seg, nth)),
      r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY seg, nth ROWS UNBOUNDED PRECEDING) AS run FROM g),
      m AS (SELECT doc_id, run, region, payload, min(a) AS a, max(b) AS b FROM r GROUP BY ALL),
      u AS (SELECT doc_id, min(run) AS run, region, payload, a, b FROM m GROUP BY doc_id, region, payload, a, b),
      c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(run)) - 1 AS cue_pos, a AS start_ms, b AS end_ms, string_agg(payload, e'\\r\\n' ORDER BY run) AS payload FROM u GROUP BY doc_id, a, b)"""

SQL = {
    "ttml_cues": f"""WITH {_CUES} SELECT doc_id, cue_pos, start_ms, end_ms, CASE WHEN starts_with(payload, 'Base64::') THEN (sum(CASE WHEN starts_with(payload, 'Base64::') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY cue_pos) - 1) || '.png' ELSE payload END AS payload,
        CASE WHEN starts_with(payload, 'Base64::') THEN 'ABC' END AS image FROM c""",
    "stpp_cues": f"WITH {_CUES} SELECT * FROM c",
    "ttml_errors": "SELECT DISTINCT l_orderkey // 4 AS doc_id, l_orderkey % 4 AS seg_pos, 'no XML' AS error FROM lineitem WHERE l_orderkey % 50 = 1",
}
