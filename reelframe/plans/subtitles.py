"""Queries on WebVTT documents and on output names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.operators import reserve
from reelframe.sources import adapters as a
from reelframe.sources import subtitles

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def vtt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seg_pos, text): a WebVTT document of each order, a cue of each of its lines; four to a subtitle, ten seconds apart by their clocks."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o, nth = F.col("l_orderkey"), F.col("nth")
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    end = F.sum(F.col("l_quantity").cast("long") * 100).over(order) + o % 4
    i = i.withColumns({"nth": F.row_number().over(order), "end": end}).withColumn("start", F.col("end") - F.col("l_quantity").cast("long") * 100)
    clock = lambda ms: F.concat(F.floor(ms / 60_000).cast("string"), F.lit(":"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    name = F.concat(F.lit("p"), (o % 4).cast("string"), F.lit("-"), F.floor(nth / 2).cast("string"))
    payload = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("<c.big>"), name, F.lit("</c> left out"))).otherwise(F.concat(name, F.lit("​")))
    times = F.concat(clock(F.col("start")), F.lit(" --> "), clock(F.col("end")), F.when(F.col("l_suppkey") % 2 == 0, "  line:0   align:start").otherwise(""))
    block = F.concat(nth.cast("string"), F.lit("\r\n"), times, F.lit("\r\n "), payload, F.lit("\r\n\r\n"))
    each = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("nth", block.alias("block")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["block"]), "")
    text = F.concat(F.lit("WEBVTT\r\nX-TIMESTAMP-MAP=MPEGTS:"), ((o % 4 + 1) * 900_000).cast("string"), F.lit(",LOCAL:00:00:00.000\r\n\r\n"), body, F.lit("NOTE the end\r\n"))
    return each.select(F.floor(o / 4).alias("doc_id"), (o % 4).alias("seg_pos"), F.when(o % 50 == 49, F.substring(text, 2, 1 << 20)).otherwise(text).alias("text"))


def vtt_batches(spark, d):
    return subtitles.vtt_joined(vtt_documents(spark, d))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of a customer with few names between them, and one of those there already."""
    s = a.read(spark, sf_dir, a.STREAMS)
    tries = reserve.attempts(F.when(F.col("media_type") == "Video", "Video").otherwise(F.when(F.col("stream_pos") % 2 == 0, "Audio")), F.col("resolution"), F.col("bandwidth").cast("long"), F.col("language"), F.lit("2"))
    file = F.concat(F.lit("show"), F.when(F.col("stream_pos") % 3 == 0, ".copy").otherwise(""), F.lit(".mp4"))
    rows = s.select(F.col("manifest_id").alias("folder"), F.col("stream_pos").alias("pos"), file.alias("file"), tries.alias("tries"))
    there = rows.where("folder % 4 = 0").select("folder", F.lit("show.mp4").alias("file")).distinct()
    return reserve.reserved(rows, there).select("folder", "pos", "reserved")


QUERIES = {
    "vtt_clocks": lambda s, d: subtitles.vtt_documents(vtt_documents(s, d)),
    "vtt_cues": lambda s, d: subtitles.vtt_cues(vtt_documents(s, d)),
    "vtt_batches": vtt_batches,
    "reserved_names": named,
}

_CUES = f"""n AS (SELECT l_orderkey AS o, l_orderkey // 4 AS doc_id, l_orderkey % 4 AS seg_pos, row_number() OVER w AS nth, CAST(CAST(l_quantity AS BIGINT) * 100 AS BIGINT) AS d,
        CAST(sum(CAST(l_quantity AS BIGINT) * 100) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)} ROWS UNBOUNDED PRECEDING) + l_orderkey % 4 AS BIGINT) AS stop, CASE WHEN l_suppkey % 2 = 0 THEN 'line:0 align:start' ELSE '' END AS settings
      FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)})),
      c AS (SELECT doc_id, seg_pos, nth - 1 AS cue_pos, stop - d AS start_ms, stop AS end_ms, 'p' || seg_pos || '-' || nth // 2 AS payload, settings, nth FROM n WHERE o % 50 <> 49)"""

SQL = {
    "vtt_clocks": "SELECT DISTINCT l_orderkey // 4 AS doc_id, l_orderkey % 4 AS seg_pos, CAST((l_orderkey % 4 + 1) * 900000 AS BIGINT) AS mpegts, CASE WHEN l_orderkey % 50 = 49 THEN 'no header' END AS error FROM lineitem",
    "vtt_cues": f"WITH {_CUES} SELECT doc_id, seg_pos, cue_pos, start_ms, end_ms, payload, settings FROM c",
    # a later document is moved by its clock, and what goes on with the same payload is joined there
    "vtt_batches": f"""WITH {_CUES}, f AS (SELECT *, min(seg_pos) OVER (PARTITION BY doc_id) AS first FROM c),
      g AS (SELECT doc_id, seg_pos, CASE WHEN seg_pos = first THEN nth + 1000 ELSE nth // 2 END AS run, seg_pos - first AS later, arg_min(settings, nth) AS settings, payload, min(start_ms) AS a, max(end_ms) AS b, min(nth) AS nth FROM f GROUP BY ALL)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_pos, nth) - 1 AS cue_pos, CAST(a + later * 10000 AS BIGINT) AS start_ms, CAST(b + later * 10000 AS BIGINT) AS end_ms, payload, settings FROM
        (SELECT doc_id, seg_pos, later, a, b, payload, settings, nth FROM g WHERE later = 0 UNION ALL
         SELECT doc_id, seg_pos, later, min(a), max(b), payload, arg_min(settings, nth), min(nth) FROM g WHERE later > 0 GROUP BY doc_id, seg_pos, later, run, payload)""",
    "reserved_names": f"""WITH RECURSIVE s AS (SELECT manifest_id AS folder, stream_pos AS pos, row_number() OVER (PARTITION BY manifest_id ORDER BY stream_pos) AS nth, count(*) OVER (PARTITION BY manifest_id) AS n,
          CASE WHEN stream_pos % 3 = 0 THEN 'show.copy' ELSE 'show' END AS stem, CASE WHEN media_type = 'Video' THEN [resolution, printf('%.1fMbps', bandwidth / 1000000.0), resolution || '.' || printf('%.1fMbps', bandwidth / 1000000.0)]
            WHEN stream_pos % 2 = 0 THEN [language, '2ch', language || '.2ch', (bandwidth // 1000) || 'kbps'] ELSE [] END AS tries FROM {a.as_sql(a.STREAMS)}),
        t AS (SELECT *, list_concat([stem || '.mp4'], list_transform(list_filter(tries, lambda x: x IS NOT NULL), lambda x: stem || '.' || x || '.mp4'), list_transform(range(1, n + 2), lambda k: stem || repeat('.copy', CAST(k AS BIGINT)) || '.mp4')) AS names FROM s),
        r AS (SELECT DISTINCT folder, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS reserved, CASE WHEN folder % 4 = 0 THEN ['show.mp4'] ELSE CAST([] AS VARCHAR[]) END AS taken FROM t
          UNION ALL SELECT folder, nth, pos, pick, list_append(taken, pick) FROM (SELECT r.folder, t.nth, t.pos, taken, list_filter(names, lambda x: NOT list_contains(taken, x))[1] AS pick FROM r JOIN t ON t.folder = r.folder AND t.nth = r.nth + 1))
      SELECT folder, pos, reserved FROM r WHERE nth > 0""",
}
