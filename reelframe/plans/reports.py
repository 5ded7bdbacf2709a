"""Queries on texts that tell of streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.operators import reports
from reelframe.sources import adapters as a


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of manifests' metadata, and their lengths."""
    s = a.read(spark, sf_dir, a.STREAMS).select("manifest_id", "stream_pos", "media_type", "language", "bandwidth", F.concat(F.lit('u "'), F.col("stream_pos").cast("string"), F.lit('"')).alias("url"))
    g = a.read(spark, sf_dir, a.SEGMENTS).select(F.col("stream_id").alias("stream_pos"), "part_pos", F.struct("seg_index", "tie", "price", "duration").alias("seg_pos"), "seg_index", "duration", "method", "url")
    return reports.metadata_json(s, g).select("manifest_id", F.length("body").cast("long").alias("n"), F.md5("body").alias("digest"))


def infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey").cast("string")
    said = F.concat(
        F.lit("Input #0\n  Duration: 00:00:01.00, start: 1."), (F.col("o_orderkey") % 10).cast("string"), F.lit(", bitrate: 5 kb/s\n  Stream #0:0[0x1"), k, F.lit("](und): Video: h264 (High) (avc1 / 0x31637661), yuv420p(tv, bt2020nc/bt2020/smpte2084), 1920x"), k, F.lit(", "), k, F.lit(" kb/s, 29.97 fps \n"),
        F.when(F.col("o_orderkey") % 3 == 0, "    DOVI configuration record: version: 1, profile: 5, level: 6, compatibility id: 0\n").otherwise(""), F.lit("  Stream #0:1: Audio: aac, "), k, F.lit(" Hz\r\nend"),
    )
    return reports.media_infos(o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 == 9, "nothing").otherwise(said).alias("text")))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    kids = c.select(F.substring(F.md5(F.col("k").cast("string")), 1, 8).alias("kid")).distinct()
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = o.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("  "), F.md5(F.col("o_custkey").cast("string")), F.lit(":"), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("text"))
    return reports.keys_of(kids, lines)


QUERIES = {"metadata_json": metadata, "media_infos": infos, "key_lines": keys}

_NUMBER = "regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '')"
SQL = {
    "metadata_json": rf"""WITH s AS (SELECT stream_id, part_pos, seg_index, tie, price, duration, e'{{\n              "Index": ' || seg_index || e',\n              "Duration": ' || {_NUMBER.format('duration')} || e',\n              "EncryptInfo": {{\n                "Method": "'
          || CASE method WHEN 'None' THEN 'NONE' WHEN 'Aes128' THEN 'AES_128' WHEN 'SampleAes' THEN 'SAMPLE_AES' ELSE 'UNKNOWN' END || e'"\n              }},\n              "IsEncrypted": ' || CASE WHEN method = 'None' THEN 'false' ELSE 'true' END || e',\n              "Url": "' || url || e'"\n            }}' AS t FROM {a.as_sql(a.SEGMENTS)}),
      p AS (SELECT stream_id, part_pos, count(*) AS n, sum(duration) AS d, e'{{\n          "MediaSegments": [\n            ' || string_agg(t, e',\n            ' ORDER BY seg_index, tie, price, duration) || e'\n          ]\n        }}' AS t FROM s GROUP BY ALL),
      l AS (SELECT stream_id, sum(n) AS n, sum(d) AS d, string_agg(t, e',\n        ' ORDER BY part_pos) AS t FROM p GROUP BY ALL),
      m AS (SELECT manifest_id, stream_pos, e'{{\n' || coalesce(e'    "MediaType": "' || CASE media_type WHEN 'ClosedCaptions' THEN 'CLOSED_CAPTIONS' ELSE upper(media_type) END || e'",\n', '') || coalesce(e'    "Language": "' || language || e'",\n', '') || coalesce(e'    "Bandwidth": ' || bandwidth || e',\n', '')
          || e'    "Url": "u%20\\"' || stream_pos || e'\\"",\n    "OriginalUrl": "",\n' || coalesce(e'    "Playlist": {{\n      "Url": "",\n      "IsLive": false,\n      "RefreshIntervalMs": 15000,\n      "TotalDuration": ' || {_NUMBER.format('d')} || e',\n      "MediaParts": [\n        ' || l.t || e'\n      ]\n    }},\n', '') || '    "SegmentsCount": ' || CAST(coalesce(n, 0) AS BIGINT) || e'\n  }}' AS t
        FROM {a.as_sql(a.STREAMS)} x LEFT JOIN l ON l.stream_id = x.stream_pos),
      b AS (SELECT manifest_id, e'[\n  ' || string_agg(t, e',\n  ' ORDER BY stream_pos) || e'\n]' AS body FROM m GROUP BY manifest_id)
      SELECT manifest_id, CAST(length(body) AS BIGINT) AS n, md5(body) AS digest FROM b""",
    "media_infos": """WITH o AS (SELECT o_orderkey AS id, CAST(1000 + o_orderkey % 10 * 100 AS BIGINT) AS start_ms FROM orders)
      SELECT id, 0 AS pos, '[0x1' || id || ']' AS stream_id, 'Video' AS media_type, 'h264 (High) (avc1 / 0x31637661), yuv420p(tv, bt2020nc/bt2020/smpte2084), 1920x' || id || ', ' || id || ' kb/s, 29.97 fps' AS text, 'h264 (High) (avc1)' AS base_info, id || ' kb/s' AS bitrate, '1920x' || id AS resolution, '29.97 fps' AS fps, start_ms, id % 3 = 0 AS dolby_vision, true AS hdr FROM o WHERE id % 10 <> 9
      UNION ALL SELECT id, 1, NULL, 'Audio', 'aac, ' || id || ' Hz', 'aac', NULL, NULL, NULL, start_ms, false, false FROM o WHERE id % 10 <> 9
      UNION ALL SELECT id, 0, NULL, 'Unknown', NULL, NULL, NULL, NULL, NULL, NULL, false, false FROM o WHERE id % 10 = 9""",
    "key_lines": """SELECT kid, line FROM (SELECT DISTINCT substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS kid FROM customer)
      LEFT JOIN (SELECT substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS kid, arg_min(md5(CAST(o_custkey AS VARCHAR)) || ':' || o_orderkey, o_orderkey) AS line FROM orders GROUP BY ALL) USING (kid)""",
}
