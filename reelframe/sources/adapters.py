"""Media tables read from the general star schema.

Each table is a list of (column, expression) pairs; the expressions are plain
SQL, so a projection of one Parquet scan is all that an adapter costs, and
columns that a query does not use are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEGMENTS = ("lineitem", (
    ("stream_id", "l_orderkey"),
    ("part_pos", "CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INT)"),
    ("seg_index", "CAST(l_linenumber AS BIGINT)"),
    ("tie", "l_partkey * 1000000 + l_suppkey"),
    ("price", "l_extendedprice"),
    ("duration", "l_quantity"),
    ("url", "concat('http://cdn.example/', CASE WHEN l_partkey % 7 = 0 THEN 'ad/' ELSE '' END, l_linestatus, '/seg', CAST(l_partkey AS VARCHAR(20)), '.ts')"),
    ("method", "CASE l_suppkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Aes128' WHEN 2 THEN 'SampleAes' ELSE 'Unknown' END"),
))

STREAMS = ("orders", (
    ("manifest_id", "o_custkey"),
    ("stream_pos", "o_orderkey"),
    ("media_type", "CASE o_orderkey % 5 WHEN 0 THEN 'Audio' WHEN 1 THEN 'Video' WHEN 2 THEN 'Subtitles' WHEN 3 THEN 'ClosedCaptions' END"),
    ("group_id", "concat('g', CAST(o_orderkey % 3 AS VARCHAR(20)))"),
    ("language", "CASE (o_orderkey + o_custkey) % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN '' END"),
    ("name", "o_orderpriority"),
    ("bandwidth", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END"),
    ("codecs", "CASE o_orderstatus WHEN 'F' THEN 'avc1.640028' WHEN 'O' THEN 'hvc1.1.6' ELSE 'mp4a.40.2' END"),
    ("resolution", "CASE o_orderkey % 4 WHEN 0 THEN '1920x1080' WHEN 1 THEN '1280x720' WHEN 2 THEN '640x360' END"),
    ("frame_rate", "CASE o_orderkey % 3 WHEN 0 THEN 25.0E0 WHEN 1 THEN 29.97E0 END"),
    ("channels", "CASE o_custkey % 3 WHEN 0 THEN '2' WHEN 1 THEN '6/JOC' END"),
    ("role", "CASE o_orderkey % 6 WHEN 0 THEN 'Main' WHEN 1 THEN 'Commentary' END"),
    ("video_range", "CASE o_orderkey % 2 WHEN 0 THEN 'SDR' ELSE 'PQ' END"),
    ("characteristics", "CAST(NULL AS VARCHAR(20))"),
    ("audio_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'g0' END"),
    ("subtitle_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'g2' END"),
    ("url", "concat('http://cdn.example/s/', CAST(o_orderkey % 97 AS VARCHAR(20)), '.m3u8')"),
))

EVENTS = ("events", (
    ("session_id", "user_id"),
    ("event_seq", "event_id"),
    ("kind", "CASE event_type WHEN 'click' THEN 'AggregateProgress' WHEN 'view' THEN 'StreamProgress' WHEN 'purchase' THEN 'LiveRefresh' WHEN 'error' THEN 'Warning' ELSE 'SegmentFinished' END"),
    ("stream_id", "concat('s', CAST(event_id % 3 AS VARCHAR(20)))"),
    ("downloaded_bytes", "CAST(round(value * 100) AS BIGINT)"),
    ("total_bytes", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(round(value * 200) AS BIGINT) END"),
    ("bytes_per_second", "CAST(round(value * 10) AS BIGINT)"),
    ("completed_segments", "event_id % 13"),
    ("total_segments", "CAST(13 AS BIGINT)"),
    ("segment_index", "event_id % 17"),
    ("message", "concat('m', CAST(event_id AS VARCHAR(20)))"),
    ("ts", "ts"),
))

JOBS = ("customer", (
    ("gid", "concat(substr(md5(CAST(c_custkey AS VARCHAR(20))), 1, 16))"),
    ("status", "CASE c_mktsegment WHEN 'BUILDING' THEN 'waiting' WHEN 'MACHINERY' THEN 'active' WHEN 'HOUSEHOLD' THEN 'paused' WHEN 'FURNITURE' THEN 'complete' ELSE 'error' END"),
    ("queue_position", "c_custkey % 500"),
    ("created_at_ms", "c_custkey * 10"),
    ("updated_at_ms", "c_custkey * 37 % 1009"),
    ("completed_length", "CAST(floor(abs(c_acctbal)) AS BIGINT)"),
    ("download_speed", "CAST(floor(abs(c_acctbal) / 10) AS BIGINT)"),
))

CUES = ("conversations", (
    ("doc_id", "conv_id"),
    ("cue_pos", "turn"),
    ("start_ms", "turn * 1000"),
    ("end_ms", "turn * 1000 + CASE WHEN turn % 3 = 2 THEN 500 ELSE 1000 END"),
    ("payload", "CASE WHEN turn % 4 < 2 THEN 'same' ELSE role END"),
    ("settings", "''"),
))


def read(spark: SparkSession, sf_dir: str, adapter: tuple) -> DataFrame:
    name, columns = adapter
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns))


def dealt(rows: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """rows of a table dealt by a key to as many tasks as their number asks for.

    What is built of them is many times larger; tasks that are put together by
    the size of the rows would hold and sort ever more of it. The count is that of the files' footers.
    """
    return rows.repartition(-(-rows.count() // most) or 1, key)


def as_sql(adapter: tuple) -> str:
    """The same projection as a subquery."""
    name, columns = adapter
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns) + f" FROM {name})"
