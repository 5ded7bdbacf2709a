"""Queries on bytes of media: boxes, fragments of WebVTT, init segments, with their SQL.

The bytes are built from the star schema's tables; the SQL knows what they were built from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.functions import boxes as make
from reelframe.sources import boxes
from reelframe.sources.adapters import dealt

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
#: Time units a second of the fragments.
UNITS = 250


def bytes_of(items: Column) -> Column:
    """The concatenation of an array of bytes."""
    return F.aggregate(items, make.raw(""), lambda a, x: F.concat(a, x))


def wvtt_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seg_pos, data): a WebVTT fragment of each order, a sample of each of its lines."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    cue = make.box("vttc", make.box("payl", make.ascii_(F.concat(F.lit("text "), (part % 3).cast("string")))), F.when(supp % 2 == 0, make.box("sttg", make.ascii_(F.concat(F.lit("line:"), (part % 2).cast("string"))))).otherwise(make.raw("")))
    media = F.when(part % 5 == 0, make.box("vtte")).otherwise(cue)
    duration = F.col("l_quantity").cast("long")
    entry = F.concat(make.number(duration, 4), F.when(o % 3 != 0, make.number(F.length(media), 4)).otherwise(make.raw("")))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    each = i.select("l_orderkey", F.struct(nth.alias("nth"), entry.alias("entry"), media.alias("media")).alias("x"))
    whole = each.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    entries, body = (bytes_of(F.col(f"xs.{c}")) for c in ("entry", "media"))
    run = lambda flags: make.full_box("trun", 0, flags, make.number(F.size("xs"), 4), entries)
    traf = make.box("traf", make.full_box("tfhd", 0, 0, make.number(2, 4)), make.full_box("tfdt", 1, 0, make.number((o % 4) * 1000, 8)), F.when(o % 3 != 0, run(0x300)).otherwise(run(0x100)))
    # sizes of 32 bits, of 64, and to the end
    mdat = F.when(o % 3 == 0, make.box("mdat", body)).when(o % 3 == 1, make.box("mdat", body, wide=True)).otherwise(F.concat(make.number(0, 4), make.ascii_("mdat"), body))
    return whole.select(F.floor(o / 4).alias("doc_id"), (o % 4).alias("seg_pos"), F.concat(make.box("moof", make.full_box("mfhd", 0, 0, make.number(o, 4)), traf), mdat).alias("data"))


def mp4_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = wvtt_segments(spark, sf_dir).select((F.col("doc_id") * 4 + F.col("seg_pos")).alias("id"), "data")
    return boxes.boxes(files, ("mdat",)).select("id", "path", "begin", "size")


def init_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    """Tracks of Smooth Streaming, one of each order, and their facts."""
    o = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", 25_000)
    key = F.col("o_orderkey")
    four = F.get(F.array(*map(F.lit, ("H264", "HVC1", "AACL", "TTML", "AACH", "EC-3", "DVH1", "XXXX"))), (key % 8).cast("int"))
    kind = F.get(F.array(*map(F.lit, ("video", "video", "audio", "text", "audio", "audio", "video", "video"))), (key % 8).cast("int"))
    more = F.lpad(F.hex(F.col("o_custkey")), 8, "A")  # no start code within
    avc = F.concat(F.lit("0000000167640028"), more, F.lit("0000000168EE3C80"))
    hevc = F.concat(F.lit("0000000140010C01FFFF"), F.lit("00000001420101016000000300900000030000030078"), more, F.lit("000000014401C172B4"))
    facts = {
        "four_cc": four, "kind": kind, "private_data": F.when(key % 8 == 0, avc).when((key % 8).isin(1, 6), hevc).when(key % 8 == 5, "AB12").otherwise(""), "rate": F.when(key % 3 == 0, 48_000).otherwise(22_050), "channels": F.lit(2), "bits": F.lit(16),
        "length_field": F.lit(4), "timescale": F.lit(10_000_000), "duration": F.floor("o_totalprice").cast("long"), "language": F.when(key % 2 == 0, "eng"), "name": F.concat(F.lit("g"), (F.col("o_custkey") % 1000).cast("string")),
        "width": F.when(kind == "video", 1280), "height": F.when(kind == "video", 720), "bandwidth": F.col("o_custkey"),
    }
    return o, facts


def init_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, data): a row of one struct through inline(), so that a filter on data does not build it again."""
    o, facts = init_streams(spark, sf_dir)
    kid = F.when((F.col("o_orderkey") % 5 == 0) & (facts["kind"] != "text"), F.unhex(F.lpad(F.hex("o_orderkey"), 32, "0")))
    data = F.encode(F.concat(F.lit("data"), F.col("o_custkey").cast("string")), "UTF-8")
    built = make.init_segment(facts, F.lit(2), F.lit(1_700_000_000), kid, F.lit(make.PLAYREADY), data)
    return o.select(F.col("o_orderkey").alias("id"), F.inline(F.array(F.struct(built.alias("data")))))


def init_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.boxes(init_bytes(spark, sf_dir)).select("id", "path", "begin", "size", "error")


QUERIES = {
    "mp4_boxes": mp4_boxes,
    "wvtt_cues": lambda s, d: boxes.wvtt_cues(wvtt_segments(s, d), UNITS),
    "init_boxes": init_boxes,
}

_LINES = f"""n AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS nth, CAST(l_quantity AS BIGINT) AS d, l_partkey % 5 = 0 AS gap, l_suppkey % 2 = 0 AS placed, 'text ' || l_partkey % 3 AS payload,
      CASE WHEN l_suppkey % 2 = 0 THEN 'line:' || l_partkey % 2 ELSE '' END AS settings FROM lineitem)"""

SQL = {
    "mp4_boxes": f"""WITH {_LINES},
      b AS (SELECT *, CASE WHEN gap THEN 8 WHEN placed THEN 8 + 14 + 14 ELSE 8 + 14 END AS len FROM n),
      c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY o ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
      f AS (SELECT o, count(*) AS n, sum(len) AS body, 16 + count(*) * CASE WHEN o % 3 = 0 THEN 4 ELSE 8 END AS trun, CASE WHEN o % 3 = 1 THEN 16 ELSE 8 END AS head FROM b GROUP BY o),
      p AS (SELECT f.o, head, 68 + trun AS moof, trun, c.before, c.len, gap, placed, body FROM f JOIN c USING (o))
      SELECT o AS id, path, CAST(pos AS BIGINT) AS begin, CAST(size AS BIGINT) AS size FROM (
        SELECT o, 'moof' AS path, 0 AS pos, 68 + trun AS size FROM f UNION ALL SELECT o, 'moof/mfhd', 8, 16 FROM f UNION ALL SELECT o, 'moof/traf', 24, 44 + trun FROM f
        UNION ALL SELECT o, 'moof/traf/tfhd', 32, 16 FROM f UNION ALL SELECT o, 'moof/traf/tfdt', 48, 20 FROM f UNION ALL SELECT o, 'moof/traf/trun', 68, trun FROM f
        UNION ALL SELECT o, 'mdat', 68 + trun, head + body FROM f
        UNION ALL SELECT o, CASE WHEN gap THEN 'mdat/vtte' ELSE 'mdat/vttc' END, moof + head + before, len FROM p
        UNION ALL SELECT o, 'mdat/vttc/payl', moof + head + before + 8, 14 FROM p WHERE NOT gap
        UNION ALL SELECT o, 'mdat/vttc/sttg', moof + head + before + 22, 14 FROM p WHERE NOT gap AND placed)""",
    "wvtt_cues": f"""WITH {_LINES},
      t AS (SELECT *, o // 4 AS doc_id, o % 4 AS seg, (o % 4) * 1000 + coalesce(sum(d) OVER (PARTITION BY o ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began FROM n),
      c AS (SELECT *, CAST(began * 4 AS BIGINT) AS a, CAST((began + d) * 4 AS BIGINT) AS b FROM t WHERE NOT gap),
      g AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(payload) OVER w = payload AND lag(settings) OVER w = settings THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY seg, nth)),
      r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY seg, nth ROWS UNBOUNDED PRECEDING) AS run FROM g)
      SELECT doc_id, CAST(run - 1 AS BIGINT) AS cue_pos, min(a) AS start_ms, max_by(b, seg * 1000 + nth) AS end_ms, payload, settings FROM r GROUP BY doc_id, run, payload, settings""",
    "init_boxes": """WITH s AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, o_orderkey % 5 = 0 AND o_orderkey % 8 <> 3 AS coded, 33 + length('g' || o_custkey % 1000) AS hdlr, length('data' || o_custkey) AS extra FROM orders WHERE o_orderkey % 8 <> 7),
      e AS (SELECT *, CASE k WHEN 0 THEN 'avc1' WHEN 1 THEN 'hvc1' WHEN 6 THEN 'dvh1' WHEN 5 THEN 'ec-3' WHEN 3 THEN 'stpp' ELSE 'mp4a' END AS code, CASE WHEN k IN (0, 1, 6) THEN 86 WHEN k = 3 THEN 16 ELSE 36 END AS head,
          CASE k WHEN 0 THEN 8 + 11 + 8 + 4 WHEN 1 THEN 8 + 23 + 15 + 6 + 22 + 5 WHEN 6 THEN 8 + 23 + 15 + 6 + 22 + 5 WHEN 5 THEN 12 + 22 + 2 WHEN 2 THEN 12 + 22 + 8 WHEN 4 THEN 12 + 22 + 16 ELSE 28 END AS config,
          CASE WHEN k IN (0, 1, 6) THEN 20 WHEN k = 3 THEN 12 ELSE 16 END AS kind FROM s),
      z AS (SELECT *, head + config + CASE WHEN coded THEN 80 ELSE 0 END AS entry FROM e),
      y AS (SELECT *, 92 + entry AS stbl FROM z),
      x AS (SELECT *, 8 + kind + 36 + stbl AS minf, 76 + head + config AS sinf_at FROM y),
      v AS (SELECT *, 52 + hdlr + minf AS mdia, 32 + 8 + 120 AS trak_at FROM x),
      u AS (SELECT *, trak_at + 8 + 104 AS mdia_at, 8 + 104 + mdia AS trak FROM v),
      t AS (SELECT *, mdia_at + 8 + 44 + hdlr AS minf_at, trak_at + trak AS mvex_at FROM u),
      q AS (SELECT *, minf_at + 8 + kind + 36 AS stbl_at FROM t)
      SELECT id, path, CAST(pos AS BIGINT) AS begin, CAST(size AS BIGINT) AS size, NULL AS error FROM (
        SELECT id, 'ftyp' AS path, 0 AS pos, 32 AS size FROM q UNION ALL SELECT id, 'moov', 32, 128 + trak + 60 + CASE WHEN coded THEN 32 + extra + 32 + 32 ELSE 0 END FROM q
        UNION ALL SELECT id, 'moov/mvhd', 40, 120 FROM q UNION ALL SELECT id, 'moov/trak', trak_at, trak FROM q UNION ALL SELECT id, 'moov/trak/tkhd', trak_at + 8, 104 FROM q
        UNION ALL SELECT id, 'moov/trak/mdia', mdia_at, mdia FROM q UNION ALL SELECT id, 'moov/trak/mdia/mdhd', mdia_at + 8, 44 FROM q UNION ALL SELECT id, 'moov/trak/mdia/hdlr', mdia_at + 52, hdlr FROM q
        UNION ALL SELECT id, 'moov/trak/mdia/minf', minf_at, minf FROM q UNION ALL SELECT id, 'moov/trak/mdia/minf/' || CASE kind WHEN 20 THEN 'vmhd' WHEN 12 THEN 'sthd' ELSE 'smhd' END, minf_at + 8, kind FROM q
        UNION ALL SELECT id, 'moov/trak/mdia/minf/dinf', minf_at + 8 + kind, 36 FROM q UNION ALL SELECT id, 'moov/trak/mdia/minf/dinf/dref', minf_at + 16 + kind, 28 FROM q UNION ALL SELECT id, 'moov/trak/mdia/minf/dinf/dref/url ', minf_at + 32 + kind, 12 FROM q
        UNION ALL SELECT id, 'moov/trak/mdia/minf/stbl', stbl_at, stbl FROM q UNION ALL SELECT id, 'moov/trak/mdia/minf/stbl/' || n, stbl_at + a, b FROM q, (VALUES ('stts', 8, 16), ('stsc', 24, 16), ('stco', 40, 16), ('stsz', 56, 20)) w(n, a, b)
        UNION ALL SELECT id, 'moov/trak/mdia/minf/stbl/stsd', stbl_at + 76, entry + 16 FROM q
        UNION ALL SELECT id, 'moov/trak/mdia/minf/stbl/stsd/' || CASE WHEN coded THEN CASE kind WHEN 20 THEN 'encv' ELSE 'enca' END ELSE code END, stbl_at + 92, entry FROM q
        UNION ALL SELECT id, 'moov/trak/mdia/minf/stbl/stsd/' || CASE WHEN coded THEN CASE kind WHEN 20 THEN 'encv' ELSE 'enca' END ELSE code END || CASE k WHEN 0 THEN '/avcC' WHEN 1 THEN '/hvcC' WHEN 6 THEN '/hvcC' ELSE '/esds' END, stbl_at + 92 + head, config FROM q WHERE k <> 3
        UNION ALL SELECT id, 'moov/trak/mdia/minf/stbl/stsd/' || CASE kind WHEN 20 THEN 'encv' ELSE 'enca' END || n, stbl_at + 92 + head + config + a, b FROM q, (VALUES ('/sinf', 0, 80), ('/sinf/frma', 8, 12), ('/sinf/schm', 20, 20), ('/sinf/schi', 40, 40), ('/sinf/schi/tenc', 48, 32)) w(n, a, b) WHERE coded
        UNION ALL SELECT id, 'moov/mvex', mvex_at, 60 FROM q UNION ALL SELECT id, 'moov/mvex/mehd', mvex_at + 8, 20 FROM q UNION ALL SELECT id, 'moov/mvex/trex', mvex_at + 28, 32 FROM q
        UNION ALL SELECT id, 'moov/pssh', mvex_at + 60, 32 + extra FROM q WHERE coded UNION ALL SELECT id, 'moov/pssh', mvex_at + 60 + 32 + extra, 64 FROM q WHERE coded)""",
}
