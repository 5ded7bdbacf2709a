"""Worked examples, edge cases, and batch against streaming."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from reelframe.functions import blobs, moments, text
from reelframe.operators import clip, cues, jobs, live, reports, select
from reelframe.plans import queries
from reelframe.streaming import live as streaming

SEGMENT = "stream_id long, part_pos int, seg_index long, tie long, price double, duration double, url string, method string"


def segments(spark, rows):
    return spark.createDataFrame([(s, p, i, 0, 0.0, d, u, "None") for s, p, i, d, u in rows], SEGMENT)


def four(spark):
    return segments(spark, [(1, 0, i, 2.0, f"http://x/seg{i}.ts") for i in range(4)])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_index_range(spark):
    row = clip.clip_summary(four(spark), 1, 2, "index").first()
    assert (row["n_kept"], row["skipped_duration"]) == (2, 2.0)


def test_time_range(spark):
    rows = clip.clip(four(spark), 2.0, 4.0).orderBy("seg_index").collect()
    assert [r["url"] for r in rows] == ["http://x/seg1.ts", "http://x/seg2.ts"]


def test_large_indexes(spark):
    big = segments(spark, [(1, 0, 2**31 - 1 + i, 1.0, "u") for i in range(3)])
    assert clip.clip(big, 2**31, 2**63 - 1, "index").count() == 2


def test_time_before_leaves_out_ties(spark):
    tied = segments(spark, [(1, 0, 1, 2.0, "a"), (1, 0, 1, 3.0, "b"), (1, 1, 2, 1.0, "c")])
    rows = clip.clip(tied, 0, 100).orderBy("url").collect()
    assert [r["before"] for r in rows] == [0.0, 0.0, 5.0]


def test_prefix_sums_against_slow_version(spark):
    r = random.Random(3)
    rows = [(s, r.randrange(3), r.randrange(6), float(r.randrange(9)), str(k)) for s in range(5) for k in range(12)]
    got = {x["url"] + f"/{x['stream_id']}": x["before"] for x in clip.clip(segments(spark, rows), -1, 1e9).collect()}
    assert got == {f"{u}/{s}": sum(d2 for s2, _, i2, d2, _ in rows if s2 == s and i2 < i) for s, _, i, _, u in rows}


def test_ad_cleanup_drops_empty_parts(spark):
    row = clip.ad_counts(segments(spark, [(1, 0, 0, 1.0, "http://x/ad/1.ts"), (1, 1, 1, 1.0, "http://x/1.ts")]), ["/ad/"]).first()
    assert (row["n_after"], row["parts_after"]) == (1, 1)


def test_empty_segments(spark):
    none = segments(spark, [])
    assert clip.clip_summary(none, 0, 1).count() == 0
    assert live.wait_seconds(none).first()["wait"] == 1


def test_split_sizes(spark):
    size = 10_485_760
    files = spark.createDataFrame([(0, size), (1, 2 * size), (2, 2 * size + 1), (3, 3 * size + 1), (4, 0)], "id int, file_size long")
    rows = clip.split_ranges(files).orderBy("id", "index").collect()
    assert [r["id"] for r in rows].count(2) == 3
    assert [r["expected_length"] for r in rows if r["id"] == 2][-1] == 0
    assert [r["expected_length"] for r in rows if r["id"] == 3][-1] == -1
    assert not any(r["id"] == 4 for r in rows)


STREAM = "manifest_id long, stream_pos long, media_type string, group_id string, language string, name string, bandwidth long, codecs string, resolution string, frame_rate double, channels string, role string, video_range string, characteristics string, audio_id string, subtitle_id string, url string, segment_count long, total_duration double"


def streams(spark, rows):
    names = [c.split()[0] for c in STREAM.split(", ")]
    return spark.createDataFrame([tuple({"manifest_id": 1, "stream_pos": k, "segment_count": 0, **r}.get(n) for n in names) for k, r in enumerate(rows)], STREAM)


def positions(df):
    return sorted(r["stream_pos"] for r in df.collect())


def test_role_and_range(spark):
    s = streams(spark, [{"role": "Main", "video_range": "PQ"}, {"role": "Commentary", "video_range": "SDR"}, {"role": "ForcedSubtitle", "video_range": "PQ"}, {"role": "10", "video_range": "PQ"}])
    assert positions(select.filter_keep(s, select.StreamFilter(video_range="P.", role="Main", choice="all"))) == [0]
    assert positions(select.filter_keep(s, select.StreamFilter(role="ForcedSubtitle", choice="all"))) == [2]


def test_drop_by_bandwidth(spark):
    s = streams(spark, [{"bandwidth": 1_000_000}, {"bandwidth": 2_000_000}])
    assert positions(select.filter_drop(s, select.StreamFilter(bandwidth_max=1_500_000, choice="all"))) == [1]


def test_drop_takes_what_looks_the_same(spark):
    s = streams(spark, [{"media_type": "Video", "language": "eng"}, {"media_type": "Video", "language": "fra"}])
    assert positions(select.filter_drop(s, select.StreamFilter(language="eng", choice="all"))) == []


def test_drop_before_keep(spark):
    s = streams(spark, [{"group_id": "v-high", "bandwidth": 2}, {"group_id": "v-low", "bandwidth": 1}])
    assert positions(select.apply_filters(s, {"Video": select.StreamFilter(choice="best")}, {"Video": select.StreamFilter(group_id="v-high", choice="all")})) == [1]


def test_choices(spark):
    s = streams(spark, [{}, {}, {}])
    assert [positions(select.choose(s, c)) for c in ("all", "best", "worst", "best2", "worst2", "best0", "worst0", "other")] == [[0, 1, 2], [0], [2], [0, 1], [1, 2], [], [], [0]]


def test_no_filter(spark):
    s = streams(spark, [{}])
    assert positions(select.filter_keep(s, None)) == []
    assert positions(select.filter_drop(s, None)) == [0]


def test_patterns_must_be_portable():
    import pytest

    with pytest.raises(ValueError):
        select.regex("(?=x)")


def test_queue_pages(spark):
    q = spark.createDataFrame([(str(k), "waiting", k, 0) for k in range(5)], "gid string, status string, queue_position long, created_at_ms long")
    ids = lambda df: [r["gid"] for r in df.collect()]
    assert ids(jobs.page(q, 1, 2)) == ["1", "2"]
    assert ids(jobs.page(q, -1, 2)) == ["4", "3"]
    assert ids(jobs.page(q, -9, 3)) == ["0"]
    assert ids(jobs.page(q, 0, 0)) == []


def test_queue_moves_against_lists(spark):
    q = spark.createDataFrame([(str(k), "waiting", k * 40, 0) for k in range(6)], "gid string, status string, queue_position long, created_at_ms long")
    for gid, position, how in (("0", 3, "POS_SET"), ("4", -2, "POS_CUR"), ("2", -1, "POS_END"), ("1", 99, "POS_SET"), ("5", -99, "POS_CUR")):
        order = [str(k) for k in range(6)]
        at = order.index(gid)
        order.remove(gid)
        order.insert(min(max(0, {"POS_SET": position, "POS_CUR": at + position, "POS_END": len(order) + position}[how]), len(order)), gid)
        assert [r["gid"] for r in jobs.moved(q, gid, position, how).orderBy("place").collect()] == order


CUE = "doc_id long, cue_pos long, start_ms long, end_ms long, payload string, settings string"


def test_cue_text(spark):
    c = cues.left_shift(spark.createDataFrame([(1, 0, 1000, 3500, "Hello", "align:start")], CUE), 500)
    assert cues.as_text(c).first()["body"].startswith("WEBVTT\r\n\r\n00:00:00.500 --> 00:00:03.000 align:start\r\nHello")
    assert "00:00:00,500 --> 00:00:03,000" in cues.as_text(c, "srt").first()["body"]


def test_cues_merge(spark):
    c = spark.createDataFrame([(1, 0, 1000, 2000, "a", ""), (1, 1, 2000, 3000, "a", ""), (1, 2, 5000, 6000, "a", ""), (1, 3, 5000, 6000, "a", "")], CUE)
    assert [(r["start_ms"], r["end_ms"]) for r in cues.merged(c).orderBy("cue_pos").collect()] == [(1000, 3000), (5000, 6000)]


def test_functions(spark):
    lit = F.lit
    assert value(spark, moments.cue_millis(lit("1.2345"))) == 3345
    assert value(spark, moments.cue_millis(lit("12.5s"))) == 12_500
    assert value(spark, moments.unix_millis(lit("1970-01-01T00:00:01.2349Z"))) == 1234
    assert value(spark, moments.unix_millis(lit("1970-01-01 01:00:00+0100"))) == 0
    assert value(spark, moments.unix_millis(lit("1970-13-01T00:00:00Z"))) is None
    assert value(spark, moments.iso_duration(lit("P1DT2H3M4.5S"))) == 93_784.5
    assert value(spark, moments.iso_duration(lit("P1Y"))) is None
    assert value(spark, moments.manifest_number(lit("1,234.5"))) == 1234.5
    assert value(spark, moments.manifest_number(lit("1e999"))) is None
    assert value(spark, moments.refresh_interval(lit(3e9))) == -(2.0**31)
    assert value(spark, moments.frame_rate(lit("30000/1001"))) == 29.97
    assert value(spark, text.redact(lit("--key abc token=abc def&sig=x"))) == "--key <redacted> token=<redacted>&sig=<redacted>"
    assert value(spark, text.combine_url(lit("http://h/a/b/c.m3u8?x"), lit("../d.ts"))) == "http://h/a/d.ts"
    assert value(spark, text.combine_url(lit("http://h/a/b"), lit("//o/x"))) == "http://o/x"
    assert value(spark, text.combine_url(lit("http://h"), lit("x"))) == "http://h/x"
    assert value(spark, text.template(lit("s-$Number%05d$-$Time$"), {"Number": lit(42), "Time": lit(7)})) == "s-00042-7"
    assert value(spark, text.template(lit("$Number%03d$"), {"Number": lit(123456)})) == "123456"
    assert value(spark, text.file_size(lit(1536))) == "1.50KiB"
    assert value(spark, text.save_name(lit("http://h/p/a%20b+c.m3u8?x=1"))) == "a b+c_"
    assert value(spark, text.encryption_method(lit("AES-128"))) == "Aes128"
    assert value(spark, text.encryption_method(lit(None).cast("string"))) == "Unknown"
    assert value(spark, text.hls_attribute(lit('METHOD=AES-128,URI="a,b"'), "URI")) == "a,b"
    assert value(spark, text.hls_attribute(lit('METHOD=AES-128,URI="a"'), "METHOD")) == "AES-128"
    assert value(spark, blobs.strict_base64(lit("AAE"))) is None
    assert bytes(value(spark, blobs.implicit_iv(lit(-2)))) == bytes(8) + (2**64 - 2).to_bytes(8)
    assert value(spark, blobs.range_header(lit(0), lit(100))) == "bytes=0-99"


def test_transport_streams(spark):
    packet = b"\x47" + bytes(187)
    for data, wanted in ((packet * 5, True), (packet * 2, False), (packet[:100], False), (b"", False)):
        assert value(spark, blobs.is_transport_stream(F.lit(data))) == wanted


SNAPSHOT = "stream_id long, refresh long, seg_pos long, seg_index long, name string, unix_time long, duration double"


def refreshes():
    """Stream 1 moves on, then loses its anchor and stalls; stream 2's indexes start anew."""
    one = [(1, k, i, i, str(i), None, 2.6) for k, w in enumerate(([0, 1, 2], [1, 2, 3, 4], [7, 8])) for i in w]
    two = [(2, k, p, i, f"n{n}", 100 + n, 1.0) for k, w in enumerate(([(10, 0), (11, 1)], [(0, 1), (1, 2)])) for p, (i, n) in enumerate(w)]
    return one + two


def test_live_window(spark):
    got = live.new_segments(spark.createDataFrame(refreshes(), SNAPSHOT)).collect()
    assert sorted(r["seg_index"] for r in got if r["stream_id"] == 1) == [0, 1, 2, 3, 4]
    assert max(r["refreshed_seconds"] for r in got if r["stream_id"] == 1) == 7 + 5
    assert sorted(r["seg_index"] for r in got if r["stream_id"] == 2) == [10, 11, 12]


def test_live_window_streams_alike(spark, tmp_path):
    batch = spark.createDataFrame(refreshes(), SNAPSHOT)
    wanted = sorted(map(tuple, live.new_segments(batch).collect()))
    for k in range(3):
        batch.where(F.col("refresh") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming.new_segments(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == wanted


def test_limit():
    seen = live.Seen()
    live.folded(pd.DataFrame({"stream_id": [1], "refresh": [0], "seg_index": [0], "name": ["a"], "unix_time": [None], "duration": [9.0]}), {1: seen}, limit=9)
    assert seen.limit_reached


def test_alignment(spark):
    x = segments(spark, [(1, 0, i, 1.0, "u") for i in range(6)] + [(2, 0, i, 1.0, "u") for i in range(2, 7)]).withColumn("m", F.lit(1))
    counts = {r["stream_id"]: r["count"] for r in live.aligned_start(x, "m", 2).groupBy("stream_id").count().collect()}
    assert counts == {1: 1, 2: 2}


def test_every_order_is_split(spark, small):
    wanted = []
    for key, price in spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_totalprice").collect():
        size, start, index = math.floor(price * 97), 0, 0
        for left in range(size, 0, -10_000_000):
            length = 10_000_001 if left > 10_000_000 else size - start + 1
            wanted.append((key, size, index, start, length, length > 0))
            start, index = start + 10_000_001, index + 1
    got = queries.QUERIES["range_split_all"](spark, small).select("o_orderkey", "file_size", "index", "start_range", "expected_length", "is_valid").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert any(key % 20 for key, *_ in wanted)


def test_aligned_start_by_times(spark):
    rows = [(1, 1, i, 100 + i) for i in range(5)] + [(1, 2, i, 102 + i) for i in range(5)] + [(2, 3, i, None if i == 1 else 7 + i) for i in range(3)] + [(2, 4, i + 1, 1 + i) for i in range(3)]
    x = spark.createDataFrame([(*r, 0, 0.0) for r in rows], "manifest_id long, stream_id long, seg_index long, at long, tie long, price double")
    found = lambda **more: sorted((r["stream_id"], r["seg_index"]) for r in live.aligned_start(x, "manifest_id", 9, **more).collect())
    # by times stream 1 begins two later; the other manifest lacks a time and goes by index
    assert found(time="at") == [(1, 2), (1, 3), (1, 4), *((2, i) for i in range(5)), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3)]
    assert found() == [*((s, i) for s in (1, 2) for i in range(5)), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3)]
    assert live.aligned_start(x, "manifest_id", 3, time="at").columns == x.columns


def test_a_move_of_a_job_that_is_not_queued_fails(spark):
    import pytest

    q = spark.createDataFrame([("a", "waiting", 0, 0), ("b", "active", 1, 0)], "gid string, status string, queue_position long, created_at_ms long")
    with pytest.raises(Exception, match="not in the queue"):
        jobs.moved(q, "b", 0, "POS_SET").collect()


def test_media_infos_need_no_exchange(spark):
    df = spark.createDataFrame([(1, "Duration: x, start: 1.5\n  Stream #0:0[0x1]: Video: h264 / 0x1, 10x20, 5 kb/s\nx\n  Stream #0:1: Audio: aac"), (2, "nothing"), (3, None)], "id long, text string").repartition(2)
    found = reports.media_infos(df)
    got = sorted(tuple(r) for r in found.select("id", "pos", "media_type", "start_ms", "base_info", "hdr").collect())
    assert got == [(1, 0, "Video", 1500, "h264", False), (1, 1, "Audio", 1500, "aac", False), (2, 0, "Unknown", None, None, False), (3, 0, "Unknown", None, None, False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_metadata_texts_are_not_shuffled(spark):
    import json

    streams = spark.createDataFrame([(1, 10, "Audio", 'a "b"'), (1, 9, None, None), (2, 11, "Video", "c")], "manifest_id long, stream_pos long, media_type string, url string")
    segments = spark.createDataFrame([(10, 1, 0, 5, 1.5, "u%20v", "None"), (10, 0, 2, 7, 2.0, "w", "Aes128"), (10, 0, 1, 6, 4.0, "x", "Unknown"), (12, 0, 0, 0, 1.0, "y", "None")], "stream_pos long, part_pos int, seg_pos long, seg_index long, duration double, url string, method string")
    found = reports.metadata_json(streams, segments)
    got = {r["manifest_id"]: json.loads(r["body"]) for r in found.collect()}
    assert [s["SegmentsCount"] for s in got[1]] == [0, 3] and "Playlist" not in got[1][0] and got[2][0]["Url"] == "c" and got[1][1]["Url"] == 'a%20"b"'
    playlist = got[1][1]["Playlist"]
    assert playlist["TotalDuration"] == 7.5 and [[(s["Index"], s["Duration"], s["EncryptInfo"]["Method"], s["Url"]) for s in p["MediaSegments"]] for p in playlist["MediaParts"]] == [[(6, 4, "UNKNOWN", "x"), (7, 2, "AES_128", "w")], [(5, 1.5, "NONE", "u v")]]
    above, *below = found._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression [manifest_id")
    assert below and "EncryptInfo" in above and "EncryptInfo" not in "".join(below) and "MediaType" not in "".join(below)
