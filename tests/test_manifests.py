"""Awkward DASH and Smooth Streaming documents, and the small planning functions."""

from pyspark.sql import functions as F

from reelframe.functions import blobs, moments, planning, text as names
from reelframe.plans import queries
from reelframe.sources import manifests

MPD = '<MPD {head}><BaseURL>http://h/a/</BaseURL><Period id="1" duration="PT10S">{sets}</Period>{more}</MPD>'
TIMELINE = '<AdaptationSet contentType="text"><Role value="forced-subtitle"/><SegmentTemplate timescale="10" media="$RepresentationID$/$Time$.m4s"><SegmentTimeline><S t="5" d="20" r="1"/><S d="30"/><S t="100" d="30" r="-1"/></SegmentTimeline></SegmentTemplate><Representation id="s" mimeType="application/ttml+xml"/></AdaptationSet>'
NUMBERS = '<AdaptationSet contentType="audio"><Representation id="a" volumeAdjust="2" lang="e!"><SegmentTemplate media="$Number%03d$.m4s" duration="4" startNumber="7"/></Representation></AdaptationSet>'
BARE = '<AdaptationSet mimeType="video/mp4"><BaseURL>../b/</BaseURL><Representation id="v" width="1" height="2"><BaseURL>v.mp4</BaseURL><SegmentBase><Initialization range="0-9"/></SegmentBase></Representation></AdaptationSet>'


def documents(spark, *texts):
    return spark.createDataFrame([(i, "http://h/x.mpd", t) for i, t in enumerate(texts)], "manifest_id long, url string, text string")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_dash_segments(spark):
    found = manifests.representations(documents(spark, MPD.format(head='type="static"', sets=TIMELINE + NUMBERS + BARE, more="")))
    x = manifests.dash_segments(found).orderBy("set_pos", "seg_pos").cache()
    assert [r[0] for r in rows(x.where("set_pos = 0"), "url")] == [f"http://h/a/s/{t}.m4s" for t in (5, 25, 45, 100, 130, 160, 190)]
    assert rows(x.where("set_pos = 1"), "seg_index", "url", "duration", "name") == [(i, f"http://h/a/{7 + i:03}.m4s", 4.0, str(7 + i)) for i in range(3)]
    assert rows(x.where("set_pos = 2"), "seg_index", "url", "duration") == [(0, "http://h/b/v.mp4", 10.0)]
    s = manifests.dash_streams(found).orderBy("set_pos")
    assert rows(s, "group_id", "media_type", "role", "language", "extension") == [("s", "Subtitles", "ForcedSubtitle", None, "ttml"), ("a-2", "Audio", None, "und", "m4s"), ("v", None, None, None, "mp4")]


def test_dash_live_window_follows_the_clock(spark):
    text = MPD.format(head='type="dynamic" availabilityStartTime="1970-01-01T00:00:00Z" timeShiftBufferDepth="PT8S"', sets=NUMBERS, more="").replace(' duration="PT10S"', "")
    found = manifests.representations(documents(spark, text), now=F.lit(100))
    assert rows(manifests.dash_segments(found).orderBy("seg_pos"), "seg_index", "name") == [(30, "30"), (31, "31")]


def test_dash_periods_join_and_equal_ends_are_absorbed(spark):
    again, third = f'<Period id="2" duration="PT10S">{NUMBERS}</Period>', f'<Period id="3" duration="PT5S">{NUMBERS}</Period>'
    found = manifests.representations(documents(spark, MPD.format(head="", sets=NUMBERS + NUMBERS, more=again + third)))
    x = manifests.merged(manifests.dash_streams(found), manifests.dash_segments(found)).orderBy("set_pos", "part", "seg_index")
    assert rows(x, "set_pos", "part", "seg_index", "duration") == [(0, 0, 0, 4.0), (0, 0, 1, 4.0), (0, 0, 2, 16.0), (0, 1, 3, 4.0), (0, 1, 4, 4.0), (1, 0, 0, 4.0), (1, 0, 1, 4.0), (1, 0, 2, 4.0)]


def test_documents_without_anything(spark):
    odd = documents(spark, None, "", "no xml", "<MPD></MPD>", "<MPD><Period/></MPD>", "<SmoothStreamingMedia/>", '<SmoothStreamingMedia><StreamIndex><c d="1"/></StreamIndex></SmoothStreamingMedia>')
    found, levels = manifests.representations(odd), manifests.smooth_levels(odd)
    assert manifests.dash_segments(found).count() == manifests.dash_streams(found).count() == 0
    assert manifests.smooth_segments(levels).count() == manifests.smooth_streams(levels).count() == 0
    assert manifests.dash_segments(manifests.representations(odd.where("false"))).count() == 0


def test_smooth_codecs(spark):
    rows_ = [("H264", "0000000167640028ff", "avc1.640028"), ("H264", "0000000168", "avc1.4D401E"), ("AACH", "1210", "mp4a.40.5"), ("AACL", "zz", "mp4a.40.2"), ("AACL", "", None), ("TTML", "", "stpp"), ("HVC1", "00", "hvc1")]
    x = spark.createDataFrame([r[:2] for r in rows_], "f string, p string").select(manifests.smooth_codec(F.col("f"), F.col("p")))
    assert [r[0] for r in x.collect()] == [r[2] for r in rows_]


def test_planning(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(planning.speed_bytes(F.lit(" 1.5m "))) == 1572864 and value(planning.speed_bytes(F.lit("-1K"))) is None and value(planning.speed_bytes(F.lit("5x"))) is None
    assert value(planning.second_millis(F.lit("1.23456"))) == 1234 and value(planning.second_millis(F.lit("7"))) == 7000 and value(planning.second_millis(F.lit("x.1"))) is None
    assert value(F.hex(planning.key_id(F.lit("{00112233-4455-6677-8899-aabbccddeeff} x")))) == "00112233445566778899AABBCCDDEEFF" and value(planning.key_id(F.lit("0011"))) is None
    assert value(planning.should_log("Off", F.lit("Off"))) is False and value(planning.should_log("Warn", F.lit("Error"))) is True
    assert value(planning.combine_group(F.lit(199), F.lit(90_001))) == "T0000.ts" and value(planning.combine_group(F.lit(199), F.lit(90_000))) == "T0001.ts"
    assert value(blobs.is_gzip(F.unhex(F.lit("1F8B")))) is False and value(blobs.is_gzip(F.unhex(F.lit("1F8B08")))) is True


def test_periods_are_joined_without_a_broadcast(spark, small):
    """There are as many rows as representations, however small the folded documents are guessed to be."""
    found = manifests.representations(queries.dash_documents(spark, small))
    plan = manifests.merged(manifests.dash_streams(found), manifests.dash_segments(found))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2


def test_roles_are_worked_out_once(spark):
    words = ["forced-subtitle", "Forced-Subtitle", "forcedsubtitle", "SUBTITLE", "main", "other", "", None]
    roles = spark.createDataFrame([(w,) for w in words], "w string").select(manifests.role(F.col("w")).alias("r")).collect()
    assert [x["r"] for x in roles] == ["ForcedSubtitle"] * 3 + ["Subtitle", "Main", None, None, None]
    text = '<MPD><Period><AdaptationSet mimeType="application/ttml+xml"><Role value="odd"/><Role value="main"/><Representation id="a"/><Representation id="b"><Role value="forced-subtitle"/></Representation></AdaptationSet></Period></MPD>'
    found = manifests.dash_streams(manifests.representations(spark.createDataFrame([(1, "http://h/x.mpd", text)], "manifest_id long, url string, text string")))
    assert [(r["role"], r["media_type"], r["extension"]) for r in found.orderBy("rep_pos").collect()] == [(None, None, "ttml+xml"), ("ForcedSubtitle", "Subtitles", "ttml")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") < 10


def test_smooth_urls_are_made_once_a_level(spark, small):
    doc = '<SmoothStreamingMedia TimeScale="2"><StreamIndex Type="video" Url="../q{bitrate}/{start time}"><QualityLevel FourCC="H264" Bitrate="5"/><QualityLevel FourCC="H264" Url="whole"/><c t="3" d="2" r="2"/><c d="4"/></StreamIndex></SmoothStreamingMedia>'
    x = manifests.smooth_segments(manifests.smooth_levels(documents(spark, doc)))
    assert rows(x.where("level_pos = 0").orderBy("seg_index"), "seg_index", "url", "name") == [(k, f"http://h/q5/{t}", t) for k, t in enumerate("357")]
    assert rows(x.where("level_pos = 1").orderBy("seg_index"), "seg_index", "url", "name") == [(k, "http://h/whole", None) for k in range(3)]
    # what is done chunk by chunk stands above the one that makes rows of them; lines are dealt before they are texts
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan(x) and "RLIKE" not in plan(x).split("posexplode(chunks")[0]
    assert "RepartitionByExpression" in plan(queries.smooth_documents(spark, small))


def test_urls_of_odd_templates_are_those_filled_first(spark):
    """A template is seen from its base once; what that could change is filled segment by segment as before."""
    media = ["s$Number$.m4s", "$Number%05d$/$Number$/$Time$", "../$Number%03d$?x=$Number%07d$", "http://o/$Number$/../$Time$.m4s", "h$Number$://x/$Number$", "/r/./$Number$", "?n=$Number$", "//o/$Number$", "$Number%00d$.x", "$Numbers$", "p.mp4", "$Number%99999999999d$"]
    given = [(k, k2, b, m) for k, b in enumerate(["http://h/a/b.mpd", "http://h", "http://h/$Number$/$Time$/c", "a/../b/"]) for k2, m in enumerate(media)]
    runs = "array(named_struct('kind', 'timeline', 'ref', null, 'range', null, 't', 90, 'd', 7, 'n', 2, 'seconds', 3.5D), named_struct('kind', 'list', 'ref', 'x.y', 'range', '3-9', 't', null, 'd', null, 'n', 1, 'seconds', 1D), named_struct('kind', 'list', 'ref', '../z', 'range', null, 't', null, 'd', null, 'n', 1, 'seconds', 1D))"
    runs = f"transform({runs}, r -> named_struct('kind', r.kind, 'ref', cast(r.ref as string), 'range', cast(r.range as string), 't', cast(r.t as bigint), 'd', cast(r.d as bigint), 'n', cast(r.n as bigint), 'seconds', r.seconds))"
    found = spark.createDataFrame(given, "manifest_id long, set_pos int, base string, media string").selectExpr("manifest_id", "0 as period_pos", "set_pos", "0 as rep_pos", "base", "media", "-8 + 3 as first", "false as is_live", f"{runs} as runs")
    ref = F.replace(names.template(F.col("media"), {"Number": F.col("first") + F.col("i")}), F.lit("$Time$"), (90 + 7 * F.col("i")).cast("string"))
    wanted = found.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).withColumn("ref", ref).withColumn("url", F.coalesce(names.combine_url(F.col("base"), F.col("ref")), F.col("base")))
    key = ["manifest_id", "set_pos", "seg_pos"]
    got = manifests.dash_segments(found).orderBy(*key).cache()
    assert rows(got.where("seg_pos < 2"), *key, "url") == rows(wanted.orderBy("manifest_id", "set_pos", "i"), "manifest_id", "set_pos", "i", "url")
    listed = wanted.where("i = 0").select("manifest_id", "set_pos", F.explode(F.array(F.struct(F.lit(2).alias("seg_pos"), names.combine_url(F.col("base"), F.lit("x.y")).alias("url")), F.struct(F.lit(3).alias("seg_pos"), names.combine_url(F.col("base"), F.lit("../z")).alias("url")))).alias("x"))
    assert rows(got.where("seg_pos >= 2"), *key, "url") == rows(listed.select("manifest_id", "set_pos", "x.*").orderBy(*key), *key, "url")
    assert manifests._patterned(found.where("manifest_id = 0")).where("pattern is null").count() == 1


def test_merging_at_once_gives_the_same_with_one_exchange(spark, small):
    """It wrote all representations, and dealt and joined all segments anew."""
    again = f'<Period id="2" duration="PT10S">{NUMBERS}</Period><Period id="3" duration="PT5S">{NUMBERS}</Period>'
    texts = [MPD.format(head="", sets=NUMBERS + TIMELINE + BARE + NUMBERS, more=again + f'<Period id="4">{TIMELINE}{BARE}</Period>'), MPD.format(head='type="dynamic" availabilityStartTime="1970-01-01T00:00:00Z"', sets=NUMBERS, more=again), MPD.format(head='type="dynamic"', sets=NUMBERS, more="")]
    for docs in (documents(spark, *texts), queries.dash_documents(spark, small)):
        found = manifests.representations(docs, now=F.lit(100))
        wanted = manifests.merged(manifests.dash_streams(found), manifests.dash_segments(found))
        assert sorted(map(str, manifests.merged_at_once(found).collect())) == sorted(map(str, wanted.collect()))
    plan = queries.QUERIES["dash_merged"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_a_template_without_widths_casts_nothing(spark):
    """A cast of an empty text fails within, at the cost of a stack trace a row."""
    x = spark.createDataFrame([("a$N$b", "7"), ("$N%03d$-$N$", "7"), ("$N%x", "7"), ("$N$", None), ("plain", None), ("$N%099999999999d$", "7")], "t string, v string")
    assert [r[0] for r in x.select(names.template(F.col("t"), {"N": F.col("v")})).collect()] == ["a7b", "007-7", "$N%x", None, "plain", "7"]
    assert "CASE WHEN !(=(regexp_extract" in str(names._filled(F.col("t"), "N", F.col("v")))
    assert [r[0] for r in spark.createDataFrame([("PT5S",), ("P1DT2H",), ("PT",), ("5S",)], "t string").select(moments.iso_duration(F.col("t"))).collect()] == [5.0, 93_600.0, 0.0, None]
