"""HLS rules with rows worked out by hand."""

from pyspark.sql import functions as F

from reelframe.functions import text as names
from reelframe.plans import queries
from reelframe.sources import playlists


def table(spark, *texts, url="http://h/p/list.m3u8"):
    return spark.createDataFrame([(k, url, t) for k, t in enumerate(texts)], "manifest_id long, url string, text string")


def rows(spark, text, *columns, url="http://h/p/list.m3u8", **more):
    found = playlists.media_segments(table(spark, text, url=url), **more).orderBy("part", "seg_index", "url").collect()
    return [tuple(r[c].rsplit("/", 1)[-1] if c == "url" else r[c] for c in columns or ("part", "seg_index", "url")) for r in found]


def facts(spark, *texts):
    return [(r["is_live"], r["refresh_ms"], r["map_url"], r["map_start"], r["map_length"], r["error"]) for r in playlists.playlist_facts(table(spark, *texts)).orderBy("manifest_id").collect()]


A, B, C = (f"#EXTINF:{k}.5,t\n{x}.ts\n" for k, x in enumerate("abc", 1))
DISC, END = "#EXT-X-DISCONTINUITY\n", "#EXT-X-ENDLIST\n"


def test_what_a_playlist_keeps(spark):
    assert rows(spark, A + DISC + B) == [(0, 0, "a.ts"), (1, 1, "b.ts")]
    # of type VOD without an end: the last part is lost, and so is all of one part
    assert rows(spark, "#EXT-X-PLAYLIST-TYPE:VOD\n" + A + DISC + B) == [(0, 0, "a.ts")]
    assert rows(spark, "#EXT-X-PLAYLIST-TYPE: VOD \n" + A) == []
    assert rows(spark, "#EXT-X-PLAYLIST-TYPE:VOD\n" + A + END) == [(0, 0, "a.ts")]
    # after the end, unless a discontinuity closes it, or a type says that it goes on
    assert rows(spark, A + END + B) == [(0, 0, "a.ts")]
    assert rows(spark, A + END + B + DISC + C) == [(0, 0, "a.ts"), (1, 1, "b.ts")]
    assert rows(spark, A + END + "#EXT-X-PLAYLIST-TYPE:EVENT\n" + B) == [(0, 0, "a.ts"), (1, 1, "b.ts")]
    # a second map ends it
    maps = '#EXT-X-MAP:URI="i.mp4"\n' + A + '#EXT-X-MAP:URI="j.mp4"\n' + B
    assert rows(spark, maps) == [(0, 0, "a.ts")]
    assert rows(spark, maps, multi_map=True) == [(0, 0, "a.ts"), (1, 1, "b.ts")]
    assert rows(spark, (A + DISC + B).replace("\n", "\r")) == [(0, 0, "a.ts"), (1, 1, "b.ts")]
    assert rows(spark, (A + DISC + B).replace("\n", "\r\n")) == [(0, 0, "a.ts"), (1, 1, "b.ts")]


def test_facts(spark):
    got = facts(spark, A, "#EXT-X-PLAYLIST-TYPE:VOD\n" + A, A + END, '#EXT-X-MAP:URI="i.mp4",BYTERANGE="7@3"\n' + A + '#EXT-X-MAP:URI="j"\n#EXT-X-TARGETDURATION:x\n', '#EXT-X-MAP:URI="i",BYTERANGE="7"\n', "#EXT-X-TARGETDURATION:1,000.5\n" + A + END + "#EXT-X-PLAYLIST-TYPE:EVENT\n")
    assert got == [(True, 10_000, None, None, None, None), (False, None, None, None, None, None), (False, None, None, None, None, None), (False, None, "http://h/p/i.mp4", 3, 7, None), (True, 10_000, "http://h/p/i", 0, 7, None), (True, 2_001_000, None, None, None, None)]


def test_errors_are_told(spark):
    texts = ["#EXT-X-MEDIA-SEQUENCE:x\n" + A, "#EXTINF:abc,\na.ts\n", "#EXT-X-BYTERANGE:5\n" + A, "#EXT-X-BYTERANGE:5@1\na\n#EXT-X-BYTERANGE:5\nb\n", "#EXT-X-BYTERANGE:5@1\na\n" + DISC + "#EXT-X-BYTERANGE:5\nb\n", "#EXT-X-BYTERANGE:z@1\n", "#EXT-X-PROGRAM-DATE-TIME:soon\n", "#EXT-X-MAP:X=1\n", "#EXT-X-TARGETDURATION:\n" + A, "#EXT-X-BYTERANGE:5@q\n", "#EXTINF:\n#EXT-X-MEDIA-SEQUENCE:x\n"]
    assert [x[-1] for x in facts(spark, *texts)] == ["media sequence", "duration", "byte range without a start", None, "byte range without a start", "byte range length", "program date time", "map without URI", "target duration", "byte range start", "duration"]
    assert rows(spark, texts[0]) == [(0, 0, "a.ts")]


def test_keys_and_dates(spark):
    key = '#EXT-X-KEY:METHOD=AES-128,URI="k"\n'
    # a key right behind a duration is moved before it; one behind the URL holds from the next segment on
    assert rows(spark, "#EXTINF:1,\n \n" + key + "a.ts\n" + B, "url", "method") == [("a.ts", "Aes128"), ("b.ts", "Aes128")]
    assert rows(spark, A + key + B + "#EXT-X-KEY:METHOD=NONE\n" + C, "url", "method") == [("a.ts", "None"), ("b.ts", "Aes128"), ("c.ts", "None")]
    assert rows(spark, "#EXT-X-MEDIA-SEQUENCE:-2\n#EXT-X-PROGRAM-DATE-TIME: 2024-01-02T03:04:05Z\n" + A + B, "seg_index", "date_time") == [(-2, "2024-01-02T03:04:05Z"), (-1, None)]
    assert rows(spark, "#EXT-X-BYTERANGE:10@5\n" + A + "#EXT-X-BYTERANGE:7\n" + B + "#EXT-X-BYTERANGE:1@2@3\n" + C, "range_start", "range_length") == [(5, 10), (15, 7), (22, 0)]


def test_ads(spark):
    ad = "#EXTINF:9,\nhttp://x/ad/1.ts?ccode=1&duration=2\n"
    assert rows(spark, A + DISC + ad + DISC + B) == [(0, 0, "a.ts"), (0, 1, "b.ts")]
    assert rows(spark, ad + A) == [(0, 0, "a.ts")]
    assert rows(spark, A + DISC + B + ad + DISC + C) == [(0, 0, "a.ts"), (0, 2, "c.ts")]
    assert rows(spark, A + "#UPLYNK-SEGMENT:1,ad\n" + B + "#UPLYNK-SEGMENT:1,segment\n" + C) == [(0, 0, "a.ts"), (0, 1, "c.ts")]
    assert rows(spark, "#EXTINF:1,\nhttp://x/y?ccode=0902&duration=1\n" + A) == [(0, 0, "a.ts")]


def test_masters(spark):
    text = '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="g",CHARACTERISTICS="public.easy,public.accessibility.describes-video",URI="a.m3u8"\n#EXT-X-MEDIA:TYPE=OTHER,URI="o.m3u8"\n#EXT-X-MEDIA:TYPE=CLOSED-CAPTIONS,URI="c.m3u8"\n#EXT-X-MEDIA:GROUP-ID="x",URI="n.m3u8"\n#EXT-X-STREAM-INF:BANDWIDTH=900,VIDEO="v"\nv.m3u8\n'
    got = {r["url"].rsplit("/", 1)[-1]: (r["media_type"], r["characteristics"], r["video_id"]) for r in playlists.master_streams(table(spark, text)).collect()}
    assert got == {"a.m3u8": ("Audio", "describes-video", None), "o.m3u8": (None, None, None), "n.m3u8": (None, None, None), "v.m3u8": (None, None, "v")}
    bad = [text, "#EXT-X-STREAM-INF:BANDWIDTH=1x\nv\n", "#EXT-X-STREAM-INF:BANDWIDTH=1,FRAME-RATE=x\nv\n"]
    assert [tuple(r) for r in playlists.master_errors(table(spark, *bad)).orderBy("manifest_id").collect()] == [(0, "rendition without TYPE"), (1, "bandwidth"), (2, "frame rate")]


def test_playlists_are_built_in_as_many_tasks_as_there_are_rows_for(spark):
    rows = queries.dealt(spark.range(250).toDF("k"), "k", most=100)
    assert rows.rdd.getNumPartitions() == 3 and queries.dealt(spark.range(0).toDF("k"), "k").count() == 0
    assert rows.groupBy("k").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_urls_beside_a_playlist_and_ads_are_told_as_by_whole_urls(spark):
    """An address was put together for every line of a playlist, to ask whether it is an ad."""
    bases = ["http://h/a/b.m3u8?q=1/2", "http://h", "http://h?x/y", "a/../b/c", "http://h/a/./b", "", "/r/x", "http://h/ad/l?ccode=1&duration=2", "h:", None]
    refs = ["x.ts", "..", ".", "a..b", "-1", "a/b", "/a", "?q", "http://o/x", "//o/x", "h:x", "", None, "é.ts", "x\n", "s/ad/x?ccode=0902&duration=1", "?ccode=1&duration=", "/ad/1?ccode=1&duration=3"]
    x = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    b, r = F.col("b"), F.col("r")
    whole = names.combine_url(b, r)
    got = x.select(names.seen_beside(b, names.beside(b), r), whole, F.coalesce(playlists.ad_at(b, r), F.lit(False)), F.coalesce(playlists.is_ad(whole), F.lit(False))).collect()
    assert all(g[0] == g[1] and g[2] == g[3] for g in got) and sum(g[2] for g in got) > 5
