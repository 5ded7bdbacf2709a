"""Every media query over the star schema's tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions import blobs, moments, planning, text
from reelframe.operators import clip, cues, events, jobs, live, select
from reelframe.plans import grammar, media, protection, raw, reports, subtitles, ttml
from reelframe.sources import adapters as a
from reelframe.sources import manifests, playlists
from reelframe.sources.adapters import dealt

AD = "/ad/"
START, END = 20.0, 60.0
KEEP = select.StreamFilter(codecs="^avc1", resolution="x(720|1080)$", frame_rate="^2[59]", bandwidth_min=50_000, choice="best2")
DROP = select.StreamFilter(language="^fr$", choice="all")
SEG, STR, EVT, JOB, CUE = (a.as_sql(x) for x in (a.SEGMENTS, a.STREAMS, a.EVENTS, a.JOBS, a.CUES))
RANK = "CASE WHEN media_type IS NULL THEN -1 WHEN media_type = 'Audio' THEN 0 WHEN media_type = 'Video' THEN 1 WHEN media_type = 'Subtitles' THEN 2 ELSE 3 END"
CHANNELS = "CASE channels WHEN '2' THEN 2 WHEN '6/JOC' THEN 6 ELSE 0 END"
BEST = f"{RANK}, bandwidth DESC NULLS LAST, {CHANNELS} DESC, stream_pos"
ALIKE = ", ".join(select.IDENTITY)
KEYS = ["manifest_id", "stream_pos"]
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def segments(spark, d):
    return a.read(spark, d, a.SEGMENTS)


def streams(spark, d):
    return a.read(spark, d, a.STREAMS)


def progress(spark, d):
    return a.read(spark, d, a.EVENTS)


def queue(spark, d):
    return a.read(spark, d, a.JOBS)


def lines(spark, d):
    return a.read(spark, d, a.CUES)


def with_totals(spark, d):
    return clip.totals(streams(spark, d), segments(spark, d))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refreshes of a live window of ten days, every five days; a stream per user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1_704_067_200) / 86_400)
    k = F.floor(day / 5)
    return e.select(F.col("user_id").alias("stream_id"), F.explode(F.array(k, k + 1)).alias("refresh"), F.col("event_id").alias("seg_pos"), F.col("event_id").alias("seg_index"),
                    F.col("event_id").cast("string").alias("name"), F.lit(None).cast("long").alias("unix_time"), (F.col("event_id") % 10).cast("double").alias("duration"))


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    url = F.col("url")
    return p.select("page_id", text.save_name(url).alias("save_name"), text.valid_file_name(url).alias("file_name"), text.combine_url(url, F.lit("../seg/a.ts")).alias("up"),
                    text.combine_url(url, F.lit("/root.ts")).alias("root"), text.normalize_token(url).alias("token"), text.percent_decoded(F.concat(F.lit("a+b%20"), F.col("page_id").cast("string"))).alias("decoded"))


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    n = F.col("event_id")
    return e.select("event_id", moments.unix_millis(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+01:00"))).alias("millis"),
                    moments.iso_duration(F.concat(F.lit("PT"), (n % 50).cast("string"), F.lit("H"), (n % 60).cast("string"), F.lit("M7S"))).alias("iso"),
                    moments.colon_seconds(F.concat((n % 24).cast("string"), F.lit(":"), (n % 60).cast("string"), F.lit(":5"))).alias("colon"),
                    moments.cue_millis(F.concat(F.lit("00:"), (n % 60).cast("string"), F.lit(":01.5"))).alias("cue"),
                    moments.clock(n).alias("clock"), moments.short_duration(n.cast("double")).alias("short"), cues.time_text(n * 37, ",").alias("srt"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.floor(F.col("o_totalprice") * 97).cast("long").alias("file_size"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip.split_ranges(files(spark, sf_dir), length=10_000_000)


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    link = F.concat(F.lit("u?token="), F.col("doc_id").cast("string"), F.lit("&q="), F.col("lang"), F.lit(" --key abc,sig=1&x"))
    return d.select("doc_id", text.redact(link).alias("redacted"), text.leaks(text.redact(link), ["abc"]).alias("leaks"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kbps = F.concat(F.expr("bandwidth div 1000").cast("string"), F.lit(" Kbps"))
    s = streams(spark, sf_dir)
    name = text.fill_pattern("<SaveName>_<Resolution>_<Language>..<Id>", {"SaveName": F.lit("show:"), "Resolution": F.col("resolution"), "Language": F.col("language"), "Id": F.col("stream_pos")})
    return s.select(*KEYS, text.label(F.col("resolution"), kbps, F.col("codecs"), F.col("language"), F.col("role")).alias("label"), name.alias("name"), text.file_size(F.col("bandwidth")).alias("size"))


def pick(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*KEYS, *more)


def worst_two(spark, d):
    return pick(select.choose(streams(spark, d), "worst2", select.stream_order()))


def fetched(spark, d):
    """Half of the streams moved to another host."""
    s = streams(spark, d)
    new = s.where("stream_pos % 2 = 0").withColumn("url", F.concat(F.lit("http://new.example/"), F.col("stream_pos").cast("string")))
    return pick(select.refreshed(s, new), "new_url")


def move_first(spark, d):
    """The queued job with the least id goes to the fifth place from the end."""
    q = queue(spark, d)
    return jobs.moved(q, q.where(F.col("status").isin(*jobs.QUEUED)).agg(F.min("gid")).first()[0], -4, "POS_END")


def aligned(spark, d):
    x = segments(spark, d).withColumn("manifest_id", F.col("stream_id") % 500)
    return live.aligned_start(x, "manifest_id", 3).groupBy("manifest_id", "stream_id").agg(F.count("*").alias("n"), F.min("seg_index").alias("first_index"))


def quoted(name: str, value) -> Column:
    """An attribute with a comma before it; nothing for null."""
    return F.coalesce(F.concat(F.lit(f',{name}="'), value, F.lit('"')), F.lit(""))


def media_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A media playlist of each order, a segment of each of its lines."""
    i = dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey")
    part, supp, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    said = lambda c: c.cast("string")
    key = F.when(supp % 3 == 0, F.concat(F.lit('#EXT-X-KEY:METHOD=AES-128,URI="k'), said(supp), F.lit('.key"'), F.when(supp % 2 == 0, ",IV=0x000102030405060708090A0B0C0D0E0F").otherwise(""), F.lit("\n"))).when(supp % 3 == 1, "#EXT-X-KEY:METHOD=NONE\n").otherwise("")
    size = F.when(part % 3 == 0, F.concat(F.lit("#EXT-X-BYTERANGE:"), said(part), F.lit("@"), said(supp), F.lit("\n"))).when(part % 3 == 1, F.concat(F.lit("#EXT-X-BYTERANGE:"), said(part), F.lit("\n"))).otherwise("")
    one = F.concat(F.when(n % 3 == 0, "#EXT-X-DISCONTINUITY\n").otherwise(""), key, F.lit("#EXTINF:"), said(F.col("l_quantity")), F.lit(",title\n"), size, F.when(n % 2 == 0, F.concat(F.lit("#EXT-X-PROGRAM-DATE-TIME: 2024-01-0"), said(n), F.lit("T00:00:00Z\n"))).otherwise(""), F.lit("seg"), said(part), F.lit(".ts\n"))
    each = i.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER, one.alias("line")))).alias("x"))
    order = F.col("l_orderkey")
    head = F.concat(F.lit("\ufeff#EXTM3U\r\n#EXT-X-TARGETDURATION:"), said(order % 9 + 1), F.lit("\r\n#EXT-X-MEDIA-SEQUENCE:"), said(order % 100), F.lit('\n\n#EXT-X-MAP:URI="init.mp4"\n'))
    body = F.array_join(F.transform("x", lambda x: x["line"]), "")
    return each.select(order.alias("manifest_id"), F.concat(F.lit("http://cdn.example/m/"), said(order), F.lit("/list.m3u8?q=1")).alias("url"), F.concat(head, body, F.when(order % 2 == 0, "#EXT-X-ENDLIST\n#EXTINF:1,\nlate.ts\n").when(order % 7 == 1, "#EXT-X-PLAYLIST-TYPE:VOD\n").otherwise("")).alias("text"))


def master_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master playlist of each manifest, a variant or rendition of each stream."""
    s = dealt(streams(spark, sf_dir), "manifest_id")
    kind = F.replace(F.upper("media_type"), F.lit("CLOSEDCAPTIONS"), F.lit("CLOSED-CAPTIONS"))
    media = F.concat(F.lit("#EXT-X-MEDIA:TYPE="), kind, quoted("GROUP-ID", F.col("group_id")), quoted("LANGUAGE", F.col("language")), quoted("NAME", F.col("name")), quoted("CHANNELS", F.col("channels")), quoted("URI", F.col("url")), F.lit("\n"))
    plain = lambda name, c: F.coalesce(F.concat(F.lit(f",{name}="), F.col(c).cast("string")), F.lit(""))
    variant = F.concat(F.lit("#EXT-X-STREAM-INF:PROGRAM-ID=1"), plain("BANDWIDTH", "bandwidth"), plain("RESOLUTION", "resolution"), plain("FRAME-RATE", "frame_rate"), quoted("CODECS", F.concat("codecs", F.lit(",mp4a.40.2"))),
                       quoted("AUDIO", F.col("audio_id")), quoted("SUBTITLES", F.col("subtitle_id")), plain("VIDEO-RANGE", "video_range"), F.lit("\n"), F.col("url"), F.lit("\n"))
    each = s.groupBy("manifest_id").agg(F.sort_array(F.collect_list(F.struct("stream_pos", F.when(kind.isNull(), variant).otherwise(media).alias("line")))).alias("x"))
    return each.select("manifest_id", F.lit("http://cdn.example/master.m3u8").alias("url"), F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform("x", lambda x: x["line"]), "")).alias("text"))


def dash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DASH document of each order: a timeline and a list of its lines in two periods, and a numbered track in both."""
    i = dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", 25_000)
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    said = lambda c: c.cast("string")
    entry = F.concat(F.lit("<S"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(' t="'), said(F.col("l_suppkey")), F.lit('"'))).otherwise(""), F.lit(' d="'), said(F.col("l_quantity").cast("long")), F.lit('" r="'), F.when(part % 10 == 9, "-1").otherwise(said(part % 3)), F.lit('"/>'))
    listed = F.concat(F.lit('<SegmentURL media="x'), said(part), F.lit('.m4s" mediaRange="'), said(part), F.lit("-"), said(part + 9), F.lit('"/>'))
    each = i.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER, entry.alias("entry"), listed.alias("listed")))).alias("x"))
    joined = lambda c: F.array_join(F.transform("x", lambda x: x[c]), "")
    audio = lambda name: F.concat(F.lit(f'<AdaptationSet contentType="audio" lang="en"><Representation id="a" bandwidth="64"><SegmentTemplate media="{name}'), F.lit('/$Number$-$Bandwidth$.m4s" duration="'), said(order % 7 + 3), F.lit('"/></Representation></AdaptationSet>'))
    body = F.concat(
        F.lit('\ufeff<?xml version="1.0"?>\n<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="static" mediaPresentationDuration="PT'), said(order % 50 + 10), F.lit('S"><BaseURL>http://cdn.example/d/'), said(order), F.lit("/</BaseURL>"),
        F.lit('<Period id="p0"><AdaptationSet mimeType="video/mp4"><Label>main</Label><SegmentTemplate timescale="2" media="v-$RepresentationID$-$Number%05d$-$Time$.m4s" initialization="init-$RepresentationID$.mp4" startNumber="'), said(order % 10), F.lit('"><SegmentTimeline>'),
        joined("entry"), F.lit('</SegmentTimeline></SegmentTemplate><Representation id="v" bandwidth="'), said(order), F.lit('" width="640" height="360" codecs="avc1.640028" frameRate="30000/1001"/></AdaptationSet>'), audio("a"),
        F.lit('</Period><Period id="p1"><AdaptationSet mimeType="video/mp4"><Role value="main"/><BaseURL>two/</BaseURL><Representation id="v" width="640" height="360"><SegmentList duration="4" timescale="2"><Initialization sourceURL="i.mp4" range="0-99"/>'),
        joined("listed"), F.lit("</SegmentList></Representation></AdaptationSet>"), F.when(order % 2 == 0, audio("a")).otherwise(audio("b")), F.lit("</Period></MPD>"),
    )
    return each.select(order.alias("manifest_id"), F.lit("http://origin.example/x.mpd").alias("url"), body.alias("text"))


def smooth_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Smooth Streaming document of each order, a chunk entry of each of its lines."""
    i = dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey")
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    said = lambda c: c.cast("string")
    entry = F.concat(F.lit("<c"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(' t="'), said(F.col("l_suppkey")), F.lit('"'))).otherwise(""), F.lit(' d="'), said(F.col("l_quantity").cast("long")), F.lit('"'),
                     F.when(part % 10 == 9, ' r="-1"').when(part % 3 > 0, F.concat(F.lit(' r="'), said(part % 3), F.lit('"'))).otherwise(""), F.lit("/>"))
    each = i.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER, entry.alias("entry")))).alias("x"))
    body = F.concat(
        F.lit('<?xml version="1.0"?><SmoothStreamingMedia TimeScale="4" Duration="'), said(order % 50 + 10), F.lit('"><StreamIndex Type="video" Name="video" Url="q({bitrate})/f({start time})">'),
        F.lit('<QualityLevel Index="0" FourCC="h264" Bitrate="'), said(order), F.lit('" MaxWidth="640" MaxHeight="360" CodecPrivateData="000000016742C01E0000000168"/><QualityLevel Index="1" FourCC="WVC1" Bitrate="5"/><QualityLevel Index="2" FourCC="HVC1" Bitrate="7" CodecPrivateData="00" Url="h/{bitrate}.m4s"/>'),
        F.array_join(F.transform("x", lambda x: x["entry"]), ""), F.lit('</StreamIndex><StreamIndex Type="audio" Language="eng" Url="a({Bitrate})/f({start_time})"><QualityLevel Index="0" FourCC="AACL" Bitrate="9" Channels="2" CodecPrivateData="1210"/><c t="0" d="8" r="2"/></StreamIndex></SmoothStreamingMedia>'),
    )
    return each.select(order.alias("manifest_id"), F.concat(F.lit("http://cdn.example/s/"), said(order), F.lit("/Manifest")).alias("url"), body.alias("text"))


def seen_progress(spark, d):
    """Progress as shown; the numbers of segments are made to vary."""
    e = progress(spark, d)
    n = F.col("event_seq")
    done, total = n % 3, F.when(n % 4 > 0, n % 4)
    sizes = F.col("downloaded_bytes"), F.col("total_bytes")
    level = F.when(F.col("kind") == "Warning", "Warn").when(F.col("kind") == "StreamProgress", "Debug").otherwise("Info")
    return e.select("event_seq", planning.progress_percent(done, total, *sizes).alias("percent"), planning.display_total(done, total, *sizes).alias("shown_bytes"),
                    *(planning.should_log(x, level).alias(f"log_{x.lower()}") for x in ("Debug", "Info", "Error")), events.items_per_second(done, n).alias("rate"), moments.bandwidth_bps(n).alias("bps"))


def planned(spark, d):
    s = with_totals(spark, d)
    extension = F.when(F.col("codecs").startswith("hvc1"), "mp4").when(F.col("codecs").startswith("mp4a"), "m4s").when(F.col("stream_pos") % 2 == 0, "vtt")
    name = planning.task_name(F.col("stream_pos"), F.col("group_id"), F.col("codecs"), F.col("bandwidth"), F.col("language"))
    support = planning.encode_support(F.col("methods"), F.when(F.col("stream_pos") % 13 > 0, F.col("codecs")), F.col("media_type"))
    return s.select(*KEYS, F.concat(name, planning.output_extension(extension, F.col("media_type"))).alias("path"), planning.output_extension(extension, F.col("media_type"), "srt").alias("repaired"), support.alias("support"))


def combined(spark, d):
    """The segments of a supplier as one list of files."""
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", *LINE_ORDER)
    return live.grouped_files(x, "l_suppkey", ["l_orderkey", *LINE_ORDER[:2], *LINE_ORDER[3:]]).groupBy("l_suppkey", "file").agg(F.count("*").alias("n"))


def words(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    n = F.col("o_orderkey")
    said = n.cast("string")
    digest = F.md5(said.cast("binary"))
    kid = F.concat(F.lit("{"), F.left(digest, F.lit(8)), F.lit("-"), F.substring(digest, 9, 24), F.lit("} more"))
    speed = F.concat(said, F.when(n % 4 == 0, "k").when(n % 4 == 1, "M").when(n % 4 == 2, "x").otherwise(""))
    return o.select("o_orderkey", F.lower(F.hex(planning.key_id(kid))).alias("kid"), planning.speed_bytes(speed).alias("speed"), planning.second_millis(F.concat(said, F.lit("."), (n % 9).cast("string"), F.lit("77"), said)).alias("millis"),
                    moments.frame_rate(F.concat(said, F.lit("/4"))).alias("rate"))


def dash(spark, d):
    return manifests.representations(dash_documents(spark, d))


def dash_joined(spark, d):
    return manifests.merged_at_once(dash(spark, d)).select("manifest_id", "period_pos", "set_pos", "part", "seg_index", "url", "duration")


def segment_rows(spark, d):
    return playlists.media_segments(media_playlists(spark, d)).withColumn("iv", F.lower(F.hex("iv")))


QUERIES = {
    "hls_media": segment_rows,
    "hls_facts": lambda s, d: playlists.playlist_facts(media_playlists(s, d)),
    "hls_master": lambda s, d: playlists.master_streams(master_playlists(s, d)).drop("pos", "video_id", "characteristics"),
    "dash_streams": lambda s, d: manifests.dash_streams(dash(s, d)),
    "dash_segments": lambda s, d: manifests.dash_segments(dash(s, d)).drop("seg_pos"),
    "dash_merged": dash_joined,
    "smooth_streams": lambda s, d: manifests.smooth_streams(manifests.smooth_levels(smooth_documents(s, d))),
    "smooth_segments": lambda s, d: manifests.smooth_segments(manifests.smooth_levels(smooth_documents(s, d))),
    "progress_view": seen_progress,
    "planned_outputs": planned,
    "combine_groups": combined,
    "same_names": lambda s, d: live.same_names(segments(s, d), "stream_id"),
    "option_words": words,
    "time_range_clip": lambda s, d: clip.clip_summary(segments(s, d), START, END),
    "index_range_clip": lambda s, d: clip.clip_summary(segments(s, d), 2, 4, "index"),
    "clip_rows": lambda s, d: clip.clip(segments(s, d), START, END).select("stream_id", "part_pos", "seg_index", "url", "before"),
    "ad_cleanup": lambda s, d: clip.without_ads(segments(s, d), [AD]).groupBy("stream_id", "part_pos").agg(F.count("*").alias("n"), F.sum("duration").alias("duration")),
    "ad_counts": lambda s, d: clip.ad_counts(segments(s, d), [AD]),
    "stream_totals": lambda s, d: with_totals(s, d).select(*KEYS, "segment_count", "total_duration", F.array_join("methods", ",").alias("methods")),
    "merge_flags": lambda s, d: clip.merge_flags(segments(s, d)),
    "over_limits": lambda s, d: clip.over_limits(segments(s, d), 6),
    "segment_batches": lambda s, d: clip.batches(segments(s, d), 3).select("stream_id", "seg_index", "tie", "price", "batch"),
    "range_split": sizes,
    "range_split_all": lambda s, d: clip.split_ranges(files(s, d), length=10_000_000),
    "stream_order": lambda s, d: pick(select.ordered(streams(s, d)), "place"),
    "filter_keep": lambda s, d: pick(select.filter_keep(streams(s, d), KEEP, select.stream_order())),
    "filter_drop": lambda s, d: pick(select.filter_drop(with_totals(s, d), DROP)),
    "filter_segments": lambda s, d: pick(select.filter_keep(with_totals(s, d), select.StreamFilter(segments_min=2, duration_max=150.0, choice="all"))),
    "drop_then_keep": lambda s, d: pick(select.apply_filters(with_totals(s, d), {"Audio": select.StreamFilter(choice="best"), "Video": select.StreamFilter(choice="best2")}, {"Video": select.StreamFilter(resolution="1920", choice="all")})),
    "worst_streams": worst_two,
    "auto_select": lambda s, d: pick(select.auto_select(streams(s, d))),
    "subtitles_only": lambda s, d: pick(select.of_type(streams(s, d), "Subtitles")),
    "interactive_defaults": lambda s, d: pick(select.interactive_defaults(streams(s, d))),
    "streams_by_id": lambda s, d: pick(select.with_ids(streams(s, d), ["g1", "http://cdn.example/s/5.m3u8"])),
    "unique_streams": lambda s, d: pick(select.unique(streams(s, d).withColumn("bandwidth", F.lit(None).cast("long")))),
    "first_by_url": lambda s, d: pick(select.first_by_url(streams(s, d))),
    "refreshed_urls": fetched,
    "default_audio": lambda s, d: select.default_track(streams(s, d), "Audio", True),
    "default_subtitles": lambda s, d: select.default_track(streams(s, d), "Subtitles", False),
    "event_summary": lambda s, d: events.summary(progress(s, d)),
    "event_warnings": lambda s, d: events.warnings(progress(s, d)),
    "job_counters": lambda s, d: events.job_counters(progress(s, d)),
    "stream_states": lambda s, d: events.stream_states(progress(s, d)),
    "segment_bitfield": lambda s, d: events.bitfield(progress(s, d)),
    "stalled_ticks": lambda s, d: events.stalls(progress(s, d), 2),
    "queue_order": lambda s, d: jobs.numbered(queue(s, d).where("status = 'waiting'")).select("gid", "place"),
    "queue_page": lambda s, d: jobs.page(queue(s, d), 5, 20).select("gid"),
    "queue_page_backwards": lambda s, d: jobs.page(queue(s, d), -3, 20).select("gid"),
    "queue_start": lambda s, d: jobs.to_start(queue(s, d), 320).select("gid"),
    "queue_move": move_first,
    "queue_to_front": lambda s, d: jobs.to_front(queue(s, d), "cfcd208495d565ef").select("gid", "queue_position"),
    "queue_retained": lambda s, d: jobs.retained(queue(s, d), 100).select("gid"),
    "global_stat": lambda s, d: jobs.global_stat(queue(s, d)),
    "job_lookup": lambda s, d: jobs.lookup(queue(s, d), queue(s, d).select(F.left("gid", F.lit(3)).alias("prefix")).distinct(), 3),
    "job_status": lambda s, d: jobs.status(queue(s, d), ["gid", "status", "completed_length"]),
    "merged_cues": lambda s, d: cues.merged(lines(s, d)),
    "grouped_cues": lambda s, d: cues.grouped(lines(s, d).withColumns({"start_ms": F.expr("cue_pos div 3 * 1000"), "end_ms": F.expr("cue_pos div 3 * 1000 + cue_pos % 2 + 1")})),
    "shifted_cues": lambda s, d: cues.from_base(cues.left_shift(lines(s, d), 1500), 500).select("doc_id", "cue_pos", "start_ms", "end_ms"),
    "cues_as_srt": lambda s, d: cues.as_text(lines(s, d), "srt"),
    "cues_as_vtt": lambda s, d: cues.as_text(lines(s, d)),
    "live_new_segments": lambda s, d: live.new_segments(snapshots(s, d)).select("stream_id", "refresh", "seg_index", "refreshed_seconds", "refreshed_segments"),
    "live_wait": lambda s, d: live.wait_seconds(segments(s, d)),
    "live_alignment": aligned,
    "url_names": scalars,
    "time_functions": times,
    "redaction": hidden,
    "stream_labels": labels,
    "range_headers": lambda s, d: segments(s, d).select("stream_id", "seg_index", "tie", "price", blobs.range_header(F.col("tie"), F.col("seg_index")).alias("header"), F.lower(F.hex(blobs.implicit_iv(F.col("seg_index") - 3))).alias("iv")),
}


def _first(keys: str, order: str, where: str = "true", source: str = STR) -> str:
    return f"SELECT manifest_id, stream_pos FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id{keys} ORDER BY {order}) AS rn FROM {source} WHERE {where}) WHERE rn = 1"


BEFORE = f"SELECT *, coalesce(sum(duration) OVER (PARTITION BY stream_id ORDER BY seg_index RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM {SEG}"


def _clip(kept: str) -> str:
    return f"""WITH b AS (SELECT *, {kept} AS kept FROM ({BEFORE})),
    f AS (SELECT *, min(CASE WHEN kept THEN seg_index END) OVER (PARTITION BY stream_id, part_pos) AS first_kept FROM b)
    SELECT stream_id, CAST(sum(CASE WHEN kept THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, coalesce(sum(CASE WHEN kept THEN duration END), 0.0::DOUBLE) AS kept_duration,
      coalesce(sum(CASE WHEN seg_index < first_kept THEN duration END), 0.0::DOUBLE) AS skipped_duration FROM f GROUP BY stream_id"""


def _entries(times: str) -> str:
    """Entries of timelines with how often each runs, what runs before it, and its first tick."""
    by, w = "PARTITION BY l_orderkey", f"PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}"
    return f"""n AS (SELECT l_orderkey AS o, l_partkey, row_number() OVER ({w}) AS nth, CAST(l_quantity AS BIGINT) AS d, CASE WHEN l_partkey % 10 = 9 THEN greatest(CAST(ceil(({times}) / CAST(l_quantity AS BIGINT)) AS BIGINT), 1) ELSE greatest(l_partkey % 3 + %s, 1) END AS c,
          CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey END AS t FROM lineitem),
        k AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY o ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(t) OVER (PARTITION BY o ORDER BY nth ROWS UNBOUNDED PRECEDING) AS island FROM n),
        s AS (SELECT *, coalesce(first_value(t) OVER (PARTITION BY o, island ORDER BY nth), 0) + coalesce(sum(c * d) OVER (PARTITION BY o, island ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began FROM k),
        e AS (SELECT *, unnest(range(c)) AS i FROM s)"""


ORDERS = "(SELECT DISTINCT l_orderkey AS o, 'http://cdn.example/d/' || l_orderkey || '/' AS base, CAST(ceil((l_orderkey % 50 + 10.0) / (l_orderkey % 7 + 3)) AS BIGINT) AS n FROM lineitem)"
DASH = f"""{_entries("(l_orderkey % 50 + 10) * 2.0").replace("%s", "1")},
        d AS (SELECT o AS manifest_id, 0 AS period_pos, 0 AS set_pos, CAST(before + i AS BIGINT) AS seg_index, 'http://cdn.example/d/' || o || '/v-v-' || printf('%05d', CAST(o % 10 + before + i AS BIGINT)) || '-' || CAST(began + i * d AS BIGINT) || '.m4s' AS url, d / 2.0::DOUBLE AS duration,
            CAST(CAST(began + i * d AS BIGINT) AS VARCHAR) AS name, NULL::BIGINT AS range_start, NULL::BIGINT AS range_length FROM e
          UNION ALL SELECT o, 1, 0, nth - 1, 'http://cdn.example/d/' || o || '/two/x' || l_partkey || '.m4s', 2.0, NULL, l_partkey, 10 FROM n
          UNION ALL SELECT o, p, 1, i, base || CASE WHEN p = 1 AND o % 2 = 1 THEN 'b/' ELSE 'a/' END || (i + 1) || '-64.m4s', CAST(o % 7 + 3 AS DOUBLE), CAST(i + 1 AS VARCHAR), NULL, NULL FROM (SELECT *, unnest(range(n)) AS i FROM {ORDERS}), (SELECT unnest([0, 1]) AS p))"""
TOTALS = f"""(SELECT s.*, coalesce(n, 0) AS segment_count, total_duration, coalesce(methods, '') AS methods FROM {STR} s LEFT JOIN
  (SELECT stream_id, count(*) AS n, sum(duration) AS total_duration, string_agg(DISTINCT CASE WHEN method <> 'None' THEN method END, ',' ORDER BY CASE WHEN method <> 'None' THEN method END) AS methods FROM {SEG} GROUP BY stream_id) g
  ON g.stream_id = s.stream_pos)"""
SHOWN = """CASE WHEN media_type = 'Audio' THEN concat_ws('|', 'A', {audio}) WHEN media_type = 'Subtitles' THEN concat_ws('|', 'S', {subs}) ELSE concat_ws('|', 'V', {video}) END""".format(
    **{k: ", ".join(f"coalesce('+' || CAST({'bandwidth // 1000' if c == 'kbps' else c} AS VARCHAR), '-')" for c in (*select.LISTED[t], "segment_count", "coalesce(total_duration, 0)")) for k, t in (("audio", "Audio"), ("subs", "Subtitles"), ("video", "Video"))}
)
KEPT = "regexp_matches(codecs, '^avc1') AND regexp_matches(resolution, 'x(720|1080)$') AND frame_rate IS NOT NULL AND bandwidth >= 50000"
VIDEO = "(media_type IS NULL OR media_type = 'Video')"
QUEUE_ORDER = "queue_position, created_at_ms, gid"
AGG, STREAM = "kind = 'AggregateProgress'", "kind = 'StreamProgress'"
STATES = f"""ends AS (SELECT session_id, stream_id, max(CASE WHEN kind IN ('StreamProgress', 'LiveRefresh') THEN event_seq END) AS since,
    coalesce(arg_max(downloaded_bytes, event_seq) FILTER ({STREAM}), 0) AS length, max(CASE WHEN {STREAM} THEN event_seq END) AS lp,
    coalesce(arg_max(bytes_per_second, event_seq) FILTER ({STREAM}), 0) AS speed,
    coalesce(arg_max(completed_segments, event_seq) FILTER (kind IN ('StreamProgress', 'LiveRefresh')), 0) AS sc,
    arg_max(total_segments, event_seq) FILTER (kind IN ('StreamProgress', 'LiveRefresh')) AS segments, count(DISTINCT CASE WHEN kind = 'SegmentFinished' THEN segment_index END) AS n_finished
    FROM e WHERE kind IN ('StreamProgress', 'LiveRefresh', 'SegmentFinished') GROUP BY ALL),
  states AS (SELECT session_id, stream_id, length, (SELECT total_bytes FROM e WHERE e.event_seq = ends.lp) AS total, speed, segments, n_finished,
    greatest(sc, coalesce((SELECT max(segment_index + 1) FROM e WHERE e.session_id = ends.session_id AND e.stream_id = ends.stream_id AND kind = 'SegmentFinished' AND (since IS NULL OR event_seq > since)), 0)) AS completed FROM ends)"""


def _cue_text(kind: str) -> str:
    mark = "." if kind == "vtt" else ","
    stamp = lambda c: f"printf('%02d:%02d:%02d{mark}%03d', {c} // 3600000, ({c} // 60000) % 60, ({c} // 1000) % 60, {c} % 1000)"
    one = f"{stamp('start_ms')} || ' --> ' || {stamp('end_ms')} || " + ("' ' || settings || e'\\r\\n'" if kind == "vtt" else "e'\\r\\n'") + " || payload || e'\\r\\n\\r\\n'"
    one = one if kind == "vtt" else "CAST(n AS VARCHAR) || e'\\r\\n' || " + one
    head = "e'WEBVTT\\r\\n\\r\\n' || " if kind == "vtt" else ""
    return f"SELECT doc_id, {head}string_agg({one}, '' ORDER BY n) || e'\\r\\n' AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cue_pos) AS n FROM {CUE}) GROUP BY doc_id"


SQL = {
    "hls_media": f"""
        WITH n AS (SELECT *, row_number() OVER w AS nth, sum(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) OVER w AS cuts,
            last_value(CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey WHEN l_suppkey % 3 = 1 THEN -1 END IGNORE NULLS) OVER w AS k
          FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)} ROWS UNBOUNDED PRECEDING)),
        p AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY cuts) - 1 AS part FROM n),
        c AS (SELECT *, sum(CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, part ORDER BY nth ROWS UNBOUNDED PRECEDING) AS chain, CASE WHEN l_partkey % 3 < 2 THEN l_partkey END AS size FROM p),
        r AS (SELECT *, first_value(CASE WHEN l_partkey % 3 = 0 THEN l_suppkey END) OVER (PARTITION BY l_orderkey, part, chain ORDER BY nth) AS first_start,
            coalesce(sum(size) OVER (PARTITION BY l_orderkey, part, chain ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
        SELECT l_orderkey AS manifest_id, CAST(part AS INT) AS part, l_orderkey % 100 + nth - 1 AS seg_index, CASE WHEN l_linenumber % 2 = 0 THEN '2024-01-0' || l_linenumber || 'T00:00:00Z' END AS date_time, 'http://cdn.example/m/' || l_orderkey || '/seg' || l_partkey || '.ts' AS url, l_quantity AS duration,
          CAST(CASE WHEN size IS NOT NULL THEN first_start + before END AS BIGINT) AS range_start, CAST(size AS BIGINT) AS range_length, CASE WHEN k >= 0 THEN 'Aes128' ELSE 'None' END AS method,
          CASE WHEN k >= 0 THEN 'http://cdn.example/m/' || l_orderkey || '/k' || k || '.key' END AS key_uri,
          CASE WHEN k >= 0 AND k % 2 = 0 THEN '000102030405060708090a0b0c0d0e0f' WHEN k >= 0 THEN lower(lpad(to_hex(CAST(l_orderkey % 100 + nth - 1 AS BIGINT)), 32, '0')) END AS iv FROM (SELECT *, max(cuts) OVER (PARTITION BY l_orderkey) AS last_cut FROM r) WHERE l_orderkey % 2 = 0 OR l_orderkey % 7 <> 1 OR cuts < last_cut""",
    "hls_facts": """
        WITH n AS (SELECT *, row_number() OVER w AS nth, sum(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) OVER w AS cuts FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {lines} ROWS UNBOUNDED PRECEDING)),
        c AS (SELECT *, sum(CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, cuts ORDER BY nth ROWS UNBOUNDED PRECEDING) AS started FROM n)
        SELECT l_orderkey AS manifest_id, CAST(l_orderkey % 9 + 1 AS DOUBLE) AS target_duration, l_orderkey % 2 <> 0 AND l_orderkey % 7 <> 1 AS is_live, NULL::BIGINT AS map_start, NULL::BIGINT AS map_length,
          CASE WHEN bool_or(l_partkey % 3 = 1 AND started = 0) THEN 'byte range without a start' END AS error,
          CASE WHEN l_orderkey % 2 <> 0 AND l_orderkey % 7 <> 1 THEN CAST((l_orderkey % 9 + 1) * 2000 AS BIGINT) END AS refresh_ms, 'http://cdn.example/m/' || l_orderkey || '/init.mp4' AS map_url FROM c GROUP BY l_orderkey""".replace("{lines}", ", ".join(LINE_ORDER)),
    "hls_master": f"""
        SELECT manifest_id, media_type, CASE WHEN media_type IS NOT NULL THEN group_id END AS group_id, CASE WHEN media_type IS NOT NULL THEN nullif(language, '') END AS language,
          CASE WHEN media_type IS NOT NULL THEN name END AS name, CASE WHEN media_type IS NOT NULL THEN channels END AS channels, CASE WHEN media_type IS NULL THEN coalesce(bandwidth, 0) END AS bandwidth,
          CASE WHEN media_type IS NULL THEN codecs || CASE WHEN audio_id IS NULL THEN ',mp4a.40.2' ELSE '' END END AS codecs, CASE WHEN media_type IS NULL THEN resolution END AS resolution,
          CASE WHEN media_type IS NULL THEN frame_rate END AS frame_rate, CASE WHEN media_type IS NULL THEN audio_id END AS audio_id, CASE WHEN media_type IS NULL THEN subtitle_id END AS subtitle_id,
          CASE WHEN media_type IS NULL THEN video_range END AS video_range, url
        FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id, url ORDER BY stream_pos) AS nth FROM {STR} WHERE media_type IS NULL OR media_type <> 'ClosedCaptions') WHERE nth = 1""",
    "dash_streams": f"""
        SELECT b.o AS manifest_id, p AS period_pos, a AS set_pos, 0 AS rep_pos, 'p' || p AS period_id, CASE a WHEN 0 THEN 'v' ELSE 'a' END AS group_id, CASE WHEN a = 1 THEN 'Audio' END AS media_type,
          CAST(CASE WHEN a = 1 THEN 64 WHEN p = 0 THEN b.o ELSE 0 END AS BIGINT) AS bandwidth, CASE WHEN a = 0 AND p = 0 THEN 'avc1.640028' END AS codecs, CASE WHEN a = 1 THEN 'en' END AS language, CASE WHEN a = 0 AND p = 0 THEN 'main' END AS name,
          CASE WHEN a = 0 AND p = 0 THEN 29.97::DOUBLE END AS frame_rate, CASE WHEN a = 0 THEN '640x360' END AS resolution, NULL::VARCHAR AS channels, CASE WHEN a = 0 AND m = 1 THEN 'mp4' ELSE 'm4s' END AS extension, CASE WHEN a = 0 AND p = 1 THEN 'Main' END AS role, NULL::VARCHAR AS video_range,
          false AS is_live, NULL::DOUBLE AS refresh_ms, CASE WHEN a = 0 THEN base || CASE p WHEN 0 THEN 'init-v.mp4' ELSE 'two/i.mp4' END END AS init_url, CASE WHEN a = 0 AND p = 1 THEN '0-99' END AS init_range, CAST(m AS BIGINT) AS segment_count
        FROM (SELECT *, CASE WHEN a = 1 THEN n ELSE m0 END AS m FROM {ORDERS} b JOIN (SELECT manifest_id AS mo, period_pos AS p, set_pos AS a, count(*) AS m0 FROM (WITH {DASH} SELECT * FROM d) GROUP BY ALL) ON mo = o) b""",
    "dash_segments": f"WITH {DASH} SELECT *, 0 AS rep_pos FROM d",
    "dash_merged": f"""
        WITH {DASH}, g AS (SELECT *, max(CASE WHEN period_pos = 0 THEN seg_index END) OVER (PARTITION BY manifest_id, set_pos) AS last FROM d),
          x AS (SELECT *, set_pos = 1 AND manifest_id % 2 = 0 AS same FROM g)
        SELECT manifest_id, 0 AS period_pos, set_pos, CAST(period_pos AS BIGINT) AS part, seg_index + CASE WHEN period_pos = 1 THEN last + 1 ELSE 0 END AS seg_index, url,
          duration + CASE WHEN same AND seg_index = last THEN (last + 1) * duration ELSE 0 END AS duration FROM x WHERE NOT (same AND period_pos = 1)""",
    "smooth_streams": """
        SELECT o AS manifest_id, i AS index_pos, l AS level_pos, CASE WHEN i = 1 THEN 'Audio' END AS media_type, CASE WHEN i = 1 THEN '0' ELSE 'video' END AS group_id, CASE WHEN i = 1 THEN 'eng' END AS language, CAST(CASE WHEN i = 1 THEN 9 WHEN l = 0 THEN o ELSE 7 END AS BIGINT) AS bandwidth,
          CASE WHEN i = 1 THEN 'mp4a.40.2' WHEN l = 0 THEN 'avc1.42C01E' ELSE 'hvc1' END AS codecs, CASE WHEN i = 0 AND l = 0 THEN '640x360' END AS resolution, CASE WHEN i = 1 THEN '2' END AS channels, 'm4s' AS extension, false AS is_live
        FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem), (VALUES (0, 0), (0, 2), (1, 0)) v(i, l)""",
    "smooth_segments": f"""
        WITH {_entries("l_orderkey % 50 + 10.0").replace("%s", "0")}, u AS (SELECT *, 'http://cdn.example/s/' || o || '/' AS base, CAST(began + i * d AS BIGINT) AS tick FROM e)
        SELECT o AS manifest_id, 0 AS index_pos, 0 AS level_pos, CAST(before + i AS BIGINT) AS seg_index, base || 'q(' || o || ')/f(' || tick || ')' AS url, d / 4.0::DOUBLE AS duration, CAST(tick AS VARCHAR) AS name FROM u
        UNION ALL SELECT o, 0, 2, CAST(before + i AS BIGINT), base || 'h/7.m4s', d / 4.0, NULL FROM u
        UNION ALL SELECT o, 1, 0, i, 'http://cdn.example/s/' || o || '/a(9)/f(' || i * 8 || ')', 2.0, CAST(i * 8 AS VARCHAR) FROM (SELECT DISTINCT o, j AS i FROM n, (SELECT unnest(range(2)) AS j))""",
    "progress_view": f"""
        WITH e AS (SELECT *, event_seq % 3 AS done, nullif(event_seq % 4, 0) AS total, CASE kind WHEN 'Warning' THEN 2 WHEN 'StreamProgress' THEN 0 ELSE 1 END AS level FROM {EVT}),
          b AS (SELECT *, CASE WHEN total_bytes > 0 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, (downloaded_bytes / total_bytes) * 100.0::DOUBLE)) END AS by_bytes FROM e)
        SELECT event_seq, CASE WHEN total = 1 AND done = 0 AND by_bytes IS NOT NULL THEN by_bytes WHEN total IS NOT NULL THEN least(100.0::DOUBLE, (done / total) * 100.0::DOUBLE) ELSE coalesce(by_bytes, 0.0::DOUBLE) END AS percent,
          CASE WHEN total_bytes IS NOT NULL THEN total_bytes WHEN done > 0 AND done < total THEN CAST(floor(downloaded_bytes * total / done) AS BIGINT) END AS shown_bytes, true AS log_debug, level > 0 AS log_info, false AS log_error,
          done * 1000 // greatest(event_seq, 1) AS rate, event_seq * 1000 AS bps FROM b""",
    "planned_outputs": f"""
        WITH t AS (SELECT *, CASE WHEN codecs LIKE 'hvc1%' THEN 'mp4' WHEN codecs LIKE 'mp4a%' THEN 'm4s' WHEN stream_pos % 2 = 0 THEN 'vtt' END AS ext FROM {TOTALS}),
          x AS (SELECT *, CASE WHEN ext IN ('mp4', 'm4s') AND media_type = 'Audio' THEN '.m4a' WHEN ext IN ('mp4', 'm4s') AND media_type IS DISTINCT FROM 'Subtitles' THEN '.mp4' ELSE '.' || coalesce(ext, 'ts') END AS dot FROM t)
        SELECT manifest_id, stream_pos, stream_pos || '_' || group_id || '_' || codecs || '_' || coalesce(CAST(bandwidth AS VARCHAR), '') || '_' || coalesce(language, '') || dot AS path,
          CASE WHEN media_type = 'Subtitles' THEN '.srt' ELSE dot END AS repaired,
          CASE WHEN methods LIKE '%SampleAes%' OR methods LIKE '%Unknown%' THEN 'Unsupported' WHEN stream_pos % 13 = 0 THEN 'RequiresProbe' WHEN media_type IN ('Subtitles', 'ClosedCaptions') OR media_type = 'Audio' AND codecs NOT LIKE 'mp4a%' THEN 'Refused' ELSE 'Supported' END AS support FROM x""",
    "combine_groups": f"""
        SELECT l_suppkey, printf('T%04d.ts', CAST(place // CASE WHEN c <= 90000 THEN 100 ELSE 200 END AS BIGINT)) AS file, count(*) AS n
        FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, {", ".join(LINE_ORDER)}) - 1 AS place, count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem) GROUP BY ALL""",
    "same_names": "SELECT l_orderkey AS stream_id, count(*) > 1 AND count(DISTINCT l_partkey) = 1 AS same_name FROM lineitem GROUP BY l_orderkey",
    "option_words": """
        SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS kid, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 1024 WHEN 1 THEN o_orderkey * 1048576 WHEN 3 THEN o_orderkey END AS speed,
          o_orderkey * 1000 + o_orderkey % 9 * 100 + 77 AS millis, round(o_orderkey / 4, 3) AS rate FROM orders""",
    "time_range_clip": _clip(f"before BETWEEN {START} AND {END}"),
    "index_range_clip": _clip("seg_index BETWEEN 2 AND 4"),
    "clip_rows": f"SELECT stream_id, part_pos, seg_index, url, before FROM ({BEFORE}) WHERE before BETWEEN {START} AND {END}",
    "ad_cleanup": f"SELECT stream_id, part_pos, count(*) AS n, sum(duration) AS duration FROM {SEG} WHERE NOT regexp_matches(url, '{AD}') GROUP BY ALL",
    "ad_counts": f"""SELECT stream_id, CAST(sum(n) AS BIGINT) AS n_before, CAST(sum(l) AS BIGINT) AS n_after, count(*) AS parts_before, CAST(sum(CASE WHEN l > 0 THEN 1 ELSE 0 END) AS BIGINT) AS parts_after
      FROM (SELECT stream_id, part_pos, count(*) AS n, count(CASE WHEN NOT regexp_matches(url, '{AD}') THEN 1 END) AS l FROM {SEG} GROUP BY ALL) GROUP BY stream_id""",
    "stream_totals": f"SELECT manifest_id, stream_pos, segment_count, total_duration, methods FROM {TOTALS}",
    "merge_flags": f"""SELECT stream_id, bool_or(method = 'Unknown') AS any_unknown, bool_and(method <> 'None') AS all_encrypted,
      CASE WHEN bool_or(method = 'Unknown') THEN 'binary' ELSE 'demux' END AS merge FROM {SEG} GROUP BY stream_id""",
    "over_limits": f"SELECT stream_id, count(*) AS segment_count FROM {SEG} GROUP BY stream_id HAVING count(*) > 6",
    "segment_batches": f"SELECT stream_id, seg_index, tie, price, (row_number() OVER (PARTITION BY stream_id ORDER BY seg_index, tie, price) - 1) // 3 AS batch FROM {SEG}",
    "range_split": """SELECT o_orderkey, file_size, i AS index, i * 10000001 AS start_range, CASE WHEN i = n - 1 THEN file_size - i * 10000001 + 1 ELSE 10000001 END AS expected_length,
      CASE WHEN i = n - 1 THEN file_size - i * 10000001 + 1 ELSE 10000001 END > 0 AS is_valid
      FROM (SELECT o_orderkey, file_size, n, unnest(range(n)) AS i FROM (SELECT *, (file_size + 9999999) // 10000000 AS n FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 97) AS BIGINT) AS file_size FROM orders)))""",
    "range_split_all": """WITH f AS (SELECT o_orderkey, CAST(floor(o_totalprice * 97) AS BIGINT) AS file_size FROM orders),
      r AS (SELECT *, (file_size + 9999999) // 10000000 - 1 AS last, unnest(range((file_size + 9999999) // 10000000)) AS index FROM f),
      e AS (SELECT o_orderkey, file_size, index, index * 10000001 AS start_range, CASE WHEN index = last THEN file_size - index * 10000001 + 1 ELSE 10000001 END AS expected_length FROM r)
      SELECT *, expected_length > 0 AS is_valid FROM e""",
    "stream_order": f"SELECT manifest_id, stream_pos, row_number() OVER (PARTITION BY manifest_id ORDER BY {BEST}) - 1 AS place FROM {STR}",
    "filter_keep": f"SELECT manifest_id, stream_pos FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY {BEST}) AS rn FROM {STR} WHERE {KEPT}) WHERE rn <= 2",
    "filter_drop": f"WITH t AS (SELECT *, {SHOWN} AS shown FROM {TOTALS}) SELECT manifest_id, stream_pos FROM t WHERE NOT EXISTS (SELECT 1 FROM t g WHERE g.language = 'fr' AND g.manifest_id = t.manifest_id AND g.shown = t.shown)",
    "filter_segments": f"""SELECT manifest_id, stream_pos FROM (SELECT *, min(segment_count) OVER (PARTITION BY manifest_id) AS least FROM {TOTALS})
      WHERE (least <= 0 OR segment_count > 2) AND total_duration < 150""",
    "drop_then_keep": f"""WITH t AS (SELECT *, {SHOWN} AS shown FROM {TOTALS}),
      v AS (SELECT * FROM t WHERE {VIDEO} AND NOT EXISTS (SELECT 1 FROM t g WHERE (g.media_type IS NULL OR g.media_type = 'Video') AND g.resolution LIKE '%1920%' AND g.manifest_id = t.manifest_id AND g.shown = t.shown)),
      k AS (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY {BEST}) AS rn FROM v),
      u AS (SELECT * FROM k WHERE rn <= 2 UNION ALL SELECT *, 1 AS rn FROM t WHERE media_type = 'Audio' QUALIFY row_number() OVER (PARTITION BY manifest_id ORDER BY {BEST}) = 1)
      SELECT manifest_id, stream_pos FROM u QUALIFY row_number() OVER (PARTITION BY manifest_id, {ALIKE}, segment_count, total_duration ORDER BY stream_pos) = 1""",
    "worst_streams": f"SELECT manifest_id, stream_pos FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY {BEST}) AS rn, count(*) OVER (PARTITION BY manifest_id) AS c FROM {STR}) WHERE rn > c - 2",
    "auto_select": f"""WITH k AS (SELECT *, count(*) OVER (PARTITION BY manifest_id) AS c, CASE WHEN {VIDEO} THEN 'Video' ELSE media_type END AS kind FROM {STR}),
      n AS (SELECT *, row_number() OVER (PARTITION BY manifest_id, kind, CASE WHEN kind = 'Audio' THEN coalesce(language, '') END ORDER BY {BEST}) AS rn FROM k)
      SELECT manifest_id, stream_pos FROM n WHERE c <= 1 OR kind = 'Subtitles' OR (kind IN ('Video', 'Audio') AND rn = 1)
      QUALIFY row_number() OVER (PARTITION BY manifest_id, {ALIKE} ORDER BY {BEST}) = 1""",
    "subtitles_only": f"SELECT manifest_id, stream_pos FROM {STR} WHERE media_type = 'Subtitles'",
    "interactive_defaults": f"""WITH t AS (SELECT * FROM {STR}), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY manifest_id ORDER BY stream_pos) = 1),
      c AS (SELECT manifest_id, stream_pos FROM f
        UNION SELECT t.manifest_id, min(t.stream_pos) FROM t JOIN f USING (manifest_id) WHERE t.media_type = 'Audio' AND t.group_id = f.audio_id GROUP BY 1
        UNION SELECT t.manifest_id, min(t.stream_pos) FROM t JOIN f USING (manifest_id) WHERE t.media_type = 'Subtitles' AND t.group_id = f.subtitle_id GROUP BY 1
        UNION SELECT manifest_id, coalesce(min(CASE WHEN media_type IS NULL THEN stream_pos END), min(CASE WHEN media_type = 'Audio' THEN stream_pos END), min(CASE WHEN media_type = 'Subtitles' THEN stream_pos END)) FROM t GROUP BY 1)
      SELECT manifest_id, stream_pos FROM t SEMI JOIN c USING (manifest_id, stream_pos) QUALIFY row_number() OVER (PARTITION BY manifest_id, {ALIKE} ORDER BY stream_pos) = 1""",
    "streams_by_id": f"SELECT manifest_id, stream_pos FROM {STR} WHERE url = 'http://cdn.example/s/5.m3u8' OR group_id = 'g1' OR audio_id = 'g1' OR subtitle_id = 'g1'",
    "unique_streams": _first(", " + ", ".join(c for c in select.IDENTITY if c != "bandwidth"), "stream_pos"),
    "first_by_url": _first(", url", "stream_pos"),
    "refreshed_urls": f"""WITH t AS (SELECT * FROM {STR}), n AS (SELECT manifest_id, {", ".join(select.REFRESH_IDENTITY)}, min(stream_pos) AS p FROM t WHERE stream_pos % 2 = 0 GROUP BY ALL)
      SELECT t.manifest_id, t.stream_pos, 'http://new.example/' || n.p AS new_url FROM t LEFT JOIN n ON n.manifest_id = t.manifest_id AND """
    + " AND ".join(f"t.{c} IS NOT DISTINCT FROM n.{c}" for c in select.REFRESH_IDENTITY),
    "default_audio": f"SELECT manifest_id, group_id FROM {STR} WHERE media_type = 'Audio' QUALIFY row_number() OVER (PARTITION BY manifest_id ORDER BY coalesce(bandwidth, 0) DESC, stream_pos DESC) = 1",
    "default_subtitles": f"SELECT manifest_id, group_id FROM {STR} WHERE media_type = 'Subtitles' QUALIFY row_number() OVER (PARTITION BY manifest_id ORDER BY stream_pos) = 1",
    "event_summary": f"""WITH e AS (SELECT *, max(CASE WHEN {AGG} THEN event_seq END) OVER (PARTITION BY session_id) AS since FROM {EVT})
      SELECT session_id, greatest(coalesce(max(CASE WHEN event_seq = since THEN downloaded_bytes END), 0), coalesce(max(CASE WHEN {STREAM} AND (since IS NULL OR event_seq > since) THEN downloaded_bytes END), 0)) AS downloaded_bytes,
        max(CASE WHEN event_seq = since THEN total_bytes END) AS total_bytes,
        greatest(coalesce(max(CASE WHEN event_seq = since THEN bytes_per_second END), 0), coalesce(max(CASE WHEN {STREAM} AND (since IS NULL OR event_seq > since) THEN bytes_per_second END), 0)) AS bytes_per_second,
        coalesce(max(CASE WHEN {STREAM} THEN completed_segments END), 0) AS completed_segments, max(CASE WHEN {STREAM} THEN total_segments END) AS total_segments,
        count(CASE WHEN kind = 'Warning' THEN 1 END) AS n_warnings FROM e GROUP BY session_id""",
    "event_warnings": f"SELECT session_id, event_seq, message FROM {EVT} WHERE kind = 'Warning'",
    "job_counters": f"""WITH e AS (SELECT * FROM {EVT} WHERE {AGG} OR {STREAM}), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_seq DESC) = 1),
      s AS (SELECT * FROM e WHERE {STREAM} QUALIFY row_number() OVER (PARTITION BY session_id, stream_id ORDER BY event_seq DESC) = 1),
      g AS (SELECT session_id, sum(downloaded_bytes) AS b, CASE WHEN count(total_bytes) = count(*) THEN sum(total_bytes) END AS t, sum(bytes_per_second) AS v FROM s GROUP BY session_id)
      SELECT session_id, CAST(CASE WHEN {AGG} THEN downloaded_bytes ELSE b END AS BIGINT) AS completed_length, CAST(CASE WHEN {AGG} THEN total_bytes ELSE t END AS BIGINT) AS total_length,
        CAST(CASE WHEN {AGG} THEN bytes_per_second ELSE v END AS BIGINT) AS download_speed FROM l LEFT JOIN g USING (session_id)""",
    "stream_states": f"WITH e AS (SELECT * FROM {EVT}), {STATES} SELECT session_id, stream_id, length, total, speed, segments, n_finished, completed FROM states",
    "segment_bitfield": f"""WITH e AS (SELECT * FROM {EVT}), {STATES},
      p AS (SELECT *, greatest(coalesce(segments, completed), completed, n_finished) AS pieces FROM states),
      o AS (SELECT *, CAST(coalesce(sum(pieces) OVER (PARTITION BY session_id ORDER BY stream_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM p),
      bits AS (SELECT DISTINCT session_id, off + segment_index AS bit FROM e JOIN o USING (session_id, stream_id) WHERE kind = 'SegmentFinished' AND segment_index < pieces
        UNION SELECT session_id, off + unnest(range(completed)) FROM o WHERE n_finished = 0),
      held AS (SELECT session_id, bit // 8 AS byte, CAST(sum(1 << CAST(7 - bit % 8 AS INT)) AS BIGINT) AS v FROM bits GROUP BY ALL),
      t AS (SELECT session_id, CAST(sum(pieces) AS BIGINT) AS n_pieces FROM o GROUP BY session_id),
      b AS (SELECT session_id, n_pieces, unnest(range((n_pieces + 7) // 8)) AS byte FROM t)
      SELECT t.session_id, t.n_pieces, coalesce(x, '') AS bitfield FROM t LEFT JOIN (SELECT b.session_id, string_agg(printf('%02x', coalesce(v, 0)), '' ORDER BY b.byte) AS x FROM b LEFT JOIN held h ON h.session_id = b.session_id AND h.byte = b.byte GROUP BY b.session_id) y USING (session_id)""",
    "stalled_ticks": f"""WITH p AS (SELECT session_id, stream_id, date_trunc('day', ts) AS tick, max(downloaded_bytes) AS m FROM {EVT} WHERE {STREAM} GROUP BY ALL),
      r AS (SELECT session_id, tick, greatest(m - coalesce(max(m) OVER (PARTITION BY session_id, stream_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rise FROM p),
      n AS (SELECT session_id, tick, sum(rise) AS b FROM r GROUP BY ALL),
      t AS (SELECT session_id, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS tick FROM {EVT} GROUP BY session_id),
      i AS (SELECT t.session_id, t.tick, coalesce(b, 0) AS b, sum(CASE WHEN coalesce(b, 0) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY t.session_id ORDER BY t.tick) AS island FROM t LEFT JOIN n ON n.session_id = t.session_id AND n.tick = t.tick),
      z AS (SELECT session_id, tick, row_number() OVER (PARTITION BY session_id, island ORDER BY tick) AS run FROM i WHERE b = 0)
      SELECT session_id, tick, run, run >= 2 AS stop FROM z""",
    "queue_order": f"SELECT gid, row_number() OVER (ORDER BY {QUEUE_ORDER}) - 1 AS place FROM {JOB} WHERE status = 'waiting'",
    "queue_page": f"SELECT gid FROM {JOB} ORDER BY {QUEUE_ORDER} LIMIT 20 OFFSET 5",
    "queue_page_backwards": f"SELECT gid FROM (SELECT gid, row_number() OVER (ORDER BY {QUEUE_ORDER}) AS rn, count(*) OVER () AS c FROM {JOB}) WHERE rn <= c - 2 AND rn > c - 22",
    "queue_start": f"SELECT gid FROM (SELECT gid, row_number() OVER (ORDER BY {QUEUE_ORDER}) AS rn FROM {JOB} WHERE status = 'waiting') WHERE rn <= greatest(0, 320 - (SELECT count(*) FROM {JOB} WHERE status = 'active'))",
    "queue_move": f"""WITH q AS (SELECT gid, row_number() OVER (ORDER BY {QUEUE_ORDER}) - 1 AS p, count(*) OVER () - 1 AS n FROM {JOB} WHERE status IN ('waiting', 'paused')),
      c AS (SELECT p AS cur, greatest(0, n - 4) AS target FROM q WHERE gid = (SELECT min(gid) FROM q)),
      w AS (SELECT gid, CASE WHEN p > cur THEN p - 1 ELSE p END AS p, target FROM q, c)
      SELECT gid, CASE WHEN gid = (SELECT min(gid) FROM q) THEN target WHEN p >= target THEN p + 1 ELSE p END AS place FROM w""",
    "queue_to_front": f"SELECT gid, CASE WHEN gid = 'cfcd208495d565ef' THEN 0 WHEN status IN ('waiting', 'paused') THEN queue_position + 1 ELSE queue_position END AS queue_position FROM {JOB}",
    "queue_retained": f"""WITH j AS (SELECT *, count(*) OVER () - 100 AS surplus FROM {JOB}), s AS (SELECT gid FROM (SELECT gid, surplus, row_number() OVER (ORDER BY updated_at_ms, gid) AS rn FROM j WHERE status IN ('complete', 'error', 'removed')) WHERE rn <= surplus)
      SELECT gid FROM j ANTI JOIN s USING (gid)""",
    "global_stat": f"""SELECT count(CASE WHEN status = 'active' THEN 1 END) AS num_active, count(CASE WHEN status IN ('waiting', 'paused') THEN 1 END) AS num_waiting, count(CASE WHEN status IN ('complete', 'error') THEN 1 END) AS num_stopped,
      CAST(coalesce(sum(CASE WHEN status = 'active' THEN download_speed END), 0) AS BIGINT) AS download_speed, CAST(coalesce(sum(CASE WHEN status = 'active' THEN completed_length END), 0) AS BIGINT) AS completed_length FROM {JOB}""",
    "job_lookup": f"SELECT substr(gid, 1, 3) AS prefix, min(gid) AS gid FROM {JOB} GROUP BY 1 HAVING count(*) = 1",
    "job_status": f"SELECT gid, status, CAST(completed_length AS VARCHAR) AS completed_length FROM {JOB}",
    "merged_cues": f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cue_pos) AS n FROM {CUE}),
      f AS (SELECT doc_id, n, cue_pos, start_ms, end_ms, payload, settings FROM c WHERE n = 1
        UNION ALL SELECT c.doc_id, c.n, CASE WHEN m THEN f.cue_pos ELSE c.cue_pos END, CASE WHEN m THEN f.start_ms ELSE c.start_ms END, c.end_ms, c.payload, CASE WHEN m THEN f.settings ELSE c.settings END
        FROM (SELECT f.*, c2.start_ms - f.end_ms <= 1 AND c2.payload = f.payload AS m FROM f JOIN c c2 ON c2.doc_id = f.doc_id AND c2.n = f.n + 1) f JOIN c ON c.doc_id = f.doc_id AND c.n = f.n + 1)
      SELECT doc_id, cue_pos, start_ms, end_ms, payload, settings FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, cue_pos ORDER BY n DESC) = 1""",
    "grouped_cues": f"SELECT doc_id, min(cue_pos) AS cue_pos, cue_pos // 3 * 1000 AS start_ms, cue_pos // 3 * 1000 + cue_pos % 2 + 1 AS end_ms, string_agg(payload, e'\\r\\n' ORDER BY cue_pos) AS payload FROM {CUE} GROUP BY doc_id, cue_pos // 3, cue_pos % 2",
    "shifted_cues": f"""WITH s AS (SELECT doc_id, cue_pos, greatest(start_ms - 1500, 0) AS b, greatest(end_ms - 1500, 0) AS f FROM {CUE}),
      m AS (SELECT *, min(CASE WHEN b >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY cue_pos) AS ok FROM s)
      SELECT doc_id, cue_pos, CASE WHEN ok = 1 THEN b - 500 ELSE b END AS start_ms, CASE WHEN ok = 1 THEN f - 500 ELSE f END AS end_ms FROM m""",
    "cues_as_srt": _cue_text("srt"),
    "cues_as_vtt": _cue_text("vtt"),
    "live_new_segments": """WITH RECURSIVE d AS (SELECT user_id AS sid, event_id AS id, CAST(floor((epoch(ts) - 1704067200) / 86400) AS BIGINT) // 5 AS k FROM events),
      w AS (SELECT sid, id, k AS r FROM d UNION ALL SELECT sid, id, k + 1 FROM d),
      g AS (SELECT sid, r, max(id) AS top, row_number() OVER (PARTITION BY sid ORDER BY r) AS n FROM w GROUP BY sid, r),
      st AS (SELECT sid, r, n, CAST(-1 AS BIGINT) AS prev, top AS last FROM g WHERE n = 1
        UNION ALL SELECT g.sid, g.r, g.n, st.last, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.sid = g.sid AND w.r = g.r AND w.id = st.last) THEN g.top ELSE st.last END FROM st JOIN g ON g.sid = st.sid AND g.n = st.n + 1),
      x AS (SELECT st.sid, st.r, st.n, w.id FROM st JOIN w ON w.sid = st.sid AND w.r = st.r AND w.id > st.prev AND w.id <= st.last AND st.last > st.prev),
      p AS (SELECT sid, r, n, sum(id % 10) AS s, count(*) AS c FROM x GROUP BY ALL),
      q AS (SELECT sid, r, CAST(sum(s) OVER (PARTITION BY sid ORDER BY n) AS BIGINT) AS refreshed_seconds, CAST(sum(c) OVER (PARTITION BY sid ORDER BY n) AS BIGINT) AS refreshed_segments FROM p)
      SELECT x.sid AS stream_id, x.r AS refresh, x.id AS seg_index, refreshed_seconds, refreshed_segments FROM x JOIN q USING (sid, r)""",
    "live_wait": f"SELECT CAST(greatest(floor(coalesce(min(d), 6) / 2) - 2, 1) AS BIGINT) AS wait FROM (SELECT sum(duration) AS d FROM {SEG} WHERE part_pos = 0 GROUP BY stream_id)",
    "live_alignment": f"""WITH s AS (SELECT *, stream_id % 500 AS manifest_id FROM {SEG}), l AS (SELECT manifest_id, stream_id, min(seg_index) AS least FROM s GROUP BY ALL), b AS (SELECT manifest_id, max(least) AS start FROM l GROUP BY ALL),
      c AS (SELECT s.*, row_number() OVER (PARTITION BY stream_id ORDER BY seg_index, tie, price) AS n, count(*) OVER (PARTITION BY stream_id) AS total FROM s JOIN b USING (manifest_id) WHERE seg_index >= start),
      m AS (SELECT manifest_id, min(total) AS fewest, max(total) AS most FROM c GROUP BY ALL)
      SELECT manifest_id, stream_id, count(*) AS n, min(seg_index) AS first_index FROM c JOIN m USING (manifest_id) WHERE c.n > CASE WHEN most <= 3 THEN 0 ELSE greatest(fewest - 2, 0) END GROUP BY ALL""",
    "url_names": r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS plain, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM pages),
      s AS (SELECT *, substr(plain, length(origin) + 1) AS path FROM p), n AS (SELECT *, regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) AS last,
        list_filter(string_split(regexp_replace(path, '[^/]*$', ''), '/'), lambda x: x <> '') AS dirs FROM s)
      SELECT page_id, regexp_replace(last, '^(.+)\.[^.]*$', '\1') || '_' AS save_name, regexp_replace(regexp_replace(url, '["<>|:*?\\/]', '_', 'g'), '^\.+|\.+$', '', 'g') AS file_name,
        origin || '/' || array_to_string(list_concat(list_slice(dirs, 1, len(dirs) - 1), ['seg', 'a.ts']), '/') AS up, origin || '/root.ts' AS root,
        lower(replace(replace(replace(url, '-', ''), '_', ''), ' ', '')) AS token, 'a+b ' || page_id AS decoded FROM n""",
    "time_functions": """SELECT event_id, CAST(epoch_ms(date_trunc('millisecond', ts)) - 3600000 AS BIGINT) AS millis, CAST((event_id % 50) * 3600 + (event_id % 60) * 60 + 7 AS DOUBLE) AS iso,
      (event_id % 24) * 3600 + (event_id % 60) * 60 + 5 AS colon, (event_id % 60) * 60000 + 1500 AS cue, printf('%02d:%02d:%02d', event_id // 3600, (event_id // 60) % 60, event_id % 60) AS clock,
      '~' || CASE WHEN event_id >= 3600 THEN printf('%02dh', event_id // 3600) ELSE '' END || printf('%02dm%02ds', (event_id // 60) % 60, event_id % 60) AS short,
      printf('%02d:%02d:%02d,%03d', event_id * 37 // 3600000, (event_id * 37 // 60000) % 60, (event_id * 37 // 1000) % 60, event_id * 37 % 1000) AS srt FROM events""",
    "redaction": "SELECT doc_id, CASE WHEN lang IS NOT NULL THEN 'u?token=<redacted>&q=' || lang || ' --key <redacted>,sig=<redacted>&x' END AS redacted, false AS leaks FROM documents",
    "stream_labels": f"""SELECT manifest_id, stream_pos, concat_ws(' | ', resolution, (bandwidth // 1000) || ' Kbps', codecs, nullif(language, ''), role) AS label,
      replace(replace(replace(rtrim('show:_' || coalesce(resolution, '') || '_' || coalesce(language, '') || '..' || stream_pos, '_'), '__', '_'), '..', '.'), ':', '_') AS name,
      CASE WHEN bandwidth < 1024 THEN bandwidth || 'B' WHEN bandwidth < 1048576 THEN printf('%.2fKiB', bandwidth / 1024.0) ELSE printf('%.2fMiB', bandwidth / 1048576.0) END AS size FROM {STR}""",
    "range_headers": f"SELECT stream_id, seg_index, tie, price, printf('bytes=%d-%d', tie, tie + seg_index - 1) AS header, CASE WHEN seg_index < 3 THEN '0000000000000000' ELSE '' END || lpad(CASE WHEN seg_index < 3 THEN printf('%016x', seg_index - 3) ELSE printf('%x', seg_index - 3) END, CASE WHEN seg_index < 3 THEN 16 ELSE 32 END, '0') AS iv FROM {SEG}",
}

# more queries, each with its SQL, by what they are about
for more in (grammar, media, protection, raw, reports, subtitles, ttml):
    QUERIES |= more.QUERIES
    SQL |= more.SQL
