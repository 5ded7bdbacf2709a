"""HLS playlists as rows: lines in order, and windows over a playlist's lines.

Input is a table (manifest_id, url, text). A playlist is one window partition;
its size is bounded by what a server sends as one document. Everything is
DataFrame functions; lines of a playlist are never in a Python process. What is
wrong in a playlist is told beside its facts, and never fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions import blobs, moments, text as names
from reelframe.functions.once import let

#: The media types of renditions.
RENDITIONS = {"AUDIO": "Audio", "VIDEO": "Video", "SUBTITLES": "Subtitles"}
LIVE_TARGET = 5.0


def lines(playlists: DataFrame) -> DataFrame:
    """(manifest_id, base, beside, pos, line) without empty lines; a byte order mark and white space around a text go.

    Carriage returns end lines where there are no line feeds. A key that follows
    a duration, with nothing between them, comes before it. A null or empty text has no lines.
    """
    body = F.regexp_replace(F.regexp_replace("text", "^[\\s﻿]+", ""), "\\s+$", "")
    body = F.when(body.contains("\n"), body).otherwise(F.replace(body, F.lit("\r"), F.lit("\n")))
    body = F.regexp_replace(body, r"(?m)^(#EXTINF[^\n]*)\n((?:[^\S\n]*\n)*)(#EXT-X-KEY[^\n]*)", "$3\n$2$1")
    # what plain names stand beside is worked out once a playlist, before its lines are rows
    x = playlists.select("manifest_id", F.col("url").alias("base"), names.beside(F.col("url")).alias("beside"), body.alias("body"))
    return x.select("manifest_id", "base", "beside", F.posexplode(F.split("body", "\r?\n")).alias("pos", "line")).where("line <> ''")


def after(line: Column, tag: str) -> Column:
    """What follows a tag; null on other lines."""
    return F.when(line.startswith(tag), F.substring(line, len(tag) + 1, 1 << 20))


def non_empty(value: Column) -> Column:
    return F.when(value != "", value)


def _windows() -> tuple:
    order = Window.partitionBy("manifest_id").orderBy("pos")
    return order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)


def seen_lines(playlists: DataFrame, multi_map: bool = False) -> DataFrame:
    """lines() of media playlists up to a second map (unless multi_map), without those in a provider's ads but byte ranges and types.

    With maps, the count of maps so far, and ends: whether the line says that the
    playlist is over (true) or not (false), null for lines that say neither.
    """
    upto, _ = _windows()
    line = F.col("line")
    marks = F.when(line.startswith("#UPLYNK-SEGMENT"), F.when(line.contains(",ad"), True).when(line.contains(",segment"), False))
    x = lines(playlists).withColumn("inside", F.coalesce(F.last(marks, ignorenulls=True).over(upto), F.lit(False)))
    x = x.where(~F.col("inside") | line.startswith("#EXT-X-BYTERANGE:") | line.startswith("#EXT-X-PLAYLIST-TYPE:"))
    is_map = line.startswith("#EXT-X-MAP:")
    x = x.withColumn("maps", F.sum(is_map.cast("int")).over(upto))
    second = is_map & (F.col("maps") > 1)
    over = F.when(line.startswith("#EXT-X-PLAYLIST-TYPE:"), F.trim(line).endswith("VOD")).when(line.startswith("#EXT-X-ENDLIST"), True)
    if not multi_map:
        x, over = x.where((F.col("maps") < 2) | (second & (F.col("maps") == 2))), over.when(second, True)
        # nothing after the second map counts
        x = x.withColumn("stop", F.min(F.when(second, F.col("pos"))).over(Window.partitionBy("manifest_id"))).where("stop is null or pos <= stop").drop("stop")
    return x.withColumns({"second": second, "ends": over}).drop("inside")


def is_ad(url: Column) -> Column:
    return (url.contains("ccode=") & url.contains("/ad/") & url.contains("duration=")) | (url.contains("ccode=0902") & url.contains("duration="))


def ad_at(base: Column, line: Column) -> Column:
    """is_ad() of a line's URL, which is made only where its parts have what all ads have."""
    told = line.contains("duration=") | base.contains("duration=")
    return F.when(told, let(names.combine_url(base, line), is_ad)).otherwise(F.when(base.isNotNull(), False))


def media_segments(playlists: DataFrame, multi_map: bool = False) -> DataFrame:
    """The segments of media playlists, with part, index, key and byte range.

    A segment is a line that is no tag and comes after a duration or a byte
    range. Its index counts durations from the media sequence on. A part ends at
    a discontinuity with segments before it, at the end of the list and at a map
    after the first, where without multi_map the playlist ends. What no such line
    follows belongs to playlists that are not over: a playlist of type VOD that
    does not say that it has ended loses its last part, and what comes after the
    end is lost. A key holds until the next one; an IV that is not given is the
    index. A range without a start begins where the range before it in the part
    ended, and has a null start if there is none. A provider's ad is no segment and
    has no index; at the discontinuity after it the part before it goes on, and
    what came between them is lost.
    """
    upto, earlier = _windows()
    line, whole = F.col("line"), Window.partitionBy("manifest_id")
    count = lambda c, w: F.coalesce(F.sum(c.cast("int")).over(w), F.lit(0))
    x = seen_lines(playlists, multi_map).withColumns({
        "is_url": ~line.startswith("#"), "extinf": line.startswith("#EXTINF:"), "cut": line.startswith("#EXT-X-DISCONTINUITY"),
        "ready": line.startswith("#EXTINF:") | line.startswith("#EXT-X-BYTERANGE:"),
        "sequence": F.last(after(line, "#EXT-X-MEDIA-SEQUENCE:"), ignorenulls=True).over(upto),
        "since": count(line.startswith("#EXT-X-MEDIA-SEQUENCE:"), upto), "key": F.last(after(line, "#EXT-X-KEY:"), ignorenulls=True).over(upto),
        "over": F.coalesce(F.last("ends", ignorenulls=True).over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(False)),
    })
    x = x.withColumn("before", count(F.col("is_url"), earlier))
    x = x.withColumn("segment", F.col("is_url") & F.max("ready").over(Window.partitionBy("manifest_id", "before")))
    x = x.withColumn("ad", F.col("segment") & ad_at(F.col("base"), line))
    x = x.withColumns({"ads": count(F.col("ad"), upto), "real": count(F.col("segment") & ~F.col("ad"), upto)})
    # ads and segments up to the discontinuity before this line
    at_cut = lambda c: F.coalesce(F.last(F.when(F.col("cut"), F.col(c)), ignorenulls=True).over(earlier), F.lit(0))
    x = x.withColumns({"ads_then": at_cut("ads"), "real_then": at_cut("real")}).withColumn("joins", F.col("cut") & (F.col("ads") > F.col("ads_then")) & (F.col("real_then") > 0))
    flush = (F.col("cut") & ~F.col("joins")) | line.startswith("#EXT-X-ENDLIST") | F.col("second")
    ahead = whole.orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    # a joining discontinuity takes back the cut before it
    x = x.withColumns({"cuts": count(flush, upto) - count(F.col("joins"), upto), "last_flush": F.max(F.when(flush, F.col("pos"))).over(whole), "lost": F.coalesce(F.first(F.when(F.col("cut"), F.col("joins")), ignorenulls=True).over(ahead), F.lit(False))})
    by_sequence = Window.partitionBy("manifest_id", "since").orderBy("pos")
    numbered = F.sum(F.col("extinf").cast("long")).over(by_sequence.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(F.sum(F.col("ad").cast("long")).over(by_sequence.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumns({"nth": count(F.col("segment"), earlier), "index": F.coalesce(F.trim("sequence").try_cast("long"), F.lit(0)) + numbered - 1})
    at = lambda c, when: F.max_by(c, F.when(when, F.col("pos")))
    extinf, ranged, dated, own = F.col("extinf"), line.startswith("#EXT-X-BYTERANGE:"), line.startswith("#EXT-X-PROGRAM-DATE-TIME:"), F.col("segment")
    kept = ~F.col("ad") & ~F.col("lost") & (~F.col("over") | F.coalesce(F.col("pos") < F.col("last_flush"), F.lit(False)))
    found = x.groupBy("manifest_id", "base", "beside", "nth").agg(
        F.max(F.when(own, line)).alias("ref"), F.max(F.when(own, F.col("cuts"))).alias("cuts"), F.max(F.when(own, kept)).alias("kept"),
        F.coalesce(moments.manifest_number(at(F.regexp_extract(line, "^#EXTINF:([^,]*)", 1), extinf)), F.lit(0.0)).alias("duration"),
        F.coalesce(at(F.col("index"), extinf), F.lit(0)).alias("seg_index"), at(F.col("key"), extinf).alias("key"),
        at(after(line, "#EXT-X-BYTERANGE:"), ranged).alias("range"), at(F.col("pos"), ranged).alias("range_pos"), F.trim(at(after(line, "#EXT-X-PROGRAM-DATE-TIME:"), dated)).alias("date_time"),
    ).where("ref is not null and kept")
    found = found.withColumn("part", F.dense_rank().over(whole.orderBy("cuts")) - 1)
    # two @ tell nothing but that the range is empty
    pieces = F.size(F.split("range", "@"))
    found = found.withColumns({"range_length": F.when(pieces > 2, 0).otherwise(F.trim(F.regexp_extract("range", "^([^@]*)", 1)).try_cast("long")), "given": F.when(pieces == 2, F.trim(F.regexp_extract("range", "@(.*)$", 1)).try_cast("long"))})
    in_part = Window.partitionBy("manifest_id", "part").orderBy("nth")
    found = found.withColumn("chain", F.sum(F.col("given").isNotNull().cast("int")).over(in_part.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("manifest_id", "part", "chain").orderBy("nth")
    start = F.first("given", ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + F.coalesce(F.sum("range_length").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    method = F.when(F.col("key").isNull(), "None").otherwise(names.encryption_method(names.hls_attribute(F.col("key"), "METHOD")))
    found = found.withColumns({"range_start": F.when(F.col("range_length").isNotNull(), start), "method": method})
    coded = F.col("method") != "None"
    iv = F.coalesce(blobs.strict_hex(names.hls_attribute(F.col("key"), "IV")), blobs.implicit_iv(F.col("seg_index")))
    uri = non_empty(names.hls_attribute(F.col("key"), "URI"))
    return found.select("manifest_id", "part", "seg_index", names.seen_beside(F.col("base"), F.col("beside"), F.col("ref")).alias("url"), "duration", "range_start", "range_length", "method",
                        F.when(coded, names.seen_beside(F.col("base"), F.col("beside"), uri)).alias("key_uri"), F.when(coded, iv).alias("iv"), "date_time")


def line_error(line: Column) -> Column:
    """What is wrong with one line of a media playlist by itself; null if nothing is."""
    value = lambda tag: F.trim(after(line, tag))
    bad = lambda tag, ok: after(line, tag).isNotNull() & ok(value(tag)).isNull()
    whole = lambda v: F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("long"))
    size = value("#EXT-X-BYTERANGE:")
    sized = F.when(F.size(F.split(size, "@")) > 2, 0).otherwise(whole(F.trim(F.regexp_extract(size, "^([^@]*)", 1))))
    placed = F.when(F.size(F.split(size, "@")) == 2, whole(F.trim(F.regexp_extract(size, "@(.*)$", 1)))).otherwise(0)
    return (
        F.when(size.isNotNull() & sized.isNull(), "byte range length").when(size.isNotNull() & placed.isNull(), "byte range start")
        .when(bad("#EXT-X-TARGETDURATION:", moments.manifest_number), "target duration").when(bad("#EXT-X-MEDIA-SEQUENCE:", whole), "media sequence")
        .when(bad("#EXT-X-PROGRAM-DATE-TIME:", moments.unix_millis), "program date time").when(line.startswith("#EXTINF:") & moments.manifest_number(F.regexp_extract(line, "^#EXTINF:([^,]*)", 1)).isNull(), "duration")
        .when(line.startswith("#EXT-X-MAP:") & names.hls_attribute(line, "URI").isNull(), "map without URI")
    )


def playlist_facts(playlists: DataFrame, multi_map: bool = False) -> DataFrame:
    """(manifest_id, target_duration, is_live, refresh_ms, map_url, map_start, map_length, error) of media playlists.

    Whether a playlist is over is told by the last line that tells it: the end of
    the list, a type (over if VOD), a second map. A live one is read again after
    twice its target duration, five seconds if it has none. A map's range without
    a start begins at 0. error: the first line that cannot be read, or a range
    without a start where none was before it in its part.
    """
    line, at = F.col("line"), lambda value, first=False: (F.min_by if first else F.max_by)(value, F.when(value.isNotNull(), F.col("pos")))
    x = seen_lines(playlists, multi_map)
    map_line = F.when(line.startswith("#EXT-X-MAP:") & (F.col("maps") == 1), line)
    # ranges by part: a start, or a range before it since the last discontinuity after a segment
    ranged = line.startswith("#EXT-X-BYTERANGE:")
    order = Window.partitionBy("manifest_id").orderBy("pos")
    cuts = F.sum((line.startswith("#EXT-X-DISCONTINUITY") | F.col("second")).cast("int")).over(order)
    x = x.withColumn("cuts", cuts)
    started = F.max((ranged & line.contains("@")).cast("int")).over(Window.partitionBy("manifest_id", "cuts").orderBy("pos"))
    wrong = F.coalesce(line_error(line), F.when(ranged & (started == 0), "byte range without a start"))
    x = x.withColumn("wrong", wrong)
    found = x.groupBy("manifest_id", "base").agg(moments.manifest_number(at(after(line, "#EXT-X-TARGETDURATION:"))).alias("target_duration"), at(F.col("ends")).alias("over"), at(map_line, True).alias("map"), at(F.col("wrong"), True).alias("error"))
    live = ~F.coalesce("over", F.lit(False))
    refresh = moments.refresh_interval(F.coalesce("target_duration", F.lit(LIVE_TARGET)) * 2000).cast("long")
    span = names.hls_attribute(F.col("map"), "BYTERANGE")
    length, start = F.trim(F.regexp_extract(span, "^([^@]*)", 1)).try_cast("long"), F.when(span.contains("@"), F.trim(F.regexp_extract(span, "@(.*)$", 1)).try_cast("long")).otherwise(0)
    return found.select("manifest_id", "target_duration", live.alias("is_live"), F.when(live, refresh).alias("refresh_ms"), names.combine_url(F.col("base"), names.hls_attribute(F.col("map"), "URI")).alias("map_url"),
                        F.when(length.isNotNull(), start).alias("map_start"), length.alias("map_length"), "error")


def master_streams(playlists: DataFrame) -> DataFrame:
    """The streams of master playlists: variants and renditions with a URI, the first of each URL.

    A rendition of another type, or of none, has a null media type; see master_errors().
    """
    _, earlier = _windows()
    line = F.col("line")
    get = lambda tag, key: names.hls_attribute(F.col(tag), key)
    x = lines(playlists).withColumn("is_url", ~line.startswith("#"))
    x = x.withColumn("before", F.coalesce(F.sum(F.col("is_url").cast("int")).over(earlier), F.lit(0)))
    inf = after(line, "#EXT-X-STREAM-INF:")
    # the last variant tag since the line before that was no tag
    x = x.withColumns({"variant": F.max_by(inf, F.when(inf.isNotNull(), F.col("pos"))).over(Window.partitionBy("manifest_id", "before")), "media": after(line, "#EXT-X-MEDIA:")})
    audio, codecs = non_empty(get("variant", "AUDIO")), get("variant", "CODECS")
    bandwidth = F.coalesce(F.trim(F.coalesce(non_empty(get("variant", "AVERAGE-BANDWIDTH")), get("variant", "BANDWIDTH"))).try_cast("int").cast("long"), F.lit(0).cast("long"))
    none = F.lit(None).cast("string")
    variants = x.where("is_url and variant is not null").select(
        "manifest_id", "pos", none.alias("media_type"), none.alias("group_id"), none.alias("language"), none.alias("name"), none.alias("channels"), bandwidth.alias("bandwidth"),
        F.when(audio.isNotNull(), F.substring_index(codecs, ",", 1)).otherwise(codecs).alias("codecs"), get("variant", "RESOLUTION").alias("resolution"),
        non_empty(get("variant", "FRAME-RATE")).try_cast("double").alias("frame_rate"), audio.alias("audio_id"), non_empty(get("variant", "SUBTITLES")).alias("subtitle_id"),
        non_empty(get("variant", "VIDEO-RANGE")).alias("video_range"), non_empty(get("variant", "VIDEO")).alias("video_id"), none.alias("characteristics"), names.combine_url(F.col("base"), line).alias("url"),
    )
    kind = F.replace(get("media", "TYPE"), F.lit("-"), F.lit("_"))
    media_type = none
    for k, v in RENDITIONS.items():
        media_type = F.when(kind == k, v).otherwise(media_type)
    renditions = x.where(F.col("media").isNotNull() & F.coalesce(kind != "CLOSED_CAPTIONS", F.lit(True)) & non_empty(get("media", "URI")).isNotNull()).select(
        "manifest_id", "pos", media_type.alias("media_type"), get("media", "GROUP-ID").alias("group_id"), non_empty(get("media", "LANGUAGE")).alias("language"),
        non_empty(get("media", "NAME")).alias("name"), non_empty(get("media", "CHANNELS")).alias("channels"), F.lit(None).cast("long").alias("bandwidth"), none.alias("codecs"),
        none.alias("resolution"), F.lit(None).cast("double").alias("frame_rate"), none.alias("audio_id"), none.alias("subtitle_id"), none.alias("video_range"),
        none.alias("video_id"), F.regexp_extract(non_empty(get("media", "CHARACTERISTICS")), r"([^,.]*)$", 1).alias("characteristics"), names.combine_url(F.col("base"), get("media", "URI")).alias("url"),
    )
    first = Window.partitionBy("manifest_id", "url").orderBy("pos")
    return variants.unionByName(renditions).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def master_errors(playlists: DataFrame) -> DataFrame:
    """(manifest_id, error) of master playlists with a line that cannot be read: the first one's error."""
    line = F.col("line")
    media, inf = after(line, "#EXT-X-MEDIA:"), after(line, "#EXT-X-STREAM-INF:")
    told = F.coalesce(non_empty(names.hls_attribute(inf, "AVERAGE-BANDWIDTH")), names.hls_attribute(inf, "BANDWIDTH"))
    rate = non_empty(names.hls_attribute(inf, "FRAME-RATE"))
    wrong = (
        F.when(media.isNotNull() & names.hls_attribute(media, "TYPE").isNull(), "rendition without TYPE")
        .when(told.isNotNull() & F.trim(told).try_cast("int").isNull(), "bandwidth").when(rate.isNotNull() & moments.manifest_number(rate).isNull(), "frame rate")
    )
    return lines(playlists).withColumn("error", wrong).where("error is not null").groupBy("manifest_id").agg(F.min_by("error", "pos").alias("error"))
