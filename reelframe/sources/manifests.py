"""DASH and Smooth Streaming documents as rows: streams, and segments from expanded timelines.

Input is a table (manifest_id, url, text), an id once. from_xml parses a whole
document in the JVM into the few attributes named in a schema; elements become
rows by posexplode, and a timeline's running times are windows over its entries.
No text is in a Python process. A document that is no XML gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.functions import moments, text as names
from reelframe.functions.once import let

XML = {"attributePrefix": "_", "ignoreNamespace": "true", "mode": "PERMISSIVE"}
_INIT = "Initialization: struct<_sourceURL: string, _range: string>"
_TEMPLATE = """struct<_media: string, _initialization: string, _timescale: double, _startNumber: bigint, _duration: bigint, _presentationTimeOffset: bigint,
  SegmentTimeline: struct<S: array<struct<_t: bigint, _d: bigint, _r: bigint>>>>"""
_SET = "_contentType: string, _mimeType: string, _codecs: string, _lang: string, _frameRate: string, _videoRange: string, Role: array<struct<_value: string>>, AudioChannelConfiguration: array<struct<_value: string>>"
_REPRESENTATION = f"""struct<_id: string, _volumeAdjust: string, _bandwidth: string, _width: string, _height: string, {_SET}, BaseURL: array<string>, SegmentTemplate: {_TEMPLATE},
  SegmentBase: struct<{_INIT}>, SegmentList: struct<_timescale: double, _duration: bigint, {_INIT}, SegmentURL: array<struct<_media: string, _mediaRange: string>>>>"""
MPD = f"""_type string, _mediaPresentationDuration string, _timeShiftBufferDepth string, _availabilityStartTime string, BaseURL array<string>,
  Period array<struct<_id: string, _duration: string, BaseURL: array<string>,
    AdaptationSet: array<struct<{_SET}, Label: array<string>, BaseURL: array<string>, SegmentTemplate: {_TEMPLATE}, Representation: array<{_REPRESENTATION}>>>>>"""
SMOOTH = """_TimeScale bigint, _Duration bigint, _IsLive string, StreamIndex array<struct<_Type: string, _Name: string, _Language: string, _Url: string,
  QualityLevel: array<struct<_Index: string, _FourCC: string, _Bitrate: bigint, _MaxWidth: bigint, _MaxHeight: bigint, _Channels: string, _CodecPrivateData: string, _Url: string>>,
  c: array<struct<_t: bigint, _d: bigint, _r: bigint>>>>"""

#: Roles, the seconds of a live window where none is given, kinds of Smooth Streaming samples, ticks a second.
ROLES = ("Subtitle", "Main", "Alternate", "Supplementary", "Commentary", "Dub", "Description", "Sign", "Metadata", "ForcedSubtitle")
WINDOW_SECONDS = 60.0
FOUR_CC = ("HVC1", "HEV1", "AACL", "AACH", "EC-3", "H264", "AVC1", "DAVC", "TTML", "DVHE", "DVH1")
SMOOTH_TICKS = 10_000_000
#: What stands for a number with a width while a URL is made (no XML has it).
MARK = "\u0001"

REPRESENTATION = ["manifest_id", "period_pos", "set_pos", "rep_pos"]
_RUN = "struct<kind: string, ref: string, range: string, t: bigint, d: bigint, n: bigint, seconds: double>"


def parsed(documents: DataFrame, schema: str) -> DataFrame:
    """(manifest_id, url, the document's attributes): white space and a byte order mark before it go.

    A row of one struct through inline(): fields of a projected struct would each parse the document again.
    """
    body = F.regexp_replace("text", "^[\\s﻿]+", "")
    return documents.select("manifest_id", "url", F.inline(F.array(F.from_xml(body, T.StructType.fromDDL(schema), XML))))


def based(url: Column, *given: str) -> Column:
    """A document's base URL with each element's own on top of it, outermost first; one fold, however deep."""
    own = F.filter(F.array(*(F.get(F.col(c), 0) for c in given)), lambda o: o.isNotNull())
    return F.aggregate(own, url, names.combine_url)


def _run(kind: str, ref=None, span=None, t=None, d=None, n=None, seconds=None) -> Column:
    lit = lambda v, to: (F.lit(v) if v is None or isinstance(v, (int, float, str)) else v).cast(to)
    return F.struct(F.lit(kind).alias("kind"), lit(ref, "string").alias("ref"), lit(span, "string").alias("range"), lit(t, "bigint").alias("t"), lit(d, "bigint").alias("d"), lit(n, "bigint").alias("n"), lit(seconds, "double").alias("seconds"))


def _times(seconds: Column, scale: Column, d: Column) -> Column:
    """How many times a duration in ticks goes into so many seconds, rounded up; null where it is none."""
    return F.when(d != 0, F.ceil(seconds * scale / d).cast("bigint"))


def representations(documents: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per representation of DASH documents, with its runs of segments still folded.

    A run is a listed segment, an entry of a timeline (n segments of d ticks, from
    tick t on if that is given), or n segments that a template numbers. Attributes
    that a representation's template lacks are those of its adaptation set's.
    """
    now = F.unix_timestamp() if now is None else now
    x = parsed(documents, MPD)
    seconds = lambda c: moments.iso_duration(F.col(c))
    depth = F.coalesce(F.when(F.col("_timeShiftBufferDepth") != "", seconds("_timeShiftBufferDepth")), F.lit(WINDOW_SECONDS))
    x = x.select("manifest_id", "url", F.coalesce(F.col("_type") == "dynamic", F.lit(False)).alias("is_live"), depth.alias("depth"), F.unix_timestamp(F.to_timestamp("_availabilityStartTime")).alias("since"),
                 seconds("_mediaPresentationDuration").alias("whole"), F.col("BaseURL").alias("mpd_base"), F.posexplode("Period").alias("period_pos", "p"))
    x = x.select("manifest_id", "url", "is_live", "depth", "since", "period_pos", F.col("p._id").alias("period_id"), F.coalesce(moments.iso_duration(F.col("p._duration")), F.col("whole")).alias("seconds"),
                 "mpd_base", F.col("p.BaseURL").alias("period_base"), F.posexplode("p.AdaptationSet").alias("set_pos", "a"))
    first = F.get(F.col("a.Representation"), 0)
    x = x.withColumn("content", F.coalesce("a._contentType", "a._mimeType", first["_contentType"], first["_mimeType"], F.lit("")))
    x = x.select("*", F.posexplode("a.Representation").alias("rep_pos", "r"))
    x = x.withColumn("base", based(F.col("url"), "mpd_base", "period_base", "a.BaseURL", "r.BaseURL"))
    either = lambda name: F.coalesce(F.col(f"r.SegmentTemplate.{name}"), F.col(f"a.SegmentTemplate.{name}"))
    x = x.withColumns({"media": either("_media"), "scale": F.coalesce(either("_timescale"), F.lit(1.0)), "first": F.coalesce(either("_startNumber"), F.lit(1)), "ticks": either("_duration"),
                       "offset": F.coalesce(either("_presentationTimeOffset"), F.lit(0)), "line": F.when(F.col("r.SegmentTemplate").isNotNull(), F.col("r.SegmentTemplate.SegmentTimeline")).otherwise(F.col("a.SegmentTemplate.SegmentTimeline"))})
    none = F.array().cast(f"array<{_RUN}>")
    listed = F.col("r.SegmentList")
    whole = F.when(F.col("r.SegmentBase.Initialization").isNotNull() & F.col("r.SegmentBase.Initialization._sourceURL").isNull(), F.array(_run("base", n=1, seconds=F.coalesce("seconds", F.lit(0.0))))).otherwise(none)
    each = F.coalesce(listed["_duration"], F.lit(0)) / F.coalesce(listed["_timescale"], F.lit(1.0))
    urls = F.coalesce(F.transform(listed["SegmentURL"], lambda s: _run("list", s["_media"], s["_mediaRange"], n=1, seconds=each)), none)
    repeats = lambda s: F.when(F.coalesce(s["_r"], F.lit(0)) < 0, F.coalesce(_times(F.col("seconds"), F.col("scale"), s["_d"]) - 1, F.lit(0))).otherwise(F.coalesce(s["_r"], F.lit(0)))
    timeline = F.transform("line.S", lambda s: _run("timeline", t=s["_t"], d=F.coalesce(s["_d"], F.lit(0)), n=F.greatest(repeats(s), F.lit(0)) + 1, seconds=F.coalesce(s["_d"], F.lit(0)) / F.col("scale")))
    total = F.coalesce(_times(F.col("seconds"), F.col("scale"), F.col("ticks")), F.lit(0))
    moving = F.col("is_live") & (total == 0)
    elapsed = now - F.col("since") - F.expr("offset div 1000") / 1000.0
    behind = F.when(moving, ((elapsed - F.col("depth")) * F.col("scale") / F.col("ticks")).cast("bigint")).otherwise(0)
    count = F.when(moving, (F.col("depth") * F.col("scale") / F.col("ticks")).cast("bigint")).otherwise(total)
    numbered = F.when(F.col("ticks") > 0, F.array(_run("number", t=behind, n=count, seconds=F.col("ticks") / F.col("scale")))).otherwise(none)
    # an entry without a media template has no segments of its own
    templated = F.when(F.col("media").isNull(), none).when(F.col("line").isNotNull(), F.coalesce(timeline, none)).otherwise(numbered)
    one = F.array(_run("base", n=1, seconds=F.coalesce("seconds", F.lit(0.0))))
    x = x.withColumn("runs", let(F.filter(F.concat(whole, urls, templated), lambda run: run["n"] > 0), lambda runs: F.when(F.size(runs) > 0, runs).otherwise(one)))
    given = {"RepresentationID": F.coalesce("r._id", F.lit("")), "Bandwidth": F.coalesce("r._bandwidth", F.lit(""))}
    odd = lambda c: c.contains("$RepresentationID%0") | c.contains("$Bandwidth%0") | given["RepresentationID"].contains("$")
    plain = lambda c: F.replace(F.replace(c, F.lit("$RepresentationID$"), given["RepresentationID"]), F.lit("$Bandwidth$"), given["Bandwidth"])
    fill = lambda c: F.when(odd(c), names.template(c, given)).otherwise(plain(c))
    begun, source = listed["Initialization"], F.col("r.SegmentBase.Initialization")
    begins = F.coalesce(fill(either("_initialization")), F.when(begun.isNotNull(), F.coalesce(begun["_sourceURL"], F.lit(""))), source["_sourceURL"])
    span = F.when(either("_initialization").isNull(), F.when(begun.isNotNull(), begun["_range"]).when(source["_sourceURL"].isNotNull(), source["_range"]))
    x = x.withColumns({"media": fill(F.col("media")), "begins": begins, "init_range": span})
    # the runs hold what these list, and each row would carry its whole set again
    return x.select(*REPRESENTATION, "period_id", "is_live", "depth", "content", "base", "media", "first", "runs", "begins", "init_range", F.col("a").dropFields("Representation", "SegmentTemplate").alias("a"), F.col("r").dropFields("SegmentTemplate", "SegmentBase", "SegmentList").alias("r"))


def role(text: Column) -> Column:
    """The role that a word stands for, upper and lower case alike, hyphens left out; null for others."""
    known = F.create_map(*(F.lit(x) for r in ROLES for x in (r.lower(), r)))
    # all are of letters that lower() gives to no others, and it costs many times as much
    return F.try_element_at(known, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ-", "abcdefghijklmnopqrstuvwxyz"))


def _group_id() -> Column:
    return F.concat("r._id", F.coalesce(F.concat(F.lit("-"), "r._volumeAdjust"), F.lit("")))


def _resolution() -> Column:
    return F.concat("r._width", F.lit("x"), "r._height")


def _typed(representations: DataFrame) -> DataFrame:
    """representations with said (the role), mime, kind (the media type) and plain (what the type of its files says)."""
    r, a = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"a.{c}"))
    either = lambda c: F.coalesce(r(c), a(c))
    here, above = F.get(r("Role"), 0)["_value"], F.get(a("Role"), 0)["_value"]
    # what is named many times below is a column of its own: branches would each work it out again
    representations = representations.withColumn("word", F.when(role(here).isNotNull(), here).otherwise(above)).withColumn("said", role(F.col("word")))
    word, said = F.col("word"), F.col("said")
    representations = representations.withColumns({"forces": F.coalesce(F.when(word.contains("-"), said == "ForcedSubtitle").otherwise(said == "Subtitle"), F.lit(False)), "mime": either("_mimeType")})
    forces, mime = F.col("forces"), F.col("mime")
    top = F.substring_index("content", "/", 1)
    media_type = F.when(forces | either("_codecs").isin("stpp", "wvtt") | (top == "text"), "Subtitles").when(top == "audio", "Audio")
    plain = F.when(forces & mime.contains("ttml"), "ttml").otherwise(F.get(F.split(mime, "/"), 1))
    return representations.withColumns({"kind": media_type, "plain": plain})


def dash_streams(representations: DataFrame) -> DataFrame:
    """The streams of DASH representations, by position; see merged() for documents of several periods."""
    r, a = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"a.{c}"))
    either = lambda c: F.coalesce(r(c), a(c))
    representations = _typed(representations)
    media_type, plain, said = F.col("kind"), F.col("plain"), F.col("said")
    n = F.aggregate("runs", F.lit(0).cast("bigint"), lambda s, run: s + run["n"])
    extension = F.when(media_type == "Subtitles", F.when(plain == "mp4", "m4s").otherwise(plain)).when(plain.isNull() | (n > 1), "m4s").otherwise(plain)
    lang = either("_lang")
    return representations.select(
        *REPRESENTATION, "period_id", _group_id().alias("group_id"), media_type.alias("media_type"),
        F.coalesce(r("_bandwidth").try_cast("int").cast("bigint"), F.lit(0).cast("bigint")).alias("bandwidth"), either("_codecs").alias("codecs"),
        F.when(lang.isNotNull(), F.when(lang.rlike(r"^[\p{L}\p{N}_-]+$"), lang).otherwise("und")).alias("language"), F.get(a("Label"), 0).alias("name"),
        F.coalesce(moments.frame_rate(a("_frameRate")), moments.frame_rate(r("_frameRate"))).alias("frame_rate"), _resolution().alias("resolution"),
        F.coalesce(F.get(a("AudioChannelConfiguration"), 0)["_value"], F.get(r("AudioChannelConfiguration"), 0)["_value"]).alias("channels"), extension.alias("extension"), said.alias("role"),
        either("_videoRange").alias("video_range"), "is_live", F.when(F.col("is_live"), F.col("depth") * 500).alias("refresh_ms"), names.combine_url(F.col("base"), F.col("begins")).alias("init_url"), "init_range", n.alias("segment_count"),
    )


def _patterned(representations: DataFrame) -> DataFrame:
    """representations with what their segments' URLs have in common, so that only numbers and ticks are put in segment by segment.

    pattern: the media template as seen from the base, its padded numbers as MARK; null where filling it first could
    give another URL, as numbers in a scheme or a base that looks like a template. beside: what stands before a plain name.
    """
    media, base = F.col("media"), F.col("base")
    whole = media.rlike(names.ABSOLUTE) | ~media.contains("://")
    plain = ~base.contains("$") & ~base.contains(MARK) & ~media.contains(MARK)
    told = F.regexp_extract(media, r"\$Number%0(\d+)d\$", 1)
    x = representations.withColumns({"pattern": F.when(whole & plain, names.combine_url(base, media)), "beside": names.beside(base), "width": F.when(told != "", F.coalesce(told.try_cast("int"), F.lit(0))),
                                     "counted": media.contains("$Number"), "timed": media.contains("$Time")})
    marked = F.when(F.col("width").isNotNull(), F.regexp_replace("pattern", r"\$Number%0\d+d\$", MARK)).otherwise(F.col("pattern"))
    return x.withColumns({"pattern": marked, "media": F.when(F.col("pattern").isNull(), media)})


#: What _patterned() tells of a representation.
PATTERN = ["base", "media", "first", "is_live", "pattern", "beside", "width", "counted", "timed"]


def _placed(runs: DataFrame) -> DataFrame:
    """Rows of runs with the number of segments before each, of those that no template names, of whole files, and its first tick.

    An entry's first tick is what it says, or else the end of the entry before it:
    the latest given tick, and all that ran since.
    """
    order = Window.partitionBy(*REPRESENTATION).orderBy("pos")
    earlier, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = lambda c, when=None: F.coalesce(F.sum(c if when is None else F.when(when, c)).over(earlier), F.lit(0))
    by_template = F.col("kind").isin("timeline", "number")
    runs = runs.withColumns({"place": ahead(F.col("n")), "past": ahead(F.col("n"), ~by_template), "ran": ahead(F.col("n") * F.col("d"), F.col("kind") == "timeline"), "wholes": ahead(F.col("n"), F.col("kind") == "base")})
    return runs.withColumn("begun", F.coalesce(F.last(F.when(F.col("kind") == "timeline", F.col("t") - F.col("ran")), ignorenulls=True).over(upto), F.lit(0)) + F.col("ran"))


def _named(x: DataFrame) -> DataFrame:
    """Rows of a run, its place and the i-th of its segments, with seg_pos, seg_index, url and name."""
    kind, nth = F.col("kind"), F.col("place") + F.col("i")
    index = F.when(kind == "base", nth).when(kind == "list", nth - F.col("wholes")).otherwise(nth - F.col("past"))
    x = x.withColumns({"seg_pos": nth, "index": index, "tick": F.when(kind == "timeline", F.col("begun") + F.col("i") * F.col("d")), "number": F.col("first") + index + F.when(kind == "number", F.col("t")).otherwise(0)})
    said, tick, ref = F.col("number").cast("string"), F.col("tick").cast("string"), F.col("ref")
    timed = (kind == "timeline") & F.col("timed")
    number = F.when(F.col("width").isNotNull(), F.replace("pattern", F.lit(MARK), names.zero_padded(said, F.col("width")))).otherwise(F.col("pattern"))
    numbered = F.when(F.col("counted"), F.replace(number, F.lit("$Number$"), said)).otherwise(F.col("pattern"))
    filled = F.when(timed, F.replace(numbered, F.lit("$Time$"), tick)).otherwise(numbered)
    listed = names.seen_beside(F.col("base"), F.col("beside"), ref)
    # a column of its own: combine_url() names it many times
    x = x.withColumn("odd", F.when(F.col("pattern").isNull() & kind.isin("timeline", "number"), names.template(F.col("media"), {"Number": F.col("number")})))
    odd = names.combine_url(F.col("base"), F.when(kind == "timeline", F.replace("odd", F.lit("$Time$"), tick)).otherwise(F.col("odd")))
    # a list's entry without a name, and a segment without a number, are the base
    url = F.when(kind == "base", F.col("base")).when(kind == "list", F.coalesce(listed, F.col("base"))).otherwise(F.coalesce(F.when(F.col("pattern").isNotNull(), filled).otherwise(odd), F.col("base")))
    return x.withColumns({"url": url, "seg_index": F.when((kind == "number") & F.col("is_live"), F.col("number")).otherwise(F.col("index")), "name": F.when(timed, tick).when((kind == "number") & F.col("counted"), said)})


def _segments(patterned: DataFrame, *more: str) -> DataFrame:
    """The segments of representations with their patterns, and the columns named in more."""
    # there always is a run; an inner posexplode would work out all runs once more, to ask whether there is one
    runs = patterned.select(*REPRESENTATION, *more, *PATTERN, F.posexplode_outer("runs").alias("pos", "run")).select("*", "run.*").drop("run")
    x = _named(_placed(runs).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i")))
    start, stop = F.substring_index("range", "-", 1).try_cast("bigint"), F.substring_index("range", "-", -1).try_cast("bigint")
    return x.select(*REPRESENTATION, *more, "seg_pos", "seg_index", "url", F.col("seconds").alias("duration"), "name", start.alias("range_start"), (stop - start + 1).alias("range_length"))


def dash_segments(representations: DataFrame) -> DataFrame:
    """The segments of DASH representations, with index, name, URL, duration and byte range.

    One exchange at most, by representation; a URL is seen from its base once a
    representation, and only its numbers are put in once a segment.
    """
    return _segments(_patterned(representations))


def _homes(x: DataFrame) -> DataFrame:
    """x (a row per representation, with its stream's facts and where its segments end) with home, part, start, more and joins, without absorbed ones; see merged()."""
    alike = ["manifest_id", "group_id", "resolution", "media_type"]
    order = Window.partitionBy(*alike).orderBy("period_pos", "set_pos", "rep_pos")
    head = F.first(F.struct("period_id", *REPRESENTATION[1:])).over(order)
    x = x.withColumn("head", head).withColumn("joins", ~F.col("is_live") & ~F.col("period_id").eqNullSafe(F.col("head.period_id")))
    own = F.struct(*REPRESENTATION[1:])
    x = x.withColumn("home", F.when(F.col("joins"), F.struct(*(F.col(f"head.{c}").alias(c) for c in REPRESENTATION[1:]))).otherwise(own))
    chain = Window.partitionBy("manifest_id", "home").orderBy("period_pos", "set_pos", "rep_pos")
    x = x.withColumn("absorbed", F.coalesce(F.col("joins") & (F.lag("last_url").over(chain) == F.col("last_url")), F.lit(False)))
    kept = (~F.col("absorbed")).cast("int")
    x = x.withColumn("part", F.sum(kept).over(chain) - 1).withColumn("start", F.coalesce(F.sum(kept * (F.col("last_index") + 1)).over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return x.withColumn("more", F.sum(F.when(F.col("absorbed"), F.col("total")).otherwise(0.0)).over(Window.partitionBy("manifest_id", "home", "part"))).where("not absorbed")


def _joined(segments: DataFrame) -> DataFrame:
    """Segments with their representation's home, part, start, more, last_pos and joins, as segments of streams."""
    last = F.col("seg_pos") == F.col("last_pos")
    return segments.select("manifest_id", "home.*", "part", "seg_pos", (F.col("seg_index") + F.when(F.col("joins"), F.col("start")).otherwise(0)).alias("seg_index"), "url", (F.col("duration") + F.when(last, F.col("more")).otherwise(0.0)).alias("duration"),
                           "name", "range_start", "range_length")


def merged(streams: DataFrame, segments: DataFrame) -> DataFrame:
    """The segments (with `part`) of documents that do not change, a stream's periods joined.

    Streams of one group, resolution and type are one from period to period, under
    the position of the first. Each further period is a part, its indexes going on;
    one that ends at the same URL as what is before it only makes the last segment
    longer by all of its duration. Documents that change keep their streams apart.
    Both joins are by sorting: there are as many rows as representations, which a
    guess from the size of the folded documents would send to every executor.
    """
    ends = segments.groupBy(*REPRESENTATION).agg(F.max_by("url", "seg_pos").alias("last_url"), F.max("seg_pos").alias("last_pos"), F.max_by("seg_index", "seg_pos").alias("last_index"), F.sum("duration").alias("total"))
    x = _homes(streams.select(*REPRESENTATION, "period_id", "is_live", "group_id", "resolution", "media_type").join(ends.hint("merge"), REPRESENTATION))
    return _joined(segments.join(x.select(*REPRESENTATION, "home", "part", "start", "more", "last_pos", "joins").hint("merge"), REPRESENTATION))


def _ended(patterned: DataFrame) -> DataFrame:
    """Representations with their last segment's URL, position and index, and the total of all, told by their runs alone."""
    count = lambda *kinds: F.aggregate(F.slice("runs", 1, F.size("runs") - 1), F.lit(0).cast("bigint"), lambda s, r: s + (F.when(r["kind"].isin(*kinds), r["n"]).otherwise(0) if kinds else r["n"]))
    end = F.aggregate("runs", F.lit(0).cast("bigint"), lambda s, r: F.when(r["kind"] == "timeline", F.coalesce(r["t"], s) + r["n"] * r["d"]).otherwise(s))
    total = F.aggregate("runs", F.lit(0.0), lambda s, r: s + F.coalesce(r["n"] * r["seconds"], F.lit(0.0)))
    x = patterned.withColumns({"place": count(), "wholes": count("base"), "past": count("base", "list"), "end": end, "total": total, "run": F.element_at("runs", -1)})
    x = _named(x.select("*", "run.*").withColumns({"i": F.col("n") - 1, "begun": F.col("end") - F.col("n") * F.col("d")}))
    return x.select(*patterned.columns, "total", F.col("url").alias("last_url"), F.col("seg_pos").alias("last_pos"), F.col("seg_index").alias("last_index"))


def merged_at_once(representations: DataFrame) -> DataFrame:
    """merged() of representations whose runs are still folded.

    Where a representation ends is told by its runs, so periods are joined before
    segments are rows: nothing is joined to the segments, and what the documents
    are dealt by is the only exchange.
    """
    x = _typed(representations).select(*REPRESENTATION, "period_id", "is_live", _group_id().alias("group_id"), _resolution().alias("resolution"), F.col("kind").alias("media_type"), "base", "media", "first", "runs")
    return _joined(_segments(_homes(_ended(_patterned(x))), "home", "part", "start", "more", "last_pos", "joins"))


def smooth_codec(four_cc: Column, private: Column) -> Column:
    """The codec string of a kind of samples and its private data in hex; null without data, but for timed text."""
    avc = F.regexp_extract(private, "^(?:(?!00000001).)*00000001(.*)$", 1)
    first = F.regexp_extract(private, "^([0-9A-Fa-f]{2})", 1)
    audio = F.when(first != "", F.shiftright(F.conv(first, 16, 10).cast("int"), 3)).otherwise(2)
    return (
        F.when(four_cc == "TTML", "stpp")
        .when(F.coalesce(private, F.lit("")) == "", None)
        .when(four_cc.isin("H264", "X264", "DAVC", "AVC1"), F.when(avc.startswith("67") & (F.length(avc) >= 8), F.concat(F.lit("avc1."), F.substring(avc, 3, 6))).otherwise("avc1.4D401E"))
        .when(four_cc.isin("AAC", "AACL", "AACH", "AACP"), F.concat(F.lit("mp4a.40."), F.when(four_cc == "AACH", F.lit("5")).otherwise(audio.cast("string"))))
        .otherwise(F.lower(four_cc))
    )


def smooth_levels(documents: DataFrame) -> DataFrame:
    """One row per quality level of Smooth Streaming documents, its chunks still folded; unknown kinds of samples are left out."""
    x = parsed(documents, SMOOTH)
    x = x.select("manifest_id", "url", F.coalesce("_TimeScale", F.lit(SMOOTH_TICKS)).alias("scale"), F.coalesce("_Duration", F.lit(0)).alias("whole"), F.coalesce(F.lower("_IsLive") == "true", F.lit(False)).alias("is_live"), F.posexplode("StreamIndex").alias("index_pos", "s"))
    x = x.select("*", F.posexplode("s.QualityLevel").alias("level_pos", "q")).withColumn("four_cc", F.upper("q._FourCC")).where(F.col("four_cc").isin(*FOUR_CC))
    pattern = F.coalesce("q._Url", "s._Url")
    return x.withColumn("pattern", F.replace(F.replace(pattern, F.lit("{bitrate}"), F.lit("{Bitrate}")), F.lit("{start time}"), F.lit("{start_time}")))


LEVEL = ["manifest_id", "index_pos", "level_pos"]


def smooth_streams(levels: DataFrame) -> DataFrame:
    """The streams of quality levels."""
    width = F.coalesce("q._MaxWidth", F.lit(0))
    return levels.select(
        *LEVEL, F.when(F.col("s._Type") == "audio", "Audio").when(F.col("s._Type") == "text", "Subtitles").alias("media_type"), F.coalesce("s._Name", "q._Index").alias("group_id"),
        F.when(F.length("s._Language") == 3, F.col("s._Language")).alias("language"), F.coalesce("q._Bitrate", F.lit(0)).alias("bandwidth"), smooth_codec(F.col("four_cc"), F.col("q._CodecPrivateData")).alias("codecs"),
        F.when(width != 0, F.concat(width.cast("string"), F.lit("x"), F.coalesce("q._MaxHeight", F.lit(0)).cast("string"))).alias("resolution"), F.col("q._Channels").alias("channels"), F.lit("m4s").alias("extension"), "is_live",
    )


def smooth_segments(levels: DataFrame) -> DataFrame:
    """The chunks of quality levels as segments; a repeat of r means r chunks in all, a negative one as many as the document lasts."""
    # a level's URL is made before its chunks are rows, and only its ticks are put in chunk by chunk
    base = F.replace(names.combine_url(F.col("url"), F.col("pattern")), F.lit("{Bitrate}"), F.coalesce("q._Bitrate", F.lit(0)).cast("string"))
    x = levels.select(*LEVEL, base.alias("base"), "scale", "whole", F.col("s.c").alias("chunks")).select(*LEVEL, "base", "scale", "whole", F.posexplode("chunks").alias("pos", "c"))
    d, r = F.coalesce("c._d", F.lit(0)), F.coalesce("c._r", F.lit(0))
    n = F.when(r < 0, F.greatest(F.coalesce(_times(F.col("whole").cast("double"), F.lit(1.0), d), F.lit(1)), F.lit(1))).otherwise(F.greatest(r, F.lit(1)))
    x = x.withColumns({"d": d, "n": n.cast("bigint")})
    order = Window.partitionBy(*LEVEL).orderBy("pos")
    earlier, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"place": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "ran": F.coalesce(F.sum(F.col("n") * F.col("d")).over(earlier), F.lit(0))})
    x = x.withColumn("shift", F.coalesce(F.last(F.col("c._t") - F.col("ran"), ignorenulls=True).over(upto), F.lit(0)))
    x = x.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    tick = (F.col("shift") + F.col("ran") + F.col("i") * F.col("d")).cast("string")
    url = F.replace("base", F.lit("{start_time}"), tick)
    return x.select(*LEVEL, (F.col("place") + F.col("i")).alias("seg_index"), url.alias("url"), (F.col("d") / F.col("scale")).alias("duration"), F.when(F.col("base").contains("{start_time}"), tick).alias("name"))
