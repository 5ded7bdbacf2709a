"""Choosing among the streams of manifests: order, filters, top-k, defaults, dedup.

Streams are rows (manifest_id, stream_pos, ...). "Best", "first" and "last" mean
places in a manifest's list, so every operator works within manifest_id and
breaks ties by stream_pos; all windows of a query share that one partitioning.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = "manifest_id"
#: Streams that agree in these look the same to a user (ids and URLs do not count).
IDENTITY = ("media_type", "group_id", "language", "name", "codecs", "bandwidth", "resolution", "frame_rate", "channels", "video_range", "characteristics", "role")
#: A refreshed stream is the old one if it agrees in these, nulls included.
REFRESH_IDENTITY = ("media_type", "group_id", "language", "name", "codecs", "resolution", "frame_rate", "channels", "video_range", "bandwidth")
#: What tells streams apart in a listing, by media type.
LISTED = {
    "Audio": ("group_id", "kbps", "name", "codecs", "language", "channels", "role"),
    "Subtitles": ("group_id", "language", "name", "codecs", "characteristics", "role"),
    "Video": ("resolution", "kbps", "group_id", "frame_rate", "codecs", "video_range", "role"),
}
_NOT_PORTABLE = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<")


def media_rank() -> Column:
    """No type, audio, video, subtitles, closed captions."""
    t = F.col("media_type")
    return F.when(t.isNull(), -1).when(t == "Audio", 0).when(t == "Video", 1).when(t == "Subtitles", 2).otherwise(3)


def channel_number() -> Column:
    """The integer before the first slash, else 0."""
    return F.coalesce(F.regexp_extract("channels", "^([0-9]+)(?:/|$)", 1).try_cast("int"), F.lit(0))


def stream_order() -> list[Column]:
    """Media type, bandwidth and channels from high to low, then place."""
    return [media_rank(), F.desc_nulls_last("bandwidth"), channel_number().desc(), F.col("stream_pos")]


def is_video() -> Column:
    return F.col("media_type").isNull() | (F.col("media_type") == "Video")


def ordered(streams: DataFrame) -> DataFrame:
    """streams with `place`, from 0 in each manifest."""
    return streams.withColumn("place", (F.row_number().over(Window.partitionBy(BY).orderBy(*stream_order())) - 1).cast("long"))


def regex(pattern: str) -> str:
    """The pattern, if it needs neither look-around nor back references."""
    if _NOT_PORTABLE.search(pattern):
        raise ValueError(f"look-around and back references are not supported: {pattern}")
    re.compile(pattern)
    return pattern


@dataclass(frozen=True)
class StreamFilter:
    """Conditions that a stream must all meet; `choice` then takes from the start or end of what is left."""

    group_id: str | None = None
    language: str | None = None
    name: str | None = None
    codecs: str | None = None
    resolution: str | None = None
    frame_rate: str | None = None
    channels: str | None = None
    video_range: str | None = None
    url: str | None = None
    segments_min: int | None = None
    segments_max: int | None = None
    duration_min: float | None = None
    duration_max: float | None = None
    bandwidth_min: int | None = None
    bandwidth_max: int | None = None
    role: str | None = None
    choice: str = "best"


def number_text(x: Column) -> Column:
    """A double as text, whole numbers without a fraction."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def matches(f: StreamFilter) -> Column:
    """The filter's row conditions; a null field never matches a pattern, a null duration or bandwidth no bound."""
    out = F.lit(True)
    for name in ("group_id", "language", "name", "codecs", "resolution", "frame_rate", "channels", "video_range", "url"):
        if (pattern := getattr(f, name)) is not None:
            value = number_text(F.col(name)) if name == "frame_rate" else F.col(name)
            out = out & F.coalesce(value.rlike(regex(pattern)), F.lit(False))
    bounds = (
        ("duration_min", lambda v: F.col("total_duration") > v),
        ("duration_max", lambda v: F.col("total_duration") < v),
        ("bandwidth_min", lambda v: F.col("bandwidth") >= v),
        ("bandwidth_max", lambda v: F.col("bandwidth") <= v),
        ("role", lambda v: F.col("role") == v),
    )
    for name, condition in bounds:
        if (v := getattr(f, name)) is not None:
            out = out & F.coalesce(condition(v), F.lit(False))
    return out


def choose(streams: DataFrame, choice: str, order: list[Column] | None = None) -> DataFrame:
    """all, best, worst, best<n> or worst<n> of each manifest; other words mean the first."""
    if choice == "all":
        return streams
    found = re.fullmatch(r"(best|worst)(\d*)", choice)
    n = int(found[2]) if found and found[2] else 1
    order = order or [F.col("stream_pos")]
    by = Window.partitionBy(BY).orderBy(*order)
    if found and found[1] == "worst":
        every = Window.partitionBy(BY)
        return streams.withColumn("_n", F.row_number().over(by)).withColumn("_all", F.count("*").over(every)).where(F.col("_n") > F.col("_all") - n).drop("_n", "_all")
    return streams.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")


def flagged(streams: DataFrame, f: StreamFilter, order: list[Column] | None = None) -> DataFrame:
    """streams with `_in`: whether the filter keeps a stream; windows in place of a second pass over the streams."""
    plain = StreamFilter(**{**f.__dict__, "duration_min": None, "duration_max": None, "bandwidth_min": None, "bandwidth_max": None, "role": None})
    out = streams.withColumn("_in", matches(plain))
    for bound, condition in ((f.segments_max, lambda v: F.col("segment_count") < v), (f.segments_min, lambda v: F.col("segment_count") > v)):
        if bound is not None:
            least = F.min(F.when(F.col("_in"), F.col("segment_count"))).over(Window.partitionBy(BY))
            out = out.withColumn("_least", least).withColumn("_in", F.col("_in") & F.coalesce((F.col("_least") <= 0) | condition(bound), F.lit(False))).drop("_least")
    rest = StreamFilter(duration_min=f.duration_min, duration_max=f.duration_max, bandwidth_min=f.bandwidth_min, bandwidth_max=f.bandwidth_max, role=f.role)
    out = out.withColumn("_in", F.col("_in") & matches(rest))
    if f.choice == "all":
        return out
    found = re.fullmatch(r"(best|worst)(\d*)", f.choice)
    n = int(found[2]) if found and found[2] else 1
    alike = Window.partitionBy(BY, "_in")
    nth = F.row_number().over(alike.orderBy(*(order or [F.col("stream_pos")])))
    chosen = nth > F.count("*").over(alike) - n if found and found[1] == "worst" else nth <= n
    return out.withColumn("_chosen", chosen).withColumn("_in", F.col("_in") & F.col("_chosen")).drop("_chosen")


def filter_keep(streams: DataFrame, f: StreamFilter | None, order: list[Column] | None = None) -> DataFrame:
    """Streams that meet the filter, then its choice; no filter keeps nothing.

    Bounds on segments are strict, and hold only where every stream that is
    left in the manifest has segments: first the upper, then the lower one.
    """
    if f is None:
        return streams.limit(0)
    return flagged(streams, f, order).where("_in").drop("_in")


def listed_as() -> Column:
    """What a listing shows of a stream, as one struct-like string per media type."""
    kbps = F.expr("bandwidth div 1000")
    t = F.col("media_type")
    kind = F.when(t == "Audio", "Audio").when(t == "Subtitles", "Subtitles").otherwise("Video")
    out = F.lit(None).cast("string")
    for k, names in LISTED.items():
        shown = [F.coalesce(F.concat(F.lit("+"), (kbps if n == "kbps" else F.col(n)).cast("string")), F.lit("-")) for n in names]
        out = F.when(kind == k, F.concat_ws("|", F.lit(k), *shown, F.col("segment_count").cast("string"), F.coalesce("total_duration", F.lit(0.0)).cast("string"))).otherwise(out)
    return out


def filter_drop(streams: DataFrame, f: StreamFilter | None, order: list[Column] | None = None) -> DataFrame:
    """Without the streams that the filter keeps, and without those that look like them; no filter drops nothing."""
    if f is None:
        return streams
    x = flagged(streams, f, order).withColumn("_listed", listed_as())
    return x.withColumn("_gone", F.max("_in").over(Window.partitionBy(BY, "_listed"))).where("not _gone").drop("_in", "_listed", "_gone")


def of_type(streams: DataFrame, kind: str) -> DataFrame:
    """Streams of a media type; those without one are video."""
    return streams.where(is_video() if kind == "Video" else F.col("media_type") == kind)


def unique(streams: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The first of the streams that look the same."""
    by = Window.partitionBy(BY, *IDENTITY, *(c for c in ("segment_count", "total_duration") if c in streams.columns)).orderBy(*(order or [F.col("stream_pos")]))
    return streams.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def apply_filters(streams: DataFrame, keep: dict[str, StreamFilter], drop: dict[str, StreamFilter] | None = None) -> DataFrame:
    """First the drop filter of each media type, then its keep filter.

    Once any type has a keep filter, types without one keep nothing.
    """
    parts = []
    for kind in ("Video", "Audio", "Subtitles"):
        own = filter_drop(of_type(streams, kind), (drop or {}).get(kind), stream_order())
        parts.append(filter_keep(own, keep.get(kind), stream_order()) if keep else own)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return unique(out)


def auto_select(streams: DataFrame) -> DataFrame:
    """The best video, the best audio of each language, all subtitles; one window over one partitioning."""
    kind = F.when(is_video(), "Video").otherwise(F.col("media_type"))
    by = Window.partitionBy(BY, "_kind", "_lang").orderBy(*stream_order())
    x = streams.withColumn("_kind", kind).withColumn("_lang", F.when(F.col("_kind") == "Audio", F.coalesce("language", F.lit(""))))
    x = x.withColumn("_n", F.row_number().over(by)).withColumn("_all", F.count("*").over(Window.partitionBy(BY)))
    kept = (F.col("_kind") == "Subtitles") | (F.col("_kind").isin("Video", "Audio") & (F.col("_n") == 1))
    return unique(x.where((F.col("_all") <= 1) | kept).drop("_kind", "_lang", "_n", "_all"), stream_order())


def interactive_defaults(streams: DataFrame) -> DataFrame:
    """A manifest's first stream, the audio and subtitles it names, and a fallback of the other kinds."""
    every = Window.partitionBy(BY)
    first = Window.partitionBy(BY).orderBy("stream_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = streams.withColumns({"_a": F.first("audio_id").over(first), "_s": F.first("subtitle_id").over(first), "_p": F.min("stream_pos").over(every)})
    t = F.col("media_type")
    least = lambda c: F.min(F.when(c, F.col("stream_pos"))).over(every)
    x = x.withColumns({
        "_audio": least((t == "Audio") & (F.col("group_id") == F.col("_a"))),
        "_subs": least((t == "Subtitles") & (F.col("group_id") == F.col("_s"))),
        "_rest": F.coalesce(least(t.isNull()), least(t == "Audio"), least(t == "Subtitles")),
    })
    chosen = F.lit(False)
    for c in ("_p", "_audio", "_subs", "_rest"):
        chosen = chosen | F.coalesce(F.col("stream_pos") == F.col(c), F.lit(False))
    return unique(x.where(chosen).drop("_a", "_s", "_p", "_audio", "_subs", "_rest"))


def with_ids(streams: DataFrame, ids: list[str]) -> DataFrame:
    """Streams that are named by URL, group, audio or subtitle id."""
    hit = F.lit(False)
    for c in ("url", "group_id", "audio_id", "subtitle_id"):
        hit = hit | F.coalesce(F.col(c).isin(ids), F.lit(False))
    return streams.where(hit)


def first_by_url(streams: DataFrame) -> DataFrame:
    """The first stream of each URL in a manifest."""
    by = Window.partitionBy(BY, "url").orderBy("stream_pos")
    return streams.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def refreshed(old: DataFrame, new: DataFrame, fallback: str | None = None) -> DataFrame:
    """old with `new_url`: the URL of the first stream of `new` with the same identity, else with the same `fallback` column.

    Both are null-safe equi-joins against one row per key, so nothing multiplies.
    """
    by = [BY, *REFRESH_IDENTITY]
    first = new.groupBy(*by).agg(F.min_by("url", "stream_pos").alias("new_url"))
    o, n = old.alias("o"), first.alias("n")
    on = F.col(f"o.{BY}") == F.col(f"n.{BY}")
    for c in REFRESH_IDENTITY:
        on = on & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    out = o.join(n, on, "left").select("o.*", "n.new_url")
    if fallback:
        other = new.groupBy(BY, fallback).agg(F.min_by("url", "stream_pos").alias("_url"))
        out = out.join(other, [BY, fallback], "left").withColumn("new_url", F.coalesce("new_url", "_url")).drop("_url")
    return out


def default_track(streams: DataFrame, kind: str, widest: bool) -> DataFrame:
    """(manifest_id, group_id) of the default track: of most bandwidth (the last of equals), or the first."""
    of = streams.where(F.col("media_type") == kind)
    key = F.struct(F.coalesce("bandwidth", F.lit(0)).alias("b"), "stream_pos")
    return of.groupBy(BY).agg((F.max_by("group_id", key) if widest else F.min_by("group_id", "stream_pos")).alias("group_id"))
