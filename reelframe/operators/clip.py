"""Cutting and counting the segments of streams.

Segments are rows (stream_id, part_pos, seg_index, duration, url, ...); a
stream's segments have an order (ORDER) that is theirs. The time before a
segment is a running sum over smaller indexes: one window where the list is
scanned once, instead of one scan for each segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = "stream_id"
ORDER = ("seg_index", "tie", "price")


def time_before() -> Column:
    """The durations of all segments of the stream with a smaller index; equal indexes do not count each other."""
    by = Window.partitionBy(BY).orderBy("seg_index").rangeBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("duration").over(by), F.lit(0.0))


def clip(segments: DataFrame, start: float, end: float, unit: str = "time") -> DataFrame:
    """Segments from start to end, both included: by index (unit "index") or by the time before them, with `before`."""
    x = segments.withColumn("before", time_before())
    return x.where(F.col("seg_index" if unit == "index" else "before").between(start, end))


def clip_summary(segments: DataFrame, start: float, end: float, unit: str = "time") -> DataFrame:
    """(stream_id, n_kept, kept_duration, skipped_duration) of every stream that has segments.

    Of each part that keeps a segment, what has a smaller index than the first
    one kept was skipped.
    """
    by = F.col("seg_index") if unit == "index" else F.col("before")
    x = segments.withColumn("before", time_before()).withColumn("kept", by.between(start, end))
    # the part is nested in the stream, so the second window needs no exchange of its own
    part = Window.partitionBy(BY, "part_pos")
    x = x.withColumn("first_kept", F.min_by(F.col("seg_index"), F.when(F.col("kept"), F.struct(*ORDER))).over(part))
    return x.groupBy(BY).agg(
        F.sum(F.col("kept").cast("long")).alias("n_kept"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("duration"))), F.lit(0.0)).alias("kept_duration"),
        F.coalesce(F.sum(F.when(F.col("seg_index") < F.col("first_kept"), F.col("duration"))), F.lit(0.0)).alias("skipped_duration"),
    )


def without_ads(segments: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Segments whose URL matches no pattern; a part that has none left is gone with them."""
    out = segments
    for p in patterns:
        out = out.where(~F.coalesce(F.col("url").rlike(p), F.lit(False)))
    return out


def ad_counts(segments: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(stream_id, n_before, n_after, parts_before, parts_after)."""
    clean = F.lit(True)
    for p in patterns:
        clean = clean & ~F.coalesce(F.col("url").rlike(p), F.lit(False))
    part = segments.groupBy(BY, "part_pos").agg(F.count("*").alias("n"), F.sum(clean.cast("long")).alias("left"))
    return part.groupBy(BY).agg(
        F.sum("n").alias("n_before"), F.sum("left").alias("n_after"), F.count("*").alias("parts_before"), F.sum((F.col("left") > 0).cast("long")).alias("parts_after")
    )


def totals(streams: DataFrame, segments: DataFrame) -> DataFrame:
    """streams with segment_count, total_duration (null without a playlist) and the sorted encryption methods in use.

    Segments are aggregated before the join, so a row per stream is what moves.
    """
    own = segments.groupBy(F.col(BY).alias("stream_pos")).agg(
        F.count("*").alias("segment_count"), F.sum("duration").alias("total_duration"), F.array_sort(F.collect_set(F.when(F.col("method") != "None", F.col("method")))).alias("methods")
    )
    return streams.join(own, "stream_pos", "left").withColumns({"segment_count": F.coalesce("segment_count", F.lit(0)), "methods": F.coalesce("methods", F.array().cast("array<string>"))})


def merge_flags(segments: DataFrame) -> DataFrame:
    """(stream_id, any_unknown, all_encrypted, merge): an unknown method calls for a binary merge."""
    x = segments.groupBy(BY).agg(F.bool_or(F.col("method") == "Unknown").alias("any_unknown"), F.bool_and(F.col("method") != "None").alias("all_encrypted"))
    return x.withColumn("merge", F.when(F.col("any_unknown"), "binary").otherwise("demux"))


def over_limits(segments: DataFrame, most: int) -> DataFrame:
    """Streams with more segments than allowed."""
    return segments.groupBy(BY).agg(F.count("*").alias("segment_count")).where(F.col("segment_count") > most)


def batches(segments: DataFrame, size: int) -> DataFrame:
    """segments with `batch`: so many segments of a stream at a time, numbered from 0."""
    n = F.row_number().over(Window.partitionBy(BY).orderBy(*ORDER))
    return segments.withColumn("batch", F.floor((n - 1) / size))


def split_ranges(files: DataFrame, size: str = "file_size", length: int = 10_485_760) -> DataFrame:
    """files with (index, start_range, expected_length, is_valid) for each range of a large file.

    A range is one byte longer than `length` and the next starts after it, so the last one of some sizes is empty or
    negative: is_valid says so.
    """
    n = F.expr(f"({size} + {length} - 1) div {length}")
    x = files.where(F.col(size) > 0).withColumn("_n", n).withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    start = F.col("index") * (length + 1)
    last = F.col("index") == F.col("_n") - 1
    x = x.withColumn("start_range", start).withColumn("expected_length", F.when(last, F.col(size) - start + 1).otherwise(F.lit(length + 1)))
    return x.withColumn("is_valid", F.col("expected_length") > 0).drop("_n")
