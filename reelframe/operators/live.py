"""What is new in a live window, refresh by refresh.

A refresh shows a sliding window of a stream's segments. New is what stands
after the last segment seen; where that is gone from the window, nothing is new
and the stream stalls. State is one small record for each stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions import planning, text


@dataclass
class Seen:
    """A stream's state; the fields are also the columns of the streaming state."""

    last_name: str = ""
    last_time: int = 0
    max_index: int = 0
    refreshed_seconds: int = 0
    refreshed_segments: int = 0
    limit_reached: bool = False

    @property
    def pristine(self) -> bool:
        return not self.last_name and not self.last_time


def fresh(window: dict[str, np.ndarray], seen: Seen, limit: int | None = None) -> tuple[int, int]:
    """(first new row, added to the new indexes) of one refresh of one stream, or its length where nothing is new; `seen` moves on.

    window: (seg_index, name, unix_time or null, duration) in order of seg_pos.
    Segments are told apart by time where all have one and one was stored,
    else by name. New indexes that fall behind are moved on.
    """
    index, name, time, duration = (window[c] for c in ("seg_index", "name", "unix_time", "duration"))
    n, shift = len(index), 0
    by_time = n and seen.last_time != 0 and not np.isnan(time).any()
    hits = np.flatnonzero((time == seen.last_time) if by_time else (name == seen.last_name))
    start = int(hits[0]) + 1 if len(hits) else 0 if seen.pristine else n
    if start < n:
        if (least := int(index[start:].min())) < seen.max_index:
            shift = seen.max_index - least + 1
        seen.max_index = int(index[start:].max()) + shift
        seen.last_name = str(name[-1])
        seen.last_time = 0 if np.isnan(time[-1]) else int(time[-1])
    seen.refreshed_seconds += int(np.maximum(duration[start:], 0).sum())
    seen.refreshed_segments += n - start
    if limit is not None and seen.refreshed_seconds >= limit:
        seen.limit_reached = True
    return start, shift


NEW_DDL = "stream_id long, refresh long, seg_index long, name string, duration double, refreshed_seconds long, refreshed_segments long"
COLUMNS = ["stream_id", "refresh", "seg_index", "name", "unix_time", "duration"]


def folded(rows: pd.DataFrame, states: dict[int, Seen], limit: int | None = None) -> pd.DataFrame:
    """The new segments of whole refreshes, in order of stream, refresh and seg_pos; `states` by stream move on."""
    x = {c: rows[c].astype(float).to_numpy() if c == "unix_time" else rows[c].to_numpy() for c in COLUMNS}
    edges = np.flatnonzero((np.diff(x["stream_id"]) != 0) | (np.diff(x["refresh"]) != 0)) + 1
    keep, shift = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
    seconds, counts = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)]):
        seen = states.setdefault(int(x["stream_id"][a]), Seen())
        start, moved = fresh({c: v[a:b] for c, v in x.items()}, seen, limit)
        keep[a + start : b] = True
        shift[a:b], seconds[a:b], counts[a:b] = moved, seen.refreshed_seconds, seen.refreshed_segments
    out = {c: x[c][keep] for c in ("stream_id", "refresh", "seg_index", "name", "duration")}
    out["seg_index"] = out["seg_index"] + shift[keep]
    return pd.DataFrame({**out, "refreshed_seconds": seconds[keep], "refreshed_segments": counts[keep]})


def new_segments(snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """The new segments of every refresh, from (stream_id, refresh, seg_pos, seg_index, name, unix_time, duration).

    One stream's refreshes are folded in order; rows of a stream arrive sorted
    and are taken a batch at a time, so memory holds a batch and one window.
    """
    dealt = snapshots.select(*COLUMNS, "seg_pos").repartition("stream_id").sortWithinPartitions("stream_id", "refresh", "seg_pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, states = None, {}
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            last = held.iloc[-1]
            whole = ~((held["stream_id"] == last["stream_id"]) & (held["refresh"] == last["refresh"])).to_numpy()
            if whole.any():
                states = {k: v for k, v in states.items() if k == held["stream_id"].iloc[0]}
                yield folded(held[whole], states, limit)
            held = held[~whole]
        if held is not None:
            yield folded(held, states, limit)

    return dealt.mapInPandas(run, NEW_DDL)


def wait_seconds(segments: DataFrame, override: int | None = None) -> DataFrame:
    """(wait): half the shortest first part less two, at least 1; from 6 s where no part has a duration."""
    first = segments.where("part_pos = 0").groupBy("stream_id").agg(F.sum("duration").alias("d")).where("d > 0")
    least = first.agg(F.coalesce(F.min("d"), F.lit(6.0)).alias("d"))
    wait = F.lit(max(1, override)) if override is not None else F.greatest(F.floor(F.col("d") / 2) - 2, F.lit(1))
    return least.select(wait.cast("long").alias("wait"))


def aligned_start(segments: DataFrame, by: str, take: int, time: str | None = None) -> DataFrame:
    """Segments of a manifest's streams from their common start on, the shortest with take - 1 of them.

    The start is the largest of the streams' least indexes; with a column of
    times, the largest of their least times, where all of a manifest's segments
    have one. All is windows over one exchange by manifest.
    """
    whole, stream = Window.partitionBy(by), Window.partitionBy(by, "stream_id")
    at = F.col("seg_index").cast("long")
    x = segments.repartition(F.col(by))
    if time is not None:
        x = x.withColumn("_timed", F.min(F.col(time).isNotNull()).over(whole))
        at = F.when(F.col("_timed"), F.col(time).cast("long")).otherwise(at)
    x = x.withColumn("_at", at).withColumn("_least", F.min("_at").over(stream)).withColumn("_start", F.max("_least").over(whole)).where("_at >= _start")
    x = x.withColumn("_all", F.count("*").over(stream)).withColumn("_n", F.row_number().over(stream.orderBy("seg_index", "tie", "price")))
    x = x.withColumns({"_fewest": F.min("_all").over(whole), "_most": F.max("_all").over(whole)})
    skip: Column = F.when(F.col("_most") <= take, 0).otherwise(F.greatest(F.col("_fewest") - take + 1, F.lit(0)))
    return x.where(F.col("_n") > skip).select(*segments.columns)


def same_names(segments: DataFrame, by: str) -> DataFrame:
    """(by, same_name): whether a list's segments, two at least, would all get one name from their URLs."""
    name = text.save_name(F.col("url"))
    return segments.groupBy(by).agg(((F.count("*") > 1) & (F.count(name) == F.count("*")) & (F.min(name) == F.max(name))).alias("same_name"))


def grouped_files(files: DataFrame, by: str, order: list[str]) -> DataFrame:
    """files with `file`: the group of each list's files that are first put together."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return files.withColumn("file", planning.combine_group(place, F.count("*").over(Window.partitionBy(by))))
