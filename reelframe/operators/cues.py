"""Subtitle cues: shifts, merging, grouping, text formats.

Cues are rows (doc_id, cue_pos, start_ms, end_ms, payload, settings).
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = "doc_id"


def left_shift(cues: DataFrame, ms: int) -> DataFrame:
    """Earlier by so much, but not before 0."""
    return cues.withColumns({c: F.greatest(F.col(c) - ms, F.lit(0)) for c in ("start_ms", "end_ms")})


def from_base(cues: DataFrame, base_ms: int) -> DataFrame:
    """Cues count from base_ms, up to the first cue of a document that begins before it."""
    by = Window.partitionBy(BY).orderBy("cue_pos")
    moves = F.min((F.col("start_ms") >= base_ms).cast("int")).over(by) == 1
    return cues.withColumns({c: F.when(moves, F.col(c) - base_ms).otherwise(F.col(c)) for c in ("start_ms", "end_ms")})


def extend(kept: list[list], seen: Counter, cues: list[list]) -> None:
    """Adds cues [start, end, payload, settings, ...] to those kept: not again, and one that goes on where the last ended, with its payload, extends it."""
    for c in cues:
        if seen[tuple(c[:4])]:
            continue
        last = kept[-1] if kept else None
        if last and c[0] - last[1] <= 1 and c[2] == last[2]:
            seen[tuple(last[:4])] -= 1
            last[1] = c[1]
            c = last
        else:
            kept.append(c)
        seen[tuple(c[:4])] += 1


def merged(cues: DataFrame) -> DataFrame:
    """Cues of a document, in order, without repeats; a cue that goes on where the last one ended, with the same payload, extends it.

    The rule depends on what was kept so far, so it is a fold over one
    document's cues, linear in them; documents are dealt out.
    """
    kind = cues.schema[BY].dataType.simpleString()

    def fold(group: pa.Table) -> pa.Table:
        kept: list[list] = []
        rows = sorted(zip(*(group[c].to_pylist() for c in ("cue_pos", "start_ms", "end_ms", "payload", "settings"))), key=lambda r: r[0])
        extend(kept, Counter(), [[*r[1:], r[0]] for r in rows])
        start, end, payload, settings, pos = zip(*kept)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.Table.from_arrays([pa.array([group[BY][0].as_py()] * len(kept), group[BY].type), *(pa.array(x, t) for x, t in zip((pos, start, end, payload, settings), kinds))], [BY, "cue_pos", "start_ms", "end_ms", "payload", "settings"])

    return cues.select(BY, "cue_pos", "start_ms", "end_ms", "payload", "settings").groupBy(BY).applyInArrow(fold, f"{BY} {kind}, cue_pos long, start_ms long, end_ms long, payload string, settings string")


def grouped(cues: DataFrame) -> DataFrame:
    """One cue for each span of a document, payloads in order and joined by line breaks."""
    x = cues.groupBy(BY, "start_ms", "end_ms").agg(F.array_sort(F.collect_list(F.struct("cue_pos", "payload"))).alias("p"), F.min("cue_pos").alias("cue_pos"))
    return x.select(BY, "cue_pos", "start_ms", "end_ms", F.array_join(F.transform("p", lambda c: c["payload"]), "\r\n").alias("payload"))


def time_text(ms: Column, mark: str) -> Column:
    """HH:MM:SS and milliseconds after `mark`; never negative."""
    ms = F.greatest(ms, F.lit(0)).cast("long")
    # not format_string, whose formatter takes most of the time where there are many cues
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(F.when(hours < 100, padded(hours, 2)).otherwise(hours.cast("string")), F.lit(":"), padded(F.floor(ms / 60_000) % 60, 2), F.lit(":"), padded(F.floor(ms / 1000) % 60, 2), F.lit(mark), padded(ms % 1000, 3))


def as_text(cues: DataFrame, kind: str = "vtt") -> DataFrame:
    """(doc_id, body): a document's cues with a payload as WebVTT or SRT; SRT cues are numbered from 1."""
    by = Window.partitionBy(BY).orderBy("cue_pos")
    x = cues.where(F.col("payload") != "").withColumn("_n", F.row_number().over(by))
    end = "\r\n"
    if kind == "vtt":
        one = F.concat(time_text(F.col("start_ms"), "."), F.lit(" --> "), time_text(F.col("end_ms"), "."), F.lit(" "), F.col("settings"), F.lit(end), F.col("payload"), F.lit(end + end))
    else:
        one = F.concat(F.col("_n").cast("string"), F.lit(end), time_text(F.col("start_ms"), ","), F.lit(" --> "), time_text(F.col("end_ms"), ","), F.lit(end), F.col("payload"), F.lit(end + end))
    body = x.groupBy(BY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", one.alias("t")))), lambda c: c["t"]), "").alias("body"))
    head = f"WEBVTT{end}{end}" if kind == "vtt" else ""
    out = cues.select(BY).distinct().join(body, BY, "left")
    empty = f"{head}{end}" if kind == "vtt" else "1\r\n00:00:00,000 --> 00:00:01,000"
    return out.select(BY, F.when(F.col("body").isNull(), F.lit(empty)).otherwise(F.concat(F.lit(head), F.col("body"), F.lit(end))).alias("body"))
