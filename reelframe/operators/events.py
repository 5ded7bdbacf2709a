"""What a session's progress events come to.

The summary is an ordered fold: some events overwrite a value, later ones raise
it. Written as "the last overwriting value, and the most of what came after it",
it needs two ordinary aggregations and no list of a session's events, however
many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = "session_id"
SEQ = "event_seq"


def last(column: str, kind: Column) -> Column:
    """The column's value in the last event of a kind."""
    return F.max_by(F.col(column), F.when(kind, F.col(SEQ)))


def summary(events: DataFrame) -> DataFrame:
    """One row per session: bytes, speed, segments, number of warnings."""
    kind = F.col("kind")
    aggregate, stream = kind == "AggregateProgress", kind == "StreamProgress"
    ends = events.groupBy(BY).agg(
        F.max(F.when(aggregate, F.col(SEQ))).alias("at"),
        last("downloaded_bytes", aggregate).alias("set_bytes"),
        last("total_bytes", aggregate).alias("total_bytes"),
        last("bytes_per_second", aggregate).alias("set_speed"),
        F.coalesce(F.max(F.when(stream, F.col("completed_segments"))), F.lit(0)).alias("completed_segments"),
        last("total_segments", stream).alias("total_segments"),
        F.sum(kind.isin("Warning", "ExternalToolOutput", "ConsoleLine").cast("long")).alias("n_warnings"),
    )
    after = events.where(stream).join(ends.select(BY, "at"), BY).where(F.col("at").isNull() | (F.col(SEQ) > F.col("at")))
    most = after.groupBy(BY).agg(F.max("downloaded_bytes").alias("more_bytes"), F.max("bytes_per_second").alias("more_speed"))
    return ends.join(most, BY, "left").select(
        BY,
        F.greatest(F.coalesce("set_bytes", F.lit(0)), F.coalesce("more_bytes", F.lit(0))).alias("downloaded_bytes"),
        "total_bytes",
        F.greatest(F.coalesce("set_speed", F.lit(0)), F.coalesce("more_speed", F.lit(0))).alias("bytes_per_second"),
        "completed_segments",
        "total_segments",
        "n_warnings",
    )


def warnings(events: DataFrame) -> DataFrame:
    """(session_id, event_seq, message) of every event that a summary lists as a warning."""
    return events.where(F.col("kind").isin("Warning", "ExternalToolOutput", "ConsoleLine")).select(BY, SEQ, "message")


def stream_states(events: DataFrame) -> DataFrame:
    """(session_id, stream_id, length, total, speed, completed, segments, n_finished) per stream of a session.

    Progress overwrites the completed segments, finished ones raise them to
    their index plus one.
    """
    kind = F.col("kind")
    stream, overwrites = kind == "StreamProgress", kind.isin("StreamProgress", "LiveRefresh")
    by = [BY, "stream_id"]
    x = events.where(kind.isin("StreamProgress", "LiveRefresh", "SegmentFinished"))
    ends = x.groupBy(*by).agg(
        F.max(F.when(overwrites, F.col(SEQ))).alias("at"),
        F.coalesce(last("downloaded_bytes", stream), F.lit(0)).alias("length"),
        last("total_bytes", stream).alias("total"),
        F.coalesce(last("bytes_per_second", stream), F.lit(0)).alias("speed"),
        F.coalesce(last("completed_segments", overwrites), F.lit(0)).alias("set_completed"),
        last("total_segments", overwrites).alias("segments"),
        F.countDistinct(F.when(kind == "SegmentFinished", F.col("segment_index"))).alias("n_finished"),
    )
    after = x.where(kind == "SegmentFinished").join(ends.select(*by, "at"), by).where(F.col("at").isNull() | (F.col(SEQ) > F.col("at")))
    most = after.groupBy(*by).agg(F.max(F.col("segment_index") + 1).alias("more"))
    x = ends.join(most, by, "left").withColumn("completed", F.greatest("set_completed", F.coalesce("more", F.lit(0))))
    return x.drop("at", "set_completed", "more")


def job_counters(events: DataFrame) -> DataFrame:
    """(session_id, completed_length, total_length, download_speed).

    The last of aggregate and stream progress decides: the former's own
    numbers, or sums over the streams, where one unknown total makes the
    total unknown.
    """
    kind = F.col("kind")
    decides = events.where(kind.isin("AggregateProgress", "StreamProgress"))
    final = decides.groupBy(BY).agg(F.max_by(F.struct("kind", "downloaded_bytes", "total_bytes", "bytes_per_second"), SEQ).alias("x"))
    per_stream = decides.where(kind == "StreamProgress").groupBy(BY, "stream_id").agg(F.max_by(F.struct("downloaded_bytes", "total_bytes", "bytes_per_second"), SEQ).alias("s"))
    sums = per_stream.groupBy(BY).agg(
        F.sum("s.downloaded_bytes").alias("length"), F.when(F.count("s.total_bytes") == F.count("*"), F.sum("s.total_bytes")).alias("total"), F.sum("s.bytes_per_second").alias("speed")
    )
    own = F.col("x.kind") == "AggregateProgress"
    return final.join(sums, BY, "left").select(
        BY,
        F.when(own, F.col("x.downloaded_bytes")).otherwise(F.col("length")).alias("completed_length"),
        F.when(own, F.col("x.total_bytes")).otherwise(F.col("total")).alias("total_length"),
        F.when(own, F.col("x.bytes_per_second")).otherwise(F.col("speed")).alias("download_speed"),
    )


def bitfield(events: DataFrame) -> DataFrame:
    """(session_id, n_pieces, bitfield): the segments of all streams as bits, highest first, in hex.

    A session's pieces are bounded by its segments; its bytes are summed from
    rows before one short list of them is made.
    """
    states = stream_states(events).withColumn("pieces", F.greatest(F.coalesce("segments", "completed"), "completed", "n_finished"))
    by = Window.partitionBy(BY).orderBy("stream_id")
    states = states.withColumn("offset", F.coalesce(F.sum("pieces").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    done = events.where(F.col("kind") == "SegmentFinished").select(BY, "stream_id", "segment_index").distinct().join(states, [BY, "stream_id"]).where(F.col("segment_index") < F.col("pieces"))
    plain = states.where((F.col("n_finished") == 0) & (F.col("completed") > 0)).withColumn("segment_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("completed") - 1)))
    bits = done.select(BY, (F.col("offset") + F.col("segment_index")).alias("bit")).unionByName(plain.select(BY, (F.col("offset") + F.col("segment_index")).alias("bit")))
    held = bits.groupBy(BY, F.expr("bit div 8").alias("byte")).agg(F.sum(F.expr("shiftleft(1, cast(7 - bit % 8 as int))")).alias("value"))
    held = held.groupBy(BY).agg(F.map_from_entries(F.collect_list(F.struct("byte", "value"))).alias("bytes"))
    total = states.groupBy(BY).agg(F.sum("pieces").alias("n_pieces")).join(held, BY, "left")
    one = lambda i: F.lpad(F.lower(F.hex(F.coalesce(F.element_at("bytes", i), F.lit(0)))), 2, "0")
    text = F.when(F.col("n_pieces") > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(n_pieces + 7) div 8") - 1), one), "")).otherwise("")
    return total.select(BY, "n_pieces", text.alias("bitfield"))


def stalls(events: DataFrame, most: int, step: str = "1 day") -> DataFrame:
    """(session_id, tick, run, stop): ticks without a new byte, each with the length of the run that it ends; a run of `most` stops a download.

    Progress tells a stream's bytes so far, so what is new in a tick is by how
    much their maximum rises. All ticks from a session's first event to its last
    count, those without events too.
    """
    at = F.window("ts", step)["start"].alias("tick")
    so_far = events.where(F.col("kind") == "StreamProgress").groupBy(BY, "stream_id", at).agg(F.max("downloaded_bytes").alias("most"))
    by = Window.partitionBy(BY, "stream_id").orderBy("tick")
    rise = F.col("most") - F.coalesce(F.max("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = so_far.withColumn("rise", F.greatest(rise, F.lit(0))).groupBy(BY, "tick").agg(F.sum("rise").alias("bytes"))
    span = events.groupBy(BY).agg(F.min(F.window("ts", step)["start"]).alias("first"), F.max(F.window("ts", step)["start"]).alias("last"))
    ticks = span.select(BY, F.explode(F.sequence("first", "last", F.expr(f"interval {step}"))).alias("tick"))
    x = ticks.join(new, [BY, "tick"], "left").withColumn("moved", F.coalesce("bytes", F.lit(0)) > 0)
    x = x.withColumn("island", F.sum(F.col("moved").cast("long")).over(Window.partitionBy(BY).orderBy("tick"))).where(~F.col("moved"))
    run = F.row_number().over(Window.partitionBy(BY, "island").orderBy("tick")).cast("long")
    return x.withColumn("run", run).withColumn("stop", F.col("run") >= most).select(BY, "tick", "run", "stop")


def items_per_second(items: Column, elapsed_ms: Column) -> Column:
    """Whole items a second; less than a millisecond counts as one."""
    return F.floor(items * 1000 / F.greatest(elapsed_ms, F.lit(1)))
