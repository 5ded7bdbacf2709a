"""The live window as a Structured Streaming query.

Each refresh of a stream arrives as rows; state by stream is kept by Spark,
checkpointed with the query, and moves on by the same step as the batch fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelframe.operators.live import NEW_DDL, Seen, folded

STATE_DDL = "last_name string, last_time long, max_index long, refreshed_seconds long, refreshed_segments long, limit_reached boolean"


def new_segments(snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """New segments as they come, from a streaming DataFrame of refreshes.

    snapshots: (stream_id, refresh, seg_pos, seg_index, name, unix_time,
    duration). A refresh must arrive whole in one micro-batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        states = {key[0]: Seen(*state.get)} if state.exists else {}
        rows = pd.concat([*batches]).sort_values(["stream_id", "refresh", "seg_pos"], kind="stable")
        yield folded(rows, states, limit)
        state.update(astuple(states[key[0]]))

    assert [f.name for f in fields(Seen)] == [c.split()[0] for c in STATE_DDL.split(", ")]
    return snapshots.groupBy("stream_id").applyInPandasWithState(run, NEW_DDL, STATE_DDL, "append", GroupStateTimeout.NoTimeout)


def speeds(events: DataFrame, late: str = "10 seconds", step: str = "1 second") -> DataFrame:
    """(session_id, tick, bytes) per second of a stream of progress events; what is later than `late` is left out."""
    tick = F.window("ts", step)
    return events.withWatermark("ts", late).groupBy("session_id", tick).agg(F.sum("downloaded_bytes").alias("bytes")).select("session_id", F.col("window.start").alias("tick"), "bytes")
