"""The stream of refreshes: restarts, and the same segments as the batch."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from reelframe.operators import live as batch
from reelframe.streaming import live
from reelframe.streaming.source import SCHEMA, TYPES, SnapshotSource


def refreshes(n):
    """Windows of two streams that move on by none to three segments."""
    r, at, out = random.Random(8), {1: 0, 2: 50}, []
    for k in range(n):
        rows = []
        for s in at:
            at[s] += r.randrange(4)
            rows += [(s, k, p, at[s] + p, f"s{s}-{at[s] + p}", None, 2.0) for p in range(5)]
        out.append(rows)
    return out


def put(folder, k, rows):
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES.types)], schema=TYPES)
    pq.write_table(table, f"{folder}/.{k:05d}")
    (folder / f".{k:05d}").rename(folder / f"{k:05d}.parquet")


def test_each_segment_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(SnapshotSource)
    folder = tmp_path / "refreshes"
    folder.mkdir()
    windows = refreshes(6)
    for first, last in ((0, 3), (3, 4), (4, 6)):
        for k in range(first, last):
            put(folder, k, windows[k])
        snapshots = spark.readStream.format("snapshot_files").load(str(folder))
        query = live.new_segments(snapshots).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").start(f"{tmp_path}/out")
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    columns = ("stream_id", "refresh", "seg_index", "name")
    got = sorted(tuple(r[c] for c in columns) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    wanted = sorted(tuple(r[c] for c in columns) for r in batch.new_segments(spark.createDataFrame([x for w in windows for x in w], SCHEMA)).collect())
    assert got == wanted and len({x[3] for x in got}) == len(got) > 10
