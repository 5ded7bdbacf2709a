"""Connected components of a table of links: union-find in each task, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import cut

#: Links that a task joins at once.
LINKS = 500_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that it reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as links (u, v) from every node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(len(nodes), at[: len(a)], at[len(a) :])
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def joined_in_tasks(links: DataFrame) -> DataFrame:
    """links (u, v) with each task's share replaced by its stars: never more rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= LINKS:
                held = [stars(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) >= LINKS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["u", "v"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*held)))], ["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a long, b long): the smallest id that it reaches.

    Tasks first join what links they hold, so that a hub has one link a task at
    most. Then each round hangs neighbours under their smallest neighbour, those
    above a node and those below it, until every id hangs directly under the
    smallest. Rounds are written to the shared folder, and links never grow in
    number. No links give no rows.
    """
    e = joined_in_tasks(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    e = cut(joined_in_tasks(e.repartition("u")))
    while True:
        ends = e.select(F.col("u").alias("id"), "v").unionByName(e.select(F.col("v").alias("id"), F.lit(None).cast("long").alias("v")))
        held = ends.groupBy("id").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max(F.col("v").isNull()).alias("above"))
        if held.where("least <> most or least is not null and above").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        down = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(joined_in_tasks(down.unionByName(least.select("u", F.col("m").alias("v"))).repartition("u")).distinct())
    return e.distinct().select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
