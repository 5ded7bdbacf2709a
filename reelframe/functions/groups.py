"""Rows of one key folded in order, where what a row does depends on those before it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
#: Rows that are sent back at a time.
BATCH = 10_000


def folded(rows: DataFrame, key: str, order: list[str], fold: Callable[[list[tuple]], Iterable[tuple]], fields: dict[str, str]) -> DataFrame:
    """(key, fields): what fold gives of each key's rows (tuples of all columns) in order.

    One exchange, by key. Groups follow each other in a task's batches, as a call
    for each of many small groups would cost more than the fold; a task holds one group's rows at a time.
    """
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = []

        def records() -> Iterator[tuple]:
            for batch in batches:
                kind[:] = [batch.schema.field(at).type]
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [*kind, *(KINDS[f] for f in fields.values())])], [key, *fields])

        out: list[tuple] = []
        for k, group in groupby(records(), itemgetter(at)):
            out += ((k, *r) for r in fold(list(group)))
            if len(out) >= BATCH:
                yield sent(out)
                out = []
        if out:
            yield sent(out)

    schema = ", ".join([f"{key} {rows.schema[key].dataType.simpleString()}", *(f"{c} {k}" for c, k in fields.items())])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
