"""Document fingerprints from prefix polynomial hashes.

P[i] = sum of c[j] * B^j for j < i, modulo a prime, answers whether two spans are
equal with two subtractions and one multiplication; a binary search over such
questions finds the longest common extension of two positions. A fingerprint is
the hash of the whole text and, of all spans of WIDTH code points, the smallest
hash in each of SLOTS classes; two fingerprints are alike as far as their
slots agree.

Plan for texts edited with their neighbour in id order: one range exchange
puts neighbours into one task. Only the first and last row of each task wait
for a second, small step over two rows per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import cut, parallelism, pieces, table

#: Two Mersenne primes are not needed: 2^31 - 1 with two bases gives 62 bits and products that fit 64.
PRIME = np.uint64(2**31 - 1)
BASES = (np.uint64(911_382_323), np.uint64(972_663_749))
WIDTH = 12
SLOTS = 64
#: Hex digits of a slot; the value zero stands for a class without spans.
DIGITS = 4
_S31 = np.uint64(31)


def reduce(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x under 2^62 (some 2^64)."""
    x = (x & PRIME) + (x >> _S31)
    x = (x & PRIME) + (x >> _S31)
    return np.where(x >= PRIME, x - PRIME, x)


class Powers:
    """B^j and B^-j modulo PRIME, grown as longer texts come."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in BASES]
        self.down = [np.ones(1, np.uint64) for _ in BASES]
        self.inverse = [np.uint64(pow(int(b), int(PRIME) - 2, int(PRIME))) for b in BASES]

    def upto(self, n: int) -> Powers:
        while len(self.up[0]) < n:
            for k in range(len(BASES)):
                for held, base in ((self.up, BASES[k]), (self.down, self.inverse[k])):
                    step = np.uint64(pow(int(base), len(held[k]), int(PRIME)))
                    held[k] = np.concatenate([held[k], reduce(held[k] * step)])
        return self


POWERS = Powers()


class PrefixHash:
    """Prefix arrays of one text's code points."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        powers = POWERS.upto(self.n + 1)
        # a code point has 21 bits and a sum of 2^33 terms under 2^31 fits 64 bits
        terms = points.astype(np.uint64) + np.uint64(1)
        self.prefix = [reduce(np.concatenate([np.zeros(1, np.uint64), np.cumsum(reduce(terms * powers.up[k][: self.n]))])) for k in range(len(BASES))]

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, stop): equal for equal spans, wherever they stand."""
        out = np.zeros(len(start), np.uint64)
        for k, p in enumerate(self.prefix):
            moved = reduce(reduce(p[stop] + PRIME - p[start]) * POWERS.down[k][start])
            out = (out << _S31) | moved
        return out

    def span(self, start: int, stop: int) -> int:
        return int(self.spans(np.array([start]), np.array([stop]))[0])

    def whole(self) -> int:
        return self.span(0, self.n)


def common_extension(a: PrefixHash, i: int, b: PrefixHash | Joined, j: int) -> int:
    """The length of the longest common prefix of a from i and b from j."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: PrefixHash) -> np.ndarray:
    """The mixed hashes of all spans of WIDTH code points; of a shorter text, its own."""
    if not hashes.n:
        return np.zeros(0, np.uint64)
    start = np.arange(max(1, hashes.n - WIDTH + 1))
    return mixed(hashes.spans(start, np.minimum(start + WIDTH, hashes.n)))


def sketch(*parts: np.ndarray) -> np.ndarray:
    """The smallest window hash of each class, cut to DIGITS hex digits; zero where a class is empty."""
    out = np.full(SLOTS, 2**64 - 1, np.uint64)
    for x in parts:
        np.minimum.at(out, (x & np.uint64(SLOTS - 1)).astype(np.int64), x)
    room = np.uint64(16**DIGITS - 1)
    return np.where(out == np.uint64(2**64 - 1), np.uint64(0), np.uint64(1) + (mixed(out) % room))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Slots that agree, among those that either has; two without spans are alike."""
    either = (a > 0) | (b > 0)
    return float(((a == b) & either).sum() / either.sum()) if either.any() else 1.0


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def as_text(hashes: PrefixHash, slots: np.ndarray) -> str:
    return f"{hashes.n:x}-{hashes.whole():016x}-" + "".join(f"{int(x):0{DIGITS}x}" for x in slots)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of a text replaced by as much, or all, of the next one's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: What is returned of each document.
RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("shared_prefix", pa.int64())])
RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long"


class Fingerprint:
    def __init__(self, text: str | None):
        self.text = text or ""
        self.hashes = PrefixHash(points_of(self.text))
        self.windows = windows(self.hashes)
        self.slots = sketch(self.windows)


class Joined:
    """The prefix hash of a[:left] + b[:right], put together from those of a and b."""

    def __init__(self, a: PrefixHash, left: int, b: PrefixHash, right: int):
        self.n, self.left = left + right, left
        powers = POWERS.upto(self.n + 1)
        self.up, self.down = powers.up, powers.down
        self.a, self.b = a.prefix, b.prefix

    def upto(self, k: int, i: int) -> int:
        if i <= self.left:
            return int(self.a[k][i])
        return (int(self.a[k][self.left]) + int(self.up[k][self.left]) * int(self.b[k][i - self.left])) % int(PRIME)

    def span(self, start: int, stop: int) -> int:
        out = 0
        for k in range(len(BASES)):
            out = out << 31 | (self.upto(k, stop) - self.upto(k, start)) * int(self.down[k][start]) % int(PRIME)
        return out

    def whole(self) -> int:
        return self.span(0, self.n)


class Edited:
    """The fingerprint of own[:-half] + following[:half], from the two texts' hashes.

    A span has the same hash wherever it stands, so only the windows across the
    seam are new.
    """

    def __init__(self, own: Fingerprint, following: Fingerprint):
        half = own.hashes.n // 2
        left, right = own.hashes.n - half, min(half, following.hashes.n)
        self.text = edited(own.text, following.text)
        self.hashes = Joined(own.hashes, left, following.hashes, right)
        if left < WIDTH or right < WIDTH:
            self.slots = Fingerprint(self.text).slots
        else:
            seam = windows(PrefixHash(points_of(self.text[left - WIDTH + 1 : left + WIDTH - 1])))
            self.slots = sketch(own.windows[: left - WIDTH + 1], seam, following.windows[: right - WIDTH + 1])


def compared(doc_id: int | None, own: Fingerprint, following: Fingerprint) -> tuple:
    changed = Edited(own, following)
    return (
        doc_id,
        own.hashes.n,
        hashlib.sha256(changed.text.encode()).hexdigest(),
        as_text(own.hashes, own.slots),
        as_text(changed.hashes, changed.slots),
        likeness(own.slots, changed.slots),
        likeness(own.slots, following.slots),
        common_extension(own.hashes, 0, changed.hashes, 0),
    )


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, compressed text)."""
    to_bytes = zstandard.ZstdCompressor(level=1).compress
    for batch in pieces(batches):
        texts = [x or "" for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([to_bytes(x.encode()) for x in texts], pa.binary())], ["doc_id", "text"])


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, and how it compares with its edited text and with the next document.

    docs: (doc_id, text) among other columns. Rows are in order of doc_id, null
    first, and of packed text among equal ids; the next document of a row is the row
    after it, and of the last row the first. A null text counts as empty. A
    single row is its own next document. No rows give no rows.
    """
    spark = docs.sparkSession
    # texts travel compressed; equal ids are ordered by text, and equal texts compress alike
    packed = docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, text binary")
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "text")]
    ordered = packed.repartitionByRange(parallelism(spark), order[0]).sortWithinPartitions(*order)
    schema = pa.schema([*RESULT, ("edge", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        before, out = None, []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                now = (doc_id, Fingerprint(unpack(text.as_py()).decode()))
                if before is None:
                    out.append((doc_id, *[None] * 7, "first", now[1].text))
                else:
                    out.append((*compared(before[0], before[1], now[1]), None, None))
                before = now
                if len(out) >= 1_000:
                    yield rows_of(schema, out)
                    out = []
        if before is not None:
            out.append((before[0], *[None] * 7, "last", before[1].text))
        yield rows_of(schema, out)

    held = cut(ordered.mapInArrow(run, RESULT_DDL + ", edge string, text string").withColumn("part", F.spark_partition_id()))
    inside = held.where(F.col("edge").isNull()).select(*RESULT.names)
    # two rows a task: the first row of the next task that has rows follows the last row of this one
    edges = held.where(F.col("edge").isNotNull()).select("part", "edge", "doc_id", "text")
    firsts = edges.where("edge = 'first'").select("part", F.col("text").alias("next_text"))
    lasts = edges.where("edge = 'last'").select("part", "doc_id", "text")
    every = Window.orderBy("part")
    following = firsts.select(F.lead("part").over(every).alias("next_part"), "part", F.first("part").over(every).alias("first_part")).select("part", F.coalesce("next_part", "first_part").alias("next_part"))
    meeting = lasts.join(following, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows_of(RESULT, [compared(i, Fingerprint(a), Fingerprint(b)) for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")))])

    return inside.unionByName(meeting.mapInArrow(meet, RESULT_DDL))


def op9_prefix_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
