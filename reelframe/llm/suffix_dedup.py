"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

Which suffixes: every window of LENGTH bytes picks the least of its ANCHOR-byte
grams as its anchor, by hash and then from the left. Equal windows pick the same
one, so windows can only be equal where their anchors are, and it is enough to
sort one suffix for each anchor, with the windows (a contiguous range) that
picked it. Anchors that occur once are dropped before any text moves.

The sort: tasks sort their suffixes into runs and front-code them (the length
shared with the suffix before, and the rest). Runs are exchanged by anchor class,
and a loser tree merges the runs of a bucket. A contender keeps the length that
it shares with the last winner; the longer shared length wins without a look at
the bytes, and equal ones are compared from there on, so no known prefix is ever
compared again. The lengths that come out beside the sorted suffixes, with
hashes of what stands before the anchors, tell which windows occur twice.

Texts are known by a 64-bit hash, so copies are handled once; strings that
repeat within a task's rows are settled there, before the exchange.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import cut, parallelism, pieces, table

LENGTH = 200
ANCHOR = 32
#: Suffixes in a run, and on average in a bucket of the exchange.
RUN = 100_000
BUCKET = 20_000
#: Cells of the window tables of a class that are held at once.
CELLS = 1_000_000
PLAIN, REPEATED, SETTLED = 0, 1, 2

_RNG = np.random.default_rng(7_310)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least value of every `width` neighbours: block-wise minima from both ends."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, anchor's hash, hash of all that the windows cover) by anchor."""
    joined = b"".join(texts)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(joined) < length:
        return none
    raw = np.frombuffer(joined, np.uint8)
    size = np.array([len(t) for t in texts])
    first = np.cumsum(size) - size
    up, down = powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=prefix[1:])
    grams = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * down[: len(raw) - ANCHOR + 1])
    at = np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(grams >> np.uint64(32) << np.uint64(32) | at, length - ANCHOR + 1)
    edge = np.zeros(len(raw) + 1, np.int32)
    long = size >= length
    np.add.at(edge, first[long], 1)
    np.add.at(edge, first[long] + size[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[: len(least)]) > 0)
    if not len(window):
        return none
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
    low, high, anchor = window[starts], window[np.r_[starts[1:] - 1, len(window) - 1]], anchor[starts]
    text = np.searchsorted(first, low, side="right") - 1
    # empty texts share their place with the next one: take the text that holds the window
    cover = mix((prefix[high + length] - prefix[low]) * down[low] + (high - low).astype(np.uint64) * np.uint64(_BASE) + (anchor - low).astype(np.uint64))
    base = first[text]
    return text, anchor - base, low - base, high - base, grams[anchor].view(np.int64), cover


def merged_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal disjoint ones, in order; touching spans are one."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.r_[True, start[1:] > stop[:-1]]
    return start[new], stop[np.r_[np.flatnonzero(new)[1:] - 1, len(stop) - 1]]


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, tid, pack, kind): the anchors of each text, and spans already known to repeat (SETTLED)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = np.seterr(over="ignore")
        for batch in pieces(batches):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            tids = batch.column("tid").to_numpy()
            text, anchor, low, high, key, cover = anchored(texts, length)
            _, rep, back, times = np.unique(cover, return_index=True, return_inverse=True, return_counts=True)
            kind = np.where(times > 1, REPEATED, PLAIN)
            pack = anchor << 24 | (anchor - low) << 12 | (anchor - high)
            known = times[back] > 1
            rows = [(key[rep], tids[text[rep]], pack[rep], kind)]
            for t in np.unique(text[known]):
                own = known & (text == t) if len(text) < 5_000 else np.flatnonzero(known[(a := np.searchsorted(text, t)) : (b := np.searchsorted(text, t, side="right"))]) + a
                start, stop = merged_spans(low[own], high[own] + length)
                tid = np.full(len(start), tids[t])
                rows.append((tid, tid, start << 32 | (stop - start), np.full(len(start), SETTLED)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows)], ["anchor", "tid", "pack", "kind"])
        np.seterr(**old)

    return docs.mapInArrow(run, "anchor long, tid long, pack long, kind long")


def shared_anchors(found: DataFrame) -> DataFrame:
    """The rows whose anchor occurs at two places at least, copies of one text not counted, and the settled spans."""
    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "tid", "pack", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "tid", "pack", "kind"]
        last: list[np.ndarray] | None = None
        open_ = False  # whether the last row held back has been seen to share its anchor
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in names]
            if last is not None:
                now = [np.r_[x, y] for x, y in zip(last, now)]
            key, tid, pack, kind = now
            fresh = np.r_[True, (key[1:] != key[:-1]) | (tid[1:] != tid[:-1]) | (pack[1:] != pack[:-1])]
            now = [x[fresh] for x in now]
            key, kind = now[0], now[3]
            same = key[1:] == key[:-1]
            shared = np.r_[open_, same] | np.r_[same, False]
            keep = shared | (kind == SETTLED)
            last, open_ = [x[-1:] for x in now], bool(shared[-1])
            out = [x[:-1][keep[:-1]] for x in now]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out[1:]], names[1:])
        if last is not None and (open_ or last[3][0] == SETTLED):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last[1:]], names[1:])

    return dealt.mapInArrow(run, "tid long, pack long, kind long")


def shared_length(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix of a and b, of which `known` bytes are known."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differ.bit_length() + 7) // 8


def shared_end(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[len(a) - n :]) ^ int.from_bytes(b[len(b) - n :])
    return ((differ & -differ).bit_length() - 1) // 8 if differ else n


RUN_COLUMNS = ["shared", "rest_size", "rest", "before_size", "before", "tid", "pack", "kind"]
RUN_DDL = "bucket int, " + ", ".join(f"{c} binary" for c in RUN_COLUMNS)


def front_coded(entries: list[tuple]) -> list[bytes]:
    """A sorted run of (suffix, before, tid, pack, kind) as columns of bytes."""
    entries.sort(key=lambda e: e[0])
    shared, rest, last = [], [], b""
    for e in entries:
        shared.append(n := shared_length(last, e[0]))
        rest.append(e[0][n:])
        last = e[0]
    before = [e[1] for e in entries]
    numbers = lambda x, t: np.array(x, t).tobytes()
    return [numbers(shared, np.uint16), numbers([*map(len, rest)], np.uint16), b"".join(rest), numbers([*map(len, before)], np.uint16), b"".join(before), *(numbers([e[k] for e in entries], np.int64) for k in (2, 3, 4))]


class Run:
    """A front-coded run, decoded as it is read."""

    def __init__(self, columns: list[bytes]):
        self.shared = np.frombuffer(columns[0], np.uint16).tolist()
        ends = np.cumsum(np.frombuffer(columns[1], np.uint16).astype(np.int64)).tolist()
        before_ends = np.cumsum(np.frombuffer(columns[3], np.uint16).astype(np.int64)).tolist()
        self.suffix, last, a = [], b"", 0
        for n, b in zip(self.shared, ends):
            last = last[:n] + columns[2][a:b]
            self.suffix.append(last)
            a = b
        self.before = [columns[4][a:b] for a, b in zip([0, *before_ends], before_ends)]
        self.tid, self.pack, self.kind = (np.frombuffer(c, np.int64).tolist() for c in columns[5:])


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, place, length shared with the suffix before) in order of suffixes, by a loser tree."""
    size = 1 << max(0, len(runs) - 1).bit_length()
    place = [0] * size
    key: list[bytes] = [r.suffix[0] if r.suffix else b"" for r in runs] + [b""] * (size - len(runs))
    known = [0 if r.suffix else -1 for r in runs] + [-1] * (size - len(runs))
    losers = [0] * size

    def first_of(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser comes to know what it shares with the winner."""
        p, q = known[x], known[y]
        if p != q:
            return (x, y) if p > q else (y, x)
        if p < 0:
            return x, y
        a, b = key[x], key[y]
        n = shared_length(a, b, p)
        if n == len(a) or (n < len(b) and a[n] < b[n]):
            known[y] = n
            return x, y
        known[x] = n
        return y, x

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = first_of(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while known[winner] >= 0:
        yield winner, place[winner], known[winner]
        place[winner] += 1
        run = runs[winner]
        if (i := place[winner]) < len(run.suffix):
            key[winner], known[winner] = run.suffix[i], run.shared[i]
        else:
            known[winner] = -1
        node = (winner + size) >> 1
        while node:
            winner, losers[node] = first_of(winner, losers[node])
            node >>= 1


def repeated_windows(suffixes: list[int], befores: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """For each member of a class and each number j of bytes before the anchor, whether that window stands elsewhere in the class.

    suffixes: the length that each shares with the one before it; low, high: the
    range of j. Windows are equal if length - j bytes from the anchor on and j
    bytes before it are: the sorted order numbers the former, hashes the latter.
    """
    m, first, last = len(befores), int(low.min()), int(high.max())
    out = np.zeros((m, last - first + 1), bool)
    shared = np.array(suffixes)
    shared[0] = -1
    widest = max(map(len, befores))
    padded = np.frombuffer(b"".join(b.rjust(widest, b"\0") for b in befores), np.uint8).reshape(m, widest)[:, ::-1] if widest else np.zeros((m, 0), np.uint8)
    step = max(1, CELLS // m)
    up = powers(widest + 1)[0]
    carried = np.zeros(m, np.uint64)
    done = 0
    for j0 in range(first, last + 1, step):
        j = np.arange(j0, min(j0 + step, last + 1))
        if j0 > done:
            carried = carried + (_BYTE[padded[:, done:j0]] * up[done:j0]).sum(axis=1, dtype=np.uint64)
            done = j0
        tail = np.zeros((m, len(j)), np.uint64)
        tail[:, 0] = carried
        if len(j) > 1:
            more = _BYTE[padded[:, j0 : j[-1]]] * up[j0 : j[-1]]
            tail[:, 1:] = carried[:, None] + np.cumsum(more, axis=1, dtype=np.uint64)
        group = np.cumsum(shared[:, None] < (length - j)[None, :], axis=0).astype(np.uint64)
        value = mix(mix(tail) + group * np.uint64(_BASE))
        valid = (j >= low[:, None]) & (j <= high[:, None])
        # what has no such window gets a number of its own
        value = np.where(valid, value, np.uint64(0))
        order = np.argsort(value, axis=0, kind="stable")
        ranked = np.take_along_axis(value, order, axis=0)
        same = ranked[1:] == ranked[:-1]
        pad = np.zeros((1, len(j)), bool)
        twice = np.zeros_like(valid)
        np.put_along_axis(twice, order, np.concatenate([same, pad]) | np.concatenate([pad, same]), axis=0)
        out[:, j0 - first : j0 - first + len(j)] = twice & valid
    return out


def settle(runs: list[Run], length: int) -> Iterator[tuple[int, int, int]]:
    """(tid, start, stop) of the spans that the plain members of the merged runs repeat."""
    group: list[tuple[int, int, int]] = []

    def answers() -> Iterator[tuple[int, int, int]]:
        packs = np.array([runs[r].pack[i] for r, i, _ in group])
        anchor, high, low = packs >> 24, packs >> 12 & 4095, packs & 4095
        befores = [runs[r].before[i] for r, i, _ in group]
        kinds = [runs[r].kind[i] for r, i, _ in group]
        if len(group) == 2:
            a = max(int(low.max()), length - group[1][2])
            b = min(int(high.min()), shared_end(*befores))
            if a <= b:
                for k in (0, 1):
                    if kinds[k] == PLAIN:
                        yield runs[group[k][0]].tid[group[k][1]], int(anchor[k]) - b, int(anchor[k]) - a + length
            return
        twice = repeated_windows([n for *_, n in group], befores, low, high, length)
        first = int(low.min())
        edges = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        for (k, a), (_, b) in zip(np.argwhere(edges == 1).tolist(), np.argwhere(edges == -1).tolist()):
            if kinds[k] == PLAIN:
                yield runs[group[k][0]].tid[group[k][1]], int(anchor[k]) - (first + b - 1), int(anchor[k]) - (first + a) + length

    for r, i, shared in merge(runs):
        if group and shared < ANCHOR:
            if len(group) > 1:
                yield from answers()
            group = []
        group.append((r, i, shared))
    if len(group) > 1:
        yield from answers()


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tid, spans): of each text, known by xxhash64, where strings of `length` bytes stand that another text or place has too."""
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), "text")
    active = cut(shared_anchors(occurrences(texts, length)))
    asked = active.where(F.col("kind") != SETTLED)
    buckets = max(parallelism(docs.sparkSession), -(-asked.count() // BUCKET))
    lists = asked.groupBy("tid").agg(F.collect_list(F.struct("pack", "kind")).alias("asked"))
    # one row for each distinct text; the join uses the same exchange
    whole = texts.where(F.octet_length("text") >= length).groupBy("tid").agg(F.first("text").alias("text")).join(lists, "tid")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        n = 0

        def flush() -> pa.RecordBatch:
            rows = [(b, *front_coded(e)) for b, e in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(1 + len(RUN_COLUMNS))], ["bucket", *RUN_COLUMNS])

        for batch in pieces(batches):
            for tid, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("tid", "text", "asked"))):
                raw = text.encode()
                for x in wanted:
                    anchor, high, low = x["pack"] >> 24, x["pack"] >> 12 & 4095, x["pack"] & 4095
                    suffix = raw[anchor : anchor - low + length]
                    held.setdefault(zlib.crc32(suffix[:ANCHOR]) % buckets, []).append((suffix, raw[anchor - high : anchor], tid, x["pack"], x["kind"]))
                n += len(wanted)
                if n >= RUN:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def combine(group: pa.Table) -> pa.Table:
        old = np.seterr(over="ignore")
        runs = [Run(list(r)) for r in zip(*(group[c].to_pylist() for c in RUN_COLUMNS))]
        rows = [*settle(runs, length)]
        np.seterr(**old)
        return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["tid", "start", "stop"])

    found = whole.mapInArrow(code, RUN_DDL).groupBy("bucket").applyInArrow(combine, "tid long, start long, stop long")
    settled = active.where(F.col("kind") == SETTLED).select("tid", F.expr("shiftright(pack, 32)").alias("start"), F.expr("shiftright(pack, 32) + (pack & 4294967295)").alias("stop"))
    return found.unionByName(settled).groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs (doc_id, text).

    Strings are bytes of UTF-8 and never cross documents. A null text counts as
    empty; texts shorter than `length` keep all. Rows with equal texts repeat
    each other wholly, whatever their ids, null ids included. No rows give no
    rows.
    """
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    copied = texts.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1").select("tid", F.lit(True).alias("copied"))
    spans = cut(repeated_spans(docs, length).join(copied, "tid", "full"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in pieces(batches):
            out = []
            for doc_id, text, spans, copied in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "copied"))):
                raw = text.encode()
                n = len(raw)
                if n < length:
                    start = stop = np.zeros(0, np.int64)
                elif copied:
                    start, stop = np.array([0]), np.array([n])
                else:
                    start, stop = merged_spans(*(np.array([s[c] for s in spans or []], np.int64) for c in ("start", "stop")))
                kept = hashlib.sha256()
                for a, b in zip([0, *stop.tolist()], [*start.tolist(), n]):
                    kept.update(raw[a:b])
                out.append((doc_id, n, int((stop - start).sum()), len(start), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k < 4 else pa.string()) for k in range(5)], names)

    return texts.join(spans, "tid", "left").select("doc_id", "text", "spans", "copied").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
