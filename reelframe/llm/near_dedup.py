"""MinHash near-deduplication by an inverted join over signature coordinates.

Every distinct shingle set (a class of copies) posts itself under the
(coordinate, value) pairs of its first coordinates, the prefix: a pair as alike
as asked shares one of these but for one or two pairs in a million. A posting
list is merged: sizes that rule out the similarity and pairs that are connected
already are skipped, and for the rest the coordinates with equal values are
counted. Pairs above the match threshold are retained; they connect classes to
groups, so that every two classes as alike as asked are in one group.

Within a group the texts meet, each in one task, and links are confirmed on the
full shingle sets: shingles that no other set of the task has bound what a set
can share, and pairs that are connected already are skipped. What leaves a task
are links that join components, never all pairs.

A long list, or a large group, is dealt to blocks of bounded size. What the
blocks connect gets one label, and then only blocks of different labels meet in
pairs: a large group of true copies costs one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import cut, pieces, scratch, table, unused
from reelframe.llm.components import components, stars

WORDS = 5
#: op3 links two documents where 100 * common >= LEAST * all of their shingles.
LEAST = 85
COORDINATES = 64
#: Of pairs just as alike as asked, at most this share agrees in too few coordinates and is lost, and again in no coordinate of the prefix.
LOST = 2.5e-6
#: Classes of a posting list that are merged at once; a longer list is dealt to blocks.
LONG_LIST = 1_024
#: A list that is left with more blocks is first parted by pairs of further coordinates.
MANY_BLOCKS = 16
#: Shingles of a group whose sets meet in one task; a larger group is dealt to blocks.
LARGE_GROUP = 200_000
#: Lists up to this length are compared together.
SHORT = 24
#: Signatures compared at once within a list.
STEP = 64

_M = np.uint64(0xBF58476D1CE4E5B9)
_RNG = np.random.default_rng(20_240_501)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def matches_for(least: int) -> int:
    """The most coordinates in which all but LOST of the pairs of similarity least / 100 agree: 40 for 85, 35 for 80."""
    p, lost, m = least / 100, 0.0, 0
    while m < COORDINATES and (lost := lost + comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)) <= LOST:
        m += 1
    return m


def tries_for(least: int, width: int = 1) -> int:
    """So many groups of `width` coordinates that all but LOST of the pairs of similarity least / 100 agree in one of them."""
    n = ceil(log(LOST) / log(1 - (least / 100) ** width)) if least < 100 else 1
    if n * width > COORDINATES // 2:
        raise ValueError(f"a similarity of {least} % is too low for {COORDINATES} coordinates")
    return n


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers modulo 2^64 and those of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step)
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, all texts at once."""
    joined = (b" ".join(texts) + b" ").translate(_LOWER)
    length = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(length) - length
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    stop = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    up, down = powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=prefix[1:])
    words = mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64))
    bounds = np.searchsorted(start, np.r_[first, len(raw)])
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = h * np.uint64(0xA0761D6478BD642F) + w
            out.append(mix(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The COORDINATES minima of each non-empty set."""
    joined = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((joined ^ _XOR[k]) * _ODD[k], first)
    return out >> np.uint64(32)


def identity(s: np.ndarray) -> bytes:
    """A set's 192 bits: two sums of mixed hashes and the size."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s * np.uint64(_BASE) + np.uint64(1)).sum(dtype=np.uint64), len(s)], np.uint64).tobytes()


def sketched(docs: DataFrame, prefix: int) -> DataFrame:
    """(doc_id, digest, n_shingles, key, bits, heads): the text's md5, the set's size, identity, low bytes of its signature, and its first `prefix` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = np.seterr(over="ignore")
        for batch in pieces(batches):
            sets = shingle_sets([(x or "").encode() for x in batch.column("text").to_pylist()])
            size = np.array([len(s) for s in sets])
            full = [s for s in sets if len(s)]
            bits, heads, keys = ([None] * len(sets) for _ in range(3))
            if full:
                sig = signatures(full)
                low, values = (sig & np.uint64(255)).astype(np.uint8), sig[:, :prefix].astype(np.int64)
                for row, i in enumerate(np.flatnonzero(size)):
                    bits[i], heads[i], keys[i] = low[row].tobytes(), values[row], identity(sets[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary()), pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "digest", "n_shingles", "key", "bits", "heads"])
        np.seterr(**old)

    return docs.select("doc_id", "text", F.md5("text").alias("digest")).mapInArrow(run, "doc_id long, digest string, n_shingles long, key binary, bits binary, heads array<long>")


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of whole tasks, from batches that are sorted by `task`."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, now]) if held is not None else now
        key = held["task"].to_numpy()
        if key[0] == key[-1]:
            continue
        last = int(np.searchsorted(key, key[-1]))
        yield held.slice(0, last)
        held = held.slice(last)
    if held is not None:
        yield held


def agreeing(bits: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
    """Whether the pairs (i, j) may be as alike by size, and agree in enough coordinates."""
    may = np.minimum(size[i], size[j]) * 100 >= least * np.maximum(size[i], size[j])
    may[may] = (bits[i[may]] == bits[j[may]]).sum(axis=1) >= matches_for(least)
    return may


def connected(bits: np.ndarray, size: np.ndarray, label: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """Links (a, b), by position, that connect what retained pairs of one list connect."""
    a, b, matches = [], [], matches_for(least)
    free = np.arange(len(bits))
    while len(free):
        reached, free = free[:1], free[1:]
        seed = int(reached[0])
        while len(reached) and len(free):
            now, reached = reached[:STEP], reached[STEP:]
            skip = (np.minimum(size[now][:, None], size[free]) * 100 < least * np.maximum(size[now][:, None], size[free])) | (label[now][:, None] == label[free])
            agree = np.zeros(skip.shape, bool)
            x, y = np.nonzero(~skip)
            for k in range(0, len(x), 1 << 16):
                p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                agree[p, q] = (bits[now[p]] == bits[free[q]]).sum(axis=1) >= matches
            # classes of one label are connected already
            hit = agree.any(axis=0) | np.isin(label[free], label[now])
            a += [seed] * int(hit.sum())
            b += free[hit].tolist()
            reached, free = np.concatenate([reached, free[hit]]), free[~hit]
    return a, b


def merged(dealt: DataFrame, least: int) -> DataFrame:
    """Links (u, v) that connect what the lists' retained pairs connect, from (task, node, label, size, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole(batches):
            task = rows["task"].to_numpy()
            same = task[1:] == task[:-1]
            shared = np.r_[same, False] | np.r_[False, same]
            if not shared.any():
                continue
            rows, task = rows.filter(pa.array(shared)), task[shared]
            node, label, size = (rows[c].to_numpy() for c in ("node", "label", "size"))
            bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
            starts = np.r_[0, np.flatnonzero(task[1:] != task[:-1]) + 1]
            length = np.diff(np.r_[starts, len(task)])
            short = np.repeat(length <= SHORT, length)
            last = np.repeat(starts + length, length)
            a, b = [], []
            at = np.flatnonzero(short)
            for step in range(1, int(length[length <= SHORT].max(initial=0))):
                at = at[at + step < last[at]]
                i = at[label[at] != label[at + step]]
                i = i[agreeing(bits, size, i, i + step, least)]
                a.append(i), b.append(i + step)
            for start, n in zip(starts[length > SHORT], length[length > SHORT]):
                x, y = connected(bits[start : start + n], size[start : start + n], label[start : start + n], least)
                a.append(np.array(x, np.int64) + start), b.append(np.array(y, np.int64) + start)
            u, v = stars(node[np.concatenate(a)], node[np.concatenate(b)])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.select("task", "node", "label", "size", "bits").repartition("task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def crossed(rows: DataFrame, key: str, most: int, many: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Tasks in which all of a key's rows with different labels meet: rows (key, node, label, weight, ...) with `task`, once for each.

    A label with more than `most` of weight has blocks of its own, the others
    share blocks; blocks meet in pairs, but for those of one label. Keys of one
    label have no task. Keys with over `many` blocks come second, as they are.
    """
    by_label = cut(rows.groupBy(key, "label").agg(F.sum("weight").alias("w")))
    by_key = by_label.groupBy(key).agg(F.sum(F.when(F.col("w") <= most, F.col("w"))).alias("pooled"), F.sum(F.when(F.col("w") > most, F.ceil(F.col("w") / most)).otherwise(0)).alias("own"), F.count("*").alias("labels"))
    by_key = by_key.where("labels > 1").select(key, F.coalesce(F.ceil(F.col("pooled") / most), F.lit(0)).cast("int").alias("shared"), "own")
    by_key = cut(by_key.withColumn("later", F.lit(False) if many is None else F.col("shared") + F.col("own") > many))
    large = by_label.where(F.col("w") > most).join(by_key, key).select(key, "label", F.ceil(F.col("w") / most).cast("int").alias("blocks"), "later")
    placed = rows.join(by_key, key).join(large.select(key, "label", "blocks"), [key, "label"], "left")
    alone = F.col("blocks").isNotNull()
    placed = placed.withColumn("side", F.when(alone, F.xxhash64("label")).otherwise(F.lit(0)))
    placed = placed.withColumn("part", F.when(alone, F.pmod(F.xxhash64("node", F.lit(7)), "blocks")).otherwise(F.pmod(F.xxhash64("label"), "shared")).cast("int"))
    later = placed.where("later").select(*rows.columns)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    blocks = large.where("not later").select(key, F.xxhash64("label").alias("side"), every(F.col("blocks")).alias("part")).unionByName(by_key.where("not later and shared > 0").select(key, F.lit(0).cast("long").alias("side"), every(F.col("shared")).alias("part")))
    x, y = (blocks.select(key, F.struct("side", "part").alias(n)) for n in ("x", "y"))
    pairs = x.join(y, key).where("x < y and x.side <> y.side or x.side = 0 and y.side = 0 and x <= y").withColumn("task", F.xxhash64(key, "x", "y"))
    ends = pairs.select(key, "x.*", "task").unionByName(pairs.where("x < y").select(key, "y.*", "task"))
    return placed.where("not later").join(ends, [key, "side", "part"]).select("task", *rows.columns), later


def collisions(posted: DataFrame, least: int, parted: bool = False) -> DataFrame:
    """Links (u, v) among the classes that the posting lists connect, from (list, node, label, size, bits)."""
    long = cut(posted.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > LONG_LIST))
    if long.isEmpty():
        return cut(merged(posted.withColumnRenamed("list", "task"), least))
    # dealt by another hash in each list, so that blocks of different lists connect each other
    block = F.pmod(F.xxhash64("node", "list"), F.ceil(F.coalesce("n", F.lit(1)) / LONG_LIST))
    links = cut(merged(posted.join(long, "list", "left").withColumn("task", F.xxhash64("list", block)), least))
    labels = cut(components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    rest = posted.join(long.select("list"), "list", "left_semi").join(labels, F.col("node") == F.col("id"), "left")
    rest = rest.select("list", "node", F.coalesce("component", "label").alias("label"), "size", "bits", F.lit(1).alias("weight"))
    across, later = crossed(rest, "list", LONG_LIST, None if parted else MANY_BLOCKS)
    links = links.unionByName(cut(merged(across, least)))
    if parted or (later := cut(later)).isEmpty():
        return links
    tries = tries_for(least, 2)
    value = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda k: F.struct(k, F.substring(F.col("bits"), COORDINATES - 1 - 2 * k, F.lit(2))))
    again = later.select("list", F.explode(value).alias("value"), "node", "label", "size", "bits").withColumn("list", F.xxhash64("list", "value")).drop("value")
    return links.unionByName(collisions(again, least, True))


def exact_links(node: np.ndarray, label: np.ndarray, bits: np.ndarray, sets: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """Links that connect what pairs as alike as asked connect, beyond what their labels say."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(node[0]), int(node[1]))] if 100 * common >= least * (size.sum() - common) and label[0] != label[1] else []
    root = np.unique(label, return_inverse=True)[1]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    shared = np.bincount(codes)[codes] > 1
    ends = np.cumsum(np.r_[0, np.add.reduceat(shared, np.cumsum(np.r_[0, size[:-1]]))])
    codes = codes[shared]
    most = np.diff(ends)  # a set has no more in common with any other of the task
    marked = np.zeros(codes.max(initial=-1) + 1, np.int64)
    matches = matches_for(least)
    out = []
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        j = j[root[j] != root[i]]
        if not len(j):
            continue
        j = j[np.minimum(most[i], most[j]) * (100 + least) >= least * (size[i] + size[j])]
        j = j[(bits[j] == bits[i]).sum(axis=1) >= matches]
        if not len(j):
            continue
        own = codes[ends[i] : ends[i + 1]]
        marked[own] = 1
        for k in range(0, len(j), STEP):
            part = j[k : k + STEP]
            part = part[root[part] != root[i]]
            if not len(part):
                continue
            common = np.add.reduceat(marked[np.concatenate([codes[ends[x] : ends[x + 1]] for x in part])], np.cumsum(np.r_[0, most[part[:-1]]]))
            for x in part[100 * common >= least * (size[i] + size[part] - common)]:
                if root[x] != root[i]:
                    out.append((int(node[i]), int(node[x])))
                    root[root == root[x]] = root[i]
        marked[own] = 0
    return out


def confirmed(dealt: DataFrame, least: int) -> DataFrame:
    """Links (a, b) of classes as alike as asked, from (task, node, label, key, bits, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = np.seterr(over="ignore")
        task, held, seen, out = None, [], set(), []

        def close() -> None:
            if len(held) > 1:
                node, label, bits, sets = zip(*held)
                out.extend(exact_links(np.array(node), np.array(label), np.frombuffer(b"".join(bits), np.uint8).reshape(-1, COORDINATES), list(sets), least))

        for batch in pieces(batches):
            sets = shingle_sets([(x or "").encode() for x in batch.column("text").to_pylist()])
            for now, node, label, key, bits, own in zip(*(batch.column(c).to_pylist() for c in ("task", "node", "label", "key", "bits")), sets):
                if now != task:
                    close()
                    task, held, seen = now, [], set()
                # a row that repeats an id may bring another text, or the same again
                if node not in seen and identity(own) == key:
                    seen.add(node)
                    held.append((node, label, bits, own))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        np.seterr(**old)

    return dealt.select("task", "node", "label", "key", "bits", "text").repartition("task").sortWithinPartitions("task", "node").mapInArrow(run, "a long, b long")


def class_links(classes: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Links (a, b) among the classes (node, key, id, size, bits, heads) that connect all that are as alike as asked."""
    posted = classes.select("node", F.col("node").alias("label"), "size", "bits", F.posexplode("heads").alias("c", "v"))
    posted = posted.select(F.expr("shiftleft(cast(c as bigint), 32) | v").alias("list"), "node", "label", "size", "bits")
    groups = components(collisions(posted, least).select(F.col("u").alias("a"), F.col("v").alias("b")))
    members = classes.join(groups.withColumnRenamed("id", "node"), "node").select(F.col("component").alias("group"), "node", F.col("node").alias("label"), "id", "key", F.col("size").alias("weight"), "bits")
    # texts are brought to their classes once, for both passes
    members = cut(members.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").drop("id"))
    large = cut(members.groupBy("group").agg(F.sum("weight").alias("w")).where(F.col("w") > LARGE_GROUP).select("group", F.ceil(F.col("w") / LARGE_GROUP).alias("blocks")))
    if large.isEmpty():
        return cut(confirmed(members.withColumn("task", F.xxhash64("group")), least))
    # two deals of a large group: the blocks of each connect those of the other
    deals = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    dealt = members.join(large, "group", "left").withColumn("deal", deals)
    links = cut(confirmed(dealt.withColumn("task", F.xxhash64("group", "deal", F.pmod(F.xxhash64("node", "deal"), F.coalesce("blocks", F.lit(1))))), least))
    labels = cut(components(links))
    rest = members.join(large.select("group"), "group", "left_semi").drop("label").join(labels.withColumnRenamed("id", "node"), "node", "left")
    across, _ = crossed(rest.withColumn("label", F.coalesce("component", "node")).drop("component"), "group", LARGE_GROUP)
    return links.unionByName(cut(confirmed(across, least)))


def near_rows(docs: DataFrame, least: int = LEAST, by_id: bool = True) -> DataFrame:
    """(doc_id, digest, n_shingles, component, component_id) for every row of docs (doc_id, text).

    digest is the text's md5, component a number that linked rows share, and
    component_id their smallest id. by_id: rows that repeat an id are one
    document. A row with a null id, or without words, has a null component but
    where its id has other texts. What is written on the way is deleted.
    """
    with scratch(docs.sparkSession):
        sketches = cut(sketched(docs, tries_for(least)))
        classes = sketches.where("doc_id is not null and key is not null").groupBy("key").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("size"), "bits", "heads")).alias("x"))
        classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "key", F.col("x.doc_id").alias("id"), "x.size", "x.bits", "x.heads"))
        links = class_links(classes, docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), least)
        rows = sketches.select("doc_id", "digest", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
        rows = rows.join(classes.select("key", "node"), "key", "left").drop("key")
        if by_id:
            # ids with several sets, or with a set and a text without words
            several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.max(F.col("node").isNull()).alias("empty"))
            several = cut(several.where("first <> last or first is not null and empty").select("doc_id", "first"))
            if not several.isEmpty():
                rows = rows.join(several, "doc_id", "left")
                links = links.unionByName(rows.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
                rows = rows.withColumn("node", F.coalesce("node", "first")).drop("first")
        labels = cut(components(links).withColumnRenamed("id", "node"))
        named = classes.select("node", "id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least_id = named.groupBy("component").agg(F.min("id").alias("component_id"))
        return cut(rows.join(named.join(least_id, "component").select("node", "component", "component_id"), "node", "left").drop("node"), keep=True)


def near_duplicates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Two documents are linked where at least `least` per cent of their shingles are common.
    Words are runs without ASCII white space, A-Z lower-cased; the set has the
    distinct runs of five words, or all words of a shorter text as one. A null
    text or one without words has an empty set and is linked with nothing. Rows
    that repeat an id count as one document, linked by each of its texts; each
    row is returned. A row with a null id is linked with nothing, has a null
    component, and is kept. No rows give no rows. Other columns are not read.
    """
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = near_rows(docs, least).select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_copies(docs: DataFrame, least: int) -> DataFrame:
    """docs (doc_id, text among its columns) with one row of each group of near copies: the one with the smallest id.

    Rows are told apart, not ids: of rows that repeat an id those stay whose
    texts are near copies of no other, and one of any group. Rows with a null
    id, or a text without words, stay.
    """
    spark, digest = docs.sparkSession, unused("digest", docs.columns)
    found = near_rows(docs, least, by_id=False)
    with scratch(spark):
        rows = cut(found.where(F.col("component").isNotNull()).groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n")))
        first = cut(rows.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("x")).select("component", "x.*"))
        key = ["component", "doc_id", "digest"]
        gone = cut(rows.join(first, key, "left_anti").select("doc_id", F.col("digest").alias(digest)), keep=True)
        again = cut(rows.join(first, key, "left_semi").where("n > 1").select("doc_id", F.col("digest").alias(digest)), keep=True)
    left = docs.withColumn(digest, F.md5("text")).join(gone, ["doc_id", digest], "left_anti")
    if not again.isEmpty():
        # the same text more than once under an id
        one = left.join(again, ["doc_id", digest], "left_semi").groupBy("doc_id", digest).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
        left = left.join(again, ["doc_id", digest], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(one.select("row.*"))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), LEAST)
