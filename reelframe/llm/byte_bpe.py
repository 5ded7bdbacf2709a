"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token
that is itself a token. Tier two, for the rest: a heap of mergeable pairs over
a doubly linked list of the pre-token's bytes, lowest rank first, leftmost among
equals. Decoding gathers the tokens' bytes with one numpy take per batch.

Both are narrow maps over the documents: no shuffle, and every task works
through its rows in pieces of bounded size.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.llm.common import pieces, table

#: Pre-tokens in each of the two generations that a worker remembers, and the longest that it remembers.
CACHED = 150_000
CACHED_CHARS = 48
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id; ids without a token are empty."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class MinimalPerfectHash:
    """Each of n distinct keys gets a slot of its own in 0..n-1 (hash and displace).

    Keys fall into buckets; large buckets first look for a displacement that
    sends their keys to free slots, single keys take a free slot by its number.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 2)
        held: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            held[h % self.buckets].append(i)
        self.displacement = [0] * self.buckets
        self.owner = [-1] * self.n
        order = sorted(range(self.buckets), key=lambda b: -len(held[b]))
        free = None
        for b in order:
            members = held[b]
            if not members:
                break
            if len(members) == 1:
                free = free or iter([s for s, o in enumerate(self.owner) if o < 0])
                slot = next(free)
                self.displacement[b] = -slot - 1
                self.owner[slot] = members[0]
                continue
            d = 1
            while True:
                slots = [self._place(hashes[i], d) for i in members]
                if len({*slots}) == len(slots) and all(self.owner[s] < 0 for s in slots):
                    break
                d += 1
            self.displacement[b] = d
            for s, i in zip(slots, members):
                self.owner[s] = i

    def _place(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15 & _MASK)) * 0xFF51AFD7ED558CCD & _MASK
        return (x ^ x >> 33) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.buckets]
        return -d - 1 if d < 0 else self._place(h, d)


class Tokenizer:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.known = [(i, t) for i, t in enumerate(tokens) if t]
        self.hash = MinimalPerfectHash([t for _, t in self.known])
        self.by_slot = [self.known[o] for o in self.hash.owner]
        self.pattern = pattern

    def start(self) -> Tokenizer:
        """In a task: compile the pattern, and begin with an empty memory."""
        self.find = regex.compile(self.pattern).findall
        self.rank = {t: i for i, t in self.known}.get
        self.memory = _Memory(self)
        return self

    def lookup(self, piece: bytes) -> int:
        """The id of a token, or -1."""
        i, token = self.by_slot[self.hash.slot(piece)]
        return i if token == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no token itself."""
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, heap = self.rank, []
        for i in range(n - 1):
            if (rank := rank_of(piece[i : i + 2])) is not None:
                heap.append((rank, i, i + 2))
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            j = after[i]
            if j < 0 or j >= n or after[j] != end:
                continue
            after[i], after[j] = end, -1
            if end < n:
                before[end] = i
                if (rank := rank_of(piece[i : after[end]])) is not None:
                    heappush(heap, (rank, i, after[end]))
            if (p := before[i]) >= 0 and (rank := rank_of(piece[p:end])) is not None:
                heappush(heap, (rank, p, end))
        ids, i = [], 0
        while i < n:
            ids.append(rank_of(piece[i : after[i]]))
            i = after[i]
        return ids

    def piece_ids(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.lookup(raw)
        return array("i", [whole] if whole >= 0 else self.merge(raw)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        memory = self.memory
        if len(memory) > CACHED:
            memory.age()
        return np.frombuffer(b"".join([memory[x] for x in self.find(text)]), np.int32)


class _Memory(dict):
    """Ids of pre-tokens met lately; what is asked for again passes from the older generation to the younger."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.older = tokenizer, {}

    def age(self) -> None:
        self.older = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.tokenizer.piece_ids(piece)
        if len(piece) <= CACHED_CHARS:
            self[piece] = ids
        return ids


def encode(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>) after the others.

    Each match of the pattern is encoded separately, without special tokens. A
    null text counts as empty and has no ids. A column that is already named
    `ids` is replaced. Repeated rows are encoded alike; no rows give no rows. A
    text of any length is encoded whole, in memory in proportion to it.
    """
    kept = docs.drop(ids)
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(read_ranks(ranks), pattern))  # fixed size: the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value.start()
        for batch in pieces(batches, text):
            found = [tokenizer.encode(x or "") for x in batch.column(text).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


class Decoder:
    """The bytes of ids, from the tokens of a rank file."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(x) for x in tokens])
        self.start, self.joined = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        first = np.cumsum(n) - n
        return self.joined[np.arange(n.sum()) + np.repeat(self.start[ids] - first, n)].tobytes()


def decode(docs: DataFrame, ranks: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with a column of the bytes that the ids stand for; null ids give no bytes.

    A column of that name is replaced. Repeated rows are decoded alike; no rows give no rows.
    """
    kept = docs.drop(decoded)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [decoder.decode(row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int32)) for row in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, decoded])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(decoded, T.BinaryType())]))


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with `text` replaced by `ids` and the bytes `decoded` from them, in one pass over the texts.

    As encode() and decode() one after the other, but with one Python process a
    task, and without texts that travel back. Columns of those names are replaced.
    Nulls, repeated rows, no rows and very long texts are as in encode().
    """
    kept = docs.drop("ids", "decoded")
    rest = [f for f in kept.schema.fields if f.name != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(read_ranks(ranks), pattern))  # fixed size: the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value.start()
        decoder = Decoder(tokenizer.tokens)
        for batch in pieces(batches):
            found = [tokenizer.encode(x or "") for x in batch.column("text").to_pylist()]
            offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            out = pa.array([decoder.decode(x) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), column, out], [*(f.name for f in rest), "ids", "decoded"])

    return kept.mapInArrow(run, T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_and_decode(docs, ranks)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
