"""Fill-in-middle transformation with a succinct index of token ends.

A text's tokens are an optional run of white space with the word behind it, and
white space at the end. The last byte of each token is a one in a bit vector
over the bytes of a batch of texts. The vector is packed, with a directory of the ones before every
block: its total gives the number of tokens, rank at the texts' ends gives each
text's own, and select on two ranks gives the byte cuts of prefix and middle.

Plan: one narrow map over the documents, no shuffle. The draws are hashes of
ids, computed on the JVM, so a task that runs again gives the same rows; the
output is put back together by string functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.llm.common import pieces, table

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of the packed vector in a block of the directory.
BLOCK = 64
ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class BitVector:
    """A packed bit vector with rank and select over arrays of positions."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.size = len(bits)
        self.packed = np.r_[packed, np.zeros(-len(packed) % BLOCK, np.uint8)]
        blocks = ONES[self.packed].reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        #: Ones before each block, and in all.
        self.before = np.r_[0, np.cumsum(blocks)]

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = np.asarray(at, np.int64)
        block, byte = at // (8 * BLOCK), at // 8
        # bytes of the position's block, those before it whole, its own masked
        inside = np.minimum(block[:, None] * BLOCK + np.arange(BLOCK), max(len(self.packed) - 1, 0))
        if not len(self.packed):
            return np.zeros(len(at), np.int64)
        values = self.packed[inside]
        part = np.arange(BLOCK) == (byte - block * BLOCK)[:, None]
        mask = np.where(part, ((1 << (at % 8)) - 1)[:, None], np.where(np.arange(BLOCK) < (byte - block * BLOCK)[:, None], 255, 0))
        held = ONES[values & mask.astype(np.uint8)].sum(axis=1, dtype=np.int64)
        last = block >= len(self.before) - 1
        return np.where(last, self.before[-1], self.before[np.minimum(block, len(self.before) - 1)] + held)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one, k from 1 to the total."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, side="left") - 1
        left = k - self.before[block]
        values = self.packed[block[:, None] * BLOCK + np.arange(BLOCK)]
        sums = np.cumsum(ONES[values], axis=1, dtype=np.int64)
        byte = (sums < left[:, None]).sum(axis=1)
        at = np.arange(len(k))
        left = left - np.where(byte > 0, sums[at, byte - 1], 0)
        bits = np.unpackbits(values[at, byte][:, None], axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1) < left[:, None]).sum(axis=1)
        return (block * BLOCK + byte) * 8 + bit


def token_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A bit for each byte: the last one of a token of its text. ends: where the texts end, empty ones included."""
    space = SPACE[data]
    bits = ~space
    bits[:-1] &= space[1:]
    last = ends[np.diff(np.r_[0, ends]) > 0] - 1
    bits[last] = True
    return bits


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from an id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


ADDED = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


def arranged(data: bytes, start: int, a: int, b: int, end: int, form: str) -> bytes:
    """One text's output, from its byte cuts a and b."""
    p, s, m = (x.encode() for x in SENTINELS)
    prefix, middle, suffix = data[start:a], data[a:b], data[b:end]
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def transformed(texts: pa.Array, h: list[np.ndarray], percent: int, spm_percent: int) -> list[pa.Array]:
    """The columns of ADDED for a batch of texts and their draws."""
    raw = [(x or "").encode() for x in texts.to_pylist()]
    data = b"".join(raw)
    whole = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    starts = ends - [len(x) for x in raw]
    index = BitVector(token_ends(whole, ends))
    # every text begins with the first bit after the last one's end
    first = index.rank(starts)
    n = np.diff(np.r_[first, index.total])
    low, high = (f(h[0] % (n + 1), h[1] % (n + 1)) for f in (np.minimum, np.maximum))
    plain = np.array([not x or any(s.encode() in x for s in SENTINELS) for x in raw], bool) | (h[2] % 100 >= percent)
    forms = np.where(plain, "plain", np.where(h[3] % 100 < spm_percent, "spm", "psm"))
    cuts = []
    for rank in (low, high):
        cut = starts.copy()
        some = np.flatnonzero(rank > 0)
        cut[some] = index.select(first[some] + rank[some]) + 1
        cuts.append(cut)
    # code points: bytes that do not go on with one
    heads = np.r_[0, np.cumsum((whole & 0xC0) != 0x80, dtype=np.int64)]
    a, b = cuts
    outputs = [x.decode() if f == "plain" else arranged(data, *at, f).decode() for x, f, *at in zip(raw, forms, starts.tolist(), a.tolist(), b.tolist(), ends.tolist())]
    chars = [pa.array(x, pa.int64(), mask=plain) for x in (heads[a] - heads[starts], heads[b] - heads[a])]
    return [pa.array(n, pa.int64()), pa.array(forms.tolist(), pa.string()), *chars, pa.array(outputs, pa.string())]


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """docs (doc_id, text among its columns) with n, form, prefix_chars, middle_chars and output.

    percent of the texts are rearranged, spm_percent of those with the suffix
    first. A null or empty text has no tokens, an empty output and the plain
    form, as has a text with one of the sentinels (its own text). Rows that
    repeat an id are cut alike where their texts are; a null id draws as one
    without digits. Columns of docs that share an added name are replaced. No
    rows give no rows. Memory is in proportion to a batch of about half a
    million bytes, or one longer text.
    """
    added = {f.name for f in ADDED}
    kept = docs.drop(*[c for c in docs.columns if c.lower() in added])
    names = [f"_draw_{i}" for i in range(4)]
    boxed = kept.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text"), *(x.alias(c) for x, c in zip(draws(F.col("doc_id"), seed), names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *transformed(batch.column("text"), h, percent, spm_percent)], ["row", *ADDED.names])

    done = boxed.mapInArrow(run, T.StructType([boxed.schema["row"], *ADDED.fields]))
    return done.select(*(F.col("row").getField(c).alias(c) for c in kept.columns), *ADDED.names)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Its parts hold no sentinel, so the first of each kind is the one put in."""
    p, s, m = (len(x) for x in SENTINELS)

    def between(a: Column, b: Column) -> Column:
        return F.substring(output, a, b - a)

    def rest(a: Column) -> Column:
        return F.substring(output, a, F.length(output))

    second = {"psm": F.instr(output, F.lit(SENTINELS[1])), "spm": F.instr(output, F.lit(SENTINELS[0]))}
    third = F.instr(output, F.lit(SENTINELS[2]))
    psm = F.concat(between(F.lit(p + 1), second["psm"]), rest(third + m), between(second["psm"] + s, third))
    spm = F.concat(between(second["spm"] + p, third), rest(third + m), between(F.lit(s + 1), second["spm"]))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents
), r AS (
  SELECT *, len(tokens) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM r
), p AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
