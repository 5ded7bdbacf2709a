"""Ranked lexical search with block-max pruning.

The index has one row for each range of documents that follow each other: its
terms in order, for each term a list of (document, occurrences), and a table
with the highest impact that each term has in the range. A query's bound for a
block is the sum of its terms' maxima there. A first round scores each
query's blocks of highest bound, and the k-th score found is its threshold.
Then every task takes its blocks in order of bound, scores them from their own
lists, raises the threshold and leaves a query where its bound has dropped
below it. Bounds and scores are whole numbers, so what is left out is below
the k-th score for certain; ties are scored.

Plan: blocks are made by a narrow map and written once; document frequencies
are one aggregate over the query's terms. Queries go in batches of a bounded number of terms, and one batch's
terms, thresholds and first blocks are what is broadcast. Each task sends on at
most k rows a query, and a windowed rank merges them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import cut, pieces, scratch, table

#: Documents of a range at most; its texts have half a million bytes at most, as far as one document has no more.
BLOCK_DOCS = 256
#: Blocks of a written file; a block's lists are up to about a megabyte.
FILE_BLOCKS = 16
#: Blocks that each query scores for its first threshold.
FIRST_BLOCKS = 2
#: Blocks that a task puts in order of their bounds at once.
TOGETHER = 16
#: Terms of the queries that are searched for together; one longer query stands alone.
BATCH_TERMS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What terms are made of, byte by byte, and what A-Z become.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IN_TERM = np.array([x >= 0x80 or chr(x).isalnum() for x in range(256)])
LOWERED = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)
BLOCKS = "block long, doc_id array<long>, n array<long>, term array<string>, df array<int>, doc array<smallint>, tf array<int>"


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order, lower-cased, and the text of each."""
    raw = [(x or "").encode() for x in texts.to_pylist()]
    data = np.frombuffer(b"".join(raw), np.uint8)
    lengths = np.array([len(x) for x in raw], np.int64)
    begins = np.cumsum(lengths) - lengths
    kept = IN_TERM[data]
    start = kept.copy()
    start[1:] &= ~kept[:-1]
    at = begins[lengths > 0]
    start[at] = kept[at]  # a term ends with its text
    starts = np.flatnonzero(start)
    rank = np.r_[0, np.cumsum(kept)]
    offsets = np.r_[rank[starts], rank[-1]].astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(LOWERED[data[kept]]))])
    return terms, np.searchsorted(np.cumsum(lengths), starts, side="right")


def range_of(doc_id: pa.Array, texts: pa.Array) -> list[pa.Array] | None:
    """The columns of BLOCKS after the first, for a document range; None without terms."""
    terms, owner = tokens_of(texts)
    if not len(terms):
        return None
    n = np.bincount(owner, minlength=len(texts))
    with_terms = np.flatnonzero(n)
    place = np.cumsum(n > 0) - 1
    coded = terms.dictionary_encode()
    # one entry a term and document, in order of both
    entries, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(texts) + owner, return_counts=True)
    term, doc = entries // len(texts), place[entries % len(texts)]
    lists = [(doc_id.take(pa.array(with_terms)), pa.int64()), (n[with_terms], pa.int64()), (coded.dictionary.cast(pa.string()), pa.string()), (np.bincount(term), pa.int32()), (doc, pa.int16()), (tf, pa.int32())]
    return [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind)) for x, kind in lists]


@dataclass
class Index:
    """blocks: the written document ranges; n_docs with a term, n_terms with repeats; maxima: (block, term, most)."""

    blocks: DataFrame
    maxima: DataFrame
    n_docs: int
    n_terms: int


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a document's score for each unit of its weight."""
    m = 75 + (25 * n * n_docs) // max(n_terms, 1)
    return ((1_000_000_000 * tf) // (1_000 * tf + 12 * m)).astype(np.int32)  # below 10**6


def impacts_of(block: dict, n_docs: int, n_terms: int) -> np.ndarray:
    return impact(block["tf"].astype(np.int64), block["n"][block["doc"]], n_docs, n_terms)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Blocks of a batch, lists of numbers as arrays."""
    lists = {c: batch.column(c) for c in batch.schema.names if c != "block"}
    for i, block in enumerate(batch.column("block").to_pylist()):
        out = {"block": block}
        for c, x in lists.items():
            values = x[i].values
            out[c] = values if c in ("term", "doc_id") else values.to_numpy(zero_copy_only=False)
        yield out


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> Index:
    """The index of docs (doc_id long, text). Every row is a document, rows that share an id too; texts without terms are left out.

    No rows, or none with terms, give an index without blocks. A document of any
    length is one entry; memory is in proportion to a range, or one longer text.
    """
    block_docs = min(block_docs, 32_767)  # places are of 16 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for at in range(0, batch.num_rows, block_docs):
                part = batch.slice(at, block_docs)
                if columns := range_of(part.column("doc_id"), part.column("text")):
                    yield pa.RecordBatch.from_arrays([part.column("place").slice(0, 1), *columns], ["block", "doc_id", "n", "term", "df", "doc", "tf"])

    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = cut(rows.mapInArrow(run, BLOCKS), file_rows=FILE_BLOCKS)
    total = lambda c: F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), c)), F.lit(0))
    n_docs, n_terms = blocks.agg(total(lambda a, x: a + F.lit(1)), total(lambda a, x: a + x)).first()

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in rows_of(batch):
                starts = np.r_[0, np.cumsum(block["df"])[:-1]]
                most = np.maximum.reduceat(impacts_of(block, n_docs, n_terms), starts)
                yield pa.RecordBatch.from_arrays([pa.array([block["block"]], pa.int64()), pa.array([block["term"]], pa.list_(pa.string())), pa.array([most], pa.list_(pa.int32()))], ["block", "term", "most"])

    maxima = cut(blocks.select("block", "n", "term", "df", "doc", "tf").mapInArrow(highest, "block long, term array<string>, most array<int>"), file_rows=FILE_BLOCKS)
    return Index(blocks, maxima, n_docs, n_terms)


@dataclass
class Queries:
    """A batch of queries: for each the terms it has, by number, and times * weight of each."""

    terms: pa.Array
    ids: np.ndarray
    starts: np.ndarray
    term: np.ndarray
    gain: np.ndarray

    def most_in(self, numbers: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Each query's bound for a block that has these terms, with these maxima."""
        held = np.zeros(len(self.terms), np.int64)
        held[numbers] = most
        return np.add.reduceat(self.gain * held[self.term], self.starts)

    def asked(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[q], self.starts[q + 1] if q + 1 < len(self.starts) else None)
        return self.term[at], self.gain[at]


def known(queries: Queries, term: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places in a block's terms, and the numbers, of those that some query has."""
    numbers = pc.index_in(term, value_set=queries.terms)
    places = np.flatnonzero(numbers.is_valid().to_numpy(zero_copy_only=False))
    return places, numbers.take(pa.array(places)).to_numpy().astype(np.int64)


class Scored:
    """A block ready for queries: impacts by term number, its documents in order of their ids."""

    def __init__(self, block: dict, queries: Queries, index: tuple[int, int]):
        self.block = block["block"]
        self.doc_id = block["doc_id"].to_pylist()
        places, self.numbers = known(queries, block["term"])
        starts = np.r_[0, np.cumsum(block["df"])]
        impacts = impacts_of(block, *index)
        # copies, so that the batch with all other terms can go
        own = lambda i: slice(starts[i], starts[i + 1])
        self.lists = {k: (block["doc"][own(i)].copy(), impacts[own(i)].copy()) for i, k in zip(places.tolist(), self.numbers.tolist())}
        most = np.array([int(self.lists[k][1].max()) for k in self.numbers.tolist()], np.int64)
        self.bounds = queries.most_in(self.numbers, most)

    def score(self, queries: Queries, q: int) -> np.ndarray:
        out = np.zeros(len(self.doc_id), np.int64)
        for term, gain in zip(*queries.asked(q)):
            if (held := self.lists.get(int(term))) is not None:
                out[held[0]] += gain * held[1]
        return out


class Best:
    """The k best (score, document) of each query; a document without an id comes after those with one."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.heaps: dict[int, list] = {}

    def add(self, q: int, scores: np.ndarray, doc_id: list) -> None:
        heap = self.heaps.setdefault(q, [])
        for i in np.flatnonzero(scores >= max(self.least[q], 1)).tolist():
            # the worst of the heap is its smallest: low score, then high id
            entry = (int(scores[i]), doc_id[i] is not None, -(doc_id[i] or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[q] = max(self.least[q], heap[0][0])

    def rows(self) -> list[tuple[int, int | None, int]]:
        return [(q, -minus if has else None, score) for q, heap in self.heaps.items() for score, has, minus in heap]


def search_blocks(blocks: list[Scored], queries: Queries, best: Best, wanted: set[tuple[int, int]] | None) -> None:
    """Blocks in order of each query's bound, until that is below what the query needs."""
    bounds = np.stack([b.bounds for b in blocks], axis=1)
    for q in range(len(queries.ids)):
        for i in np.argsort(-bounds[q], kind="stable").tolist():
            if bounds[q, i] < max(best.least[q], 1):
                break
            if wanted is None or (blocks[i].block, q) in wanted:
                best.add(q, blocks[i].score(queries, q), blocks[i].doc_id)


def found_in(index: Index, blocks: DataFrame, queries: Queries, k: int, least: np.ndarray, wanted: set[tuple[int, int]] | None) -> DataFrame:
    """(query, doc_id, score): each task's k best of each query."""
    spark, stats = index.blocks.sparkSession, (index.n_docs, index.n_terms)
    shared = spark.sparkContext.broadcast((queries, least, wanted))  # bounded by BATCH_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start, pairs = shared.value
        best, held = Best(k, start), []
        for batch in batches:
            for block in rows_of(batch):
                held.append(Scored(block, own, stats))
                if len(held) >= TOGETHER:
                    search_blocks(held, own, best, pairs)
                    held = []
                    pa.default_memory_pool().release_unused()
        if held:
            search_blocks(held, own, best, pairs)
        q, d, s = zip(*best.rows()) if best.heaps and best.rows() else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(own.ids[list(q)] if q else [], pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["query", "doc_id", "score"])

    return blocks.mapInArrow(run, "query long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_blocks(index: Index, queries: Queries) -> list[tuple[int, int]]:
    """(block, query) of the blocks with each query's highest bounds, from the maxima alone."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        heaps: list[list] = [[] for _ in own.ids]
        for batch in batches:
            for block in rows_of(batch):
                places, numbers = known(own, block["term"])
                for q, bound in enumerate(own.most_in(numbers, block["most"][places]).tolist()):
                    if bound:
                        (heapq.heappush if len(heaps[q]) < FIRST_BLOCKS else heapq.heappushpop)(heaps[q], (bound, -block["block"]))
        rows = [(q, bound, -minus) for q, heap in enumerate(heaps) for bound, minus in heap]
        q, bound, block = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, bound, block)], ["query", "bound", "block"])

    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    top = index.maxima.mapInArrow(run, "query long, bound long, block long").withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST_BLOCKS)
    return [(r["block"], r["query"]) for r in top.select("block", "query").collect()]  # FIRST_BLOCKS a query of the batch


def batch_of(rows: list) -> Queries:
    """rows: (query, term, times, w), the terms of whole queries."""
    rows = sorted(rows, key=lambda r: (r["query"], r["term"]))
    names = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    ids, starts = np.unique([r["query"] for r in rows], return_index=True)
    return Queries(pa.array(list(names), pa.string()), ids, starts, np.array([names[r["term"]] for r in rows], np.int64), np.array([r["times"] * r["w"] for r in rows], np.int64))


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * df + 1).cast("double"))).cast("long")


def search(index: Index, items: DataFrame, k: int) -> DataFrame:
    """Each item's k best documents: its columns, and rank (from 1), doc_id, score.

    items: text among its columns; every row is a query, rows that are alike too.
    An item without terms, or of terms that no document has, gives no rows, as
    does an index without blocks. Scores above 0 only; equal scores by ascending
    doc_id, a null one last. Columns rank, doc_id and score of items are replaced.
    """
    spark = items.sparkSession
    kept = [c for c in items.columns if c.lower() not in ("rank", "doc_id", "score")]
    # a query's number is in the written table, so every later job sees the same
    queries = cut(items.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), "text").select(F.monotonically_increasing_id().alias("query"), "row", "text"))
    lowered = F.translate("text", UPPER, LOWER)
    words = F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))
    terms = cut(queries.select("query", F.explode(words).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times")))
    batches = max(1, math.ceil(terms.count() / BATCH_TERMS))
    out = None
    for b in range(batches):
        own = terms.where(F.pmod(F.xxhash64("query"), F.lit(batches)) == b)
        # a block counts a term's documents, so a frequency is one sum over blocks
        held = index.blocks.select(F.explode(F.arrays_zip("term", "df")).alias("t")).select("t.term", "t.df").join(F.broadcast(own.select("term").distinct()), "term")
        df = held.groupBy("term").agg(F.sum("df").alias("df"))
        rows = own.join(df, "term").withColumn("w", weight(index.n_docs, F.col("df"))).collect()  # about BATCH_TERMS
        if not rows:
            continue
        batch = batch_of(rows)
        least = np.zeros(len(batch.ids), np.int64)
        pairs = set(first_blocks(index, batch))
        start = index.blocks.where(F.col("block").isin(sorted({block for block, _ in pairs})))
        kth = ranked(found_in(index, start, batch, k, least, pairs), k).where(F.col("rank") == k).collect()  # one a query
        least[np.searchsorted(batch.ids, [r["query"] for r in kth])] = [r["score"] for r in kth]
        best = ranked(found_in(index, index.blocks, batch, k, least, None), k)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return queries.where("false").select(*(F.col("row").getField(c).alias(c) for c in kept), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return out.join(queries.select("query", "row"), "query").select(*(F.col("row").getField(c).alias(c) for c in kept), "rank", "doc_id", "score")


def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        index = build_index(table(spark, sf_dir, "documents"))
        best = search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"), 20)
        return cut(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), keep=True)


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sized AS (
  SELECT d, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized
), item AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), asked AS (
  SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM item) GROUP BY ALL
), postings AS (
  SELECT d, doc_id, n, term, count(*) AS tf
  FROM (SELECT d, doc_id, n, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked)
  GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM totals) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM postings GROUP BY term
), scored AS (
  SELECT q, item_id, doc_id, d,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rn FROM scored WHERE score > 0
)
SELECT item_id, CAST(rn AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rn <= 20
"""
