"""Exact top-k search by segment statistics, coarse to fine.

For a segment of L components with means m, m' and deviations s, s', the squared
distance of two vectors is at least L * ((m - m')^2 + (s - s')^2). Summed over
the segments this bounds the distance d^2 from below, and with
score = (|q|^2 + |x|^2 - d^2) / 2 the inner product from above. Few long
segments are tried first, then more short ones; only pairs that no bound
excludes get their exact integer score.

Plan: candidates are hashed into blocks, queries into blocks, and one cogroup
per (query block, candidate block) searches with bounded memory. Each block
sends on k rows per query, and a windowed rank merges them. The few vectors of
huge norm are scored beside that in Python's integers.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import parallelism, table

#: Segments of each level, as far as they are fewer than components by four times.
LEVELS = (4, 16, 64)
QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 65_536
#: Candidates and queries that are compared at once within a block.
STEP = 4_096
QUERY_STEP = 256
#: With squared norms below this, every score fits a long.
NORM_LIMIT = 2.0**62


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of the vectors: sqrt(L) * (mean, deviation) of each segment."""
    parts = []
    for a, b in zip(*[iter_bounds(vectors.shape[1], segments)[i:] for i in (0, 1)]):
        part = vectors[:, a:b].astype(np.float64)
        mean = part.mean(axis=1)
        deviation = np.sqrt(np.maximum((part * part).mean(axis=1) - mean * mean, 0))
        parts += [mean * math.sqrt(b - a), deviation * math.sqrt(b - a)]
    return np.stack(parts, axis=1).astype(np.float32)


def levels_of(width: int) -> list[int]:
    """The levels that cost less than scores: two numbers a segment, on at most half as many as there are components."""
    return [n for n in LEVELS if 4 * n <= width] or [1]


def iter_bounds(width: int, segments: int) -> list[int]:
    return [width * i // segments for i in range(segments + 1)]


def best_of(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -score, owner))
    sorted_owner = owner[order]
    start = np.r_[0, np.flatnonzero(sorted_owner[1:] != sorted_owner[:-1]) + 1] if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[rank < k]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best among these vectors, its own row left out."""
    levels = levels_of(vectors.shape[1])
    fine = [statistics(vectors, n) for n in levels]
    double = vectors.astype(np.float64)
    norm = math.sqrt(float((double**2).sum(axis=1).max(initial=0)))
    out = []
    for q0 in range(0, len(query_ids), QUERY_STEP):
        own_ids, own = query_ids[q0 : q0 + QUERY_STEP], queries[q0 : q0 + QUERY_STEP]
        own_fine, own_double = [statistics(own, n) for n in levels], own.astype(np.float64)
        # every partial sum of a score is a whole number below this
        exact_doubles = norm * math.sqrt(float((own_double**2).sum(axis=1).max(initial=0))) < 2.0**52
        # the bounds are computed in single precision
        slack = 1e-3 + 1e-5 * norm * np.sqrt((own.astype(np.float64) ** 2).sum(axis=1))[:, None]
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        least = np.full((len(own), 1), -np.inf)
        for c0 in range(0, len(ids), STEP):
            cols = np.arange(c0, min(c0 + STEP, len(ids)))
            alive = own_ids[:, None] != ids[cols][None, :]
            for level, (mine, theirs) in enumerate(zip(own_fine, fine)):
                bound = mine @ theirs[cols].T
                if level == 0 and c0 == 0 and len(cols) > 4 * k:
                    # the most promising candidates give a first threshold
                    first = np.argpartition(-np.where(alive, bound, -np.inf), 2 * k, axis=1)[:, : 2 * k]
                    score = np.einsum("qd,qcd->qc", own_double, double[cols[first]])
                    score = np.where(np.take_along_axis(alive, first, axis=1), score, -np.inf)
                    least = np.maximum(least, np.sort(score, axis=1)[:, -k][:, None])
                alive &= bound >= least - slack
                some = alive.any(axis=0)
                cols, alive = cols[some], alive[:, some]
            # where bounds exclude little, all of the block's scores in one product cost less than the pairs; both are exact
            dense = exact_doubles and 8 * int(alive.sum()) > alive.size
            scores = own_double @ double[cols].T if dense else None
            if dense and len(cols) >= k:
                # each query's k-th score here; below its least bound nothing is kept
                least = np.maximum(least, np.partition(np.where(alive, scores, -np.inf), -k, axis=1)[:, -k][:, None])
            qi, ci = np.nonzero(alive & (scores >= least)) if dense else np.nonzero(alive)
            for p in range(0, len(qi), 1 << 18):
                a, b = qi[p : p + (1 << 18)], cols[ci[p : p + (1 << 18)]]
                score = scores[a, ci[p : p + (1 << 18)]].astype(np.int64) if dense else np.einsum("nd,nd->n", own[a], vectors[b])
                near = score >= least[a, 0]
                kept = tuple(np.concatenate(x) for x in zip(kept, (a[near], ids[b[near]], score[near])))
                keep = best_of(kept[0], kept[2], kept[1], k)
                kept = tuple(x[keep] for x in kept)
                full = np.bincount(kept[0], minlength=len(own)) >= k
                low = np.full(len(own), np.inf)
                np.minimum.at(low, kept[0], kept[2].astype(np.float64))
                least = np.maximum(least, np.where(full, low, -np.inf)[:, None])
        out.append((own_ids[kept[0]], kept[1], kept[2]))
    return tuple(np.concatenate(x) for x in zip(*out))


def huge_pairs(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, int | None]]:
    """(query, candidate, score) of each query's k best among these vectors in Python's integers; None for a score below a long."""
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object)
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    own = whole(queries)
    for c0 in range(0, len(ids), STEP):
        theirs, names = whole(vectors[c0 : c0 + STEP]), ids[c0 : c0 + STEP].tolist()
        for i, q in enumerate(query_ids.tolist()):
            found = [(-s, c) for s, c in zip(theirs @ own[i], names) if c != q]
            best[i] = heapq.nsmallest(k, best[i] + found)
    out = []
    for q, rows in zip(query_ids.tolist(), best):
        for s, c in rows:
            if -s >= 2**63:
                raise OverflowError(f"the score of vectors {q} and {c} does not fit a long")
            out.append((q, c, -s if -s >= -(2**63) else None))
    return out


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each query's k highest integer inner products, ties to the smaller vec_id.

    vectors, queries: (vec_id long, vector array<double> of whole numbers). Rows
    with a null id or vector, and vectors of no component, take no part. Rows that
    share an id are all candidates of other ids' queries; the queries of one id
    have their k best together. Only vectors of the same length are compared. A
    score among the k best that does not fit a long is an error. No vectors or no
    queries give no rows. Returns (query_id, rank, vec_id, score).
    """

    def clean(df: DataFrame) -> DataFrame:
        squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
        valid = df.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0)).withColumn("vector", F.col("vector").cast("array<double>"))
        # equal rows go to several blocks
        return valid.select("vec_id", "vector", F.size("vector").alias("width"), (squares >= NORM_LIMIT).alias("huge"), F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("deal"))

    spark = vectors.sparkSession
    vectors, queries = clean(vectors), clean(queries)
    n, m = vectors.count(), queries.count()
    blocks = max(1, math.ceil(n / CANDIDATE_BLOCK), min(parallelism(spark), math.ceil(n / 2_048)))
    query_blocks = max(1, math.ceil(m / QUERY_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("width", "vec_id", "vector", "huge", F.pmod("deal", F.lit(query_blocks)).cast("int").alias("qb"), every(blocks).alias("cb"))
    right = vectors.select("width", "vec_id", "vector", "huge", F.pmod("deal", F.lit(blocks)).cast("int").alias("cb"), every(query_blocks).alias("qb"))

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        mine_huge, theirs_huge = mine["huge"].to_numpy(bool), theirs["huge"].to_numpy(bool)
        if not mine_huge.all() and not theirs_huge.all():
            (q_ids, q), (ids, v) = ((x["vec_id"].to_numpy(), np.stack(x["vector"]).astype(np.int64)) for x in (mine[~mine_huge], theirs[~theirs_huge]))
            out += zip(*(x.tolist() for x in search_block(q_ids, q, ids, v, k)))
        for a, b in ((mine[~mine_huge], theirs[theirs_huge]), (mine[mine_huge], theirs)):
            if len(a) and len(b):
                out += huge_pairs(a["vec_id"].to_numpy(), np.stack(a["vector"]), b["vec_id"].to_numpy(), np.stack(b["vector"]), k)
        q, c, s = zip(*out) if out else ((), (), ())
        return pd.DataFrame({"query_id": np.array(q, np.int64), "vec_id": np.array(c, np.int64), "score": pd.array(s, "Int64")})

    found = left.groupBy("width", "qb", "cb").cogroup(right.groupBy("width", "qb", "cb")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.coalesce("score", F.raise_error(F.lit("a score does not fit a long")).cast("long")).alias("score"))


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, vector): every component as floor(scale * x).

    Vectors null or with null or non-finite components go, and those with a component that scaling takes beyond the doubles.
    """
    # floor() of a double is a long; from 2**53 on a double is whole
    whole = lambda y: F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(F.lit(scale) * v.cast("double")) < F.lit(float("inf"))))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda v: whole(F.lit(scale) * v.cast("double"))).alias("vector"))


def op1_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(64 * CAST(x AS DOUBLE)))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM pairs
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rn <= 20
"""
