"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, a sample of all documents is
unlabelled. With the class prior pi, the share of toxic rows among the labels,
the risk of a classifier is

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)),

so unlabelled toxic text does not teach that it is clean, and the second term,
which estimates the risk on clean text, cannot be driven below zero. The
classifier is linear over a document's words, the beginnings of its words, and
the beginnings that several of its words share.
A feature may enter once it is commoner or rarer among positives than chance
allows, with false discoveries held to a share of those that enter; how much it
counts, the risk and the weight decay decide.

Plan: the samples have documented bounds and are found by hashing ids, so the
learner's cost does not grow with the corpus. Feature counts are aggregated on
the executors; the driver gets the features that entered and the samples' hits
among them. Scoring is one narrow map over the documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.llm.common import cut, pieces, table

#: Expected sizes of the samples: a row is in by the hash of its id.
POSITIVES = 4_000
UNLABELLED = 12_000
#: Lengths of word beginnings that are features, beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A feature needs so many positives with it or expected with it (an eighth of them, where they are few).
LEAST_POSITIVES = 4
#: Of the features that enter, the share that may be there by chance (Benjamini and Hochberg's rule).
FALSE_SHARE = 0.01
#: Steps of evidence, in nats, that the rule tells apart, and how far they go.
EVIDENCE_STEP, EVIDENCE_MOST = 0.25, 60.0
THRESHOLD = 0.3
#: Words that a worker remembers before it starts afresh.
CACHED = 400_000
WORDS = re.compile(r"\w+").findall


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def all_features(text: str) -> set[str]:
    """A text's words, their beginnings ("abcd*"), and the beginnings that two different words of it share ("abcd**")."""
    once: set[str] = set()
    twice: set[str] = set()
    for word in set(WORDS(text.lower())):
        for f in features_of(word):
            (twice if f in once else once).add(f)
    return once | {f"{f}*" for f in twice}


@dataclass
class Model:
    """weights by feature, and the bias."""

    weights: dict[str, float]
    bias: float

    def start(self) -> Model:
        self.plain: set[str] = set()
        self.hits: dict[str, list[str]] = {}
        self.sought = {*self.weights, *(f[:-1] for f in self.weights if f.endswith("**"))}
        return self

    def found(self, text: str) -> set[str]:
        """The features of the model that a text has."""
        if len(self.plain) > CACHED:
            self.plain.clear()
        out: set[str] = set()
        for word in set(WORDS(text.lower())) - self.plain:
            if (hits := self.hits.get(word)) is None:
                hits = [f for f in features_of(word) if f in self.sought]
                if hits and len(self.hits) < CACHED:
                    self.hits[word] = hits
                elif not hits:
                    self.plain.add(word)
            for f in hits:
                out.add(f"{f}*" if f in out else f)
        return {f for f in out if f in self.weights}

    def score(self, text: str) -> float:
        z = self.bias + sum(sorted(self.weights[f] for f in self.found(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Sample:
    """Rows as lists of feature numbers below n, to be multiplied by weights and back."""

    def __init__(self, rows: list[list[int]], n: int):
        self.size, self.n = len(rows), n
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.fromiter((f for r in rows for f in r), np.int64)

    def margin(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, theta[self.col], self.size) + theta[self.n]

    def gradient(self, slope: np.ndarray) -> np.ndarray:
        """Of the mean over rows, from its slope by each row's margin."""
        return np.r_[np.bincount(self.col, slope[self.row], self.n), slope.sum()] / max(self.size, 1)


def risk(p: Sample, u: Sample, prior: float, theta: np.ndarray, corrected: bool = True) -> tuple[float, float, np.ndarray]:
    """(risk on toxic text, estimated risk on clean text, gradient), with logistic loss.

    Where the estimate on clean text is below zero, the gradient steps back from
    what made it so, unless not corrected.
    """
    zp, zu = p.margin(theta), u.margin(theta)
    clean = float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())
    of_clean = u.gradient(sigmoid(zu)) - prior * p.gradient(sigmoid(zp))
    of_toxic = prior * p.gradient(sigmoid(zp) - 1)
    return prior * float(np.logaddexp(0, -zp).mean()), clean, -of_clean if corrected and clean < 0 else of_toxic + of_clean


def fit(positive: list[list[int]], unlabelled: list[list[int]], n: int, prior: float, steps: int = 1500, rate: float = 0.1, decay: float = 2e-4, corrected: bool = True) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative PU risk by Adam on all rows.

    The bias stays where a text without any feature scores half the threshold at most.
    """
    p, u = Sample(positive, n), Sample(unlabelled, n)
    most = np.log(THRESHOLD / 2) - np.log(1 - THRESHOLD / 2)
    theta = np.zeros(n + 1)
    theta[n] = min(np.log(prior / (1 - prior)), most)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        g = risk(p, u, prior, theta, corrected)[2]
        g[:n] += decay * theta[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta[n] = min(theta[n], most)
    return theta[:n], float(theta[n])


def least_evidence(counts: list[tuple[int, int]], false_share: float = FALSE_SHARE) -> float:
    """The evidence from which on features enter, from (step of evidence, features that have it).

    A feature of evidence e is there by chance with probability exp(-e) about. The
    limit is the lowest at which no more than false_share of those above it are expected by chance.
    """
    total, above, least = sum(n for _, n in counts), 0, float("inf")
    for step, n in sorted(counts, reverse=True):
        above += n
        if total * np.exp(-step * EVIDENCE_STEP) <= false_share * above:
            least = step * EVIDENCE_STEP
    return least


def sketch(text: str) -> int:
    """A number that texts share as often as they share their five-word shingles."""
    words = WORDS(text.lower())
    return min((zlib.crc32(" ".join(words[i : i + 5]).encode()) * 2654435761 % 2**61 for i in range(max(1, len(words) - 4))), default=0)


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def in_sample(doc_id: Column, bound: int, n: int, salt: int) -> Column:
    part = F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(1_000_000))
    return part < int(1_000_000 * min(1.0, bound / max(n, 1)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic); an id with several labels is toxic if one says so.

    Rows of docs that repeat an id all count, a null or empty text is an example
    without words, and rows with a null id are not learned from. Without toxic
    labels of any of docs, every text scores zero.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_labels, n_toxic = usable.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not n_toxic:
        return Model({}, -500.0)
    prior = min(max(n_toxic / n_labels, 1e-4), 0.9)
    # at most about POSITIVES ids, whatever the input
    ids = usable.where("toxic = 1").where(in_sample(F.col("doc_id"), POSITIVES, n_toxic, 1)).select("doc_id", F.lit(True).alias("positive"))
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    drawn = in_sample(F.col("doc_id"), UNLABELLED, rows.count(), 2)
    sample = rows.join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"), drawn.alias("unlabelled")).where("positive or unlabelled")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys = pa.array([sketch(x or "") for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "sketch"])

    # a text that was copied often, near copies included, must not speak more often
    sample = cut(sample.mapInArrow(sketched, "text string, positive boolean, unlabelled boolean, sketch long"))
    sample = cut(sample.groupBy("sketch").agg(F.min("text").alias("text"), F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            p, u = Counter(), Counter()
            for text, positive, unlabelled in zip(*(batch.column(c).to_pylist() for c in ("text", "positive", "unlabelled"))):
                own = all_features(text or "")
                if positive:
                    p.update(own)
                elif unlabelled:
                    u.update(own)
            names = [*{*p, *u}]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[x] for x in names], pa.int64()), pa.array([u[x] for x in names], pa.int64())], ["feature", "p", "u"])

    sizes = sample.agg(*(F.sum(F.expr(x).cast("long")) for x in ("positive", "unlabelled", "not positive"))).first()
    n_p, n_u, n_other = (x or 0 for x in sizes)
    if not n_p or not n_u:
        return Model({}, -500.0)
    counts = sample.mapInArrow(counted, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # of all rows that have a feature, how many are positives, against their share of all rows
    share = n_p / (n_p + n_other)
    both = F.col("p") + F.col("u")
    expected, missed = both * share, both * (1 - share)
    part = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    evidence = part(F.col("p"), expected) + part(F.col("u"), missed)
    tested = counts.where(F.greatest(F.col("p"), expected) >= min(LEAST_POSITIVES, max(1, n_p // 8))).select("feature", F.floor(F.least(evidence, F.lit(EVIDENCE_MOST)) / EVIDENCE_STEP).alias("step"))
    tested = cut(tested)
    least = least_evidence([tuple(r) for r in tested.groupBy("step").agg(F.count("*").alias("n")).collect()])
    names = sorted(r["feature"] for r in tested.where(F.col("step") * EVIDENCE_STEP >= F.lit(least)).select("feature").collect())  # bounded by the samples
    index = {x: i for i, x in enumerate(names)}

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(index, 0.0).start()
        for batch in pieces(batches):
            found = [sorted(index[f] for f in model.found(x or "")) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("unlabelled"), pa.array(found, pa.list_(pa.int64()))], ["positive", "unlabelled", "hits"])

    rows = sample.mapInArrow(hit, "positive boolean, unlabelled boolean, hits array<long>").collect()  # bounded: the samples
    rows.sort(key=lambda r: r["hits"])
    weights, bias = fit([r["hits"] for r in rows if r["positive"]], [r["hits"] for r in rows if r["unlabelled"]], len(names), prior)
    return Model(dict(zip(names, weights.tolist())), bias)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs (text among its columns) with the model's score from 0 to 1.

    A null text scores as the empty one. A column of that name is replaced.
    Repeated rows score alike; no rows give no rows.
    """
    kept = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.start()
        for batch in pieces(batches):
            scores = pa.array([own.score(x or "") for x in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, column])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
