"""From raw documents to token ids: a pipeline of five corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm import byte_bpe, near_dedup, personal_data, source_mixing, toxicity
from reelframe.llm.common import cut, table, unused

#: Of the tokens that reach the mixing stage, the share to be kept; no document is taken twice.
MIX_PERCENT = 80
#: Two documents are near copies where at least so many per cent of their shingles are common.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; null texts and repeated rows are judged like any others."""
    model, score = toxicity.train(docs, table(spark, sf_dir, "labels")), unused("toxicity", docs.columns)
    return toxicity.score(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows are told apart, not ids: of rows that repeat an id those stay whose
    texts are near copies of no other, and one of any group. Rows with a null
    id, or a text without words, stay.
    """
    return near_dedup.without_near_copies(docs, NEAR_PERCENT)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data in their texts replaced by its kind, and n_chars to match; null texts stay null."""
    return personal_data.redacted(docs).withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else personal_data.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weights of domains, languages and sources call for.

    A null language or source is a leaf of its own; a document without tokens is taken with its leaf's others.
    """
    copies = [c for c in docs.columns if c.lower() == "copies"]
    rows = docs.withColumnRenamed("copies", held := unused("copies", docs.columns)) if copies else docs
    mixed = source_mixing.mix(rows, percent=MIX_PERCENT, epochs=1).drop("copies")
    return mixed.withColumnRenamed(held, copies[0]) if copies else mixed


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether they decode to its text; a null text has none and counts as empty."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    coded = byte_bpe.encode_and_decode(rows, ranks)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Learned classifiers and byte-pair merges are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
