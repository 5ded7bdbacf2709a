"""Block-max search against scoring every document, on awkward tables, with small ranges."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelframe.llm import block_max


def terms_of(text):
    return re.findall(block_max.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """Each item's k best by scoring all documents, one list an item row."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def made():
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(5000)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice((0, 1, 5, 40, 200))))) for i in range(400)]
    docs += [(7, docs[3][1]), (7, docs[3][1]), (None, docs[3][1]), (900, None), (901, ""), (902, "-- ** --"), (903, "W1 É w1É 漢字w2 " + "w3 " * 30_000)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice((1, 3, 12, 60))))) for k in range(25)]
    items += [(3, items[3][1]), (None, "w1 w2"), (50, None), (51, ""), (52, "nowhere"), (53, "W1 w1 w1É 漢字w2")]
    return docs, items


def as_list(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("limits", [(256, 100_000), (7, 40)])
def test_against_every_document(spark, made, monkeypatch, limits):
    monkeypatch.setattr(block_max, "BATCH_TERMS", limits[1])
    docs, items = made
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("x")).repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x")).withColumn("query", F.lit(1))
    for k in (1, 20):
        got = block_max.search(block_max.build_index(d, limits[0]), q, k)
        assert got.columns == ["item_id", "text", "query", "rank", "doc_id", "score"]
        assert as_list(got) == sorted(brute(docs, items, k), key=str)


def test_empty(spark, made):
    docs, items = (spark.createDataFrame(x, f"{n} long, text string") for n, x in zip(("doc_id", "item_id"), made))
    index = block_max.build_index(docs)
    assert block_max.search(index, items.where("false"), 5).count() == 0
    assert block_max.search(block_max.build_index(docs.where("false")), items, 5).count() == 0
    assert block_max.search(index, items.where("item_id in (50, 51, 52)"), 5).collect() == []


def test_a_file_holds_few_blocks(spark, made):
    """All blocks of a task were one file, and a reader decodes all rows of a file at once."""
    docs = spark.createDataFrame(made[0], "doc_id long, text string").coalesce(1)
    index = block_max.build_index(docs, 3)
    for table in (index.blocks, index.maxima):
        counts = table.groupBy(F.input_file_name()).count().collect()
        assert len(counts) > 2 and max(r["count"] for r in counts) <= block_max.FILE_BLOCKS
