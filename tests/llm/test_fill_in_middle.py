"""The fill-in-middle transformation against a plain version, on awkward texts, and its index against counting."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.llm import fill_in_middle as fim

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = TOKENS.findall(text)
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "\n\t", "one", " one", "one ", "a b c d  e\r\n\x0bf", "naïve 漢字 🙂 x", "has <P> in it", "ends < <S <", "P> S> M>", "x" * 70_000, "ab " * 40_000, "\x00 \x1f\x85 z"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k * 100 + j, t) for k, t in enumerate(TEXTS) for j in range(12)] + [(None, "no id at all"), (None, "no id at all"), (5, "same id"), (5, "same id")]
    return spark.createDataFrame(data, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("Row", F.lit("r")).withColumn("a.b", F.lit(2))


def test_against_plain(rows):
    got = fim.fill_in_middle(rows)
    assert got.columns == ["doc_id", "text", "Row", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == rows.count()
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(rows.where("false")).count() == 0


def test_rank_and_select():
    r = np.random.default_rng(3)
    for n, share in ((0, 0), (1, 1), (7, 0.5), (512, 1), (513, 0), (5000, 0.01), (5000, 0.7)):
        bits = r.random(n) < share
        v = fim.BitVector(bits)
        assert v.total == bits.sum()
        assert v.rank(np.arange(n + 1)).tolist() == [int(bits[:i].sum()) for i in range(n + 1)]
        assert v.select(np.arange(1, v.total + 1)).tolist() == np.flatnonzero(bits).tolist()
