"""The non-negative risk against a plain loop, what its correction does, and corpora that a model must not fail on."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.llm import toxicity


def plain_risk(positive, unlabelled, prior, theta):
    """(toxic part, clean part) by loops over rows."""
    z = lambda row: sum(theta[f] for f in row) + theta[-1]
    loss = lambda x: math.log1p(math.exp(x))
    clean = sum(loss(z(r)) for r in unlabelled) / len(unlabelled) - prior * sum(loss(z(r)) for r in positive) / len(positive)
    return prior * sum(loss(-z(r)) for r in positive) / len(positive), clean


def rows_of(seed, n, features=6):
    r = random.Random(seed)
    return [sorted(r.sample(range(features), r.randrange(features))) for _ in range(n)]


def test_risk_and_gradient_against_loops():
    p, u, r, seen = rows_of(1, 30), rows_of(2, 50), np.random.default_rng(0), set()
    for scale, prior in ((0.3, 0.2), (2.0, 0.4), (6.0, 0.8)):
        for _ in range(4):
            theta = r.normal(size=7) * scale
            toxic, clean, gradient = toxicity.risk(toxicity.Sample(p, 6), toxicity.Sample(u, 6), prior, theta)
            assert (toxic, clean) == pytest.approx(plain_risk(p, u, prior, theta))
            seen.add(clean < 0)

            def value(t):
                a, b = plain_risk(p, u, prior, t)
                return -b if clean < 0 else a + b

            step = [(value(theta + e) - value(theta - e)) / 2e-5 for e in np.eye(7) * 1e-5]
            assert gradient == pytest.approx(np.array(step), abs=1e-5)
    assert seen == {True, False}


def test_correction_keeps_the_clean_part_from_negative():
    # every positive has a feature of its own, so that the uncorrected risk has no bottom
    p, u = [[k] for k in range(40)], [[] for _ in range(40)]
    parts = {}
    for corrected in (True, False):
        weights, bias = toxicity.fit(p, u, 40, 0.4, decay=0.0, corrected=corrected)
        parts[corrected] = toxicity.risk(toxicity.Sample(p, 40), toxicity.Sample(u, 40), 0.4, np.r_[weights, bias])[1]
    assert parts[False] < -1 and parts[True] > -0.2


def test_evidence_rule():
    # 1,000 features of no evidence, 50 of much: the limit lets about one in a hundred in by chance
    least = toxicity.least_evidence([(0, 1000), (80, 50)])
    assert 0 < least <= 80 * toxicity.EVIDENCE_STEP
    assert toxicity.least_evidence([(0, 1000), (1, 3)]) == float("inf")
    assert toxicity.least_evidence([]) == float("inf")


@pytest.mark.parametrize("share,n", [(0.1, 20_000), (0.33, 6_000)])
def test_many_rare_toxic_words(spark, share, n):
    r = random.Random(7)
    common = [f"w{k}" for k in range(3000)]
    bad = ["".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic, w = r.random() < share, [r.choice(common) for _ in range(60)]
        for x in r.sample(bad, 2) if toxic else []:
            w[r.randrange(60)] = x
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(8)
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    held = toxicity.score(df, model).where(toxicity.is_held_out(F.col("doc_id"))).groupBy("toxic").agg(F.avg((F.col("score") >= toxicity.THRESHOLD).cast("int"))).collect()
    found = dict(map(tuple, held))
    assert found[1] >= 0.9 and found[0] < 0.05


def test_nothing_to_learn_rejects_nothing(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefghij") * 4 for _ in range(20)), int(r.random() < 0.4)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert toxicity.score(df, model).where(F.col("score") >= toxicity.THRESHOLD).count() == 0


def test_copies_count_once(spark):
    # one toxic text in 200 near copies teaches no more than once: its own words are no features
    r = random.Random(5)
    base = [f"base{k}" for k in range(60)]
    rows = []
    for i in range(200):
        w = list(base)
        w[r.randrange(60)] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(w), 1))
    rows += [(200 + i, " ".join(f"v{r.randrange(500)}" for _ in range(40)) + (" venom" if i % 6 == 0 else ""), int(i % 6 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    weights = model.weights
    assert weights["venom"] > 3 * max([v for f, v in weights.items() if f.startswith("base")], default=0.0)


def test_two_words_of_one_beginning():
    assert {"abcd*", "abcd**", "abcde*", "abcdefx", "abcdxy"} <= toxicity.all_features("ABCDefx abcdxy other")
    model = toxicity.Model({"abcd**": 2.0, "abcd*": 1.0}, -1.0).start()
    assert model.found("abcdefx abcdxy") == {"abcd**", "abcd*"} and model.found("abcdefx abcdefx") == {"abcd*"}
