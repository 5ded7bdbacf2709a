"""Fingerprints and alignments against slow versions, and the pipeline's stages on empty and odd tables."""

import random

import pytest

import corpus_pipeline
from reelframe.llm import license_scan, prefix_fingerprint
from reelframe.llm.common import table

MASK, PRIME, BASES = 2**64 - 1, 2**31 - 1, (911_382_323, 972_663_749)


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def polynomial(text):
    out = 0
    for b in BASES:
        out = out << 31 | sum((ord(c) + 1) * pow(b, j, PRIME) for j, c in enumerate(text)) % PRIME
    return out


def slots(text):
    """The least hash of each class over all spans of 12 code points, one span after the other."""
    least = {}
    for i in range(max(1, len(text) - 11)) if text else ():
        h = mixed(polynomial(text[i : i + 12]))
        least[h % 64] = min(h, least.get(h % 64, MASK))
    return {k: 1 + mixed(h) % 65_535 for k, h in least.items()}


def alike(a, b):
    keys = a.keys() | b.keys()
    return sum(a.get(k) == b.get(k) for k in keys) / len(keys) if keys else 1.0


def test_fingerprints_against_spans_one_by_one(spark):
    r = random.Random(9)
    base = "".join(r.choice("ab cdeé漢🙂") for _ in range(120))
    texts = [base, base[:60] + base[70:], base, "", None, "short", "x" * 40, "".join(r.choice("ab cd") for _ in range(75)), base[40:] + "tail", "a" * 11, "b" * 12, "c" * 13]
    rows = list(enumerate(texts))
    got = {x["doc_id"]: x for x in prefix_fingerprint.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for k, t in rows:
        t, following = t or "", texts[(k + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert got[k]["near_edited"] == pytest.approx(alike(slots(t), slots(edited)))
        assert got[k]["near_next"] == pytest.approx(alike(slots(t), slots(following)))
        assert got[k]["fingerprint"].split("-")[1] == f"{polynomial(t):016x}"


def longest_common(a, b):
    most = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            most[i + 1][j + 1] = most[i][j] + 1 if x == y else max(most[i][j + 1], most[i + 1][j])
    return most[-1][-1]


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        k = r.randrange(len(out) + 1)
        step = r.randrange(4)
        if step == 0:
            out.insert(k, f"new{r.randrange(99)}")
        elif step == 1 and out:
            del out[min(k, len(out) - 1)]
        elif step == 2 and out:
            out[min(k, len(out) - 1)] = f"other{r.randrange(99)}"
        elif len(out) > 5:
            a = r.randrange(len(out) - 4)
            out[a : a + 4] = out[a : a + 4][::-1]
    return out


def test_alignment_against_the_longest_common_subsequence():
    r = random.Random(12)
    for _ in range(60):
        # every word once: patience is exact
        a = [f"w{k}" for k in range(r.randrange(1, 60))]
        b = edited(r, a, r.randrange(12))
        pairs = license_scan.align(a, b)
        unique = len(set(b)) == len(b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == longest_common(a, b) or not unique and len(pairs) <= longest_common(a, b)
        # ends that differ, and no word once between them: the gap is aligned exactly
        c, d = (["xxyy"[k % 4] for k in r.sample(range(40), r.randrange(8, 25))] for _ in range(2))
        c, d = ["c", *"xxyy", *c, "c"], ["d", *"yyxx", *d, "d"]
        assert len(license_scan.align(c, d)) == longest_common(c, d)


def test_random_edits_of_a_notice_are_found_while_covered(spark):
    r = random.Random(3)
    template = next(t for t in license_scan.all_templates() if t.name == "MIT" and len(t.text) > 800)
    words = license_scan.words_of(template.text)
    rows, want = [], {}
    for k in range(12):
        text = list(words)
        # words of no meaning to the license are replaced, fewer than a tenth
        for _ in range(r.randrange(0, len(words) // 12)):
            i = r.randrange(len(words) // 2, len(words) - 30)
            text[i] = "zzz"
        rows.append((k, "before it " * 5 + " ".join(text) + " after it" * 5))
        want[k] = sum(a == b for a, b in zip(words, text)) / len(words)
    for x in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = {y["license"]: y["matched"] / y["size"] for y in x["licenses"]}
        assert found["MIT"] >= want[x["doc_id"]] - 0.02, x["doc_id"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_empty_and_odd_tables(spark, small, name, stage):
    docs = table(spark, small, "documents")
    assert stage(spark, docs.where("false"), small).count() == 0
    rows = [(1, None, "en", None, 0), (1, "", None, "src0", 0), (None, "a text without an id", "en", "src0", 20), (2, "word " * 30_000, "en", "src1", 150_000), (2, "word " * 30_000, "en", "src1", 150_000)]
    odd = spark.createDataFrame(rows, docs.schema)
    done = stage(spark, odd, small)
    n = done.count()
    assert n <= len(rows) and (name in ("mixing", "near_dedup") or n == len(rows))
    if name != corpus_pipeline.STAGES[-1][0]:
        assert done.columns == docs.columns
