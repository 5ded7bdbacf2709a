"""Corpus operators against SQL or slow versions, and on awkward tables."""

import hashlib
import math
import random
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken
import tiktoken.load
from pyspark.sql import functions as F

import corpus_pipeline
from reelframe.llm import byte_bpe, components, license_scan, near_dedup, personal_data, prefix_fingerprint, registry, source_mixing, suffix_dedup, toxicity, url_filter, vector_search

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 997}" for k in range(30_000))
TEXTS = [None, "", " ", "one two", "same text here for all of us", "same text here for all of us", LONG, LONG + " end", "naïve 漢字 🙂 mail a.b@example.com now", "call +49 170 1234567 or 10.0.0.1"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 == 0 else "src0", len(t or "")) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", "en", "src1", 5)], DOC).withColumn("score", F.lit("x")).withColumn("ids", F.lit("y")).withColumn("copies", F.lit(1)).withColumn("spans", F.lit(2))


@pytest.fixture(scope="module")
def none(awkward):
    return awkward.where("false")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("name", registry.SQL)
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    wanted = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({registry.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, wanted))


def test_topk_awkward(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, []), (None, [1.0, 1.0])]
    v = vector_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = vector_search.exact_topk(v, v.where("vec_id % 20 = 0"), 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 4096), (0, 2, 4096), (20, 1, 8192), (20, 2, 8192)]
    assert vector_search.exact_topk(v.where("false"), v, 2).count() == 0


def test_urls_awkward(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.example.NET/en/x?q#f"), (5, "http://x.org/fr/"), (6, "http://net"), (4, "http://A.example.NET/en/x?q#f"), (7, "http://é.com/" + "a" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("z"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).collect()}
    assert got[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[5] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[6][:3] == ("net", "", None)
    assert got[1][:3] == got[2][:3] == got[3][:3] == ("", "", None)
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def varied(seed, n):
    r = random.Random(seed)
    base = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(6)]
    out = []
    for k in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            words[r.randrange(len(words))] = f"x{r.randrange(9999)}"
        out.append((k, " ".join(words)))
    return out


def test_near_copies_against_all_pairs(spark, docs):
    for rows in ([tuple(r) for r in docs.collect()], varied(1, 150)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == linked(rows)


def test_near_copies_awkward(awkward, none):
    rows = near_dedup.near_duplicates(awkward).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_shingles"] == 0 and by[0]["component_id"] == 0
    assert by[5]["component_id"] == 4 and by[7]["component_id"] == 6
    assert by[None]["kept"] and by[None]["component_id"] is None
    assert near_dedup.near_duplicates(none).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_toxicity_learns(spark):
    r = random.Random(5)
    words = [f"plain{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        t = r.choices(words, k=30) + ([f"venom{r.randrange(3)}"] if toxic else [])
        rows.append((k, " ".join(t)))
        labels.append((k, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), dict(labels)
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = toxicity.score(d, model).where(toxicity.is_held_out(F.col("doc_id"))).collect()
    assert len(held) > 80
    assert sum((x["score"] >= 0.3) == bool(y[x["doc_id"]]) for x in held) / len(held) > 0.95


def test_toxicity_awkward(spark, awkward, none):
    no_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(awkward, no_labels)
    assert all(0 <= r["score"] < 0.3 for r in toxicity.score(awkward, model).collect())
    assert toxicity.score(none, toxicity.train(none, no_labels.where("false"))).count() == 0


def repeated(rows, length):
    seen = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in raws:
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]] = seen.get(raw[p : p + length], 0) + 1
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_against_all_windows(spark):
    r = random.Random(8)
    pool = ["".join(r.choice("abc é") for _ in range(r.randrange(200, 400))) for _ in range(5)]
    rows = [(k, "".join(r.choice(["x" * r.randrange(90), r.choice(pool), str(r.random())]) for _ in range(6))) for k in range(40)]
    rows += [(40, "ab" * 300), (41, rows[3][1]), (42, None), (43, "")]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == repeated(rows, 200)


def test_repeats_awkward(awkward, none):
    rows = suffix_dedup.without_repeats(awkward).collect()
    assert len(rows) == 12
    assert {r["doc_id"]: r["n_removed"] for r in rows}[6] == len(LONG)
    assert suffix_dedup.without_repeats(none).count() == 0


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    }
    found = [(m.start(), n, m.end(), k) for n, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_personal_data_base(spark, docs):
    extra = [(10**6 + k, t) for k, t in enumerate([None, "", "a@b.c.d x@y a..b@c-d.e", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 +12 +123456789012345678", "🙂 p@q.r", "a@b.c@d.e", "." * 5000 + "@x.y"])]
    rows = [tuple(r) for r in docs.collect()] + extra
    found = personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["b"], r["s"]) for r in found.select("doc_id", personal_data.listed(F.col("base")).alias("b"), personal_data.listed(F.col("spans")).alias("s")).collect()}
    for i, t in rows:
        assert got[i][0] == base_spans(t), t
        assert set(filter(None, got[i][0].split(","))) <= set(filter(None, got[i][1].split(",")))


def test_redaction(spark, awkward, none):
    out = {r["doc_id"]: r["text"] for r in personal_data.redacted(awkward).collect()}
    assert "a.b@example.com" not in out[8] and "<email>" in out[8]
    assert "10.0.0.1" not in out[9]
    assert out[0] is None and out[6] == LONG
    assert personal_data.redacted(none).count() == 0


def test_mixing_awkward(awkward, none):
    out = source_mixing.mix(awkward, percent=100, epochs=1).collect()
    assert all(r["copies"] == 1 for r in out)
    assert source_mixing.mix(none).count() == 0


def test_mixing_keeps_the_budget(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    tokens = lambda df: df.select((F.regexp_count("text", F.lit(source_mixing.WORD)) * F.col("copies")).alias("n")).agg(F.sum("n")).first()[0]
    every, some = tokens(d.withColumn("copies", F.lit(1))), tokens(source_mixing.mix(d, percent=50, epochs=1))
    assert 0.3 * every < some <= 0.5 * every


def test_bpe_against_tiktoken(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(path)) if t}
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(10**6 + k, t) for k, t in enumerate([None, "", "a", "<|endoftext|>", "🙂" * 50, "x" * 3000, "zqxjkv" * 500, "\n\n  \t é"])]
    rows = [tuple(r) for r in docs.collect()] + extra
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = byte_bpe.decode(byte_bpe.encode(d, path), path)
    for r in coded.collect():
        assert r["ids"] == library.encode(r["text"] or "", disallowed_special=())
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(d.where("false"), path).count() == 0


def test_bpe_memory_ages(docs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED", 20)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
    tokenizer = byte_bpe.Tokenizer(tokens, public_tokenizers.PATTERN).start()
    texts = [t or "" for _, t in docs.limit(50).collect()] * 2
    for t in texts:
        assert tokenizer.encode(t).tolist() == library.encode(t, disallowed_special=())
    assert tokenizer.memory.older


def test_perfect_hash():
    keys = [str(k).encode() for k in range(5000)]
    h = byte_bpe.MinimalPerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(5000))


def test_fingerprints(spark, docs):
    rows = sorted(tuple(r) for r in docs.collect())
    got = {r["doc_id"]: r for r in prefix_fingerprint.compare_neighbours(docs.repartition(7)).collect()}
    prints = {}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[i]["edited_fingerprint"] == prefix_fingerprint.as_text((f := prefix_fingerprint.Fingerprint(e)).hashes, f.slots)
        assert 0 <= got[i]["near_next"] <= 1
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
        k = 0
        while k < min(len(t), len(e)) and t[k] == e[k]:
            k += 1
        assert got[i]["shared_prefix"] == k


def test_fingerprints_awkward(awkward, none):
    assert prefix_fingerprint.compare_neighbours(awkward).count() == 12
    assert prefix_fingerprint.compare_neighbours(none).count() == 0


def test_licenses(spark, awkward, none):
    mit = license_scan.TEMPLATES[1][1]
    rows = [(1, "intro " + mit.upper() + " outro"), (2, mit.replace("including", "also including many").replace("merge, ", "")), (3, "permission is granted to any person"), (4, None), (5, ""), (6, LONG + " " + license_scan.TEMPLATES[2][1])]
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: [], 4: [], 5: [], 6: ["Apache-2.0"]}
    assert license_scan.scan_licenses(awkward).count() == 12
    assert license_scan.scan_licenses(none).count() == 0


def test_patience_alignment():
    a, b = "the quick brown fox jumps".split(), "a the quick red fox always jumps".split()
    assert [a[i] for i, _ in license_scan.align(a, b)] == ["the", "quick", "fox", "jumps"]


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.cut(stage(spark, before, small))
        assert after.columns == columns, name
        assert 0 < after.count() <= before.count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, small)
    assert last.where("not round_trip").count() == 0 and last.count() == before.count()


def test_near_copy_stage_keeps_one_of_each(spark, awkward, small):
    kept = corpus_pipeline.drop_near_copies(spark, awkward.select(*[c.split()[0] for c in DOC.split(", ")]), small)
    rows = linked([(k, t) for k, t in enumerate(TEXTS)])
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({c for _, c in rows.values()})


def linked_at(rows, least):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= least * len(a | b) and label[i] != label[j]:
                x, y = sorted((label[i], label[j]))
                label = {k: x if v == y else v for k, v in label.items()}
    return label


def test_near_copy_stage_links_from_80_percent(spark, small):
    r = random.Random(80)
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for k, places in ((1, (20, 70, 120)), (2, (30, 80, 130, 180)), (3, (10, 40, 90, 140, 170, 195))):
        words = list(base)
        for p in places:
            words[p] = f"new{k}_{p}"
        rows.append((k, " ".join(words)))
    # 0.86 and 0.81 are near copies of 0; 0.74 and more from all others is not
    rows += [(10 + k, t) for k, t in varied(3, 120)] + [(200, " ".join(f"own{r.random()}" for _ in range(60)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = linked_at(rows, 80)
    assert [wanted[k] for k in range(4)] == [0, 0, 0, 3] and wanted != linked_at(rows, 85)
    assert {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(d, 80).collect()} == wanted
    assert {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, d, small).collect()} == set(wanted.values())
    assert {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(d).collect()} == linked_at(rows, 85)


def test_near_copies_of_one_long_list(spark):
    r = random.Random(81)
    base = [f"c{k}" for k in range(100)]
    rows = []
    for k in range(560):
        words = list(base)
        words[r.randrange(100)] = f"x{k}"
        rows.append((k, " ".join(words)))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert got == linked_at(rows, 80)


def test_matches_of_a_similarity():
    assert (near_dedup.matches_for(85), near_dedup.matches_for(80)) == (40, 35)


def test_licenses_side_by_side(spark):
    mit = license_scan.TEMPLATES[1][1]
    assert len(license_scan.align("x the mit y the mit z".split(), "q the mit r the mit s".split())) == 4
    rows = [(1, "see a b c released under the mit license and released under the mit license for more"), (2, f"one {mit} two {mit} three"), (3, " and ".join([mit] * 5))]
    got = {r["doc_id"]: [(x["license"], x["matched"] == x["size"]) for x in r["licenses"]] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: [("MIT", True)] for k in (1, 2, 3)}


def test_licenses_told_apart(spark):
    bsd3, bsd2, gpl2 = (license_scan.whole_text(x) for x in ("BSD-3-Clause", "BSD-2-Clause", "GPL-2.0"))
    wanted = {
        "Released under the BSD License.": [],
        "Licensed under CC BY 4.0.": ["CC-BY-4.0"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": ["CC-BY-NC-4.0"],
        "released a b c under d e f the g h i mit j k license": [],
        "released one two three four five under six seven the eight mit license": [],
        "x " + bsd2 + " y": ["BSD-2-Clause"],
        "x " + bsd3.replace("Regents", "Owners") + " y": ["BSD-3-Clause"],
        bsd3 + bsd2: ["BSD-2-Clause", "BSD-3-Clause"],
        gpl2[:-3000] + " and more": ["GPL-2.0"],
        **{license_scan.whole_text(name): [name] for name, _ in license_scan.WHOLE},
        **{t.text: [t.name] for t in license_scan.all_templates()},
    }
    rows = list(enumerate(wanted))
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(rows[k][1][:99], got[k]) for k in range(len(rows))] == [(x[:99], names) for x, names in wanted.items()]


def test_topk_repeated_ids_and_huge_vectors(spark):
    # squared norms of the huge ones pass a long, their scores with the others do not; the last row takes no part
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 1.0]), (1, [2.0, 0.0]), (1, [3.0, 0.5]), (1, [3.0, 0.5]), (2, [2.0**40, 0.0]), (3, [-(2.0**42), 5.0]), (40, [2.0**41, 0.0]), (4, [float("nan"), 1.0])]
    exact = {}
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows[:-1]]
    for i, q in vectors:
        if i % 20 == 0 and i != 40:
            exact.setdefault(i, []).extend((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i)
    v = vector_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in vector_search.exact_topk(v, v.where("vec_id in (0, 20)"), 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert got == {i: sorted(x)[:6] for i, x in exact.items()}
    with pytest.raises(Exception, match="fit a long"):
        vector_search.exact_topk(v, v.where("vec_id = 40"), 6).collect()


def test_near_copies_dealt_to_blocks(spark, monkeypatch):
    rows = varied(7, 260) + [(1000 + k, t) for k, t in varied(7, 40)]
    for long, many, large in ((8, 99, 1500), (4, 2, 600)):
        monkeypatch.setattr(near_dedup, "LONG_LIST", long)
        monkeypatch.setattr(near_dedup, "MANY_BLOCKS", many)
        monkeypatch.setattr(near_dedup, "LARGE_GROUP", large)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        assert got == linked(rows)


@pytest.mark.parametrize("turn", (1, -1))
def test_near_copies_of_an_id_with_several_texts(spark, small, turn):
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    text = lambda words, *new: " ".join([*words, *new])
    rows = [(1, text(a)), (1, text(b)), (2, text(a, "x")), (3, text(b, "y")), (0, text(b, "z")), (5, ""), (5, text(a, "w")), (7, None), (7, "")][::turn]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = near_dedup.near_duplicates(d, 80).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(0, 0), (1, 0), (2, 0), (3, 0), (5, 0), (7, 7)} and len(got) == 9
    kept = corpus_pipeline.drop_near_copies(spark, d.withColumn("_row_0", F.lit("mine")), small).collect()
    # rows are told apart there: one near copy of a, one of b, and those without words
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["text"]) == [(0, text(b, "z")), (1, text(a))]
    assert len(kept) == 5 and all(r["_row_0"] == "mine" for r in kept)


def test_components_of_random_links(spark):
    r = random.Random(4)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(330)]
    label = {k: k for link in links for k in link}
    for x, y in links:
        x, y = sorted((label[x], label[y]))
        label = {k: x if v == y else v for k, v in label.items()}
    real = {k for link in links if link[0] != link[1] for k in link}
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    assert got == {k: label[k] for k in real}


def test_personal_data_of_a_long_text(spark):
    r = random.Random(6)
    parts = ["mail ana{0}@example.org", "call +49 170 {1}", "at 10.0.0.7", "naïve 🙂 {0}", "555-123-{2}", "card 4111 1111 1111 1111"]
    text = " ".join(r.choice(parts).format(k, r.randrange(10**6, 10**7), r.randrange(1000, 9999)) for k in range(6_000))
    rows = [(1, text), (2, text[:700]), (3, "clean"), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: (x["b"], x["spans"]) for x in personal_data.find_personal_data(d).select("doc_id", personal_data.listed(F.col("base")).alias("b"), "spans").collect()}
    out = {x["doc_id"]: x["text"] for x in personal_data.redacted(d).collect()}
    for i, t in rows:
        assert found[i][0] == base_spans(t)
        wanted, at = [], 0
        for s in found[i][1]:
            if s["start"] >= at:
                wanted += [t[at : s["start"]], f"<{personal_data.KINDS[s['k']]}>"]
                at = s["end"]
        assert out[i] == (t and "".join([*wanted, t[at:]]))
    assert len(found[1][1]) > 3_000


def test_personal_data_query_columns(spark, small):
    got = {x["doc_id"]: x for x in personal_data.op6_weak_supervision(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, t in rows:
        base = base_spans(t)
        kinds = [x.split(":")[0] for x in filter(None, base.split(","))]
        assert [got[i][f"n_{k}"] for k in personal_data.KINDS] == [kinds.count(k) for k in personal_data.KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, got[i]["spans"].split(",")))


#: Names that operators use inside themselves, and others.
NAMES = """row leaf passes rest bucket last place model codes limit by_rule held_out accepted n token gram own context total length step score weights _base _more base
candidates pieces blocks more _email_1 _email_1v _toxicity decoded copies task node label group key heads bits list id component component_id kept first deal host path
rule verdict size left right votes start end k c x tokens row_ text_bytes licenses license words positive unlabelled hits url_ domain given room weight budget spans ids""".split()


@pytest.mark.parametrize("name", ["urls", "mix", "find", "redacted", "score", "encode", "licenses", "toxicity", "near_dedup", "personal_data", "mixing", "byte_bpe"])
def test_clashing_columns_come_back(spark, small, name):
    rows = [(k, t, "en", "src0", len(t or "")) for k, t in enumerate(TEXTS[:6] + TEXTS[8:])]
    d = spark.createDataFrame(rows, DOC)
    d = d.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in NAMES), F.col("doc_id").alias("`").alias("a column"))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    stages = dict(corpus_pipeline.STAGES)
    run, replaced = {
        "urls": (lambda: url_filter.judge_urls(d.withColumn("url", F.col("text"))), {"host", "path", "rule", "verdict", "score"}),
        "mix": (lambda: source_mixing.mix(d, percent=100, epochs=1), {"copies"}),
        "find": (lambda: personal_data.find_personal_data(d), {"base", "spans"}),
        "redacted": (lambda: personal_data.redacted(d), set()),
        "score": (lambda: toxicity.score(d, toxicity.Model({}, -1.0)), {"score"}),
        "encode": (lambda: byte_bpe.decode(byte_bpe.encode(d, path), path), {"ids", "decoded"}),
        "licenses": (lambda: license_scan.scan_licenses(d), {"licenses"}),
    }.get(name, (lambda: stages[name](spark, d, small), set()))
    got = run()
    if name == "byte_bpe":
        assert got.count() == len(rows)
        return
    if name in stages:
        assert got.columns == d.columns
    found = got.collect()
    # one of the copies goes, and the mixing stage takes 80 % of the tokens
    assert len(found) == (len(rows) - 1 if name in ("near_dedup", "mixing") else len(rows))
    for r in found:
        assert all(r[c] == f"{c}:{r['doc_id']}" for c in NAMES if c not in replaced)


def test_bpe_query_columns(spark, small):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(byte_bpe.read_ranks(path)) if t}, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    wanted = {}
    for i, t in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(t or "", disallowed_special=())
        wanted[i] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.op8_byte_bpe(spark, small).collect()} == wanted


def test_personal_data_counts_by_kind(spark, tmp_path):
    rows = [(1, "a@b.cd then 1.2.3.4 and 5.6.7.8"), (2, "4111 1111 1111 1111 or 4111111111111111"), (3, None), (4, "+49 170 1234567 x@y.z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r[f"n_{k}"] for k in personal_data.KINDS) for r in personal_data.op6_weak_supervision(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 2, 0, 0), 2: (0, 0, 2, 0), 3: (0, 0, 0, 0), 4: (1, 0, 0, 1)}


def test_url_tables_that_grow_are_not_broadcast(spark):
    """A table whose file is small was sent to the driver and every executor, however many rows it has."""
    urls = spark.createDataFrame([(f"http://example.net/en/{k}", k % 2 == 0, 1) for k in range(50)], "url string, accepted boolean, n int")
    own, context = url_filter.counts(urls)
    gram = urls.select(F.explode(url_filter.grams(F.element_at(url_filter.tokens(F.col("url")), -1))).alias("gram")).distinct()
    plan = url_filter.ratios(gram, own, context)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2  # short ones, behind a checked size
    judged = url_filter.judge_urls(urls.select("url"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in judged
