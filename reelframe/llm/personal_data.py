"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans are what the strict patterns and their checks find; they always stay.
Looser patterns bring further candidates. On every candidate four labelers vote:
the strict pattern, a gazetteer (top-level domains, calling codes, issuers,
address ranges), cue words before it, and its surroundings. Expectation
maximisation over the counts of vote patterns (at most 16 for each kind) gives
the labelers' reliabilities and each pattern's probability of being personal
data. With these as soft labels a naive Bayes classifier is fitted to the
candidates' features; a loose candidate that it finds likely enough, and that
overlaps no base span, is added.

Plan: one narrow pass finds the candidates. What is learned comes from counts
over all of them: a group by of bounded size. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import boxed, cut, table, unboxed

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: Strict patterns, written so that they find what the plain ones find, but in
#: linear time and without deep recursion: runs are possessive, and a run is
#: entered at its start or where the match before ended.
STRICT = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of digits with single separators; fewer than 14 digits never pass
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates: written-out addresses, IPv6, 13-digit cards, phone numbers without a plus.
LOOSE = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": ("@",), "phone": ("+",)}
LOOSE_NEEDS = {"email": ("(at)", "[at]"), "ip": (":",)}
#: Fixed lists: top-level domains, calling codes, card issuers, cue words.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl|us|ca|au|jp"
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38"
CUES = {
    "email": "mail|contact|write|schreib|contacto|courriel|correo",
    "ip": "ip|host|server|address|adresse|dirección",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|telefon|téléphone|teléfono|fax",
}
CONTEXT = 24
#: Elements of an array that are folded at once.
BLOCK = 64
#: Characters of a piece of a text that is rewritten.
PIECE = 1_024
LABELERS = 4
ROUNDS = 30
ACCEPT = 0.9


def luhn(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a + F.aggregate(F.array(F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)), F.lit(0), lambda _, x: F.when(x > 9, x - 9).otherwise(x)),
    )
    return (n > 0) & (total % 10 == 0)


def passes(kind: str, value: Column) -> Column:
    """The checks on what a strict pattern matched."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        # leading zeros do not count
        return F.forall(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def votes(kind: str, strict: Column, value: Column, before: Column, after: Column) -> Column:
    """The four labelers' votes as bits: pattern, gazetteer, cue words, surroundings."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    known = {
        "email": F.lower(F.right(value, F.lit(8))).rlike(rf"[.)\] ](?:{DOMAINS})$"),
        "ip": ~F.left(value, F.lit(4)).rlike(r"^(?:0|2[4-9][0-9])\."),
        "card": F.left(digits, F.lit(4)).rlike(f"^(?:{ISSUERS})"),
        "phone": F.when(value.startswith("+"), digits.rlike(f"^(?:{CALLING})")).otherwise(digits.rlike("^[2-9][0-9]{2}[2-9]")),
    }[kind]
    cued = F.lower(before).rlike(rf"(?<!\pL)(?:{CUES[kind]})")
    apart = ~before.rlike(r"[\pL0-9=\"'/_-]$") & ~after.rlike(r"^[\pL0-9=\"'/_@-]")
    bit = lambda c, k: F.when(c, 1 << k).otherwise(0)
    return bit(strict, 0) + bit(known, 1) + bit(cued, 2) + bit(apart, 3)


def located(kind: str, strict: bool, values: Column, gaps: Column) -> Column:
    """Candidates in order from a pattern's matches and the text between them."""
    each = F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.struct(F.get(values, i).alias("value"), F.get(gaps, i).alias("gap"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after")))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        before = F.right(x["gap"], F.lit(CONTEXT))
        ok = passes(kind, x["value"]) if strict else F.lit(False)
        may = F.lit(False) if strict else (luhn(F.regexp_replace(x["value"], "[^0-9]", "")) if kind == "card" else F.lit(True))
        one = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), end.alias("end"), ok.alias("base"), may.alias("loose"), votes(kind, ok, x["value"], before, x["after"]).alias("votes"),
            F.least(F.length(x["value"]).cast("int"), F.lit(24)).alias("size"), shape(F.right(before, F.lit(1))).alias("left"), shape(x["after"]).alias("right"),
        )
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    none = F.expr(f"cast(array() as array<{CANDIDATE}>)")
    # an array that grows is copied each time: blocks begin where the sums of their lengths say
    length = lambda x: F.length(x["gap"]) + F.length(x["value"])
    blocks = in_blocks(each)
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + length(x)))
    starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    within = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), add, lambda s: s["out"])
    return F.aggregate(F.array(F.struct(blocks.alias("blocks"), starts.alias("starts"))), none, lambda _, x: F.flatten(F.zip_with(x["blocks"], F.slice(x["starts"], 1, F.size(x["blocks"])), within)))


def in_blocks(x: Column) -> Column:
    """An array as an array of arrays of BLOCK elements, the last one shorter; one empty array for none."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, BLOCK))


CANDIDATE = "struct<start:int,k:int,end:int,base:boolean,loose:boolean,votes:int,size:int,left:int,right:int>"


def shape(c: Column) -> Column:
    """The class of a neighbouring character: none, white space, letter, digit, other."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\pL"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs (text among its columns) with `candidates`, all kinds together."""
    names = []
    text = F.coalesce("text", F.lit(""))
    for strict, patterns, needs in ((True, STRICT, NEEDS), (False, LOOSE, LOOSE_NEEDS)):
        for kind in KINDS:
            p, name = patterns[kind], f"_{kind}_{int(strict)}"
            values = F.regexp_extract_all(text, F.lit(p), F.lit(0))
            if kind in needs:
                seen = F.lit(False)
                for x in needs[kind]:
                    seen = seen | text.contains(x)
                values = F.when(seen, values)
            else:
                values = F.when(text.rlike("[0-9]"), values)
            # matches first; the text between them only where there are any
            docs = docs.withColumn(f"{name}v", values)
            docs = docs.withColumn(f"{name}g", F.when(F.size(f"{name}v") > 0, F.split(text, p, -1)))
            docs = docs.withColumn(name, F.when(F.size(f"{name}v") > 0, located(kind, strict, F.col(f"{name}v"), F.col(f"{name}g"))).otherwise(F.expr(f"cast(array() as array<{CANDIDATE}>)"))).drop(f"{name}v", f"{name}g")
            names.append(name)
    return docs.withColumn("candidates", F.concat(*names)).drop(*names)


def reliabilities(patterns: Column) -> Column:
    """By EM from array<struct<votes, n>>: struct<prior, hit, false_> with a rate for each labeler.

    Weak priors (a labeler is right four times in five) keep the two classes from changing places.
    """
    bit = lambda p, k: F.when(p["votes"].bitwiseAND(F.lit(1 << k)) != 0, 1.0).otherwise(0.0)

    def step(state: Column, _: Column) -> Column:
        judged = F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].cast("double").alias("n"), posterior(state, p["votes"]).alias("q")))

        def total(x: Column, f) -> Column:
            return F.aggregate(x, F.lit(0.0), lambda a, p: a + f(p))

        def again(_: Column, x: Column) -> Column:
            yes, no = total(x, lambda p: p["n"] * p["q"]), total(x, lambda p: p["n"] * (1 - p["q"]))
            hit = F.array(*((total(x, lambda p, k=k: p["n"] * p["q"] * bit(p, k)) + 4) / (yes + 5) for k in range(LABELERS)))
            false = F.array(*((total(x, lambda p, k=k: p["n"] * (1 - p["q"]) * bit(p, k)) + 1) / (no + 5) for k in range(LABELERS)))
            return F.struct(((yes + 1) / (yes + no + 2)).alias("prior"), hit.alias("hit"), false.alias("false_"))

        return F.aggregate(F.array(judged), state, again)

    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(0.8)] * LABELERS).alias("hit"), F.array(*[F.lit(0.2)] * LABELERS).alias("false_"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def posterior(state: Column, vote: Column) -> Column:
    log_odds = F.log(state["prior"]) - F.log(1 - state["prior"])
    for k in range(LABELERS):
        hit, false = F.get(state["hit"], F.lit(k)), F.get(state["false_"], F.lit(k))
        log_odds = log_odds + F.when(vote.bitwiseAND(F.lit(1 << k)) != 0, F.log(hit) - F.log(false)).otherwise(F.log(1 - hit) - F.log(1 - false))
    return 1 / (1 + F.exp(-log_odds))


def features(c: Column) -> list[Column]:
    return [F.concat_ws("|", F.lit(n), c["k"].cast("string"), c[n].cast("string")) for n in ("votes", "size", "left", "right")]


def classifier(found: DataFrame) -> DataFrame:
    """One row with `weights`, map<feature, log odds>, from documents with candidates.

    A feature is a kind with a vote pattern, a length or a neighbour's class: a
    few hundred at most. Empty without candidates.
    """
    each = found.select(F.explode("candidates").alias("c"))
    # at most 16 patterns for each kind
    counted = cut(each.groupBy(F.col("c.k").alias("k"), F.col("c.votes").alias("votes"), F.col("c.size").alias("size"), F.col("c.left").alias("left"), F.col("c.right").alias("right")).agg(F.count("*").alias("n")))
    patterns = counted.groupBy("k", "votes").agg(F.sum("n").alias("n")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    states = cut(patterns.select("k", reliabilities(F.col("patterns")).alias("state")))
    soft = counted.join(F.broadcast(states), "k").withColumn("q", posterior(F.col("state"), F.col("votes")))
    prior = soft.groupBy("k").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no"))
    row = F.struct("k", "votes", "size", "left", "right")
    by_feature = soft.select("k", "n", "q", F.explode(F.array(*features(row))).alias("feature")).groupBy("k", "feature").agg(F.sum(F.col("n") * F.col("q")).alias("a"), F.sum(F.col("n") * (1 - F.col("q"))).alias("b"))
    weighed = by_feature.join(F.broadcast(prior), "k").select("feature", (F.log((F.col("a") + 1) / (F.col("yes") + 5)) - F.log((F.col("b") + 1) / (F.col("no") + 5))).alias("w"))
    weighed = weighed.unionByName(prior.select(F.concat(F.lit("kind|"), F.col("k").cast("string")).alias("feature"), F.log((F.col("yes") + 1) / (F.col("no") + 1)).alias("w")))
    return weighed.agg(F.map_from_entries(F.collect_list(F.struct("feature", "w"))).alias("weights"))


def judged(found: DataFrame, weights: DataFrame) -> DataFrame:
    """found with `base` and `spans`, arrays of struct<start, k, end> in order of start, then kind."""
    found = found.withColumn("weights", weights.scalar())
    w = lambda key: F.coalesce(F.element_at("weights", key), F.lit(0.0))

    def likely(c: Column) -> Column:
        odds = w(F.concat(F.lit("kind|"), c["k"].cast("string")))
        for f in features(c):
            odds = odds + w(f)
        return 1 / (1 + F.exp(-odds)) >= ACCEPT

    plain = lambda x: F.array_sort(F.transform(x, lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"))))
    found = found.withColumn("base", plain(F.filter("candidates", lambda c: c["base"])))
    # base spans by blocks with their extent, so that a candidate is held against few of them
    extent = lambda block: F.struct(F.array_min(F.transform(block, lambda b: b["start"])).alias("low"), F.array_max(F.transform(block, lambda b: b["end"])).alias("high"), block.alias("block"))
    found = found.withColumn("blocks", F.transform(in_blocks(F.col("base")), extent))
    meets = lambda c, low, high: (low < c["end"]) & (c["start"] < high)
    free = lambda c: ~F.exists("blocks", lambda x: F.coalesce(meets(c, x["low"], x["high"]), F.lit(False)) & F.exists(x["block"], lambda b: meets(c, b["start"], b["end"])))
    found = found.withColumn("more", F.filter("candidates", lambda c: c["loose"] & free(c) & likely(c)))
    # no two kinds and no two matches of a kind make the same span, and what is added is free of base spans
    return found.withColumn("spans", F.when(F.size("more") > 0, F.array_sort(F.concat("base", plain(F.col("more"))))).otherwise(F.col("base"))).drop("blocks", "more", "weights")


def candidates_of(docs: DataFrame) -> DataFrame:
    """(row, text, candidates) of docs, written once: training and judging read them."""
    return cut(with_candidates(boxed(docs, "text")))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs (text among its columns) with `base` and `spans`: arrays of struct<start, k, end>.

    Offsets count code points, the end is exclusive, and k is a place in KINDS.
    A null text counts as empty. Columns `base` and `spans` of docs are replaced,
    others stay whatever their names. Repeated rows are judged alike, and each
    counts in training. No rows give no rows. Time and memory are in proportion
    to a text's length and matches.
    """
    found = candidates_of(docs.drop("base", "spans"))
    kept = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    return judged(found, cut(classifier(found.select("candidates")))).select(*unboxed(kept), "base", "spans")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind in angle brackets; of overlapping spans the first counts.

    All other columns stay as they are, whatever their names; a null text stays null.
    """
    found = candidates_of(docs)
    found = judged(found, cut(classifier(found.select("candidates"))))
    # code points are counted from the start of a string, so a long text is taken in pieces
    pieces = F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    found = found.withColumn("pieces", pieces)
    kinds = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def between(a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        some = F.array_join(F.slice("pieces", first + 1, F.floor(b / PIECE).cast("int") - first + 1), "")
        return F.substring(some, a - first * PIECE + 1, b - a)

    def add(state: Column, s: Column) -> Column:
        # what stands between the last span and this one, then the kind
        new = F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(between(state["at"], s["start"]), F.get(kinds, s["k"]))).alias("out"))
        return F.when(s["start"] >= state["at"], new).otherwise(state)

    def block(state: Column, spans: Column) -> Column:
        none = F.struct(state["at"].alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(spans, none, add, lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(s["out"], ""))).alias("out")))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.aggregate(in_blocks(F.col("spans")), none, block, lambda s: F.concat(F.array_join(s["out"], ""), between(s["at"], F.size("pieces") * PIECE)))
    new = F.when(F.size("spans") > 0, text).otherwise(F.col("text"))
    return found.select("row", new.alias("text")).select(*(F.col("text") if c == "text" else x for c, x in zip(docs.columns, unboxed(docs.columns))))


def listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(k: int) -> Callable[[Column], Column]:
    """Whether a span is of a kind. Spark gives a second parameter of a lambda the index, so k must not be one."""
    return lambda s: s["k"] == k


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = cut(with_candidates(docs).select("doc_id", "candidates"))
    spans = judged(found, cut(classifier(found)))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
