"""URL filter: listed rules first, then a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of rejected
URLs, give each character a probability after the ORDER characters before it in
its token, backed by every shorter context as far as the longer ones were seen
(Witten-Bell weights). A token is a run of delimiters with the characters that
follow it, so whole words are learned as far as the table supports them. A
URL's score is the difference of the log-likelihoods divided by its length; the
limit is the one with the least balanced error on labelled URLs that the models
have not seen.

Plan: what repeats is counted once. Distinct URLs give distinct tokens, these
give distinct grams (a character with the longest context that it has), and
only grams meet the counts, by two joins. The model is a table of grams that
grows with the URLs; nothing of it is sent to the driver, and what grows is
joined by sorting: a table's file may be small enough to be broadcast and its
rows too many for the driver to hold.
Everything is DataFrame functions; log ratios are scaled to integers so that
sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import boxed, cut, table, unboxed

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Characters of the longest context. ^ stands before a token, $ after it.
ORDER = 10
#: Rows of counts of short grams and of short contexts up to which they are broadcast: any gram joins them.
SHORT_ROWS = 50_000
#: The probability of a character that no context says anything about.
UNIFORM = 1 / 256
DELIMITERS = "/?#&=:.@_~%+-"
TOKEN = f"[{DELIMITERS}]+[^{DELIMITERS}]*|[^{DELIMITERS}]+"
#: Parts of a nat in a log ratio, and in a step of the limit.
SCALE = 65_536
STEP = 1_024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: First hex digits of a URL's md5 that set it aside for the limit.
HELD_OUT = ("0", "1", "2")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without :// or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """A URL's tokens, A-Z lower-cased; none for null or the empty string."""
    return F.regexp_extract_all(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def grams(token: Column) -> Column:
    """Each character of a token, and its end, with the up to ORDER characters before it."""
    # split into characters once: substring() would scan from the start each time
    each = F.split(F.concat(F.lit("^"), token, F.lit("$")), "")
    found = lambda c: F.transform(F.sequence(F.lit(2), F.size(c)), lambda i: F.array_join(F.slice(c, F.greatest(i - ORDER, F.lit(1)), F.least(i, F.lit(ORDER + 1))), ""))
    return F.aggregate(F.array(each), F.array().cast("array<string>"), lambda _, c: found(c))


def ends(gram: Column) -> Column:
    """A gram with its context shortened step by step, the bare character first."""
    return F.transform(F.sequence(F.lit(1), F.length(gram)), lambda k: F.right(gram, k))


def before(gram: Column) -> Column:
    return F.substring(gram, F.lit(1), F.length(gram) - 1)


def counts(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How often each gram, and each context with how many characters, occurs among accepted and rejected URLs.

    urls: (url, accepted, n). Returns (own, a, r) and (context, total_a, kinds_a, total_r, kinds_r).
    """
    side = lambda c, yes: F.sum(F.when(F.col("accepted") == yes, F.col(c)).otherwise(0))
    token = urls.select("accepted", "n", F.explode(tokens(F.col("url"))).alias("token")).groupBy("token").agg(side("n", True).alias("a"), side("n", False).alias("r"))
    gram = token.select("a", "r", F.explode(grams(F.col("token"))).alias("gram")).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    own = cut(gram.select("a", "r", F.explode(ends(F.col("gram"))).alias("own")).groupBy("own").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long"))
    context = own.groupBy(before(F.col("own")).alias("context")).agg(F.sum("a").alias("total_a"), kinds("a").alias("kinds_a"), F.sum("r").alias("total_r"), kinds("r").alias("kinds_r"))
    return own, context


def ratios(gram: DataFrame, own: DataFrame, context: DataFrame) -> DataFrame:
    """(gram, ratio): the scaled log ratio of each distinct gram's last character.

    Both models smooth to the same uniform distribution, so without any labelled
    URL every ratio is zero.
    """
    each = gram.select("gram", F.explode(ends(F.col("gram"))).alias("own")).withColumn("context", before(F.col("own")))
    # the empty context and single characters stand behind nearly every gram: as keys of an exchange they would be hot
    short = lambda df, c, n: df.where(F.length(c) <= n)
    few_own, few = short(own, "own", 2), short(context, "context", 1)
    if few_own.count() <= SHORT_ROWS and few.count() <= SHORT_ROWS:
        near = short(each, "own", 2).join(F.broadcast(few_own), "own", "left").join(F.broadcast(few), "context", "left")
        far = each.where(F.length("own") > 2).join(own.hint("merge"), "own", "left").join(context.hint("merge"), "context", "left")
        each = near.unionByName(far)
    else:
        each = each.join(own.hint("merge"), "own", "left").join(context.hint("merge"), "context", "left")
    known = [F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "r", "total_a", "kinds_a", "total_r", "kinds_r")]
    # at most ORDER + 1 rows a gram
    levels = each.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct(F.length("own").alias("k"), *known))).alias("levels"))

    def chance(n: str) -> Column:
        step = lambda p, x: F.when(x[f"total_{n}"] > 0, (x[n] + x[f"kinds_{n}"] * p) / (x[f"total_{n}"] + x[f"kinds_{n}"])).otherwise(p)
        return F.aggregate("levels", F.lit(UNIFORM), step)

    return levels.select("gram", F.floor((F.log(chance("a")) - F.log(chance("r"))) * SCALE).alias("ratio"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (url among its columns) with host, path, rule, verdict and score.

    A null URL, or one without ://, has an empty host and path and fits no rule.
    The models read the whole URL; null and the empty string score zero.
    Repeated rows are judged alike, and each counts in training. Without
    labelled URLs of both kinds the method allows everything. Columns of those
    five names are replaced, others stay whatever their names. No rows give no
    rows.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "score")]
    rows = boxed(pages.select(*(F.col(f"`{c}`") for c in kept)), F.coalesce("url", F.lit("")).alias("url"))
    host, path = parts(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    distinct = rows.groupBy("url").agg(F.count("*").alias("n"))
    held_out = F.substring(F.md5("url"), 1, 1).isin(*HELD_OUT)
    urls = cut(distinct.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "by_rule": verdict}).withColumns({"accepted": F.col("by_rule") == "allow", "held_out": held_out}))
    own, context = counts(urls.where("accepted is not null and not held_out"))
    token = cut(urls.select(F.explode(tokens(F.col("url"))).alias("token")).distinct())
    gram = token.select("token", F.explode(grams(F.col("token"))).alias("gram"))
    by_gram = cut(ratios(gram.select("gram").distinct(), own, context))
    by_token = cut(gram.join(by_gram.hint("merge"), "gram").groupBy("token").agg(F.sum("ratio").alias("total"), F.count("*").alias("length")))
    total = urls.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(by_token.hint("merge"), "token").groupBy("url").agg(F.floor(F.sum("total") / F.sum("length").cast("double")).alias("score"))
    scored = cut(urls.join(total.hint("merge"), "url", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long"))))

    step = F.floor(F.col("score") / F.lit(float(STEP)))
    held = scored.where("accepted is not null and held_out").groupBy(step.alias("step")).agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(~F.col("accepted"), F.col("n")).otherwise(0)).alias("bad"))
    # a row for each step of the limit: bounded by the range of a mean log ratio
    earlier, every = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    errors = held.select(
        "step",
        (F.coalesce(F.sum("good").over(earlier), F.lit(0)) * F.sum("bad").over(every) + (F.sum("bad").over(every) - F.coalesce(F.sum("bad").over(earlier), F.lit(0))) * F.sum("good").over(every)).alias("error"),
    )
    limit = cut(errors.agg(F.coalesce(F.min_by("step", F.struct("error", F.abs("step"), "step")), F.lit(0).cast("long")).alias("limit")))
    by_model = F.when(step >= limit.scalar(), "allow").otherwise("block")
    judged = scored.select("url", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")
    return rows.join(judged.hint("merge"), "url").select(*unboxed(kept), "host", "path", "rule", "verdict", "score")


def op2_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _rule_sql(column: int) -> str:
    case = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[column]}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    return f"CASE{case} END"


def _chance_sql(n: str) -> str:
    """Columns p{n}1 to the last, each by the one before it."""
    step = lambda k, p: f"CASE WHEN coalesce(t{n}{k}, 0) > 0 THEN (coalesce({n}{k}, 0) + k{n}{k} * {p}) / (t{n}{k} + k{n}{k}) ELSE {p} END AS p{n}{k}"
    return ", ".join(step(k, repr(UNIFORM) if k == 1 else f"p{n}{k - 1}") for k in range(1, ORDER + 2))


_LEVELS = range(1, ORDER + 2)
OP2_SQL = f"""
WITH x AS (SELECT coalesce(url, '') AS url, count(*) AS n FROM pages GROUP BY ALL),
y AS (SELECT url, n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM x),
z AS (SELECT url, n, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM y),
j AS (SELECT url, n, host, path, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS by_rule, substr(md5(url), 1, 1) IN ('0', '1', '2') AS held_out,
  regexp_extract_all(translate(url, '{UPPER}', '{LOWER}'), '{TOKEN}') AS tokens FROM z),
t AS (SELECT url, n, by_rule, held_out, unnest(tokens) AS token FROM j),
w AS (SELECT DISTINCT token, '^' || token || '$' AS s FROM t),
g AS (SELECT token, unnest(list_transform(range(2, length(s) + 1), lambda i: substr(s, greatest(i - {ORDER}, 1), least(i, {ORDER + 1})))) AS gram FROM w),
gc AS (SELECT gram, sum(CASE WHEN by_rule = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN by_rule = 'block' THEN n ELSE 0 END) AS r
  FROM t JOIN g USING (token) WHERE by_rule IS NOT NULL AND NOT held_out GROUP BY gram),
e AS (SELECT a, r, unnest(list_transform(range(1, length(gram) + 1), lambda k: right(gram, k))) AS own FROM gc),
o AS (SELECT own, sum(a) AS a, sum(r) AS r FROM e GROUP BY own),
c AS (SELECT substr(own, 1, length(own) - 1) AS context, sum(a) AS ta, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS ka, sum(r) AS tr, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS kr FROM o GROUP BY ALL),
d AS (SELECT DISTINCT gram FROM g),
u AS (SELECT gram, k, right(gram, k) AS own, substr(right(gram, k), 1, k - 1) AS context FROM d, (SELECT unnest(range(1, {ORDER + 2})) AS k) WHERE k <= length(gram)),
v AS (SELECT gram, {", ".join(f"max(CASE WHEN k = {k} THEN {c} END) AS {c}{k}" for k in _LEVELS for c in ("a", "r", "ta", "ka", "tr", "kr"))}
  FROM (SELECT u.gram, u.k, o.a::DOUBLE AS a, o.r::DOUBLE AS r, c.ta::DOUBLE AS ta, c.ka::DOUBLE AS ka, c.tr::DOUBLE AS tr, c.kr::DOUBLE AS kr FROM u LEFT JOIN o USING (own) LEFT JOIN c USING (context)) GROUP BY gram),
q AS (SELECT gram, {_chance_sql("a")}, {_chance_sql("r")} FROM v),
m AS (SELECT gram, CAST(floor((ln(pa{ORDER + 1}) - ln(pr{ORDER + 1})) * {SCALE}) AS BIGINT) AS ratio FROM q),
b AS (SELECT token, sum(ratio) AS total, count(*) AS length FROM g JOIN m USING (gram) GROUP BY token),
sc AS (SELECT url, CAST(floor(sum(total) / CAST(sum(length) AS DOUBLE)) AS BIGINT) AS score FROM t JOIN b USING (token) GROUP BY url),
f AS (SELECT j.*, coalesce(sc.score, 0) AS score FROM j LEFT JOIN sc USING (url)),
h AS (SELECT floor(score / {STEP}.0) AS step, sum(CASE WHEN by_rule = 'allow' THEN n ELSE 0 END) AS good, sum(CASE WHEN by_rule = 'block' THEN n ELSE 0 END) AS bad
  FROM f WHERE by_rule IS NOT NULL AND held_out GROUP BY ALL),
er AS (SELECT step, coalesce(sum(good) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * sum(bad) OVER ()
  + (sum(bad) OVER () - coalesce(sum(bad) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * sum(good) OVER () AS error FROM h),
l AS (SELECT coalesce((SELECT step FROM er ORDER BY error, abs(step), step LIMIT 1), 0) AS lim)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN floor(score / {STEP}.0) >= lim THEN 'allow' ELSE 'block' END) AS verdict, score
FROM pages p JOIN f ON coalesce(p.url, '') = f.url, l
"""
