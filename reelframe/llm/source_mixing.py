"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domains, languages and sources. At each node
the children share what it has by weight; a child that cannot use its share
(it holds no more than its tokens, times the epochs allowed) passes the rest to
its siblings, and only what all siblings cannot use goes to the node above. A
leaf then takes whole passes over its documents and, of one more epoch in an
order seeded for that epoch, the longest prefix that fits.

Plan: one pass writes (doc_id, leaf, tokens); the tree has a row per leaf. A
leaf may hold a third of all documents, so no leaf is ever sorted whole: token
sums of BUCKETS hash ranges per leaf locate the one range in which the prefix
ends, and only that range is ordered. The result is a cut point per leaf, so
choosing the documents is a map. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import boxed, cut, table, unboxed

DOMAIN_WEIGHTS = {"web": 5, "books": 3, "news": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 1, "es": 1}
#: Weight of a domain or language that is not listed; sources have equal weights.
OTHER_WEIGHT = 1
BUDGET_PERCENT = 60
EPOCHS = 2
SEED = 17
#: Hash ranges of a leaf (a power of 16), told apart by this many hex digits.
BUCKET_DIGITS = 3
#: A leaf table of up to so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 50_000
LEAF = ["domain", "lang", "source"]
WORD = "[^\\x20\\x09-\\x0D]+"


def domain_of(source: Column) -> Column:
    """The crawl is src0; src1 to src9 count as books, other sources as news."""
    return F.when(source == "src0", "web").when(source.rlike("^src[1-9]$"), "books").otherwise("news")


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out.cast("long")


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent columns, name, weight, room, budget of the parent) with `given`.

    Children in order of room per weight are satisfied one by one while their
    share of what is left covers their room; those after them split the rest by
    weight. Shares are rounded down.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("room") / F.col("weight"), name)
    x = children.withColumns({
        "nth": F.row_number().over(order),
        "used": F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weights": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    x = x.withColumn("full", F.col("room") * F.col("weights") <= (F.col("budget") - F.col("used")) * F.col("weight"))
    x = x.withColumn("open", F.min(F.when(~F.col("full"), F.struct("nth", "used", "weights"))).over(by))
    given = F.when(F.col("open").isNull() | (F.col("nth") < F.col("open.nth")), F.col("room")).otherwise(F.expr("(budget - open.used) * weight div open.weights"))
    return x.withColumn("given", given).drop("nth", "used", "weights", "full", "open")


def budgets(leaves: DataFrame, percent: int, epochs: int) -> DataFrame:
    """Leaves (LEAF, tokens) with the tokens `given` to each."""
    leaves = leaves.withColumn("room", F.col("tokens") * epochs)
    root = leaves.agg(F.expr(f"coalesce(sum(tokens), 0L) * {percent} div 100").alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("room").alias("room")).withColumns({"weight": weight_of(F.col("domain"), DOMAIN_WEIGHTS), "budget": root.scalar()})
    domains = share(domains, [], "domain").select("domain", F.col("given").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("room").alias("room")).withColumn("weight", weight_of(F.col("lang"), LANG_WEIGHTS)).join(domains, "domain")
    langs = share(langs, ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    return share(leaves.withColumn("weight", F.lit(1).cast("long")).join(langs, ["domain", "lang"]), ["domain", "lang"], "source").select(*LEAF, "tokens", "given")


def with_leaf(docs: DataFrame) -> DataFrame:
    """docs with its leaf in a struct `leaf`; null languages and sources are the empty string."""
    source = F.coalesce("source", F.lit(""))
    return docs.withColumn("leaf", F.struct(domain_of(source).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), source.alias("source")))


def place(seed: int) -> Column:
    """A document's place in the order of epoch `passes`: its hash, and its id among equal hashes."""
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col("passes").cast("string"), F.lit(":"), ids)).alias("hash"), F.coalesce("doc_id", F.lit(-1)).alias("id"))


def joined(docs: DataFrame, leaves: DataFrame, small: bool) -> DataFrame:
    return docs.join(F.broadcast(leaves) if small else leaves, "leaf")


def cuts(docs: DataFrame, percent: int, epochs: int, seed: int) -> tuple[DataFrame, bool]:
    """(leaf, passes, rest, bucket, last) of each leaf, and whether these rows are few.

    docs: (doc_id, leaf, n_tokens). A leaf takes `passes` whole epochs and, where
    rest > 0, the documents of the next epoch in ranges before `bucket`, or in
    it at places up to `last`.
    """
    totals = docs.groupBy("leaf").agg(F.sum("n_tokens").alias("tokens"))
    given = budgets(totals.select("leaf.*", "tokens"), percent, epochs)
    leaves = cut(given.select(F.struct(*LEAF).alias("leaf"), F.expr("case when tokens > 0 then given div tokens else 0L end").alias("passes"), F.expr("case when tokens > 0 then given % tokens else 0L end").alias("rest")))
    small = leaves.count() <= BROADCAST_ROWS
    placed = joined(docs, leaves.where("rest > 0"), small).withColumn("place", place(seed)).withColumn("bucket", F.substring("place.hash", 1, BUCKET_DIGITS))
    order = Window.partitionBy("leaf").orderBy("bucket")
    ranges = placed.groupBy("leaf", "rest", "bucket").agg(F.sum("n_tokens").alias("n")).withColumn("upto", F.sum("n").over(order))
    ends = cut(ranges.where("upto > rest").groupBy("leaf").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("end")).select("leaf", "end.*"))
    inside = placed.join(F.broadcast(ends) if small else ends, ["leaf", "bucket"])
    within = Window.partitionBy("leaf").orderBy("place")
    last = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(within)).where("upto <= rest").groupBy("leaf").agg(F.max("place").alias("last"))
    return cut(leaves.join(ends.drop("before"), "leaf", "left").join(last, "leaf", "left")), small


def chosen(docs: DataFrame, found: tuple[DataFrame, bool], seed: int) -> DataFrame:
    """docs (doc_id, leaf and others) with `copies`, how often each is taken; those not taken go."""
    leaves, small = found
    placed = joined(docs, leaves, small).withColumn("place", place(seed))
    bucket = F.substring("place.hash", 1, BUCKET_DIGITS)
    more = (F.col("rest") > 0) & ((bucket < F.col("bucket")) | ((bucket == F.col("bucket")) & F.coalesce(F.col("place") <= F.col("last"), F.lit(False))))
    copies = F.col("passes") + F.when(more, 1).otherwise(0)
    return placed.withColumn("copies", copies).where("copies > 0").select(*docs.columns, "copies")


def mix(docs: DataFrame, percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents taken, each with `copies`, the number of epochs that take it.

    docs: (doc_id, text, lang, source) among other columns. Tokens are runs
    without white space; a null text has none. A null language or source is a
    leaf of its own. Rows that share an id and a leaf have the same place and
    are taken together. A column `copies` of docs is replaced, others stay
    whatever their names. An empty table gives no rows.
    """
    kept = docs.drop("copies")
    rows = with_leaf(boxed(kept, "doc_id", "text", "lang", "source"))
    counted = cut(rows.select("doc_id", "leaf", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")))
    return chosen(rows.select("row", "doc_id", "leaf"), cuts(counted, percent, epochs, seed), seed).select(*unboxed(kept.columns), "copies")


def op7_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = cut(with_leaf(docs).select("doc_id", "leaf", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")))
    taken = chosen(counted, cuts(counted, BUDGET_PERCENT, EPOCHS, SEED), SEED)
    return taken.select("doc_id", "leaf.*", "n_tokens", "copies")


def _case(name: str, weights: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {OTHER_WEIGHT} END"


def _share_sql(children: str, parent: str, name: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    order = f"{part} ORDER BY room / weight, {name}"
    return f"""(WITH a AS (SELECT *, row_number() OVER ({order}) AS nth,
      coalesce(sum(room) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
      sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM {children}),
    b AS (SELECT *, room * weights <= (budget - used) * weight AS is_full FROM a),
    c AS (SELECT *, min(CASE WHEN NOT is_full THEN nth END) OVER ({part}) AS first_open FROM b),
    d AS (SELECT *, max(CASE WHEN nth = first_open THEN used END) OVER ({part}) AS u, max(CASE WHEN nth = first_open THEN weights END) OVER ({part}) AS w FROM c)
    SELECT *, CASE WHEN first_open IS NULL OR nth < first_open THEN room ELSE (budget - u) * weight // w END AS given FROM d)"""


OP7_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN coalesce(source, '') = 'src0' THEN 'web' WHEN regexp_matches(coalesce(source, ''), '^src[1-9]$') THEN 'books' ELSE 'news' END AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {EPOCHS} AS room, 1 AS weight FROM d GROUP BY ALL),
dom AS (SELECT domain, sum(room) AS room, {_case("domain", DOMAIN_WEIGHTS)} AS weight, (SELECT sum(tokens) * {BUDGET_PERCENT} // 100 FROM leaf) AS budget FROM leaf GROUP BY domain),
dom_given AS {_share_sql("dom", "", "domain")},
lng AS (SELECT l.domain, l.lang, sum(l.room) AS room, {_case("l.lang", LANG_WEIGHTS)} AS weight, any_value(g.given) AS budget FROM leaf l JOIN dom_given g USING (domain) GROUP BY l.domain, l.lang),
lng_given AS {_share_sql("lng", "domain", "lang")},
lea AS (SELECT l.*, g.given AS budget FROM leaf l JOIN lng_given g USING (domain, lang)),
lea_given AS {_share_sql("lea", "domain, lang", "source")},
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS passes, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM lea_given),
o AS (SELECT d.*, p.passes, p.rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
  ORDER BY md5('{SEED}:' || CAST(p.passes AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), coalesce(doc_id, -1)) AS upto FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM o WHERE passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""
