"""Query parameters of URLs as an ordered list of pairs, keys repeated or not. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_of(url: Column) -> Column:
    """What stands between the first ? and a #; empty if there is none."""
    return F.regexp_extract(url, r"^[^?]*\?([^#]*)", 1)


def decoded(text: Column) -> Column:
    """Form coding undone: + is a space, %xx a byte of UTF-8; a percent sign without two hex digits stays."""
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def encoded(text: Column) -> Column:
    """Form coding: letters, digits and -_.!*() stay, a space is +, other bytes are %xx in lower case."""
    pieces = F.split(F.url_encode(text), "%")
    small = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.concat(F.lit("%"), F.lower(F.substring(p, 1, 2)), F.substring(p, 3, 1 << 20)))
    out = F.concat(F.get(pieces, F.lit(0)), F.array_join(small, ""))
    for code, mark in (("%21", "!"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def pairs(query: Column) -> Column:
    """array<struct<key, value, has>> of a query in order; has: whether there is an equals sign. Empty parts and question marks at the end go."""
    parts = F.filter(F.split(F.regexp_replace(query, r"\?+$", ""), "&"), lambda p: p != "")
    key, value = (lambda p: F.substring_index(p, "=", 1)), (lambda p: F.regexp_extract(p, "^[^=]*=(?s:(.*))$", 1))
    return F.transform(parts, lambda p: F.named_struct(F.lit("key"), decoded(key(p)), F.lit("value"), decoded(value(p)), F.lit("has"), p.contains("=")))


def joined(listed: Column) -> Column:
    """One pair a key, where it first stands; values that are not empty are joined by commas."""

    def one(key: Column) -> Column:
        own = F.filter(listed, lambda p: p["key"] == key)
        value = F.array_join(F.filter(F.transform(own, lambda p: p["value"]), lambda v: v != ""), ",")
        return F.named_struct(F.lit("key"), key, F.lit("value"), value, F.lit("has"), F.exists(own, lambda p: p["has"]))

    return F.transform(F.array_distinct(F.transform(listed, lambda p: p["key"])), one)


def overridden(target: Column, source: Column) -> Column:
    """target with the pairs of source (one a key): the first pair of a key takes its value, others of that key go; new keys and keys without a value come behind."""
    with_value = F.filter(source, lambda s: s["has"])
    new = lambda p: F.try_element_at(F.filter(with_value, lambda s: s["key"] == p["key"]), F.lit(1))
    firsts = F.transform(target, lambda p, i: F.named_struct(F.lit("p"), p, F.lit("first"), F.array_position(F.transform(target, lambda t: t["key"]), p["key"]) == i + 1, F.lit("new"), new(p)))
    kept = F.transform(F.filter(firsts, lambda x: x["first"] | x["new"].isNull()), lambda x: F.coalesce(x["new"], x["p"]))
    known = F.transform(target, lambda p: p["key"])
    return F.concat(kept, F.filter(source, lambda s: ~s["has"] | ~F.array_contains(known, s["key"])))


def written(listed: Column) -> Column:
    return F.array_join(F.transform(listed, lambda p: F.concat(encoded(p["key"]), F.when(p["has"], F.concat(F.lit("="), encoded(p["value"]))).otherwise(""))), "&")


def with_query_of(url: Column, source: Column) -> Column:
    """url with the parameters of another URL put over its own, and without its fragment; as it is where the other has none."""
    all_ = overridden(pairs(query_of(url)), joined(pairs(query_of(source))))
    path = F.regexp_extract(url, "^[^?#]*", 0)
    return F.when(query_of(source) == "", url).when(F.size(all_) == 0, path).otherwise(F.concat(path, F.lit("?"), written(all_)))
