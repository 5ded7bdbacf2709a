"""Option texts as columns: values by key with escaped colons, ranges, durations in units, headers, start times, and filters from text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions import moments
from reelframe.functions.once import let
from reelframe.operators.select import StreamFilter

#: What stands for the open end of a range.
LAST_INDEX, LAST_SECOND = 2**63 - 1, 1.7976931348623157e308
#: A filter's options and the fields that they set.
PATTERNS = {"id": "group_id", "lang": "language", "name": "name", "codecs": "codecs", "res": "resolution", "frame": "frame_rate", "channel": "channels", "range": "video_range", "url": "url"}
COUNTS, DURATIONS, BANDWIDTHS = {"segsMin": "segments_min", "segsMax": "segments_max"}, {"plistDurMin": "duration_min", "plistDurMax": "duration_max"}, {"bwMin": "bandwidth_min", "bwMax": "bandwidth_max"}
CHOICE = re.compile(r"all|(?:best|worst)\d*")


def option(text: Column, key: str) -> Column:
    """struct<value, error> of a key in "k=v:k2=v2", null if it is not there.

    A value goes up to a colon without a backslash before it. Where it has
    colons with one, backslashes up to the last of them go. White space and
    quotes around it go; quotes within are an error. A key without a value that ends the text is "true".
    """
    rest = F.regexp_extract(text, f"(?s)^.*?{re.escape(key)}=(.*)$", 1)
    own = F.regexp_extract(rest, r"(?s)^((?:[^:]|(?<=\\):)*)", 1)
    head, tail = F.regexp_extract(own, r"(?s)^(.*)\\:(?:.*)$", 1), F.regexp_extract(own, r"(?s)^.*\\:(.*)$", 1)
    plain = F.when(own.contains("\\:"), F.concat(F.replace(head, F.lit("\\"), F.lit("")), F.lit(":"), tail)).otherwise(own)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"(?U)^\s+|\s+$", ""), '^"+|"+$', ""), "^'+|'+$", "")
    bad = clean.rlike("[\"']")
    found = F.struct(F.when(~bad, clean).alias("value"), F.when(bad, "quotes").alias("error"))
    flag = F.struct(F.lit("true").alias("value"), F.lit(None).cast("string").alias("error"))
    return F.when(text.contains(f"{key}="), found).when(text.endswith(key), flag)


def unit_seconds(text: Column) -> Column:
    """Seconds of hours, minutes and seconds like 1h2m3s, in that order, each once at most; null for anything else."""
    of = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+){unit}", 1).try_cast("int").cast("long"), F.lit(0))
    fits = text.rlike(r"^(?=.)(?:\d+h)?(?:\d+m)?(?:\d+s)?$") & ~text.rlike(r"\d{11}")
    return F.when(fits, (of("h") * 3600 + of("m") * 60 + of("s")).cast("double"))


def custom_range(text: Column) -> Column:
    """struct<kind, first, last, start, end, error> of "a-b": segments by index, or times where there is a colon; an open start is 0. Null for an empty text."""
    return let(F.struct(text.alias("text"), F.transform(F.split(text, "-"), lambda p: F.trim(p)).alias("parts")), lambda x: _custom_range(x["text"], x["parts"]))


def _custom_range(text: Column, parts: Column) -> Column:
    time = lambda k, empty: let(F.get(parts, k), lambda t: F.when(t == "", F.lit(empty)).when(t.rlike(r"^\s*[+-]?\d+\s*([:：]\s*[+-]?\d+\s*)*$"), moments.colon_seconds(t).cast("double")))
    index = lambda pattern, empty: let(F.regexp_extract(text, pattern, 1), lambda t: F.when(t == "", F.lit(empty)).otherwise(t.try_cast("long")))
    timed = text.contains(":")
    bounds = F.struct(index(r"^[^-]*?(\d*)-", 0).alias("first"), index(r"^[^-]*-(\d*)", LAST_INDEX).alias("last"), time(0, 0.0).alias("start"), time(1, LAST_SECOND).alias("end"))

    def checked(b: Column) -> Column:
        error = F.when(F.size(parts) != 2, "start-end").when(timed & (b["start"].isNull() | b["end"].isNull()), "time").when(~timed & (b["first"].isNull() | b["last"].isNull()), "index")
        return F.struct(b.alias("b"), error.alias("error"))

    def told(x: Column) -> Column:
        good, b = x["error"].isNull(), x["b"]
        return F.struct(F.when(good, F.when(timed, "time").otherwise("segment")).alias("kind"), F.when(good & ~timed, b["first"]).alias("first"), F.when(good & ~timed, b["last"]).alias("last"), F.when(good & timed, b["start"]).alias("start"), F.when(good & timed, b["end"]).alias("end"), x["error"].alias("error"))

    return F.when(text != "", let(let(bounds, checked), told))


def header(text: Column) -> Column:
    """struct<name, value> of "Name: value", the name in lower case; null without a colon."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(text.contains(":"), F.struct(F.lower(trim(F.substring_index(text, ":", 1))).alias("name"), trim(F.regexp_extract(text, "(?s)^[^:]*:(.*)$", 1)).alias("value")))


def start_time(text: Column) -> Column:
    """A timestamp from 14 digits, year to second; null for anything else."""
    return F.when(text.rlike(r"^\d{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


def wait_until(text: Column, now: Column) -> Column:
    """Seconds from one such text to another; null where the time is not ahead."""
    ahead = F.unix_seconds(start_time(text)) - F.unix_seconds(start_time(now))
    return F.when(ahead > 0, ahead)


def signed_value(path: Column, secret: Column, now_ms: Column, shift_ms: Column | int = 0) -> Column:
    """What signs a path for a minute from now: the md5 of time, path and secret in base64 with - and _, and the time."""
    at = (now_ms + 60_000 + shift_ms).cast("string")
    digest = F.base64(F.unhex(F.md5(F.concat(at, path, secret).cast("binary"))))
    return F.concat(F.translate(digest, "+/", "-_"), F.lit(","), at)


def version_behind(version: Column, tag: Column) -> Column:
    """Whether a release's tag, with or without a v, is another version than this one."""
    return F.regexp_replace(F.trim(tag), "^v+", "") != F.regexp_replace(F.trim(version), "^v+", "")


def _value(text: str, key: str) -> str | None:
    """option() for one text in the driver."""
    at = text.find(f"{key}=")
    if at < 0:
        return "true" if text.endswith(key) else None
    own = re.match(r"(?:[^:]|(?<=\\):)*", text[at + len(key) + 1 :], re.S)[0]
    head, colon, tail = own.rpartition("\\:")
    clean = (head.replace("\\", "") + ":" + tail if colon else own).strip().strip('"').strip("'")
    if '"' in clean or "'" in clean:
        raise ValueError(f"quotes within the value of {key}")
    return clean


def stream_filter(text: str) -> StreamFilter:
    """A filter from text like "lang=en:res=1080*:for=best2", or a choice alone like "all"; ValueError for what it cannot be."""
    get = lambda key: _value(text, key) or None
    choice = text if CHOICE.fullmatch(text) else _value(text, "for")
    choice = "best" if choice is None else choice
    if choice and not CHOICE.fullmatch(choice):
        raise ValueError(f"for={choice}")
    fields: dict = {"choice": choice}
    for key, field in PATTERNS.items():
        if (value := get(key)) is not None:
            re.compile(value)
            fields[field] = value
    for key, field in COUNTS.items():
        if (value := get(key)) is not None:
            fields[field] = int(value)
    for key, field in BANDWIDTHS.items():
        if (value := get(key)) is not None:
            fields[field] = int(value) * 1000
    for key, field in DURATIONS.items():
        if (value := get(key)) is not None:
            found = re.fullmatch(r"(?=.)(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?", value)
            if not found:
                raise ValueError(f"{key}={value}")
            fields[field] = float(sum(int(n or 0) * unit for n, unit in zip(found.groups(), (3600, 60, 1))))
    if (role := get("role")) is not None:
        fields["role"] = role
    return StreamFilter(**fields)
