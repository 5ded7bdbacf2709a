"""Times, durations and numbers as manifests write them. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions.once import let

STAMP = r"^(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|z|[+-]\d\d(?::?\d\d)?)?$"


def unix_millis(text: Column) -> Column:
    """Milliseconds since 1970 of a manifest timestamp, digits beyond them cut; null for what is none.

    A time without an offset is taken in the session's time zone.
    """
    t = F.trim(text)
    group = lambda k: F.regexp_extract(t, STAMP, k)
    offset = F.regexp_replace(F.upper(group(4)), r"^([+-]\d\d):?(\d\d)?$", "$1:$2")
    offset = F.when(offset.endswith(":"), F.concat(offset, F.lit("00"))).otherwise(offset)
    seconds = F.unix_timestamp(F.try_to_timestamp(F.concat(group(1), F.lit("T"), group(2), offset)))
    millis = F.rpad(F.left(group(3), F.lit(3)), 3, "0").cast("long")
    return F.when(t.rlike(STAMP) & ~t.rlike("^0000"), seconds * 1000 + millis)


def iso_duration(text: Column) -> Column:
    """Seconds of PnDTnHnMnS; null for other forms, those with years, months or weeks among them."""
    form = r"^P(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    total = F.lit(0.0)
    for k, unit in enumerate((86_400, 3_600, 60, 1), 1):
        part = F.regexp_extract(text, form, k)
        total = total + F.coalesce(F.when(part != "", part.try_cast("double")), F.lit(0.0)) * unit
    return F.when(text.rlike(form), total)


def colon_seconds(text: Column) -> Column:
    """Seconds of d:h:m:s or less; full-width colons count, parts before the last four do not."""

    def added(parts: Column) -> Column:
        total = F.lit(0).cast("long")
        for k, unit in enumerate((1, 60, 3_600, 86_400)):
            total = total + F.coalesce(F.get(parts, F.lit(k)).try_cast("long"), F.lit(0)) * unit
        return total

    return let(F.reverse(F.split(F.replace(text, F.lit("\uff1a"), F.lit(":")), ":")), added)


def cue_millis(text: Column) -> Column:
    """Milliseconds of a subtitle time: [[h:]m:]s[.fff], or seconds with an s. Fraction digits beyond three are not scaled."""
    return let(F.replace(F.trim(text), F.lit(","), F.lit(".")), _cue_millis)


def _cue_millis(t: Column) -> Column:
    whole, fraction = F.substring_index(t, ".", 1), F.when(t.contains("."), F.regexp_extract(t, r"\.(.*)$", 1)).otherwise("")
    parts = F.reverse(F.split(whole, ":"))
    total = F.aggregate(F.transform(parts, lambda p, i: p.try_cast("long") * F.pow(F.lit(60.0), i).cast("long") * 1000), F.lit(0).cast("long"), lambda a, x: a + x)
    padded = F.concat(fraction, F.repeat(F.lit("0"), F.greatest(3 - F.length(fraction), F.lit(0))))
    seconds = F.round(F.regexp_replace(t, "s$", "").try_cast("double") * 1000).cast("long")
    return F.when(t.endswith("s"), seconds).otherwise(total + padded.try_cast("long"))


def clock(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def short_duration(seconds: Column) -> Column:
    """~MMmSSs, with hours where there are any; null for negative, infinite or missing durations."""
    s = F.floor(seconds).cast("long")
    minutes = F.format_string("%02dm%02ds", F.floor(s / 60) % 60, s % 60)
    return F.when((seconds >= 0) & ~F.isnan(seconds) & (seconds < float("inf")), F.concat(F.lit("~"), F.when(s >= 3600, F.format_string("%02dh", F.floor(s / 3600))).otherwise(""), minutes))


def manifest_number(text: Column) -> Column:
    """A number with commas between its integer digits, or NaN; null for others and infinities."""
    t = F.trim(text)
    ok = t.rlike(r"^[+-]?(?:\d[\d,]*)?(?:\.\d*)?(?:[eE][+-]?\d+)?$") & t.rlike(r"\d")
    x = F.when(ok, F.replace(t, F.lit(","), F.lit("")).try_cast("double"))
    return F.when(t == "NaN", F.lit(float("nan"))).when(F.abs(x) < float("inf"), x)


def refresh_interval(ms: Column) -> Column:
    """Whole milliseconds in the range of 32 bits; the least of that range for what is outside."""
    fits = ~F.isnan(ms) & (ms >= -(2.0**31)) & (ms < 2.0**31)
    return F.when(fits, F.when(ms < 0, F.ceil(ms)).otherwise(F.floor(ms)).cast("double")).otherwise(F.lit(-(2.0**31)))


def frame_rate(text: Column) -> Column:
    """n/d with three decimals; null without a slash."""
    n, d = F.substring_index(text, "/", 1).try_cast("double"), F.substring_index(text, "/", -1).try_cast("double")
    return F.when(text.contains("/") & (d != 0), F.round(n / d, 3))


def bandwidth_bps(kbps: Column) -> Column:
    """Kilobits as bits, held within 64 bits."""
    return F.coalesce(F.try_multiply(kbps.cast("long"), F.lit(1000).cast("long")), F.when(kbps < 0, F.lit(-(2**63))).otherwise(F.lit(2**63 - 1)))
