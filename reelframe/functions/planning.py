"""What a session decides from its settings and counters: levels, progress, outputs, numbers. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions import text as names

#: Log levels from low to high, codecs that can be encoded, methods that leave samples whole.
LEVELS = ("Debug", "Info", "Warn", "Error", "Off")
VIDEO_CODECS = ("avc1", "h264", "hvc1", "hev1", "hevc", "dvhe", "dvh1")
AUDIO_CODECS = ("mp4a", "aac", "ec-3", "ec3", "ac-3", "ac3")
WHOLE_SAMPLES = ("None", "Aes128", "Aes128Ecb")


def should_log(active: str, level: Column) -> Column:
    """Whether a message's level reaches the active one; nothing does where logging is off."""
    return F.lit(False) if active == "Off" else level.isin(*LEVELS[LEVELS.index(active) :])


def progress_percent(done: Column, total: Column, done_bytes: Column, total_bytes: Column) -> Column:
    """By segments, or by bytes where there is one segment yet to come or no number of them; 0 to 100."""
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x * 100.0))
    by_bytes = F.when(total_bytes > 0, held(done_bytes / total_bytes))
    return F.coalesce(F.when((total == 1) & (done == 0), by_bytes), F.when(total > 0, held(done / total)), by_bytes, F.lit(0.0))


def display_total(done: Column, total: Column, done_bytes: Column, total_bytes: Column) -> Column:
    """The bytes that there will be: as told, or in proportion to the segments done while some are open."""
    return F.coalesce(total_bytes, F.when((done > 0) & (done < total), F.floor(done_bytes.cast("decimal(20,0)") * total / done).cast("long")))


def encode_support(methods: Column, codecs: Column, media_type: Column) -> Column:
    """Unsupported for samples encrypted one by one, RequiresProbe without codecs, Supported where all are known, else Refused."""
    words = F.filter(F.transform(F.split(codecs, ","), lambda c: F.lower(F.trim(c))), lambda c: c != "")
    begins = lambda c, heads: c.rlike("^(?:" + "|".join(heads) + ")")
    known = F.when(media_type == "Audio", F.forall(words, lambda c: begins(c, AUDIO_CODECS))).when(media_type.isNull() | (media_type == "Video"), F.forall(words, lambda c: begins(c, VIDEO_CODECS + AUDIO_CODECS))).otherwise(F.size(words) == 0)
    return (
        F.when(F.exists(methods, lambda m: ~m.isin(*WHOLE_SAMPLES)), "Unsupported")
        .when(F.coalesce(codecs, F.lit("")) == "", "RequiresProbe")
        .when(known, "Supported")
        .otherwise("Refused")
    )


def output_extension(extension: Column, media_type: Column, subtitles: str | None = None) -> Column:
    """The extension of an output with its dot; subtitles: the format that they are put right in, if they are."""
    boxed = extension.isin("m4s", "mp4")
    text = F.coalesce(media_type == "Subtitles", F.lit(False))
    plain = F.when(boxed & (media_type == "Audio"), ".m4a").when(boxed & ~text, ".mp4").otherwise(F.coalesce(F.concat(F.lit("."), extension), F.lit(".ts")))
    return F.when(text, f".{subtitles}").otherwise(plain) if subtitles else plain


def task_name(task: Column, group_id: Column, codecs: Column, bandwidth: Column, language: Column) -> Column:
    """The name of a task's folder, and of its output where none was asked for."""
    rest = (F.coalesce(c.cast("string"), F.lit("")) for c in (codecs, bandwidth, language))
    return F.array_join(F.array(task.cast("string"), names.valid_file_name(F.coalesce(group_id, F.lit("")), "-"), *rest), "_")


def combine_group(place: Column, files: Column) -> Column:
    """The file that a segment goes to when so many are first put together in groups: 100 to a group, 200 beyond 90,000."""
    return F.format_string("T%04d.ts", F.floor(place / F.when(files <= 90_000, 100).otherwise(200)))


def speed_bytes(text: Column) -> Column:
    """Bytes of a number, or of one with K, M or G after it; null for others and negative ones."""
    t = F.trim(text)
    scale = F.when(F.upper(F.right(t, F.lit(1))) == "K", 1024.0).when(F.upper(F.right(t, F.lit(1))) == "M", 1024.0**2).when(F.upper(F.right(t, F.lit(1))) == "G", 1024.0**3)
    number = F.substr(t, F.lit(1), F.length(t) - 1).try_cast("double")
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("long")).when(number >= 0, F.floor(number * scale).cast("long"))


def second_millis(text: Column) -> Column:
    """Milliseconds of seconds in decimals, what is finer cut off; null without a whole number before the point."""
    whole = F.trim(F.substring_index(text, ".", 1)).try_cast("long")
    digits = F.regexp_extract(text, r"^[^.]*\.([0-9]{1,3})", 1)
    return whole * 1000 + F.coalesce(F.rpad(digits, 3, "0").try_cast("long"), F.lit(0))


def key_id(text: Column) -> Column:
    """The 16 bytes of a key id: its first word, without braces and hyphens; null unless it is 32 hex digits."""
    digits = F.replace(F.regexp_replace(F.regexp_extract(text, r"^\s*(\S*)", 1), r"^\{+|\}+$", ""), F.lit("-"), F.lit(""))
    return F.when(digits.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(digits))
