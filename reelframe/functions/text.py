"""Text functions: file names, URLs, patterns, redaction, sizes. All are column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions.once import let

#: Markers whose value is cut up to white space or one of & , " and those whose value is cut up to the next &.
SECRET_MARKERS = ("key=", "decryption_key ", "--key ")
SECRET_QUERIES = ("token=", "signature=", "sig=", "Policy=", "Key-Pair-Id=")
SIZE_UNITS = {"short": ("B", "KiB", "MiB", "GiB", "TiB"), "plain": ("B", "KB", "MB", "GB", "TB")}
#: A name that stands beside a base as it is.
NAME = r"^[A-Za-z0-9_-][A-Za-z0-9_.-]*$"
ABSOLUTE = "^[A-Za-z][A-Za-z0-9+.-]*://"


def redact(text: Column) -> Column:
    for m in SECRET_MARKERS:
        text = F.regexp_replace(text, m + r"[^\s&,\"]*", m + "<redacted>")
    for m in SECRET_QUERIES:
        text = F.regexp_replace(text, m + "[^&]*", m + "<redacted>")
    return text


def leaks(text: Column, secrets: list[str]) -> Column:
    """Whether a redacted text still holds a known secret."""
    out = F.lit(False)
    for s in secrets:
        out = out | text.contains(s)
    return out


def valid_file_name(text: Column, replacement: str = "_") -> Column:
    """Characters that file systems refuse replaced, dots at the ends cut."""
    return F.regexp_replace(F.regexp_replace(text, r'["<>|\x00-\x1f:*?\\/]', replacement), r"^\.+|\.+$", "")


def percent_decoded(text: Column) -> Column:
    """%xx as bytes; a plus stays, and so does a percent sign without two hex digits."""
    kept = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(kept, F.lit("+"), F.lit("%2B")))


def stem(path: Column) -> Column:
    """A path's last name without its extension; a leading dot is no extension."""
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.when(name == "..", "").otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def save_name(url: Column, suffix: Column | None = None) -> Column:
    """A file name from an address: the decoded stem of its path, an underscore and the suffix."""
    plain = F.regexp_replace(url, "[?#].*$", "")
    path = F.when(plain.rlike(ABSOLUTE), F.regexp_extract(plain, "://[^/]*(.*)$", 1)).otherwise(plain)
    return valid_file_name(F.concat(stem(percent_decoded(path)), F.lit("_"), suffix if suffix is not None else F.lit("")))


def fill_pattern(pattern: str, values: dict[str, Column]) -> Column:
    """<Token>s replaced (null by nothing), doubled underscores and dots halved once, then made a file name."""
    out = F.lit(pattern)
    for token, value in values.items():
        out = F.replace(out, F.lit(f"<{token}>"), F.coalesce(value.cast("string"), F.lit("")))
    out = F.replace(F.replace(out, F.lit("__"), F.lit("_")), F.lit(".."), F.lit("."))
    return valid_file_name(F.regexp_replace(F.regexp_replace(out, "^_+|_+$", ""), r"^\.+|\.+$", ""))


def normalize_token(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[-_ ]", ""))


def encryption_method(text: Column) -> Column:
    """The method by its normalized name; missing or other names are Unknown."""
    names = {"none": "None", "aes128": "Aes128", "aes128ecb": "Aes128Ecb", "sampleaes": "SampleAes", "sampleaesctr": "SampleAesCtr", "cenc": "Cenc", "chacha20": "ChaCha20", "unknown": "Unknown"}
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(known, normalize_token(text)), F.lit("Unknown"))


def file_size(n: Column, style: str = "short") -> Column:
    """A number of bytes in units of 1,024, ties to even; in the short style bytes are whole."""
    units, out = SIZE_UNITS[style], None
    for k in range(len(units) - 1, -1, -1):
        text = F.concat(n.cast("string"), F.lit("B")) if k == 0 and style == "short" else F.format_string(f"%.2f{units[k]}", F.bround(n / float(1024**k), 2))
        out = text if out is None else F.when(n < 1024 ** (k + 1), text).otherwise(out)
    return F.when(n.isNotNull(), out)


def label(*parts: Column) -> Column:
    """Parts with a vertical bar between; null and blank ones are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")), " | ")


def template(text: Column, values: dict[str, Column]) -> Column:
    """$Name$ replaced; $Number%05d$ pads with zeros, and never cuts digits."""
    for name, value in values.items():
        text = let(F.struct(text.alias("text"), value.cast("string").alias("value")), _filler(name))
    return text


def _filler(name: str) -> Callable[[Column], Column]:
    return lambda x: F.when(x["text"].contains(f"${name}"), _filled(x["text"], name, x["value"])).otherwise(x["text"])


def _filled(text: Column, name: str, plain: Column) -> Column:
    # without a width there is nothing to cast: a cast that fails costs more than all the rest
    told = F.regexp_extract(text, rf"\${name}%0(\d+)d\$", 1)
    width = F.coalesce(F.when(told != "", told.try_cast("int")), F.lit(0))
    padded = F.regexp_replace(text, F.lit(rf"\${name}%0\d+d\$"), zero_padded(plain, width))
    return F.replace(F.when(text.contains(f"${name}%0"), padded).when(plain.isNotNull(), text), F.lit(f"${name}$"), F.coalesce(plain, F.lit("")))


def zero_padded(plain: Column, width: Column) -> Column:
    """A text with zeros before it up to a width; a longer one stays."""
    return F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(plain), F.lit(0))), plain)


def combine_url(base: Column, ref: Column) -> Column:
    """ref as seen from base: absolute, from the host's root, a query only, or beside the base's last name."""
    return let(F.struct(base.alias("base"), ref.alias("ref")), lambda x: let(_seen_from(x["base"], x["ref"]), _without_dots))


def beside(base: Column) -> Column:
    """What stands before a plain name as seen from base; see seen_beside()."""
    return let(combine_url(base, F.lit("x")), lambda x: F.substr(x, F.lit(1), F.length(x) - 1))


def seen_beside(base: Column, before: Column, ref: Column) -> Column:
    """combine_url(base, ref), where before is beside(base): a plain name is only put behind it."""
    return F.when(ref.rlike(NAME), F.concat(before, ref)).otherwise(combine_url(base, ref))


def _seen_from(base: Column, ref: Column) -> Column:
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = base.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?(?:[?#]|$)")
    folder = F.when(bare, F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(base, "^([^?#]*/)", 1))
    return (
        F.when(ref.rlike(ABSOLUTE), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("?"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), ref))
        .when(ref == "", base)
        .otherwise(F.concat(folder, ref))
    )


def _without_dots(full: Column) -> Column:
    head = F.regexp_extract(full, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(F.substr(full, F.length(head) + 1), "^([^?#]*)", 1)
    rest = F.substr(full, F.length(head) + F.length(path) + 1)
    steps = F.split(path, "/")
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    ends = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    # asked of the whole URL, so that one without dots costs one look; folding leaves what this lets through by its host alone
    dotted = full.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?(?:[^?#]*/)?\.\.?(?:[/?#]|$)")
    return F.when(~dotted, full).otherwise(F.concat(head, F.array_join(folded, "/"), ends, rest))


def hls_attribute(line: Column, key: str) -> Column:
    """An attribute's value: in quotes where it stands so, else up to a comma; null where it is missing."""
    quoted, plain = F.regexp_extract(line, f'{key}="([^"]*)"', 1), F.regexp_extract(line, f"{key}=([^,]*)", 1)
    return F.when(line.contains(f'{key}="'), quoted).when(line.contains(f"{key}="), plain)


def source_kind(text: Column) -> Column:
    """hls, dash or mss by what a document holds, else null."""
    return (
        F.when(F.ltrim(text).startswith("#EXTM3U"), "hls")
        .when(text.contains("<MPD") & text.contains("</MPD>"), "dash")
        .when(text.contains("<SmoothStreamingMedia") & text.contains("</SmoothStreamingMedia>"), "mss")
    )
