"""Bytes: sniffing, base64 and hex with checks, block ciphers. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Images that stand before a segment's bytes, and how many bytes they take: (first bytes in hex, length).
DISGUISES = (("89504E47", (120, 6102, 69, 771)), ("47494638", (42,)), ("424D", (62,)))


def is_transport_stream(data: Column) -> Column:
    """At least 188 bytes, and of the first five packets three that begin with the sync byte, or as many as there are."""
    n = F.length(data)
    hits = F.lit(0)
    for k in range(5):
        hits = hits + F.when((n > 188 * k) & (F.hex(F.substring(data, 188 * k + 1, 1)) == "47"), 1).otherwise(0)
    return (n >= 188) & (hits >= 3)


def is_gzip(data: Column) -> Column:
    """The two bytes of the format, and more after them."""
    return (F.length(data) > 2) & (F.hex(F.substring(data, 1, 2)) == "1F8B")


def without_disguise(data: Column) -> Column:
    """The bytes after an image that hides a transport stream, where one of the known lengths leads to a sync byte."""
    out = data
    for head, lengths in DISGUISES:
        for n in reversed(lengths):
            hit = (F.hex(F.substring(data, 1, len(head) // 2)) == head) & (F.hex(F.substring(data, n + 1, 1)) == "47")
            out = F.when(hit, F.substr(data, F.lit(n + 1))).otherwise(out)
    return out


def strict_base64(text: Column) -> Column:
    """Decoded bytes; null unless length, characters and padding are right."""
    ok = (F.length(text) % 4 == 0) & text.rlike("^[A-Za-z0-9+/]*={0,2}$")
    return F.when(ok, F.unbase64(text))


def strict_hex(text: Column) -> Column:
    """Decoded bytes of an even number of hex digits, 0x before them or not; else null."""
    digits = F.regexp_replace(text, "^0[xX]", "")
    return F.when(digits.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(digits))


def implicit_iv(index: Column) -> Column:
    """16 bytes, big-endian; a negative index fills the last 8 with its two's complement."""
    return F.unhex(F.lpad(F.hex(index.cast("long")), 32, "0"))


def decrypted(data: Column, key: Column, iv: Column | None = None) -> Column:
    """AES with PKCS padding: CBC with an IV, else ECB."""
    if iv is None:
        return F.aes_decrypt(data, key, F.lit("ECB"), F.lit("PKCS"))
    return F.aes_decrypt(F.concat(iv, data), key, F.lit("CBC"), F.lit("PKCS"))


def range_header(start: Column, length: Column) -> Column:
    """bytes=first-last; without a length up to the end, without a start nothing."""
    return F.when(start.isNotNull() & length.isNotNull(), F.format_string("bytes=%d-%d", start, start + length - 1)).when(start.isNotNull(), F.format_string("bytes=%d-", start))
