"""Query parameters, ChaCha20, source texts and transport streams against published vectors and plain versions."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelframe.functions import chacha, query
from reelframe.sources import raw


def test_chacha_published_vectors():
    key, nonce = bytes(range(32)), bytes.fromhex("000000000000004a00000000")
    stream = chacha.key_streams(np.frombuffer(key, np.uint8)[None], np.frombuffer(nonce, np.uint8)[None], 2, 1)[0].tobytes()
    plain = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    coded = bytes(a ^ b for a, b in zip(plain, stream))
    assert coded.hex().startswith("6e2e359a2568f98041ba0728dd0d6981e97e7aec1d4360c20a27afccfd9fae0b") and coded.hex().endswith("8eedf2785e42874d")
    zero = chacha.key_streams(np.zeros((1, 32), np.uint8), np.zeros((1, 12), np.uint8), 1)[0].tobytes()
    assert zero.hex().startswith("76b8e0ada0f13d90405d6ae55386bd28bdd219b8a08ded1aa836efcc8b770dc7da41597c5157488d7724e03fb8d84a376a43b8f41518a11cc387b669b2ee6586")


def test_chacha_restarts(spark):
    rows = [(k, bytearray(d), bytearray(key), bytearray(n)) for k, (d, key, n) in enumerate([(bytes(5000), bytes(range(32)), bytes(12)), (b"abc", bytes(32), bytes(8)), (b"", bytes(32), bytes(12)), (b"x", bytes(31), bytes(12)), (b"x", bytes(32), bytes(9))])] + [(9, None, bytearray(32), bytearray(12))]
    df = spark.createDataFrame(rows, "id long, data binary, key binary, nonce binary")
    got = {r["id"]: r for r in chacha.coded(chacha.coded(df), "coded", out="back").collect()}
    stream = bytes(got[0]["coded"])
    assert stream[:1024] == stream[1024:2048] == stream[3072:4096] and stream[4096:] == stream[:904] and len(set(stream[k : k + 64] for k in range(0, 1024, 64))) == 16
    assert bytes(got[1]["back"]) == b"abc" and bytes(got[1]["coded"]) != b"abc" and bytes(got[2]["coded"]) == b""
    assert [got[k]["coded"] for k in (3, 4, 9)] == [None] * 3


def test_chacha_works_on_few_rows_at_once():
    batch = pa.RecordBatch.from_pydict({"id": list(range(2 * chacha.ROWS + 3))})
    got = list(chacha.pieces(iter([batch, batch.slice(0, 0), batch.slice(0, 1)])))
    assert [b.num_rows for b in got] == [chacha.ROWS, chacha.ROWS, 3, 1]
    assert [x for b in got for x in b.column("id").to_pylist()] == [*range(2 * chacha.ROWS + 3), 0]


@pytest.mark.parametrize("url,source,wanted", [
    ("http://a/b?x=1&y=2&x=3#f", "http://s/?x=9", "http://a/b?x=9&y=2"), ("http://a/b?x=1", "http://s/", "http://a/b?x=1"), ("http://a/b", "http://s/?k=1&k=2&k=", "http://a/b?k=1%2c2"), ("http://a/b?x", "http://s/?x=", "http://a/b?x="),
    ("http://a/b?x=1", "http://s/?x&y#z", "http://a/b?x=1&x&y"), ("http://a/b?p=a+b%21&q=%zz", "http://s/?r=(é)~'", "http://a/b?p=a+b!&q=%25zz&r=(%c3%a9)%7e%27"), ("http://a/b#f", "http://s/?&&??", "http://a/b"), ("http://a/b?=v", "http://s/?=w", "http://a/b?=w"), ("u?a=1=2", "s?b=3", "u?a=1%3d2&b=3"),
])
def test_query_parameters(spark, url, source, wanted):
    assert spark.createDataFrame([(url, source)], "u string, s string").select(query.with_query_of(F.col("u"), F.col("s")).alias("x")).first()["x"] == wanted


def binary_by_loop(data):
    """The rule for bytes, one after the other."""
    data, i, other, total = data[:4096], 0, 0, 0
    while i < len(data):
        b = data[i]
        total += 1
        if b == 0:
            return True
        n = 1 if b < 0x80 else 2 if b & 0xE0 == 0xC0 else 3 if b & 0xF0 == 0xE0 else 4 if b & 0xF8 == 0xF0 else 1
        if 0x20 <= b <= 0x7E or b in (9, 10, 13):
            i += 1
        elif n > 1 and i + n <= len(data) and all(x & 0xC0 == 0x80 for x in data[i + 1 : i + n]):
            i += n
        else:
            other += 1
            i += 1
    return total > 0 and other / total > 0.3


def test_binary_against_a_loop(spark):
    r = random.Random(3)
    parts = [b"plain text ", "é漢🙂".encode(), b"\xff", b"\x80", b"\xc3", b"\x01\x02", b"\xe0\x80", b"\0"]
    rows = [b"".join(r.choices(parts, weights=(6, 4, 3, 3, 3, 3, 3, 0.1), k=r.randrange(0, 60))) for _ in range(300)] + [b"a" * 4096 + b"\0", b"a" * 4095 + "é".encode(), b""]
    df = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(rows)], "id long, data binary")
    got = {r["id"]: r["b"] for r in df.select("id", raw.looks_binary(F.col("data")).alias("b")).collect()}
    assert [got[k] for k in range(len(rows))] == [binary_by_loop(x) for x in rows] and set(got.values()) == {True, False}


def test_source_texts(spark):
    mpd = "<MPD>é</MPD>"
    packets = (b"\x47" + bytes(187)) * 5
    rows = [
        ("#EXTM3U\n", None), (" ﻿#EXTM3U x \n", None), (mpd.encode("utf-8-sig"), None), (b"\xff\xfe" + mpd.encode("utf-16-le"), None), (b"\xfe\xff" + mpd.encode("utf-16-be") + b"\0", None),
        (mpd.encode("utf-16-le"), 'text/xml; Charset="UTF-16"'), (mpd.encode("latin-1"), "a/b;charset=iso-8859-1"), (mpd.encode("shift_jis", "replace"), "charset=shift_jis"), (b"\x01\x02\x03\x04", None), (packets, "text/plain;charset=utf-8"),
        (b"plain", None), (b"  ", None), (None, None), (b"<MPD>\xff</MPD>", "x;charset=nonsense"), (b"\0\0", "x;charset=utf-8"),
    ]
    df = spark.createDataFrame([(k, None if d is None else bytearray(d.encode() if isinstance(d, str) else d), c) for k, (d, c) in enumerate(rows)], "id long, data binary, content_type string")
    got = {r["id"]: (r["kind"], r["text"], r["error"]) for r in raw.source_texts(df).collect()}
    assert got[0] == ("hls", "#EXTM3U", None) and got[1][0] == "hls" and got[2] == got[3] == ("dash", mpd, None) and got[4] == ("dash", mpd + "�", None)
    assert got[5] == got[6] == ("dash", mpd, None) and got[7][0] == "dash" and got[8] == ("binary", None, None) and got[9] == ("ts", None, None)
    assert got[10] == (None, "plain", "unknown kind") and got[11][2] == got[12][2] == "empty" and got[13] == ("dash", "<MPD>�</MPD>", None) and got[14][2] == "unknown kind"
    assert raw.source_texts(df.where("false")).count() == 0


def packet(pid, body):
    return bytes([0x47]) + struct.pack(">H", 0x4000 | pid) + b"\x10" + body.ljust(184, b"\xff")


def pat(program):
    return packet(0, bytes([0, 0, 0xB0, 13, 0, 1, 0xC1, 0, 0]) + struct.pack(">H", program))


def sdt(provider, name, cut=0):
    held = bytes([0x48, 0, 1, len(provider)]) + provider + bytes([len(name)]) + name
    loop = bytes(3) + struct.pack(">H", len(held)) + held
    section = bytes(8) + loop
    return packet(0x11, bytes([0, 0x42]) + struct.pack(">H", len(section) + cut) + section)


def test_services(spark):
    other = packet(0x100, b"")
    rows = [pat(7) + other + sdt(b"Prov", "Näme".encode()) + other, b"xx" + sdt(b"", b"N") + pat(1) + other, pat(1) + other, sdt(b"a", b"b", 300) + pat(1) + other, b"", None, pat(1) + sdt(b"a", b"b")]
    df = spark.createDataFrame([(k, None if d is None else bytearray(d)) for k, d in enumerate(rows)], "id long, data binary")
    got = {r["id"]: tuple(r)[1:] for r in raw.services(df).collect()}
    assert got[0] == ("7", "Prov", "Näme") and got[1] == ("1", "", "N") and all(got[k] == (None,) * 3 for k in (2, 3, 4, 5, 6))


def test_recordings(spark):
    df = spark.createDataFrame([(1, k, 100, ms) for k, ms in enumerate((500, 1500, 2000, 3000))] + [(2, 0, 5, 10)], "session_id long, seq long, n_bytes long, elapsed_ms long")
    got = [tuple(r)[4:] for r in raw.recordings(df, 2000).orderBy("session_id", "seq").collect()]
    assert got == [(100, 0, False), (200, 1, False), (300, 2, True), (5, 0, False)]
