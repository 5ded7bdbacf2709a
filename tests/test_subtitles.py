"""WebVTT documents, batches and reserved names against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reelframe.operators import reserve
from reelframe.sources import subtitles


def docs(spark, *texts):
    return spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, seg_pos long, text string")


def cues_of(spark, *texts, base=0):
    return [tuple(r)[1:] for r in subtitles.vtt_cues(docs(spark, *texts), base).orderBy("seg_pos", "cue_pos").collect()]


def test_cues(spark):
    text = "﻿WEBVTT"[1:] + "\r\nX-TIMESTAMP-MAP=MPEGTS:90000,LOCAL:00:00:00.000\r\n\r\n1\r\n00:02.000 --> 00:00:04.500 align:start  line:0\r\n  Hello ​\r\nyou\r\n\r\nNOTE x\r\n\r\n00:05.000 --> 00:06.000\r\n\r\n00:07.5 --> 8s\r\n<c.red>a</c> b <c.x>c</c>\r\n00:09,000 --> 00:10.000\r\nplain\r\n"
    assert cues_of(spark, text) == [(0, 0, 2000, 4500, "Hello \r\nyou", "align:start line:0"), (0, 1, 9000, 10_000, "a c", "")]
    assert cues_of(spark, text, base=3000)[0][2:4] == (2000, 4500) and cues_of(spark, text, base=1000)[0][2:4] == (1000, 3500)
    assert cues_of(spark, None, "", "no header\n\n00:01.000 --> 00:02.000\nx", "WEBVTT\n\nx --> 00:02.000\nbad\n\n00:01.000 --> 00:02.000\ngood") == []
    found = {r["seg_pos"]: (r["mpegts"], r["error"]) for r in subtitles.vtt_documents(docs(spark, text, None, "x", "WEBVTT\n\nx --> 00:02.000\nbad", "WEBVTT")).collect()}
    assert found == {0: (90_000, None), 1: (0, "no header"), 2: (0, "no header"), 3: (0, "no times"), 4: (0, None)}


def test_documents_are_read_once(spark):
    texts = ["WEBVTT\n\nid\n\u2003\n00:01.000 --> 00:02.000  x:1\n a \n\u200b\n \t\n\n 00:03.000 --> 00:04.000\n00:05.000 --> 00:06.000\nb\nc", "WEBVTT", "WEBVTT\n\n1 --> 2\n\n\n3s --> 4s\nd"]
    assert cues_of(spark, *texts) == [(0, 0, 1000, 2000, "a\r\n", "x:1"), (0, 1, 5000, 6000, "b\r\nc", ""), (2, 0, 3000, 4000, "d", "")]
    found = subtitles.vtt_joined(docs(spark, *texts))
    assert [tuple(r) for r in found.orderBy("cue_pos").collect()] == [(1, 0, 1000, 2000, "a\r\n", "x:1"), (1, 1, 5000, 6000, "b\r\nc", ""), (1, 2, 3000, 4000, "d", "")]
    clocks = subtitles.vtt_documents(docs(spark, *texts))
    plan = [x._jdf.queryExecution().executedPlan().toString() for x in (found, clocks)]
    assert [(p.count("Exchange"), p.count("Window"), p.count("Join")) for p in plan] == [(1, 0, 0), (0, 0, 0)]
    assert subtitles.vtt_joined(docs(spark, *texts).where("false")).count() == 0


def plain_join(documents):
    """documents: [(clock, [(start, end, payload, settings)])] added one by one."""
    own, kept = documents[0][0], [list(c) for c in documents[0][1]]
    for clock, cues in documents[1:]:
        cues = [list(c) for c in cues]
        if clock:
            fix = cues[0][0] < kept[-1][1] and cues[0][1] != kept[-1][1] if cues and kept else not kept
            shift = int((clock - own) / 90_000) * 1000
            if fix and cues and cues[0][0] < shift:
                cues = [[a + shift, b + shift, p, s] for a, b, p, s in cues]
        for c in cues:
            if c in kept:
                continue
            if kept and c[0] - kept[-1][1] <= 1 and c[2] == kept[-1][2]:
                kept[-1][1] = c[1]
            else:
                kept.append(c)
    return [tuple(c) for c in kept]


def test_joined_against_one_by_one(spark):
    r = random.Random(2)
    wanted, cues, clocks = {}, [], []
    for doc in range(30):
        documents = []
        for seg in range(r.randrange(1, 6)):
            clock = r.choice((0, 0, 90_000 * r.randrange(1, 20)))
            at, own = r.randrange(0, 4) * 1000, []
            for _ in range(r.randrange(0, 5)):
                end = at + r.choice((500, 1000))
                own.append((at, end, r.choice("ab"), r.choice(("", "x"))))
                at = end + r.choice((0, 0, 500))
            documents.append((clock, own))
            clocks.append((doc, seg, clock))
            cues += [(doc, seg, k, *c) for k, c in enumerate(own)]
        wanted[doc] = plain_join(documents)
    got = subtitles.joined(spark.createDataFrame(cues, "doc_id long, seg_pos long, cue_pos long, start_ms long, end_ms long, payload string, settings string"), spark.createDataFrame(clocks, "doc_id long, seg_pos long, mpegts long"))
    found = {}
    for x in got.orderBy("doc_id", "cue_pos").collect():
        found.setdefault(x["doc_id"], []).append(tuple(x)[2:])
    assert found == {k: v for k, v in wanted.items() if v}


def fold(streams, existing):
    """Each stream in order takes its first free name."""
    taken, out = set(existing), {}
    for folder, pos, file, tries in sorted(streams):
        m = re.match(r"^(.+)(\.[^.]*)$", file)
        stem, ext = (m[1], m[2]) if m else (file, "")
        names, copies = [file, *(f"{stem}.{t}{ext}" for t in tries)], 0
        while True:
            name = names[copies] if copies < len(names) else stem + ".copy" * (copies - len(names) + 1) + ext
            if (folder, name) not in taken:
                break
            copies += 1
        taken.add((folder, name))
        out[folder, pos] = name
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reserved_against_a_fold(spark, seed):
    r = random.Random(seed)
    files = ["a.mp4", "a.x.mp4", "a.copy.mp4", "a.copy.copy.mp4", "b", "b.copy", ".hidden"]
    streams = [(f, p, r.choice(files[: 2 + 5 * (f > 2)]), r.sample(["x", "y", "copy", "x.y"], r.randrange(3))) for f in range(6) for p in range(r.randrange(1, 30))]
    existing = [(r.randrange(6), r.choice(files)) for _ in range(5)] if seed else []
    s = spark.createDataFrame(streams, "folder long, pos long, file string, tries array<string>")
    e = spark.createDataFrame(existing, "folder long, file string") if existing else None
    got = {(x["folder"], x["pos"]): x["reserved"] for x in reserve.reserved(s, e).collect()}
    assert got == fold(streams, existing)
    assert reserve.reserved(s.where("false")).count() == 0


def test_small_folders_are_folded_and_nothing_is_written(spark, monkeypatch):
    """Every round wrote all streams again."""
    streams = [(f, p, ["a.mp4", "b", "a.copy.mp4"][p % 3], ["x"] * (p % 2)) for f in (0, 1, None) for p in range(3 + 9 * (f == 1))]
    existing = [(1, "a.mp4"), (1, "b.copy"), (2, "b"), (None, "b")]
    s, e = spark.createDataFrame(streams, "folder long, pos int, file string, tries array<string>"), spark.createDataFrame(existing, "folder long, file string")
    wanted = fold([x for x in streams if x[0] is not None], existing) | {(None, p): None for p in range(3)}
    told = lambda: {(x["folder"], x["pos"]): x["reserved"] for x in reserve.reserved(s, e).collect()}
    monkeypatch.setattr(reserve, "MOST", 5)
    assert told() == wanted  # one folder in rounds
    monkeypatch.setattr(reserve, "MOST", 12)
    monkeypatch.setattr(reserve, "settled", None)
    assert told() == wanted
    assert reserve.reserved(s, e).schema == reserve.reserved(s).schema


def test_attempts(spark):
    df = spark.createDataFrame([("Video", "1x2", 1_260_000, "en", "2"), ("Video", None, 1, None, None), ("Video", "1x2", None, None, None), ("Audio", "1x2", 64_999, "en", "2"), ("Audio", None, None, None, "6"), ("Subtitles", "1x2", 5, "en", None), (None, "1x2", 5, "en", "2")], "m string, r string, b long, l string, c string")
    got = [x["t"] for x in df.select(reserve.attempts(*(F.col(c) for c in "mrblc")).alias("t")).collect()]
    assert got == [["1x2", "1.3Mbps", "1x2.1.3Mbps"], ["0.0Mbps"], ["1x2"], ["en", "2ch", "en.2ch", "64kbps"], ["6ch"], ["en"], []]


def test_tenths_of_megabits_are_rounded_from_the_number(spark):
    rates = [50_000, 150_000, 250_000, 350_000, 450_000, 950_000, 1_250_000, 1_234_567_890_123, None]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rates)], "k long, b long")
    got = [x["t"] for x in df.select("k", reserve.attempts(F.lit("Video"), F.lit(None).cast("string"), F.col("b"), F.lit("en"), F.lit("2")).alias("t")).orderBy("k").collect()]
    assert got == [[] if r is None else ["%.1fMbps" % (r / 1e6)] for r in rates]
