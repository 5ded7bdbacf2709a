"""Boxes, fragments of WebVTT, init segments and key facts against bytes put together by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from reelframe.functions import boxes as make
from reelframe.plans import protection as protection_plans
from reelframe.sources import boxes, protection


def box(name, *parts, size=None):
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8 if size is None else size) + name.encode() + body


def full(name, *parts, version=0, flags=0):
    return box(name, bytes([version]) + flags.to_bytes(3, "big"), *parts)


def u32(*x):
    return struct.pack(f">{len(x)}I", *x)


def files(spark, *data):
    return spark.createDataFrame([(k, bytearray(d) if d is not None else None) for k, d in enumerate(data)], "id long, data binary")


def test_walk(spark):
    inner = full("tfdt", u32(7))
    wide = u32(1) + b"free" + struct.pack(">Q", 20) + b"1234"
    data = box("moof", box("traf", inner)) + wide + box("mdat", b"abc", size=0)
    broken = box("moov", box("trak", b"xy", size=99), box("free")) + b"\0\0"
    got = boxes.boxes(files(spark, data, broken, None, b"", b"1234567")).orderBy("id", "nth").collect()
    assert [(r["id"], r["path"], r["begin"], r["header"], r["size"], r["error"]) for r in got] == [
        (0, "moof", 0, 8, 32, None), (0, "moof/traf", 8, 8, 24, None), (0, "moof/traf/tfdt", 16, 8, 16, None), (0, "free", 32, 16, 20, None), (0, "mdat", 52, 8, 11, None),
        (1, "moov", 0, 8, 26, None), (1, "moov/trak", 8, 8, 99, "size of a box"),
    ]
    assert boxes.boxes(files(spark)).count() == 0


def fragment(cues, durations, sizes=None, base=0, moved=None, version=0, head=b"", flags=0):
    flags |= 0x100 | (0x200 if sizes else 0) | (0x800 if moved else 0)
    entries = b"".join(u32(d) + (u32(sizes[k]) if sizes else b"") + (struct.pack(">i", moved[k]) if moved else b"") for k, d in enumerate(durations))
    return box("moof", box("traf", full("tfhd", u32(2)), full("tfdt", struct.pack(">Q", base), version=1), full("trun", u32(len(durations)), head, entries, version=version, flags=flags))) + box("mdat", *cues)


def cue(text, place=None):
    return box("vttc", box("payl", text.encode()), box("sttg", place.encode()) if place else b"")


def test_wvtt(spark):
    rows = [
        (1, 0, fragment([cue("Hello", "line:0")], [1000], base=1000)),
        # two boxes in one sample, an empty one, a box of another kind; the last goes on from the segment before
        (1, 1, fragment([cue("Hello", "line:0"), cue("é漢"), box("vtte"), box("vttx"), cue("end")], [500, 250, 250, 100], [len(cue("Hello", "line:0") + cue("é漢")), 8, 8, len(cue("end"))], base=2000)),
        (2, 0, fragment([cue("a"), cue("b")], [10, 10], moved=[500, -200], version=1, base=1000)),
        (2, 1, fragment([cue("a")], [10], head=u32(0, 0), flags=5, base=5000)),
        (3, 0, fragment([cue("a")], [0])),
        (3, 1, box("moof")),
        (3, 2, fragment([cue("a")], [5]) + box("mdat")),
        (3, 3, fragment([cue("a")], [5])[:-3]),
        (3, 4, None),
        (3, 5, fragment([cue("")], [5])),
    ]
    segments = spark.createDataFrame([(d, s, None if x is None else bytearray(x)) for d, s, x in rows], "doc_id long, seg_pos long, data binary")
    got = [tuple(r) for r in boxes.wvtt_cues(segments, 1000).orderBy("doc_id", "cue_pos").collect()]
    assert got == [
        (1, 0, 1000, 2500, "Hello", "line:0"), (1, 1, 2000, 2500, "é漢", ""), (1, 2, 3000, 3100, "end", ""),
        (2, 0, 1500, 1510, "a", ""), (2, 1, 800, 810, "b", ""), (2, 2, 5000, 5010, "a", ""),
    ]
    errors = {(r["doc_id"], r["seg_pos"]): r["error"] for r in boxes.fragments(segments)[2].collect()}
    assert errors == {(3, 0): "a sample duration of zero", (3, 1): "no media data box", (3, 2): "several media data boxes", (3, 3): "size of a box", (3, 4): "no media data box"}


def test_timescale(spark):
    head = full("mdhd", u32(0, 0, 1000, 0))
    wide = full("mdhd", struct.pack(">QQI", 0, 0, 48_000), version=1)
    got = files(spark, head + b"wvtt", wide + b"xwvtt", head + b"stpp", b"wvtt", None).select("id", boxes.timescale(F.col("data")).alias("t")).orderBy("id").collect()
    assert [r["t"] for r in got] == [1000, 48_000, None, None, None]


SPS, PPS = bytes.fromhex("67640028ac"), bytes.fromhex("68ee3c80")
FACTS = "four_cc string, kind string, private_data string, rate int, channels int, bits int, length_field int, timescale long, duration long, language string, name string, width int, height int, bandwidth long"


def init(spark, *rows, kid=None):
    df = spark.createDataFrame(rows, FACTS)
    made = make.init_segment({c: F.col(c) for c in df.columns}, F.lit(3), F.lit(77), kid, F.lit(make.PLAYREADY) if kid is not None else None, F.lit(b"xyz") if kid is not None else None)
    return [None if r["d"] is None else bytes(r["d"]) for r in df.select(made.alias("d")).collect()]


def test_init_segments(spark):
    video = ("AVC1", "video", f"00000001{SPS.hex()}00000001{PPS.hex()}", None, None, None, 4, 1000, 5000, "eng", "v", 640, 360, 9)
    audio = ("AACL", "audio", "", 48_000, 2, 16, None, 1000, 5000, None, None, None, None, 64_000)
    text = ("TTML", "text", "", None, None, None, None, 1000, 5000, "ge", "t", None, None, None)
    unknown, broken = ("WVC1", *video[1:]), (*video[:2], "0000000167", *video[3:])
    got = init(spark, video, audio, text, unknown, broken)
    assert got[3] is None and got[4] is None
    avcc = box("avcC", bytes([1]) + SPS[1:4] + bytes([0xFF, 1]) + struct.pack(">H", 5) + SPS + bytes([1]) + struct.pack(">H", 4) + PPS)
    entry = box("avc1", bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">HHIIIH", 640, 360, 0x480000, 0x480000, 0, 1) + bytes(32) + struct.pack(">HH", 24, 65_535), avcc)
    tables = box("stbl", *(full(x, u32(0)) for x in ("stts", "stsc", "stco")), full("stsz", u32(0, 0)), full("stsd", u32(1), entry))
    minf = box("minf", full("vmhd", bytes(8), flags=1), box("dinf", full("dref", u32(1), full("url ", flags=1))), tables)
    times = struct.pack(">QQ", 77, 77)
    matrix = u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    eng = struct.pack(">H", (5 << 10) | (14 << 5) | 7)
    mdia = box("mdia", full("mdhd", times, u32(1000), struct.pack(">Q", 5000), eng, bytes(2), version=1), full("hdlr", u32(0), b"vide", bytes(12), b"v\0"), minf)
    tkhd = full("tkhd", times, u32(3, 0), struct.pack(">Q", 5000), bytes(16), matrix, struct.pack(">HHHH", 640, 0, 360, 0), version=1, flags=7)
    mvhd = full("mvhd", times, u32(1000), struct.pack(">Q", 5000), u32(0x10000), struct.pack(">HH", 256, 0), bytes(8), matrix, bytes(24), u32(2**32 - 1), version=1)
    mvex = box("mvex", full("mehd", struct.pack(">Q", 5000), version=1), full("trex", u32(3, 1, 0, 0, 0)))
    assert got[0] == box("ftyp", b"isml", u32(1), b"iso5iso6piffmsdh") + box("moov", mvhd, box("trak", tkhd, mdia), mvex)
    config = bytes.fromhex("0000000000001190")
    esds = full("esds", bytes([3, 28, 0, 3, 0, 4, 23, 0x40, 0x15, 255, 255, 255]) + u32(64_000, 64_000) + bytes([5, 8]) + config)
    assert box("mp4a", bytes(6) + struct.pack(">H", 1) + bytes(8) + struct.pack(">HHIHH", 2, 16, 0, 48_000, 0), esds) in got[1]
    assert box("stpp", bytes(6) + struct.pack(">H", 1) + b"http://www.w3.org/ns/ttml" + bytes(3)) in got[2] and full("sthd") in got[2]
    secret = init(spark, video, kid=F.lit(bytes(range(16))))[0]
    assert box("sinf", box("frma", b"avc1"), full("schm", b"cenc", u32(0x10000)), box("schi", full("tenc", bytes([0, 0, 1, 8]), bytes(range(16))))) in secret and b"encv" in secret
    assert full("pssh", bytes.fromhex(make.PLAYREADY), u32(3), b"xyz") in secret


def test_codec_facts(spark):
    one = spark.range(1)
    aac = one.select(*(make.aac_private_data(F.lit(c), F.lit(r), F.lit(2)).alias(n) for n, c, r in (("a", "AACL", 48_000), ("b", "AACH", 24_000), ("c", "EC-3", 48_000)))).first()
    assert tuple(aac) == ("0000000000001190", "0000000000002B110000000000008800", None)
    # emulation prevention goes, zero constraint bytes are left out of the codec string
    sps = "420101016000000300900000030000030078AA"
    got = one.select(make.hevc_codecs(F.lit(f"0000000140010C0000000001{sps}000000014401C1"), F.lit("hvc1")).alias("c")).first()["c"]
    clean = bytes.fromhex("420101016000000090000000000078AA")
    assert got == f"hvc1.1.{int.from_bytes(clean[4:8]):x}.L{clean[14]}." + bytes(b for b in clean[8:14] if b).hex().upper()
    assert one.select(make.language_code(F.lit("eng")).alias("a"), make.language_code(F.lit("x")).alias("b"), make.language_code(F.lit(None).cast("string")).alias("c")).first() == ((5 << 10) | (14 << 5) | 7, *[(21 << 10) | (14 << 5) | 4] * 2)


def pssh(system, data, version=0, more=b""):
    return full("pssh", bytes.fromhex(system), more, u32(len(data)), data, version=version)


def entry(kid, scheme=b"cenc"):
    return box("encv", bytes(78), box("sinf", full("schm", scheme, u32(0x10000)), box("schi", full("tenc", bytes([0, 0, 1, 8]), kid))))


def test_file_protection(spark):
    kid, other = bytes(range(16)), bytes(range(16, 32))
    stsd = lambda *x: box("trak", box("mdia", box("minf", box("stbl", full("stsd", u32(len(x)), *x)))))
    data = (
        box("moov", pssh(make.WIDEVINE, b"\x08\x01" + bytes(16)), stsd(entry(bytes(16)))),
        box("moov", pssh(make.PLAYREADY, b"\1\2\3")),
        box("moov", stsd(entry(bytes(16), b"cbcs")), pssh(make.WIDEVINE, b"\x12\x10" + kid), pssh(make.FAIRPLAY, b"f", 1, u32(1) + other), pssh("00" * 16, b"none"), pssh(make.PLAYREADY, b"p", 2)),
        box("moov", stsd(entry(other)), pssh(make.WIDEVINE, b"\x12\x10" + kid)),
        b"",
    )
    got = {r["id"]: (r["scheme"], r["kid"], r["is_multi"], [tuple(s) for s in r["systems"]]) for r in protection.file_protection(files(spark, *data)).collect()}
    assert got[0] == ("cenc", "0" * 32, True, [("Widevine", "CAEAAAAAAAAAAAAAAAAAAAAA")])
    assert got[1] == (None, None, False, [("PlayReady", "AQID")])
    assert got[2] == ("cbcs", kid.hex(), True, [("Widevine", "EhAAAQIDBAUGBwgJCgsMDQ4P"), ("FairPlay", "Zg==")])
    assert got[3][:3] == ("cenc", other.hex(), False) and got[4] == (None, None, False, [])


@pytest.mark.parametrize("keys,kid,multi,wanted", [
    (["aa:1", "bb:2"], "bb", False, (None, "bb:2")), (["aa:1"], "bb", False, None), (["k"], "bb", True, ("1", "bb:k")), (["aa:1", "bb:2"], "0" * 32, False, ("1", "aa:1")), (["aa:1"], None, False, None), ([], "aa", False, None), (["k"], None, False, (None, ":k")),
])
def test_choose_key(spark, keys, kid, multi, wanted):
    row = spark.createDataFrame([(keys, kid, multi)], "k array<string>, kid string, m boolean").select(protection.choose_key(F.col("k"), F.col("kid"), F.col("m")).alias("c")).first()
    assert (tuple(row["c"]) if row["c"] else None) == wanted


def test_document_protection(spark):
    dash = '<MPD xmlns:cenc="urn:mpeg:cenc:2013"><Period><AdaptationSet><ContentProtection schemeIdUri="urn:mpeg:dash:mp4protection:2011" value="cenc" cenc:default_KID="00112233-4455-6677-8899-aabbccddeeff"/><ContentProtection schemeIdUri="urn:uuid:9a04f079-9840-4286-ab92-e65be0885f95"><cenc:pssh>READY</cenc:pssh></ContentProtection><ContentProtection schemeIdUri="urn:uuid:edef8ba9-79d6-4ace-a3c8-27dcd51d21ed"><cenc:pssh>WIDE</cenc:pssh></ContentProtection><Representation id="v"/></AdaptationSet><AdaptationSet><Representation/></AdaptationSet></Period></MPD>'
    got = protection.dash_protection(spark.createDataFrame([(1, "u", dash), (2, "u", None), (3, "u", "no xml")], "manifest_id long, url string, text string")).collect()
    assert [(r["manifest_id"], r["set_pos"], bytes(r["kid"]).hex(), r["scheme"], bytes(r["data"])) for r in got] == [(1, 0, "00112233445566778899aabbccddeeff", "cenc", b"WIDE")]


def test_wvtt_in_one_pass(spark):
    # sizes that part the boxes unevenly, a default duration, bytes that are no UTF-8; each segment is read once and only cues are dealt out
    a, b = cue("a"), cue("b", "line:1")
    usual = full("tfhd", u32(2, 7), flags=8)
    plain = box("moof", box("traf", usual, full("trun", u32(2)))) + box("mdat", a, b)
    rows = [(1, 0, fragment([a, box("vtte"), b], [10, 20], [len(a) + 8, len(b)])), (2, 0, plain), (3, 0, fragment([box("vttc", box("payl", b"\xff"))], [10])), (4, 0, fragment([a], [10, 10])[:-40])]
    segments = spark.createDataFrame([(d, s, bytearray(x)) for d, s, x in rows], "doc_id long, seg_pos long, data binary")
    cues = boxes.wvtt_cues(segments, 1000)
    assert sorted(tuple(r) for r in cues.collect()) == [(1, 0, 0, 10, "a", ""), (1, 1, 10, 30, "b", "line:1"), (2, 0, 0, 7, "a", ""), (2, 1, 7, 14, "b", "line:1"), (3, 0, 0, 10, "�", "")]
    plan = cues._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    samples = boxes.fragments(segments)[1].where("doc_id = 2").orderBy("k")
    assert [tuple(r) for r in samples.collect()] == [(2, 0, 0, 0, 7, None), (2, 0, 1, 7, 14, None)]


def test_files_are_read_once(spark, small):
    # rows that repeat an id are told by themselves, a file of nothing has no systems; nothing is joined or sorted
    data = box("moov", pssh(make.PLAYREADY, b"p"), box("trak", box("mdia", box("minf", box("stbl", full("stsd", u32(1), entry(bytes(16)))))))), box("moov", pssh(make.FAIRPLAY, b""))
    rows = [(1, bytearray(data[0])), (1, bytearray(data[1])), (2, None), (None, bytearray(data[1]))]
    got = protection.file_protection(spark.createDataFrame(rows, "id long, data binary"))
    assert sorted(((r["id"], r["scheme"], r["kid"], r["is_multi"], [tuple(s) for s in r["systems"]]) for r in got.collect()), key=str) == [
        (1, "cenc", "0" * 32, False, [("PlayReady", "cA==")]), (1, None, None, False, [("FairPlay", "")]), (2, None, None, False, []), (None, None, None, False, [("FairPlay", "")]),
    ]
    plan = protection_plans.file_keys(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Window" not in plan and plan.count("inline(") == 1
