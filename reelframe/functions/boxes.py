"""MP4 boxes as byte columns, built bottom-up: what a box holds is built before its size is known.

Everything is a column expression, so a table of streams becomes a table of
init segments without a Python worker. The layouts are those of ISO/IEC
14496-12, 14496-14, 14496-15, 14496-30 and 23001-7.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions.once import let

#: The systems' identifiers.
WIDEVINE, PLAYREADY, FAIRPLAY = "edef8ba979d64acea3c827dcd51d21ed", "9a04f07998404286ab92e65be0885f95", "94ce86fb07ff4f43adb893d2fa968ca2"
#: The numbers that stand for sampling rates in audio configurations.
RATES = {96_000: 0, 88_200: 1, 64_000: 2, 48_000: 3, 44_100: 4, 32_000: 5, 24_000: 6, 22_050: 7, 16_000: 8, 12_000: 9, 11_025: 10, 8_000: 11, 7_350: 12}
VIDEO, AUDIO = {"H264": "avc1", "AVC1": "avc1", "DAVC": "avc1", "HVC1": "hvc1", "HEV1": "hvc1", "DVHE": "dvh1", "DVH1": "dvh1"}, {"AACL": "mp4a", "AACH": "mp4a", "EC-3": "ec-3"}
START_CODE = "00000001"


def raw(hex_digits: str) -> Column:
    return F.unhex(F.lit(hex_digits))


def ascii_(value: Column | str) -> Column:
    return F.encode(F.lit(value) if isinstance(value, str) else value, "UTF-8")


def number(value: Column | int, size: int) -> Column:
    """Big-endian, so many bytes; of larger or negative numbers the last ones."""
    if isinstance(value, int):
        return raw(f"{value % (1 << 8 * size):0{2 * size}x}")
    digits = F.concat(F.lit("0" * 2 * size), F.hex(value.cast("long")))
    return F.unhex(F.right(digits, F.lit(2 * size)))


def zeros(size: int) -> Column:
    return raw("00" * size)


def joined(*parts: Column) -> Column:
    return F.concat(*parts) if parts else raw("")


def box(name: str | Column, *parts: Column, wide: bool = False) -> Column:
    """A box of a four-letter name; wide: its size takes 64 bits."""
    if wide:
        return let(joined(*parts), lambda x: F.concat(number(1, 4), ascii_(name), number(F.length(x) + 16, 8), x))
    return let(joined(*parts), lambda x: F.concat(number(F.length(x) + 8, 4), ascii_(name), x))


def full_box(name: str, version: int, flags: int, *parts: Column) -> Column:
    return box(name, number(version, 1), number(flags, 3), *parts)


def limited(value: Column, most: int) -> Column:
    """Within 0 and most; null counts as 0."""
    return F.least(F.greatest(F.coalesce(value.cast("long"), F.lit(0)), F.lit(0)), F.lit(most))


def language_code(language: Column) -> Column:
    """Three letters of five bits each; "und" for less than three letters."""
    three = F.when(F.length(language) >= 3, language).otherwise("und")
    letter = lambda k: F.greatest(F.ascii(F.substring(three, k, 1)) - 0x60, F.lit(0))
    return F.shiftleft(letter(1), 10) + F.shiftleft(letter(2), 5) + letter(3)


def rate_number(rate: Column) -> Column:
    out = F.lit(0)
    for hertz, n in RATES.items():
        out = F.when(rate == hertz, n).otherwise(out)
    return out


def aac_private_data(four_cc: Column, rate: Column, channels: Column) -> Column:
    """The audio configuration that a stream of these facts has, in hex; null for what is not AAC.

    Two bytes of object type, rate and channels in 16 hex digits; with spectral
    band replication (AACH) two more for the doubled rate, in 16 hex digits too.
    """
    of = lambda kind, n: F.lit(kind << 11) + F.shiftleft(n, 7) + F.shiftleft(channels.cast("int") % 32, 3)
    own, twice = rate_number(rate), rate_number(rate * 2)
    high = F.concat(F.lpad(F.hex(of(5, own).bitwiseOR(F.shiftright(twice, 1))), 16, "0"), F.lpad(F.hex(F.shiftleft(twice % 2, 15) + (2 << 10)), 16, "0"))
    return F.when(four_cc == "AACH", high).when(four_cc.startswith("AAC"), F.lpad(F.hex(of(2, own)), 16, "0"))


def unit(private_data: Column, of_kind: Callable[[Column], Column]) -> Column:
    """The first unit between start codes whose first byte is of a kind, in hex; null if there is none."""
    units = F.filter(F.split(private_data, START_CODE), lambda u: u != "")
    return F.try_element_at(F.filter(units, lambda u: of_kind(F.conv(F.substring(u, 1, 2), 16, 10).cast("int"))), F.lit(1))


def byte(hex_digits: Column, k: int) -> Column:
    return F.conv(F.substring(hex_digits, 2 * k + 1, 2), 16, 10).cast("int")


def without_emulation(hex_digits: Column) -> Column:
    """Hex of bytes without each 03 after two zeros, which keeps start codes out of a unit."""
    pairs = F.regexp_replace(hex_digits, "(..)", "$1 ")
    return F.replace(F.regexp_replace(pairs, "(00 00 )03 ", "$1"), F.lit(" "), F.lit(""))


def avc_config(private_data: Column, length_field: Column) -> Column:
    """avcC; null without both parameter sets, or with one of under four bytes."""
    sps, pps = unit(private_data, lambda b: b % 32 == 7), unit(private_data, lambda b: b % 32 == 8)
    sized = lambda u: F.concat(number(F.length(u) / 2, 2), F.unhex(u))
    length = number(F.lit(0xFC).bitwiseOR(limited(length_field - 1, 255).cast("int")), 1)
    body = lambda s: let(pps, lambda p: box("avcC", number(1, 1), F.unhex(F.substring(s, 3, 6)), length, number(1, 1), sized(s), number(1, 1), sized(p)))
    return let(sps, lambda s: F.when(F.length(s) >= 8, body(s)))


def hevc_config(private_data: Column, length_field: Column) -> Column:
    """hvcC; null without all three parameter sets, or with a short one."""
    vps, sps, pps = (unit(private_data, f) for f in (lambda b: F.shiftright(b, 1) == 32, lambda b: F.shiftright(b, 1) == 33, lambda b: F.shiftright(b, 1) == 34))
    clean = without_emulation(sps)
    listed = lambda kind, u: F.concat(number(kind, 1), number(1, 2), number(F.length(u) / 2, 2), F.unhex(u))
    # profile, compatibility and constraints stand as in the parameter set
    told = lambda c: F.concat(F.unhex(F.substring(c, 7, 22)), number(byte(c, 3) % 32, 1))
    sets = [listed(kind, u) for kind, u in ((32, vps), (33, sps), (34, pps))]
    body = lambda c: box("hvcC", number(1, 1), told(c), raw("f000fcfcf8f80000"), number(limited(length_field - 1, 255), 1), number(3, 1), *sets)
    return let(clean, lambda c: F.when(F.length(c) >= 30, body(c)))


def hevc_codecs(private_data: Column, code: Column) -> Column:
    """The codec string that a parameter set of HEVC tells; null without it."""
    return let(without_emulation(unit(private_data, lambda b: F.shiftright(b, 1) == 33)), lambda clean: _hevc_codecs(clean, code))


def _hevc_codecs(clean: Column, code: Column) -> Column:
    profile = byte(clean, 3)
    space = F.get(F.array(*map(F.lit, ("", "A", "B", "C"))), F.shiftright(profile, 6))
    compatible = F.lower(F.regexp_replace(F.substring(clean, 9, 8), "^0+(?=.)", ""))
    constraints = F.replace(F.regexp_replace(F.regexp_replace(F.substring(clean, 17, 12), "(..)", "$1 "), "00 ", ""), F.lit(" "), F.lit(""))
    tier = F.when(F.shiftright(profile, 5) % 2 == 1, "H").otherwise("L")
    return F.when(F.length(clean) >= 30, F.concat(code, F.lit("."), space, (profile % 32).cast("string"), F.lit("."), compatible, F.lit("."), tier, byte(clean, 14).cast("string"), F.lit("."), F.upper(constraints)))


def elementary_stream(config: Column, track: Column, bandwidth: Column) -> Column:
    """esds of an audio configuration in hex."""
    rate = number(F.coalesce(bandwidth, F.lit(0)), 4)
    sized = lambda kind, data, more: F.concat(number(kind, 1), number(F.length(data) + more, 1))
    body = lambda data: F.concat(sized(3, data, 20), number(track % 65_536, 2), number(0, 1), sized(4, data, 15), raw("4015ffffff"), rate, rate, sized(5, data, 0), data)
    return full_box("esds", 0, 0, let(F.unhex(config), body))


def protection_scheme(codec: Column, kid: Column) -> Column:
    """sinf of an encrypted sample entry: the codec it hides, the scheme cenc, and the key identifier of 16 bytes."""
    return box("sinf", box("frma", ascii_(codec)), full_box("schm", 0, 0, ascii_("cenc"), raw("00010000")), box("schi", full_box("tenc", 0, 0, raw("00000108"), kid)))


def protection_system(system: Column | str, data: Column) -> Column:
    """pssh of a system's identifier, with or without dashes, and its data."""
    digits = F.replace(F.lit(system) if isinstance(system, str) else system, F.lit("-"), F.lit(""))
    return let(data, lambda x: full_box("pssh", 0, 0, F.unhex(digits), number(F.length(x), 4), x))


def widevine_data(kid: Column) -> Column:
    return F.concat(raw("08011210"), kid, raw("1a046e647265220400000000"))


def init_segment(stream: dict[str, Column], track: Column, created: Column, kid: Column | None = None, system: Column | None = None, system_data: Column | None = None) -> Column:
    """ftyp and moov of a Smooth Streaming track; null where its type or four letters are not known, or its private data does not do.

    stream: columns four_cc, kind (audio, video or text), private_data (hex),
    rate, channels, bits, length_field, timescale, duration, language, name,
    width, height, bandwidth. kid: where it is not null, sample entries are
    encrypted ones, and boxes for the system and for Widevine follow.
    """
    s = stream
    kind, four = s["kind"], s["four_cc"]
    created8, duration8, timescale4 = number(created, 8), number(s["duration"], 8), number(limited(s["timescale"], 2**32 - 1), 4)
    matrix = raw("00010000" + "00000000" * 3 + "00010000" + "00000000" * 3 + "40000000")
    private = F.when(F.coalesce(s["private_data"], F.lit("")) == "", F.coalesce(aac_private_data(four, s["rate"], s["channels"]), F.lit(""))).otherwise(F.upper(s["private_data"]))

    def entry(code: Column, hidden: str, *parts: Column) -> Column:
        """A sample entry by its own name, or by that of encrypted ones with the scheme behind."""
        body = joined(raw("0000000000000001"), *parts)
        if kid is not None:
            whole, name = F.when(kid.isNotNull(), F.concat(body, protection_scheme(code, kid))).otherwise(body), F.when(kid.isNotNull(), hidden).otherwise(code)
        else:
            whole, name = body, code
        return let(F.struct(name.alias("name"), whole.alias("body")), lambda x: F.concat(number(F.length(x["body"]) + 8, 4), ascii_(x["name"]), x["body"]))

    named = lambda codes: F.coalesce(*(F.when(four == k, F.lit(v)) for k, v in codes.items()))
    video, audio = named(VIDEO), named(AUDIO)
    config = F.when(video == "avc1", avc_config(private, s["length_field"])).otherwise(hevc_config(private, s["length_field"]))
    of_video = entry(video, "encv", zeros(16), number(limited(s["width"], 65_535), 2), number(limited(s["height"], 65_535), 2), raw("0048000000480000" + "00000000" + "0001" + "00" * 32 + "0018ffff"), config)
    of_audio = entry(audio, "enca", zeros(8), number(limited(s["channels"], 65_535), 2), number(limited(s["bits"], 65_535), 2), zeros(4), number(limited(s["rate"], 65_535), 2), zeros(2), elementary_stream(private, track, s["bandwidth"]))
    of_text = F.when(four == "TTML", box("stpp", raw("0000000000000001"), ascii_("http://www.w3.org/ns/ttml"), zeros(3)))
    by_kind = lambda a, v, t: F.when(kind == "audio", a).when(kind == "video", v).when(kind == "text", t)
    described = full_box("stsd", 0, 0, number(1, 4), by_kind(of_audio, of_video, of_text))
    tables = box("stbl", *(full_box(x, 0, 0, zeros(4)) for x in ("stts", "stsc", "stco")), full_box("stsz", 0, 0, zeros(8)), described)
    head = by_kind(full_box("smhd", 0, 0, zeros(4)), full_box("vmhd", 0, 1, zeros(8)), full_box("sthd", 0, 0))
    reference = box("dinf", full_box("dref", 0, 0, number(1, 4), full_box("url ", 0, 1)))
    handler = full_box("hdlr", 0, 0, zeros(4), ascii_(by_kind(F.lit("soun"), F.lit("vide"), F.lit("subt"))), zeros(12), ascii_(F.coalesce(s["name"], F.lit("handler"))), zeros(1))
    media_head = full_box("mdhd", 1, 0, created8, created8, timescale4, duration8, number(language_code(s["language"]), 2), zeros(2))
    track_head = full_box("tkhd", 1, 7, created8, created8, number(track, 4), zeros(4), duration8, zeros(12), number(F.when(kind == "audio", 1).otherwise(0), 1), zeros(3), matrix,
                          number(limited(s["width"], 65_535), 2), zeros(2), number(limited(s["height"], 65_535), 2), zeros(2))
    movie_head = full_box("mvhd", 1, 0, created8, created8, timescale4, duration8, raw("00010000" + "0100" + "0000" + "00" * 8), matrix, zeros(24), raw("ffffffff"))
    extends = box("mvex", full_box("mehd", 1, 0, duration8), full_box("trex", 0, 0, number(track, 4), number(1, 4), zeros(12)))
    systems = raw("") if kid is None else F.when(kid.isNotNull(), F.concat(protection_system(system, system_data), protection_system(WIDEVINE, widevine_data(kid)))).otherwise(raw(""))
    trak = box("trak", track_head, box("mdia", media_head, handler, box("minf", head, reference, tables)))
    return F.concat(box("ftyp", ascii_("isml"), number(1, 4), ascii_("iso5iso6piffmsdh")), box("moov", movie_head, trak, extends, systems))
