"""Content protection: what DASH and Smooth Streaming documents and MP4 files tell of keys, and which key goes with them.

Documents are (manifest_id, url, text), files (id, data). Nothing is decrypted here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions import blobs, boxes as make, text as names
from reelframe.sources import boxes
from reelframe.sources.manifests import FOUR_CC, LEVEL, REPRESENTATION, parsed

_ONE = "ContentProtection: array<struct<_schemeIdUri: string, _value: string, _default_KID: string, pssh: array<string>>>"
MPD = f"Period array<struct<AdaptationSet: array<struct<{_ONE}, Representation: array<struct<_id: string, {_ONE}>>>>>>"
SMOOTH = "Protection struct<ProtectionHeader: struct<_SystemID: string, _VALUE: string>>, StreamIndex array<struct<_Type: string, QualityLevel: array<struct<_Index: string, _FourCC: string>>>>"
ZERO_KID = "0" * 32
SYSTEMS = {make.WIDEVINE: "Widevine", make.PLAYREADY: "PlayReady", make.FAIRPLAY: "FairPlay"}


def key_id(text: Column) -> Column:
    """16 bytes from the first word of a text, in hex with dashes and braces or without; null for anything else."""
    word = F.regexp_extract(text, r"^\s*(\S+)", 1)
    digits = F.replace(F.regexp_replace(word, r"^\{+|\}+$", ""), F.lit("-"), F.lit(""))
    return F.when(digits.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(digits))


def told(protections: Column) -> Column:
    """struct<kid, scheme, data> of a list of ContentProtection elements: the first of each, but Widevine's data before others (the last that has some)."""
    present = lambda c: F.when(F.trim(c) != "", F.trim(c))
    kid = lambda p: key_id(p["_default_KID"])
    scheme = lambda p: F.lower(F.coalesce(present(p["_value"]), present(p["_schemeIdUri"])))
    data = lambda p: F.try_element_at(F.filter(p["pssh"], lambda x: x.isNotNull()), F.lit(1))
    widevine = lambda p: F.coalesce(names.normalize_token(p["_schemeIdUri"]).contains(make.WIDEVINE), F.lit(False))
    each = F.transform(protections, lambda p: F.named_struct(F.lit("kid"), kid(p), F.lit("scheme"), scheme(p), F.lit("data"), data(p), F.lit("widevine"), widevine(p)))
    has = lambda c: F.filter(each, lambda p: p[c].isNotNull())
    first = lambda c: F.try_element_at(has(c), F.lit(1))[c]
    special = F.try_element_at(F.filter(each, lambda p: p["widevine"] & p["data"].isNotNull()), F.lit(-1))["data"]
    return F.named_struct(F.lit("kid"), first("kid"), F.lit("scheme"), first("scheme"), F.lit("data"), F.coalesce(special, first("data")))


def dash_protection(documents: DataFrame) -> DataFrame:
    """(REPRESENTATION, method, kid, scheme, data) of the representations that are protected, by themselves or by their adaptation set.

    What the set tells comes first, what it leaves out the representation tells.
    The attribute default_KID is found as the standard writes it.
    data is the text of a pssh element as bytes.
    """
    x = parsed(documents, MPD).select("manifest_id", F.posexplode("Period").alias("period_pos", "p")).select("manifest_id", "period_pos", F.posexplode("p.AdaptationSet").alias("set_pos", "a"))
    x = x.select("manifest_id", "period_pos", "set_pos", told(F.col("a.ContentProtection")).alias("above"), (F.size("a.ContentProtection") > 0).alias("whole"), F.posexplode("a.Representation").alias("rep_pos", "r"))
    x = x.where(F.coalesce("whole", F.lit(False)) | F.coalesce(F.size("r.ContentProtection") > 0, F.lit(False))).withColumn("own", told(F.col("r.ContentProtection")))
    either = lambda c: F.coalesce(F.col(f"above.{c}"), F.col(f"own.{c}")).alias(c)
    return x.select(*REPRESENTATION, F.lit("Cenc").alias("method"), either("kid"), either("scheme"), either("data")).withColumn("data", F.encode("data", "UTF-8"))


def playready_key_id(header: Column) -> Column:
    """The key identifier of a PlayReady header: base64 in a KID element of its UTF-16 text, its first three numbers little-endian; null without one of 16 bytes."""
    text = F.try_to_binary(F.replace(F.hex(header), F.lit("00"), F.lit("")), F.lit("hex"))
    encoded = F.regexp_extract(F.decode(text, "ISO-8859-1"), "<KID>([^<]*)<", 1)
    digits = F.hex(blobs.strict_base64(encoded))
    places = (3, 2, 1, 0, 5, 4, 7, 6, *range(8, 16))
    return F.when(F.length(digits) == 32, F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in places))))


def smooth_protection(documents: DataFrame) -> DataFrame:
    """(LEVEL, method, scheme, system, data, kid, error) of the quality levels of protected documents; text tracks are not protected.

    Without a system's identifier a header is PlayReady's. Other systems but
    Widevine have a key identifier of zeros; Widevine's is not supported, which is
    told as an error, like a header that is not base64 or has no key identifier.
    """
    x = parsed(documents, SMOOTH).where("Protection.ProtectionHeader is not null")
    header = F.col("Protection.ProtectionHeader")
    x = x.select("manifest_id", F.lower(F.coalesce(header["_SystemID"], F.lit(make.PLAYREADY))).alias("system"), blobs.strict_base64(F.trim(F.coalesce(header["_VALUE"], F.lit("")))).alias("data"), F.posexplode("StreamIndex").alias("index_pos", "s"))
    x = x.select("*", F.posexplode("s.QualityLevel").alias("level_pos", "q")).where(F.upper("q._FourCC").isin(*FOUR_CC) & (F.coalesce("s._Type", F.lit("")) != "text"))
    plain = F.replace("system", F.lit("-"), F.lit(""))
    kid = F.when(plain == make.PLAYREADY, playready_key_id(F.col("data"))).when(plain != make.WIDEVINE, F.unhex(F.lit(ZERO_KID)))
    error = F.when(F.col("data").isNull(), "header is not base64").when(plain == make.WIDEVINE, "system is not supported").when(F.col("kid").isNull(), "no key identifier")
    return x.withColumn("kid", kid).select(*LEVEL, F.lit("Cenc").alias("method"), F.lit("cenc").alias("scheme"), "system", "data", "kid", error.alias("error"))


def _box_told(box: Column) -> Column:
    """struct<system, data, scheme, kid>: what a box (name, payload) tells, each null where it is not its to tell."""
    name, p = box["name"], box["payload"]
    version = F.hex(F.substr(p, F.lit(1), F.lit(1)))
    at = F.when(version == "01", F.lit(24) + F.coalesce(boxes.uint(p, 20), F.lit(0)) * 16).otherwise(20)
    digits = F.lower(F.hex(F.substr(p, F.lit(5), F.lit(16))))
    system = F.coalesce(*(F.when(digits == k, F.lit(v)) for k, v in SYSTEMS.items()))
    whole = (F.length(p) >= 24) & version.isin("00", "01") & (F.length(p) >= at + 4 + boxes.uint(p, at))
    of = lambda kind, value: F.when(name == kind, value)
    return F.struct(
        of("pssh", F.when(whole, system)).alias("system"), of("pssh", F.substr(p, (at + 5).cast("int"), boxes.uint(p, at).cast("int"))).alias("data"),
        of("schm", F.decode(F.substr(p, F.lit(5), F.lit(4)), "ISO-8859-1")).alias("scheme"), of("tenc", F.when(F.length(p) >= 24, F.lower(F.hex(F.substr(p, F.lit(9), F.lit(16)))))).alias("kid"),
    )


def file_protection(files: DataFrame) -> DataFrame:
    """(id, scheme, kid, is_multi, systems) of MP4 files (id, data), one row each.

    scheme and kid (hex) are those of the last sample entry. A Widevine box takes
    the place of a key identifier of zeros with bytes 2 to 17 of its data, and the
    file is one of several systems. systems: struct<system, data> of the known
    systems' boxes in order, data in base64.
    """
    x = boxes.payloads(files, "pssh", "schm", "tenc").select("id", F.transform("held", _box_told).alias("told"))
    those = lambda c: F.filter("told", lambda b: b[c].isNotNull())
    # at a system's box the key identifier is that of the entry before it, or else of the first behind it
    none = F.lit(None).cast("string")
    start = F.struct(F.get(those("kid"), 0)["kid"].alias("then"), none.alias("kid"), F.lit(False).alias("is_multi"))

    def with_box(state: Column, b: Column) -> Column:
        then = F.coalesce(b["kid"], state["then"])
        taken = (b["system"] == "Widevine") & (then == ZERO_KID) & (F.length(b["data"]) >= 18)
        own = F.when(taken, F.lower(F.hex(F.substr(b["data"], F.lit(3), F.lit(16)))))
        return F.struct(then.alias("then"), F.coalesce(own, b["kid"], state["kid"]).alias("kid"), (state["is_multi"] | own.isNotNull()).alias("is_multi"))

    listed = F.transform(those("system"), lambda b: F.struct(b["system"].alias("system"), F.regexp_replace(F.base64(b["data"]), "\\s", "").alias("data")))
    x = x.select("id", F.try_element_at(those("scheme"), F.lit(-1))["scheme"].alias("scheme"), F.aggregate("told", start, with_box).alias("end"), listed.alias("systems"))
    return x.select("id", "scheme", "end.kid", "end.is_multi", "systems")


def choose_key(keys: Column, kid: Column, is_multi: Column) -> Column:
    """struct<track, pair>: of keys ("kid:key" or one bare key) the one for a key identifier, and the track it is for; null without one.

    The key whose text begins with the identifier; for one of zeros the first
    key and track 1; a single bare key goes with any identifier.
    """
    own = F.coalesce(kid, F.lit(""))
    zero = own == ZERO_KID
    first = F.try_element_at(keys, F.lit(1))
    fits = F.when(own != "", F.try_element_at(F.filter(keys, lambda k: k.startswith(own)), F.lit(1)))
    bare = F.when((F.size(keys) == 1) & ~first.contains(":"), F.concat(own, F.lit(":"), first))
    pair = F.coalesce(F.when(zero, first).otherwise(fits), bare)
    return F.when(pair.isNotNull(), F.struct(F.when(zero | F.coalesce(is_multi, F.lit(False)), "1").alias("track"), pair.alias("pair")))
