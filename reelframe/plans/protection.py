"""Queries on content protection, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions import boxes as make
from reelframe.plans import media
from reelframe.sources import protection


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


def hex_of(n: Column) -> Column:
    return F.lower(F.lpad(F.hex(n), 32, "0"))


def dash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DASH document of each order: a protected set, a protected representation in another, and one that is not."""
    k, c = F.col("k"), F.col("c")
    said = lambda x: x.cast("string")
    one = lambda *p: F.concat(F.lit("<ContentProtection"), *p, F.lit("</ContentProtection>"))
    kid = F.concat(F.lit(' cenc:default_KID="'), F.when(k % 4 == 3, "broken").otherwise(F.concat(F.lit("{"), hex_of(k), F.lit("}"))), F.lit('"'))
    general = one(F.lit(' schemeIdUri="urn:mpeg:dash:mp4protection:2011" value="'), F.when(k % 2 == 0, "CENC").otherwise(" "), F.lit('"'), kid, F.lit(">"))
    ready = one(F.lit(' schemeIdUri="urn:uuid:9a04f079-9840-4286-ab92-e65be0885f95"><cenc:pssh>READY'), said(c), F.lit("</cenc:pssh>"))
    wide = one(F.lit(' schemeIdUri="urn:uuid:EDEF8BA9-79d6-4ace-a3c8-27dcd51d21ed"><cenc:pssh>WIDE'), said(c), F.lit("</cenc:pssh>"))
    own = one(F.lit(' value="cbcs" cenc:default_KID="'), hex_of(c), F.lit('"><cenc:pssh>OWN</cenc:pssh>'))
    body = F.concat(F.lit('<MPD xmlns:cenc="urn:mpeg:cenc:2013"><Period><AdaptationSet>'), F.when(k % 3 > 0, general).otherwise(""), F.when(k % 3 > 0, ready).otherwise(""), F.when(k % 3 > 1, wide).otherwise(""),
                    F.lit('<Representation id="a">'), own, F.lit('</Representation><Representation id="b"/></AdaptationSet></Period></MPD>'))
    return _orders(spark, sf_dir).select(k.alias("manifest_id"), F.lit("http://cdn.example/m.mpd").alias("url"), body.alias("text"))


def smooth_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Smooth Streaming document of each order with a header of PlayReady, of another system, or of none that does."""
    k = F.col("k")
    # the first three numbers of an identifier stand little-endian in the header; none of its bytes is zero
    kid = F.unhex(F.concat(F.lit("11223344556677889911AABBCC"), F.hex(F.lit(0x100000) + F.col("c") % 0xFFFFF + 0x111111)))
    xml = F.concat(F.lit("<WRMHEADER><DATA><KID>"), F.base64(kid), F.lit("</KID></DATA></WRMHEADER>"))
    header = F.when(k % 5 == 4, F.lit("no base64!")).otherwise(F.regexp_replace(F.base64(F.concat(make.raw("7E0201000100"), F.encode(F.when(k % 5 == 3, "<WRMHEADER/>").otherwise(xml), "UTF-16LE"))), r"\s", ""))
    system = F.when(k % 5 == 1, ' SystemID="9A04F079-9840-4286-AB92-E65BE0885F95"').when(k % 5 == 2, F.when(k % 2 == 0, ' SystemID="EDEF8BA9-79D6-4ACE-A3C8-27DCD51D21ED"').otherwise(' SystemID="11111111-2222-3333-4444-555555555555"')).otherwise("")
    level = '<StreamIndex Type="{0}"><QualityLevel Index="0" FourCC="{1}"/></StreamIndex>'
    body = F.concat(F.lit("<SmoothStreamingMedia><Protection><ProtectionHeader"), system, F.lit(">"), header, F.lit("</ProtectionHeader></Protection>" + level.format("video", "H264") + level.format("text", "TTML") + level.format("audio", "AACL") + "</SmoothStreamingMedia>"))
    return _orders(spark, sf_dir).select(k.alias("manifest_id"), F.lit("http://cdn.example/Manifest").alias("url"), body.alias("text"))


def dash_keys(spark, d):
    return protection.dash_protection(dash_documents(spark, d)).withColumns({"kid": F.lower(F.hex("kid")), "data": F.decode("data", "UTF-8")})


def smooth_keys(spark, d):
    return protection.smooth_protection(smooth_documents(spark, d)).withColumn("kid", F.lower(F.hex("kid"))).drop("data")


def file_keys(spark, d):
    """What init segments tell, and the key of two that goes with it."""
    found = protection.file_protection(media.init_bytes(spark, d).where("data is not null"))
    keys = F.array(F.concat(F.lit("00000000000000000000000000000005"), F.lit(":first")), F.concat(F.substring("kid", 1, 32), F.lit(":"), F.col("id").cast("string")))
    chosen = protection.choose_key(F.filter(keys, lambda k: k.isNotNull()), F.col("kid"), F.col("is_multi"))
    return found.select("id", "scheme", "kid", "is_multi", F.concat_ws(",", F.transform("systems", lambda s: F.concat_ws(":", s["system"], s["data"]))).alias("systems"), chosen["pair"].alias("pair"), chosen["track"].alias("track"))


QUERIES = {"dash_protection": dash_keys, "smooth_protection": smooth_keys, "file_protection": file_keys}

_HEX = "lower(lpad(printf('%x', {0}), 32, '0'))"
SQL = {
    "dash_protection": f"""SELECT k AS manifest_id, 0 AS period_pos, 0 AS set_pos, r AS rep_pos, 'Cenc' AS method,
        CASE WHEN k % 3 > 0 AND k % 4 <> 3 THEN {_HEX.format('k')} WHEN r = 0 THEN {_HEX.format('c')} END AS kid,
        CASE WHEN k % 3 = 0 THEN 'cbcs' WHEN k % 2 = 0 THEN 'cenc' ELSE 'urn:mpeg:dash:mp4protection:2011' END AS scheme,
        CASE WHEN k % 3 = 0 THEN 'OWN' WHEN k % 3 = 1 THEN 'READY' || c ELSE 'WIDE' || c END AS data
      FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders), (VALUES (0), (1)) v(r) WHERE r = 0 OR k % 3 > 0""",
    "smooth_protection": """SELECT k AS manifest_id, i AS index_pos, 0 AS level_pos, 'Cenc' AS method, 'cenc' AS scheme,
        CASE WHEN k % 5 = 1 THEN '9a04f079-9840-4286-ab92-e65be0885f95' WHEN k % 5 = 2 AND k % 2 = 0 THEN 'edef8ba9-79d6-4ace-a3c8-27dcd51d21ed' WHEN k % 5 = 2 THEN '11111111-2222-3333-4444-555555555555' ELSE '9a04f07998404286ab92e65be0885f95' END AS system,
        CASE WHEN k % 5 IN (0, 1) THEN '44332211665588779911aabbcc' || printf('%x', 1048576 + c % 1048575 + 1118481) WHEN k % 5 = 2 AND k % 2 = 1 THEN repeat('0', 32) END AS kid,
        CASE WHEN k % 5 = 4 THEN 'header is not base64' WHEN k % 5 = 2 AND k % 2 = 0 THEN 'system is not supported' WHEN k % 5 = 3 THEN 'no key identifier' END AS error
      FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders), (VALUES (0), (2)) v(i)""",
    "file_protection": f"""WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 5 = 0 AND o_orderkey % 8 <> 3 AS coded FROM orders WHERE o_orderkey % 8 <> 7),
      h AS (SELECT *, CASE WHEN coded THEN {_HEX.format('k')} END AS kid FROM s),
      w AS (SELECT *, coded AND k = 0 AS zero FROM h)
      SELECT k AS id, CASE WHEN coded THEN 'cenc' END AS scheme, CASE WHEN zero THEN '1210' || substr(kid, 1, 28) ELSE kid END AS kid, zero AS is_multi,
        CASE WHEN coded THEN 'PlayReady:' || to_base64(encode('data' || c)) || ',Widevine:' || to_base64(unhex('08011210' || kid || '1A046E647265220400000000')) ELSE '' END AS systems,
        CASE WHEN zero THEN '1210' || substr(kid, 1, 28) || ':' || k WHEN kid = '00000000000000000000000000000005' THEN kid || ':first' WHEN coded THEN kid || ':' || k END AS pair,
        CASE WHEN zero THEN '1' END AS track FROM w""",
}
