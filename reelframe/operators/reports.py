"""Texts that tell of streams: metadata as JSON, facts read from a tool's text, keys looked up in a file of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions import moments
from reelframe.functions.once import let
from reelframe.operators.select import number_text

#: Names of media types and methods in metadata, and of the fields in their order.
TYPES = {"Audio": "AUDIO", "Video": "VIDEO", "Subtitles": "SUBTITLES", "ClosedCaptions": "CLOSED_CAPTIONS"}
METHODS = {"None": "NONE", "Aes128": "AES_128", "Aes128Ecb": "AES_128_ECB", "SampleAes": "SAMPLE_AES", "SampleAesCtr": "SAMPLE_AES_CTR", "Cenc": "CENC", "ChaCha20": "CHACHA20", "Unknown": "UNKNOWN"}
BEFORE = (("GroupId", "group_id"), ("Language", "language"), ("Name", "name"))
FACTS = (("Codecs", "codecs"), ("Resolution", "resolution"))
AFTER = (("Channels", "channels"), ("Extension", "extension"), ("Role", "role"), ("VideoRange", "video_range"), ("Characteristics", "characteristics"), ("PublishTime", "publish_time"), ("AudioId", "audio_id"), ("VideoId", "video_id"), ("SubtitleId", "subtitle_id"), ("PeriodId", "period_id"))


def quoted(text: Column) -> Column:
    """A JSON string; only quotes, backslashes, line ends and tabs are escaped."""
    out = text
    for mark, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(mark), F.lit(written))
    return F.concat(F.lit('"'), out, F.lit('"'))


def object_(indent: int, *fields: tuple[str, Column]) -> Column:
    """A JSON object over several lines, closed at an indent; null fields are left out."""
    inside = " " * (indent + 2)
    listed = F.array_join(F.array(*(F.concat(F.lit(f'{inside}"{name}": '), value) for name, value in fields)), ",\n")
    return F.concat(F.lit("{\n"), listed, F.lit("\n" + " " * indent + "}"))


def list_(indent: int, items: Column) -> Column:
    inside = " " * (indent + 2)
    return let(items, lambda x: F.when(F.size(x) == 0, "[]").otherwise(F.concat(F.lit("[\n" + inside), F.array_join(x, ",\n" + inside), F.lit("\n" + " " * indent + "]"))))


def of_names(column: Column, names: dict[str, str]) -> Column:
    """A fixed name as a JSON string."""
    return F.coalesce(*(F.when(column == k, F.lit(f'"{v}"')) for k, v in names.items()))


def metadata_json(streams: DataFrame, segments: DataFrame) -> DataFrame:
    """(manifest_id, body): what is known of a manifest's streams as one JSON text, streams by stream_pos.

    streams: manifest_id, stream_pos, url and those columns of theirs that are
    there. segments: stream_pos, part_pos, seg_pos, seg_index, duration, url,
    method, and start_range, expected_length, title, date_time, key, iv where
    they are there. A stream without segments has no playlist.

    Rows are dealt out as they are, segments to their stream and streams to their
    manifest, before anything is gathered; texts are written last and not shuffled.
    """
    mine, theirs = set(segments.columns), set(streams.columns)
    nothing = F.lit(None).cast("string")
    said = lambda flag: F.when(flag, "true").otherwise("false")
    text = lambda of, x, c: quoted(x[c].cast("string")) if c in of else nothing
    number = lambda of, x, c: number_text(x[c]) if c in of else nothing

    def segment(s: Column) -> Column:
        coded = object_(14, ("Method", of_names(s["method"], METHODS)), *((n, quoted(F.regexp_replace(F.base64(s[c]), r"\s", "")) if c in mine else nothing) for n, c in (("Key", "key"), ("IV", "iv"))))
        stop = (s["start_range"] + s["expected_length"] - 1).cast("string") if "start_range" in mine else nothing
        return object_(
            12, ("Index", s["seg_index"].cast("string")), ("Duration", number(mine, s, "duration")), ("Title", text(mine, s, "title")), ("DateTime", text(mine, s, "date_time")), ("StartRange", number(mine, s, "start_range")),
            ("StopRange", stop), ("ExpectLength", number(mine, s, "expected_length")), ("EncryptInfo", coded), ("IsEncrypted", said(s["method"] != "None")), ("Url", quoted(F.replace(s["url"], F.lit("%20"), F.lit(" ")))), ("NameFromVar", text(mine, s, "name_from_var")),
        )

    def stream(s: Column) -> Column:
        live = s["is_live"] if "is_live" in theirs else F.lit(False)
        refresh = s["refresh_ms"].cast("double") if "refresh_ms" in theirs else F.lit(None).cast("double")
        parts = F.transform(s["parts"], lambda p: object_(8, ("MediaSegments", list_(10, F.transform(p["xs"], segment)))))
        playlist = object_(4, ("Url", F.lit('""')), ("IsLive", said(live)), ("RefreshIntervalMs", number_text(F.coalesce(refresh, F.lit(15_000.0)))), ("TotalDuration", number_text(s["total"])), ("TargetDuration", number(theirs, s, "target_duration")), ("MediaParts", list_(6, parts)))
        address = lambda c: quoted(F.replace(F.coalesce(s[c], F.lit("")), F.lit(" "), F.lit("%20"))) if c in theirs else F.lit('""')
        return object_(
            2, ("MediaType", of_names(s["media_type"], TYPES)), *((n, text(theirs, s, c)) for n, c in BEFORE), ("SkippedDuration", number(theirs, s, "skipped_duration")), ("Bandwidth", number(theirs, s, "bandwidth")), *((n, text(theirs, s, c)) for n, c in FACTS),
            ("FrameRate", number(theirs, s, "frame_rate")), *((n, text(theirs, s, c)) for n, c in AFTER), ("Url", address("url")), ("OriginalUrl", address("original_url")), ("Playlist", F.when(s["parts"].isNotNull(), playlist)), ("SegmentsCount", F.coalesce(s["n"], F.lit(0)).cast("string")),
        )

    told = [c for c in segments.columns if c not in ("stream_pos", "part_pos", "seg_pos")]
    held = F.transform(F.sort_array(F.collect_list(F.struct("seg_pos", F.struct(*told).alias("x")))), lambda s: s["x"])
    parts = segments.repartition("stream_pos").groupBy("stream_pos", "part_pos").agg(held.alias("xs"), F.sum("duration").alias("duration"), F.count("*").alias("n"))
    lists = parts.groupBy("stream_pos").agg(F.sort_array(F.collect_list(F.struct("part_pos", "xs"))).alias("parts"), F.sum("duration").alias("total"), F.sum("n").alias("n"))
    x = streams.join(lists, "stream_pos", "left").repartition("manifest_id")
    each = x.groupBy("manifest_id").agg(F.sort_array(F.collect_list(F.struct("stream_pos", *(c for c in x.columns if c not in ("manifest_id", "stream_pos"))))).alias("xs"))
    return each.select("manifest_id", list_(0, F.transform("xs", stream)).alias("body"))


def media_infos(outputs: DataFrame) -> DataFrame:
    """(id, pos, stream_id, media_type, text, base_info, bitrate, resolution, fps, start_ms, dolby_vision, hdr) from a tool's text on a file.

    outputs: (id, text). One row a line "  Stream #..."; a text without one is a row of unknown type.
    Each text's rows come from the text alone: nothing is shuffled, sorted or joined.
    """
    part = lambda c, p, g=1: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    start = moments.cue_millis(F.concat(part(F.col("text"), r"Duration.*?start: (\d+\.?\d{0,3})"), F.lit("s")))
    dovi = F.col("text").rlike(r"DOVI configuration record.*profile: (\d).*compatibility id: (\d)")
    streams = F.filter(F.split("text", "\r?\n"), lambda line: line.startswith("  Stream #"))
    x = outputs.select("id", start.alias("start_ms"), dovi.alias("dovi"), F.posexplode_outer(streams).alias("pos", "line"))
    line, own = F.col("line"), F.col("own")
    x = x.withColumn("media_type", F.when(line.isNull(), "Unknown").otherwise(part(line, r": (\w+): (.*)", 1))).withColumn("own", F.regexp_replace(part(line, r": (\w+): (.*)", 2), r"\s+$", ""))
    x = x.withColumn("base_info", F.regexp_replace(F.regexp_extract("own", r"^(.*?)(,|$)", 1), r" / 0x\w+", ""))
    vision = F.col("base_info").rlike("dvhe|dvh1|DOVI") | F.col("media_type").contains("dvvideo") | (F.col("dovi") & (F.col("media_type") == "Video"))
    return x.select("id", F.coalesce("pos", F.lit(0)).alias("pos"), part(line, r"#0:\d(\[0x\w+?\])").alias("stream_id"), "media_type", own.alias("text"), "base_info", part(own, r"(\d+ kb/s)").alias("bitrate"), part(own, r"(\d{2,}x\d+)").alias("resolution"),
                    part(own, r"(\d+(?:\.\d+)? fps)").alias("fps"), F.when(line.isNotNull(), F.col("start_ms")).alias("start_ms"), F.coalesce(vision, F.lit(False)).alias("dolby_vision"), F.coalesce(own.contains("/bt2020/"), F.lit(False)).alias("hdr"))


def keys_of(kids: DataFrame, lines: DataFrame) -> DataFrame:
    """kids (kid) with `line`: the first line of a key file (pos, text) that begins with it, white space cut.

    Identifiers of one length join by that many characters, so that no pair is tried that does not fit.
    """
    text = F.trim(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    lengths = [r["n"] for r in kids.where("kid <> ''").select(F.length("kid").alias("n")).distinct().collect()]  # lengths of identifiers: a few
    each = lines.select("pos", text.alias("line"), F.explode(F.array(*map(F.lit, lengths or [1]))).alias("n")).where(F.length("line") >= F.col("n"))
    first = each.withColumn("kid", F.expr("substring(line, 1, n)")).groupBy("kid").agg(F.min_by("line", "pos").alias("line"))
    return kids.join(first, "kid", "left")
