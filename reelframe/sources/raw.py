"""Raw bytes as sources: which are text and in what coding, which are transport streams and what these tell.

Files are (id, data), with content_type where a server told it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.functions import blobs, text as names

#: Bytes that are looked at to tell text from other data, and the share of bytes that are no text from which on it is not.
SAMPLE, MOST_OTHER = 4_096, 0.3
#: Byte order marks with their codings, and labels that stand for other codings than they say.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
LABELS = {
    "utf-16": "utf-16-le", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "ascii": "cp1252", "us-ascii": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "l1": "cp1252", "windows-1252": "cp1252",
    "iso-8859-9": "cp1254", "latin5": "cp1254", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "gbk": "gb18030", "gb2312": "gb18030", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "tis-620": "cp874", "iso-8859-11": "cp874",
}


def looks_binary(data: Column) -> Column:
    """Whether the first bytes hold a zero, or more than three in ten that are neither printable nor a sequence of UTF-8."""
    s = F.decode(F.substr(data, F.lit(1), F.lit(SAMPLE)), "ISO-8859-1")  # a character a byte
    sequence = "[À-ß][\u0080-¿]|[à-ï][\u0080-¿]{2}|[ð-÷][\u0080-¿]{3}"
    rest = F.regexp_replace(s, sequence, "é")  # one unit each
    plain = F.length(F.regexp_replace(rest, r"[^\x09\x0A\x0D\x20-\x7e]", ""))
    other = F.length(rest) - plain - F.regexp_count(s, F.lit(sequence))
    return (F.length(s) > 0) & (s.contains("\0") | (other / F.length(rest) > MOST_OTHER))


def charset(content_type: Column) -> Column:
    """The charset of a content type in lower case, quotes cut; null if it tells none."""
    told = F.filter(F.transform(F.split(content_type, ";"), lambda p: F.trim(p)), lambda p: p.contains("=") & (F.lower(F.substring_index(p, "=", 1)) == "charset"))
    return F.lower(F.regexp_replace(F.regexp_extract(F.try_element_at(told, F.lit(1)), "^[^=]*=(.*)$", 1), '^"+|"+$', ""))


def decode(data: bytes, label: str | None) -> str:
    """Text by a byte order mark, else by a label, else UTF-8; what cannot be read is replaced."""
    for mark, coding in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(coding, "replace")
    coding = LABELS.get(label, label) if label else "utf-8"
    if coding == "cp1252":  # five bytes stand for themselves
        return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in data)
    try:
        return data.decode(coding, "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def source_texts(files: DataFrame) -> DataFrame:
    """(id, kind, text, error): hls, dash, mss, ts or binary, the text of the first three, and why there is no kind.

    A transport stream is told by its packets, whatever else is said; with a
    charset or a byte order mark data is text; else the first bytes decide. White space around a
    text goes, and a mark. Null data is an error, like an empty text. No rows give no rows.
    """
    told = charset(F.col("content_type")) if "content_type" in files.columns else F.lit(None).cast("string")
    data = F.col("data")
    marked = F.hex(F.substr(data, F.lit(1), F.lit(3))).rlike("^(EFBBBF|FFFE|FEFF)")
    stream = F.coalesce(blobs.is_transport_stream(data), F.lit(False))
    binary = ~stream & told.isNull() & ~marked & looks_binary(data)
    x = files.select("id", "data", told.alias("charset"), stream.alias("stream"), F.coalesce(binary, F.lit(False)).alias("binary"))
    kept = x.select("id", F.when(~F.col("stream") & ~F.col("binary"), F.col("data")).alias("data"), "charset", "stream", "binary")
    schema = T.StructType([kept.schema["id"], T.StructField("stream", T.BooleanType()), T.StructField("binary", T.BooleanType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if d is None else decode(d, c).encode("utf-8", "replace").decode() for d, c in zip(batch.column("data").to_pylist(), batch.column("charset").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "stream", "binary")), pa.array(texts, pa.string())], schema.names)

    done = kept.mapInArrow(run, schema)
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), "^﻿+", ""), r"(?U)^\s+$", "")
    kind = F.when(F.col("stream"), "ts").when(F.col("binary"), "binary").otherwise(names.source_kind(body))
    error = F.when(F.col("stream") | F.col("binary"), None).when(F.coalesce(body, F.lit("")) == "", "empty").when(kind.isNull(), "unknown kind")
    return done.select("id", kind.alias("kind"), body.alias("text"), error.alias("error"))


#: Bytes of a packet, and the program identifiers of the tables that are read. Fixed values of the format.
PACKET, PROGRAMS, SERVICES = 188, 0x00, 0x11


def service_of(data: bytes) -> tuple[str, str, str] | None:
    """(program, provider, name) that the first tables of a transport stream tell; null if they do not, or one of them is cut off."""
    at = np.frombuffer(data, np.uint8)
    if len(at) <= PACKET:
        return None
    program = provider = name = ""
    for o in np.flatnonzero((at[:-PACKET] == 0x47) & (at[PACKET:] == 0x47)).tolist():
        body, pid = data[o + 4 : o + PACKET], int.from_bytes(data[o + 1 : o + 3]) & 0x1FFF
        if pid == PROGRAMS:
            program = str(int.from_bytes(body[9:11]))
        elif pid == SERVICES and body[1] == 0x42:
            n = int.from_bytes(body[2:4]) & 0x0FFF
            section = body[4 : 4 + n]
            loop = section[8:]
            size = int.from_bytes(loop[3:5]) & 0x0FFF
            held = loop[5 : 5 + size]
            if 4 + n > len(body) or n < 13 or 5 + size > len(loop) or size < 4:
                return None
            end = 4 + held[3]
            if end >= size or end + 1 + held[end] > size:
                return None
            provider, name = (x.decode("utf-8", "replace") for x in (held[4:end], held[end + 1 : end + 1 + held[end]]))
        if program and (provider or name):
            return program, provider, name
    return None


def services(files: DataFrame) -> DataFrame:
    """(id, program, provider, name) of transport streams (id, data), null where the data does not tell."""
    schema = T.StructType([files.schema["id"], *(T.StructField(c, T.StringType()) for c in ("program", "provider", "name"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [service_of(d) if d else None for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([x and x[k] for x in found], pa.string()) for k in range(3))], schema.names)

    return files.select("id", "data").mapInArrow(run, schema)


def recordings(chunks: DataFrame, limit_ms: int | None = None) -> DataFrame:
    """chunks (session_id, seq, n_bytes, elapsed_ms) with size_bytes, seconds, and whether recording stops, after each of them.

    The chunk that reaches the limit is still recorded; those behind it are not there.
    """
    by = Window.partitionBy("session_id").orderBy("seq")
    x = chunks.withColumns({"size_bytes": F.sum("n_bytes").over(by), "seconds": F.floor(F.col("elapsed_ms") / 1000)})
    stop = F.lit(False) if limit_ms is None else F.col("elapsed_ms") >= limit_ms
    x = x.withColumn("stop", stop)
    over = F.coalesce(F.max(F.col("stop").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("over", over).where("over = 0").drop("over")
