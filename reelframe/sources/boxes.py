"""MP4 files as rows: their boxes, the samples of a fragment, the cues of WebVTT and TTML tracks.

Where a box begins is known only from the size of the one before it, so a small
loop over one file's headers makes the rows; it runs on Arrow batches and never
copies what a box holds. The samples of a WebVTT fragment and their share of its
bytes come from the same loop; what joins segments is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.groups import KINDS

#: Boxes that hold boxes, and how many bytes of their own come first. Fixed values of the format.
CONTAINERS = {"moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "dinf": 0, "mvex": 0, "moof": 0, "traf": 0, "sinf": 0, "schi": 0, "edts": 0, "udta": 0, "vttc": 0, "dref": 8, "stsd": 8}
SAMPLE_ENTRIES = {"encv": 78, "avc1": 78, "hvc1": 78, "hev1": 78, "dvh1": 78, "enca": 28, "mp4a": 28, "ec-3": 28}
#: Boxes of a WebVTT track's segments that hold boxes.
IN_MEDIA = CONTAINERS | SAMPLE_ENTRIES | {"mdat": 0}
ROW = "id {kind}, nth int, depth int, path string, name string, begin long, header int, size long, error string"


def walk(data: memoryview, containers: dict[str, int]) -> Iterator[tuple[int, str, str, int, int, int, str | None]]:
    """(depth, path, name, begin, header, size, error) of a file's boxes, each before those in it.

    A size of 1 is told by the next 64 bits, a size of 0 goes to the end of what
    the box is in. A box that is shorter than its header or longer than what it
    is in ends that level with a row that says so; fewer than eight bytes at the end are passed over.
    """
    levels = [(0, len(data), 0, "")]
    while levels:
        at, end, depth, path = levels.pop()
        if at + 8 > end:
            continue
        size, header = int.from_bytes(data[at : at + 4]), 8
        name = bytes(data[at + 4 : at + 8]).decode("latin-1")
        if size == 1:
            size, header = int.from_bytes(data[at + 8 : at + 16]) if at + 16 <= end else 0, 16
        elif size == 0:
            size = end - at
        own = f"{path}/{name}" if path else name
        if size < header or at + size > end:
            yield depth, own, name, at, header, size, "size of a box"
            continue
        yield depth, own, name, at, header, size, None
        levels.append((at + size, end, depth, path))
        if (skip := containers.get(name)) is not None:
            levels.append((at + header + skip, at + size, depth + 1, own))


def boxes(files: DataFrame, inside: tuple[str, ...] = (), data: str = "data") -> DataFrame:
    """(id, nth, depth, path, name, begin, header, size, error) for files (id, data), boxes in the order of the file.

    inside: names that hold boxes besides the usual ones (mdat of a WebVTT
    track). A null or empty file has no boxes. Rows that repeat an id are walked
    each. No rows give no rows.
    """
    containers = CONTAINERS | SAMPLE_ENTRIES | dict.fromkeys(inside, 0)
    kind = files.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, x in enumerate(batch.column(data)):
                if x.is_valid:
                    found = [(n, *row) for n, row in enumerate(walk(memoryview(x.as_buffer()), containers))]
                    rows += found
                    owner += [i] * len(found)
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "nth", "depth", "path", "name", "begin", "header", "size", "error"])

    return files.select("id", data).mapInArrow(run, ROW.format(kind=kind))


def uint(data: Column, at: Column | int, size: int = 4) -> Column:
    """A big-endian number at a place counted from 0; null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substr(data, at.cast("int") + 1, F.lit(size)))
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).cast("decimal(20,0)").cast("long") if size == 8 else F.conv(digits, 16, 10).cast("long"))


def payloads(files: DataFrame, *names: str, data: str = "data") -> DataFrame:
    """(id, held): what the boxes of these names hold, in the order of the file, as array<struct<name, payload>>; one row a file.

    A file is read once and nothing is joined or shuffled. A null or empty file has none, a box with an error is left out.
    """
    containers, kind = CONTAINERS | SAMPLE_ENTRIES, files.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, found, held = [0], [], []
            for x in batch.column(data):
                whole = memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")
                for _, _, name, begin, header, size, error in walk(whole, containers):
                    if error is None and name in names:
                        found.append(name)
                        held.append(whole[begin + header : begin + size])
                ends.append(len(found))
            structs = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(held, pa.binary())], ["name", "payload"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], ["id", "held"])

    return files.select("id", data).mapInArrow(run, f"id {kind}, held array<struct<name: string, payload: binary>>")


def timescale(init: Column) -> Column:
    """The time units a second of an init segment that tells of WebVTT; null for others."""
    hexed, anywhere = F.hex(init), "^(?:[0-9A-F]{2})*?"  # on whole bytes
    body = F.regexp_extract(hexed, f"{anywhere}{b'mdhd'.hex().upper()}([0-9A-F]*)$", 1)
    digits = F.when(F.substring(body, 1, 2) == "01", F.substring(body, 41, 8)).otherwise(F.substring(body, 25, 8))
    return F.when(hexed.rlike(anywhere + b"wvtt".hex().upper()) & (F.length(digits) == 8), F.conv(digits, 16, 10).cast("long"))


def number_at(data: bytes, at: int, size: int = 4) -> int | None:
    """A big-endian number of a box's content; None past its end."""
    return int.from_bytes(data[at : at + size]) if at + size <= len(data) else None


def samples_of(parts: dict[str, bytes]) -> tuple[Iterator[tuple[int | None, int | None, int | None]], str | None]:
    """(start, end, size) of a fragment's samples in time units, by its last tfdt, tfhd and trun; and what is wrong with them.

    A sample has a size or None (one box). It starts where the one before it
    ended, or its own offset after the fragment's time.
    """
    tfdt, tfhd, trun = (parts.get(x) for x in ("tfdt", "tfhd", "trun"))
    n, flags = (number_at(trun, 4), int.from_bytes(trun[1:4])) if trun else (0, 0)
    if not n:
        return iter(()), None
    width = lambda f, bits: sum(size for bit, size in bits if f & bit)
    base = 0 if tfdt is None else number_at(tfdt, 4, 8 if tfdt[:1] == b"\1" else 4)
    usual, fh = None, number_at(tfhd, 1, 3) if tfhd else None
    if fh and fh & 8:
        usual = number_at(tfhd, width(fh, ((1, 8), (2, 4))) + 8)
    first, step = 8 + width(flags, ((1, 4), (4, 4))), width(flags, ((0x100, 4), (0x200, 4), (0x400, 4), (0x800, 4)))
    if len(trun) < first + n * step:
        return iter(()), "samples are cut off"
    durations = [number_at(trun, first + k * step) for k in range(n)] if flags & 0x100 else [usual]
    if None in durations:
        return iter(()), "no sample duration"
    if 0 in durations:
        return iter(()), "a sample duration of zero"
    to_size, to_moved = width(flags, ((0x100, 4),)), width(flags, ((0x100, 4), (0x200, 4), (0x400, 4)))

    def each() -> Iterator[tuple[int | None, int | None, int | None]]:
        end = base
        for k in range(n):
            at = first + k * step
            if flags & 0x800 and base is not None:
                end = base + int.from_bytes(trun[at + to_moved : at + to_moved + 4], signed=trun[0] != 0)
            start, end = end, None if end is None else end + (durations[k] if flags & 0x100 else usual)
            yield start, end, number_at(trun, at + to_size) if flags & 0x200 else None

    return each(), None


def fragment(data: memoryview | None) -> tuple[list[tuple], dict[str, bytes], str | None]:
    """The boxes of a segment of a WebVTT track, what its last tfdt, tfhd and trun hold, and what is wrong with it."""
    found = list(walk(data, IN_MEDIA)) if data is not None else []
    parts = {name: bytes(data[at + header : at + size]) for _, _, name, at, header, size, error in found if error is None and name in ("tfdt", "tfhd", "trun")}
    media = sum(x[2] == "mdat" for x in found)
    error = max((x[6] for x in found if x[6]), default=None)
    return found, parts, error or (None if media == 1 else "several media data boxes" if media else "no media data box")


def cues_of(data: memoryview | None) -> Iterator[tuple[int, int | None, int | None, str, str]]:
    """(nth, start, end, payload, settings) of a segment's cues, in time units; none of a segment with an error.

    A sample takes the boxes of the media data that begin within its size, or one
    box. The last payload and the last settings in a cue's box count.
    """
    found, parts, error = fragment(data)
    samples, wrong = samples_of(parts)
    if error or wrong:
        return
    tops: list[list] = []
    at = 0
    for nth, (depth, path, name, begin, header, size, _) in enumerate(found):
        if depth == 1 and path.startswith("mdat/"):
            tops.append([at, nth, name == "vttc", None, None])
            at += size
        elif path in ("mdat/vttc/payl", "mdat/vttc/sttg"):
            tops[-1][3 if name == "payl" else 4] = bytes(data[begin + header : begin + size])
    low, j = 0, 0
    for k, (start, end, size) in enumerate(samples):
        if size:
            held, low = j, low + size
            while j < len(tops) and tops[j][0] < low:
                j += 1
            held = range(held, j)
        else:
            held = range(k, min(k + 1, len(tops)))
        for _, nth, is_cue, payload, settings in (tops[i] for i in held):
            if is_cue and payload:
                yield nth, start, end, payload.decode("utf-8", "replace"), (settings or b"").decode("utf-8", "replace")
        if j == len(tops) and k >= len(tops):
            return


def per_segment(segments: DataFrame, of: Callable[[memoryview | None], Iterable[tuple]], fields: dict[str, str]) -> DataFrame:
    """(doc_id, seg_pos, fields): the rows that a function tells of each segment (doc_id, seg_pos, data), on Arrow batches."""
    keys = [f"{c} {segments.schema[c].dataType.simpleString()}" for c in ("doc_id", "seg_pos")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, x in enumerate(batch.column("data")):
                rows += of(memoryview(x.as_buffer()) if x.is_valid else None)
                owner += [i] * (len(rows) - len(owner))
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            owners = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owners), batch.column("seg_pos").take(owners), *(pa.array(c, KINDS[k]) for c, k in zip(columns, fields.values()))], ["doc_id", "seg_pos", *fields])

    return segments.select("doc_id", "seg_pos", "data").mapInArrow(run, ", ".join([*keys, *(f"{c} {k}" for c, k in fields.items())]))


def fragments(segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of segments (doc_id, seg_pos, data) of a WebVTT track: their boxes, their samples in order, their errors.

    Samples are (doc_id, seg_pos, k, start, end, size), see samples_of. Errors are one row a segment
    (doc_id, seg_pos, error), the first that applies.
    """
    files = segments.select(F.struct("doc_id", "seg_pos").alias("id"), "data")

    def samples(data: memoryview | None) -> Iterator[tuple]:
        return ((k, *x) for k, x in enumerate(samples_of(fragment(data)[1])[0]))

    def errors(data: memoryview | None) -> list[tuple[str]]:
        _, parts, error = fragment(data)
        error = error or samples_of(parts)[1]
        return [(error,)] if error else []

    times = {"k": "long", "start": "long", "end": "long", "size": "long"}
    return boxes(files, ("mdat",)), per_segment(segments, samples, times), per_segment(segments, errors, {"error": "string"})


def wvtt_cues(segments: DataFrame, units: int) -> DataFrame:
    """(doc_id, cue_pos, start_ms, end_ms, payload, settings) of a WebVTT track's segments (doc_id, seg_pos, data).

    units: time units a second. A segment's cues come from its bytes alone (see
    cues_of), each segment read once; one exchange, of cues by doc_id, follows. A
    cue that goes on where the last one ended, with its payload and settings,
    extends it.
    """
    told = per_segment(segments, cues_of, {"cue_nth": "int", "start": "long", "end": "long", "payload": "string", "settings": "string"})
    ms = lambda c: F.round(F.col(c).cast("double") / F.lit(units) * 1000).cast("long")
    rows = told.select("doc_id", "seg_pos", "cue_nth", ms("start").alias("start_ms"), ms("end").alias("end_ms"), "payload", "settings")
    by = Window.partitionBy("doc_id").orderBy("seg_pos", "cue_nth")
    goes_on = (F.lag("end_ms").over(by) == F.col("start_ms")) & (F.lag("payload").over(by) == F.col("payload")) & (F.lag("settings").over(by) == F.col("settings"))
    runs = rows.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(by))
    return runs.groupBy("doc_id", "run", "payload", "settings").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("seg_pos", "cue_nth")).alias("end_ms")).select("doc_id", (F.col("run") - 1).alias("cue_pos"), "start_ms", "end_ms", "payload", "settings")
