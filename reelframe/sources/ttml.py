"""TTML documents, plain or in MP4 segments, as cues.

A paragraph holds text between and inside its elements, which no fixed schema
of columns does; a small reader gives paragraphs as rows. What follows (shifts,
joining, grouping) is DataFrame functions and one fold over a subtitle's paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions import moments
from reelframe.functions.groups import folded
from reelframe.functions.once import let
from reelframe.operators.cues import time_text
from reelframe.sources import boxes

BREAK, IMAGE = "\r\n", "Base64::"
PARAGRAPH, ODD_MARK = re.compile(r"(<p\b[^>]*>)(.*?)(</p>)", re.S), re.compile(r' \w+:\w+="[^"]*"')
ROWS = "doc_id {kind}, seg_pos long, part long, nth long, start string, stop string, region string, contents array<string>, error string"
KEYS = ["doc_id", "seg_pos", "part"]


def parse(text: str) -> ElementTree.Element:
    """The root element; comments are kept, as they part texts."""
    parser = ElementTree.XMLParser(target=ElementTree.TreeBuilder(insert_comments=True))
    parser.feed(text.encode())
    return parser.close()


def repaired(text: str) -> str:
    """text with the inside of paragraphs escaped that holds what looks like an attribute, and is no markup."""

    def one(m: re.Match) -> str:
        if ODD_MARK.search(m[2]):
            try:
                parse(f"<p>{m[2]}</p>")
            except ElementTree.ParseError:
                return m[1] + escape(m[2], {'"': "&quot;", "'": "&apos;"}) + m[3]
        return m[0]

    return PARAGRAPH.sub(one, text)


def is_element(node: ElementTree.Element) -> bool:
    return isinstance(node.tag, str)


def local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


def inside(node: ElementTree.Element) -> str:
    """An element's text, pieces trimmed, with its line breaks and that of the elements in it."""
    out = [(node.text or "").strip()]
    for child in node:
        if is_element(child):
            out.append(BREAK if local(child.tag) == "br" else inside(child))
        out.append((child.tail or "").strip())
    return "".join(out)


def contents(node: ElementTree.Element, images: dict[str, str]) -> list[str]:
    """A paragraph's pieces in order: texts, elements' texts, in italics where they say so; or the image it refers to."""
    background = attribute(node, "backgroundImage")
    if background is not None and (image := images.get(background.lstrip("#"))) is not None:
        return [IMAGE + image]
    out = [(node.text or "").strip()]
    for child in node:
        if is_element(child) and (text := inside(child)):
            out.append(f"<i>{text}</i>" if attribute(child, "fontStyle") in ("italic", "oblique") else text)
        out.append((child.tail or "").strip())
    return [x for x in out if x]


def paragraphs(text: str) -> list[tuple[str, str, str, list[str]]]:
    """(begin, end, region, contents) of a document's paragraphs, or of its divisions if it has none; those without contents or times go."""
    try:
        root = parse(text)
    except ElementTree.ParseError:
        root = parse(repaired(text))
    nodes = [x for x in root.iter() if is_element(x)]
    images = {i: (x.text or "").strip() for x in nodes if local(x.tag) == "image" and (i := attribute(x, "id")) is not None}
    found = [x for x in nodes if local(x.tag) == "p"] or [x for x in nodes if local(x.tag) == "div"]
    rows = [(*(attribute(x, a) or "" for a in ("begin", "end", "region")), contents(x, images)) for x in found]
    return [r for r in rows if r[3] and r[0].strip() and r[1].strip()]


def rows(documents: DataFrame) -> DataFrame:
    """(doc_id, seg_pos, part, nth, start, stop, region, contents, error) of documents (doc_id, seg_pos, part, text).

    A document that cannot be read is one row with an error; one without <tt, or null, has no rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text and "<tt" in text:
                    try:
                        found = [(n, *r, None) for n, r in enumerate(paragraphs(text.strip()))]
                    except ElementTree.ParseError:
                        found = [(0, None, None, None, None, "no XML")]
                    out += found
                    owner += [i] * len(found)
            columns = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            taken = [batch.column(c).take(pa.array(owner, pa.int64())) for c in KEYS]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*KEYS, "nth", "start", "stop", "region", "contents", "error"])

    return documents.select("doc_id", F.col("seg_pos").cast("long"), F.col("part").cast("long"), "text").mapInArrow(run, ROWS.format(kind=kind))


def shifted(documents: DataFrame, segment_ms: int) -> DataFrame:
    """documents with times of the form 00:00:00.000 moved by segment_ms for each segment before theirs; all others stay."""
    if not segment_ms:
        return documents
    # what comes next is asked first: looking back at every character takes longer
    pieces = F.split("text", r'(?=\d{2}:\d{2}:\d{2}\.\d{3}")(?<=(?:begin|end)=")')
    millis = lambda p: sum((F.substring(p, at, n).cast("long") * unit for at, n, unit in ((4, 2, 60_000), (7, 2, 1000), (10, 3, 1))), F.substring(p, 1, 2).cast("long") * 3_600_000)
    moved = lambda p: F.concat(let(millis(p) + F.col("seg_pos") * segment_ms, lambda ms: time_text(ms, ".")), F.substring(p, 13, 1 << 30))
    text = let(pieces, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.transform(F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), moved)), ""))
    return documents.withColumn("text", text)


def ttml_cues(documents: DataFrame, segment_ms: int = 0, base_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """Cues (doc_id, cue_pos, start_ms, end_ms, payload) of documents (doc_id, seg_pos, text; part if a segment has several), and errors (doc_id, seg_pos, part, error).

    A paragraph that goes on where the last one ended, with its region and
    contents, extends it; one that is there already is left out. Paragraphs of the
    same times are one cue. Cues count from base_ms, up to the first that begins
    before it. Documents that are no XML, and cues whose times cannot be read, are errors and give nothing.
    """
    d = documents if "part" in documents.columns else documents.withColumn("part", F.lit(0))
    found = rows(shifted(d, segment_ms))
    good = found.where("error is null").select("doc_id", "seg_pos", "part", "nth", "start", "stop", "region", "contents")

    def fold(group: list[tuple]) -> list[tuple]:
        kept: list[list] = []
        seen: set[tuple] = set()
        for r in group:
            x = [*r[4:7], tuple(r[7])]
            last = kept[-1] if kept else None
            if last and last[1] == x[0] and last[2:] == x[2:]:
                seen.discard(tuple(last))
                last[1] = x[1]
                seen.add(tuple(last))
            elif tuple(x) not in seen:
                kept.append(x)
                seen.add(tuple(x))
        at: dict[tuple, list[str]] = {}
        for start, stop, _, texts in kept:
            at.setdefault((start, stop), []).extend(texts)
        return [([a for a, _ in at], [b for _, b in at], [BREAK.join(x) for x in at.values()])]

    # a subtitle's cues are one row, so that their numbers need no second exchange
    held = folded(good, "doc_id", ["seg_pos", "part", "nth"], fold, dict.fromkeys(("starts", "stops", "payloads"), "array<string>"))
    timed = F.transform(F.arrays_zip("starts", "stops", "payloads"), lambda c: F.struct(moments.cue_millis(c["starts"]).alias("start_ms"), moments.cue_millis(c["stops"]).alias("end_ms"), c["payloads"].alias("payload")))
    read = F.filter(timed, lambda c: c["start_ms"].isNotNull() & c["end_ms"].isNotNull())
    # an outer explode: Spark would else ask for the cues' number below, and read the times twice
    x = held.select("doc_id", F.posexplode_outer(read).alias("cue_pos", "cue")).where("cue_pos is not null").select("doc_id", "cue_pos", "cue.*")
    if base_ms:
        moves = F.min((F.col("start_ms") >= base_ms).cast("int")).over(Window.partitionBy("doc_id").orderBy("cue_pos")) == 1
        x = x.withColumns({c: F.when(moves, F.col(c) - base_ms).otherwise(F.col(c)) for c in ("start_ms", "end_ms")})
    unread = F.when(moments.cue_millis(F.col("start")).isNull() | moments.cue_millis(F.col("stop")).isNull(), "times")
    errors = found.select(*KEYS, F.coalesce("error", unread).alias("error")).where("error is not null").distinct()
    return x, errors


def documents_in(segments: DataFrame) -> DataFrame:
    """(doc_id, seg_pos, part, text): the TTML documents in the media data of segments (doc_id, seg_pos, data); a segment with a wrong box has none."""

    def media(data: memoryview | None) -> list[tuple[int, bytes]]:
        found = list(boxes.walk(data, boxes.CONTAINERS | boxes.SAMPLE_ENTRIES)) if data is not None else []
        if any(x[6] for x in found):
            return []
        return [(n, bytes(data[at + header : at + size])) for n, (_, _, name, at, header, size, _) in enumerate(found) if name == "mdat"]

    texts = F.regexp_extract_all(F.make_valid_utf8(F.col("payload").cast("string")), F.lit(r"(?s)<tt.*?</tt>"), F.lit(0))
    each = boxes.per_segment(segments, media, {"nth": "int", "payload": "binary"}).select("doc_id", "seg_pos", "nth", F.posexplode_outer(texts).alias("k", "text")).where("k is not null")
    return each.select("doc_id", "seg_pos", (F.col("nth").cast("long") * 100_000 + F.col("k")).alias("part"), "text")


def images(cues: DataFrame) -> DataFrame:
    """cues with image: for payloads that are images their bytes, and payload the name of the file, numbered by subtitle."""
    is_image = F.col("payload").startswith(IMAGE)
    number = F.sum(is_image.cast("int")).over(Window.partitionBy("doc_id").orderBy("cue_pos")) - 1
    data = F.try_to_binary(F.trim(F.substring("payload", len(IMAGE) + 1, 1 << 30)), F.lit("base64"))
    return cues.withColumn("image", F.when(is_image, data)).withColumn("payload", F.when(is_image, F.concat(number.cast("string"), F.lit(".png"))).otherwise(F.col("payload")))
