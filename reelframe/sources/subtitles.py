"""WebVTT documents as cues: a block grammar over lines, and batches joined by their 90 kHz clocks.

Documents are (doc_id, seg_pos, text); a subtitle's documents follow each other
by seg_pos. A document's blocks are read from its text alone.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions import moments
from reelframe.functions.groups import folded
from reelframe.functions.once import let
from reelframe.operators import cues as cue_rules

KEYS = ["doc_id", "seg_pos"]
#: Fixed values of the format.
HEAD, ARROW, BREAK, CLOCK = "WEBVTT", " --> ", "\r\n", 90_000


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_classes(text: Column) -> Column:
    """A payload with class tags: of each line what stands in them, by spaces; others as they are."""
    tag = r"(?s)<c\..*?>(.*?)</c>"
    line = lambda x: F.regexp_replace(F.array_join(F.regexp_extract_all(x, F.lit(tag), F.lit(1)), " "), r"(?U)\s+$", "")
    kept = F.array_join(F.transform(F.split(text, "\r?\n"), line), BREAK)
    return F.when(text.rlike(tag), F.regexp_replace(kept, r"(?U)\s+$", "")).otherwise(text)


def vtt_blocks(text: Column) -> Column:
    """array<struct<start_ms, end_ms, payload, settings>> of a document's text, times null where they are none.

    A block goes up to an empty line. Its cue has the last time line of the
    block and all lines behind the first; one without lines is left out.
    """
    timed = lambda line: line.contains(ARROW)
    blocks = F.filter(F.split(text, r"(?U)\n\s*\n"), timed)
    behind = F.transform(blocks, lambda b: let(F.split(b, "\n"), lambda x: F.slice(x, F.array_position(F.transform(x, timed), F.lit(True)).cast("int"), F.size(x))))
    bare = lambda x: F.array_join(F.filter(F.transform(F.filter(x, lambda line: ~timed(line)), trimmed), lambda line: line != ""), BREAK)
    parts = lambda x: F.filter(F.split(F.replace(F.element_at(F.filter(x, timed), -1), F.lit("-->"), F.lit(" ")), r"(?U)\s+"), lambda p: p != "")
    told = F.filter(F.transform(behind, lambda x: F.struct(bare(x).alias("payload"), parts(x).alias("parts"))), lambda x: x["payload"] != "")
    return F.transform(told, lambda x: F.struct(*(moments.cue_millis(F.get(x["parts"], F.lit(k))).alias(c) for k, c in ((0, "start_ms"), (1, "end_ms"))),
                       without_classes(F.replace(x["payload"], F.lit("​"), F.lit(""))).alias("payload"), F.array_join(F.slice(x["parts"], 3, F.greatest(F.size(x["parts"]), F.lit(1))), " ").alias("settings")))


def vtt_read(documents: DataFrame) -> DataFrame:
    """(doc_id, seg_pos, mpegts, error, cues): each document from its text alone; cues are empty where there is an error."""
    clock = F.regexp_extract(F.regexp_extract("text", "(X-TIMESTAMP-MAP.*)", 1), r"MPEGTS:(\d+)", 1).try_cast("long")
    head = F.coalesce(F.col("text").rlike(rf"(?U)\A\s*{HEAD}"), F.lit(False))
    none = F.array().cast("array<struct<start_ms: bigint, end_ms: bigint, payload: string, settings: string>>")
    bad = lambda x: F.exists(x, lambda c: c["start_ms"].isNull() | c["end_ms"].isNull())
    # one value, so that the blocks are read once
    read = F.when(~head, F.struct(F.lit("no header").alias("error"), none.alias("cues"))).otherwise(let(vtt_blocks(F.col("text")), lambda x: F.when(bad(x), F.struct(F.lit("no times").alias("error"), none.alias("cues"))).otherwise(F.struct(F.lit(None).cast("string").alias("error"), x.alias("cues")))))
    return documents.select(*KEYS, F.coalesce(clock, F.lit(0)).alias("mpegts"), read.alias("read")).select(*KEYS, "mpegts", "read.error", "read.cues")


def vtt_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, seg_pos, mpegts, error): each document's clock, 0 if it names none, and why it has no cues."""
    return vtt_read(documents).select(*KEYS, "mpegts", "error")


def vtt_cues(documents: DataFrame, base_ms: int = 0) -> DataFrame:
    """(doc_id, seg_pos, cue_pos, start_ms, end_ms, payload, settings) of the documents without an error.

    Cues count from base_ms, up to the first of a document that begins before it.
    """
    # an outer explode: Spark would else ask for the cues' number below, and read the blocks twice
    x = vtt_read(documents).select(*KEYS, F.posexplode_outer("cues").alias("cue_pos", "cue")).where("cue_pos is not null").select(*KEYS, "cue_pos", "cue.*")
    if base_ms:
        moves = F.min((F.col("start_ms") >= base_ms).cast("int")).over(Window.partitionBy(*KEYS).orderBy("cue_pos")) == 1
        x = x.withColumns({c: F.when(moves, F.col(c) - base_ms).otherwise(F.col(c)) for c in ("start_ms", "end_ms")})
    return x


CUES = {"cue_pos": "long", "start_ms": "long", "end_ms": "long", "payload": "string", "settings": "string"}


def vtt_joined(documents: DataFrame) -> DataFrame:
    """(doc_id, cue_pos, start_ms, end_ms, payload, settings): the documents without an error, joined as of joined(), each read once."""
    x = vtt_read(documents).select(*KEYS, "mpegts", "error", F.posexplode_outer("cues").alias("cue_pos", "cue")).where("error is null or cue_pos is not null")
    return _joined(x.select(*KEYS, "mpegts", "cue_pos", "cue.*"))


def joined(cues: DataFrame, clocks: DataFrame) -> DataFrame:
    """(doc_id, cue_pos, start_ms, end_ms, payload, settings): the cues of a subtitle's documents, joined in order.

    cues: as of vtt_cues. clocks: (doc_id, seg_pos, mpegts). The first document
    is taken as it is. A later one with a clock that begins before the end of what
    is there is moved by the difference of the clocks in whole seconds, if it
    begins before that. Its cues are then added: not again, and one that goes on
    where the last one ended, with its payload, extends it. What is added depends
    on what is there, so one subtitle is one fold, linear in its cues.
    """
    # documents without cues count: the first one's clock is what others are held against
    return _joined(clocks.select(*KEYS, "mpegts").join(cues, KEYS, "left"))


def _joined(whole: DataFrame) -> DataFrame:
    """joined() of cues with their document's clock; a document without cues is one row of nulls."""

    def fold(group: list[tuple]) -> list[tuple]:
        kept: list[list] = []
        seen: Counter = Counter()
        own = None
        for (_, clock), part in groupby(group, key=itemgetter(1, 2)):
            rows = [list(r[4:]) for r in part if r[6] is not None]
            if own is None:
                own = clock
                kept = rows
                seen.update(tuple(r) for r in rows)
                continue
            if clock and (rows[0][0] < kept[-1][1] and rows[0][1] != kept[-1][1] if rows and kept else not kept):
                shift = int((clock - own) / CLOCK) * 1000
                if rows and rows[0][0] < shift:
                    rows = [[a + shift, b + shift, p, s] for a, b, p, s in rows]
            cue_rules.extend(kept, seen, rows)
        return [(n, *r) for n, r in enumerate(kept)]

    return folded(whole.select(*KEYS, "mpegts", "cue_pos", "start_ms", "end_ms", "payload", "settings"), "doc_id", ["seg_pos", "mpegts", "cue_pos"], fold, CUES)
