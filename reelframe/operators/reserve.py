"""Output names without collisions: every stream of a folder gets the first name of its own that no earlier stream has.

A folder is folded, one stream after the other, in one exchange by folder. A
folder of more streams than a task should hold goes in rounds instead: all its
streams ask at once, each for its next name; a name goes to the earliest that
asks for it, the others ask for their next one. As all names prefer earlier
streams, what is left when nobody is turned down is the fold's result. A round
is one exchange by folder and name, and is written; streams that run through
the same copies go past as many of them as earlier ones of their kind need, so
rounds are few.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.groups import KINDS, folded
from reelframe.operators.lineage import settled

#: Streams of a folder that is folded, at most.
MOST = 100_000


def attempts(media_type: Column, resolution: Column, bandwidth: Column, language: Column, channels: Column) -> Column:
    """What a stream's facts add to a name, in the order in which they are tried."""
    # format_string would round what the decimals show (0.25 to 0.3), not the number
    mbps = F.concat(F.replace(F.format_number(bandwidth / 1_000_000.0, 1), F.lit(","), F.lit("")), F.lit("Mbps"))
    kbps = F.concat(((bandwidth - bandwidth % 1000) / 1000).cast("long").cast("string"), F.lit("kbps"))
    ch = F.concat(channels, F.lit("ch"))
    both = lambda a, b: F.concat(a, F.lit("."), b)  # noqa: E731  null if one is
    listed = (
        F.when(media_type == "Video", F.array(resolution, mbps, both(resolution, mbps)))
        .when(media_type == "Audio", F.array(language, ch, both(language, ch), kbps))
        .when(media_type == "Subtitles", F.array(language))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.filter(listed, lambda x: x.isNotNull())


def reserved(streams: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """streams with `reserved`, each one's file name in its folder.

    streams: folder, pos (their order, no ties within a folder), file, tries
    (array of what may stand before the extension). existing: (folder, file) that
    are there already. After the tries a name gets ".copy" once more each time. A
    stream without a file has none reserved. No rows give no rows.
    """
    rows = streams.where("file is not null").select("folder", "pos", "file", "tries")
    there = None if existing is None else existing.select("folder", F.col("file").alias("name")).distinct()
    large = rows.groupBy("folder").count().where(F.col("count") > MOST).select("folder")
    if _kind(rows) not in KINDS:
        found = _in_rounds(rows, there)
    elif large.isEmpty():
        found = _folded(rows, there)
    else:
        # null folders go with the others: eqNullSafe
        own = large.withColumnRenamed("folder", "large")
        alike = F.col("folder").eqNullSafe(F.col("large"))
        found = _folded(rows.join(own, alike, "left_anti"), there).unionByName(_in_rounds(rows.join(own, alike, "left_semi"), there))
    return streams.join(found, ["folder", "pos"], "left")


def _split(name: Column) -> tuple[Column, Column]:
    """What stands before a name's extension, and the extension with its dot; a leading dot is none."""
    dotted = name.rlike(r"^.+\.[^.]*$")
    return F.when(dotted, F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name), F.when(dotted, F.regexp_extract(name, r"(\.[^.]*)$", 1)).otherwise("")


def _folded(rows: DataFrame, there: DataFrame | None) -> DataFrame:
    """(folder, pos, reserved) of rows, folder by folder; what is there comes first."""
    stem, ext = _split(F.col("file"))
    x = rows.select("folder", F.lit(True).alias("asks"), "pos", stem.alias("stem"), ext.alias("ext"), "tries")
    if there is not None:
        none = {c: F.lit(None).cast(x.schema[c].dataType) for c in ("pos", "tries")}
        x = x.unionByName(there.where("folder is not null").select("folder", F.lit(False).alias("asks"), none["pos"].alias("pos"), F.col("name").alias("stem"), F.lit("").alias("ext"), none["tries"].alias("tries")))

    def fold(group: list[tuple]) -> Iterator[tuple]:
        taken: set[str] = set()
        copies: dict[tuple[str, str], int] = {}
        for _, asks, pos, stem, ext, tries in group:
            name = next((n for n in (stem + ext, *(f"{stem}.{t}{ext}" for t in tries or () if t is not None)) if n not in taken), None) if asks else stem
            if name is None:
                # names are never given back, so a later stream goes on where the last one of its kind was
                k = copies.get((stem, ext), 1)
                while (name := stem + ".copy" * k + ext) in taken:
                    k += 1
                copies[stem, ext] = k
            taken.add(name)
            if asks:
                yield pos, name

    return folded(x, "folder", ["asks", "pos"], fold, {"pos": _kind(rows), "reserved": "string"})


def _kind(rows: DataFrame) -> str:
    return rows.schema["pos"].dataType.simpleString().replace("bigint", "long")


def _in_rounds(rows: DataFrame, there: DataFrame | None) -> DataFrame:
    """(folder, pos, reserved) of rows, all streams at once, round by round."""
    taken = None if there is None else there.withColumn("there", F.lit(True))
    stem, ext = _split(F.col("file"))
    x = rows.select("folder", "pos", "file", "tries", stem.alias("stem"), ext.alias("ext"), F.lit(0).alias("k"))
    k, n = F.col("k"), F.size("tries")
    copies = F.greatest(k - n, F.lit(0))
    name = F.when(k == 0, F.col("file")).when(k <= n, F.concat("stem", F.lit("."), F.get("tries", k - 1), "ext")).otherwise(F.concat("stem", F.repeat(F.lit(".copy"), copies), "ext"))
    while True:
        x = x.withColumn("name", name)
        if taken is not None:
            x = x.drop("there").join(taken, ["folder", "name"], "left")
        blocked = F.coalesce(F.col("there"), F.lit(False)) if taken is not None else F.lit(False)
        rank = F.row_number().over(Window.partitionBy("folder", "name").orderBy("pos"))
        # those that are at the same copy of the same file go on in step
        alike = F.row_number().over(Window.partitionBy("folder", "name", "file", copies).orderBy("pos"))
        x = x.withColumns({"rank": rank, "alike": F.when(copies > 0, alike).otherwise(1), "blocked": blocked})
        step = F.when(F.col("blocked"), F.col("alike")).when(F.col("rank") > 1, F.greatest(F.lit(1), F.col("alike") - 1)).otherwise(0)
        x = settled(x.withColumn("step", step))
        if x.where("step > 0").isEmpty():
            break
        x = x.withColumn("k", k + F.col("step"))
    return x.select("folder", "pos", F.col("name").alias("reserved"))
