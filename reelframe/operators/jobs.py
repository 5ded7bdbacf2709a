"""A table of jobs as a queue: order, pages, moves, starts, retention, counts.

Jobs are rows (gid, status, queue_position, created_at_ms, ...). Pages and the
next jobs are top-k queries (each task sends on k rows). Numbering the whole
queue goes by ranges of positions: counts per range are summed over few rows,
and only within a range are rows put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("queue_position", "created_at_ms", "gid")
QUEUED = ("waiting", "paused")
STOPPED = ("complete", "error", "removed")
#: Positions in a range that is ordered by one task.
RANGE = 64


def numbered(jobs: DataFrame, column: str = "place") -> DataFrame:
    """jobs with their place in the queue, from 0."""
    x = jobs.withColumn("_range", F.expr(f"queue_position div {RANGE}"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range of positions
    starts = x.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("_range").orderBy(*ORDER)
    return x.join(starts, "_range").withColumn(column, F.col("_start") + F.row_number().over(within) - 1).drop("_range", "_start")


def page(jobs: DataFrame, offset: int, count: int) -> DataFrame:
    """`count` jobs from `offset` on; a negative offset counts from the end and walks backwards."""
    if count <= 0:
        return jobs.limit(0)
    if offset >= 0:
        return jobs.orderBy(*ORDER).offset(offset).limit(count)
    skipped = min(-offset, jobs.count()) - 1
    return jobs.orderBy(*(F.desc(c) for c in ORDER)).offset(max(0, skipped)).limit(count)


def to_start(jobs: DataFrame, most_active: int) -> DataFrame:
    """The waiting jobs that free slots can take."""
    active = jobs.where("status = 'active'").count()
    return jobs.where("status = 'waiting'").orderBy(*ORDER).limit(max(0, most_active - active))


def retained(jobs: DataFrame, most: int) -> DataFrame:
    """jobs without the stopped ones updated longest ago, as far as there are more than `most`."""
    surplus = jobs.count() - most
    if surplus <= 0:
        return jobs
    gone = jobs.where(F.col("status").isin(*STOPPED)).orderBy("updated_at_ms", "gid").limit(surplus)
    return jobs.join(gone.select("gid"), "gid", "left_anti")


def moved(jobs: DataFrame, gid: str, position: int, how: str) -> DataFrame:
    """The queue (gid, place) after one job moved: POS_SET, POS_CUR or POS_END, as far as there is room.

    A job that is not in the queue fails the query when it runs; nothing runs before that.
    """
    queue = numbered(jobs.where(F.col("status").isin(*QUEUED)))
    found = queue.agg(F.struct(F.max(F.when(F.col("gid") == gid, F.col("place"))).alias("current"), (F.count("*") - 1).alias("others")).alias("found")).scalar()
    x = queue.select("gid", "place", found.alias("found")).select("gid", "place", "found.*")
    current = F.coalesce("current", F.raise_error(F.lit(f"not in the queue: {gid}")).cast("long"))
    target = {"POS_SET": F.lit(position), "POS_CUR": F.col("current") + position, "POS_END": F.col("others") + position}[how]
    x = x.withColumn("current", current).withColumn("target", F.least(F.greatest(target, F.lit(0)), F.col("others")))
    without = F.when(F.col("place") > F.col("current"), F.col("place") - 1).otherwise(F.col("place"))
    place = F.when(F.col("gid") == gid, F.col("target")).when(without >= F.col("target"), without + 1).otherwise(without)
    return x.select("gid", place.alias("place"))


def to_front(jobs: DataFrame, gid: str) -> DataFrame:
    """jobs with one at position 0 and the other queued ones a place later."""
    place = F.when(F.col("gid") == gid, 0).when(F.col("status").isin(*QUEUED), F.col("queue_position") + 1).otherwise(F.col("queue_position"))
    return jobs.withColumn("queue_position", place)


def global_stat(jobs: DataFrame) -> DataFrame:
    """One row: numbers of active, waiting and stopped jobs, and the active ones' bytes and speed."""
    s = F.col("status")
    count = lambda c: F.count(F.when(c, 1))
    total = lambda c: F.coalesce(F.sum(F.when(s == "active", F.col(c))), F.lit(0))
    return jobs.agg(
        count(s == "active").alias("num_active"),
        count(s.isin(*QUEUED)).alias("num_waiting"),
        count(s.isin(*STOPPED)).alias("num_stopped"),
        total("download_speed").alias("download_speed"),
        total("completed_length").alias("completed_length"),
    )


def lookup(jobs: DataFrame, prefixes: DataFrame, length: int) -> DataFrame:
    """prefixes (prefix, of `length` characters) with the gid that alone begins so.

    An equi-join on the cut gid: the prefixes have one length, so no pair of
    rows is compared that does not match.
    """
    found = jobs.select(F.left("gid", F.lit(length)).alias("prefix"), "gid").join(prefixes, "prefix")
    return found.groupBy("prefix").agg(F.count("*").alias("_n"), F.min("gid").alias("gid")).where("_n = 1").drop("_n")


def status(jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The asked columns, numbers as text; without keys all of them."""
    wanted = [c for c in jobs.columns if not keys or c in keys]
    return jobs.select(*(F.col(c).cast("string").alias(c) for c in wanted))


def progress_text(done: Column, total: Column) -> Column:
    """Done of total in percent with two digits; without a total nothing."""
    return F.when(total > 0, F.concat(F.replace(F.format_number(done * 100.0 / total, 2), F.lit(","), F.lit("")), F.lit("%")))
