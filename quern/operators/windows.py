"""Ranking, numbering and run operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.contracts import checkpointed


def bottom_k(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The k first rows of each group; the limit works map-side before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_row_number(rows: DataFrame, order: str, ties: list[str] = (), parts: int | None = None) -> DataFrame:
    """Number all rows from 1 in the order of a numeric column without a single sorting task.

    Cut points from a mergeable quantile sketch deal the rows into ranges; numbers are places in the range plus the counts of the
    ranges before, a table of ``parts`` rows. Null orders come first.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)] or [0.5], 1000)).first()[0] or []
    points = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    span = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.size(F.filter(points, lambda p: p < F.col(order))))
    dealt = rows.withColumn("_range", span)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    starts = counts.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(order, *ties)
    numbered = dealt.withColumn("_place", F.row_number().over(within))
    return numbered.join(F.broadcast(starts), F.col("_range") == F.col("_r")).select(*rows.columns, (F.col("_before") + F.col("_place")).alias("row_number"))


def numbered_in_groups(rows: DataFrame, group: str, order: str, ties: list[str] = (), prefix: int = 3) -> DataFrame:
    """Place of each row in its group, from 0, in the order of a hexadecimal digest, without a task that holds a group.

    Adds ``_place``, ``_size`` (rows of the group) and ``_all_before`` (rows of the groups before, in the order of their names' digests). Rows are
    numbered within (group, first ``prefix`` digits of the digest), 4,096 of them in a hot group; the counts of these are summed within a
    prefix of the group's digest, and those over the prefixes, so that each window sees a small share of the groups.
    """
    cut = rows.withColumns({"_g": F.sha2(F.coalesce(F.col(group).cast("string"), F.lit("")), 256), "_p": F.substring(order, 1, prefix)})
    counts = cut.groupBy("_g", "_p").agg(F.count("*").alias("_n")).withColumn("_top", F.substring("_g", 1, prefix))
    tops = counts.groupBy("_top").agg(F.sum("_n").alias("_m"))
    tops = tops.select(F.col("_top").alias("_t"), F.coalesce(F.sum("_m").over(Window.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own, near = Window.partitionBy("_top", "_g").orderBy("_p"), Window.partitionBy("_top").orderBy("_g", "_p")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_own": before(own), "_near": before(near), "_size": F.sum("_n").over(Window.partitionBy("_top", "_g"))})
    starts = counts.join(tops, F.col("_top") == F.col("_t"))
    starts = starts.select(F.col("_g").alias("_g1"), F.col("_p").alias("_p1"), "_own", "_size", (F.col("_start") + F.col("_near") - F.col("_own")).alias("_all_before"))
    within = Window.partitionBy("_g", "_p").orderBy(order, *ties)
    placed = cut.withColumn("_row", F.row_number().over(within) - 1)
    placed = placed.join(starts, (F.col("_g") == F.col("_g1")) & (F.col("_p") == F.col("_p1")))
    return placed.withColumn("_place", F.col("_own") + F.col("_row")).select(*rows.columns, "_place", "_size", "_all_before")


def ranked_with_count(rows: DataFrame, group: str, order: list) -> DataFrame:
    return rows.withColumns({"rank": F.row_number().over(Window.partitionBy(group).orderBy(*order)), "candidates": F.count("*").over(Window.partitionBy(group))})


def round_robin(rows: DataFrame, group: str, key: list, n: int) -> DataFrame:
    """The n first rows when groups take turns: each group's k-th row before any group's next."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*key))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", group, *key).limit(n)


def in_ranges(rows: DataFrame, part: str, order: str) -> DataFrame:
    """Rows dealt by ranges of (part, order), ``_range`` being the number of each: a hot part is many ranges, and ranges follow its order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartitionByRange(parts, part, order).withColumn("_range", F.spark_partition_id()))


def contiguous_runs(rows: DataFrame, part: str, order: str, key: str) -> DataFrame:
    """Runs of one key in the order of each part: first and last place and length; a null key is a run of its own.

    Runs are found within ranges. A range's summary for a part is its number of runs and its first and last key; the summaries, one for
    each range and part, tell which runs go on across a border and how many came before. So no task holds a part.
    """
    own = Window.partitionBy("_range", part).orderBy(order)
    dealt = in_ranges(rows.select(part, order, key), part, order)
    change = F.coalesce((F.lag(key).over(own) != F.col(key)).cast("int"), F.lit(1))
    local = dealt.withColumn("_c", change).withColumn("_run", F.sum("_c").over(own))
    local = local.groupBy("_range", part, "_run", key).agg(F.min(order).alias("_first"), F.max(order).alias("_last"), F.count("*").alias("_n"))
    borders = local.groupBy("_range", part).agg(F.max("_run").alias("_runs"), F.min_by(key, "_run").alias("_begin"), F.max_by(key, "_run").alias("_end"))
    ranges = Window.partitionBy(part).orderBy("_range")
    borders = borders.withColumn("_on", F.coalesce((F.lag("_end").over(ranges) == F.col("_begin")).cast("int"), F.lit(0)))
    before = F.sum("_runs").over(ranges) - F.col("_runs") - F.sum("_on").over(ranges)
    borders = borders.select(F.col("_range").alias("_r"), F.col(part).alias("_p"), before.alias("_before"))
    met = local.join(borders, (F.col("_range") == F.col("_r")) & F.col(part).eqNullSafe(F.col("_p")))
    runs = met.withColumn("run", F.col("_before") + F.col("_run")).groupBy(part, "run", key)
    return runs.agg(F.min("_first").alias("first_at"), F.max("_last").alias("last_at"), F.sum("_n").alias("n_rows"))


def last_flag(rows: DataFrame, part: str, order: str) -> DataFrame:
    """Whether a row is the last of its part: the last of the part in its range, if no later range has the part."""
    dealt = in_ranges(rows, part, order)
    borders = dealt.select(F.col("_range").alias("_r"), F.col(part).alias("_p")).distinct()
    borders = borders.withColumn("_final", F.lead("_r").over(Window.partitionBy("_p").orderBy("_r")).isNull())
    local = dealt.withColumn("_local", F.lead(order).over(Window.partitionBy("_range", part).orderBy(order)).isNull())
    met = local.join(borders, (F.col("_range") == F.col("_r")) & F.col(part).eqNullSafe(F.col("_p")))
    return met.select(*rows.columns, (F.col("_local") & F.col("_final")).alias("is_last"))


def longest_run(rows: DataFrame, part: str, order: str, bad: str) -> DataFrame:
    """Longest run of consecutive bad steps of each part; a null step neither counts nor ends a run."""
    runs = contiguous_runs(rows.where(F.col(bad).isNotNull()), part, order, bad)
    longest = runs.groupBy(F.col(part).alias("_p")).agg(F.max(F.when(F.col(bad), F.col("n_rows"))).alias("_n"))
    return rows.select(part).distinct().join(longest, F.col(part) == F.col("_p"), "left").select(part, F.coalesce("_n", F.lit(0)).alias("longest_run"))


def shard_of(row_number: Column, shards: int) -> Column:
    """Strided shards: every ``shards``-th row."""
    return F.pmod(row_number - 1, F.lit(shards))


def batch_of(row_number: Column, size: int) -> Column:
    """Batch of a row, from 0."""
    return F.floor((row_number - 1) / size).cast("long")


def full_batches(numbered: DataFrame, size: int, partial: bool = False) -> DataFrame:
    """Batches of ``size`` rows by row_number; without ``partial`` the short last one goes."""
    batches = numbered.withColumn("batch", batch_of(F.col("row_number"), size))
    if partial:
        return batches
    return batches.where((F.col("batch") + 1) * size <= numbered.count())


def epoch_sizes(n_samples: int, batch: int, world: int, workers: int, round_up: bool = True) -> dict[str, int]:
    """Batches and samples of an epoch when every worker of every process gets as many whole batches."""
    step = batch * world
    batches = -(-n_samples // step) if round_up else n_samples // step
    per_worker = -(-batches // max(1, workers))
    batches = per_worker * max(1, workers)
    return {"num_batches": batches, "num_samples": batches * step, "per_worker": per_worker}
