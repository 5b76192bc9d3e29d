"""Time buckets, bars, hierarchy sums and the summaries of measurement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairograph.exceptions import WrongInputFormat

from .storage import materialised

HOUR, DAY, WEEK = 3600, 86400, 7 * 86400


def _seconds(t: Column) -> Column:
    """Microseconds since the epoch of a time without zone."""
    return F.unix_micros(t.cast("timestamp"))


def buckets(log: DataFrame, unit: str, time: str = "timestamp") -> DataFrame:
    """Insertions and deletions by bucket and the last triple count; empty buckets have 0, 0 and the count before.

    HOUR and DAY buckets hold their start and are named by it; WEEK buckets hold their end and are named by
    it.  All count from the start of the first row's day.
    """
    size = {"HOUR": HOUR, "DAY": DAY, "WEEK": WEEK}[unit] * 1_000_000
    origin = log.agg(F.min(F.date_trunc("day", F.col(time)).cast("timestamp_ntz")).alias("origin"))
    at = _seconds(F.col(time)) - _seconds(F.col("origin"))
    number = F.ceil(at / size) if unit == "WEEK" else F.floor(at / size)
    rows = log.crossJoin(F.broadcast(origin)).withColumn("k", number.cast("long"))
    sums = rows.groupBy("k").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.max_by("cnt_triples", F.struct(time, "cnt_triples")).alias("cnt_triples"))
    # from here on as many rows as buckets
    spine = sums.agg(F.min("k").alias("a"), F.max("k").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("k"))
    filled = spine.join(sums, "k", "left").crossJoin(F.broadcast(origin))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    label = F.col("origin") + F.make_dt_interval(secs=F.col("k") * F.lit(size // 1_000_000))
    return filled.select(label.alias("bucket"), F.coalesce("insertions", F.lit(0).cast("long")).alias("insertions"), F.coalesce("deletions", F.lit(0).cast("long")).alias("deletions"), F.last("cnt_triples", ignorenulls=True).over(w).alias("cnt_triples"))


def net_bars(series: DataFrame, time: str = "bucket") -> DataFrame:
    """Previous total, net change, and the base on which the bar of the larger change stands."""
    w = Window.orderBy(time)
    out = series.withColumn("previous_total", F.coalesce(F.lag("cnt_triples").over(w), F.col("cnt_triples") - F.col("insertions") + F.col("deletions")))
    out = out.withColumn("net", F.col("insertions") - F.col("deletions"))
    base = F.when(F.col("net") > 0, F.col("previous_total")).when(F.col("net") < 0, F.col("previous_total") + F.col("net")).otherwise(F.col("previous_total"))
    return out.withColumn("base", base)


def rollup(nodes: DataFrame, measures: list[str], root: str = "ROOT") -> DataFrame:
    """Sums over the subtree of each node, once for every path to it.  nodes: node, parent, measures; missing parents are made up with 0, no parent means ``root``.

    Each round carries the last sums one step up until none is left; a node that is its own parent has none, a longer cycle is an error.
    """
    filled = nodes.select("node", F.coalesce("parent", F.lit(root)).alias("parent"), *measures)
    made = filled.select(F.col("parent").alias("node")).distinct().join(filled.select("node").distinct(), "node", "left_anti")
    made = made.select("node", F.when(F.col("node") != root, root).alias("parent"), *[F.lit(0).cast(filled.schema[m].dataType).alias(m) for m in measures])
    every = materialised(filled.unionByName(made), "hierarchy")
    edges = every.select("node", "parent").filter("parent is not null and parent <> node").distinct()
    own = every.groupBy("node").agg(*[F.sum(m).alias(m) for m in measures])
    step = own.select(F.col("node").alias("from"), F.col("node").alias("at"), *measures)
    out = step
    while True:
        up = step.join(edges, F.col("at") == F.col("node")).select("from", F.col("parent").alias("at"), *measures)
        step = materialised(up, "hierarchy")
        left, cyclic = step.agg(F.count("*"), F.bool_or(F.col("at") == F.col("from"))).first()
        if not left:
            break
        if cyclic:  # every node of a cycle comes back to itself
            raise WrongInputFormat("the hierarchy has a cycle")
        out = out.unionByName(step)
    return out.groupBy(F.col("at").alias("node")).agg(*[F.sum(m).alias(m) for m in measures])


def query_times(log: DataFrame, keys: list[str], most: float = 30.0) -> DataFrame:
    """Min, mean and max of the execution time, cut at the timeout, and the number of timeouts."""
    seconds = F.least(F.coalesce("execution_time", F.lit(0.0)), F.lit(most))
    return log.groupBy(*keys).agg(F.min(seconds).alias("min_time"), F.avg(seconds).alias("mean_time"), F.max(seconds).alias("max_time"), F.sum("yn_timeout").alias("timeouts"))


def storage_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.groupBy(*keys).agg(F.avg("ingestion_time").alias("mean_ingestion_time"), F.median("ingestion_time").alias("median_ingestion_time"), F.median("raw_file_size_MiB").alias("raw_file_size_MiB"), F.median("db_files_disk_usage_MiB").alias("db_files_disk_usage_MiB"))


def merged_times(log: DataFrame, wanted: DataFrame, keys: list[str], most: float = 30.0) -> DataFrame:
    """Every wanted row with its time: 0 where none was measured, cut at the timeout."""
    return wanted.join(log, keys, "left").withColumn("execution_time", F.least(F.coalesce("execution_time", F.lit(0.0)), F.lit(most)))


def quartiles(rows: DataFrame, value: str, cut: float | None = None) -> DataFrame:
    """Linear quartiles, their distance, and how many values are over the cut (which the quartiles leave out)."""
    kept = rows.filter(F.col(value) <= cut) if cut is not None else rows
    q = kept.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    over = rows.agg(F.sum((F.col(value) > (float("inf") if cut is None else cut)).cast("long")).alias("outliers"))
    return q.crossJoin(over).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "n", "outliers")


def missing_days(rows: DataFrame, time: str, keys: list[str] | None = None) -> DataFrame:
    """Days between the first and the last without a row, for each of the keys."""
    keys = keys or []
    days = rows.select(*keys, F.to_date(time).alias("day")).distinct()
    spine = days.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null").select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(days, [*keys, "day"], "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` in place of those of the table that have their keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def mean_by(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"))


def validity_classes(results: DataFrame, keys: list[str], valid: str = "valid") -> DataFrame:
    """For each query whether it is valid in all, any or no store."""
    out = results.groupBy(*keys).agg(F.bool_or(valid).alias("any_valid"), F.bool_and(valid).alias("all_valid"), F.count(F.lit(1)).alias("stores"))
    return out.withColumn("class", F.when(F.col("all_valid"), "all").when(F.col("any_valid"), "some").otherwise("none"))


def batch_maxima(log: DataFrame, keys: list[str]) -> DataFrame:
    """The longest time of each kind of batch (insert or invalidate) and version."""
    kind = F.when(F.col("batch").startswith("negative"), "invalidate").otherwise("insert")
    version = F.regexp_extract("batch", r"([0-9]+)$", 1).cast("int")
    return log.withColumn("kind", kind).withColumn("version", version).groupBy(*keys, "kind", "version").agg(F.max("execution_time").alias("max_time"))
