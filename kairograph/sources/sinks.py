"""Writers: lines of any serialisation, CSV results, timings logs, and the bounded view for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.functions.terms import display

TIMINGS = "timestamp timestamp_ntz, insertions long, deletions long, time_prepare_ns long, time_delta_ns long, time_versioning_ns long, time_overall_ns long, cnt_triples long"
SHOWN = 200


def write_lines(lines: DataFrame, path: str, mode: str = "error") -> None:
    """A table with the one column ``value`` as text files."""
    lines.select("value").write.mode(mode).text(path)


def write_csv(result: DataFrame, path: str) -> None:
    """A result set in display form, with its header."""
    result.select(*[display(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in result.dtypes]).write.csv(path, header=True)


def shown(result: DataFrame, most: int = SHOWN) -> tuple[list, bool]:
    """At most ``most`` rows and whether there are more."""
    rows = result.limit(most + 1).collect()
    return rows[:most], len(rows) > most


def append_timings(spark: SparkSession, path: str, row: dict, mode: str = "append") -> None:
    spark.createDataFrame([tuple(row[f.split()[0]] for f in TIMINGS.split(", "))], TIMINGS).coalesce(1).write.mode(mode).parquet(path)


def delta_event(delta: DataFrame, repository: str, at: Column, versioning_ms: int = 0) -> DataFrame:
    """One row of JSON for a delta with both lists of lines, as a receiver of notifications gets it; for deltas that one row can hold."""
    line = F.concat_ws(" ", "s", "p", "o", F.lit("."))
    rows = delta.agg(F.collect_list(F.when(F.col("op") == "add", line)).alias("insertions"), F.collect_list(F.when(F.col("op") == "delete", line)).alias("deletions"))
    event = F.struct(F.expr("uuid()").alias("id"), F.lit(repository).alias("repository_name"), F.size("insertions").alias("total_insertions"), F.size("deletions").alias("total_deletions"), F.array_sort("insertions").alias("insertions"), F.array_sort("deletions").alias("deletions"), F.lit(versioning_ms).alias("versioning_duration_ms"), at.alias("timestamp"))
    return rows.select(F.to_json(event).alias("value"))
