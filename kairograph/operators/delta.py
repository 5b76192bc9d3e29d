"""Deltas between fact sets, change sets over a chain of versions, and checks between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FACT = ("s", "p", "o")


def insertions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Facts of ``new`` that aren't stored (set semantics)."""
    return new.select(*FACT).subtract(stored.select(*FACT))


def deletions(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.select(*FACT).subtract(new.select(*FACT))


def anti_delta(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The same as two anti-joins: op, s, p, o."""
    a, b = new.select(*FACT).distinct(), stored.select(*FACT).distinct()
    added = a.join(b, list(FACT), "left_anti").withColumn("op", F.lit("add"))
    return added.unionByName(b.join(a, list(FACT), "left_anti").withColumn("op", F.lit("delete"))).select("op", *FACT)


def indicator_delta(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The same as one full outer join: one shuffle of each side gives both directions."""
    a = new.select(*FACT).distinct().withColumn("in_new", F.lit(True))
    b = stored.select(*FACT).distinct().withColumn("in_stored", F.lit(True))
    joined = a.join(b, list(FACT), "full")
    op = F.when(F.col("in_stored").isNull(), "add").when(F.col("in_new").isNull(), "delete")
    return joined.withColumn("op", op).filter("op is not null").select("op", *FACT)


def counts_agree(delta_a: DataFrame, delta_b: DataFrame) -> DataFrame:
    """Counts by op of two deltas, and whether they agree."""
    a = delta_a.groupBy("op").agg(F.count(F.lit(1)).alias("n_a"))
    b = delta_b.groupBy("op").agg(F.count(F.lit(1)).alias("n_b"))
    return a.join(b, "op", "full").select("op", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).withColumn("agree", F.col("n_a") == F.col("n_b"))


def islands(versions: DataFrame, last: Column | int) -> DataFrame:
    """Runs of consecutive versions of each fact: s, p, o, first, final.  versions: version, s, p, o, one row a fact and version."""
    w = Window.partitionBy(*FACT).orderBy("version")
    runs = versions.select("version", *FACT).distinct().withColumn("run", F.col("version") - F.row_number().over(w))
    return runs.groupBy(*FACT, "run").agg(F.min("version").alias("first"), F.max("version").alias("final")).drop("run")


def change_sets(versions: DataFrame, first: int, last: int) -> DataFrame:
    """v_from, v_to, op, s, p, o between consecutive versions, in one pass over the facts' islands instead of one difference for each pair."""
    runs = islands(versions, last)
    added = runs.filter(F.col("first") > first).select((F.col("first") - 1).alias("v_from"), F.col("first").alias("v_to"), F.lit("add").alias("op"), *FACT)
    gone = runs.filter(F.col("final") < last).select(F.col("final").alias("v_from"), (F.col("final") + 1).alias("v_to"), F.lit("delete").alias("op"), *FACT)
    return added.unionByName(gone).select(*[F.col(c).cast("int").alias(c) if c.startswith("v_") else F.col(c) for c in ("v_from", "v_to", "op", *FACT)])


def replay(initial: DataFrame, changes: DataFrame, version: int) -> DataFrame:
    """The facts of a version from the first one and the change sets up to it: of each fact the last change counts."""
    base = initial.select(*FACT).distinct().select(F.lit(-1).alias("v"), F.lit("add").alias("op"), *FACT)
    rows = base.unionByName(changes.filter(F.col("v_to") <= version).select(F.col("v_to").alias("v"), "op", *FACT))
    return rows.groupBy(*FACT).agg(F.max_by("op", "v").alias("op")).filter("op = 'add'").select(*FACT)


VERSION_IRI = "version:"


def chain_graphs(initial: DataFrame, changes: DataFrame, versions: list[int]) -> DataFrame:
    """Materialised versions of a delta chain as facts in the graphs <version:k>, for queries with GRAPH <version:k>."""
    out = None
    for k in versions:
        part = replay(initial, changes, k).select(F.lit(f"<{VERSION_IRI}{k}>").alias("g"), *FACT)
        out = part if out is None else out.unionByName(part)
    return out


def pairwise_changes(versions: DataFrame, first: int, last: int) -> DataFrame:
    """The change sets by one difference for each pair of versions, to hold against :func:`change_sets`."""
    out = None
    for k in range(first, last):
        part = anti_delta(versions.filter(F.col("version") == k), versions.filter(F.col("version") == k + 1)).select(F.lit(k).alias("v_from"), F.lit(k + 1).alias("v_to"), "op", *FACT)
        out = part if out is None else out.unionByName(part)
    return out


def consistency(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """For each step: size before + added - deleted, and the size after."""
    sizes = versions.groupBy("version").agg(F.count(F.lit(1)).alias("size"))
    step = changes.groupBy("v_from", "v_to").agg(F.sum((F.col("op") == "add").cast("long")).alias("added"), F.sum((F.col("op") == "delete").cast("long")).alias("deleted"))
    before, after = sizes.select(F.col("version").alias("v_from"), F.col("size").alias("before")), sizes.select(F.col("version").alias("v_to"), F.col("size").alias("after"))
    out = step.join(before, "v_from").join(after, "v_to")
    return out.withColumn("consistent", F.col("before") + F.col("added") - F.col("deleted") == F.col("after"))


def delta_lines(delta: DataFrame) -> DataFrame:
    """A delta file: ``- fact`` lines before ``+ fact`` lines."""
    line = F.concat(F.when(F.col("op") == "delete", "- ").otherwise("+ "), F.concat_ws(" ", *FACT), F.lit(" ."))
    return delta.select((F.col("op") == "add").alias("late"), line.alias("value")).orderBy("late", "value").select("value")
