"""Metrics of versioned graphs: classes and properties between two times, and how a data set evolves."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairograph.functions.terms import OWL, RDF, RDFS, iri

from .delta import FACT
from .store import is_open, snapshot, valid_at

TYPE, LABEL = iri(RDF + "type"), iri(RDFS + "label")
CLASSES = (iri(RDFS + "Class"), iri(OWL + "Class"))
SUB_CLASS, SUB_PROPERTY = iri(RDFS + "subClassOf"), iri(RDFS + "subPropertyOf")
PROPERTIES = (iri(RDF + "Property"), iri(OWL + "ObjectProperty"), iri(OWL + "DatatypeProperty"))


def _evolution(table: DataFrame, t: dt.datetime, previous: dt.datetime, kinds: tuple[str, ...], parent: str, used: Column, thing: Column, key: list[str]) -> DataFrame:
    """Things of one of the kinds at either time, with each label and parent, and their current, previous, added and deleted uses.

    One pass over the table tells which facts are valid at either time.  used: whether a fact is a use, of ``thing``
    with ``key``.  What is typed by both vocabularies counts twice.
    """
    g = F.col("g") if "g" in table.columns else F.lit(None).cast("string")
    facts = table.filter(valid_at(t) | valid_at(previous)).select(F.coalesce(g, F.lit("")).alias("g"), *FACT, valid_at(t).alias("now"), valid_at(previous).alias("before"))

    role = F.when((F.col("p") == TYPE) & F.col("o").isin(*kinds), "kind").when(F.col("p") == LABEL, "label").when(F.col("p") == parent, "parent")
    told = facts.withColumn("role", role).filter("role IS NOT NULL").groupBy(F.col("s").alias("thing")).agg(F.collect_set(F.struct("role", "g", "o", "now", "before")).alias("told"))

    def these(kind: str, time: str) -> Column:
        return F.filter("told", lambda x: (x["role"] == kind) & x[time])

    def values(kind: str, time: str) -> Column:
        found = F.array_distinct(F.transform(these(kind, time), lambda x: x["o"]))
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast("string")))

    def typed(time: str) -> Column:
        return F.size(F.array_distinct(F.transform(these("kind", time), lambda x: F.struct(x["g"], x["o"]))))

    def listed(time: str) -> Column:
        pairs = F.flatten(F.transform(values("label", time), lambda a: F.transform(values("parent", time), lambda b: F.struct(a.alias("label"), b.alias("parent")))))
        return F.when(typed(time) > 0, pairs).otherwise(F.array().cast("array<struct<label: string, parent: string>>"))

    catalogue = told.select("thing", typed("now").alias("n_now"), typed("before").alias("n_before"), F.explode(F.array_union(listed("now"), listed("before"))).alias("x"))

    graphs = lambda time: F.size(F.collect_set(F.when(F.col(time), F.col("g"))))
    each = facts.filter(used).withColumn("thing", thing).groupBy("thing", *key).agg(graphs("now").alias("now"), graphs("before").alias("before"))
    sums = each.groupBy("thing").agg(F.sum("now").alias("current"), F.sum("before").alias("previous"), F.sum(F.when(F.col("before") == 0, F.col("now"))).alias("added"), F.sum(F.when(F.col("now") == 0, F.col("before"))).alias("deleted"))
    times = {"current": "n_now", "previous": "n_before", "added": "n_now", "deleted": "n_before"}
    counts = [(F.coalesce(F.col(c), F.lit(0)) * F.col(n)).cast("long").alias(c) for c, n in times.items()]
    return catalogue.join(sums, "thing", "left").select("thing", "x.label", "x.parent", *counts).orderBy(F.desc("current"), "thing")


def class_metrics(table: DataFrame, t: dt.datetime, previous: dt.datetime | None = None, kinds: tuple[str, ...] = CLASSES) -> DataFrame:
    """Instances of each class at t and before (by default at t too), and those added and deleted between."""
    return _evolution(table, t, previous or t, kinds, SUB_CLASS, F.col("p") == TYPE, F.col("o"), ["s"])


def property_metrics(table: DataFrame, t: dt.datetime, previous: dt.datetime | None = None, kinds: tuple[str, ...] = PROPERTIES) -> DataFrame:
    """Facts with each property at t and before, and those added and deleted between."""
    return _evolution(table, t, previous or t, kinds, SUB_PROPERTY, F.lit(True), F.col("p"), ["s", "o"])


def static_core_open(table: DataFrame) -> DataFrame:
    """Open rows that began when the first fact did."""
    first = table.agg(F.min("valid_from").alias("first"))
    return table.filter(is_open()).join(F.broadcast(first), F.col("valid_from") == F.col("first")).agg(F.count(F.lit(1)).alias("triples"))


def version_oblivious(table: DataFrame) -> DataFrame:
    """Distinct facts of all times."""
    return table.agg(F.count_distinct(F.struct(*FACT)).alias("triples"))


def snapshot_metrics(versions: DataFrame) -> DataFrame:
    """One row: versions, first and last size, mean growth, facts in every version and in any."""
    sizes = versions.groupBy("version").agg(F.count(F.lit(1)).alias("size"))
    # as many rows as versions
    w = Window.orderBy("version")
    growth = sizes.withColumn("growth", F.lead("size").over(w) / F.col("size"))
    head = growth.agg(F.count(F.lit(1)).alias("versions"), F.min_by("size", "version").alias("cnt_triples_first_version"), F.max_by("size", "version").alias("cnt_triples_last_version"), F.avg("growth").alias("mean_growth"))
    facts = versions.groupBy(*FACT).agg(F.count(F.lit(1)).alias("n"))
    both = facts.crossJoin(F.broadcast(head.select("versions"))).agg(F.sum((F.col("n") == F.col("versions")).cast("long")).alias("cnt_triples_static_core"), F.count(F.lit(1)).alias("cnt_triples_version_oblivious"))
    return head.crossJoin(both)


def change_ratios(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Mean change, insertion and deletion ratio over the steps; the denominator is the size before plus what is added.  A step without change sets counts 0."""
    sizes = versions.groupBy("version").agg(F.count(F.lit(1)).alias("size"))
    w = Window.orderBy("version")
    steps = sizes.withColumn("v_to", F.lead("version").over(w)).filter("v_to is not null")
    delta = changes.groupBy(F.col("v_from").alias("version")).agg(F.sum((F.col("op") == "add").cast("long")).alias("added"), F.sum((F.col("op") == "delete").cast("long")).alias("deleted"))
    steps = steps.join(delta, "version", "left").fillna(0, ["added", "deleted"])
    base = F.col("size") + F.col("added")
    return steps.agg(F.avg((F.col("added") + F.col("deleted")) / base).alias("mean_change_ratio"), F.avg(F.col("added") / base).alias("mean_insertion_ratio"), F.avg(F.col("deleted") / base).alias("mean_deletion_ratio"))


def computed_twice(versions: DataFrame, changes: DataFrame, again: DataFrame) -> DataFrame:
    """The change ratios from two computations of the change sets, and whether both runs agree."""
    names = ("mean_change_ratio", "mean_insertion_ratio", "mean_deletion_ratio")
    a = change_ratios(versions, changes)
    b = change_ratios(versions, again).select(*[F.col(n).alias(f"{n}_again") for n in names])
    same = F.lit(True)
    for n in names:
        same = same & (F.abs(F.col(n) - F.col(f"{n}_again")) < 1e-12)
    return a.crossJoin(b).withColumn("agree", same)  # one row each


def triples_by_graph(table: DataFrame, t: dt.datetime | None = None) -> DataFrame:
    rows = table if t is None else snapshot(table, t)
    return rows.groupBy("g").agg(F.count(F.lit(1)).alias("triples"))


def invalid_ratio(summary: DataFrame, invalid: str = "invalid_triples", total: str = "lines") -> DataFrame:
    return summary.agg((F.sum(invalid) / F.sum(total)).alias("ratio"))


def query_counts(queries: DataFrame) -> DataFrame:
    return queries.groupBy("policy", "dataset", "query_set").agg(F.count(F.lit(1)).alias("queries"))


def delete_metrics(metrics: DataFrame, dataset: Column, since: dt.datetime | None = None) -> DataFrame:
    """Without a data set's rows, all or from an instant on."""
    gone = F.col("dataset_id") == dataset
    return metrics.filter(~(gone if since is None else gone & (F.col("snapshot_ts") >= F.lit(since).cast("timestamp_ntz"))))
