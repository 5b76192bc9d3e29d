"""Conversions between archiving policies: independent copies, change sets, version lists, validity intervals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.terms import OWL, VERS, XSD

from .delta import FACT, islands
from .store import sentinel

#: Version k counts from this instant in steps of a second (fixed values of the benchmark).
ORIGIN = dt.datetime(2022, 10, 1, 12)
IC_GRAPH, TB_GRAPH, VERSION_GRAPH = "http://kairograph.example/ic/v", "http://kairograph.example/v", "http://kairograph.example/versions"


def version_time(version: Column, origin: dt.datetime = ORIGIN) -> Column:
    return F.lit(origin).cast("timestamp_ntz") + F.make_dt_interval(secs=version)


def intervals(versions: DataFrame, last: int, origin: dt.datetime = ORIGIN) -> DataFrame:
    """Independent copies as validity intervals: one row for each run of consecutive versions; only the last run can be open."""
    runs = islands(versions, last)
    until = F.when(F.col("final") == last, sentinel()).otherwise(version_time(F.col("final") + 1, origin))
    return runs.select(*FACT, version_time(F.col("first"), origin).alias("valid_from"), until.alias("valid_until"))


def intervals_from_changes(initial: DataFrame, changes: DataFrame, origin: dt.datetime = ORIGIN) -> DataFrame:
    """The same from the first version and change sets: each addition is closed by the next deletion of its fact."""
    from pyspark.sql.window import Window

    base = initial.select(*FACT).distinct().select(F.lit(0).alias("v"), F.lit("add").alias("op"), *FACT)
    rows = base.unionByName(changes.select(F.col("v_to").alias("v"), "op", *FACT))
    w = Window.partitionBy(*FACT).orderBy("v")
    rows = rows.withColumn("next_v", F.lead("v").over(w)).filter("op = 'add'")
    until = F.when(F.col("next_v").isNull(), sentinel()).otherwise(version_time(F.col("next_v"), origin))
    return rows.select(*FACT, version_time(F.col("v"), origin).alias("valid_from"), until.alias("valid_until"))


def version_lists(versions: DataFrame) -> DataFrame:
    """s, p, o and the sorted list of versions in which the fact is valid."""
    return versions.groupBy(*FACT).agg(F.array_sort(F.collect_set("version")).alias("versions"))


def list_graph(versions: Column) -> Column:
    """The graph IRI of a version list: v and the versions joined by underscores."""
    return F.concat(F.lit(f"<{TB_GRAPH}"), F.array_join(versions.cast("array<string>"), "_"), F.lit(">"))


def query_copies(versions: DataFrame, k: int) -> DataFrame:
    """Facts of version k of independent copies; a table partitioned by version reads only that part."""
    return versions.filter(F.col("version") == k).select(*FACT)


def query_lists(lists: DataFrame, k: int) -> DataFrame:
    return lists.filter(F.array_contains("versions", k)).select(*FACT)


def bridge(lists: DataFrame) -> DataFrame:
    """graph, version of each version list."""
    return lists.select(list_graph(F.col("versions")).alias("graph"), F.explode("versions").alias("version")).distinct()


def query_lists_by_graph(lists: DataFrame, k: int) -> DataFrame:
    """The version's facts with their graph, through the bridge; patterns that are to match in one graph join on it."""
    graphs = bridge(lists).filter(F.col("version") == k).select("graph")
    return lists.select(list_graph(F.col("versions")).alias("graph"), *FACT).join(graphs, "graph")


def star_lines(table: DataFrame, namespace: str = VERS) -> DataFrame:
    """Validity intervals as doubly nested quoted triples."""
    stamp = lambda c: F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'"), F.lit(f'"^^<{XSD}dateTime>'))
    inner = F.concat(F.lit("<< << "), F.concat_ws(" ", *FACT), F.lit(f" >> <{namespace}valid_from> "), stamp(F.col("valid_from")), F.lit(f" >> <{namespace}valid_until> "), stamp(F.col("valid_until")), F.lit(" ."))
    return table.select(inner.alias("value"))


def reified_lines(table: DataFrame, namespace: str = VERS) -> DataFrame:
    """The same as reified statements; the blank node is named after the row, so a repeated task gives the same."""
    stamp = lambda c: F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'"), F.lit(f'"^^<{XSD}dateTime>'))
    node = F.concat(F.lit("_:b"), F.md5(F.concat_ws(" ", *FACT, F.date_format("valid_from", "yyyyMMddHHmmssSSS"))))
    line = F.concat(node, F.lit(" rdf:reifies << "), F.concat_ws(" ", *FACT), F.lit(f" >> ; <{namespace}valid_from> "), stamp(F.col("valid_from")), F.lit(f" ; <{namespace}valid_until> "), stamp(F.col("valid_until")), F.lit(" ."))
    return table.select(line.alias("value"))


def copies_trig(versions: DataFrame) -> DataFrame:
    """Independent copies as TriG, one GRAPH statement for each fact's graph."""
    return versions.select(F.concat(F.lit(f"GRAPH <{IC_GRAPH}"), F.col("version").cast("string"), F.lit("> { "), F.concat_ws(" ", *FACT), F.lit(" . }")).alias("value"))


def list_quads(lists: DataFrame) -> DataFrame:
    """Version lists as N-Quads: facts in the graph of their list, and which versions each graph stands for."""
    facts = lists.select(F.concat_ws(" ", *FACT, list_graph(F.col("versions")), F.lit(".")).alias("value"))
    info = bridge(lists).select(F.concat_ws(" ", "graph", F.lit(f"<{OWL}versionInfo>"), F.concat(F.lit('"'), F.col("version").cast("string"), F.lit(f'"^^<{XSD}integer>')), F.lit(f"<{VERSION_GRAPH}>"), F.lit(".")).alias("value"))
    return facts.unionByName(info)
