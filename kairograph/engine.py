"""The engine that users call: temporal writes, snapshots and time-travel SPARQL over one versioned table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.exceptions import StoreNotFound
from kairograph.functions.terms import display
from kairograph.operators import store as S
from kairograph.plans.sparql.algebra import Query
from kairograph.plans.sparql.compiler import Compiler
from kairograph.plans.sparql.parser import parse
from kairograph.sources.ntriples import to_line


@dataclass
class TimestampedQuery:
    """A parsed query with the one instant at which all its patterns are evaluated."""

    text: str
    algebra: Query
    timestamp: dt.datetime

    def __str__(self) -> str:
        return f"# facts with valid_from <= {self.timestamp.isoformat(timespec='milliseconds')} < valid_until\n{self.text}"


def timestamp_query(query: str, version_timestamp: dt.datetime | str | None = None, mode: str = "decorator") -> tuple[TimestampedQuery, dt.datetime]:
    """Parse a query and bind it to an instant (now by default); raises what the parser raises."""
    S.check_mode(mode)
    t = S.instant(version_timestamp)
    return TimestampedQuery(query, parse(query), t), t


class TripleStoreEngine:
    """A versioned table at ``path`` (or given as a DataFrame, then read-only in place: writes give a new engine state in memory)."""

    def __init__(self, spark: SparkSession, path: str | None = None, table: DataFrame | None = None, mode: str = "decorator", services: dict[str, DataFrame] | None = None, paths: str = "all", skip_connection_test: bool = True):
        self.spark, self.mode, self.services, self.paths = spark, S.check_mode(mode), services or {}, paths
        self.store = S.VersionedStore(spark, path) if path else None
        self._table = table
        self.timestamped_query: TimestampedQuery | None = None
        if not skip_connection_test:
            self.check()

    def check(self) -> None:
        missing = {"s", "p", "o", "valid_from", "valid_until"} - set(self.table().columns)
        if missing:
            raise StoreNotFound(f"the versioned table has no {', '.join(sorted(missing))}")

    def table(self) -> DataFrame:
        df = self.store.table() if self.store else self._table
        if df is None:
            raise StoreNotFound("the engine has no table")
        return df

    def _keep(self, table: DataFrame) -> None:
        if self.store:
            self.store.commit(table)
        else:
            self._table = table

    def _change(self, gone: DataFrame | None, new: DataFrame | None, t: dt.datetime) -> None:
        if self.store:
            self.store.change(gone, new, t)
            return
        table = self.table() if gone is None else S.outdate(self.table(), gone, t)
        self._table = table if new is None else table.unionByName(new)

    # --- writes; chunk_size is accepted and not needed: a call is one commit

    def version_all_triples(self, initial_timestamp: dt.datetime | str | None = None, plain: DataFrame | None = None) -> None:
        self._keep(S.version_all(plain if plain is not None else self.table(), S.instant(initial_timestamp)))

    def insert(self, triples: list | str, prefixes: dict[str, str] | None = None, timestamp: dt.datetime | str | None = None, chunk_size: int = 1000, dedupe: bool = False) -> None:
        if not triples:
            return
        facts = S.fact_rows(self.spark, triples, prefixes)
        if "g" in self.table().columns:
            facts = facts.withColumn("g", F.lit(None).cast("string"))
        t = S.instant(timestamp)
        self._change(None, S.new_rows(self.table(), facts, t, self.mode, dedupe), t)

    def update(self, old: list, new: list, prefixes: dict[str, str] | None = None, chunk_size: int = 1000, timestamp: dt.datetime | str | None = None, whole_terms: bool = False) -> None:
        if not old and not new:
            return
        changes = S.change_rows(self.spark, [self._terms(x, prefixes) for x in old], [self._terms(x, prefixes) for x in new])
        t = S.instant(timestamp)
        self._change(*S.update_parts(self.table(), changes, t, whole_terms), t)

    def outdate(self, triples: list | str, prefixes: dict[str, str] | None = None, timestamp: dt.datetime | str | None = None, chunk_size: int = 1000) -> None:
        if triples:
            self._change(S.fact_rows(self.spark, triples, prefixes), None, S.instant(timestamp))

    def drop_graph(self, graph: str | None) -> None:
        """Remove all rows of a named graph, history included (None: of the default graph)."""
        self._keep(self.table().filter(~F.col("g").eqNullSafe(F.lit(graph))))

    def import_graph(self, facts: DataFrame, graph: str | None = None, timestamp: dt.datetime | str | None = None) -> None:
        """Open the facts (s, p, o) in a named graph."""
        t = S.instant(timestamp)
        self._change(None, S.new_rows(self.table(), facts.withColumn("g", F.lit(graph).cast("string")), t, self.mode), t)

    def dump(self, path: str) -> None:
        """The whole versioned table as N-Quads-star lines of the decorator form."""
        from kairograph.operators.variants import star_lines

        star_lines(self.table()).write.text(path)

    def rollback(self, timestamp: dt.datetime | str) -> None:
        """Undo everything from an instant on."""
        t = S.instant(timestamp)
        self._keep(S.rollback_deletes(S.rollback_inserts(self.table(), t), t))

    @staticmethod
    def _terms(triple, prefixes: dict[str, str] | None):
        from kairograph.plans.sparql.parser import Parser

        out, known = [], S.check_prefixes(prefixes)
        for x in triple:
            if x is None:
                out.append(None)
                continue
            p = Parser(str(x))
            p.prefixes = dict(known)
            out.append(p.term())
        return out

    # --- reads

    def query(self, select: str, timestamp: dt.datetime | str | None = None, yn_timestamp_query: bool = True, as_df: bool = True) -> DataFrame:
        """Solutions as canonical terms, one column for each variable; ``as_df=False`` gives them in their display form."""
        bound, t = timestamp_query(select, timestamp, self.mode)
        self.timestamped_query = bound if yn_timestamp_query else None
        facts = self.table()
        if yn_timestamp_query:
            facts = facts.filter(S.valid_at(t))
        if "g" not in facts.columns:
            facts = facts.withColumn("g", F.lit(None).cast("string"))
        out = Compiler(self.spark, facts.select("g", "s", "p", "o"), self.services, S.instant(None), self.paths).run(bound.algebra)
        return out if as_df or bound.algebra.form == "ask" else out.select(*[display(F.col(f"`{c}`")).alias(c) for c in out.columns])

    def retrieve_snapshot(self, timestamp: dt.datetime | str | None = None) -> DataFrame:
        """The facts valid at an instant, as s, p, o and the N-Triples line."""
        df = S.snapshot(self.table(), S.instant(timestamp)).select("s", "p", "o").distinct()
        return df.withColumn("line", to_line(F.col("s"), F.col("p"), F.col("o")))

    def count_triples(self, timestamp: dt.datetime | str | None = None) -> int:
        return S.snapshot_count(self.table(), S.instant(timestamp)).first()[0]
