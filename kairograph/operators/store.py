"""Versioned facts: a table of (g, s, p, o) with a half-open validity interval, its temporal writes and its snapshots.

All operators are functions from DataFrame to DataFrame; :class:`VersionedStore` keeps the table under one
folder as immutable folders of rows and numbered commits.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.exceptions import ConcurrentWrite, ReservedPrefix, StoreNotFound, UnknownMode, WrongInputFormat

#: The end of an open interval: 9999-12-31T00:00:00+02:00 in UTC (a fixed value).
SENTINEL = dt.datetime(9999, 12, 30, 22)
RESERVED_PREFIX = "vers"
MODES = ("decorator", "reification")
COLUMNS = ("g", "s", "p", "o", "valid_from", "valid_until")
SCHEMA = "g string, s string, p string, o string, valid_from timestamp_ntz, valid_until timestamp_ntz"


def instant(t: dt.datetime | str | None) -> dt.datetime:
    """A time in UTC without zone, cut to milliseconds; now by default."""
    if t is None:
        t = dt.datetime.now(dt.timezone.utc)
    if isinstance(t, str):
        t = dt.datetime.fromisoformat(t)
    if t.tzinfo is not None:
        t = t.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return t.replace(microsecond=t.microsecond // 1000 * 1000)


def at(t: dt.datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def sentinel() -> Column:
    return at(SENTINEL)


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise UnknownMode(f"mode {mode!r}; known: {', '.join(MODES)}")
    return mode


def is_open() -> Column:
    return F.col("valid_until") == sentinel()


# --- writes


def version_all(plain: DataFrame, t: dt.datetime) -> DataFrame:
    """Every distinct plain fact as an open one from t on."""
    keys = [c for c in ("g", "s", "p", "o") if c in plain.columns]
    return plain.select(*keys).distinct().withColumn("valid_from", at(t)).withColumn("valid_until", sentinel())


def new_rows(table: DataFrame, facts: DataFrame, t: dt.datetime, mode: str = "decorator", dedupe: bool = False) -> DataFrame:
    """The rows that :func:`insert` adds."""
    new = facts.withColumn("valid_from", at(t)).withColumn("valid_until", sentinel()).select(*table.columns)
    keys = [c for c in ("g", "s", "p", "o") if c in table.columns]
    if check_mode(mode) == "decorator":
        new = new.distinct()
        new = _without(new, table.filter((F.col("valid_from") == at(t)) & is_open()), keys)
    if dedupe:
        new = _without(new, table.filter(is_open()), keys)
    return new


def insert(table: DataFrame, facts: DataFrame, t: dt.datetime, mode: str = "decorator", dedupe: bool = False) -> DataFrame:
    """Open facts from t on.  No check for open ones (``dedupe`` leaves those out); a row that is there already collapses in decorator mode."""
    return table.unionByName(new_rows(table, facts, t, mode, dedupe))


def _without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    other = others.select(*[F.col(k).alias(f"o_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"o_{k}")) if k == "g" else F.col(k) == F.col(f"o_{k}")
        on = on & same
    return rows.join(other, on, "left_anti")


def _marked(table: DataFrame, facts: DataFrame) -> DataFrame:
    """``table`` with ``hit``, true in the rows of the facts."""
    keys = [c for c in ("s", "p", "o") if c in table.columns]
    gone = facts.select(*[F.col(k).alias(f"d_{k}") for k in keys]).distinct().withColumn("hit", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"d_{k}"))
    return table.join(gone, on, "left").select(*table.columns, F.coalesce("hit", F.lit(False)).alias("hit"))


def outdate(table: DataFrame, facts: DataFrame, t: dt.datetime) -> DataFrame:
    """Close the open rows of the facts at t; others aren't touched, so it may be repeated."""
    until = F.when(F.col("hit") & is_open(), at(t)).otherwise(F.col("valid_until"))
    return _marked(table, facts).withColumn("valid_until", until).select(*table.columns)


def update_parts(table: DataFrame, changes: DataFrame, t: dt.datetime, whole_terms: bool = False) -> tuple[DataFrame, DataFrame]:
    """(facts that :func:`update` closes, rows that it opens).  What changes is known from the changes alone, so neither side needs the other."""
    from kairograph.functions.terms import lex

    spo = ("s", "p", "o")
    shown = (lambda c: c) if whole_terms else (lambda c: F.coalesce(lex(c), c))
    new = [F.coalesce(F.col(f"new_{k}"), F.col(f"old_{k}")) for k in spo]
    changes = changes.filter(F.concat(*[shown(c) for c in new]) != F.concat(*[shown(F.col(f"old_{k}")) for k in spo]))
    on = is_open()
    for k in spo:
        on = on & (F.col(k) == F.col(f"old_{k}"))
    rest = [c for c in table.columns if c not in spo]
    opened = table.join(changes, on).select(*[c.alias(k) for k, c in zip(spo, new, strict=True)], *rest)
    opened = opened.withColumn("valid_from", at(t)).withColumn("valid_until", sentinel()).select(*table.columns).distinct()
    return changes.select(*[F.col(f"old_{k}").alias(k) for k in spo]), opened


def update(table: DataFrame, changes: DataFrame, t: dt.datetime, whole_terms: bool = False) -> DataFrame:
    """Replace open facts.  changes: old_s, old_p, old_o and new_s, new_p, new_o, where null inherits.

    The old row is closed at t and the new one opened, unless the text of the three terms stays the same
    (``whole_terms``: unless the terms do, with language and datatype).
    """
    gone, opened = update_parts(table, changes, t, whole_terms)
    return outdate(table, gone, t).unionByName(opened)


def rollback_inserts(table: DataFrame, t: dt.datetime) -> DataFrame:
    """Without the rows that began at t or later."""
    return table.filter(F.col("valid_from") < at(t))


def rollback_deletes(table: DataFrame, t: dt.datetime) -> DataFrame:
    """Rows closed at t or later are open again."""
    return table.withColumn("valid_until", F.when((F.col("valid_until") >= at(t)) & ~is_open(), sentinel()).otherwise(F.col("valid_until")))


# --- reads


def valid_at(t: dt.datetime) -> Column:
    """The half-open interval test; both comparisons reach the parquet scan."""
    return (F.col("valid_from") <= at(t)) & (F.col("valid_until") > at(t))


def snapshot(table: DataFrame, t: dt.datetime) -> DataFrame:
    """The distinct facts valid at t."""
    keys = [c for c in ("g", "s", "p", "o") if c in table.columns]
    return table.filter(valid_at(t)).select(*keys).distinct()


def snapshot_without_newer(table: DataFrame, t: dt.datetime) -> DataFrame:
    """The same with the explicit test that no newer version of the fact began up to t."""
    keys = [c for c in ("g", "s", "p", "o") if c in table.columns]
    newest = table.filter(F.col("valid_from") <= at(t)).groupBy(*keys).agg(F.max("valid_from").alias("newest"))
    valid = table.filter(valid_at(t))
    on = F.col("n.newest") > F.col("v.valid_from")
    for k in keys:
        on = on & F.col(f"v.{k}").eqNullSafe(F.col(f"n.{k}"))  # the default graph is null
    return valid.alias("v").join(newest.alias("n"), on, "left_anti").select(*keys).distinct()


def snapshot_count(table: DataFrame, t: dt.datetime) -> DataFrame:
    return table.filter(valid_at(t)).agg(F.count(F.lit(1)).alias("triples"))


def creation_timestamps(table: DataFrame) -> DataFrame:
    return table.select("valid_from").distinct().orderBy("valid_from")


def latest_update(table: DataFrame) -> DataFrame:
    """The last time at which a fact began or ended."""
    ended = F.max(F.when(~is_open(), F.col("valid_until")))
    return table.agg(F.greatest(F.max("valid_from"), ended).alias("latest"))


def as_of(rows: DataFrame, time: str, t: Column) -> DataFrame:
    """All rows of the last ``time`` at or before t."""
    last = rows.filter(F.col(time) <= t).agg(F.max(time).alias("as_of"))
    return rows.join(last, F.col(time) == F.col("as_of")).drop("as_of")


# --- input


def check_prefixes(prefixes: dict[str, str] | None) -> dict[str, str]:
    """The prefixes of a write; the one of the validity predicates is taken."""
    if prefixes and RESERVED_PREFIX in prefixes:
        raise ReservedPrefix(f"the prefix {RESERVED_PREFIX}: is reserved")
    return dict(prefixes or {})


def fact_rows(spark: SparkSession, triples: list | str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """s, p, o of N-Triples lines or (s, p, o) rows; prefixed names are resolved.  Nothing given is changed."""
    import re

    from kairograph.plans.sparql.parser import Parser

    known = check_prefixes(prefixes)
    if isinstance(triples, str):
        triples = [x for x in triples.splitlines() if x.strip() and not x.strip().startswith("#")]
    rows = []
    for x in triples:
        if isinstance(x, (tuple, list)):
            if len(x) != 3:
                raise WrongInputFormat("a triple has three terms")
            text = " ".join(str(y) for y in x)
        else:
            text = re.sub(r"\s*\.\s*$", "", x)
        try:
            p = Parser(text)
            p.prefixes = dict(known)
            terms = [p.verb() if k == 1 else p.term() for k in range(3)]
            if p.kind != "end":
                raise WrongInputFormat(f"more than three terms: {x!r}")
        except WrongInputFormat:
            raise
        except Exception as e:
            raise WrongInputFormat(f"not a triple: {x!r} ({e})") from e
        rows.append(tuple(terms))
    return spark.createDataFrame(rows, "s string, p string, o string")


def change_rows(spark: SparkSession, old: list, new: list) -> DataFrame:
    if len(old) != len(new):
        raise WrongInputFormat("old and new triples differ in number")
    if any(len(x) != 3 for x in [*old, *new]):
        raise WrongInputFormat("a triple has three terms")
    names = [f"{k}_{c}" for k in ("old", "new") for c in "spo"]
    return spark.createDataFrame([(*a, *b) for a, b in zip(old, new, strict=True)], ", ".join(f"{n} string" for n in names))


#: Buckets of a store's open rows, by hash of the subject: a commit that closes facts rewrites those of the facts only.
BUCKETS = 16


class VersionedStore:
    """Folders of rows that never change, and numbered commits that name the ones to read.

    A commit is a file ``commits/<number>`` with the folders of closed rows and, bucket by bucket, of open ones.
    New facts are a folder more.  Closing facts moves their rows to a folder of closed ones and rewrites the rest of
    their buckets; history isn't touched.  The file is created and never overwritten: readers see the last whole
    one, and of two writers that start from the same commit the second gets ConcurrentWrite.  :meth:`compact` merges
    folders, :meth:`vacuum` deletes those that no recent commit names.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def commits(self) -> list[int]:
        return sorted(int(n) for n in self._names("commits") if n.isdigit())

    def state(self, number: int | None = None) -> tuple[int, dict]:
        """(number, folders) of the last commit, or of the one asked for; a file that a writer didn't end doesn't count."""
        jvm, fs = self._fs()
        for n in [number] if number is not None else self.commits()[::-1]:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{n:010d}"))
            try:
                return n, json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                continue
            finally:
                stream.close()
        raise StoreNotFound(f"no versioned table at {self.path}")

    def exists(self) -> bool:
        return bool(self.commits())

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def table(self, number: int | None = None) -> DataFrame:
        state = self.state(number)[1]
        return self._read([*state["closed"], *(f for folders in state["open"].values() for f in folders)])

    def open_rows(self) -> DataFrame:
        return self._read([f for folders in self.state()[1]["open"].values() for f in folders])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("s"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict:
        """Write rows sorted for skipping by predicate and subject; the folders that this made."""
        if "g" not in rows.columns:
            rows = rows.withColumn("g", F.lit(None).cast("string"))
        name = f"data/{uuid.uuid4().hex}"
        rows = rows.select(*COLUMNS).withColumn("open", is_open()).withColumn("bucket", F.when(F.col("open"), self._bucket()).otherwise(-1))
        rows.repartitionByRange("bucket", "p", "s").sortWithinPartitions("bucket", "p", "s", "valid_from").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        made = {f.partition("=")[2]: f"{name}/{f}" for f in self._names(name) if f.startswith("bucket=")}
        return {"closed": [f for b, f in made.items() if b == "-1"], "open": {b: [f] for b, f in made.items() if b != "-1"}}

    def _publish(self, after: int, state: dict) -> None:
        from py4j.protocol import Py4JJavaError

        jvm, fs = self._fs()
        number = after + 1
        try:
            out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{number:010d}"), False)
        except Py4JJavaError as e:
            raise ConcurrentWrite(f"commit {number} of {self.path} is there already") from e
        out.write(bytearray((json.dumps(state) + "\n").encode()))
        out.close()

    def _last(self) -> tuple[int, dict]:
        """Where a writer starts: the last number, whole or not, and the last state."""
        numbers = self.commits()
        return (numbers[-1], self.state()[1]) if numbers else (0, {"closed": [], "open": {}})

    def commit(self, table: DataFrame) -> None:
        """A whole new state."""
        number = (self.commits() or [0])[-1]
        self._publish(number, self._write(table))

    def change(self, gone: DataFrame | None, new: DataFrame | None, t: dt.datetime) -> None:
        """Close the facts ``gone`` (s, p, o) at t and add the open rows ``new``, in one commit."""
        number, state = self._last()
        parts = []
        if new is not None:
            parts.append(self._write(new))
        opened = {b: list(folders) for b, folders in state["open"].items()}
        if gone is not None:
            touched = [str(r["b"]) for r in gone.select(self._bucket().alias("b")).distinct().collect()]  # as many as buckets at most
            held = [f for b in touched for f in opened.pop(b, [])]
            if held:
                rows = _marked(self._read(held), gone)
                parts.append(self._write(rows.withColumn("valid_until", F.when(F.col("hit"), at(t)).otherwise(F.col("valid_until")))))
        closed = list(state["closed"])
        for part in parts:
            closed += part["closed"]
            for b, folders in part["open"].items():
                opened.setdefault(b, []).extend(folders)
        self._publish(number, {"closed": closed, "open": opened})

    def compact(self) -> None:
        """The same rows in as few folders as there are buckets."""
        self.commit(self.table())

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the last ``keep`` commits names; how many."""
        jvm, fs = self._fs()
        needed = set()
        for n in self.commits()[-keep:]:
            state = self.state(n)[1]
            needed |= {f.split("/")[1] for f in [*state["closed"], *(x for folders in state["open"].values() for x in folders)]}
        old = [n for n in self._names("data") if n not in needed]
        for n in old:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{n}"), True)
        return len(old)
