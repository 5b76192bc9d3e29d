"""Tracked data sets: a landing folder of dumps, each compared with the store and versioned as it arrives.

Structured Streaming watches the folder; ``foreachBatch`` takes the new dumps in the order of their
instants, computes the delta to the open facts, and closes and opens rows in one commit per dump.  The
commit's instant is the state: a dump that isn't newer than the last one is left out, so a batch that runs
again changes nothing.  Timings and metrics of a dump lie in a folder of its instant, the timings last; what a
crash left out after the commit is made up for when the batch runs again.  The registry is kept below the root,
one file for each data set, so a new Tracker goes on where the last one ended.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.operators import delta as D
from kairograph.operators import metrics as M
from kairograph.operators import store as S
from kairograph.operators.storage import materialised
from kairograph.sources.ntriples import normalise, parse, skolemise_object, skolemise_subject
from kairograph.sources.sinks import append_timings, delta_event

#: A dump's name holds its instant: YYYYMMDD-HHMMSS_mmm.
_STAMP = re.compile(r"(\d{8}-\d{6}_\d{3})[^/]*(?:/part-[^/]*)?$")


@dataclass
class Dataset:
    name: str
    source: str
    polling_interval: int = 3600
    webhook: Callable[[str], None] | None = None
    active: bool = True
    next_run: dt.datetime | None = None
    last_modified: dt.datetime | None = None
    id: str = field(default_factory=lambda: str(uuid.uuid4()))


def _folder(t: dt.datetime) -> str:
    return f"at={t:%Y%m%d%H%M%S}{t.microsecond // 1000:03d}"


def stamp_of(path: str) -> dt.datetime | None:
    m = _STAMP.search(path)
    return dt.datetime.strptime(m[1] + "000", "%Y%m%d-%H%M%S_%f") if m else None


def facts_of(lines: DataFrame) -> DataFrame:
    """Distinct facts of dump lines (column value)."""
    line = F.trim("value")
    kept = lines.select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    return parse(kept.select(skolemise_object(skolemise_subject(normalise(F.col("line")))).alias("line"))).distinct()


def version_step(store: S.VersionedStore, facts: DataFrame, t: dt.datetime) -> tuple[DataFrame, dict]:
    """Bring the store to ``facts`` at t: (delta, measurements)."""
    began = time.perf_counter_ns()
    if not store.exists():
        table = S.version_all(facts.withColumn("g", F.lit(None).cast("string")), t)
        store.commit(table)
        done = time.perf_counter_ns()
        delta = store.spark.createDataFrame([], "op string, s string, p string, o string")
        return delta, {"timestamp": t, "insertions": 0, "deletions": 0, "time_prepare_ns": 0, "time_delta_ns": 0, "time_versioning_ns": done - began, "time_overall_ns": done - began, "cnt_triples": S.snapshot_count(store.table(), t).first()[0]}
    table = store.table()
    delta = materialised(D.indicator_delta(store.open_rows(), facts), "delta")
    compared = time.perf_counter_ns()
    counts = {r["op"]: r["count"] for r in delta.groupBy("op").count().collect()}
    if counts:
        added = delta.filter("op = 'add'").select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
        store.change(delta.filter("op = 'delete'") if counts.get("delete") else None, S.new_rows(table, added, t) if counts.get("add") else None, t)
    done = time.perf_counter_ns()
    return delta, {"timestamp": t, "insertions": counts.get("add", 0), "deletions": counts.get("delete", 0), "time_prepare_ns": 0, "time_delta_ns": compared - began, "time_versioning_ns": done - compared, "time_overall_ns": done - began, "cnt_triples": S.snapshot_count(store.table(), t).first()[0]}


class Tracker:
    """Data sets below one folder: each has a store, a log of timings, a metrics table and the stream's checkpoint.

    webhooks: receivers by data set, for those that the registry brings back.  workers: data sets that
    :meth:`run_due` follows at the same time.
    """

    def __init__(self, spark: SparkSession, root: str, webhooks: dict[str, Callable[[str], None]] | None = None, workers: int = 10):
        self.spark, self.root, self.workers = spark, root.rstrip("/"), workers
        self.queries: dict[str, object] = {}
        self.datasets: dict[str, Dataset] = {}
        for name in self._names("registry"):
            kept = json.loads(self._read(f"registry/{name}"))
            times = {k: dt.datetime.fromisoformat(kept[k]) if kept[k] else None for k in ("next_run", "last_modified")}
            d = Dataset(**(kept | times), webhook=(webhooks or {}).get(kept["name"]))
            self.datasets[d.name] = d

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, name: str) -> str:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _keep(self, d: Dataset) -> None:
        """Write the data set's entry in the registry."""
        kept = {"name": d.name, "source": d.source, "polling_interval": d.polling_interval, "active": d.active, "next_run": d.next_run and d.next_run.isoformat(), "last_modified": d.last_modified and d.last_modified.isoformat(), "id": d.id}
        path, fs = self._path(f"registry/{d.name}.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(kept).encode()))
        out.close()

    def register(self, dataset: Dataset) -> Dataset:
        if not dataset.name or not dataset.source or dataset.polling_interval <= 0:
            raise ValueError("a data set needs a name, a source and a polling interval over 0")
        if dataset.name in self.datasets:
            raise ValueError(f"{dataset.name} is registered already")
        self.datasets[dataset.name] = dataset
        self._keep(dataset)
        return dataset

    def get(self, name: str) -> Dataset:
        return self.datasets[name]

    def remove(self, name: str | None = None) -> None:
        """Forget one data set or all; their tables stay."""
        for n in [name] if name else list(self.datasets):
            self.stop(n)
            del self.datasets[n]
            path, fs = self._path(f"registry/{n}.json")
            fs.delete(path, False)

    def store(self, name: str) -> S.VersionedStore:
        return S.VersionedStore(self.spark, f"{self.root}/{name}/store")

    def timings(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/timings").drop("at")

    def metrics(self, name: str, kind: str = "classes") -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{kind}").drop("at")

    def last_instant(self, name: str) -> dt.datetime | None:
        store = self.store(name)
        return S.latest_update(store.table()).first()[0] if store.exists() else None

    def apply(self, name: str, facts: DataFrame, t: dt.datetime) -> DataFrame:
        """One dump: delta, versioning, notification, metrics, timings."""
        delta, measured = version_step(self.store(name), facts, t)
        self._report(name, t, measured, delta)
        return delta

    def _report(self, name: str, t: dt.datetime, measured: dict, delta: DataFrame | None) -> None:
        """What follows a commit; may be done again."""
        dataset, table, at = self.datasets[name], self.store(name).table(), _folder(t)
        if dataset.webhook and delta is not None and (measured["insertions"] or measured["deletions"]):
            dataset.webhook(delta_event(delta, name, S.at(t), measured["time_versioning_ns"] // 1_000_000).first()[0])
        before = S.latest_update(table.filter(F.col("valid_from") < S.at(t)).withColumn("valid_until", F.when(F.col("valid_until") < S.at(t), F.col("valid_until")).otherwise(S.sentinel()))).first()[0]
        for kind, metric in (("classes", M.class_metrics), ("properties", M.property_metrics)):
            rows = metric(table, t, before).withColumn("dataset_id", F.lit(dataset.id)).withColumn("snapshot_ts", S.at(t)).withColumn("snapshot_ts_prev", S.at(before or t))
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/{kind}/{at}")
        append_timings(self.spark, f"{self.root}/{name}/timings/{at}", measured, "overwrite")
        dataset.last_modified, dataset.next_run = t, t + dt.timedelta(seconds=dataset.polling_interval)
        self._keep(dataset)

    def _make_up(self, name: str, t: dt.datetime) -> None:
        """Report the last commit if a crash kept that from happening; its times aren't known any more."""
        if _folder(t) not in self._names(f"{name}/timings"):
            table = self.store(name).table()
            first = table.filter(F.col("valid_from") < S.at(t)).isEmpty()
            counts = table.agg(F.sum((F.col("valid_from") == S.at(t)).cast("long")), F.sum((F.col("valid_until") == S.at(t)).cast("long"))).first()
            measured = dict.fromkeys(("time_prepare_ns", "time_delta_ns", "time_versioning_ns", "time_overall_ns"), 0)
            measured |= {"timestamp": t, "insertions": 0 if first else counts[0] or 0, "deletions": counts[1] or 0, "cnt_triples": S.snapshot_count(table, t).first()[0]}
            self._report(name, t, measured, None)

    def _batch(self, name: str):
        def take(batch: DataFrame, _: int) -> None:
            files = [r["file"] for r in batch.select(F.input_file_name().alias("file")).distinct().collect()]  # dumps that arrived since the last batch
            last = self.last_instant(name)
            dumps: dict[dt.datetime, list[str]] = {}
            for f in files:
                if stamp := stamp_of(f):
                    dumps.setdefault(stamp, []).append(unquote(f))
            for t, paths in sorted(dumps.items()):
                if last is None or t > last:
                    self.apply(name, facts_of(self.spark.read.text(paths)), t)  # reads this dump only
                    last = t
                elif t == last:
                    self._make_up(name, t)

        return take

    def run_due(self, now: dt.datetime | None = None) -> list[str]:
        """Take what has arrived for every active data set whose time has come, the longest due first, at most ``workers`` at once.  One that fails stops for good; the others go on."""
        now = now or S.instant(None)
        due = sorted((d for d in self.datasets.values() if d.active and (d.next_run is None or d.next_run <= now)), key=lambda d: d.next_run or dt.datetime.min)

        def one(d: Dataset) -> str | None:
            try:
                self.start(d.name, once=True)
            except Exception:
                d.active = False
                self._keep(d)
                return None
            if d.next_run is None or d.next_run <= now:  # nothing new
                d.next_run = now + dt.timedelta(seconds=d.polling_interval)
                self._keep(d)
            return d.name

        with ThreadPoolExecutor(self.workers) as pool:
            return [n for n in pool.map(one, due) if n]

    def start(self, name: str, once: bool = False):
        """Follow the landing folder; ``once`` takes what is there and ends.  An error stops the data set for good."""
        dataset = self.datasets[name]
        if not dataset.active:
            raise ValueError(f"{name} isn't active")
        stream = self.spark.readStream.text(dataset.source)
        writer = stream.writeStream.queryName(f"track-{name}-{uuid.uuid4().hex[:8]}").option("checkpointLocation", f"{self.root}/{name}/checkpoint").foreachBatch(self._batch(name))
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{dataset.polling_interval} seconds")
        query = self.queries[name] = writer.start()
        if once:
            try:
                query.awaitTermination()
            except Exception:
                dataset.active = False
                self._keep(dataset)
                raise
        return query

    def restart(self) -> None:
        """All active data sets that aren't followed, from their checkpoints."""
        for name, d in self.datasets.items():
            q = self.queries.get(name)
            if q is not None and q.exception() is not None:
                d.active = False
                self._keep(d)
            if d.active and (q is None or not q.isActive):
                self.start(name)

    def stop(self, name: str) -> None:
        q = self.queries.pop(name, None)
        if q is not None:
            q.stop()

    def deactivate(self, name: str) -> None:
        self.stop(name)
        self.datasets[name].active = False
        self._keep(self.datasets[name])


def rebuild(spark: SparkSession, store: S.VersionedStore, dumps: list[str], from_version: dt.datetime | None = None) -> list[dict]:
    """Replay archived dumps in the order of their instants, all or from one on (after undoing what came since)."""
    if from_version is not None and store.exists():
        store.commit(S.rollback_deletes(S.rollback_inserts(store.table(), from_version), from_version))
    out = []
    for t, path in sorted((stamp_of(p), p) for p in dumps if stamp_of(p)):
        if from_version is None or t >= from_version:
            out.append(version_step(store, facts_of(spark.read.text(path)), t)[1])
    return out


def changed_versions(timings: DataFrame) -> DataFrame:
    """The instants that changed something: those whose metrics are to be computed again."""
    return timings.filter((F.col("insertions") > 0) | (F.col("deletions") > 0)).select("timestamp")
