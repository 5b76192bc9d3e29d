import datetime as dt

import pytest

from kairograph.engine import TripleStoreEngine, timestamp_query
from kairograph.exceptions import ConcurrentWrite, ExpressionNotCovered, StoreNotFound, UnknownMode, WrongInputFormat
from kairograph.operators import store as S

EX = {"ex": "http://ex/"}
T0, T1, T2 = (dt.datetime(2024, m, 1) for m in (1, 2, 3))
P = "PREFIX ex: <http://ex/> "


def engine(spark, **more):
    return TripleStoreEngine(spark, table=spark.createDataFrame([], S.SCHEMA), **more)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lifecycle(spark, tmp_path):
    e = TripleStoreEngine(spark, str(tmp_path / "store"))
    with pytest.raises(StoreNotFound):
        e.table()
    e.version_all_triples(T0, spark.createDataFrame([("<http://ex/a>", "<http://ex/p>", '"1"'), ("<http://ex/a>", "<http://ex/p>", '"1"')], "s string, p string, o string"))
    e.insert(["<http://ex/b> <http://ex/p> \"2\" .", ("ex:c", "ex:p", '"3"')], EX, T1)
    e.update([["<http://ex/b>", "<http://ex/p>", '"2"']], [[None, None, '"22"']], timestamp=T2)
    e.outdate([("ex:c", "ex:p", '"3"')], EX, T2)
    query = P + "SELECT ?s ?o { ?s ex:p ?o }"
    assert rows(e.query(query, T0)) == [("<http://ex/a>", '"1"')]
    assert rows(e.query(query, T1)) == [("<http://ex/a>", '"1"'), ("<http://ex/b>", '"2"'), ("<http://ex/c>", '"3"')]
    assert rows(e.query(query, T2)) == [("<http://ex/a>", '"1"'), ("<http://ex/b>", '"22"')]
    assert e.count_triples(T1) == 3
    assert rows(e.retrieve_snapshot(T0).select("line")) == [('<http://ex/a> <http://ex/p> "1" .',)]
    e.rollback(T2)
    assert rows(e.query(query, T2)) == rows(e.query(query, T1))


def test_interval_edges(spark):
    e = engine(spark)
    e.insert([("ex:a", "ex:p", '"1"')], EX, T0)
    e.outdate([("ex:a", "ex:p", '"1"')], EX, T1)
    assert e.query(P + "SELECT * { ?s ?p ?o }", T0).count() == 1  # visible at its start
    assert e.query(P + "SELECT * { ?s ?p ?o }", T1).count() == 0  # not at its end
    e.insert([("ex:a", "ex:p", '"1"')], EX, T2)
    e.outdate([("ex:a", "ex:p", '"1"')], EX, T2)  # an empty interval is never visible
    assert e.query(P + "SELECT * { ?s ?p ?o }", T2).count() == 0
    e.outdate([("ex:missing", "ex:p", '"1"')], EX, T2)
    assert e.table().count() == 2


def test_duplicates_collapse_only_in_decorator_mode(spark):
    for mode, n in (("decorator", 1), ("reification", 2)):
        e = engine(spark, mode=mode)
        for _ in range(2):
            e.insert([("ex:a", "ex:p", '"1"')], EX, T0)
        assert e.table().count() == n
    e = engine(spark)
    e.insert([("ex:a", "ex:p", '"1"')], EX, T0)
    e.insert([("ex:a", "ex:p", '"1"')], EX, T1)
    assert e.table().count() == 2
    e.insert([("ex:a", "ex:p", '"1"')], EX, T2, dedupe=True)
    assert e.table().count() == 2


def test_update_without_a_change_does_nothing(spark):
    e = engine(spark)
    e.insert([("ex:a", "ex:p", '"1"@en')], EX, T0)
    e.update([["<http://ex/a>", "<http://ex/p>", '"1"@en']], [[None, None, '"1"@de']], timestamp=T1)
    assert e.table().count() == 1
    e.update([["<http://ex/a>", "<http://ex/p>", '"1"@en']], [[None, None, '"1"@de']], timestamp=T1, whole_terms=True)
    assert e.table().count() == 2


def test_wrong_input(spark):
    e = engine(spark)
    with pytest.raises(WrongInputFormat):
        e.insert([("ex:a", "ex:p")], EX)
    with pytest.raises(WrongInputFormat):
        e.update([["<urn:a>", "<urn:p>", '"1"']], [])
    with pytest.raises(WrongInputFormat):
        e.insert(["nonsense"])
    with pytest.raises(UnknownMode):
        engine(spark, mode="other")
    given = ["<urn:a> <urn:p> <urn:b> ."]
    e.insert(given, timestamp=T0)
    assert given == ["<urn:a> <urn:p> <urn:b> ."]
    e.insert([])
    assert e.table().count() == 1


def test_plain_paths_are_refused_on_request(spark):
    e = engine(spark, paths="plain")
    e.insert([("ex:a", "ex:p", "ex:b"), ("ex:b", "ex:p", "ex:c")], EX, T0)
    assert rows(e.query(P + "SELECT ?x { ex:a ex:p/ex:p ?x }", T1)) == [("<http://ex/c>",)]
    for path in ("ex:p|ex:q", "!ex:p", "ex:p?", "ex:p*", "ex:p+"):
        with pytest.raises(ExpressionNotCovered):
            e.query(P + f"SELECT ?x {{ ex:a {path} ?x }}", T1)


def test_timestamped_query_is_cut_to_milliseconds():
    q, t = timestamp_query("SELECT * { ?s ?p ?o }", dt.datetime(2024, 1, 1, 0, 0, 0, 123999))
    assert t.microsecond == 123000 and "123" in str(q)


def test_rollup_of_deep_and_of_cyclic_hierarchies(spark):
    from kairograph.operators.timeseries import rollup

    chain = [(f"n{k}", f"n{k + 1}" if k < 66 else None, 1) for k in range(67)]
    got = {r.node: r.amount for r in rollup(spark.createDataFrame(chain, "node string, parent string, amount long"), ["amount"]).collect()}
    assert got == {f"n{k}": k + 1 for k in range(67)} | {"ROOT": 67}
    for rows in ([("c", "a", 1), ("a", "b", 1), ("b", "a", 1)], [("a", "b", 1), ("b", "c", 1), ("c", "a", 1)]):
        with pytest.raises(WrongInputFormat):
            rollup(spark.createDataFrame(rows, "node string, parent string, amount long"), ["amount"])
    assert {r.node: r.amount for r in rollup(spark.createDataFrame([("a", "a", 1), ("b", "a", 2)], "node string, parent string, amount long"), ["amount"]).collect()} == {"a": 3, "b": 2}


def facts(spark, n, o="1"):
    return spark.createDataFrame([(f"<urn:{k}>", "<urn:p>", f'"{o}"') for k in range(n)], "s string, p string, o string")


def folders(state):
    return {f for f in [*state["closed"], *(x for fs in state["open"].values() for x in fs)]}


def test_commits_write_what_changes(spark, tmp_path):
    store = S.VersionedStore(spark, str(tmp_path / "store"), buckets=4)
    e = TripleStoreEngine(spark, str(tmp_path / "store"))
    e.store.buckets = 4
    e.version_all_triples(T0, facts(spark, 200))
    first = store.state()[1]
    e.insert([("<urn:new>", "<urn:p>", '"1"')], None, T1)
    second = store.state()[1]
    added = folders(second) - folders(first)
    assert folders(first) <= folders(second) and store._read(sorted(added)).count() == 1  # one row for one fact
    e.outdate([("<urn:7>", "<urn:p>", '"1"')], None, T2)
    third = store.state()[1]
    rewritten = folders(second) - folders(third)
    assert {f.partition("bucket=")[2] for f in rewritten} == {f.partition("bucket=")[2] for f in folders(third) - folders(second)} - {"-1"}
    assert len({f.partition("bucket=")[2] for f in rewritten}) == 1  # the bucket of the fact only
    assert store._read(third["closed"]).count() == 1
    before = rows(store.table())
    assert len(before) == 201 and e.count_triples(T2) == 200 and rows(store.table(2)) != before
    store.compact()
    assert rows(store.table()) == before
    assert store.vacuum(keep=1) > 0 and rows(store.table()) == before
    e.outdate([("<urn:none>", "<urn:p>", '"1"')], None, T2)
    assert rows(store.table()) == before


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = (S.VersionedStore(spark, str(tmp_path / "store"), buckets=2) for _ in range(2))
    a.commit(S.version_all(facts(spark, 3), T0))
    start = b._last()
    a.change(facts(spark, 1), None, T1)
    seen = rows(a.table())
    monkeypatch.setattr(b, "_last", lambda: start)  # b began before a was done
    with pytest.raises(ConcurrentWrite):
        b.change(None, S.new_rows(a.table(), facts(spark, 2, "9").selectExpr("cast(null as string) as g", "*"), T1), T1)
    assert rows(a.table()) == seen
    (tmp_path / "store" / "commits" / f"{3:010d}").write_text('{"closed": [')  # a writer that died
    assert rows(S.VersionedStore(spark, str(tmp_path / "store")).table()) == seen
    a.change(None, S.new_rows(a.table(), facts(spark, 1, "5").selectExpr("cast(null as string) as g", "*"), T2), T2)
    assert a.commits()[-1] == 4 and a.table().count() == len(seen) + 1


def test_graphs(spark, tmp_path):
    e = TripleStoreEngine(spark, str(tmp_path / "store"))
    e.version_all_triples(T0, facts(spark, 2))
    e.import_graph(facts(spark, 3, "g"), "<urn:g>", T1)
    assert e.query("SELECT * { GRAPH <urn:g> { ?s ?p ?o } }", T1).count() == 3
    e.dump(str(tmp_path / "dump"))
    assert spark.read.text(str(tmp_path / "dump")).count() == 5
    e.drop_graph("<urn:g>")
    assert e.table().count() == 2
    e.drop_graph(None)
    assert e.table().count() == 0


def test_newer_versions_in_the_default_graph(spark):
    later = dt.datetime(2024, 2, 10)
    table = spark.createDataFrame([(g, "<a>", "<p>", '"1"', T0, S.SENTINEL) for g in (None, "<g>")] + [(None, "<a>", "<p>", '"1"', T1, later), ("<g>", "<a>", "<p>", '"1"', T1, later)], S.SCHEMA)
    # the open row is superseded by one that has ended since, in either graph
    assert S.snapshot_without_newer(table, T2).count() == 0 and S.snapshot(table, T2).count() == 2


def test_update_in_memory_and_on_disk_agree(spark, tmp_path):
    start = S.version_all(facts(spark, 20), T0).withColumn("g", S.F.lit(None).cast("string")).select(*S.COLUMNS)
    old = [["<urn:3>", "<urn:p>", '"1"'], ["<urn:4>", "<urn:p>", '"1"'], ["<urn:5>", "<urn:p>", '"1"'], ["<urn:no>", "<urn:p>", '"1"']]
    new = [[None, None, '"2"'], [None, None, None], ["<urn:55>", None, None], [None, None, '"2"']]
    memory, disk = TripleStoreEngine(spark, table=start), TripleStoreEngine(spark, str(tmp_path / "store"))
    disk.store.commit(start)
    for e in (memory, disk):
        e.update(old, new, timestamp=T1)
    got = sorted((tuple(r) for r in disk.table().collect()), key=repr)
    assert got == sorted((tuple(r) for r in memory.table().collect()), key=repr) and len(got) == 22
