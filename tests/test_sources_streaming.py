import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kairograph.operators import store as S
from kairograph.sources import ntriples as N
from kairograph.sources.sinks import shown, write_csv
from kairograph.sources.turtle import read_turtle, triples_of
from kairograph.streaming.tracking import Dataset, Tracker, changed_versions, rebuild, stamp_of


def test_dirty_ntriples(spark, tmp_path):
    text = '# comment\n\n<urn:a> <urn:p> "x\\u0008y" .\n_:b1 <urn:p> _:b2 .\n<urn:a> <urn:p> "t\tab"^^<http://www.w3.org/2001/XMLSchema#string> .\n<urn:a> <urn:p> "no dot"\n<urn a> <urn:p> "bad" .\n<urn:a> <urn:p> "q\\"uote\\\\ \\n"@EN-us .\n<urn:a> <urn:p> "x\\u0008y" .\n'
    (tmp_path / "a.nt").write_text(text)
    got = {tuple(r) for r in N.read_ntriples(spark, str(tmp_path / "a.nt")).collect()}
    assert got == {("<urn:a>", "<urn:p>", '"xy"'), ("<_:b1>", "<urn:p>", "<_:b2>"), ("<urn:a>", "<urn:p>", '"t\tab"'), ("<urn:a>", "<urn:p>", '"q"uote\\ \n"@en-us')}
    lines = N.read_lines(spark, str(tmp_path / "a.nt"))
    r = N.preprocess_summary(lines).first()
    assert (r.skolemized_subjects, r.skolemized_objects, r.invalid_triples) == (1, 1, 2)
    back = spark.createDataFrame([("<urn:a>", "<urn:p>", '"q"uote\\ \n"@en')], "s string, p string, o string")
    line = back.select(N.to_line(F.col("s"), F.col("p"), F.col("o")).alias("line"))
    assert line.first()[0] == '<urn:a> <urn:p> "q\\"uote\\\\ \\n"@en .'
    assert N.parse(line).first()[2] == '"q"uote\\ \n"@en'


def test_quads(spark):
    df = spark.createDataFrame([('<urn:a> <urn:p> "1" <urn:g> .',), ("<urn:a> <urn:p> <urn:b> .",)], "line string")
    assert {tuple(r) for r in N.parse(df, quads=True).collect()} == {("<urn:a>", "<urn:p>", '"1"', "<urn:g>"), ("<urn:a>", "<urn:p>", "<urn:b>", None)}


def test_newest_archive():
    assert N.newest_archive(["a/20240101-000000_000.zip", "b/20240301-000000_001.zip", "x.zip"]) == "b/20240301-000000_001.zip"
    assert N.newest_archive([]) is None


def test_turtle(spark, tmp_path):
    text = '@prefix ex: <http://ex/> .\n@base <http://b/> .\nex:a a ex:C ; ex:p "1"@en , 2.5 , true ;\n  ex:q [ ex:r <x> ] .\n# end\n_:n ex:p ( ex:a ) .'
    got = set(triples_of(text))
    assert ("<http://ex/a>", "<http://ex/p>", '"2.5"^^<http://www.w3.org/2001/XMLSchema#decimal>') in got
    assert any(p == "<http://ex/r>" and o == "<http://b/x>" for _, p, o in got) and len(got) == 9
    (tmp_path / "a.ttl").write_text(text)
    assert {tuple(r) for r in read_turtle(spark, str(tmp_path / "a.ttl")).collect()} == got


def test_bounded_view_and_csv(spark, tmp_path):
    df = spark.range(5).select(F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('"')).alias("x"))
    assert shown(df, 3)[1] and not shown(df, 5)[1]
    write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 5


def dump(folder, stamp, facts):
    (folder / f"set_{stamp}.nt").write_text("".join(f"<urn:{s}> <urn:p> \"{o}\" .\n" for s, o in facts))


def test_tracker(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    heard = []
    tracker = Tracker(spark, str(tmp_path / "tracked"))
    tracker.register(Dataset("set", str(landing), webhook=heard.append))
    with pytest.raises(ValueError):
        tracker.register(Dataset("set", str(landing)))
    with pytest.raises(ValueError):
        tracker.register(Dataset("", "x"))
    dump(landing, "20240101-000000_000", [("a", 1), ("b", 1)])
    dump(landing, "20240102-000000_500", [("a", 1), ("b", 2)])
    tracker.start("set", once=True)
    dump(landing, "20240103-000000_000", [("b", 2), ("c", 1)])
    tracker.start("set", once=True)
    tracker.start("set", once=True)  # nothing new
    store = tracker.store("set")
    at = lambda *d: sorted((r.s, r.o) for r in S.snapshot(store.table(), dt.datetime(*d)).collect())
    assert at(2024, 1, 1) == [("<urn:a>", '"1"'), ("<urn:b>", '"1"')]
    assert at(2024, 1, 2, 12) == [("<urn:a>", '"1"'), ("<urn:b>", '"2"')]
    assert at(2024, 1, 4) == [("<urn:b>", '"2"'), ("<urn:c>", '"1"')]
    log = tracker.timings("set").orderBy("timestamp").collect()
    assert [(r.insertions, r.deletions, r.cnt_triples) for r in log] == [(0, 0, 2), (1, 1, 2), (1, 1, 2)]
    assert [json.loads(x)["total_insertions"] for x in heard] == [1, 1]
    assert changed_versions(tracker.timings("set")).count() == 2
    fresh = S.VersionedStore(spark, str(tmp_path / "fresh"))
    rebuild(spark, fresh, [str(p) for p in landing.iterdir()])
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(fresh.table()) == key(store.table())
    rebuild(spark, fresh, [str(p) for p in landing.iterdir()], dt.datetime(2024, 1, 2))
    assert key(fresh.table()) == key(store.table())
    tracker.deactivate("set")
    with pytest.raises(ValueError):
        tracker.start("set")
    tracker.remove()
    assert not tracker.datasets


def test_tracker_goes_on_after_a_restart(spark, tmp_path):
    from kairograph.streaming.feed import SUBJECT, put_dump

    landing, root = str(tmp_path / "feed"), str(tmp_path / "tracked")
    heard, t = [], dt.datetime(2024, 1, 1)
    first = Tracker(spark, root)
    first.register(Dataset("feed", landing, polling_interval=60, webhook=heard.append))
    first.register(Dataset("off", landing, active=False))
    put_dump(spark, landing, t, 100)
    assert first.run_due(t) == ["feed"]
    again = Tracker(spark, root, {"feed": heard.append})
    assert again.get("feed").id == first.get("feed").id and again.get("feed").next_run == t + dt.timedelta(seconds=60) and not again.get("off").active
    assert again.run_due(t + dt.timedelta(seconds=30)) == []  # not due
    put_dump(spark, landing, t + dt.timedelta(seconds=60), 101)
    assert again.run_due(t + dt.timedelta(seconds=61)) == ["feed"]
    assert [(r.insertions, r.deletions, r.cnt_triples) for r in again.timings("feed").orderBy("timestamp").collect()] == [(0, 0, 4), (1, 1, 4)]
    assert [json.loads(x)["total_insertions"] for x in heard] == [1]
    # a crash after the commit: the timings are made up for, and nothing is done twice
    import shutil

    kept = sorted(map(tuple, again.store("feed").table().collect()), key=repr)
    shutil.rmtree(next((tmp_path / "tracked" / "feed" / "timings").glob("at=20240101000100*")))
    shutil.rmtree(tmp_path / "tracked" / "feed" / "checkpoint")
    third = Tracker(spark, root)
    third.start("feed", once=True)
    assert [(r.insertions, r.deletions, r.cnt_triples) for r in third.timings("feed").orderBy("timestamp").collect()] == [(0, 0, 4), (1, 1, 4)]
    assert sorted(map(tuple, third.store("feed").table().collect()), key=repr) == kept
    assert third.metrics("feed", "properties").select("snapshot_ts").distinct().count() <= 2
    now = {r.p: r.o for r in S.snapshot(third.store("feed").table(), dt.datetime(2024, 1, 2)).collect() if r.s == SUBJECT}
    assert len(now) == 4 and now["<urn:feed:population>"].startswith('"101"')


def test_a_data_set_that_fails_stops_alone(spark, tmp_path):
    landing = tmp_path / "good"
    landing.mkdir()
    dump(landing, "20240101-000000_000", [("a", 1)])
    tracker = Tracker(spark, str(tmp_path / "tracked"), workers=2)
    tracker.register(Dataset("bad", str(tmp_path / "missing")))
    tracker.register(Dataset("good", str(landing)))
    assert tracker.run_due() == ["good"]
    assert not Tracker(spark, str(tmp_path / "tracked")).get("bad").active


def test_fallback_to_the_newest_archive(spark, tmp_path):
    import zipfile

    from pyspark.errors import PySparkException

    from kairograph.sources.ntriples import read_dump

    archives = tmp_path / "archives"
    archives.mkdir()
    for stamp, o in (("20240101-000000_000", 1), ("20240301-000000_000", 3), ("20240201-000000_000", 2)):
        with zipfile.ZipFile(archives / f"{stamp}.zip", "w") as z:
            z.writestr("dump.nt", f'<urn:a> <urn:p> "{o}" .\n# comment\n')
    got = [r.value for r in read_dump(spark, str(tmp_path / "no.nt"), str(archives)).collect()]
    assert got == ['<urn:a> <urn:p> "3" .', "# comment"]
    (tmp_path / "yes.nt").write_text('<urn:b> <urn:p> "1" .\n')
    assert read_dump(spark, str(tmp_path / "yes.nt"), str(archives)).count() == 1
    with pytest.raises(PySparkException):
        read_dump(spark, str(tmp_path / "no.nt"))


def test_normalising(spark):
    from kairograph.sources.ntriples import normalise

    lines = {
        r'"a\u0009b\u000Cc\u001fd\u007fe\u00a0f\u2028g\u2029h\u000Ai" .': r'"abcdefgh\u000Ai" .',
        r'"x\fy\bz\'w\\fv" .': r'"xyzw\\fv" .',
        "\"a\tb\"^^<http://www.w3.org/2001/XMLSchema#string> .": r'"a\tb" .',
    }
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r.line: r.out for r in df.select("line", normalise(df["line"]).alias("out")).collect()} == lines


def test_stamp():
    assert stamp_of("a/b_20240102-030405_678.raw.nt") == dt.datetime(2024, 1, 2, 3, 4, 5, 678000) and stamp_of("x.nt") is None
