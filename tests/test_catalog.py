"""Queries of the catalogue against the same queries in SQL, on the smallest tables."""

import datetime
import decimal
import os

import pytest

from kairograph import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind here; the whole catalogue is compared by the driver.
NAMES = [
    "version_all", "insert_rows", "update_rows", "outdate_rows", "rollback_deletes", "snapshot_no_newer", "delta_indicator", "changesets_consecutive", "cb_replay_version",
    "intervals_from_copies", "intervals_from_changesets", "tb_query_by_graph", "optional_filter", "minus_shared", "exists_in_expression", "values_undef", "subselect", "path_negated",
    "path_plus", "agg_sum", "agg_group_concat", "fn_if_coalesce", "fn_string_around", "nt_parse", "nt_validate_counts", "class_metrics", "bear_snapshot_metrics", "bear_change_ratios",
    "timeseries_week", "timeseries_net_bars", "hierarchy_rollup", "quartiles_outliers", "stream_replay_state",
    "store_change", "template_pattern", "cb_query_graph_version", "bear_ratios_twice", "snapshot_no_newer_in_graph", "fn_interval_text", "fn_hash", "fn_hash_sha1", "fn_hash_long", "fn_display", "fn_uri_encode", "fn_string_case", "fn_datetime_cast", "nt_lines_out", "missing_days", "reified_lines", "nt_read_files",
    "turtle_read_files", "metrics_delete", "rebuild_state", "tracked_timings", "property_metrics",
]


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return ("f", round(float(v), 6))
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_time_filter_reaches_the_scan(spark, tmp_path):
    from kairograph import views as V
    from kairograph.operators import store as S

    store = S.VersionedStore(spark, str(tmp_path / "store"))
    store.commit(V.v_or(spark, SF))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = S.snapshot(store.table(), V.T_OR)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(valid_from" in plan and "GreaterThan(valid_until" in plan


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "kairograph", tmp_path / "kairograph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path).returncode == 0
    # the other tests don't need it either
    shutil.copytree(root / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import pytest, sys; sys.exit(pytest.main(['-q', '--collect-only', 'tests', '-p', 'no:cacheprovider']))"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True).returncode == 0
    named = [p for p in (tmp_path / "tests").glob("*.py") if "kairograph.llm" in p.read_text().replace('"kairograph.llm"', "")]
    assert not named
