"""Every operator as a query over the driver's tables, with the same query in SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph import views as V
from kairograph.functions import terms as T
from kairograph.operators import delta as D
from kairograph.operators import metrics as M
from kairograph.operators import store as S
from kairograph.operators import timeseries as TS
from kairograph.operators import variants as X
from kairograph.plans.sparql.compiler import Compiler
from kairograph.plans.sparql.parser import parse
from kairograph.sources import ntriples as N
from kairograph.views import EX, SQL, T_DIM, T_EV, T_OR, ts
from kairograph.views import sql_integer as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PREFIX = f"PREFIX ex: <{EX}> PREFIX c: <{EX}class/> "


def entry(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, uses: str = "") -> None:
    QUERIES[name] = run
    if sql is not None:
        ctes = [SQL[u] if u in SQL else u for u in uses.split()] if uses else []
        ORACLE[name] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql


def sparql(name: str, view: Callable, t: dt.datetime, query: str, sql: str | None = None, uses: str = "", services: bool = False) -> None:
    """A time-travel query on a view at an instant."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = view(spark, sf_dir).filter(S.valid_at(t)).select("g", "s", "p", "o")
        remote = {f"{EX}remote": V.v_dim(spark, sf_dir).select("s", "p", "o")} if services else {}
        return Compiler(spark, facts, remote, dt.datetime(2024, 6, 1, 12, 30, 15, 250000)).run(parse(PREFIX + query))

    entry(name, run, sql, uses)


EV = f"(SELECT * FROM ev WHERE vf <= {ts(T_EV)} AND vu > {ts(T_EV)}) f"
OR = f"(SELECT * FROM ord WHERE vf <= {ts(T_OR)} AND vu > {ts(T_OR)}) f"
LABEL = f"<{T.RDFS}label>"


def b(x: str) -> str:
    return f"""(CASE WHEN {x} THEN '"true"' ELSE '"false"' END || '^^<{T.XSD}boolean>')"""


# --- writes (W)
U0, U1 = dt.datetime(1997, 1, 1), dt.datetime(1999, 6, 1)
entry("version_all", lambda s, d: S.version_all(V.v_or(s, d).select("s", "p", "o"), U0), f"SELECT DISTINCT s, p, o, {ts(U0)} AS valid_from, {V.SENT} AS valid_until FROM ord", "ord")


def _new_facts(spark, d):
    c = V.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return c.select(F.lit(None).cast("string").alias("g"), V._iri("customer/", F.col("c_custkey")).alias("s"), F.lit(f"<{EX}segment>").alias("p"), F.concat(F.lit('"'), "c_mktsegment", F.lit('"')).alias("o"))


_BASE = "SELECT s, p, o, vf AS valid_from, vu AS valid_until FROM ord"
entry("insert_rows", lambda s, d: S.insert(V.v_or(s, d), _new_facts(s, d), U0).drop("g"), f"""{_BASE} UNION ALL SELECT DISTINCT '<{EX}customer/' || c_custkey || '>', '<{EX}segment>', '"' || c_mktsegment || '"', {ts(U0)}, {V.SENT} FROM customer WHERE c_mktsegment = 'BUILDING'""", "ord")
_SEGMENT = f"s IN (SELECT '<{EX}customer/' || c_custkey || '>' FROM customer WHERE c_mktsegment = 'BUILDING')"


def _of_segment(spark, d, status="O"):
    return _new_facts(spark, d).select("s", F.lit(f"<{EX}orderStatus>").alias("p"), F.lit(f'"{status}"').alias("o"))


entry("outdate_rows", lambda s, d: S.outdate(V.v_or(s, d), _of_segment(s, d), U1).drop("g"), f"""SELECT s, p, o, vf AS valid_from, CASE WHEN vu = {V.SENT} AND o = '"O"' AND {_SEGMENT} THEN {ts(U1)} ELSE vu END AS valid_until FROM ord""", "ord")


def _changes(spark, d):
    t = _of_segment(spark, d)
    none = F.lit(None).cast("string")
    return t.select(F.col("s").alias("old_s"), F.col("p").alias("old_p"), F.col("o").alias("old_o"), none.alias("new_s"), none.alias("new_p"), F.lit('"X"').alias("new_o"))


entry("update_rows", lambda s, d: S.update(V.v_or(s, d), _changes(s, d), U1).drop("g"), f"""SELECT s, p, o, vf AS valid_from, CASE WHEN vu = {V.SENT} AND o = '"O"' AND {_SEGMENT} THEN {ts(U1)} ELSE vu END AS valid_until FROM ord UNION ALL SELECT DISTINCT s, p, '"X"', {ts(U1)}, {V.SENT} FROM ord WHERE vu = {V.SENT} AND o = '"O"' AND {_SEGMENT}""", "ord")


def _stored_change(spark, d):
    """One commit on disk that closes facts and opens others, read back."""
    import uuid

    from kairograph.operators.storage import shared_dir

    store = S.VersionedStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.commit(V.v_or(spark, d))
    store.change(_of_segment(spark, d), S.new_rows(store.table(), _new_facts(spark, d), U1), U1)
    return store.table().drop("g")


entry("store_change", _stored_change, f"""SELECT s, p, o, vf AS valid_from, CASE WHEN vu = {V.SENT} AND o = '"O"' AND {_SEGMENT} THEN {ts(U1)} ELSE vu END AS valid_until FROM ord UNION ALL SELECT DISTINCT '<{EX}customer/' || c_custkey || '>', '<{EX}segment>', '"' || c_mktsegment || '"', {ts(U1)}, {V.SENT} FROM customer WHERE c_mktsegment = 'BUILDING'""", "ord")
entry("rollback_inserts", lambda s, d: S.rollback_inserts(V.v_or(s, d), U1).drop("g"), f"{_BASE} WHERE vf < {ts(U1)}", "ord")
entry("rollback_deletes", lambda s, d: S.rollback_deletes(V.v_or(s, d), U1).drop("g"), f"SELECT s, p, o, vf AS valid_from, CASE WHEN vu >= {ts(U1)} THEN {V.SENT} ELSE vu END AS valid_until FROM ord", "ord")

# --- time travel (T)
entry("snapshot_at", lambda s, d: S.snapshot(V.v_or(s, d), T_OR).drop("g"), f"SELECT DISTINCT s, p, o FROM {OR}", "ord")
entry("snapshot_latest", lambda s, d: S.snapshot(V.v_or(s, d), dt.datetime(2030, 1, 1)).drop("g"), f"SELECT DISTINCT s, p, o FROM ord WHERE vu = {V.SENT}", "ord")
entry("snapshot_no_newer", lambda s, d: S.snapshot_without_newer(V.v_or(s, d).drop("g"), T_OR), f"SELECT DISTINCT s, p, o FROM {OR} WHERE NOT EXISTS (SELECT 1 FROM ord n WHERE n.s = f.s AND n.p = f.p AND n.o = f.o AND n.vf > f.vf AND n.vf <= {ts(T_OR)})", "ord")
_NEWER = "NOT EXISTS (SELECT 1 FROM {0} n WHERE n.s = f.s AND n.p = f.p AND n.o = f.o AND n.vf > f.vf AND n.vf <= {1})"
entry("snapshot_no_newer_in_graph", lambda s, d: S.snapshot_without_newer(V.v_or(s, d).unionByName(V.v_ev(s, d)), T_EV), f"SELECT DISTINCT CAST(NULL AS VARCHAR) AS g, s, p, o FROM ord f WHERE vf <= {ts(T_EV)} AND vu > {ts(T_EV)} AND {_NEWER.format('ord', ts(T_EV))} UNION ALL SELECT DISTINCT '<{EX}events>', s, p, o FROM {EV} WHERE {_NEWER.format('ev', ts(T_EV))}", "ord ev")
entry("snapshot_count", lambda s, d: S.snapshot_count(V.v_or(s, d), T_OR), f"SELECT COUNT(*) AS triples FROM {OR}", "ord")
entry("creation_timestamps", lambda s, d: S.creation_timestamps(V.v_or(s, d)), "SELECT DISTINCT vf AS valid_from FROM ord", "ord")
entry("latest_update_ts", lambda s, d: S.latest_update(V.v_or(s, d)), f"SELECT GREATEST(MAX(vf), MAX(CASE WHEN vu < {V.SENT} THEN vu END)) AS latest FROM ord", "ord")
entry("asof_snapshot_stats", lambda s, d: S.as_of(V.table(s, d, "orders").groupBy(F.col("o_orderdate").alias("snapshot_ts"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "snapshot_ts", S.at(T_OR)), f"SELECT o_orderdate AS snapshot_ts, o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderdate = (SELECT MAX(o_orderdate) FROM orders WHERE o_orderdate <= {ts(T_OR)}) GROUP BY ALL")
entry("ic_query_version", lambda s, d: X.query_copies(V.copies(s, d), 2), "SELECT s, p, o FROM copies WHERE version = 2", "ord copies")
_LISTS = "SELECT s, p, o, STRING_AGG(CAST(version AS VARCHAR), '_' ORDER BY version) AS versions FROM copies GROUP BY s, p, o"
entry("tb_query_version", lambda s, d: X.query_lists(X.version_lists(V.copies(s, d)), 2), "SELECT s, p, o FROM copies WHERE version = 2", "ord copies")
entry("tb_query_by_graph", lambda s, d: X.query_lists_by_graph(X.version_lists(V.copies(s, d)), 2), f"SELECT '<{X.TB_GRAPH}' || l.versions || '>' AS graph, l.s, l.p, l.o FROM ({_LISTS}) l WHERE '_' || l.versions || '_' LIKE '%\\_2\\_%' ESCAPE '\\'", "ord copies")
_CHANGES = "(" + " UNION ALL ".join(f"SELECT {k} AS v_from, {k + 1} AS v_to, '{op}' AS op, s, p, o FROM (SELECT s, p, o FROM copies WHERE version = {a} EXCEPT SELECT s, p, o FROM copies WHERE version = {z}) x{k}{op}" for k in range(4) for op, a, z in (("add", k + 1, k), ("delete", k, k + 1))) + ")"
entry("changesets_consecutive", lambda s, d: D.change_sets(V.copies(s, d), 0, 4), f"SELECT * FROM {_CHANGES} x", "ord copies")


def _replayed(s, d):
    c = V.copies(s, d)
    return D.replay(c.filter("version = 0"), D.change_sets(c, 0, 4), 3)


entry("cb_replay_version", _replayed, "SELECT s, p, o FROM copies WHERE version = 3", "ord copies")



def _template(s, d):
    from kairograph.plans.sparql.templates import versioned_text

    facts = V.v_dim(s, d).filter(S.valid_at(T_DIM)).select("g", "s", "p", "o")
    return Compiler(s, facts).run(parse(versioned_text(PREFIX + "?n ex:partOf ?r . ?r rdfs:label ?l", 3)))


entry("template_pattern", _template, f"SELECT a.s AS n, a.o AS r, l.o AS l FROM dim a JOIN dim l ON l.s = a.o WHERE a.p = '<{EX}partOf>' AND l.p = '{LABEL}'", "dim")


def _chain_query(s, d):
    c = V.copies(s, d)
    graphs = D.chain_graphs(c.filter("version = 0"), D.change_sets(c, 0, 4), [2, 3])
    return Compiler(s, graphs).run(parse(PREFIX + "SELECT ?s { GRAPH <version:3> { ?s ex:orderStatus 'O' } MINUS { GRAPH <version:2> { ?s ex:orderStatus 'O' } } }"))


entry("cb_query_graph_version", _chain_query, "SELECT s FROM copies WHERE version = 3 AND o = '\"O\"' AND s NOT IN (SELECT s FROM copies WHERE version = 2 AND o = '\"O\"')", "ord copies")

# --- deltas and variants (D)
_C = lambda k: f"SELECT s, p, o FROM copies WHERE version = {k}"
entry("delta_insertions", lambda s, d: D.insertions(V.copies(s, d).filter("version = 1"), V.copies(s, d).filter("version = 2")), f"{_C(2)} EXCEPT {_C(1)}", "ord copies")
entry("delta_deletions", lambda s, d: D.deletions(V.copies(s, d).filter("version = 1"), V.copies(s, d).filter("version = 2")), f"{_C(1)} EXCEPT {_C(2)}", "ord copies")
_BOTH = f"SELECT 'add' AS op, * FROM ({_C(2)} EXCEPT {_C(1)}) a UNION ALL SELECT 'delete' AS op, * FROM ({_C(1)} EXCEPT {_C(2)}) b"
entry("delta_anti_joins", lambda s, d: D.anti_delta(V.copies(s, d).filter("version = 1"), V.copies(s, d).filter("version = 2")), _BOTH, "ord copies")
entry("delta_indicator", lambda s, d: D.indicator_delta(V.copies(s, d).filter("version = 1"), V.copies(s, d).filter("version = 2")), _BOTH, "ord copies")


def _pair(s, d):
    c = V.copies(s, d)
    return c.filter("version = 1"), c.filter("version = 2")


entry("delta_strategies_agree", lambda s, d: D.counts_agree(D.anti_delta(*_pair(s, d)), D.indicator_delta(*_pair(s, d))), f"SELECT op, COUNT(*) AS n_a, COUNT(*) AS n_b, TRUE AS agree FROM ({_BOTH}) x GROUP BY op", "ord copies")
entry("delta_file_lines", lambda s, d: D.delta_lines(D.indicator_delta(*_pair(s, d))), f"SELECT CASE WHEN op = 'delete' THEN '- ' ELSE '+ ' END || s || ' ' || p || ' ' || o || ' .' AS value FROM ({_BOTH}) x", "ord copies")
entry("changeset_consistency", lambda s, d: D.consistency(V.copies(s, d), D.change_sets(V.copies(s, d), 0, 4)), f"""SELECT x.v_from, x.v_to, SUM(CASE WHEN op = 'add' THEN 1 ELSE 0 END)::BIGINT AS added, SUM(CASE WHEN op = 'delete' THEN 1 ELSE 0 END)::BIGINT AS deleted, (SELECT COUNT(*) FROM copies c WHERE c.version = x.v_from) AS "before", (SELECT COUNT(*) FROM copies c WHERE c.version = x.v_to) AS "after", TRUE AS consistent FROM {_CHANGES} x GROUP BY x.v_from, x.v_to""", "ord copies")
_RUNS = "(SELECT s, p, o, MIN(version) AS a, MAX(version) AS z FROM (SELECT *, version - ROW_NUMBER() OVER (PARTITION BY s, p, o ORDER BY version) AS run FROM copies) r GROUP BY s, p, o, run)"
_ORIGIN = ts(X.ORIGIN)
_INTERVALS = f"SELECT s, p, o, {_ORIGIN} + a * INTERVAL 1 SECOND AS valid_from, CASE WHEN z = 4 THEN {V.SENT} ELSE {_ORIGIN} + (z + 1) * INTERVAL 1 SECOND END AS valid_until FROM {_RUNS} x"
entry("intervals_from_copies", lambda s, d: X.intervals(V.copies(s, d), 4), _INTERVALS, "ord copies")
entry("intervals_from_changesets", lambda s, d: X.intervals_from_changes(V.copies(s, d).filter("version = 0"), D.change_sets(V.copies(s, d), 0, 4)), _INTERVALS, "ord copies")
entry("tb_version_lists", lambda s, d: X.version_lists(V.copies(s, d)).select("s", "p", "o", F.array_join(F.col("versions").cast("array<string>"), "_").alias("versions")), _LISTS, "ord copies")
entry("icng_lines", lambda s, d: X.copies_trig(V.copies(s, d)), f"SELECT 'GRAPH <{X.IC_GRAPH}' || version || '> {{ ' || s || ' ' || p || ' ' || o || ' . }}' AS value FROM copies", "ord copies")
entry("star_lines", lambda s, d: X.star_lines(X.intervals(V.copies(s, d), 4)), f"""SELECT '<< << ' || s || ' ' || p || ' ' || o || ' >> <{T.VERS}valid_from> "' || STRFTIME(valid_from, '%Y-%m-%dT%H:%M:%S.000+00:00') || '"^^<{T.XSD}dateTime> >> <{T.VERS}valid_until> "' || STRFTIME(valid_until, '%Y-%m-%dT%H:%M:%S.000+00:00') || '"^^<{T.XSD}dateTime> .' AS value FROM ({_INTERVALS}) i""", "ord copies")
entry("tb_quads", lambda s, d: X.list_quads(X.version_lists(V.copies(s, d))), f"""SELECT s || ' ' || p || ' ' || o || ' <{X.TB_GRAPH}' || versions || '> .' AS value FROM ({_LISTS}) l UNION ALL SELECT DISTINCT '<{X.TB_GRAPH}' || l.versions || '> <{T.OWL}versionInfo> "' || c.version || '"^^<{T.XSD}integer> <{X.VERSION_GRAPH}> .' FROM ({_LISTS}) l JOIN copies c ON c.s = l.s AND c.p = l.p AND c.o = l.o""", "ord copies")

_STAMPED = lambda c: f"""'"' || STRFTIME({c}, '%Y-%m-%dT%H:%M:%S.000+00:00') || '"^^<{T.XSD}dateTime>'"""
entry("reified_lines", lambda s, d: X.reified_lines(X.intervals(V.copies(s, d), 4)), f"""SELECT '_:b' || MD5(s || ' ' || p || ' ' || o || ' ' || STRFTIME(valid_from, '%Y%m%d%H%M%S000')) || ' rdf:reifies << ' || s || ' ' || p || ' ' || o || ' >> ; <{T.VERS}valid_from> ' || {_STAMPED('valid_from')} || ' ; <{T.VERS}valid_until> ' || {_STAMPED('valid_until')} || ' .' AS value FROM ({_INTERVALS}) i""", "ord copies")

# --- graph patterns (G)
sparql("bgp_single", V.v_ev, T_EV, "SELECT * { ?s ?p ?o }", f"SELECT s, p, o FROM {EV}", "ev")
sparql("bgp_star", V.v_dim, T_DIM, "SELECT ?c ?n ?seg { ?c ex:partOf ?n ; ex:segment ?seg }", f"SELECT a.s AS c, a.o AS n, b.o AS seg FROM dim a JOIN dim b ON a.s = b.s WHERE a.p = '<{EX}partOf>' AND b.p = '<{EX}segment>'", "dim")
sparql("bgp_chain", V.v_dim, T_DIM, "SELECT ?c ?r ?l { ?c ex:segment ?g . ?c ex:partOf ?n . ?n ex:partOf ?r . ?r rdfs:label ?l }", f"SELECT a.s AS c, n.o AS r, l.o AS l FROM dim g JOIN dim a ON a.s = g.s JOIN dim n ON n.s = a.o JOIN dim l ON l.s = n.o WHERE g.p = '<{EX}segment>' AND a.p = '<{EX}partOf>' AND n.p = '<{EX}partOf>' AND l.p = '{LABEL}'", "dim")
sparql("bgp_ground", V.v_dim, T_DIM, "SELECT ?l { <urn:ex:nation/0> ex:partOf <urn:ex:region/0> . <urn:ex:region/0> rdfs:label ?l }", f"SELECT l.o AS l FROM dim a, dim l WHERE a.s = '<{EX}nation/0>' AND a.p = '<{EX}partOf>' AND a.o = '<{EX}region/0>' AND l.s = '<{EX}region/0>' AND l.p = '{LABEL}'", "dim")
sparql("bgp_repeated_variable", V.v_dim, T_DIM, "SELECT (COUNT(*) AS ?n) { ?x ?p ?x }", f"SELECT {I('COUNT(*)')} AS n FROM dim WHERE s = o", "dim")
sparql("group_join", V.v_dim, T_DIM, "SELECT ?c ?n ?l { ?c ex:partOf ?n . { ?n rdfs:label ?l } }", f"SELECT a.s AS c, a.o AS n, l.o AS l FROM dim a JOIN dim l ON l.s = a.o WHERE a.p = '<{EX}partOf>' AND l.p = '{LABEL}'", "dim")
sparql("optional_left", V.v_doc, T_DIM, "SELECT ?d ?t ?q { ?d ex:title ?t OPTIONAL { ?d ex:quality ?q } }", f"SELECT d.s AS d, d.title || '@' || d.lang AS t, {I('q.quality')} AS q FROM doc d LEFT JOIN labels q ON d.s = '<{EX}doc/' || q.doc_id || '>'", "doc")
sparql("optional_filter", V.v_doc, T_DIM, "SELECT ?d ?q { ?d ex:title ?t OPTIONAL { ?d ex:quality ?q FILTER(?q > 0 && LANG(?t) = 'en') } }", f"SELECT d.s AS d, {I('q.quality')} AS q FROM doc d LEFT JOIN labels q ON d.s = '<{EX}doc/' || q.doc_id || '>' AND q.quality > 0 AND d.lang = 'en'", "doc")
sparql("union_patterns", V.v_dim, T_DIM, "SELECT ?x ?n ?m { { ?x ex:partOf ?n } UNION { ?x ex:basedIn ?m } }", f"SELECT s AS x, o AS n, NULL AS m FROM dim WHERE p = '<{EX}partOf>' UNION ALL SELECT s, NULL, o FROM dim WHERE p = '<{EX}basedIn>'", "dim")
sparql("minus_shared", V.v_doc, T_DIM, "SELECT ?d { ?d ex:title ?t MINUS { ?d ex:quality ?q } }", f"SELECT s AS d FROM doc WHERE s NOT IN (SELECT '<{EX}doc/' || doc_id || '>' FROM labels)", "doc")
sparql("minus_disjoint", V.v_dim, T_DIM, "SELECT ?x { ?x ex:basedIn ?n MINUS { ?a ex:segment ?b } }", f"SELECT s AS x FROM dim WHERE p = '<{EX}basedIn>'", "dim")
sparql("filter_rows", V.v_ev, T_EV, "SELECT ?s ?o { ?s ex:purchase ?o FILTER(?o > 1000 && ?o < 5000) }", f"SELECT s, o FROM {EV} WHERE p = '<{EX}purchase>' AND v > 1000 AND v < 5000", "ev")
sparql("exists_semi", V.v_doc, T_DIM, "SELECT ?d { ?d ex:title ?t FILTER EXISTS { ?d ex:quality ?q } }", f"SELECT s AS d FROM doc WHERE s IN (SELECT '<{EX}doc/' || doc_id || '>' FROM labels)", "doc")
sparql("not_exists_anti", V.v_dim, T_DIM, "SELECT ?n { ?n ex:partOf ?r FILTER NOT EXISTS { ?c ex:partOf ?n } }", f"SELECT s AS n FROM dim a WHERE p = '<{EX}partOf>' AND NOT EXISTS (SELECT 1 FROM dim b WHERE b.p = '<{EX}partOf>' AND b.o = a.s)", "dim")
sparql("exists_in_expression", V.v_doc, T_DIM, "SELECT ?d { ?d ex:title ?t FILTER(EXISTS { ?d ex:quality ?q } || LANG(?t) = 'fr') }", f"SELECT s AS d FROM doc WHERE lang = 'fr' OR s IN (SELECT '<{EX}doc/' || doc_id || '>' FROM labels)", "doc")
sparql("bind_extend", V.v_ev, T_EV, "SELECT ?s ?half { ?s ex:view ?o BIND(FLOOR(?o / 2) AS ?h) BIND(xsd:integer(?h) AS ?half) }", f"SELECT s, {I('FLOOR(v / 2.0)')} AS half FROM {EV} WHERE p = '<{EX}view>'", "ev")
sparql("bind_in_union", V.v_dim, T_DIM, "SELECT ?x ?kind { { ?x ex:basedIn ?n BIND('supplier' AS ?kind) } UNION { ?x ex:segment ?n BIND('customer' AS ?kind) } }", f"""SELECT s AS x, '"supplier"' AS kind FROM dim WHERE p = '<{EX}basedIn>' UNION ALL SELECT s, '"customer"' FROM dim WHERE p = '<{EX}segment>'""", "dim")
sparql("values_undef", V.v_dim, T_DIM, "SELECT ?x ?n ?tag { VALUES (?x ?n ?tag) { (UNDEF <urn:ex:nation/3> 'n') (<urn:ex:nation/1> UNDEF 'x') } ?x ex:partOf ?n }", f"""SELECT s AS x, o AS n, '"n"' AS tag FROM dim WHERE p = '<{EX}partOf>' AND o = '<{EX}nation/3>' UNION ALL SELECT s, o, '"x"' FROM dim WHERE p = '<{EX}partOf>' AND s = '<{EX}nation/1>'""", "dim")
sparql("subselect", V.v_dim, T_DIM, "SELECT ?n ?k ?r { { SELECT ?n (COUNT(?c) AS ?k) { ?c ex:partOf ?n } GROUP BY ?n } ?n ex:partOf ?r }", f"SELECT x.n, {I('x.k')} AS k, d.o AS r FROM (SELECT o AS n, COUNT(*) AS k FROM dim WHERE p = '<{EX}partOf>' GROUP BY o) x JOIN dim d ON d.s = x.n AND d.p = '<{EX}partOf>'", "dim")
sparql("graph_named", V.v_ev, T_EV, "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", f"SELECT '<{EX}events>' AS g, {I('COUNT(*)')} AS n FROM {EV}", "ev")
sparql("graph_default_nil", V.v_dim, T_DIM, "SELECT ?s FROM NAMED <http://www.openrdf.org/schema/sesame#nil> { GRAPH <http://www.openrdf.org/schema/sesame#nil> { ?s ex:basedIn ?n } }", f"SELECT s FROM dim WHERE p = '<{EX}basedIn>'", "dim")
sparql("service_table", V.v_ev, T_EV, "SELECT ?r ?l { SERVICE <urn:ex:remote> { ?r rdfs:label ?l . ?n ex:partOf ?r } }", f"SELECT l.s AS r, l.o AS l FROM dim l JOIN dim n ON n.o = l.s WHERE l.p = '{LABEL}' AND n.p = '<{EX}partOf>'", "dim", services=True)
sparql("ask_pattern", V.v_dim, T_DIM, "ASK { ?x ex:basedIn ?n }", f"SELECT COUNT(*) > 0 AS ask FROM dim WHERE p = '<{EX}basedIn>'", "dim")
sparql("construct_triples", V.v_dim, T_DIM, "CONSTRUCT { ?r ex:contains ?n } WHERE { ?n ex:partOf ?r . ?n rdfs:label ?l }", f"SELECT DISTINCT a.o AS s, '<{EX}contains>' AS p, a.s AS o FROM dim a JOIN dim l ON a.s = l.s WHERE a.p = '<{EX}partOf>' AND l.p = '{LABEL}'", "dim")

# --- property paths (P)
_PART = f"(SELECT s, o FROM dim WHERE p = '<{EX}partOf>')"
sparql("path_sequence", V.v_dim, T_DIM, "SELECT ?a ?b { ?a ex:partOf/ex:partOf ?b }", f"SELECT x.s AS a, y.o AS b FROM {_PART} x JOIN {_PART} y ON x.o = y.s", "dim")
sparql("path_inverse", V.v_dim, T_DIM, "SELECT ?a ?b { ?a ^ex:partOf/rdfs:label ?b }", f"SELECT x.o AS a, l.o AS b FROM {_PART} x JOIN dim l ON l.s = x.s WHERE l.p = '{LABEL}'", "dim")
sparql("path_alternative", V.v_dim, T_DIM, "SELECT ?a ?b { ?a ex:partOf|ex:basedIn ?b }", f"SELECT s AS a, o AS b FROM dim WHERE p IN ('<{EX}partOf>', '<{EX}basedIn>')", "dim")
sparql("path_negated", V.v_dim, T_DIM, "SELECT ?a ?b { ?a !(ex:partOf|ex:segment|ex:balance|^ex:basedIn) ?b }", f"SELECT s AS a, o AS b FROM dim WHERE p NOT IN ('<{EX}partOf>', '<{EX}segment>', '<{EX}balance>') UNION ALL SELECT o, s FROM dim WHERE p <> '<{EX}basedIn>'", "dim")
sparql("path_zero_or_one", V.v_dim, T_DIM, "SELECT ?a ?b { ?a ex:basedIn/ex:partOf? ?b }", f"SELECT s AS a, o AS b FROM dim WHERE p = '<{EX}basedIn>' UNION ALL SELECT x.s, y.o FROM dim x JOIN {_PART} y ON x.o = y.s WHERE x.p = '<{EX}basedIn>'", "dim")
sparql("path_plus", V.v_dim, T_DIM, "SELECT ?a ?b { ?a ex:partOf+ ?b }", f"WITH RECURSIVE {SQL['dim']}, r AS (SELECT s, o FROM dim WHERE p = '<{EX}partOf>' UNION SELECT r.s, d.o FROM r JOIN dim d ON d.s = r.o AND d.p = '<{EX}partOf>') SELECT s AS a, o AS b FROM r")
sparql("path_star", V.v_dim, T_DIM, "SELECT ?b { <urn:ex:customer/7> ex:partOf* ?b }", f"WITH RECURSIVE {SQL['dim']}, r AS (SELECT '<{EX}customer/7>' AS o UNION SELECT d.o FROM r JOIN dim d ON d.s = r.o AND d.p = '<{EX}partOf>') SELECT o AS b FROM r")

# --- aggregates and modifiers (A)
_EVG = "FROM " + EV
sparql("agg_count", V.v_ev, T_EV, "SELECT ?p (COUNT(*) AS ?c) (SUM(?o) AS ?v) { ?s ?p ?o } GROUP BY ?p", f"SELECT p, {I('COUNT(*)')} AS c, {I('SUM(v)')} AS v {_EVG} GROUP BY p", "ev")
sparql("agg_count_distinct", V.v_ev, T_EV, "SELECT (COUNT(DISTINCT ?s) AS ?n) (COUNT(?s) AS ?m) { ?s ?p ?o }", f"SELECT {I('COUNT(DISTINCT s)')} AS n, {I('COUNT(s)')} AS m {_EVG}", "ev")
sparql("agg_sum", V.v_ev, T_EV, "SELECT ?s (SUM(?o) AS ?t) (SUM(?s) AS ?bad) { ?s ?p ?o } GROUP BY ?s", f"SELECT s, {I('SUM(v)')} AS t, CAST(NULL AS VARCHAR) AS bad {_EVG} GROUP BY s", "ev")


def _avg(s, d):
    facts = V.v_ev(s, d).filter(S.valid_at(T_EV)).select("g", "s", "p", "o")
    out = Compiler(s, facts).run(parse(PREFIX + "SELECT ?p (AVG(?o) AS ?a) { ?s ?p ?o } GROUP BY ?p"))
    return out.select("p", F.round(T.num(F.col("a")), 4).alias("a"))


entry("agg_avg", _avg, f"SELECT p, ROUND(AVG(v), 4) AS a {_EVG} GROUP BY p", "ev")
sparql("agg_min_max", V.v_ev, T_EV, "SELECT ?p (MIN(?o) AS ?a) (MAX(?o) AS ?b) (MAX(?s) AS ?c) { ?s ?p ?o } GROUP BY ?p", f"SELECT p, {I('MIN(v)')} AS a, {I('MAX(v)')} AS b, MAX(s) AS c {_EVG} GROUP BY p", "ev")
sparql("agg_sample", V.v_ev, T_EV, "SELECT ?p (SAMPLE(?s) AS ?a) { ?s ?p ?o } GROUP BY ?p", f"SELECT p, MIN(s) AS a {_EVG} GROUP BY p", "ev")
sparql("agg_group_concat", V.v_dim, T_DIM, "SELECT ?r (GROUP_CONCAT(?l; SEPARATOR='|') AS ?all) { ?n ex:partOf ?r . ?n rdfs:label ?l } GROUP BY ?r", f"""SELECT a.o AS r, '"' || STRING_AGG(REPLACE(l.o, '"', ''), '|' ORDER BY l.o) || '"' AS "all" FROM dim a JOIN dim l ON a.s = l.s WHERE a.p = '<{EX}partOf>' AND l.p = '{LABEL}' GROUP BY a.o""", "dim")
sparql("agg_having", V.v_ev, T_EV, "SELECT ?s (SUM(?o) AS ?t) { ?s ?p ?o } GROUP BY ?s HAVING(SUM(?o) > 30000)", f"SELECT s, {I('SUM(v)')} AS t {_EVG} GROUP BY s HAVING SUM(v) > 30000", "ev")
sparql("agg_empty", V.v_ev, T_EV, "SELECT (COUNT(?o) AS ?n) (SUM(?o) AS ?t) (MIN(?o) AS ?m) { ?s ex:nothing ?o }", f"SELECT {I('0')} AS n, {I('0')} AS t, CAST(NULL AS VARCHAR) AS m")
sparql("projection_rename", V.v_dim, T_DIM, "SELECT (?n AS ?nation) ?r { ?n ex:partOf ?r . ?n rdfs:label ?l }", f"SELECT a.s AS nation, a.o AS r FROM dim a JOIN dim l ON a.s = l.s WHERE a.p = '<{EX}partOf>' AND l.p = '{LABEL}'", "dim")
sparql("distinct_rows", V.v_ev, T_EV, "SELECT DISTINCT ?p { ?s ?p ?o }", f"SELECT DISTINCT p {_EVG}", "ev")
sparql("reduced_rows", V.v_dim, T_DIM, "SELECT REDUCED ?n { ?x ex:partOf ?n }", f"SELECT DISTINCT o AS n FROM dim WHERE p = '<{EX}partOf>'", "dim")
sparql("order_limit", V.v_ev, T_EV, "SELECT ?s ?p ?o { ?s ?p ?o } ORDER BY DESC(?o) ?s ?p LIMIT 20", f"SELECT s, p, o {_EVG} ORDER BY v DESC, s, p LIMIT 20", "ev")
sparql("slice_offset", V.v_dim, T_DIM, "SELECT ?s { ?s ex:basedIn ?n } ORDER BY ?s LIMIT 10 OFFSET 5", f"SELECT s FROM dim WHERE p = '<{EX}basedIn>' ORDER BY s LIMIT 10 OFFSET 5", "dim")
sparql("topk", V.v_ev, T_EV, "SELECT ?s (SUM(?o) AS ?t) { ?s ?p ?o } GROUP BY ?s ORDER BY DESC(?t) ?s LIMIT 5", f"SELECT s, {I('SUM(v)')} AS t {_EVG} GROUP BY s ORDER BY SUM(v) DESC, s LIMIT 5", "ev")

# --- functions (F)
_TITLES = "SELECT ?d ?x { ?d ex:title ?t BIND(%s AS ?x) }"


def title(name: str, expression: str, sql: str) -> None:
    sparql(name, V.v_doc, T_DIM, _TITLES % expression, f"SELECT s AS d, {sql} AS x FROM doc", "doc")


_T = "txt"
Q = lambda x: f"""('"' || {x} || '"')"""
QL = lambda x: f"""('"' || {x} || '"@' || lang)"""
sparql("fn_arith", V.v_ev, T_EV, "SELECT ?s (?o * 2 - 5 + 3 AS ?x) (?o / 0 AS ?bad) { ?s ex:view ?o }", f"SELECT s, {I('v * 2 - 5 + 3')} AS x, CAST(NULL AS VARCHAR) AS bad {_EVG} WHERE p = '<{EX}view>'", "ev")
sparql("fn_logic", V.v_ev, T_EV, "SELECT ?s { ?s ex:view ?o FILTER((?o > 2000 || 1 = 2) && !(?o > 8000)) }", f"SELECT s {_EVG} WHERE p = '<{EX}view>' AND v > 2000 AND NOT v > 8000", "ev")
sparql("fn_compare", V.v_ev, T_EV, "SELECT ?s (?o >= 3000 AS ?a) (?o != 10 AS ?b) (?s = <urn:ex:user/1> AS ?c) { ?s ex:view ?o }", f"SELECT s, {b('v >= 3000')} AS a, {b('v <> 10')} AS b, {b(f's = $$<{EX}user/1>$$')} AS c {_EVG} WHERE p = '<{EX}view>'", "ev")
sparql("fn_ebv", V.v_doc, T_DIM, "SELECT ?d { ?d ex:quality ?q FILTER(?q || ?q) }", f"SELECT '<{EX}doc/' || doc_id || '>' AS d FROM labels WHERE quality <> 0")
sparql("fn_if_coalesce", V.v_ev, T_EV, "SELECT ?bucket (COUNT(?bucket) AS ?n) { SELECT (COALESCE(IF(?o > 5000, '> 5000', IF(?o > 1000, '> 1000', 1/0)), '< 1000') AS ?bucket) { ?s ?p ?o } } GROUP BY ?bucket", f"""SELECT bucket, {I('COUNT(*)')} AS n FROM (SELECT CASE WHEN v > 5000 THEN '"> 5000"' WHEN v > 1000 THEN '"> 1000"' ELSE '"< 1000"' END AS bucket {_EVG}) x GROUP BY bucket""", "ev")
sparql("fn_bound_in", V.v_doc, T_DIM, "SELECT ?d { ?d ex:title ?t OPTIONAL { ?d ex:quality ?q } FILTER(BOUND(?q) && LANG(?t) IN ('fr', 'de')) }", f"SELECT d.s AS d FROM doc d JOIN labels q ON d.s = '<{EX}doc/' || q.doc_id || '>' WHERE d.lang IN ('fr', 'de')", "doc")
sparql("fn_numeric", V.v_dim, T_DIM, "SELECT ?c (ABS(?b) AS ?a) (xsd:integer(ROUND(?b / 100)) AS ?r) (xsd:integer(CEIL(?b / 100)) AS ?u) (xsd:integer(FLOOR(?b / 100)) AS ?l) { ?c ex:balance ?b }", f"SELECT '<{EX}customer/' || c_custkey || '>' AS c, {I('ABS(FLOOR(c_acctbal))')} AS a, {I('FLOOR(FLOOR(c_acctbal) / 100 + 0.5)')} AS r, {I('CEIL(FLOOR(c_acctbal) / 100)')} AS u, {I('FLOOR(FLOOR(c_acctbal) / 100)')} AS l FROM customer")
title("fn_string_case", "UCASE(?t)", QL(f"UPPER(REPLACE({_T}, 'ß', 'SS'))"))
title("fn_string_length", "STRLEN(?t)", I(f"LENGTH({_T})"))
title("fn_string_sub", "SUBSTR(STR(?t), 2, 5)", Q(f"SUBSTRING({_T}, 2, 5)"))
title("fn_string_tests", "STRSTARTS(?t, 'A') || STRENDS(?t, 'e') || CONTAINS(?t, 'he')", b(f"{_T} LIKE 'A%' OR {_T} LIKE '%e' OR {_T} LIKE '%he%'"))
title("fn_string_around", "CONCAT(STRBEFORE(STR(?t), ' '), '+', STRAFTER(STR(?t), ' '))", Q(f"CASE WHEN STRPOS({_T}, ' ') > 0 THEN SUBSTRING({_T}, 1, STRPOS({_T}, ' ') - 1) || '+' || SUBSTRING({_T}, STRPOS({_T}, ' ') + 1) ELSE '+' END"))
title("fn_uri_encode", "ENCODE_FOR_URI(STR(?t))", Q(f"URL_ENCODE({_T})"))
title("fn_regex", "REGEX(STR(?t), '^[a-m]', 'i')", b(f"REGEXP_MATCHES({_T}, '^[a-mA-M]')"))
title("fn_replace", "REPLACE(STR(?t), '[aeiou]', '_')", Q(f"REGEXP_REPLACE({_T}, '[aeiou]', '_', 'g')"))
title("fn_lang", "LANG(?t)", Q("lang"))
title("fn_lang_matches", "LANGMATCHES(LANG(?t), 'EN')", b("lang = 'en'"))
title("fn_terms", "STRDT(LANG(?t), <urn:ex:tag>)", f"""('"' || lang || '"^^<{EX}tag>')""")
title("fn_term_tests", "isLiteral(?t) && isIRI(?d) && !isBlank(?d) && !isNumeric(?t)", b("TRUE"))
title("fn_datatype_iri", "CONCAT(STR(DATATYPE(?t)), STR(IRI(CONCAT('urn:ex:', LANG(?t)))))", Q(f"'{T.RDF}langString' || '{EX}' || lang"))
title("fn_hash", "CONCAT(MD5(STR(?t)), SHA256(STR(?t)))", Q(f"MD5({_T}) || SHA256({_T})"))
title("fn_hash_sha1", "SHA1(STR(?t))", Q(f"SHA1({_T})"))
# SQL has no SHA-384 and SHA-512; these are the published digests of the text abc
_ABC = ("cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7", "ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f")
sparql("fn_hash_long", V.v_dim, T_DIM, "SELECT ?s (SHA384('abc') AS ?x) (SHA512('abc') AS ?y) { ?s ex:basedIn ?n }", f"""SELECT s, '"{_ABC[0]}"' AS x, '"{_ABC[1]}"' AS y FROM dim WHERE p = '<{EX}basedIn>'""", "dim")
sparql("fn_datetime_cast", V.v_ev, T_EV, "SELECT ?s (YEAR(xsd:dateTime('2024-03-05T06:07:08Z')) AS ?y) (xsd:dateTime(STR(?s)) AS ?bad) { ?s ex:view ?o }", f"SELECT s, {I('2024')} AS y, CAST(NULL AS VARCHAR) AS bad {_EVG} WHERE p = '<{EX}view>'", "ev")
sparql("fn_datetime", V.v_or, T_OR, "SELECT ?n ?y ?z { ?s ?p ?o BIND(NOW() AS ?n) BIND(YEAR(NOW()) * 100 + MONTH(NOW()) AS ?y) BIND(TZ(NOW()) AS ?z) } LIMIT 1", f"""SELECT '"2024-06-01T12:30:15.250"^^<{T.XSD}dateTime>' AS n, {I('202406')} AS y, '"Z"' AS z""")


def _stamps(s, d):
    e = V.table(s, d, "events").select("event_id", "ts")
    term = T.datetime(F.col("ts"))
    return e.select("event_id", T.format_instant(F.col("ts")).alias("iso"), T.file_stamp(F.col("ts")).alias("stamp"), (T.parse_file_stamp(T.file_stamp(F.col("ts"))) == F.date_trunc("millisecond", "ts").cast("timestamp_ntz")).alias("parses"), (T.timestamp(term) <= F.col("ts")).alias("cut"))


entry("fn_timestamps", _stamps, "SELECT event_id, STRFTIME(ts, '%Y-%m-%dT%H:%M:%S.%g') AS iso, STRFTIME(ts, '%Y%m%d-%H%M%S_%g') AS stamp, TRUE AS parses, TRUE AS cut FROM events")
_CLOCK = "PRINTF('%02d:%02d:%02d', (n % 86400) // 3600, (n % 3600) // 60, n % 60)"
entry("fn_interval_text", lambda s, d: V.table(s, d, "part").select("p_partkey", T.interval_text(F.col("p_partkey") * F.col("p_size") * 7).alias("text")), f"SELECT p_partkey, CASE WHEN n < 60 THEN n || ' seconds' WHEN n < 3600 THEN (n // 60) || ' minutes ' || (n % 60) || ' seconds' WHEN n < 86400 THEN {_CLOCK} ELSE (n // 86400) || ' days, ' || {_CLOCK} END AS text FROM (SELECT p_partkey, p_partkey * p_size * 7 AS n FROM part) x")
entry("fn_display", lambda s, d: V.v_doc(s, d).filter(F.col("p") == f"<{EX}title>").select(T.display(F.col("s")).alias("s"), T.display(F.col("o")).alias("o"), T.display_with_type(F.col("o")).alias("v")), "SELECT s, quote || txt || quote || '@' || lang AS o, txt AS v FROM (SELECT *, CASE WHEN CONTAINS(txt, CHR(10)) OR (CONTAINS(txt, CHR(34)) AND CONTAINS(txt, CHR(39))) THEN REPEAT(CHR(34), 3) WHEN CONTAINS(txt, CHR(34)) THEN CHR(39) ELSE CHR(34) END AS quote FROM doc) q", "doc")

# --- sources (IO)


def _lines(s, d):
    """N-Triples lines with flaws, made of the customers: blank nodes, control escapes, typed strings, missing dots."""
    c = V.table(s, d, "customer")
    k = F.col("c_custkey")
    subject = F.when(k % 5 == 0, F.concat(F.lit("_:c"), k.cast("string"))).otherwise(F.concat(F.lit(f"<{EX}customer/"), k.cast("string"), F.lit(">")))
    obj = F.when(k % 7 == 0, F.concat(F.lit("_:n"), F.col("c_nationkey").cast("string"))).when(k % 3 == 0, F.concat(F.lit('"'), "c_mktsegment", F.lit(f'"^^<{T.XSD}string>'))).otherwise(F.concat(F.lit('"a\\u0008'), "c_mktsegment", F.lit('"@EN')))
    return c.select((k % 4).cast("string").alias("file"), F.concat(subject, F.lit(f" <{EX}p> "), obj, F.when(k % 11 == 0, "").otherwise(" .")).alias("line"))


_NT = f"""nt AS (SELECT CAST(c_custkey % 4 AS VARCHAR) AS file, c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN '_:c' || c_custkey ELSE '<{EX}customer/' || c_custkey || '>' END AS subj, CASE WHEN c_custkey % 7 = 0 THEN '_:n' || c_nationkey WHEN c_custkey % 3 = 0 THEN '"' || c_mktsegment || '"' ELSE '"a' || c_mktsegment || '"@EN' END AS obj FROM customer)"""
SQL["nt"] = _NT
_SK = "CASE WHEN {0} LIKE '\\_:%' ESCAPE '\\' THEN '<' || {0} || '>' ELSE {0} END"
entry("nt_normalize", lambda s, d: _lines(s, d).select(N.normalise(F.col("line")).alias("line")), f"SELECT subj || ' <{EX}p> ' || obj || CASE WHEN k % 11 = 0 THEN '' ELSE ' .' END AS line FROM nt", "nt")
entry("nt_skolemize", lambda s, d: _lines(s, d).select(N.skolemise_object(N.skolemise_subject(N.normalise(F.col("line")))).alias("line")), f"SELECT {_SK.format('subj')} || ' <{EX}p> ' || CASE WHEN k % 11 = 0 THEN obj ELSE {_SK.format('obj')} || ' .' END AS line FROM nt", "nt")
entry("nt_parse", lambda s, d: N.parse(_lines(s, d).select(N.skolemise_object(N.skolemise_subject(N.normalise(F.col("line")))).alias("line"))), f"SELECT {_SK.format('subj')} AS s, '<{EX}p>' AS p, REPLACE({_SK.format('obj')}, '@EN', '@en') AS o FROM nt WHERE k % 11 <> 0", "nt")
entry("nt_validate_counts", lambda s, d: N.preprocess_summary(_lines(s, d).select("file", N.normalise(F.col("line")).alias("line"))), "SELECT file, COUNT(*) FILTER (k % 5 = 0) AS skolemized_subjects, COUNT(*) FILTER (k % 7 = 0 AND k % 11 <> 0) AS skolemized_objects, COUNT(*) FILTER (k % 11 = 0) AS invalid_triples FROM nt GROUP BY file", "nt")
entry("nt_commented", lambda s, d: _lines(s, d).select(N.commented(N.normalise(F.col("line"))).alias("line")), f"SELECT CASE WHEN k % 11 = 0 THEN '# ' ELSE '' END || subj || ' <{EX}p> ' || obj || CASE WHEN k % 11 = 0 THEN '' ELSE ' .' END AS line FROM nt", "nt")
_ESCAPED = "txt"
for _code, _letter in ((92, "CHR(92)"), (34, "CHR(34)"), (10, "'n'"), (13, "'r'"), (9, "'t'")):
    _ESCAPED = f"REPLACE({_ESCAPED}, CHR({_code}), CHR(92) || {_letter})"
entry("nt_lines_out", lambda s, d: V.v_doc(s, d).select(N.to_line(F.col("s"), F.col("p"), F.col("o")).alias("line")), f"SELECT s || ' <{EX}title> ' || {Q(_ESCAPED)} || '@' || lang || ' .' AS line FROM doc UNION ALL SELECT '<{EX}doc/' || doc_id || '> <{EX}quality> ' || {I('quality')} || ' .' FROM labels", "doc")


def _file(s, d, lines: DataFrame, label: str) -> str:
    """``lines`` as text files in the shared folder."""
    import uuid

    from kairograph.operators.storage import shared_dir
    from kairograph.sources.sinks import write_lines

    path = f"{shared_dir(s)}/{label}-{uuid.uuid4().hex}"
    write_lines(lines, path)
    return path


entry("nt_read_files", lambda s, d: N.read_ntriples(s, _file(s, d, _lines(s, d).select(F.col("line").alias("value")), "lines")), f"SELECT DISTINCT {_SK.format('subj')} AS s, '<{EX}p>' AS p, REPLACE({_SK.format('obj')}, '@EN', '@en') AS o FROM nt WHERE k % 11 <> 0", "nt")


def _turtle(s, d):
    """The dimension facts as Turtle files with their own prefixes, read back."""
    from kairograph.sources.turtle import read_turtle

    n = V.table(s, d, "nation")
    block = F.concat(F.lit("n:"), F.col("n_nationkey").cast("string"), F.lit(" ex:partOf r:"), F.col("n_regionkey").cast("string"), F.lit(' ;\n  rdfs:label "'), "n_name", F.lit('", "'), F.lower("n_name"), F.lit('"@EN .'))
    head = f"@prefix ex: <{EX}> .\n@prefix n: <{EX}nation/> .\nPREFIX r: <{EX}region/>\n@prefix rdfs: <{T.RDFS}> .\n"
    text = n.groupBy((F.col("n_nationkey") % 3).alias("k")).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(block)), "\n")).alias("value")).select("value")
    return read_turtle(s, _file(s, d, text.repartition(3), "turtle"))


entry("turtle_read_files", _turtle, f"""SELECT '<{EX}nation/' || n_nationkey || '>' AS s, '<{EX}partOf>' AS p, '<{EX}region/' || n_regionkey || '>' AS o FROM nation
    UNION SELECT '<{EX}nation/' || n_nationkey || '>', '{LABEL}', '"' || n_name || '"' FROM nation UNION SELECT '<{EX}nation/' || n_nationkey || '>', '{LABEL}', '"' || LOWER(n_name) || '"@en' FROM nation""")
entry("invalid_line_ratio", lambda s, d: M.invalid_ratio(N.preprocess_summary(_lines(s, d)).withColumn("lines", F.lit(1)).join(_lines(s, d).groupBy("file").agg(F.count(F.lit(1)).alias("n")), "file").withColumn("lines", F.col("n"))).select(F.round("ratio", 6).alias("ratio")), "SELECT ROUND(COUNT(*) FILTER (k % 11 = 0) / COUNT(*), 6) AS ratio FROM nt", "nt")

# --- metrics (M)
M1, M0 = dt.datetime(1999, 1, 1), dt.datetime(1997, 1, 1)
_NOW, _OLD = (f"(SELECT DISTINCT s, o FROM typed WHERE vf <= {ts(t)} AND vu > {ts(t)})" for t in (M1, M0))
entry("class_metrics", lambda s, d: M.class_metrics(V.v_typed(s, d), M1, M0), f"""SELECT c.thing, '"status ' || c.k || '"' AS label, '<{EX}class/Order>' AS parent,
    (SELECT COUNT(*) FROM {_NOW} n WHERE n.o = c.thing) AS current, (SELECT COUNT(*) FROM {_OLD} n WHERE n.o = c.thing) AS previous,
    (SELECT COUNT(*) FROM (SELECT * FROM {_NOW} a EXCEPT SELECT * FROM {_OLD} b) n WHERE n.o = c.thing) AS added, (SELECT COUNT(*) FROM (SELECT * FROM {_OLD} a EXCEPT SELECT * FROM {_NOW} b) n WHERE n.o = c.thing) AS deleted
    FROM (SELECT DISTINCT o_orderstatus AS k, '<{EX}class/' || o_orderstatus || '>' AS thing FROM orders) c""", "typed")


def _with_property(s, d):
    v = V.v_or(s, d)
    meta = s.createDataFrame([(None, f"<{EX}orderStatus>", M.TYPE, M.PROPERTIES[0]), (None, f"<{EX}orderStatus>", M.LABEL, '"order status"')], "g string, s string, p string, o string")
    return v.unionByName(meta.withColumn("valid_from", S.at(dt.datetime(1990, 1, 1))).withColumn("valid_until", S.sentinel()))


_PN, _PO = (f"(SELECT DISTINCT s, o FROM ord WHERE vf <= {ts(t)} AND vu > {ts(t)})" for t in (M1, M0))
entry("property_metrics", lambda s, d: M.property_metrics(_with_property(s, d), M1, M0), f"""SELECT '<{EX}orderStatus>' AS thing, '"order status"' AS label, CAST(NULL AS VARCHAR) AS parent, (SELECT COUNT(*) FROM {_PN} n) AS current, (SELECT COUNT(*) FROM {_PO} n) AS previous, (SELECT COUNT(*) FROM (SELECT * FROM {_PN} a EXCEPT SELECT * FROM {_PO} b) x) AS added, (SELECT COUNT(*) FROM (SELECT * FROM {_PO} a EXCEPT SELECT * FROM {_PN} b) x) AS deleted""", "ord")
entry("static_core_open", lambda s, d: M.static_core_open(V.v_or(s, d)), f"SELECT COUNT(*) AS triples FROM ord WHERE vu = {V.SENT} AND vf = (SELECT MIN(vf) FROM ord)", "ord")
entry("version_oblivious", lambda s, d: M.version_oblivious(V.v_or(s, d)), "SELECT COUNT(*) AS triples FROM (SELECT DISTINCT s, p, o FROM ord) x", "ord")


def _snapshot_metrics(s, d):
    return M.snapshot_metrics(V.copies(s, d)).withColumn("mean_growth", F.round("mean_growth", 6))


_SIZES = "(SELECT version, COUNT(*) AS size FROM copies GROUP BY version)"
entry("bear_snapshot_metrics", _snapshot_metrics, f"""SELECT COUNT(*) AS versions, (SELECT size FROM {_SIZES} z WHERE version = 0) AS cnt_triples_first_version, (SELECT size FROM {_SIZES} z WHERE version = 4) AS cnt_triples_last_version, ROUND(AVG(growth), 6) AS mean_growth, (SELECT COUNT(*) FROM (SELECT s FROM copies GROUP BY s, p, o HAVING COUNT(*) = 5) x) AS cnt_triples_static_core, (SELECT COUNT(*) FROM (SELECT DISTINCT s, p, o FROM copies) x) AS cnt_triples_version_oblivious FROM (SELECT version, LEAD(size) OVER (ORDER BY version) / size AS growth FROM {_SIZES} z) g""", "ord copies")


def _ratios(s, d):
    c = V.copies(s, d)
    return M.change_ratios(c, D.change_sets(c, 0, 4)).select(*[F.round(x, 6).alias(x) for x in ("mean_change_ratio", "mean_insertion_ratio", "mean_deletion_ratio")])


_STEP = f"(SELECT z.version, z.size, (SELECT COUNT(*) FROM {_CHANGES} x WHERE x.v_from = z.version AND op = 'add') AS a, (SELECT COUNT(*) FROM {_CHANGES} x WHERE x.v_from = z.version AND op = 'delete') AS r FROM {_SIZES} z WHERE z.version < 4)"
entry("bear_change_ratios", _ratios, f"SELECT ROUND(AVG((a + r) / (size + a)), 6) AS mean_change_ratio, ROUND(AVG(a / (size + a)), 6) AS mean_insertion_ratio, ROUND(AVG(r / (size + a)), 6) AS mean_deletion_ratio FROM {_STEP} s", "ord copies")
def _twice(s, d):
    c = V.copies(s, d)
    return M.computed_twice(c, D.change_sets(c, 0, 4), D.pairwise_changes(c, 0, 4)).select(F.round("mean_change_ratio", 6).alias("mean_change_ratio"), F.round("mean_change_ratio_again", 6).alias("mean_change_ratio_again"), "agree")


entry("bear_ratios_twice", _twice, f"SELECT ROUND(AVG((a + r) / (size + a)), 6) AS mean_change_ratio, ROUND(AVG((a + r) / (size + a)), 6) AS mean_change_ratio_again, TRUE AS agree FROM {_STEP} s", "ord copies")
entry("triples_per_graph", lambda s, d: M.triples_by_graph(V.v_ev(s, d).unionByName(V.v_dim(s, d))), f"SELECT '<{EX}events>' AS g, COUNT(*) AS triples FROM ev UNION ALL SELECT NULL, COUNT(*) FROM dim", "ev dim")



def _kept_metrics(s, d):
    """Class metrics of two snapshots and data sets, those of one removed from an instant on."""
    rows = M.class_metrics(V.v_typed(s, d), M1, M0).select("thing", "current", "previous")
    both = [rows.withColumn("dataset_id", F.lit(x)).withColumn("snapshot_ts", S.at(t)) for x in ("a", "b") for t in (M0, M1)]
    every = both[0].unionByName(both[1]).unionByName(both[2]).unionByName(both[3])
    return M.delete_metrics(every, F.lit("a"), M1)


entry("metrics_delete", _kept_metrics, f"""SELECT c.thing, (SELECT COUNT(*) FROM {_NOW} n WHERE n.o = c.thing) AS current, (SELECT COUNT(*) FROM {_OLD} n WHERE n.o = c.thing) AS previous, x.dataset_id, x.snapshot_ts FROM (SELECT DISTINCT '<{EX}class/' || o_orderstatus || '>' AS thing FROM orders) c, (VALUES ('a', {ts(M0)}), ('b', {ts(M0)}), ('b', {ts(M1)})) x(dataset_id, snapshot_ts)""", "typed")

# --- series and summaries (A20 on)


def _log(s, d):
    """A timings log made of the events, one row each."""
    e = V.table(s, d, "events")
    return e.select(F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "purchase", 2).otherwise(1).cast("long").alias("insertions"), F.when(F.col("event_type") == "view", 1).otherwise(0).cast("long").alias("deletions"), F.col("event_id").alias("cnt_triples"))


SQL["log"] = "log AS (SELECT ts, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS i, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS e, event_id AS n FROM events)"


def _series_sql(unit: str) -> str:
    size = {"HOUR": 3600, "DAY": 86400, "WEEK": 7 * 86400}[unit]
    at = "(EPOCH_US(ts) - EPOCH_US(DATE_TRUNC('day', (SELECT MIN(ts) FROM log))))"
    k = f"CAST(CEIL({at} / {size}000000.0) AS BIGINT)" if unit == "WEEK" else f"CAST(FLOOR({at} / {size}000000.0) AS BIGINT)"
    return f"""SELECT DATE_TRUNC('day', (SELECT MIN(ts) FROM log)) + k * INTERVAL {size} SECOND AS bucket, COALESCE(i, 0)::BIGINT AS insertions, COALESCE(e, 0)::BIGINT AS deletions, LAST_VALUE(n IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt_triples FROM (SELECT g.k, x.i, x.e, x.n FROM (SELECT UNNEST(GENERATE_SERIES((SELECT MIN({k}) FROM log), (SELECT MAX({k}) FROM log))) AS k) g LEFT JOIN (SELECT {k} AS k, SUM(i) AS i, SUM(e) AS e, LAST(n ORDER BY ts, n) AS n FROM log GROUP BY 1) x ON x.k = g.k) y"""


for _unit in ("HOUR", "DAY", "WEEK"):
    entry(f"timeseries_{_unit.lower()}", lambda s, d, u=_unit: TS.buckets(_log(s, d), u), _series_sql(_unit), "log")
entry("timeseries_net_bars", lambda s, d: TS.net_bars(TS.buckets(_log(s, d), "DAY")), f"""SELECT *, CASE WHEN net < 0 THEN previous_total + net ELSE previous_total END AS base FROM (SELECT bucket, insertions, deletions, cnt_triples, COALESCE(LAG(cnt_triples) OVER (ORDER BY bucket), cnt_triples - insertions + deletions) AS previous_total, insertions - deletions AS net FROM ({_series_sql("DAY")}) s) t""", "log")


def _nodes(s, d):
    c, n = V.table(s, d, "customer"), V.table(s, d, "nation")
    leaves = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.floor("c_acctbal").cast("bigint").alias("amount"))
    inner = n.filter("n_nationkey % 5 <> 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.lit(1).cast("bigint").alias("amount"))
    return leaves.unionByName(inner)


_HN = "(SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_nationkey % 5 <> 0)"
entry("hierarchy_rollup", lambda s, d: TS.rollup(_nodes(s, d), ["amount"]), f"""SELECT 'c' || c_custkey AS node, CAST(FLOOR(c_acctbal) AS BIGINT) AS amount FROM customer
    UNION ALL SELECT 'n' || k, CAST(COALESCE(SUM(a), 0) + MAX(own) AS BIGINT) FROM (SELECT n.k, 1 AS own, FLOOR(c.c_acctbal) AS a FROM {_HN} n LEFT JOIN customer c ON c.c_nationkey = n.k) x GROUP BY k
    UNION ALL SELECT 'n' || c_nationkey, CAST(SUM(FLOOR(c_acctbal)) AS BIGINT) FROM customer WHERE c_nationkey % 5 = 0 GROUP BY c_nationkey
    UNION ALL SELECT 'r' || r, CAST(SUM(own) + COALESCE(SUM(a), 0) AS BIGINT) FROM (SELECT n.k, n.r, 1 AS own, (SELECT SUM(FLOOR(c_acctbal)) FROM customer c WHERE c.c_nationkey = n.k) AS a FROM {_HN} n) x GROUP BY r
    UNION ALL SELECT 'ROOT', CAST((SELECT SUM(FLOOR(c_acctbal)) FROM customer) + (SELECT COUNT(*) FROM {_HN} n) AS BIGINT)""")


def _times(s, d):
    e = V.table(s, d, "lineitem")
    return e.select(F.col("l_returnflag").alias("policy"), F.col("l_linenumber").alias("snapshot"), F.col("l_quantity").alias("execution_time"), (F.col("l_quantity") > 30).cast("long").alias("yn_timeout"))


entry("query_time_summary", lambda s, d: TS.query_times(_times(s, d), ["policy", "snapshot"]).withColumn("mean_time", F.round("mean_time", 6)), "SELECT l_returnflag AS policy, l_linenumber AS snapshot, MIN(LEAST(l_quantity, 30)) AS min_time, ROUND(AVG(LEAST(l_quantity, 30)), 6) AS mean_time, MAX(LEAST(l_quantity, 30)) AS max_time, COUNT(*) FILTER (l_quantity > 30) AS timeouts FROM lineitem GROUP BY ALL")
entry("mean_by_policy", lambda s, d: TS.mean_by(_times(s, d), ["policy"], "execution_time").withColumn("mean_execution_time", F.round("mean_execution_time", 6)), "SELECT l_returnflag AS policy, ROUND(AVG(l_quantity), 6) AS mean_execution_time FROM lineitem GROUP BY 1")
entry("quartiles_outliers", lambda s, d: TS.quartiles(V.table(s, d, "part"), "p_retailprice", 1500.0).select(*[F.round(c, 4).alias(c) for c in ("q1", "q2", "q3", "iqr")], "n", "outliers"), "SELECT ROUND(QUANTILE_CONT(p_retailprice, 0.25), 4) AS q1, ROUND(QUANTILE_CONT(p_retailprice, 0.5), 4) AS q2, ROUND(QUANTILE_CONT(p_retailprice, 0.75), 4) AS q3, ROUND(QUANTILE_CONT(p_retailprice, 0.75) - QUANTILE_CONT(p_retailprice, 0.25), 4) AS iqr, COUNT(*) AS n, (SELECT COUNT(*) FROM part WHERE p_retailprice > 1500) AS outliers FROM part WHERE p_retailprice <= 1500")
entry("storage_summary", lambda s, d: TS.storage_summary(V.table(s, d, "part").select(F.col("p_brand").alias("policy"), F.col("p_retailprice").alias("ingestion_time"), F.col("p_size").alias("raw_file_size_MiB"), F.col("p_size").alias("db_files_disk_usage_MiB")), ["policy"]).withColumn("mean_ingestion_time", F.round("mean_ingestion_time", 4)).withColumn("median_ingestion_time", F.round("median_ingestion_time", 4)), 'SELECT p_brand AS policy, ROUND(AVG(p_retailprice), 4) AS mean_ingestion_time, ROUND(MEDIAN(p_retailprice), 4) AS median_ingestion_time, MEDIAN(p_size)::DOUBLE AS "raw_file_size_MiB", MEDIAN(p_size)::DOUBLE AS "db_files_disk_usage_MiB" FROM part GROUP BY p_brand')


def _upserted(s, d):
    n = V.table(s, d, "nation")
    return TS.upsert(n, n.filter("n_nationkey < 5").withColumn("n_name", F.lower("n_name")), ["n_nationkey"])


entry("upsert_by_key", _upserted, "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN LOWER(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation")
entry("missing_days", lambda s, d: TS.missing_days(V.table(s, d, "events"), "ts", ["user_id"]), "SELECT user_id, CAST(x AS DATE) AS day FROM (SELECT user_id, UNNEST(GENERATE_SERIES(CAST(MIN(ts) AS DATE), CAST(MAX(ts) AS DATE), INTERVAL 1 DAY)) AS x FROM events GROUP BY user_id) g EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events")
entry("merged_times", lambda s, d: TS.merged_times(V.table(s, d, "lineitem").filter("l_quantity > 25").groupBy("l_orderkey").agg(F.max("l_quantity").alias("execution_time")), V.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"]), "SELECT o_orderkey AS l_orderkey, LEAST(COALESCE((SELECT MAX(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25), 0), 30) AS execution_time FROM orders")
entry("validity_classes", lambda s, d: TS.validity_classes(V.table(s, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("valid")), ["l_orderkey"]), "SELECT l_orderkey, BOOL_OR(l_returnflag = 'R') AS any_valid, BOOL_AND(l_returnflag = 'R') AS all_valid, COUNT(*) AS stores, CASE WHEN BOOL_AND(l_returnflag = 'R') THEN 'all' WHEN BOOL_OR(l_returnflag = 'R') THEN 'some' ELSE 'none' END AS class FROM lineitem GROUP BY l_orderkey")
entry("batch_max_per_version", lambda s, d: TS.batch_maxima(V.table(s, d, "lineitem").select(F.col("l_linestatus").alias("policy"), F.when(F.col("l_linenumber") == 1, "snapshot_0").when(F.col("l_returnflag") == "R", F.concat(F.lit("negative_change_set_"), F.col("l_linenumber").cast("string"))).otherwise(F.concat(F.lit("positive_change_set_"), F.col("l_linenumber").cast("string"))).alias("batch"), F.col("l_quantity").alias("execution_time")), ["policy"]), "SELECT l_linestatus AS policy, CASE WHEN l_linenumber <> 1 AND l_returnflag = 'R' THEN 'invalidate' ELSE 'insert' END AS kind, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END AS version, MAX(l_quantity) AS max_time FROM lineitem GROUP BY ALL")
entry("query_counts", lambda s, d: M.query_counts(V.table(s, d, "part").select(F.col("p_brand").alias("policy"), F.col("p_type").alias("dataset"), (F.col("p_size") % 2).alias("query_set"))), "SELECT p_brand AS policy, p_type AS dataset, p_size % 2 AS query_set, COUNT(*) AS queries FROM part GROUP BY ALL")


# --- streaming (S): the state after a replay through the tracker equals the last dump


def _replayed_state(spark, d):
    import uuid

    from kairograph.operators.storage import shared_dir
    from kairograph.streaming.tracking import version_step

    store = S.VersionedStore(spark, f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}")
    c = V.copies(spark, d)
    for k in range(len(V.COPY_TIMES)):
        version_step(store, c.filter(F.col("version") == k).select("s", "p", "o"), V.COPY_TIMES[k])
    return store.table().drop("g")


def _dump_folder(spark, d, versions):
    """Dumps of some copies under names with their instants."""
    import uuid

    from kairograph.operators.storage import shared_dir
    from kairograph.sources.sinks import write_lines

    folder = f"{shared_dir(spark)}/dumps-{uuid.uuid4().hex}"
    c = V.copies(spark, d)
    for k in versions:
        write_lines(c.filter(F.col("version") == k).select(N.to_line(F.col("s"), F.col("p"), F.col("o")).alias("value")), f"{folder}/{V.COPY_TIMES[k]:%Y%m%d-%H%M%S}_000")
    return folder, [f"{folder}/{V.COPY_TIMES[k]:%Y%m%d-%H%M%S}_000" for k in versions]


def _rebuilt(spark, d):
    """The state after a rebuild from archived dumps, the last two of them replayed again."""
    import uuid

    from kairograph.operators.storage import shared_dir
    from kairograph.streaming.tracking import rebuild

    store = S.VersionedStore(spark, f"{shared_dir(spark)}/rebuild-{uuid.uuid4().hex}")
    dumps = _dump_folder(spark, d, range(len(V.COPY_TIMES)))[1]
    rebuild(spark, store, dumps)
    rebuild(spark, store, dumps, V.COPY_TIMES[3])
    return store.table().drop("g")


def _tracked(spark, d):
    """A tracker over a landing folder of all dumps; its log of timings without the times, and the metrics that were kept."""
    import uuid

    from kairograph.operators.storage import shared_dir
    from kairograph.streaming.tracking import Dataset, Tracker

    tracker = Tracker(spark, f"{shared_dir(spark)}/track-{uuid.uuid4().hex}")
    folder, _ = _dump_folder(spark, d, range(len(V.COPY_TIMES)))
    tracker.register(Dataset("orders", f"{folder}/*"))
    tracker.start("orders", once=True)
    return tracker.timings("orders").select("timestamp", "insertions", "deletions", "cnt_triples")


_RUNS_IN_TIME = "(SELECT s, p, o, MIN(version) AS a, MAX(version) AS z FROM (SELECT *, version - ROW_NUMBER() OVER (PARTITION BY s, p, o ORDER BY version) AS run FROM copies) r GROUP BY s, p, o, run)"
_AT = "CASE {0} " + " ".join(f"WHEN {k} THEN {ts(t)}" for k, t in enumerate(V.COPY_TIMES)) + " END"
entry("stream_replay_state", _replayed_state, f"SELECT s, p, o, {_AT.format('a')} AS valid_from, CASE WHEN z = 4 THEN {V.SENT} ELSE {_AT.format('z + 1')} END AS valid_until FROM {_RUNS_IN_TIME} x", "ord copies")
entry("rebuild_state", _rebuilt, ORACLE["stream_replay_state"])
entry("tracked_timings", _tracked, f"""SELECT CASE version {" ".join(f"WHEN {k} THEN {ts(t)}" for k, t in enumerate(V.COPY_TIMES))} END AS timestamp, CASE WHEN version = 0 THEN 0 ELSE (SELECT COUNT(*) FROM {_CHANGES} x WHERE x.v_to = version AND op = 'add') END AS insertions, CASE WHEN version = 0 THEN 0 ELSE (SELECT COUNT(*) FROM {_CHANGES} x WHERE x.v_to = version AND op = 'delete') END AS deletions, size AS cnt_triples FROM {_SIZES} z""", "ord copies")
