import datetime as dt

import pytest

from kairograph.engine import TripleStoreEngine
from kairograph.exceptions import ReservedPrefix, ServiceNotRegistered, SparqlSyntax
from kairograph.operators import store as S
from kairograph.plans.sparql.parser import is_ask, parse, parenthesise_aliases, split_modifiers, split_prologue, without_wide

EX = {"ex": "http://ex/", "xsd": "http://www.w3.org/2001/XMLSchema#"}
P = "PREFIX ex: <http://ex/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "
NOW = dt.datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def engine(spark):
    e = TripleStoreEngine(spark, table=spark.createDataFrame([], S.SCHEMA))
    facts = "a p b|b p c|c p a|d p d|a n 1|b n 2|c n 10|a l 'x'@en|a l 'y'@de|b l 'z'|a t '2020-05-06T07:08:09.5+02:00'^^xsd:dateTime"
    e.insert([tuple(x if x[0] in "'0123456789" else f"ex:{x}" for x in f.split(" ", 2)) for f in facts.split("|")], EX, dt.datetime(2024, 1, 1))
    return e


def ask(engine, query):
    short = lambda c: None if c is None else c.replace("http://ex/", "").replace("http://www.w3.org/2001/XMLSchema#", "xsd:")
    return sorted((tuple(short(c) if isinstance(c, (str, type(None))) else c for c in r) for r in engine.query(P + query, NOW).collect()), key=repr)


CASES = [
    ("SELECT ?x { ?x ex:p ?x }", [("<d>",)]),
    ("SELECT ?x ?y { ?x ex:p/ex:p ?y . ?y ex:n 10 }", [("<a>", "<c>")]),
    ("SELECT ?y { ex:a ex:p+ ?y }", [("<a>",), ("<b>",), ("<c>",)]),
    ("SELECT ?y { ex:d ex:p* ?y }", [("<d>",)]),
    ("SELECT ?y { ?y ex:p* ex:b }", [("<a>",), ("<b>",), ("<c>",)]),
    ("SELECT ?y { ex:a ex:p? ?y }", [("<a>",), ("<b>",)]),
    ("SELECT ?x ?l { ?x ex:n ?n OPTIONAL { ?x ex:l ?l FILTER(LANG(?l) = 'en') } }", [("<a>", '"x"@en'), ("<b>", None), ("<c>", None)]),
    ("SELECT ?x ?l { ?x ex:n ?n OPTIONAL { ?x ex:l ?l FILTER(LANG(?l) = 'en') } VALUES ?l { 'x'@en 'q' } }", [("<a>", '"x"@en'), ("<b>", '"q"'), ("<b>", '"x"@en'), ("<c>", '"q"'), ("<c>", '"x"@en')]),
    ("SELECT ?x { ?x ex:n ?n MINUS { ?x ex:l ?l } }", [("<c>",)]),
    ("SELECT ?x { ?x ex:n ?n FILTER NOT EXISTS { ?x ex:l ?l FILTER(?n > 1) } }", [("<a>",), ("<c>",)]),
    ("SELECT (SUM(?n) AS ?s) (AVG(?n) AS ?a) (MAX(?n) AS ?m) { ?x ex:n ?n }", [('"13"^^<xsd:integer>', '"4.3333333333"^^<xsd:decimal>', '"10"^^<xsd:integer>')]),
    ("SELECT (SUM(?l) AS ?s) (COUNT(DISTINCT ?x) AS ?c) { ?x ex:l ?l }", [(None, '"2"^^<xsd:integer>')]),
    ("SELECT ?x { ?x ex:n ?n } ORDER BY DESC(?n) LIMIT 1 OFFSET 1", [("<b>",)]),
    ("SELECT (1/0 AS ?a) (COALESCE(1/0, 'z') AS ?b) (IF(1/0 = 1, 1, 2) AS ?c) {}", [(None, '"z"', None)]),
    ("SELECT (ROUND(-2.5) AS ?a) (2 + 3 * 4 - 1 AS ?b) (xsd:integer('7') + 1 AS ?c) {}", [('"-2.0"^^<xsd:decimal>', '"13"^^<xsd:integer>', '"8"^^<xsd:integer>')]),
    ("SELECT (HOURS(?t) AS ?h) (SECONDS(?t) AS ?s) (TZ(?t) AS ?z) { ?x ex:t ?t }", [('"7"^^<xsd:integer>', '"9.5"^^<xsd:decimal>', '"+02:00"')]),
    ("SELECT (STRBEFORE('abc'@en, 'c') AS ?a) (STRAFTER('abc', 'x') AS ?b) (ENCODE_FOR_URI('a b*~') AS ?c) (SUBSTR('foobar', 4) AS ?d) {}", [('"ab"@en', '""', '"a%20b%2A~"', '"bar"')]),
    ("SELECT ?x ?k { { ?x ex:l 'z' BIND('A' AS ?k) } UNION { ?x ex:n 10 BIND('B' AS ?k) } }", [("<b>", '"A"'), ("<c>", '"B"')]),
    ("SELECT ?x { ?x ex:n ?n } GROUP BY ?x HAVING(SUM(?n) > 1)", [("<b>",), ("<c>",)]),
    ("SELECT ?x ?n { VALUES (?x ?n) { (ex:a UNDEF) (UNDEF 2) } ?x ex:n ?n }", [("<a>", '"1"^^<xsd:integer>'), ("<b>", '"2"^^<xsd:integer>')]),
    ("SELECT ?l (COUNT(*) AS ?c) { ?x ex:n ?n OPTIONAL { ?x ex:l ?l } } GROUP BY ?l", [('"x"@en', '"1"^^<xsd:integer>'), ('"y"@de', '"1"^^<xsd:integer>'), ('"z"', '"1"^^<xsd:integer>'), (None, '"1"^^<xsd:integer>')]),
    ("SELECT ?x { ?x ex:l ?l FILTER(LANGMATCHES(LANG(?l), 'DE') && REGEX(?l, 'Y', 'i')) }", [("<a>",)]),
    ("SELECT * { ex:a ex:p ex:b }", [()]),
    ("SELECT ?x { ?x ex:p [ ex:p ex:c ] }", [("<a>",)]),
    ("ASK { ex:a ex:p ex:c }", [(False,)]),
]


@pytest.mark.parametrize("query, expected", CASES, ids=range(len(CASES)))
def test_query(engine, query, expected):
    assert ask(engine, query) == sorted(expected, key=repr)


def test_helper_variables_stay_inside(engine):
    assert engine.query(P + "SELECT * { ?x ex:p/ex:p ?y . ?y ^ex:p ?z }", NOW).columns == ["x", "y", "z"]


def test_case_of_variables_matters(engine):
    assert len(engine.query(P + "SELECT ?a ?A { ?a ex:n 1 . ?A ex:n 2 }", NOW).columns) == 2


def test_plain_query_on_a_snapshot_equals_the_time_travel_query(spark, engine):
    snap = S.snapshot(engine.table(), NOW).withColumn("valid_from", S.at(dt.datetime(1990, 1, 1))).withColumn("valid_until", S.sentinel())
    plain = TripleStoreEngine(spark, table=snap)
    for query, _ in CASES[:12]:
        assert sorted(map(repr, plain.query(P + query, None, False).collect())) == sorted(map(repr, engine.query(P + query, NOW).collect()))


def test_errors(engine):
    for text in ("SELECT", "SELECT ?x { ?x ", "SELECT ?x { ?x no:p ?y }", "FOO { }"):
        with pytest.raises(SparqlSyntax):
            parse(text)
    assert parse("PREFIX vers: <urn:other:> SELECT * { ?s vers:p ?o }").prefixes["vers"] == "urn:other:"  # reserved in writes only
    for write in (lambda p: engine.insert([("v:a", "v:b", "v:c")], p), lambda p: engine.outdate([("v:a", "v:b", "v:c")], p), lambda p: engine.update([("v:a", "v:b", "v:c")], [("v:a", "v:b", "v:d")], p)):
        with pytest.raises(ReservedPrefix):
            write({"vers": "urn:other:", "v": "urn:v:"})
    with pytest.raises(ServiceNotRegistered):
        engine.query("SELECT * { SERVICE <urn:x> { ?s ?p ?o } }", NOW)
    assert engine.query("SELECT * { SERVICE SILENT <urn:x> { ?s ?p ?o } }", NOW).count() == 1


def test_text_helpers():
    assert split_prologue("PREFIX a: <b> SELECT *")[1] == "SELECT *"
    assert split_modifiers("SELECT * { ?s ?p ?o } LIMIT 3") == ("SELECT * { ?s ?p ?o }", "LIMIT 3")
    assert is_ask("PREFIX a: <b> ask {}") and not is_ask("SELECT * {}")
    assert without_wide("a\U0001f600b") == "ab"
    assert parenthesise_aliases("SELECT count(?x) as ?n {}") == "SELECT (count(?x) as ?n) {}"


def test_templates(engine):
    from kairograph.exceptions import ExpressionNotCovered
    from kairograph.plans.sparql.templates import annotated_text, versioned_text

    pattern = versioned_text("PREFIX ex: <http://ex/> ?s ex:p ?o . ?o ex:q 'x'@EN", 7)
    assert "# version 7" in pattern and parse(pattern).prefixes["ex"] == "http://ex/"
    assert parse(versioned_text("{ ?s ?p ?o } LIMIT 3", 1)).where.triples
    assert "SELECT ?s { ?s ?p ?o }" in versioned_text("SELECT ?s { ?s ?p ?o }", 2, "query")
    text = annotated_text(pattern, dt.datetime(2024, 1, 1))
    assert text.startswith("SELECT ?o ?s {") and '<< << ?s <http://ex/p> ?o >>' in text and '"x"@en' in text
    assert text.count("valid_from") == 2 and '"2024-01-01T00:00:00.000+00:00"' in text and text.count("FILTER") == 2
    for other in ("SELECT * { ?s (<urn:p>|<urn:q>)+ ?o }", "SELECT * { { ?s ?p ?o } UNION { ?o ?p ?s } }"):
        with pytest.raises(ExpressionNotCovered):
            annotated_text(other, dt.datetime(2024, 1, 1))
