from pyspark.sql import functions as F

from kairograph.functions import terms as T

X = T.XSD


def one(spark, term, *columns):
    df = spark.createDataFrame([(term,)], "t string")
    return tuple(df.select(*[c(F.col("t")).alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_accessors(spark):
    assert one(spark, '"a"@en', T.lex, T.lang, T.datatype) == ("a", "en", T.RDF + "langString")
    assert one(spark, f'"1.50"^^<{X}decimal>', T.lex, T.num, T.rank) == ("1.50", 1.5, 1)
    assert one(spark, "<urn:a>", T.lex, T.lang, T.num) == ("urn:a", None, None)
    assert one(spark, '"x\ny"', T.lex, T.datatype) == ("x\ny", X + "string")
    assert one(spark, f'"abc"^^<{X}integer>', T.num, T.is_numeric) == (None, False)
    assert one(spark, None, T.lex, T.ebv, T.is_numeric) == (None, None, False)


def test_instants_in_utc(spark):
    assert str(one(spark, f'"2020-01-01T00:30:00+02:00"^^<{X}dateTime>', T.timestamp)[0]) == "2019-12-31 22:30:00"
    assert str(one(spark, f'"2020-01-01T00:30:00"^^<{X}dateTime>', T.timestamp)[0]) == "2020-01-01 00:30:00"


def test_effective_boolean_values(spark):
    for term, value in ((f'"true"^^<{X}boolean>', True), (f'"0"^^<{X}integer>', False), ('""', False), ('"x"', True), ("<urn:a>", None)):
        assert one(spark, term, T.ebv)[0] is value


def test_display_forms(spark):
    for term, shown in (('"a"', '"a"'), ('"say "hi""', "'say \"hi\"'"), ('"a\nb"', '"""a\nb"""'), ("_:b1", '"_:b1"'), ("<urn:a>", "<urn:a>"), ('"a"@de', '"a"@de'), (None, None)):
        assert one(spark, term, T.display)[0] == shown


def test_comparison_by_value(spark):
    df = spark.createDataFrame([(f'"1"^^<{X}integer>', f'"1.0"^^<{X}decimal>'), ('"a"', '"a"@en'), (f'"2"^^<{X}integer>', f'"10"^^<{X}integer>')], "a string, b string")
    rows = df.select(T.equal(F.col("a"), F.col("b")), T.less(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(True, False), (False, False), (False, True)]
