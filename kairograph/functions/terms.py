"""RDF terms as canonical N3 strings, and the column expressions that take them apart and build them.

A term is one string column: ``<iri>``, ``_:id``, ``"lex"``, ``"lex"@lang`` or ``"lex"^^<datatype>``; null is
unbound or an error.  The lexical form is kept unescaped between its outer quotes.  Everything here is a
Spark expression, so it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
#: Default namespace of the validity predicates in exported files, and its reserved prefix; readers and writers take another as a parameter.
VERS, VERS_PREFIX = "urn:kairograph:versioning:", "vers"

INTEGER_TYPES = tuple(XSD + t for t in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte"))
NUMERIC_TYPES = (*INTEGER_TYPES, XSD + "decimal", XSD + "double", XSD + "float")
TIME_TYPES = (XSD + "dateTime", XSD + "date", XSD + "dateTimeStamp")

DECIMAL = "decimal(38,10)"


def iri(value: str) -> str:
    return f"<{value}>"


def literal(lex: str, datatype: str | None = None, lang: str | None = None) -> str:
    """The canonical string of a literal; xsd:string is left out."""
    if lang:
        return f'"{lex}"@{lang}'
    if datatype and datatype != XSD + "string":
        return f'"{lex}"^^<{datatype}>'
    return f'"{lex}"'


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


_LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'


def lex(t: Column) -> Column:
    """STR(): the lexical form of a literal, the IRI without brackets; null for blank nodes."""
    return F.when(is_literal(t), F.regexp_extract(t, _LITERAL, 1)).when(is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2))


def lang(t: Column) -> Column:
    """LANG(): the tag, empty for other literals; null for what isn't a literal."""
    return F.when(is_literal(t), F.regexp_extract(t, _LITERAL, 2))


def datatype(t: Column) -> Column:
    """DATATYPE() as an IRI string without brackets."""
    found = F.regexp_extract(t, _LITERAL, 3)
    return F.when(is_literal(t), F.when(found != "", found).when(F.regexp_extract(t, _LITERAL, 2) != "", RDF + "langString").otherwise(XSD + "string"))


def is_numeric(t: Column) -> Column:
    return F.coalesce(is_literal(t) & F.endswith(t, F.lit(">")) & datatype(t).isin(*NUMERIC_TYPES) & num(t).isNotNull(), F.lit(False)) & t.isNotNull()


def _number_text(t: Column) -> Column:
    return F.when(is_literal(t) & F.endswith(t, F.lit(">")) & datatype(t).isin(*NUMERIC_TYPES), lex(t))


def num(t: Column) -> Column:
    """The value of a numeric literal as a double, else null."""
    return _number_text(t).try_cast("double")


def dec(t: Column) -> Column:
    """The value of an integer or decimal literal, exact."""
    return _number_text(t).try_cast(DECIMAL)


def rank(t: Column) -> Column:
    """Numeric promotion: 0 integer, 1 decimal, 2 float, 3 double; null if not numeric."""
    d = datatype(t)
    return F.when(d.isin(*INTEGER_TYPES), 0).when(d == XSD + "decimal", 1).when(d == XSD + "float", 2).when(d == XSD + "double", 3)


def timestamp(t: Column) -> Column:
    """The instant of a dateTime or date literal in UTC without a zone; a value without a zone counts as UTC."""
    text = F.when(is_literal(t) & datatype(t).isin(*TIME_TYPES), lex(t))
    return instant(text)


def instant(text: Column) -> Column:
    zoned = text.rlike(r"(?:Z|[+-][0-9]{2}:[0-9]{2})$")
    plain = F.regexp_replace(text, r"(?:Z|[+-][0-9]{2}:[0-9]{2})$", "")
    offset = F.regexp_extract(text, r"([+-][0-9]{2}:[0-9]{2})$", 1)
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    minutes = F.when(offset == "", 0).otherwise(sign * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int")))
    wall = plain.try_cast("timestamp_ntz")
    return F.when(zoned, wall - F.make_interval(mins=minutes)).otherwise(wall)


# --- building terms


def plain(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def typed(text: Column, dt: str) -> Column:
    return F.concat(F.lit('"'), text.cast("string"), F.lit(f'"^^<{dt}>'))


def boolean(value: Column) -> Column:
    return typed(F.when(value, "true").when(~value, "false"), XSD + "boolean")


def integer(value: Column) -> Column:
    return typed(value.cast("decimal(38,0)").cast("string"), XSD + "integer")


def decimal(value: Column) -> Column:
    """Digits without trailing zeros, one after the point at least."""
    text = value.cast(DECIMAL).cast("string")
    return typed(F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", ".0"), XSD + "decimal")


def double(value: Column) -> Column:
    return typed(value.cast("double").cast("string"), XSD + "double")


def datetime(value: Column) -> Column:
    return typed(format_instant(value), XSD + "dateTime")


def same_kind(text: Column, t: Column) -> Column:
    """A string with the language tag of ``t``, as the string functions keep it."""
    tag = lang(t)
    return F.when(tag != "", F.concat(F.lit('"'), text, F.lit('"@'), tag)).otherwise(plain(text))


def is_string(t: Column) -> Column:
    return is_literal(t) & (F.endswith(t, F.lit('"')) | (lang(t) != "") | (datatype(t) == XSD + "string"))


# --- comparison


def ebv(t: Column) -> Column:
    """Effective boolean value; null is an error."""
    d = datatype(t)
    return F.when(d == XSD + "boolean", lex(t).isin("true", "1")).when(num(t).isNotNull(), (num(t) != 0) & ~F.isnan(num(t))).when(is_string(t), lex(t) != "")


def equal(a: Column, b: Column) -> Column:
    """``=``: by value for numbers and times, else the same term; unequal values of unknown datatypes are an error."""
    both_numbers = num(a).isNotNull() & num(b).isNotNull()
    both_times = timestamp(a).isNotNull() & timestamp(b).isNotNull()
    return F.when(a == b, True).when(both_numbers, num(a) == num(b)).when(both_times, timestamp(a) == timestamp(b)).when(a.isNotNull() & b.isNotNull(), F.lit(False))


def less(a: Column, b: Column) -> Column:
    """``<`` between numbers, times, booleans or strings; null if the two don't compare."""
    na, nb, ta, tb = num(a), num(b), timestamp(a), timestamp(b)
    boolean_type = (datatype(a) == XSD + "boolean") & (datatype(b) == XSD + "boolean")
    return F.when(na.isNotNull() & nb.isNotNull(), na < nb).when(ta.isNotNull() & tb.isNotNull(), ta < tb).when(boolean_type, (lex(a) == "false") & (lex(b) == "true")).when(is_string(a) & is_string(b), lex(a) < lex(b))


def order_key(t: Column) -> Column:
    """Sorts unbound, blank nodes, IRIs, literals; numbers by value, then times, then by text."""
    kind = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).otherwise(3)
    group = F.when(num(t).isNotNull(), 0).when(timestamp(t).isNotNull(), 1).otherwise(2)
    return F.struct(kind.alias("kind"), group.alias("group"), F.coalesce(num(t), F.lit(0.0)).alias("num"), F.coalesce(timestamp(t), F.lit("0001-01-01").cast("timestamp_ntz")).alias("ts"), F.coalesce(t, F.lit("")).alias("text"))


# --- input and output forms


def format_instant(value: Column) -> Column:
    """ISO 8601 cut (not rounded) to milliseconds, UTC."""
    return F.date_format(F.date_trunc("millisecond", value), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def display(t: Column) -> Column:
    """A result cell: quotes chosen by content, blank nodes as quoted text, unbound as null."""
    text = F.when(is_literal(t), F.regexp_extract(t, _LITERAL, 1)).when(is_blank(t), t)
    tail = F.when(is_literal(t), F.concat(F.when(lang(t) != "", F.concat(F.lit("@"), lang(t))).otherwise(""), F.when(F.regexp_extract(t, _LITERAL, 3) != "", F.concat(F.lit("^^<"), F.regexp_extract(t, _LITERAL, 3), F.lit(">"))).otherwise(""))).otherwise("")
    double_quote, single_quote = F.contains(text, F.lit('"')), F.contains(text, F.lit("'"))
    long_form = F.contains(text, F.lit("\n")) | (double_quote & single_quote)
    quote = F.when(long_form, '"""').when(double_quote, "'").otherwise('"')
    return F.when(is_iri(t), t).otherwise(F.concat(quote, text, quote, tail))


def display_with_type(t: Column) -> Column:
    """The other result form: ``value [datatype]``."""
    found = F.regexp_extract(t, _LITERAL, 3)
    return F.when(is_literal(t) & (found != ""), F.concat(lex(t), F.lit(" ["), found, F.lit("]"))).otherwise(F.coalesce(lex(t), t))


def file_stamp(value: Column) -> Column:
    return F.date_format(value, "yyyyMMdd-HHmmss_SSS")


def parse_file_stamp(text: Column) -> Column:
    ok = text.rlike(r"^[0-9]{8}-[0-9]{6}_[0-9]{3}$")
    parts = F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2), F.lit(" "), F.substring(text, 10, 2), F.lit(":"), F.substring(text, 12, 2), F.lit(":"), F.substring(text, 14, 2), F.lit("."), F.substring(text, 17, 3))
    return F.when(ok, parts.try_cast("timestamp_ntz"))


def interval_text(seconds: Column) -> Column:
    """A polling interval as people read it: seconds, minutes and seconds, a clock time, or days and a clock time."""
    n = seconds.cast("long")
    clock = F.format_string("%02d:%02d:%02d", F.floor(n % 86400 / 3600), F.floor(n % 3600 / 60), n % 60)
    return (
        F.when(n < 60, F.format_string("%d seconds", n))
        .when(n < 3600, F.format_string("%d minutes %d seconds", F.floor(n / 60), n % 60))
        .when(n < 86400, clock)
        .otherwise(F.format_string("%d days, %s", F.floor(n / 86400), clock))
    )


def encode_for_uri(text: Column) -> Column:
    out = F.url_encode(text)
    for found, put in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        out = F.regexp_replace(out, found, put)
    return out
