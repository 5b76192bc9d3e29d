"""Expressions of the algebra as Spark columns.

A value knows how it is held: as a term string, or as a boolean, a number or a text that needs no term
until it is returned.  Null is an error or unbound, and every function used gives null instead of raising.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairograph.exceptions import ExpressionNotCovered
from kairograph.functions import terms as T


@dataclass
class Value:
    """kind: term, bool, num, text, time.  For num: exact and approximate value and its rank (an int if it is known)."""

    kind: str
    col: Column | None = None
    dec: Column | None = None
    dbl: Column | None = None
    rank: object = None
    constant: str | None = None

    def term(self) -> Column:
        match self.kind:
            case "term":
                return self.col
            case "bool":
                return T.boolean(self.col)
            case "text":
                return T.plain(self.col)
            case "time":
                return T.datetime(self.col)
        forms = [T.integer(self.dec), T.decimal(self.dec), T.typed(self.dbl, T.XSD + "float"), T.double(self.dbl)]
        if isinstance(self.rank, int):
            return forms[self.rank]
        return F.when(self.rank == 0, forms[0]).when(self.rank == 1, forms[1]).when(self.rank == 2, forms[2]).when(self.rank == 3, forms[3])

    def boolean(self) -> Column:
        match self.kind:
            case "bool":
                return self.col
            case "text":
                return self.col != ""
            case "num":
                return self.number().dbl != 0
        return T.ebv(self.term())

    def number(self) -> Value:
        if self.kind == "num":
            return self
        if self.kind == "term":
            return Value("num", dec=T.dec(self.col), dbl=T.num(self.col), rank=T.rank(self.col))
        null = F.lit(None)
        return Value("num", dec=null.cast(T.DECIMAL), dbl=null.cast("double"), rank=null.cast("int"))

    def text(self) -> Column:
        """STR()."""
        if self.kind == "text":
            return self.col
        if self.kind == "bool":
            return F.when(self.col, "true").when(~self.col, "false")
        return T.lex(self.term())

    def instant(self) -> Column:
        return self.col if self.kind == "time" else T.timestamp(self.term())


def constant(term: str) -> Value:
    m = re.fullmatch(r'"([^"]*)"\^\^<([^>]*)>', term, re.S)
    if m and m[2] in T.NUMERIC_TYPES:
        rank = 0 if m[2] in T.INTEGER_TYPES else {"decimal": 1, "float": 2, "double": 3}[m[2].rpartition("#")[2]]
        return Value("num", dec=F.lit(m[1]).try_cast(T.DECIMAL), dbl=F.lit(m[1]).try_cast("double"), rank=rank, constant=term)
    if m and m[2] == T.XSD + "boolean":
        return Value("bool", F.lit(m[1] in ("true", "1")), constant=term)
    return Value("term", F.lit(term), constant=term)


def truth(c: Column) -> Value:
    return Value("bool", c)


def text(c: Column) -> Value:
    return Value("text", c)


def integer(c: Column) -> Value:
    return Value("num", dec=c.cast(T.DECIMAL), dbl=c.cast("double"), rank=0)


def _top(a, b):
    return max(a, b) if isinstance(a, int) and isinstance(b, int) else F.greatest(*[F.lit(x) if isinstance(x, int) else x for x in (a, b)])


def arithmetic(op: str, a: Value, b: Value) -> Value:
    a, b = a.number(), b.number()
    do = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    rank = _top(a.rank, b.rank)
    if op == "/":
        rank = max(rank, 1) if isinstance(rank, int) else F.greatest(rank, F.lit(1))
    near = do(a.dbl, b.dbl)
    # an exact quotient would lose digits to its type's scale
    return Value("num", dec=near.try_cast(T.DECIMAL) if op == "/" else do(a.dec, b.dec).try_cast(T.DECIMAL), dbl=near, rank=rank)


def compare(op: str, a: Value, b: Value) -> Column:
    if op == "!=":
        return ~compare("=", a, b)
    if op == ">":
        return compare("<", b, a)
    if op in ("<=", ">="):
        x, y = (a, b) if op == "<=" else (b, a)
        return compare("<", x, y) | compare("=", x, y)
    known = {a.kind, b.kind}
    if "num" in known:
        x, y = a.number(), b.number()
        exact = isinstance(x.rank, int) and isinstance(y.rank, int) and max(x.rank, y.rank) < 2
        p, q = (x.dec, y.dec) if exact else (x.dbl, y.dbl)
        if op == "<":
            return p < q
        other = a if a.kind == "term" else b if b.kind == "term" else None
        return p == q if other is None else F.when(p.isNotNull() & q.isNotNull(), p == q).when(other.col.isNotNull(), F.lit(False))
    if known == {"bool"}:
        return (a.col == b.col) if op == "=" else (~a.col & b.col)
    if "time" in known:
        return a.instant() == b.instant() if op == "=" else a.instant() < b.instant()
    if op == "=":
        for x in (a, b):  # an IRI or a string equals only itself, so the scan can be filtered by it
            if x.constant and (x.constant.startswith("<") or x.constant.endswith('"') or re.search(r'"@[^"]*$', x.constant)):
                return a.term() == b.term()
        if known == {"text"}:
            return a.col == b.col
        return T.equal(a.term(), b.term())
    return a.col < b.col if known == {"text"} else T.less(a.term(), b.term())


def _round_up(v: Value, f: Callable[[Column], Column]) -> Value:
    n = v.number()
    return Value("num", dec=f(n.dec).cast(T.DECIMAL), dbl=f(n.dbl).cast("double"), rank=n.rank)


def _flags(found: str) -> str:
    """Flags of the standard as Java's; others are ignored."""
    return "".join(sorted({"i": "i", "s": "s", "m": "m", "x": "x"}.get(c, "") for c in set(found)))


class Scope:
    """Compiles expressions over the columns that hold the variables."""

    def __init__(self, column: Callable[[str], Column | None], now: dt.datetime, aggregates: dict | None = None, exists: dict | None = None):
        self.column, self.now, self.aggregates, self.exists = column, now, aggregates or {}, exists or {}

    def __call__(self, e: tuple) -> Value:
        match e:
            case ("var", name):
                c = self.column(name)
                return Value("term", F.lit(None).cast("string") if c is None else c)
            case ("term", t):
                return constant(t)
            case ("or", a, b):
                return truth(self(a).boolean() | self(b).boolean())
            case ("and", a, b):
                return truth(self(a).boolean() & self(b).boolean())
            case ("not", a):
                return truth(~self(a).boolean())
            case ("neg", a):
                n = self(a).number()
                return Value("num", dec=-n.dec, dbl=-n.dbl, rank=n.rank)
            case (("=" | "!=" | "<" | ">" | "<=" | ">=") as op, a, b):
                return truth(compare(op, self(a), self(b)))
            case (("+" | "-" | "*" | "/") as op, a, b):
                return arithmetic(op, self(a), self(b))
            case ("in", a, options):
                out = F.lit(False)
                for o in options:
                    out = out | compare("=", self(a), self(o))
                return truth(out)
            case ("agg", *_):
                return self.aggregates[id(e)]
            case ("exists", *_):
                return truth(self.exists[id(e)])
            case ("triple", a, b, c):
                return Value("term", F.concat(F.lit("<< "), self(a).term(), F.lit(" "), self(b).term(), F.lit(" "), self(c).term(), F.lit(" >>")))
            case ("call", name, args):
                return self.call(name, args)
        raise ExpressionNotCovered(f"expression {e!r}")

    def call(self, name: str, args: list[tuple]) -> Value:
        if name.startswith("<"):
            return self.cast(name[1:-1], self(args[0]))
        if name == "BOUND":
            c = self.column(args[0][1])
            return truth(F.lit(False) if c is None else c.isNotNull())
        v = [self(a) for a in args]
        match name, v:
            case "IF", [c, a, b]:
                test = c.boolean()
                if a.kind == b.kind and a.kind in ("text", "bool", "time"):
                    return Value(a.kind, F.when(test, a.col).when(~test, b.col))
                return Value("term", F.when(test, a.term()).when(~test, b.term()))
            case "COALESCE", _:
                return Value("term", F.coalesce(*[x.term() for x in v]))
            case "ABS", [a]:
                return _round_up(a, F.abs)
            case "CEIL", [a]:
                return _round_up(a, F.ceil)
            case "FLOOR", [a]:
                return _round_up(a, F.floor)
            case "ROUND", [a]:
                n = a.number()
                return Value("num", dec=F.floor(n.dec + F.lit("0.5").cast("decimal(2,1)")).cast(T.DECIMAL), dbl=F.floor(n.dbl + 0.5).cast("double"), rank=n.rank)
            case "RAND", []:
                value = F.rand()  # one seed, so that both forms are one value
                return Value("num", dec=value.cast(T.DECIMAL), dbl=value, rank=3)
            case "STR", [a]:
                return text(a.text())
            case "STRLEN", [a]:
                return integer(F.length(a.text()))
            case "SUBSTR", [a, start, *rest]:
                at = start.number().dbl
                first = F.greatest(F.round(at), F.lit(1)).cast("int")
                if rest:
                    stop = F.round(at) + F.round(rest[0].number().dbl)
                    return self.like(a, F.substring(a.text(), first, F.greatest(stop - first, F.lit(0)).cast("int")))
                return self.like(a, F.substring(a.text(), first, F.length(a.text())))
            case "UCASE", [a]:
                return self.like(a, F.upper(a.text()))
            case "LCASE", [a]:
                return self.like(a, F.lower(a.text()))
            case "STRSTARTS", [a, b]:
                return truth(F.startswith(a.text(), b.text()))
            case "STRENDS", [a, b]:
                return truth(F.endswith(a.text(), b.text()))
            case "CONTAINS", [a, b]:
                return truth(F.contains(a.text(), b.text()))
            case "STRBEFORE", [a, b]:
                at = F.position(b.text(), a.text())
                return self.found(a, at, F.substring(a.text(), F.lit(1), at - 1))
            case "STRAFTER", [a, b]:
                at = F.position(b.text(), a.text())
                return self.found(a, at, F.substring(a.text(), at + F.length(b.text()), F.length(a.text())))
            case "ENCODE_FOR_URI", [a]:
                return text(T.encode_for_uri(a.text()))
            case "CONCAT", _:
                joined = F.concat(*[x.text() for x in v]) if v else F.lit("")
                if all(x.kind == "text" for x in v):
                    return text(joined)
                tags = [T.lang(x.term()) for x in v]
                same = F.lit(True)
                for t in tags[1:]:
                    same = same & (t == tags[0])
                return Value("term", F.when(same & (tags[0] != ""), F.concat(F.lit('"'), joined, F.lit('"@'), tags[0])).otherwise(T.plain(joined)))
            case "REPLACE", [a, pattern, put, *flags]:
                p = self.pattern(pattern, args[3] if flags else None)
                return self.like(a, F.regexp_replace(a.text(), p, put.text()))
            case "REGEX", [a, pattern, *flags]:
                return truth(F.regexp_like(a.text(), self.pattern(pattern, args[2] if flags else None)))
            case "LANGMATCHES", [a, b]:
                tag, of = F.lower(a.text()), F.lower(b.text())
                return truth(F.when(of == "*", tag != "").otherwise((tag == of) | F.startswith(tag, F.concat(of, F.lit("-")))))
            case "LANG", [a]:
                return text(T.lang(a.term()))
            case "DATATYPE", [a]:
                return Value("term", F.concat(F.lit("<"), T.datatype(a.term()), F.lit(">")))
            case ("IRI" | "URI"), [a]:
                t = a.term()
                return Value("term", F.when(T.is_iri(t), t).otherwise(F.concat(F.lit("<"), T.lex(t), F.lit(">"))))
            case "BNODE", []:
                return Value("term", F.concat(F.lit("_:"), F.expr("uuid()")))
            case "BNODE", [a]:
                return Value("term", F.concat(F.lit("_:b"), F.md5(a.text())))
            case ("ISIRI" | "ISURI"), [a]:
                return truth(T.is_iri(a.term()))
            case "ISBLANK", [a]:
                return truth(T.is_blank(a.term()))
            case "ISLITERAL", [a]:
                return truth(T.is_literal(a.term()))
            case "ISNUMERIC", [a]:
                return truth(T.is_numeric(a.term()))
            case "STRDT", [a, b]:
                return Value("term", F.concat(F.lit('"'), a.text(), F.lit('"^^'), b.term()))
            case "STRLANG", [a, b]:
                return Value("term", F.concat(F.lit('"'), a.text(), F.lit('"@'), F.lower(b.text())))
            case "SAMETERM", [a, b]:
                return truth(a.term() == b.term())
            case "UUID", []:
                return Value("term", F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))
            case "STRUUID", []:
                return text(F.expr("uuid()"))
            case "MD5", [a]:
                return text(F.md5(a.text().cast("binary")))
            case "SHA1", [a]:
                return text(F.sha1(a.text().cast("binary")))
            case ("SHA256" | "SHA384" | "SHA512"), [a]:
                return text(F.sha2(a.text().cast("binary"), int(name[3:])))
            case "NOW", []:
                return Value("time", F.lit(self.now.replace(microsecond=self.now.microsecond // 1000 * 1000)).cast("timestamp_ntz"))
            case ("YEAR" | "MONTH" | "DAY" | "HOURS" | "MINUTES"), [a]:
                # the written fields, not those in UTC
                part = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOURS": F.hour, "MINUTES": F.minute}[name]
                return integer(part(self.wall(a)))
            case "SECONDS", [a]:
                seconds = F.extract(F.lit("SECOND"), self.wall(a))
                return Value("num", dec=seconds.cast(T.DECIMAL), dbl=seconds.cast("double"), rank=1)
            case "TZ", [a]:
                return text(self.zone(a))
            case "TIMEZONE", [a]:
                z = self.zone(a)
                sign = F.when(z.startswith("-"), "-").otherwise("")
                h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
                span = F.when(z.isin("Z", "+00:00", "-00:00"), "PT0S").when(z != "", F.concat(sign, F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise("")))
                return Value("term", T.typed(span, T.XSD + "dayTimeDuration"))
        raise ExpressionNotCovered(f"function {name} with {len(args)} arguments")

    def like(self, a: Value, c: Column) -> Value:
        return text(c) if a.kind == "text" or (a.constant or "").endswith('"') else Value("term", T.same_kind(c, a.term()))

    def found(self, a: Value, at: Column, c: Column) -> Value:
        """The part where there is one, else the empty string without a tag."""
        hit = self.like(a, c)
        return Value("term", F.when(at > 0, hit.term()).when(at == 0, F.lit('""')))

    def pattern(self, p: Value, flags: tuple | None) -> Column:
        f = _flags(re.sub(r'^"(.*)".*$', r"\1", flags[1], flags=re.S)) if flags and flags[0] == "term" else ""
        return F.concat(F.lit(f"(?{f})"), p.text()) if f else p.text()

    def wall(self, a: Value) -> Column:
        if a.kind == "time":
            return a.col
        return F.when(T.timestamp(a.term()).isNotNull(), F.regexp_replace(a.text(), r"(?:Z|[+-][0-9]{2}:[0-9]{2})$", "").try_cast("timestamp_ntz"))

    def zone(self, a: Value) -> Column:
        if a.kind == "time":
            return F.lit("Z")
        return F.when(T.timestamp(a.term()).isNotNull(), F.regexp_extract(a.text(), r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1))

    def cast(self, target: str, a: Value) -> Value:
        kind = target.removeprefix(T.XSD)
        s = a.text() if a.kind != "num" or kind in ("string", "boolean", "dateTime", "date") else None
        if target == kind:
            raise ExpressionNotCovered(f"function <{target}>")
        if kind == "string":
            return text(s)
        if kind == "boolean":
            return truth(F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False).when(a.number().dbl.isNotNull(), a.number().dbl != 0))
        if kind in ("dateTime", "date"):
            t = a.term()
            ok = T.instant(s).isNotNull()
            return Value("term", F.when(ok, T.typed(s, target)) if a.kind != "time" else t)
        if a.kind == "num":  # no detour over text
            n = a.dec if isinstance(a.rank, int) and a.rank < 2 else F.coalesce(a.dec, a.dbl.try_cast(T.DECIMAL))
        else:
            n = F.coalesce(s.try_cast(T.DECIMAL), s.try_cast("double").try_cast(T.DECIMAL))
        if kind == "integer" or target in T.INTEGER_TYPES:
            whole = F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n))
            return integer(whole)
        if kind == "decimal":
            return Value("num", dec=n, dbl=n.cast("double"), rank=1)
        if kind in ("double", "float"):
            d = a.dbl if a.kind == "num" else s.try_cast("double")
            return Value("num", dec=d.try_cast(T.DECIMAL), dbl=d, rank=3 if kind == "double" else 2)
        raise ExpressionNotCovered(f"cast to {target}")
