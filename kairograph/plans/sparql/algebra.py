"""Algebra of a query.  Terms are canonical strings, variables are Var; expressions are tuples led by their operator."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Path:
    """kind: iri, inv, seq, alt, neg, opt, star, plus; neg holds forward and inverse IRIs."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Triple:
    s: object
    p: object
    o: object


@dataclass
class BGP:
    triples: list[Triple] = field(default_factory=list)


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    condition: tuple | None = None


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Filter:
    condition: tuple
    child: object


@dataclass
class Extend:
    child: object
    var: Var
    expr: tuple


@dataclass
class Values:
    vars: list[Var]
    rows: list[list[str | None]]


@dataclass
class Graph:
    name: object
    child: object


@dataclass
class Service:
    name: object
    child: object
    silent: bool = False


@dataclass
class SubSelect:
    query: Query


@dataclass
class Query:
    form: str
    where: object
    distinct: bool = False
    projection: list[tuple[Var, tuple | None]] | None = None
    group: list[tuple[tuple, Var | None]] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    values: Values | None = None
    template: list[Triple] = field(default_factory=list)
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)


def expression_parts(e):
    """The tuple and all tuples in it; patterns of EXISTS are left alone."""
    if isinstance(e, tuple):
        yield e
        for x in e[1:]:
            if isinstance(x, (tuple, list)):
                for y in x if isinstance(x, list) else [x]:
                    yield from expression_parts(y)


def expression_vars(e) -> set[str]:
    return {x[1] for x in expression_parts(e) if x[0] == "var"}


def visible(node) -> list[str]:
    """Names of the variables that a pattern can bind, in order of appearance; helpers start with a dot."""
    out: dict[str, None] = {}

    def add(x):
        if isinstance(x, Var):
            out.setdefault(x.name)

    def walk(n):
        match n:
            case BGP(triples):
                for t in triples:
                    add(t.s), add(t.p), add(t.o)
            case Join(a, b) | LeftJoin(a, b, _) | Union(a, b):
                walk(a), walk(b)
            case Minus(a, _):
                walk(a)
            case Filter(_, c):
                walk(c)
            case Extend(c, v, _):
                walk(c), add(v)
            case Values(vs, _):
                for v in vs:
                    add(v)
            case Graph(name, c) | Service(name, c, _):
                add(name), walk(c)
            case SubSelect(q):
                for v in projected(q):
                    add(Var(v))

    walk(node)
    return list(out)


def projected(q: Query) -> list[str]:
    if q.projection is not None:
        return [v.name for v, _ in q.projection]
    names = [v for v in visible(q.where) if not v.startswith(".")]
    return names + [v.name for v in (q.values.vars if q.values else []) if v.name not in names]
