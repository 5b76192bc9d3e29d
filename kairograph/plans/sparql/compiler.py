"""Algebra to DataFrames.

Each variable has a column of its own; the compiler knows which are certainly bound.  Certain variables in
common become keys of an equi-join, so Spark can shuffle or broadcast by them; for one that may be unbound
both sides are split by whether it is null, which keeps each part an equi-join.  The triple patterns of a
basic graph pattern are joined in the order of how selective and connected they are.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.exceptions import ExpressionNotCovered, ServiceNotRegistered
from kairograph.functions import terms as T
from kairograph.operators.storage import materialised

from .algebra import BGP, Extend, Filter, Graph, Join, LeftJoin, Minus, Path, Query, Service, SubSelect, Triple, Union, Values, Var, expression_parts, expression_vars, projected, visible
from .expressions import Scope, Value, integer

NIL_GRAPH = "<http://www.openrdf.org/schema/sesame#nil>"


@dataclass
class Relation:
    """A DataFrame with one column for each variable, and the variables that are never null."""

    df: DataFrame
    vars: dict[str, str]
    certain: set[str]

    def col(self, name: str) -> Column | None:
        return self.df[self.vars[name]] if name in self.vars else None


class Compiler:
    """facts: g, s, p, o of one snapshot.  services: IRI -> table of s, p, o.  closure paths need ``paths="all"``; "plain" allows sequences and inverses only."""

    def __init__(self, spark: SparkSession, facts: DataFrame, services: dict[str, DataFrame] | None = None, now: dt.datetime | None = None, paths: str = "all", hops: int = 64):
        self.spark, self.facts, self.services, self.paths, self.hops = spark, facts, services or {}, paths, hops
        self.now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        self.count = 0

    def name(self, var: str = "x") -> str:
        self.count += 1
        return f"v{self.count}_" + "".join(c if c.isalnum() else "_" for c in var)

    # --- queries

    def run(self, q: Query) -> DataFrame:
        if q.form == "ask":
            rel = self.pattern(q.where, self.dataset(q))
            return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        if q.form == "construct":
            rel = self.sliced(self.pattern(q.where, self.dataset(q)), q)
            scope = Scope(rel.col, self.now)
            parts = [rel.df.select(*[scope(self.as_expression(x)).term().alias(n) for n, x in zip("spo", (t.s, t.p, t.o), strict=True)]).dropna() for t in q.template]
            return reduce(DataFrame.unionByName, parts).distinct()
        rel = self.select(q)
        out = rel.df.select(*[rel.df[rel.vars[v]].alias(v) if v in rel.vars else F.lit(None).cast("string").alias(v) for v in projected(q)])
        return out

    @staticmethod
    def as_expression(x) -> tuple:
        return ("var", x.name) if isinstance(x, Var) else ("term", x)

    def dataset(self, q: Query) -> DataFrame:
        if q.default_graphs:
            plain = self.facts.filter(F.col("g").isin(q.default_graphs) | (F.col("g").isNull() if NIL_GRAPH in q.default_graphs else F.lit(False)))
            return plain
        return self.facts

    def select(self, q: Query, facts: DataFrame | None = None, graph=None) -> Relation:
        rel = self.pattern(q.where, self.dataset(q) if q.default_graphs or facts is None else facts, graph)
        if q.values:
            rel = self.join(rel, self.values(q.values))
        aggregates = [x for e in [*(e for _, e in q.projection or [] if e), *q.having, *(e for e, _ in q.order)] for x in expression_parts(e) if x[0] == "agg"]
        found: dict = {}
        if q.group or aggregates:
            rel, found = self.grouped(rel, q, aggregates)
        for h in q.having:
            rel = replace(rel, df=rel.df.filter(self.scope(rel, found)(h).boolean()))
        for v, e in q.projection or []:
            if e is not None:
                rel = self.extended(rel, v.name, self.scope(rel, found)(e), certain=False)
        names = projected(q)
        keys = [(self.scope(rel, found)(e).term(), down) for e, down in q.order]
        if q.distinct:
            # sort keys that aren't projected would tell equal rows apart; the standard leaves that order open
            keep = {v: rel.vars[v] for v in names if v in rel.vars}
            extra = [T.order_key(c).alias(f"sort{i}") for i, (c, _) in enumerate(keys)]
            df = rel.df.select(*[rel.df[c] for c in keep.values()], *extra)
            if extra:
                ordered = [f"sort{i}" for i in range(len(extra))]
                df = df.groupBy(*keep.values()).agg(*[(F.max if down else F.min)(s).alias(s) for s, (_, down) in zip(ordered, keys, strict=True)])
                df = df.orderBy(*[F.col(s).desc() if down else F.col(s).asc() for s, (_, down) in zip(ordered, keys, strict=True)])
            else:
                df = df.distinct()
            rel = Relation(df.select(*keep.values()), keep, rel.certain & set(keep))
        else:
            if keys:
                rel = replace(rel, df=rel.df.orderBy(*[T.order_key(c).desc() if down else T.order_key(c).asc() for c, down in keys]))
            keep = {v: rel.vars[v] for v in names if v in rel.vars}
            rel = Relation(rel.df.select(*[rel.df[c] for c in keep.values()]) if keep else rel.df, keep, rel.certain & set(keep))
        return self.sliced(rel, q)

    @staticmethod
    def sliced(rel: Relation, q: Query) -> Relation:
        df = rel.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return replace(rel, df=df)

    def scope(self, rel: Relation, aggregates: dict | None = None) -> Scope:
        return Scope(rel.col, self.now, aggregates)

    # --- groups

    def grouped(self, rel: Relation, q: Query, aggregates: list[tuple]) -> tuple[Relation, dict]:
        scope, df = self.scope(rel), rel.df
        keys: dict[str, str] = {}
        columns = []
        for i, (e, v) in enumerate(q.group):
            name = v.name if v else e[1] if e[0] == "var" else f".g{i}"
            keys[name] = self.name(name)
            columns.append(scope(e).term().alias(keys[name]))
        measures, found = [], {}
        for e in aggregates:
            if id(e) in found:
                continue
            _, kind, distinct, arg, separator = e
            if arg is None:
                what = F.struct(*[df[c] for v, c in rel.vars.items() if not v.startswith(".")]) if distinct else F.lit(1)
                m = F.count_distinct(what) if distinct else F.count(what)
                found[id(e)] = (integer, [self.add(measures, m)])
                continue
            column = self.name("a")
            columns.append(scope(arg).term().alias(column))
            found[id(e)] = self.measure(measures, kind, distinct, F.col(column), separator)
        df = df.select(*columns) if columns else df
        if keys:
            df = df.groupBy(*keys.values()).agg(*(measures or [F.count(F.lit(1)).alias(self.name("n"))]))
        else:
            df = df.agg(*measures)
        values = {k: make(*[df[c] for c in names]) for k, (make, names) in found.items()}
        certain = {v.name if v else e[1] for e, v in q.group if v is None and e[0] == "var" and e[1] in rel.certain}
        return Relation(df, keys, certain), values

    def add(self, measures: list, m: Column) -> str:
        name = self.name("m")
        measures.append(m.alias(name))
        return name

    def measure(self, measures: list, kind: str, distinct: bool, x: Column, separator: str):
        """(how to make the value from its columns, their names); all of them have partial aggregates."""
        add = lambda m: self.add(measures, m)
        if kind == "COUNT":
            return integer, [add(F.count_distinct(x) if distinct else F.count(x))]
        if kind == "SAMPLE":
            return (lambda c: Value("term", c)), [add(F.min(x))]
        if kind in ("MIN", "MAX"):
            pick = F.min_by if kind == "MIN" else F.max_by
            return (lambda c: Value("term", c)), [add(pick(x, F.when(x.isNotNull(), T.order_key(x))))]
        if kind == "GROUP_CONCAT":
            gather = F.collect_set if distinct else F.collect_list
            return (lambda c: Value("text", F.array_join(F.array_sort(c), separator))), [add(gather(T.lex(x)))]
        total = (lambda c: F.sum_distinct(c)) if distinct else F.sum
        names = [add(F.count(x)), add(F.count(T.num(x))), add(total(T.dec(x))), add(total(T.num(x))), add(F.max(T.rank(x)))]
        number = add(F.count_distinct(T.num(x)) if distinct else F.count(T.num(x)))

        def make(n, numbers, exact, near, rank, count):
            good = n == numbers
            rank = F.when(good, F.coalesce(rank, F.lit(0)))
            exact, near = F.coalesce(exact, F.lit(0).cast(T.DECIMAL)).try_cast(T.DECIMAL), F.coalesce(near, F.lit(0.0))
            if kind == "SUM":
                return Value("num", dec=F.when(good, exact), dbl=F.when(good, near), rank=rank)
            some = good & (count > 0)
            mean = F.try_divide(exact.cast("double"), count.cast("double")).try_cast(T.DECIMAL)
            return Value("num", dec=F.when(some, mean).when(good, F.lit(0).cast(T.DECIMAL)), dbl=F.when(some, near / count).when(good, 0.0), rank=F.when(some, F.greatest(rank, F.lit(1))).otherwise(rank))

        return make, [*names, number]

    # --- patterns

    def pattern(self, node, facts: DataFrame, graph=None) -> Relation:
        match node:
            case BGP(triples):
                return self.bgp(triples, facts, graph)
            case Join(a, b):
                return self.join(self.pattern(a, facts, graph), self.pattern(b, facts, graph))
            case LeftJoin(a, b, condition):
                return self.left_join(self.pattern(a, facts, graph), self.pattern(b, facts, graph), condition)
            case Union(a, b):
                return self.union(self.pattern(a, facts, graph), self.pattern(b, facts, graph))
            case Minus(a, b):
                return self.minus(self.pattern(a, facts, graph), self.pattern(b, facts, graph))
            case Filter(condition, child):
                return self.filter(self.pattern(child, facts, graph), condition, facts, graph)
            case Extend(child, v, e):
                rel = self.pattern(child, facts, graph)
                return self.extended(rel, v.name, self.scope(rel)(e), certain=(e[0] == "term") or (e[0] == "var" and e[1] in rel.certain))
            case Values():
                return self.values(node)
            case Graph(name, child):
                return self.pattern(child, facts, name)
            case Service(name, child, silent):
                return self.service(name, child, silent)
            case SubSelect(q):
                return self.select(q, facts, graph)
        raise ExpressionNotCovered(f"pattern {type(node).__name__}")

    def unit(self) -> Relation:
        return Relation(self.spark.range(1).select(F.lit(1).alias(self.name("unit"))), {}, set())

    def values(self, node: Values) -> Relation:
        names = {v.name: self.name(v.name) for v in node.vars}
        df = self.spark.createDataFrame([tuple(r) for r in node.rows], ", ".join(f"`{c}` string" for c in names.values()))
        certain = {v.name for k, v in enumerate(node.vars) if all(r[k] is not None for r in node.rows)}
        return Relation(df, names, certain)

    def service(self, name, child, silent: bool) -> Relation:
        if isinstance(child, BGP) and not child.triples:
            return self.unit()
        table = None if isinstance(name, Var) else self.services.get(name[1:-1])
        if table is None:
            if silent:
                return self.unit()
            raise ServiceNotRegistered(f"no table is registered for {name}")
        facts = table.select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
        return self.pattern(child, facts)

    def extended(self, rel: Relation, var: str, value: Value, certain: bool) -> Relation:
        name = self.name(var)
        return Relation(rel.df.withColumn(name, value.term()), {**rel.vars, var: name}, rel.certain | ({var} if certain else set()) if certain else rel.certain - {var})

    # basic graph patterns

    def bgp(self, triples: list[Triple], facts: DataFrame, graph) -> Relation:
        if not triples:
            return self.unit()
        triples = self.expanded(triples)
        left = list(triples)
        bound: set[str] = set()
        rel: Relation | None = None
        while left:
            def cost(t: Triple) -> tuple:
                names = [x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)]
                joined = any(n in bound for n in names)
                free = sum(n not in bound for n in names)
                closure = isinstance(t.p, Path)
                return (rel is not None and not joined, closure, free, isinstance(t.s, Var) and t.s.name not in bound, isinstance(t.o, Var) and t.o.name not in bound)

            t = min(left, key=cost)
            left.remove(t)
            one = self.triple(t, facts, graph)
            bound |= set(one.vars)
            rel = one if rel is None else self.join(rel, one)
        if isinstance(graph, Var) and graph.name not in rel.vars:
            raise ExpressionNotCovered("GRAPH with a variable around an empty pattern")
        return rel

    def expanded(self, triples: list[Triple]) -> list[Triple]:
        """Sequences and inverses as plain patterns, each sequence with variables of its own."""
        out: list[Triple] = []
        for t in triples:
            if not isinstance(t.p, Path):
                out.append(t)
            elif t.p.kind == "iri":
                out.append(Triple(t.s, t.p.args[0], t.o))
            elif t.p.kind == "inv":
                out += self.expanded([Triple(t.o, t.p.args[0], t.s)])
            elif t.p.kind == "seq":
                here = t.s
                for k, part in enumerate(t.p.args):
                    self.count += 1
                    there = t.o if k + 1 == len(t.p.args) else Var(f".q{self.count}")
                    out += self.expanded([Triple(here, part, there)])
                    here = there
            else:
                if self.paths != "all":
                    raise ExpressionNotCovered(f"property path {t.p.kind}" + ("; write it as UNION" if t.p.kind == "alt" else ""))
                out.append(t)
        return out

    def scan(self, facts: DataFrame, graph) -> DataFrame:
        if graph is None:
            return facts
        if isinstance(graph, Var):
            return facts.filter(F.col("g").isNotNull())
        return facts.filter(F.col("g").isNull() if graph == NIL_GRAPH else F.col("g") == graph)

    def triple(self, t: Triple, facts: DataFrame, graph) -> Relation:
        df = self.scan(facts, graph)
        if isinstance(t.p, Path):
            p = t.p
            if p.kind == "alt" and all(x.kind == "iri" for x in p.args):
                df = df.filter(F.col("p").isin([x.args[0] for x in p.args]))
                return self.bind(df, [(t.s, "s"), (t.o, "o")], graph)
            pairs = self.pairs(p, df, t.s if isinstance(t.s, str) else None, t.o if isinstance(t.o, str) else None)
            return self.bind(pairs, [(t.s, "s"), (t.o, "o")], None)
        return self.bind(df, [(t.s, "s"), (t.p, "p"), (t.o, "o")], graph)

    def bind(self, df: DataFrame, places: list[tuple[object, str]], graph) -> Relation:
        names: dict[str, str] = {}
        columns = []
        for x, c in [*places, *([(graph, "g")] if isinstance(graph, Var) else [])]:
            if isinstance(x, Var):
                if x.name in names:
                    df = df.filter(F.col(c) == F.col(names[x.name][1]))
                else:
                    names[x.name] = (self.name(x.name), c)
                    columns.append(F.col(c).alias(names[x.name][0]))
            else:
                df = df.filter(F.col(c) == x)
        columns = columns or [F.lit(1).alias(self.name("unit"))]
        return Relation(df.select(*columns), {v: n for v, (n, _) in names.items()}, set(names))

    # property paths

    def pairs(self, p: Path, facts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
        """(s, o) that the path links; a constant end bounds the search."""
        match p.kind:
            case "iri":
                return facts.filter(F.col("p") == p.args[0]).select("s", "o")
            case "inv":
                x = self.pairs(p.args[0], facts, end, start)
                return x.select(F.col("o").alias("s"), F.col("s").alias("o"))
            case "alt":
                return reduce(DataFrame.unionByName, [self.pairs(x, facts, start, end) for x in p.args])
            case "seq":
                out = self.pairs(p.args[0], facts, start)
                for x in p.args[1:]:
                    step = self.pairs(x, facts).select(F.col("s").alias("m"), F.col("o").alias("t"))
                    out = out.join(step, out["o"] == step["m"]).select("s", F.col("t").alias("o"))
                return out
            case "neg":
                forward, inverse = p.args
                parts = []
                if forward or not inverse:
                    parts.append(facts.filter(~F.col("p").isin(list(forward))).select("s", "o"))
                if inverse:
                    parts.append(facts.filter(~F.col("p").isin(list(inverse))).select(F.col("o").alias("s"), F.col("s").alias("o")))
                return reduce(DataFrame.unionByName, parts)
            case "opt":
                return self.identity(facts, start, end).unionByName(self.pairs(p.args[0], facts, start, end)).distinct()
            case "star":
                return self.identity(facts, start, end).unionByName(self.closure(p.args[0], facts, start, end)).distinct()
            case "plus":
                return self.closure(p.args[0], facts, start, end)
        raise ExpressionNotCovered(f"property path {p.kind}")

    def identity(self, facts: DataFrame, start: str | None, end: str | None) -> DataFrame:
        nodes = facts.select(F.col("s").alias("n")).unionByName(facts.select(F.col("o").alias("n")))
        given = [x for x in (start, end) if x is not None]
        if given:
            nodes = self.spark.createDataFrame([(x,) for x in given], "n string")
        nodes = nodes.distinct()
        return nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))

    def closure(self, p: Path, facts: DataFrame, start: str | None, end: str | None) -> DataFrame:
        """Transitive closure by semi-naive rounds: only pairs found last are extended, and pairs seen before are dropped.

        From a given start each round is one step further; between all nodes it doubles the length, so a few rounds do.
        """
        if start is None and end is not None:
            x = self.closure(Path("inv", (p,)), facts, end, None)
            return x.select(F.col("o").alias("s"), F.col("s").alias("o"))
        step = materialised(self.pairs(p, facts).distinct(), "path")
        seen = fresh = materialised(step.filter(F.col("s") == start) if start is not None else step, "path")
        for _ in range(self.hops):
            edge = (seen if start is None else step).select(F.col("s").alias("m"), F.col("o").alias("t"))
            new = fresh.join(edge, fresh["o"] == edge["m"]).select("s", F.col("t").alias("o")).distinct().join(seen, ["s", "o"], "left_anti")
            fresh = materialised(new, "path")
            if fresh.isEmpty():
                return seen
            seen = seen.unionByName(fresh)
        raise ExpressionNotCovered(f"a path longer than {self.hops} steps")

    # joins

    def join(self, a: Relation, b: Relation) -> Relation:
        shared = [v for v in a.vars if v in b.vars]
        sure = [v for v in shared if v in a.certain and v in b.certain]
        maybe = [v for v in shared if v not in sure]
        names = {**b.vars, **a.vars}
        certain = a.certain | b.certain
        if len(maybe) > 2:
            return self.loose(a, b, sure, maybe, names, certain)

        def split(left: DataFrame, right: DataFrame, equal: list[str], rest: list[str], take: dict[str, str]) -> list[DataFrame]:
            if rest:
                v, more = rest[0], rest[1:]
                x, y = a.vars[v], b.vars[v]
                out = split(left.filter(F.col(x).isNotNull()), right.filter(F.col(y).isNotNull()), [*equal, v], more, {**take, v: x})
                if v not in a.certain:
                    out += split(left.filter(F.col(x).isNull()), right, equal, more, {**take, v: y})
                if v not in b.certain:
                    out += split(left.filter(F.col(x).isNotNull()), right.filter(F.col(y).isNull()), equal, more, {**take, v: x})
                return out
            on = [F.col(a.vars[v]) == F.col(b.vars[v]) for v in equal]
            joined = left.join(right, on=reduce(Column.__and__, on)) if on else left.crossJoin(right)
            return [joined.select(*[F.col(take.get(v, c)).alias(c) for v, c in names.items()], *([F.lit(1).alias(unit)] if not names else []))]

        unit = self.name("unit")
        parts = split(a.df, b.df, sure, maybe, {})
        return Relation(reduce(DataFrame.unionByName, parts), names, certain)

    def loose(self, a: Relation, b: Relation, sure, maybe, names, certain) -> Relation:
        on = [a.col(v) == b.col(v) for v in sure] + [(a.col(v) == b.col(v)) | a.col(v).isNull() | b.col(v).isNull() for v in maybe]
        joined = a.df.join(b.df, on=reduce(Column.__and__, on))
        return Relation(joined.select(*[(F.coalesce(a.col(v), b.col(v)) if v in maybe else (a.col(v) if v in a.vars else b.col(v))).alias(c) for v, c in names.items()]), names, certain)

    def matches(self, a: Relation, b: Relation, need_shared: bool) -> Column | None:
        """Compatibility of two rows; with need_shared also one common bound variable.  None: no condition."""
        shared = [v for v in a.vars if v in b.vars]
        if not shared:
            return None
        on, both = [], F.lit(False)
        for v in shared:
            x, y = a.col(v), b.col(v)
            if v in a.certain and v in b.certain:
                on.append(x == y)
                both = F.lit(True)
                need_shared = False
            else:
                on.append((x == y) | x.isNull() | y.isNull())
                both = both | (x.isNotNull() & y.isNotNull())
        if need_shared:
            on.append(both)
        return reduce(Column.__and__, on)

    def left_join(self, a: Relation, b: Relation, condition: tuple | None) -> Relation:
        on = self.matches(a, b, False)
        if condition is not None:
            def both(v: str) -> Column | None:
                x, y = a.col(v), b.col(v)
                return y if x is None else x if y is None or v in a.certain else F.coalesce(x, y)

            c = Scope(both, self.now)(condition).boolean()
            on = c if on is None else on & c
        names = {**b.vars, **a.vars}
        joined = a.df.join(b.df, on=F.lit(True) if on is None else on, how="left")
        columns = [(a.col(v) if v in a.certain or v not in b.vars else F.coalesce(a.col(v), b.col(v)) if v in a.vars else b.col(v)).alias(c) for v, c in names.items()]
        return Relation(joined.select(*(columns or [F.lit(1).alias(self.name("unit"))])), names, set(a.certain))

    def union(self, a: Relation, b: Relation) -> Relation:
        names = dict(a.vars)
        for v in b.vars:
            names.setdefault(v, self.name(v))
        unit = [F.lit(1).alias(self.name("unit"))] if not names else []

        def part(r: Relation) -> DataFrame:
            return r.df.select(*[(r.col(v) if v in r.vars else F.lit(None).cast("string")).alias(c) for v, c in names.items()], *unit)

        return Relation(part(a).unionByName(part(b)), names, a.certain & b.certain)

    def minus(self, a: Relation, b: Relation) -> Relation:
        on = self.matches(a, b, True)
        return a if on is None else replace(a, df=a.df.join(b.df, on=on, how="left_anti"))

    # filters

    def filter(self, rel: Relation, condition: tuple, facts: DataFrame, graph) -> Relation:
        for part in self.conjuncts(condition):
            negated = part[0] == "not" and part[1][0] == "exists"
            e = part[1] if negated else part
            if e[0] == "exists":
                rel = self.exists(rel, e[1], e[2] != negated, facts, graph)
                continue
            inner = [x for x in expression_parts(part) if x[0] == "exists"]
            found = {}
            for x in inner:
                rel, found[id(x)] = self.marked(rel, x, facts, graph)
            scope = Scope(rel.col, self.now, exists=found)
            rel = replace(rel, df=rel.df.filter(scope(part).boolean()))
        return rel

    def conjuncts(self, e: tuple):
        if e[0] == "and":
            yield from self.conjuncts(e[1])
            yield from self.conjuncts(e[2])
        else:
            yield e

    def exists(self, rel: Relation, node, positive: bool, facts: DataFrame, graph) -> Relation:
        conditions = []
        while isinstance(node, Filter) and (expression_vars(node.condition) - set(visible(node.child))) & set(rel.vars) and not any(x[0] == "exists" for x in expression_parts(node.condition)):
            conditions.append(node.condition)  # it looks at the outer row
            node = node.child
        inner = self.pattern(node, facts, graph)
        on = self.matches(rel, inner, False)

        def both(v: str) -> Column | None:
            x, y = rel.col(v), inner.col(v)
            return x if x is not None else y

        for c in conditions:
            k = Scope(both, self.now)(c).boolean()
            on = k if on is None else on & k
        if on is None:
            some = inner.df.limit(1).agg(F.count(F.lit(1)).alias(self.name("n")))
            column = some.columns[0]
            test = F.col(column) > 0 if positive else F.col(column) == 0
            return replace(rel, df=rel.df.crossJoin(F.broadcast(some)).filter(test).drop(column))
        return replace(rel, df=rel.df.join(inner.df, on=on, how="left_semi" if positive else "left_anti"))

    def marked(self, rel: Relation, e: tuple, facts: DataFrame, graph) -> tuple[Relation, Column]:
        """For EXISTS inside an expression: a column that says whether the pattern matches."""
        inner = self.pattern(e[1], facts, graph)
        shared = [v for v in rel.vars if v in inner.vars]
        if not shared or any(v not in rel.certain or v not in inner.certain for v in shared):
            raise ExpressionNotCovered("EXISTS inside an expression needs variables that are bound on both sides")
        flag = self.name("flag")
        keys = inner.df.select(*[inner.col(v) for v in shared]).distinct().withColumn(flag, F.lit(True))
        on = reduce(Column.__and__, [rel.col(v) == keys[inner.vars[v]] for v in shared])
        df = rel.df.join(keys, on=on, how="left").select(*[rel.df[c] for c in rel.df.columns], keys[flag])
        hit = F.coalesce(F.col(flag), F.lit(False))
        return replace(rel, df=df), hit if e[2] else ~hit
