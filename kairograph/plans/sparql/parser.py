"""A recursive-descent parser for SPARQL 1.1 queries."""

from __future__ import annotations

import re

from kairograph.exceptions import SparqlSyntax
from kairograph.functions.terms import OWL, RDF, RDFS, VERS, VERS_PREFIX, XSD, iri, literal

from .algebra import BGP, Extend, Filter, Graph, Join, LeftJoin, Minus, Path, Query, Service, SubSelect, Triple, Union, Values, Var

_TOKEN = re.compile(
    r"""
    (?P<space>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<long>\"{3}(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3})
  | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<var>[?$][A-Za-z0-9_·-￿]+)
  | (?P<double>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)
  | (?P<decimal>\d*\.\d+)
  | (?P<integer>\d+)
  | (?P<blank>_:[A-Za-z0-9_](?:[\w.-]*[\w-])?)
  | (?P<pname>(?:[A-Za-zÀ-￿](?:[\w.-]*[\w-])?)?:(?:(?:[\w:%]|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w.:%-]|\\[_~.!$&'()*+,;=/?\#@%-])*(?:[\w:%-]|\\[_~.!$&'()*+,;=/?\#@%-]))?)?)
  | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|<<|>>|[{}()\[\].;,=<>+\-*/!|^?])
    """,
    re.X | re.S,
)

#: Namespaces that may be used without being declared (fixed values).
KNOWN = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL}

_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


def unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlSyntax(f"unexpected {text[at:at + 20]!r} at {at}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str):
        self.toks, self.at = tokens(text), 0
        self.base, self.prefixes, self.fresh = "", {}, 0

    # --- tokens
    @property
    def kind(self) -> str:
        return self.toks[self.at][0]

    @property
    def text(self) -> str:
        return self.toks[self.at][1]

    def is_(self, *texts: str) -> bool:
        return self.kind in ("op", "word") and self.text.upper() in texts

    def take(self, *texts: str) -> bool:
        if self.is_(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SparqlSyntax(f"expected {text}, found {self.text or 'the end'!r}")

    def next(self) -> str:
        self.at += 1
        return self.toks[self.at - 1][1]

    def helper(self) -> Var:
        self.fresh += 1
        return Var(f".h{self.fresh}")

    # --- queries
    def query(self) -> Query:
        self.prologue()
        q = self.select() if self.is_("SELECT") else self.other()
        if self.kind != "end":
            raise SparqlSyntax(f"unexpected {self.text!r} after the query")
        q.prefixes = dict(self.prefixes)
        return q

    def prologue(self) -> None:
        while self.is_("PREFIX", "BASE"):
            if self.next().upper() == "BASE":
                self.base = self.next()[1:-1]
            else:
                name = self.next().removesuffix(":")
                self.prefixes[name] = self.resolve(self.next())[1:-1]

    def other(self) -> Query:
        if self.take("ASK"):
            q = Query("ask", None)
        elif self.take("CONSTRUCT"):
            q = Query("construct", None)
            if self.is_("{"):
                q.template = self.template()
        else:
            raise SparqlSyntax("SELECT, ASK or CONSTRUCT expected")
        self.datasets(q)
        self.take("WHERE")
        q.where = self.group()
        if q.form == "construct" and not q.template and isinstance(q.where, BGP):
            q.template = list(q.where.triples)
        self.modifiers(q)
        return q

    def template(self) -> list[Triple]:
        self.need("{")
        out: list[Triple] = []
        while not self.take("}"):
            self.subject_block(out)
            self.take(".")
        return out

    def select(self) -> Query:
        self.need("SELECT")
        q = Query("select", None)
        q.distinct = self.take("DISTINCT", "REDUCED")
        if not self.take("*"):
            q.projection = []
            while self.kind == "var" or self.is_("(") or (self.kind == "word" and self.text.upper() in AGGREGATES):
                if self.kind == "var":
                    q.projection.append((Var(self.next()[1:]), None))
                else:
                    self.need("(")
                    e = self.expression()
                    self.need("AS")
                    q.projection.append((Var(self.next()[1:]), e))
                    self.need(")")
            if not q.projection:
                raise SparqlSyntax("SELECT without variables")
        self.datasets(q)
        self.take("WHERE")
        q.where = self.group()
        self.modifiers(q)
        return q

    def datasets(self, q: Query) -> None:
        while self.take("FROM"):
            into = q.named_graphs if self.take("NAMED") else q.default_graphs
            into.append(self.iri())

    def modifiers(self, q: Query) -> None:
        while True:
            if self.take("GROUP"):
                self.need("BY")
                while self.kind in ("var", "iri", "pname") or self.is_("(") or (self.kind == "word" and not self.is_("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES")):
                    if self.take("("):
                        e = self.expression()
                        v = Var(self.next()[1:]) if self.take("AS") else None
                        self.need(")")
                        q.group.append((e, v))
                    else:
                        q.group.append((self.primary(), None))
            elif self.take("HAVING"):
                while self.is_("(") or (self.kind == "word" and not self.is_("ORDER", "LIMIT", "OFFSET", "VALUES")):
                    q.having.append(self.primary())
            elif self.take("ORDER"):
                self.need("BY")
                while self.kind in ("var", "iri", "pname") or self.is_("(", "ASC", "DESC") or (self.kind == "word" and not self.is_("LIMIT", "OFFSET", "VALUES")):
                    down = self.is_("DESC")
                    if self.is_("ASC", "DESC"):
                        self.next()
                    q.order.append((self.primary(), down))
            elif self.take("LIMIT"):
                q.limit = int(self.next())
            elif self.take("OFFSET"):
                q.offset = int(self.next())
            elif self.take("VALUES"):
                q.values = self.values()
            else:
                return

    # --- patterns
    def group(self):
        self.need("{")
        if self.is_("SELECT"):
            q = self.select()
            self.need("}")
            return SubSelect(q)
        node, filters = None, []

        def join(x):
            nonlocal node
            node = x if node is None else Join(node, x)

        while not self.take("}"):
            if self.take("FILTER"):
                filters.append(self.constraint())
            elif self.take("OPTIONAL"):
                right = self.group()
                condition = None
                while isinstance(right, Filter):
                    condition = right.condition if condition is None else ("and", right.condition, condition)
                    right = right.child
                node = LeftJoin(node if node is not None else BGP(), right, condition)
            elif self.take("MINUS"):
                node = Minus(node if node is not None else BGP(), self.group())
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                node = Extend(node if node is not None else BGP(), Var(self.next()[1:]), e)
                self.need(")")
            elif self.take("VALUES"):
                join(self.values())
            elif self.take("GRAPH"):
                name = self.var_or_iri()
                join(Graph(name, self.group()))
            elif self.take("SERVICE"):
                silent = self.take("SILENT")
                name = self.var_or_iri()
                join(Service(name, self.group(), silent))
            elif self.is_("{"):
                x = self.group()
                while self.take("UNION"):
                    x = Union(x, self.group())
                join(x)
            elif self.kind == "end":
                raise SparqlSyntax("a group isn't closed")
            else:
                triples: list[Triple] = []
                while True:
                    self.subject_block(triples)
                    if not self.take(".") or not self.starts_triple():
                        break
                if isinstance(node, BGP):
                    node.triples += triples
                else:
                    join(BGP(triples))
            self.take(".")
        node = node if node is not None else BGP()
        for f in filters:
            node = Filter(f, node)
        return node

    def starts_triple(self) -> bool:
        return self.kind in ("var", "iri", "pname", "blank", "string", "long", "integer", "decimal", "double") or self.is_("[", "(", "TRUE", "FALSE")

    def subject_block(self, out: list[Triple]) -> None:
        if self.is_("["):
            s = self.anonymous(out)
            if self.is_(".", "}"):
                return
        else:
            s = self.node(out)
        self.predicates(s, out)

    def predicates(self, s, out: list[Triple]) -> None:
        while True:
            p = Var(self.next()[1:]) if self.kind == "var" else self.path()
            if isinstance(p, Path) and p.kind == "iri":
                p = p.args[0]
            while True:
                out.append(Triple(s, p, self.node(out)))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.is_(".", "}", "]"):
                return

    def anonymous(self, out: list[Triple]) -> Var:
        self.need("[")
        v = self.helper()
        if not self.is_("]"):
            self.predicates(v, out)
        self.need("]")
        return v

    def node(self, out: list[Triple]):
        if self.kind == "var":
            return Var(self.next()[1:])
        if self.kind == "blank":
            return Var("." + self.next())
        if self.is_("["):
            return self.anonymous(out)
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out))
            head = iri(RDF + "nil")
            for x in reversed(items):
                v = self.helper()
                out += [Triple(v, iri(RDF + "first"), x), Triple(v, iri(RDF + "rest"), head)]
                head = v
            return head
        return self.term()

    def var_or_iri(self):
        return Var(self.next()[1:]) if self.kind == "var" else self.iri()

    def values(self) -> Values:
        if self.kind == "var":
            names = [Var(self.next()[1:])]
            self.need("{")
            rows = []
            while not self.take("}"):
                rows.append([self.data()])
            return Values(names, rows)
        self.need("(")
        names = []
        while not self.take(")"):
            names.append(Var(self.next()[1:]))
        self.need("{")
        rows = []
        while not self.take("}"):
            self.need("(")
            row = []
            while not self.take(")"):
                row.append(self.data())
            if len(row) != len(names):
                raise SparqlSyntax("a row of VALUES has another length than its variables")
            rows.append(row)
        return Values(names, rows)

    def data(self) -> str | None:
        return None if self.take("UNDEF") else self.term()

    # --- paths
    def path(self) -> Path:
        parts = [self.path_sequence()]
        while self.take("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def path_sequence(self) -> Path:
        parts = [self.path_step()]
        while self.take("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def path_step(self) -> Path:
        inverse = self.take("^")
        p = self.path_primary()
        if self.is_("?", "*", "+"):
            p = Path({"?": "opt", "*": "star", "+": "plus"}[self.next()], (p,))
        return Path("inv", (p,)) if inverse else p

    def path_primary(self) -> Path:
        if self.take("("):
            p = self.path()
            self.need(")")
            return p
        if self.take("!"):
            forward, inverse = [], []
            several = self.take("(")
            while True:
                (inverse if self.take("^") else forward).append(self.verb())
                if not (several and self.take("|")):
                    break
            if several:
                self.need(")")
            return Path("neg", (tuple(forward), tuple(inverse)))
        return Path("iri", (self.verb(),))

    def verb(self) -> str:
        if self.kind == "word" and self.text == "a":
            self.next()
            return iri(RDF + "type")
        return self.iri()

    # --- terms
    def resolve(self, text: str) -> str:
        inner = unescaped(text[1:-1])
        return iri(inner if not self.base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", inner) else self.base + inner)

    def iri(self) -> str:
        if self.kind == "iri":
            return self.resolve(self.next())
        if self.kind == "pname":
            prefix, _, local = self.next().partition(":")
            space = self.prefixes.get(prefix, VERS if prefix == VERS_PREFIX else KNOWN.get(prefix))
            if space is None:
                raise SparqlSyntax(f"the prefix {prefix}: isn't declared")
            return iri(space + re.sub(r"\\(.)", r"\1", local))
        raise SparqlSyntax(f"an IRI is expected, found {self.text!r}")

    def term(self) -> str:
        sign = self.next() if self.is_("+", "-") else ""
        if self.kind in ("integer", "decimal", "double"):
            kind = self.kind
            return literal(sign.replace("+", "") + self.next(), XSD + kind)
        if sign:
            raise SparqlSyntax("a number is expected after the sign")
        if self.is_("TRUE", "FALSE"):
            return literal(self.next().lower(), XSD + "boolean")
        if self.kind in ("string", "long"):
            cut = 3 if self.kind == "long" else 1
            lex = unescaped(self.next()[cut:-cut])
            if self.kind == "lang":
                return literal(lex, lang=self.next()[1:].lower())
            if self.take("^^"):
                return literal(lex, self.iri()[1:-1])
            return literal(lex)
        return self.iri()

    # --- expressions
    def constraint(self) -> tuple:
        return self.primary()

    def expression(self) -> tuple:
        e = self.conjunction()
        while self.take("||"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self) -> tuple:
        e = self.relation()
        while self.take("&&"):
            e = ("and", e, self.relation())
        return e

    def relation(self) -> tuple:
        e = self.sum()
        if self.is_("=", "!=", "<", ">", "<=", ">="):
            op = self.next()
            return (op, e, self.sum())
        if self.take("IN"):
            return ("in", e, self.list())
        if self.is_("NOT") and self.toks[self.at + 1][1].upper() == "IN":
            self.at += 2
            return ("not", ("in", e, self.list()))
        return e

    def list(self) -> list[tuple]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    def sum(self) -> tuple:
        e = self.product()
        while self.is_("+", "-"):
            op = self.next()
            e = (op, e, self.product())
        return e

    def product(self) -> tuple:
        e = self.unary()
        while self.is_("*", "/"):
            op = self.next()
            e = (op, e, self.unary())
        return e

    def unary(self) -> tuple:
        if self.take("!"):
            return ("not", self.unary())
        if self.take("-"):
            return ("neg", self.unary())
        if self.take("+"):
            return self.unary()
        return self.primary()

    def primary(self) -> tuple:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.kind == "var":
            return ("var", self.next()[1:])
        if self.take("EXISTS"):
            return ("exists", self.group(), True)
        if self.is_("NOT") and self.toks[self.at + 1][1].upper() == "EXISTS":
            self.at += 2
            return ("exists", self.group(), False)
        if self.take("<<"):
            parts = tuple(self.primary() for _ in range(3))
            self.need(">>")
            return ("triple", *parts)
        if self.kind == "word" and not self.is_("TRUE", "FALSE"):
            name = self.next().upper()
            if name in AGGREGATES:
                return self.aggregate(name)
            return ("call", name, self.list())
        if self.kind in ("iri", "pname"):
            name = self.iri()
            return ("call", name, self.list()) if self.is_("(") else ("term", name)
        return ("term", self.term())

    def aggregate(self, name: str) -> tuple:
        self.need("(")
        distinct = self.take("DISTINCT")
        arg = None if self.take("*") else self.expression()
        separator = " "
        if self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = unescaped(self.next()[1:-1])
        self.need(")")
        return ("agg", name, distinct, arg, separator)


def parse(text: str) -> Query:
    return Parser(text).query()


# --- helpers on query text


def split_prologue(text: str) -> tuple[str, str]:
    """(prefix declarations, rest)."""
    m = re.match(r"\s*((?:(?:PREFIX\s+[^\s:]*:\s*<[^>]*>|BASE\s*<[^>]*>)\s*)*)", text, re.I)
    return m[1], text[m.end() :]


def split_modifiers(text: str) -> tuple[str, str]:
    """(query without, its solution modifiers): what follows the last closing brace."""
    at = text.rfind("}") + 1
    return text[:at], text[at:].strip()


def is_ask(text: str) -> bool:
    return bool(re.match(r"\s*ASK\b", split_prologue(text)[1], re.I))


def without_wide(text: str) -> str:
    """Without code points outside the basic plane."""
    return "".join(c for c in text if ord(c) < 0x10000)


def parenthesise_aliases(text: str) -> str:
    """``SELECT count(?x) as ?n`` with the parentheses that the standard asks for."""
    return re.sub(r"(?<![(\w])((?:COUNT|SUM|AVG|MIN|MAX|SAMPLE)\s*\([^()]*\))\s+(AS\s+\?\w+)(?!\s*\))", r"(\1 \2)", text, flags=re.I)
