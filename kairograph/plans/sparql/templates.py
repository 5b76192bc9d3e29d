"""Query texts made of raw patterns, for evaluations over many versions."""

from __future__ import annotations

import datetime as dt

from kairograph.exceptions import ExpressionNotCovered
from kairograph.functions.terms import VERS, XSD

from .algebra import BGP, Path, Query, Var
from .parser import parse, split_modifiers, split_prologue

KINDS = ("pattern", "query")


def versioned_text(raw: str, version: int, kind: str = "pattern") -> str:
    """A full query: a raw graph pattern becomes ``SELECT *`` over it, a query stays; prefixes lead, the version is told in a comment, modifiers end it."""
    if kind not in KINDS:
        raise ValueError(f"kind {kind!r}; known: {', '.join(KINDS)}")
    prologue, body = split_prologue(raw)
    if kind == "query":
        return f"{prologue.strip()}\n# version {version}\n{body.strip()}\n"
    pattern, modifiers = split_modifiers(body) if body.lstrip().startswith("{") else ("{ " + body.strip() + " }", "")
    return f"{prologue.strip()}\n# version {version}\nSELECT * {pattern.strip()}\n{modifiers}\n"


def _text(term) -> str:
    if isinstance(term, Var):
        return f"?{term.name}"
    if isinstance(term, Path):
        raise ExpressionNotCovered("a property path has no annotated form")
    return term


def annotated_text(query: str | Query, t: dt.datetime) -> str:
    """The query on plain triples as one on triples annotated with their validity, for a store of quoted triples; its pattern has triples only."""
    q = parse(query) if isinstance(query, str) else query
    if not isinstance(q.where, BGP):
        raise ExpressionNotCovered("only triples have an annotated form")
    stamp = f'"{t.isoformat(timespec="milliseconds")}+00:00"^^<{XSD}dateTime>'
    lines = []
    for k, x in enumerate(q.where.triples):
        lines.append(f"  << << {_text(x.s)} {_text(x.p)} {_text(x.o)} >> <{VERS}valid_from> ?from_{k} >> <{VERS}valid_until> ?until_{k} .")
        lines.append(f"  FILTER(?from_{k} <= {stamp} && {stamp} < ?until_{k})")
    names = sorted({v.name for x in q.where.triples for v in (x.s, x.p, x.o) if isinstance(v, Var) and not v.name.startswith(".")})
    return f"SELECT {' '.join(f'?{n}' for n in names) or '*'} {{\n" + "\n".join(lines) + "\n}"
