"""A reader for the Turtle subset that dumps use: prefixes, base, ``a``, ``;`` and ``,`` lists, blank nodes and collections."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession


def triples_of(text: str) -> list[tuple[str, str, str]]:
    """Triples of one document as canonical terms; blank nodes become <_:id>, those without a name one of this document's own."""
    from kairograph.plans.sparql.algebra import Path, Triple, Var
    from kairograph.plans.sparql.parser import KNOWN, Parser

    p = Parser(_as_sparql(text))
    p.prefixes = dict(KNOWN)
    out: list[Triple] = []
    while p.kind != "end":
        if p.is_("PREFIX", "BASE"):
            p.prologue()
            p.take(".")
            continue
        p.subject_block(out)
        p.need(".")

    own = f"{zlib.crc32(text.encode()):08x}"

    def term(x) -> str:
        if isinstance(x, Var):
            return f"<{x.name[1:]}>" if x.name.startswith("._:") else f"<_:{own}{x.name[1:]}>"
        if isinstance(x, Path):
            raise ValueError("a path isn't a term")
        return x

    return [(term(t.s), term(t.p), term(t.o)) for t in out]


def _as_sparql(text: str) -> str:
    """``@prefix`` and ``@base`` in the other spelling, which the parser reads."""
    import re

    text = re.sub(r"^\s*@prefix\s+([^\s:]*:)\s*(<[^>]*>)\s*\.", r"PREFIX \1 \2", text, flags=re.M | re.I)
    return re.sub(r"^\s*@base\s+(<[^>]*>)\s*\.", r"BASE \1", text, flags=re.M | re.I)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Distinct facts of Turtle files; each file is one unit of work, since its prefixes hold for all of it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = triples_of(text)
                s, p, o = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (s, p, o)], ["s", "p", "o"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "s string, p string, o string").distinct()
