"""Line-based RDF sources: scan, normalise, skolemise, validate and parse N-Triples and N-Quads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A term's grammar in Java regular expressions.
IRI = r"<[^\x00-\x20<>\"{}|^`\\]*>"
BLANK = r"_:[A-Za-z0-9_][A-Za-z0-9_.\-]*"
LITERAL = r"\"(?:[^\"\\\n\r]|\\[tbnrf\"'\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*\"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^" + IRI + ")?"
SUBJECT, PREDICATE, OBJECT = f"(?:{IRI}|{BLANK})", IRI, f"(?:{IRI}|{BLANK}|{LITERAL})"
TRIPLE = rf"^\s*({SUBJECT})\s*({PREDICATE})\s*({OBJECT})\s*\.\s*(?:#.*)?$"
QUAD = rf"^\s*({SUBJECT})\s*({PREDICATE})\s*({OBJECT})\s*({IRI}|{BLANK})?\s*\.\s*(?:#.*)?$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files without blank ones and comments, each once, with their file."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.input_file_name().alias("file"))
    return lines.filter((F.col("line") != "") & ~F.col("line").startswith("#")).distinct()


def normalise(line: Column) -> Column:
    """Written escapes that a store doesn't give back go: controls, no-break space, line and paragraph separator, \\f, \\b, \\'.  A real tab becomes \\t, ^^xsd:string is dropped."""
    # fixed values: 0000 to 0009, 000B, 000C, 000E to 001F, 007f, 00a0, 2028, 2029
    out = F.regexp_replace(line, r"\\u(?:00(?:0[0-9BbCcEeFf]|1[0-9A-Fa-f]|7f|a0)|202[89])", "")
    out = F.regexp_replace(out, r"(?<!\\)\\[fb']", "")
    out = F.regexp_replace(out, "\t", r"\\t")
    return F.regexp_replace(out, r"\^\^<http://www\.w3\.org/2001/XMLSchema#string>", "")


def skolemise_subject(line: Column) -> Column:
    """A blank node at the start of the line becomes the IRI <_:id>."""
    return F.regexp_replace(line, rf"^\s*({BLANK})(?=\s)", "<$1>")


def skolemise_object(line: Column) -> Column:
    """A blank node before the final dot (or before a graph name) becomes the IRI <_:id>."""
    return F.regexp_replace(line, rf"(?<=\s)({BLANK})(?=\s*(?:{IRI})?\s*\.\s*$)", "<$1>")


def has_subject_blank(line: Column) -> Column:
    return line.rlike(rf"^\s*{BLANK}\s")


def has_object_blank(line: Column) -> Column:
    return line.rlike(rf"\s{BLANK}\s*(?:{IRI})?\s*\.\s*$")


def is_valid(line: Column, quads: bool = False) -> Column:
    return line.rlike(QUAD if quads else TRIPLE)


def commented(line: Column, quads: bool = False) -> Column:
    """An invalid line as a comment."""
    return F.when(is_valid(line, quads), line).otherwise(F.concat(F.lit("# "), line))


def unescape(text: Column) -> Column:
    """Character escapes of N-Triples as characters, so that equal terms are equal strings.  The backslash is held back to the end."""
    hold = ""
    out = F.regexp_replace(text, r"\\\\", hold)
    for code, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ('"', '"'), ("'", "'")):
        out = F.regexp_replace(out, r"\\" + code, char)
    return F.regexp_replace(out, hold, r"\\")


def canonical(term: Column) -> Column:
    """A parsed term in canonical form: escapes read, language tags in lower case, xsd:string dropped."""
    body = F.regexp_extract(term, r'(?s)^"(.*)"[^"]*$', 1)
    tail = F.regexp_extract(term, r'(?s)^".*"([^"]*)$', 1)
    tail = F.when(tail.startswith("@"), F.lower(tail)).when(tail == "^^<http://www.w3.org/2001/XMLSchema#string>", "").otherwise(tail)
    return F.when(term.startswith('"'), F.concat(F.lit('"'), F.when(F.contains(body, F.lit("\\")), unescape(body)).otherwise(body), F.lit('"'), tail)).otherwise(term)


def parse(lines: DataFrame, column: str = "line", quads: bool = False) -> DataFrame:
    """s, p, o (and g) of the valid lines, as canonical terms."""
    pattern = QUAD if quads else TRIPLE
    names = ["s", "p", "o", *(["g"] if quads else [])]
    parts = [canonical(F.regexp_extract(column, pattern, k + 1)).alias(n) if n != "g" else F.nullif(F.regexp_extract(column, pattern, 4), F.lit("")).alias("g") for k, n in enumerate(names)]
    return lines.filter(F.col(column).rlike(pattern)).select(*parts)


def read_ntriples(spark: SparkSession, path: str, quads: bool = False) -> DataFrame:
    """Distinct facts of N-Triples (or N-Quads) files after normalising and skolemising."""
    lines = read_lines(spark, path).select(skolemise_object(skolemise_subject(normalise(F.col("line")))).alias("line"))
    return parse(lines, "line", quads).distinct()


def preprocess_summary(lines: DataFrame, quads: bool = False) -> DataFrame:
    """Skolemised subjects and objects and invalid lines by file; lines: file, line."""
    line = F.col("line")
    fixed = skolemise_object(skolemise_subject(line))
    return lines.groupBy("file").agg(F.sum(has_subject_blank(line).cast("long")).alias("skolemized_subjects"), F.sum(has_object_blank(line).cast("long")).alias("skolemized_objects"), F.sum((~is_valid(fixed, quads)).cast("long")).alias("invalid_triples"))


def to_line(s: Column, p: Column, o: Column) -> Column:
    """``s p o .`` with the escapes that N-Triples asks for."""
    return F.concat_ws(" ", s, p, escaped(o), F.lit("."))


def escaped(term: Column) -> Column:
    body = F.regexp_extract(term, r'(?s)^"(.*)"[^"]*$', 1)
    tail = F.regexp_extract(term, r'(?s)^".*"([^"]*)$', 1)
    out = body
    for found, put in ((r"\\", r"\\\\"), ('"', r'\\"'), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        out = F.regexp_replace(out, found, put)
    return F.when(term.startswith('"'), F.concat(F.lit('"'), out, F.lit('"'), tail)).otherwise(term)


def read_dump(spark: SparkSession, path: str, archives: str | None = None) -> DataFrame:
    """The lines (value) of a dump, or, if it can't be read, those of the newest archive in the folder ``archives``."""
    from pyspark.errors import PySparkException

    try:
        lines = spark.read.text(path)
        lines.limit(1).collect()
        return lines
    except PySparkException:
        if archives is None:
            raise
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(archives)
        names = [f.getPath().toString() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
        newest = newest_archive(names)
        if newest is None:
            raise
    return unzipped(spark, newest)


def unzipped(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) of all files in zip archives; an archive is one unit of work."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    for name in archive.namelist():
                        with archive.open(name) as f:
                            lines: list[str] = []
                            for line in io.TextIOWrapper(f, "utf-8"):
                                lines.append(line.rstrip("\r\n"))
                                if len(lines) == 10_000:
                                    yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
                                    lines = []
                            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def newest_archive(names: list[str]) -> str | None:
    """The newest of archive names ``YYYYMMDD-HHMMSS_mmm.zip``, to fall back on when a download fails."""
    import re

    return max((n for n in names if re.fullmatch(r"(?:.*/)?\d{8}-\d{6}_\d{3}\.zip", n)), key=lambda n: n.rpartition("/")[2], default=None)
