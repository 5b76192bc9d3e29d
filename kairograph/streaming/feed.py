"""A feed of dumps whose one literal changes, to try a tracker out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from kairograph.functions.terms import XSD

#: Four facts about one subject; the last holds a count that changes with every dump.
SUBJECT = "<urn:feed:country>"


def dump_lines(count: int) -> list[str]:
    facts = [("area", f'"1.12E8"^^<{XSD}double>'), ("topLevelDomain", "<urn:feed:tld>"), ("abstract", '"A country\\nwith two lines"@en'), ("population", f'"{count}"^^<{XSD}nonNegativeInteger>')]
    return [f"{SUBJECT} <urn:feed:{p}> {o} ." for p, o in facts]


def put_dump(spark: SparkSession, folder: str, t: dt.datetime, count: int) -> str:
    """Write one dump below ``folder`` under a name with its instant, complete as soon as it is seen."""
    jvm = spark._jvm
    name = f"feed_{t:%Y%m%d-%H%M%S}_{t.microsecond // 1000:03d}.nt"
    target, part = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), jvm.org.apache.hadoop.fs.Path(f"{folder}/_{name}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(("\n".join(dump_lines(count)) + "\n").encode()))
    out.close()
    fs.rename(part, target)
    return f"{folder}/{name}"
