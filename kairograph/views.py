"""Versioned views of the driver's tables, in DataFrames and in the same words as SQL common table expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairograph.functions.terms import RDF, RDFS, XSD
from kairograph.operators.store import at, sentinel

EX = "urn:ex:"
T_EV = dt.datetime(2024, 1, 15)
T_OR = dt.datetime(1998, 1, 1)
T_DIM = dt.datetime(2000, 1, 1)
COPY_TIMES = [dt.datetime(1996 + k, 1, 1) for k in range(5)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iri(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"<{EX}{kind}"), key.cast("string"), F.lit(">"))


def _integer(value: Column) -> Column:
    return F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{XSD}integer>'))


def _with_graph(df: DataFrame, graph: str | None = None) -> DataFrame:
    return df.select(F.lit(graph).cast("string").alias("g"), "s", "p", "o", "valid_from", "valid_until")


def v_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: the value of a user and type is valid until the next one."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    df = e.select(_iri("user/", F.col("user_id")).alias("s"), _iri("", F.col("event_type")).alias("p"), _integer(F.floor(F.col("value") * 100 + 0.5).cast("bigint")).alias("o"), F.col("ts").alias("valid_from"), F.coalesce(F.lead("ts").over(w), sentinel()).alias("valid_until"))
    return _with_graph(df, f"<{EX}events>")


def v_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: a customer's status is valid until the next order; facts recur and intervals may be empty."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    df = o.select(_iri("customer/", F.col("o_custkey")).alias("s"), F.lit(f"<{EX}orderStatus>").alias("p"), F.concat(F.lit('"'), "o_orderstatus", F.lit('"')).alias("o"), F.col("o_orderdate").alias("valid_from"), F.coalesce(F.lead("o_orderdate").over(w), sentinel()).alias("valid_until"))
    return _with_graph(df)


def v_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, nations, regions and suppliers as open facts."""
    c, n, r, s = (table(spark, sf_dir, x) for x in ("customer", "nation", "region", "supplier"))
    quoted = lambda x: F.concat(F.lit('"'), F.col(x), F.lit('"'))
    parts = [
        c.select(_iri("customer/", F.col("c_custkey")).alias("s"), F.lit(f"<{EX}partOf>").alias("p"), _iri("nation/", F.col("c_nationkey")).alias("o")),
        c.select(_iri("customer/", F.col("c_custkey")).alias("s"), F.lit(f"<{EX}segment>").alias("p"), F.concat(F.lit('"'), "c_mktsegment", F.lit('"@en')).alias("o")),
        c.select(_iri("customer/", F.col("c_custkey")).alias("s"), F.lit(f"<{EX}balance>").alias("p"), _integer(F.floor("c_acctbal").cast("bigint")).alias("o")),
        n.select(_iri("nation/", F.col("n_nationkey")).alias("s"), F.lit(f"<{EX}partOf>").alias("p"), _iri("region/", F.col("n_regionkey")).alias("o")),
        n.select(_iri("nation/", F.col("n_nationkey")).alias("s"), F.lit(f"<{RDFS}label>").alias("p"), quoted("n_name").alias("o")),
        r.select(_iri("region/", F.col("r_regionkey")).alias("s"), F.lit(f"<{RDFS}label>").alias("p"), quoted("r_name").alias("o")),
        s.select(_iri("supplier/", F.col("s_suppkey")).alias("s"), F.lit(f"<{EX}basedIn>").alias("p"), _iri("nation/", F.col("s_nationkey")).alias("o")),
    ]
    df = parts[0]
    for x in parts[1:]:
        df = df.unionByName(x)
    return _with_graph(df.withColumn("valid_from", at(dt.datetime(1990, 1, 1))).withColumn("valid_until", sentinel()))


def v_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as instances: the status is the class, valid from the order's day; classes have labels and a parent."""
    o = table(spark, sf_dir, "orders")
    inst = o.select(_iri("order/", F.col("o_orderkey")).alias("s"), F.lit(f"<{RDF}type>").alias("p"), _iri("class/", F.col("o_orderstatus")).alias("o"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("INTERVAL 900 DAYS")).alias("valid_until"))
    classes = o.select("o_orderstatus").distinct()
    meta = [classes.select(_iri("class/", F.col("o_orderstatus")).alias("s"), F.lit(p).alias("p"), v.alias("o")) for p, v in ((f"<{RDF}type>", F.lit(f"<{RDFS}Class>")), (f"<{RDFS}label>", F.concat(F.lit('"status '), "o_orderstatus", F.lit('"'))), (f"<{RDFS}subClassOf>", F.lit(f"<{EX}class/Order>")))]
    df = inst
    for m in meta:
        df = df.unionByName(m.withColumn("valid_from", at(dt.datetime(1990, 1, 1))).withColumn("valid_until", sentinel()))
    return _with_graph(df)


def v_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the whole text as a literal with its language, and the quality label of some."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    a = d.select(_iri("doc/", F.col("doc_id")).alias("s"), F.lit(f"<{EX}title>").alias("p"), F.concat(F.lit('"'), F.coalesce("text", F.lit("")), F.lit('"@'), "lang").alias("o"))
    b = q.select(_iri("doc/", F.col("doc_id")).alias("s"), F.lit(f"<{EX}quality>").alias("p"), _integer(F.col("quality")).alias("o"))
    return _with_graph(a.unionByName(b).withColumn("valid_from", at(dt.datetime(1990, 1, 1))).withColumn("valid_until", sentinel()))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent copies: snapshots of the orders at five times, in one scan."""
    times = F.array(*[F.struct(F.lit(k).alias("version"), at(t).alias("t")) for k, t in enumerate(COPY_TIMES)])
    df = v_or(spark, sf_dir).withColumn("x", F.explode(F.filter(times, lambda x: (F.col("valid_from") <= x["t"]) & (F.col("valid_until") > x["t"]))))
    return df.select(F.col("x.version").alias("version"), "s", "p", "o").distinct()


# --- the same in SQL

SENT = "TIMESTAMP '9999-12-30 22:00:00'"


def ts(t: dt.datetime) -> str:
    return f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}'"


def sql_integer(x: str) -> str:
    return f"""('"' || CAST({x} AS BIGINT) || '"^^<{XSD}integer>')"""


SQL = {
    "ev": f"""ev AS (SELECT '<{EX}user/' || user_id || '>' AS s, '<{EX}' || event_type || '>' AS p, {sql_integer("FLOOR(value * 100 + 0.5)")} AS o,
        CAST(FLOOR(value * 100 + 0.5) AS BIGINT) AS v, ts AS vf, COALESCE(LEAD(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), {SENT}) AS vu FROM events)""",
    "ord": f"""ord AS (SELECT '<{EX}customer/' || o_custkey || '>' AS s, '<{EX}orderStatus>' AS p, '"' || o_orderstatus || '"' AS o, o_orderdate AS vf,
        COALESCE(LEAD(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), {SENT}) AS vu FROM orders)""",
    "dim": f"""dim AS (SELECT '<{EX}customer/' || c_custkey || '>' AS s, '<{EX}partOf>' AS p, '<{EX}nation/' || c_nationkey || '>' AS o FROM customer
        UNION ALL SELECT '<{EX}customer/' || c_custkey || '>', '<{EX}segment>', '"' || c_mktsegment || '"@en' FROM customer
        UNION ALL SELECT '<{EX}customer/' || c_custkey || '>', '<{EX}balance>', {sql_integer("FLOOR(c_acctbal)")} FROM customer
        UNION ALL SELECT '<{EX}nation/' || n_nationkey || '>', '<{EX}partOf>', '<{EX}region/' || n_regionkey || '>' FROM nation
        UNION ALL SELECT '<{EX}nation/' || n_nationkey || '>', '<{RDFS}label>', '"' || n_name || '"' FROM nation
        UNION ALL SELECT '<{EX}region/' || r_regionkey || '>', '<{RDFS}label>', '"' || r_name || '"' FROM region
        UNION ALL SELECT '<{EX}supplier/' || s_suppkey || '>', '<{EX}basedIn>', '<{EX}nation/' || s_nationkey || '>' FROM supplier)""",
    "typed": f"""typed AS (SELECT '<{EX}order/' || o_orderkey || '>' AS s, '<{RDF}type>' AS p, '<{EX}class/' || o_orderstatus || '>' AS o, o_orderdate AS vf, o_orderdate + INTERVAL 900 DAY AS vu FROM orders)""",
    "doc": f"""doc AS (SELECT '<{EX}doc/' || doc_id || '>' AS s, COALESCE(text, '') AS txt, '"' || COALESCE(text, '') || '"' AS title, lang FROM documents)""",
    "copies": "copies AS (" + " UNION ALL ".join(f"SELECT {k} AS version, s, p, o FROM (SELECT DISTINCT s, p, o FROM ord WHERE vf <= {ts(t)} AND vu > {ts(t)}) c{k}" for k, t in enumerate(COPY_TIMES)) + ")",
}
