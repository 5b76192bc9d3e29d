"""Mixing sources to target weights by temperature.

A source with a share p of all tokens gets the weight p^x / sum(p^x).  The exponent x in [0, 1] is found
by bisection: the entropy of the weights is to reach a target, and no source may be repeated more often
than a limit; the larger exponent (nearer to the natural shares) of the two holds.  The total budget is
the least one in which every document is used at least once, unless ``total`` tokens are asked for.  Each
source's budget is realised as whole passes over its blocks, each in a permutation of its own, and a last
part of a pass.

Blocks are hash buckets of documents of about BLOCK_TOKENS tokens, so the largest source is only more
blocks.  Sums over sources and blocks are aggregates; nothing is gathered but the sums for 33 exponents
at a time.

Defined results: tokens are words, a null or blank text has none; documents without tokens follow their
block; a source without tokens is used once; a null source counts as the empty name; repeated rows share
a block and are scheduled one by one; other columns are ignored (kept by :func:`remix`); an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

BLOCK_TOKENS = 1 << 16
#: Blocks of a small source, so that a part of a pass can be met.
LEAST_BLOCKS = 64
#: Part of the way from the natural entropy to that of equal weights; most passes over a source.
ENTROPY_GAIN, REPETITIONS = 0.5, 2.0
SEED = 17
#: Exponents tried at once, and rounds: the bracket shrinks by 32 in each.
_GRID, _ROUNDS = 32, 5
#: Slices of a permutation, so that no window holds all blocks of a source.
_SLICES = 256


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_name(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def entropy_exponent(shares: DataFrame, gain: float) -> float:
    """The exponent at which the entropy is ``gain`` of the way up; shares: a column p, all over 0."""
    natural, low, high = None, 0.0, 1.0
    for _ in range(_ROUNDS):
        grid = [low + (high - low) * k / _GRID for k in range(_GRID + 1)]
        row = shares.agg(F.count("p").alias("k"), F.sum(F.col("p") * F.log("p")).alias("h"), *[F.sum(F.pow("p", F.lit(x))).alias(f"a{i}") for i, x in enumerate(grid)], *[F.sum(F.pow("p", F.lit(x)) * F.log("p")).alias(f"b{i}") for i, x in enumerate(grid)]).first()
        if not row["k"]:
            return 1.0
        if natural is None:
            natural = -row["h"]
        target = natural + gain * (math.log(row["k"]) - natural)
        # entropy falls as the exponent grows
        good = [i for i, x in enumerate(grid) if math.log(row[f"a{i}"]) - x * row[f"b{i}"] / row[f"a{i}"] >= target - 1e-12]
        k = max(good, default=0)
        low, high = grid[k], grid[min(k + 1, _GRID)]
    return round(low, 6)


def repetition_exponent(least: float, most: float, limit: float) -> float:
    """The smallest exponent at which the source of share ``least`` is passed ``limit`` times at most while that of ``most`` is passed once."""
    low, high = 0.0, 1.0
    if (least / most) ** (low - 1) <= limit:
        return 0.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if (least / most) ** (x - 1) > limit else (low, x)
    return round(high, 6)


def plan(counts: DataFrame, gain: float = ENTROPY_GAIN, limit: float = REPETITIONS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, schedule) for a table of doc_id, src, n_tokens that is read a few times; total: tokens of the whole mixture.

    sources: src, weight, exponent, budget, blocks.  schedule: src, block, epoch, tokens of the source's stream before it.
    Both are stored, so that their true size decides whether they are broadcast.
    """
    sums = stored(counts.groupBy("src").agg(F.sum("n_tokens").alias("t")), "mix-sums")
    bounds = sums.agg(F.sum("t").alias("all"), F.max("t").alias("most"), F.min(F.when(F.col("t") > 0, F.col("t"))).alias("least")).first()
    every, most = float(bounds["all"] or 0), float(bounds["most"] or 0)
    x = 1.0
    if most:
        shares = sums.filter("t > 0").select((F.col("t") / F.lit(every)).alias("p"))
        x = max(entropy_exponent(shares, gain), repetition_exponent(bounds["least"] / every, most / every, limit))
    # with the largest source passed once, another of t tokens is passed (t / most)^(x - 1) times
    power, scale = F.pow(F.col("t") / F.lit(most or 1.0), F.lit(x - 1)), 1.0
    if total is not None and most:
        scale = total / sums.filter("t > 0").agg(F.sum(F.col("t") * power).alias("b")).first()["b"]
    passes = F.when(F.col("t") > 0, F.round(power * F.lit(scale), 9)).otherwise(F.lit(1.0))
    sources = sums.select("src", "t", passes.alias("passes"), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("t") / F.lit(block_tokens))).cast("long").alias("blocks"), F.lit(x).alias("exponent"))
    budget = sources.agg(F.sum(F.col("t") * F.col("passes")).alias("b")).first()["b"] or 1.0
    sources = stored(sources.withColumn("budget", F.round(F.col("t") * F.col("passes"), 3)).withColumn("weight", F.round(F.col("budget") / F.lit(budget), 9)), "mix-sources")
    blocks = with_block(counts, sources, seed).groupBy("src", "block").agg(F.sum("n_tokens").alias("n"))
    each = blocks.join(sources.select("src", "t", "passes", "budget"), "src").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("passes")).cast("int") - 1))))
    each = each.withColumn("rank", F.xxhash64(F.lit(seed), "src", "epoch", "block")).withColumn("slice", F.shiftrightunsigned("rank", 64 - int(math.log2(_SLICES))))
    inside = Window.partitionBy("src", "epoch", "slice").orderBy(F.shiftrightunsigned("rank", 1), "block").rowsBetween(Window.unboundedPreceding, -1)
    slices = each.groupBy("src", "epoch", "slice").agg(F.sum("n").alias("slice_n"))
    across = Window.partitionBy("src", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slice_before", F.coalesce(F.sum("slice_n").over(across), F.lit(0))).drop("slice_n")
    each = each.withColumn("in_slice", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(slices, ["src", "epoch", "slice"])
    each = each.withColumn("before", F.col("epoch") * F.col("t") + F.col("slice_before") + F.col("in_slice"))
    # of the last pass those blocks that begin inside the budget; the first is whole unless a total asks for less
    first = (F.col("epoch") == 0) if total is None else F.col("t") == 0
    each = each.filter(first | (F.col("before") < F.col("budget")))
    return sources, stored(each.select("src", "block", "epoch", "before"), "mix-schedule")


def with_block(counts: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    of = sources.select(F.col("src").alias("s_src"), "blocks")
    return counts.join(of, counts["src"] == of["s_src"]).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("blocks"))).drop("s_src", "blocks")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The schedule by document: one row for each pass that uses it.  mix_key, the part of the source's budget before it, orders the mixture."""
    counts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("src"), tokens(F.col("text")).alias("n_tokens")), "mix-counts")
    sources, schedule = plan(counts, **parameters)
    out = with_block(counts, sources, parameters.get("seed", SEED)).join(schedule, ["src", "block"]).join(sources.select("src", "weight", "exponent", "budget"), "src")
    key = F.round(F.col("before") / F.greatest(F.col("budget"), F.lit(1.0)), 9)
    return out.select("doc_id", F.col("src").alias("source"), "n_tokens", "epoch", "block", key.alias("mix_key"), "weight", "exponent")


def remix(docs: DataFrame, **parameters) -> DataFrame:
    """The documents themselves in the order of the mixture, each as often as the schedule uses it; columns stay."""
    names = docs.columns
    counts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("src"), tokens(F.col("text")).alias("n_tokens")), "mix-counts")
    sources, schedule = plan(counts, **parameters)
    seed = parameters.get("seed", SEED)
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("src"))
    out = with_block(rows, sources, seed).join(schedule, ["src", "block"]).join(sources.select("src", "budget"), "src")
    key = F.col("before") / F.greatest(F.col("budget"), F.lit(1.0))
    return out.select("row", key.alias("mix_key"), F.xxhash64(F.lit(seed), "epoch", "doc_id").alias("tie")).repartitionByRange("mix_key", "tie").sortWithinPartitions("mix_key", "tie").select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op1_mixing": op1_mixing}
ORACLE_SQL: dict[str, str] = {}
