"""Quality rules by distribution divergence, in DataFrame operations only.

For each document two histograms are counted over the whole text: character classes, and common words of
the languages with one more bin for all other words.  The reference of a language is the sum over all its
documents.  A document is rejected by the method if the Jensen-Shannon distance (base 2, 0 to 1) of one
histogram to its language's reference is over the language's limit: the median of the distances of its
judged documents and a multiple of their median absolute deviation.  Texts with too few characters or
words for a histogram are not judged by it.  Plain counts (symbols, repeated lines,
words in repeated windows) are returned beside it and give the base verdict.

Defined results: a null or blank text has no words and fails the base rule; a null language is a language
of its own; repeated rows are judged one by one and all count for the reference; other columns are
ignored; an empty table gives no rows.  Repeated windows are found by 64-bit hashes of eight word hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8
MIN_WORDS = 20
#: Frequent function words of four languages (fixed values).
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "que",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "nicht",
    "el", "y", "los", "del", "las", "por", "con", "para", "una", "no",
)
#: Least characters and words of a text before its histogram is judged, and the distances over which it fails in any language.
MIN_CHARS, MIN_JUDGED_WORDS = 200, 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.35, 0.6
#: A language's limit is this many deviations over its median; the least deviation keeps short or few texts from failing by chance.
CLASS_DEVIATIONS, WORD_DEVIATIONS = 10.0, 2.5
LEAST_CLASS_DEVIATION, LEAST_WORD_DEVIATION = 0.01, 0.04
#: Median absolute deviation to standard deviation, and the steps in which distances are counted for the medians.
TO_SIGMA, STEPS = 1.4826, 10000


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a lambda's variable isn't inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeat_words(w: Column) -> Column:
    """How many of the words ``w`` stand in a window of WINDOW words that occurs twice or more."""

    def covered(h: Column) -> Column:
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            at,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])).alias("hit"))),
                        lambda x: F.coalesce(x["hit"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        return let(twice, lambda d: F.aggregate(F.transform(d, lambda x, k: F.least(F.coalesce(F.get(d, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x))

    def judged(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))

    def windows(x: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(x) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(x, i, WINDOW))), judged)

    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), windows))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, lang, the base counts, and the two histograms of each document."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")

    def of_words(w: Column) -> Column:
        common = F.filter(w, lambda x: x.isin(*COMMON_WORDS))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
            let(common, lambda f: F.array(*[(F.size(f) - F.size(F.array_remove(f, c))).cast("double") for c in COMMON_WORDS], (F.size(w) - F.size(f)).cast("double"))).alias("word_histogram"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    df = df.select(
        "doc_id",
        F.xxhash64(text).alias("th"),
        "lang",
        let(words(text), of_words).alias("w"),
        F.length(text).cast("long").alias("n_chars"),
        (F.octet_length(text) - F.length(text)).cast("long").alias("n_wide"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count(text, F.lit(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]")).cast("long").alias("n_punctuation"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    classes = [F.col("n_chars") - F.col("w.word_chars"), F.col("n_digits"), F.col("n_punctuation"), F.col("n_upper"), F.col("n_wide"), F.greatest(F.col("w.word_chars") - F.col("n_digits") - F.col("n_punctuation") - F.col("n_upper") - F.col("n_wide"), F.lit(0))]
    return df.select("doc_id", "th", "lang", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", F.array(*[c.cast("double") for c in classes]).alias("class_histogram"), "w.word_histogram")


def total(h: Column) -> Column:
    return F.aggregate(h, F.lit(0.0), lambda a, x: a + x)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null if one has no counts."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def of(s: Column) -> Column:
        both = F.zip_with(p, q, lambda a, b: F.struct((a / s["p"]).alias("a"), (b / s["q"]).alias("b")))
        each = F.transform(both, lambda x: (part(x["a"], (x["a"] + x["b"]) / 2) + part(x["b"], (x["a"] + x["b"]) / 2)) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), total(each)))

    sums = F.struct(total(p).alias("p"), total(q).alias("q"))
    return F.when((total(p) > 0) & (total(q) > 0), let(sums, of))


def limits(distances: DataFrame) -> DataFrame:
    """For each ref_lang the limits of both distances; exact medians of the distances in steps, whatever the order of the rows."""
    each = distances.select("ref_lang", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(k) * STEPS).cast("int").alias("b")) for k in ("class_distance", "word_distance")])).alias("x"))
    bins = each.filter("x.b IS NOT NULL").groupBy("ref_lang", F.col("x.k").alias("k"), F.col("x.b").alias("b")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("ref_lang", "k")

    def median(value: str) -> Column:
        """The least value that half of the counted rows don't exceed."""
        below = F.sum("n").over(group.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return F.when(2 * below >= F.sum("n").over(group), F.col(value))

    bins = bins.withColumn("half", median("b")).withColumn("median", F.min("half").over(group)).withColumn("away", F.abs(F.col("b") - F.col("median")))
    spread = bins.withColumn("half", median("away")).groupBy("ref_lang", "k").agg(F.first("median").alias("median"), F.min("half").alias("deviation"))

    def limit(name: str, times: float, least: float, most: float) -> Column:
        x = F.least(F.lit(most), F.col("median") / STEPS + times * TO_SIGMA * F.greatest(F.col("deviation") / STEPS, F.lit(least)))
        return F.max(F.when(F.col("k") == f"{name}_distance", x)).alias(f"{name}_limit")

    both = [limit("class", CLASS_DEVIATIONS, LEAST_CLASS_DEVIATION, MAX_CLASS_DISTANCE), limit("word", WORD_DEVIATIONS, LEAST_WORD_DEVIATION, MAX_WORD_DISTANCE)]
    return spread.groupBy(F.col("ref_lang").alias("limit_lang")).agg(*both)


def judge(feats: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``feats`` with its distances, base_failed and kept; it is read three times, so give a stored table."""
    n_class, n_word = 6, len(COMMON_WORDS) + 1
    sums = [F.sum(F.col("class_histogram")[i]).alias(f"c{i}") for i in range(n_class)] + [F.sum(F.col("word_histogram")[i]).alias(f"w{i}") for i in range(n_word)]
    # stored, so that its true size decides between broadcasting it and shuffling
    refs = stored(
        feats.groupBy(F.coalesce("lang", F.lit("\0")).alias("ref_lang")).agg(*sums).select("ref_lang", F.array(*[f"c{i}" for i in range(n_class)]).alias("ref_class"), F.array(*[f"w{i}" for i in range(n_word)]).alias("ref_word")),
        "quality-references",
    )
    df = feats.join(refs, F.coalesce(feats["lang"], F.lit("\0")) == refs["ref_lang"], "left")
    df = df.withColumn("class_distance", F.when(total(F.col("class_histogram")) >= MIN_CHARS, js_distance(F.col("class_histogram"), F.col("ref_class"))))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= MIN_JUDGED_WORDS, js_distance(F.col("word_histogram"), F.col("ref_word"))))
    df = df.join(stored(limits(df), "quality-limits"), F.col("ref_lang") == F.col("limit_lang"), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    near = F.coalesce(F.col("class_distance") <= F.col("class_limit"), F.lit(True)) & F.coalesce(F.col("word_distance") <= F.col("word_limit"), F.lit(True))
    df = df.withColumn("base_failed", failed).withColumn("kept", ~failed & near)
    return df.select("doc_id", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def quality(docs: DataFrame) -> DataFrame:
    return judge(stored(features(docs), "quality-features")).drop("th", "lang")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass; all columns stay."""
    good = quality_by_text(docs).filter("kept").select(F.coalesce("doc_id", F.lit(0)).alias("k_id"), F.col("doc_id").isNull().alias("k_null"), "th", F.coalesce("lang", F.lit("")).alias("k_lang")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"))
    doc_id, text, lang = F.col("row.doc_id").cast("long"), F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.col("row.lang").cast("string")
    row = row.select("row", F.coalesce(doc_id, F.lit(0)).alias("k_id"), doc_id.isNull().alias("k_null"), F.xxhash64(text).alias("th"), F.coalesce(lang, F.lit("")).alias("k_lang"))
    return row.join(good, ["k_id", "k_null", "th", "k_lang"], "left_semi").select("row.*")


def quality_by_text(docs: DataFrame) -> DataFrame:
    return judge(stored(features(docs), "quality-features"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL: dict[str, str] = {}
