"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame operations only.

Every text has counts (words, symbols, repeated lines and word windows) and measures derived from them, whole numbers all.
For each language and source a sketch of each measure counts values in buckets that are exact below 64 and then keep six
bits after the leading one, so a quantile read from it is at most a sixty-fourth too low. Buckets are integers: sketches of
parts, sources or days merge by adding counts, in any order, to the same sketch, and partial aggregation leaves one row for
each bucket of a group in a task, however many documents a source has.

A source's thresholds lie beyond its quartiles by a multiple of their distance (at least a measure's least spread, since
many measures are zero nearly everywhere). A source of few documents is judged by its language's sketch, the sum of its
sources', and a language of few by the sum of all. Documents are joined with the thresholds of their source and those
outside are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize

#: A text with fewer words fails, and so does one of whose words more than so many percent lie in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Quartile distances between a quartile and its threshold.
REACH = 4
#: Documents below which a source, and a language, has no thresholds of its own.
LEAST_DOCS = 100
#: Measures: the expression, whether low values fail too, and the least spread. Shares are in ten thousandths.
MEASURES = {
    "word_length": ("word_chars * 1000 DIV n_words", True, 100),
    "symbol_share": ("n_symbols * 10000 DIV word_chars", False, 50),
    "line_share": ("n_dup_lines * 10000 DIV n_lines", False, 1000),
    "repeat_share": ("n_repeat_words * 10000 DIV n_words", False, 500),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows of one source's documents are spread over so many keys where they meet their thresholds.
SALTS = 16


# ---- counts ----------------------------------------------------------------------------------------------------------


def counts(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, source, n_lines (with a word) and COUNTS of each row of docs; its whole row too if asked."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    out = docs.select(*row, "doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kept = [c for c in out.columns if c != "text"]
    # Steps are columns of their own: what a later step uses more than once is computed once.
    lines = F.expr(f"filter(split(text, '\\n'), x -> x RLIKE '{WORD}')")
    out = out.select(*kept, F.expr(f"regexp_extract_all(text, '{WORD}', 0)").alias("words"), lines.alias("lines"), F.expr("regexp_count(text, '[#*$%&|<>]')").cast("long").alias("n_symbols"))
    windows = F.expr("transform(slice(words, 1, greatest(size(words) - 2, 0)), (x, i) -> concat_ws(' ', x, words[i + 1], words[i + 2]))")
    n_lines = F.size("lines").cast("long")
    out = out.select(
        *kept, "n_symbols", n_lines.alias("n_lines"), (n_lines - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), windows.alias("windows"),
    )
    rest = [c for c in out.columns if c != "windows"]
    # Equal windows are neighbours in a sorted list; only texts that have some are sorted.
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    out = out.select(*rest, F.when(some, F.expr("sort_array(transform(windows, (x, i) -> struct(x AS window, i AS at)))")).alias("sorted"))
    found = F.expr("transform(filter(transform(sorted, (x, i) -> struct(x.at AS at, (i > 0 AND get(sorted, i - 1).window = x.window) OR (i + 1 < size(sorted) AND get(sorted, i + 1).window = x.window) AS twice)), x -> x.twice), x -> x.at)")
    out = out.select(*rest, F.sort_array(found).alias("at"))
    # A repeated window covers its words up to where the next one begins.
    covered = F.expr("aggregate(transform(at, (x, i) -> least(3, coalesce(get(at, i + 1), x + 3) - x)), 0, (a, x) -> a + x)")
    return out.select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def failed() -> Column:
    """The fixed rules, on COUNTS."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


# ---- sketches --------------------------------------------------------------------------------------------------------


def bucket(value: Column) -> Column:
    """The bucket of a whole number from 0: itself below 64, else its bit length and the six bits after its first."""
    bits = F.length(F.bin(value))
    return F.when(value < 64, value).otherwise((bits - 1) * 64 + F.call_function("shiftright", value, bits - 7) - 64)


def lower(at: Column) -> Column:
    """The least number of a bucket."""
    power = F.floor(at / 64).cast("int")
    return F.when(at < 64, at).otherwise(F.call_function("shiftleft", (64 + at % 64).cast("long"), power - 6))


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, bucket and n: one sketch of each measure for each combination of keys. Null measures aren't counted."""
    each = F.array(*[F.struct(F.lit(name).alias("measure"), bucket(F.col(name)).alias("bucket")) for name in MEASURES])
    rows = measured.select(*keys, F.inline(each)).filter("bucket IS NOT NULL")
    return rows.groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of the same keys added up; of fewer keys, those that share them."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, n, q1 and q3 of each sketch. What a window sorts is a sketch: at most some hundreds of buckets."""
    group = W.partitionBy(*keys, "measure")
    below, total = F.sum("n").over(group.orderBy("bucket")), F.sum("n").over(group)
    ranked = sketches.select(*keys, "measure", "bucket", below.alias("below"), total.alias("total"))
    at = lambda k: lower(F.min(F.when(4 * F.col("below") >= k * F.col("total"), F.col("bucket"))))
    return ranked.groupBy(*keys, "measure").agg(F.max("total").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketches: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source and, for each measure, least and most (null: no bound) of sketches by lang, source, measure and bucket."""
    levels = [quartiles(sketches, ["lang", "source"]), quartiles(merged(sketches, ["lang"]), ["lang"]), quartiles(merged(sketches, []), [])]
    names = ["of_source", "of_lang", "of_all"]
    packed = [q.select(*[c for c in q.columns if c in ("lang", "source", "measure")], F.struct("n", "q1", "q3").alias(s)) for q, s in zip(levels, names)]
    both = packed[0].join(packed[1].withColumnRenamed("lang", "its_lang").withColumnRenamed("measure", "its_measure"), F.col("lang").eqNullSafe(F.col("its_lang")) & (F.col("measure") == F.col("its_measure")))
    every = both.drop("its_lang", "its_measure").join(packed[2], "measure")
    enough = lambda s: F.when(F.col(f"{s}.n") >= least_docs, F.col(s))
    used = every.select("lang", "source", "measure", F.coalesce(*map(enough, names[:2]), F.col("of_all")).alias("q"))
    least, most = [], []
    for name, (_, low, spread) in MEASURES.items():
        width = reach * F.greatest(F.col("q.q3") - F.col("q.q1"), F.lit(spread))
        here = F.col("measure") == name
        least.append(F.max(F.when(here & F.lit(low), F.col("q.q1") - width)).alias(f"least_{name}"))
        most.append(F.max(F.when(here, F.col("q.q3") + width)).alias(f"most_{name}"))
    return used.groupBy("lang", "source").agg(*least, *most)


# ---- documents -------------------------------------------------------------------------------------------------------


def measured(counted: DataFrame) -> DataFrame:
    """counted with a column for each measure; null where there is nothing to divide by."""
    zero = {"n_words": "n_words > 0", "word_chars": "word_chars > 0", "n_lines": "n_lines > 0"}
    ratio = {name: F.expr(f"CASE WHEN {zero[e.split(' DIV ')[1]]} THEN {e} END") for name, (e, _, _) in MEASURES.items()}
    return counted.withColumns(ratio)


def judged(counted: DataFrame, bounds: DataFrame) -> DataFrame:
    """counted (as counts() gives it) with base_failed, kept and reasons: the measures that lie outside. A document of a source
    without bounds is outside of none.

    Both sides are dealt by source and a number from the row, so a source of a third of all documents is in many tasks."""
    rows = measured(counted).withColumn("salt", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)))
    spread = bounds.select(F.col("lang").alias("its_lang"), F.col("source").alias("its_source"), *[c for c in bounds.columns if c not in ("lang", "source")], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("its_salt"))
    same = F.col("lang").eqNullSafe(F.col("its_lang")) & F.col("source").eqNullSafe(F.col("its_source")) & (F.col("salt") == F.col("its_salt"))
    out = rows.join(spread, same, "left")
    outside = [F.when((F.col(m) < F.col(f"least_{m}")) | (F.col(m) > F.col(f"most_{m}")), F.lit(m)) for m in MEASURES]
    out = out.withColumn("reasons", F.array_compact(F.array(*outside))).withColumn("base_failed", failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).select(*counted.columns, "base_failed", "kept", "reasons")


def assess(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, source, n_lines, COUNTS, base_failed, kept and reasons of each row of docs (doc_id, text, lang, source).

    Sketches are of the documents that pass the fixed rules. Null texts are empty, and fail; null languages and sources are
    a language and a source of their own; very long texts are counted whole; repeated rows count, and are judged, each;
    values at a threshold are kept. No rows: no rows. Other columns don't matter, whatever their names.
    """
    counted = materialize(counts(docs, carry), "rules-counts")
    passing = measured(counted.filter(~failed()))
    sketches = materialize(sketch(passing, ["lang", "source"]), "rules-sketches")
    return judged(counted, thresholds(sketches))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    return assess(docs, carry=True).filter("kept").select("row.*")
