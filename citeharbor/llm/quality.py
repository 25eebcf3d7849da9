"""Quality rules: word and line counts of each text, and cutoffs that adapt to language and source.

Everything is built-in functions; no Python touches a row. Two fixed rules always hold. The other
cutoffs come from mergeable quantile sketches per language and source: counts on a grid of
logarithmic cells with 10 significant bits, so a quantile is off by at most one part in 512.
Sketches of the sources of a language merge by adding counts, do not depend on partitioning, and
replace those of sources with too few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeharbor.sources.stages import cut

SPACES = r"[\x20\x09-\x0D]+"
NGRAM = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_ROWS = 200  # rows that passed the fixed rules, for a source to have cutoffs of its own
SPREADS = 6  # quartile distances beyond the quartile
# Measures in thousandths, and how far an upper cutoff stays from the quartile at least: these many thousandths
# for measures that are 0 in most texts, a share of the quartile itself for the length of words.
MEASURES = {"word_length": 0, "symbols": 250, "dup_lines": 400}
TWO_SIDED = ("word_length",)
BITS = 10


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _joined(values: Column, by: int) -> Column:
    return F.zip_with(values, _shifted(values, by), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words covered by the windows (given by hash, in order) that occur twice or more."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.zip_with(ordered, _shifted(ordered, 1), lambda x, y: F.when(
        x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")))
    places = F.array_sort(F.array_distinct(F.flatten(pairs)))
    steps = F.zip_with(places, _shifted(places, 1),
                       lambda x, y: F.least(F.lit(NGRAM), F.coalesce(y - x, F.lit(NGRAM))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.withColumn("__words", F.array_remove(F.split(text, SPACES), ""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    hashed = words.select(
        *docs.columns, F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"))
    doubled = reduce(lambda h, by: _joined(h, by), (1, 2, 4), F.col("__hashes"))
    windowed = hashed.withColumn("__windows", F.when(
        F.col("n_words") > NGRAM, F.slice(doubled, 1, F.greatest(F.size("__hashes") - (NGRAM - 1), F.lit(0)))))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    return windowed.select(
        *docs.columns, "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, _covered(F.col("__windows"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _thousandths(part: str, whole: str) -> Column:
    return F.expr(f"CAST(1000 * {part} AS BIGINT) DIV greatest({whole}, 1)")


def with_measures(df: DataFrame) -> DataFrame:
    """Ratios per word in thousandths; repeated lines per 20 words."""
    return df.withColumns({
        "word_length": _thousandths("word_chars", "n_words"),
        "symbols": _thousandths("n_symbols", "n_words"),
        "dup_lines": _thousandths("20 * n_dup_lines", "n_words")})


def cell(value: Column) -> Column:
    """Lower end of the grid cell: the value cut to its ``BITS`` leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    width = F.pow(F.lit(2), shift).cast("long")
    return value - value % width


def sketches(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, cell, n``: how many rows fall into each grid cell."""
    measures = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), cell(F.col(m)).alias("cell")) for m in MEASURES]))
    return df.select(*keys, measures.alias("x")).groupBy(*keys, "x.measure", "x.cell").agg(
        F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, rows, q1, q3`` from a sketch; a group has a bounded number of cells."""
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("cell"))
    placed = sketch.select(*keys, "measure", "cell", upto.alias("upto"), F.sum("n").over(group).alias("rows"))
    return placed.groupBy(*keys, "measure", "rows").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("rows"), F.col("cell"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("rows"), F.col("cell"))).alias("q3"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) of ``sketch``: for each measure ``low_*`` and ``high_*``.

    A source with fewer than ``MIN_ROWS`` rows takes the cutoffs of its language; if that has fewer
    as well, those of all rows.
    """
    by_all = quartiles(merged(sketch, []), []).withColumnRenamed("rows", "rows_all")
    by_lang = quartiles(merged(sketch, ["lang"]), ["lang"])
    by_source = quartiles(sketch, ["lang", "source"])

    def named(df, tag):
        return df.select(*[F.col(c).alias(f"{c}_{tag}") for c in df.columns])

    source, lang, whole = named(by_source, "s"), named(by_lang, "l"), by_all.select(
        F.col("measure").alias("measure_a"), F.col("q1").alias("q1_a"), F.col("q3").alias("q3_a"))
    joined = (
        source.join(lang, F.col("lang_s").eqNullSafe(F.col("lang_l")) & (F.col("measure_s") == F.col("measure_l")))
        .join(whole, F.col("measure_s") == F.col("measure_a")))

    def chosen(q):
        return (F.when(F.col("rows_s") >= MIN_ROWS, F.col(f"{q}_s"))
                .when(F.col("rows_l") >= MIN_ROWS, F.col(f"{q}_l")).otherwise(F.col(f"{q}_a")))

    rows = joined.select(F.col("lang_s").alias("lang"), F.col("source_s").alias("source"),
                         F.col("measure_s").alias("measure"), chosen("q1").alias("q1"), chosen("q3").alias("q3"))
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv]), F.col("measure"))
    own = F.when(F.col("measure").isin(*TWO_SIDED), F.expr("q3 DIV 2")).otherwise(slack.cast("long"))
    spread = SPREADS * (F.col("q3") - F.col("q1"))
    # Downwards no cutoff goes further than half of the quartile, or nothing could fall below it.
    below = F.least(F.greatest(spread, F.expr("q1 DIV 4")), F.expr("q1 DIV 2"))
    fences = rows.select("lang", "source", "measure", (F.col("q1") - below).alias("low"),
                         (F.col("q3") + F.greatest(spread, own)).alias("high"))

    def of(measure, side):
        return F.max(F.when(F.col("measure") == measure, F.col(side))).alias(f"{side}_{measure}")

    return fences.groupBy("lang", "source").agg(
        *[of(m, "high") for m in MEASURES], *[of(m, "low") for m in TWO_SIDED])


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for each row of ``docs``.

    Needs doc_id, text, lang and source; other columns are ignored, whatever their names. A NULL or
    empty text has no words and fails. NULL languages or sources form a group like any other.
    Repeated rows are judged one by one. Cutoffs come from all rows that pass the fixed rules;
    values that equal a cutoff pass.
    """
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang", "source")
    counts = measured(narrow).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    counts = cut(with_measures(counts.withColumn("base_failed", base_failed())))
    passed = counts.filter(~F.col("base_failed"))
    limits = cut(cutoffs(cut(sketches(passed, ["lang", "source"])))).withColumnsRenamed(
        {"lang": "__lang", "source": "__source"})
    judged = counts.join(
        limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    inside = reduce(lambda a, b: a & b, [
        *[F.col(m) <= F.col(f"high_{m}") for m in MEASURES], *[F.col(m) >= F.col(f"low_{m}") for m in TWO_SIDED]])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))
