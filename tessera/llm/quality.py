"""Quality rules: one table of thresholds, compiled into one projection of built-in functions.

Cases: a null text has no words and no lines and fails on its length; an empty text likewise; texts of any
length cost n log n at most; repeated rows are judged alike; an empty table gives an empty one; extra columns pass through `stage`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, SPACE_RUN, let

#: Frequent short words of running text in English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be this by from or an at he his not which a "
    "der die und das den von zu mit ist ein eine nicht sich auf des im dem für auch es "
    "le la les de et en un une du des que qui est pour dans par sur pas au plus avec "
    "el los las y que en un una por con para se del al es lo como más su"
).split()

#: (rule, measure, lower bound or None, upper bound or None, words from which the rule holds): a text is kept when
#: every measure is within its bounds.
THRESHOLDS = (
    ("length_words", "n_words", 10, None, 0),
    ("word_length", "mean_word_length", 2.0, 12.0, 10),
    ("symbols", "symbols_per_word", None, 0.3, 10),
    ("stop_words", "stop_ratio", 0.02, None, 40),
    ("repeated_lines", "dup_line_ratio", None, 0.5, 10),
    ("repeated_windows", "repeat_word_ratio", None, 0.2, 10),
    ("stuttering", "stutter_ratio", None, 0.3, 10),
    ("table_rows", "bar_ratio", None, 0.3, 10),
    ("shouting", "upper_word_ratio", None, 0.6, 10),
)
WINDOW = 5
#: Columns that `measures` and `verdicts` add.
RESERVED = ("quality_measures", "base_failed", "failed_rules", "kept")


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside five-word windows that the text has twice or more.

    Hashes of windows only say that there can be no repeat; where there may be one, windows are compared as text.
    """
    at = lambda i: F.get(hashes, i)
    n = F.size(words)
    windows = F.transform(F.slice(hashes, 1, n - (WINDOW - 1)), lambda h, i: F.xxhash64(h, *[at(i + k) for k in range(1, WINDOW)]))
    ordered = F.array_sort(F.transform(F.slice(words, 1, n - (WINDOW - 1)), lambda _,
        i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
    twice = let(ordered, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a,
        b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    start = F.struct(F.lit(0).alias("covered"), F.lit(-WINDOW).alias("last"))
    step = lambda acc, p: F.struct((acc["covered"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("covered"), p.alias("last"))
    covered = F.aggregate(F.sort_array(F.array_distinct(F.flatten(twice))), start, step, lambda acc: acc["covered"])
    may = let(windows, lambda h: F.size(h) > F.size(F.array_distinct(h)))
    return F.when(n < WINDOW + 1, 0).when(may, covered).otherwise(0).cast("long")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a struct column `quality_measures` of counts and ratios; a column of df with a name used here goes."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in RESERVED]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = df.select(*kept, F.filter(F.split(body, SPACE_RUN, -1), lambda w: w != "").alias("__words"))
    hashed = split.select(*kept, "__words", F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"))
    words, n = F.col("__words"), F.size("__words")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    letters = F.translate(body, SPACE_CHARS, "")
    per = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    counted = hashed.select(
        *kept,
        n.cast("long").alias("__n_words"),
        F.length(letters).cast("long").alias("__word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("__n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("__lines"),
        _repeat_words(words, F.col("__hashes")).alias("__n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(F.translate(w, ".,;:!?", "")).isin(*STOP_WORDS))).cast("long").alias("__n_stop"),
        F.size(F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1))).cast("long").alias("__n_upper"),
        F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda x, y: x == y), lambda x: x)).cast("long").alias("__n_stutter"),
        F.regexp_count(body, F.lit(r"\|")).cast("long").alias("__n_bars"),
    )
    c = F.col
    return counted.select(
        *kept,
        F.struct(
            c("__n_words").alias("n_words"),
            c("__word_chars").alias("word_chars"),
            c("__n_symbols").alias("n_symbols"),
            c("__lines.all").alias("n_lines"),
            c("__lines.dup").alias("n_dup_lines"),
            c("__n_repeat_words").alias("n_repeat_words"),
            per(c("__word_chars"), c("__n_words")).alias("mean_word_length"),
            per(c("__n_symbols"), c("__n_words")).alias("symbols_per_word"),
            per(c("__n_stop"), c("__n_words")).alias("stop_ratio"),
            per(c("__lines.dup"), c("__lines.all")).alias("dup_line_ratio"),
            per(c("__n_repeat_words"), c("__n_words")).alias("repeat_word_ratio"),
            per(c("__n_upper"), c("__n_words")).alias("upper_word_ratio"),
            per(c("__n_stutter"), c("__n_words")).alias("stutter_ratio"),
            per(c("__n_bars"), c("__n_words")).alias("bar_ratio"),
        ).alias("quality_measures"),
    )


def verdicts(measured: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """measured with `base_failed`, `failed_rules` and `kept`; a ratio without words passes, the length rule decides."""
    m = lambda name: F.col(f"quality_measures.{name}")
    broken = []
    for rule, name, low, high, from_words in thresholds:
        out = F.lit(False)
        if low is not None:
            out = out | (m(name) < F.lit(low))
        if high is not None:
            out = out | (m(name) > F.lit(high))
        broken.append(F.when((m("n_words") >= from_words) & F.coalesce(out, F.lit(False)), F.lit(rule)))
    base = (m("n_words") < 10) | (100 * m("n_repeat_words") > 20 * m("n_words"))
    failed = F.array_compact(F.array(*broken))
    return measured.select("*", base.alias("base_failed"), failed.alias("failed_rules")).select("*",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = [f"quality_measures.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return verdicts(measures(docs)).select("doc_id", *counts, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule, with their columns, whatever their names."""
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("text").alias("quality_text"))
    # A filter on `kept` would be pushed below the projections and spell out every measure wherever a rule names it; a row
    # that is made once or not at all stays above them.
    once = F.explode(F.when(F.col("kept"), F.array(F.lit(True)))).alias("once")
    return verdicts(measures(boxed, "quality_text")).select("whole", once).select("whole.*")
