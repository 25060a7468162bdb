"""Text: tokens, similarities, action parsing, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The action marker, and words that similarity leaves out.
ACTION_MARKER = r"(?im)^\s*Action\s*:\s*"
STOP_WORDS = ("the", "a", "an", "you", "are", "is", "in", "of", "to", "and", "on", "with", "at", "from")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.lower(t))


def token_counts(df: DataFrame, key: str, text: str, stop_words=(), carried=()) -> DataFrame:
    """key, the carried columns that belong to it, token, n."""
    runs = F.explode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("token")
    exploded = df.select(key, *carried, runs).withColumn("token", F.lower("token"))
    if stop_words:
        exploded = exploded.where(~F.col("token").isin(*stop_words))
    return exploded.groupBy(key, *carried, "token").agg(F.count("*").alias("n"))


#: Right rows of a token in one part.
PART = 20_000


def cosine_by_index(left: DataFrame, right: DataFrame, left_key: str, right_key: str, within=(), once: bool = False) -> DataFrame:
    """left_key, right_key, cosine of count vectors, for pairs with a common token that agree in the columns `within`.

    The counts meet on their tokens, so no pair without a common token is looked at; others have cosine 0. A token with more
    than PART rows on the right has these dealt into parts, and only then the left's rows of it are copied to each. once: the
    sides are one table, and of (a, b) and (b, a) only the pair with the smaller key on the left is formed.
    """
    norm = lambda df, k: df.groupBy(k).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(f"{k}_norm"))
    on = ["token", *within]
    parts = right.groupBy(*on).agg(F.ceil(F.count("*") / PART).cast("int").alias("__parts"))
    asked = left.select(left_key, *on, F.col("n").alias("__n_left")).join(parts, on)
    asked = asked.select(left_key, *on, "__n_left", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
    found = right.join(parts, on).select(right_key, *on, F.col("n").alias("__n_right"), F.pmod(F.xxhash64(right_key), F.col("__parts")).cast("int").alias("__part"))
    met = asked.join(found, [*on, "__part"])
    if once:
        met = met.where(F.col(left_key) < F.col(right_key))
    dots = met.groupBy(left_key, right_key).agg(F.sum(F.col("__n_left") * F.col("__n_right")).alias("dot"))
    return dots.join(norm(left, left_key), left_key).join(norm(right, right_key), right_key).select(left_key, right_key,
        (F.col("dot") / (F.col(f"{left_key}_norm") * F.col(f"{right_key}_norm"))).alias("cosine"))


def jaccard(left: Column, right: Column) -> Column:
    """Of two sets as arrays; null for two empty ones."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, None).otherwise(F.size(F.array_intersect(left, right)) / union)


# What is taken off an action's text, and the spellings that stand for one action.
ACTION_SPELLINGS = (
    (r"^[`\"' \t\r\n]+|[`\"' \t\r\n]+$", ""),
    (r"\s+", " "),
    (r"[.;]+$", ""),
    (r"(?i)^put\s+(.+?)\s+(?:in|on|into|onto)\s+(.+)$", "move $1 to $2"),
    (r"(?i)^(clean|heat|cool)\s+(.+?)\s+using\s+(.+)$", "$1 $2 with $3"),
)


def normalise_action(text: Column) -> Column:
    """Quotes and spaces off, one space inside, no trailing stops, one spelling of put and of using, lower case."""
    value = F.coalesce(text, F.lit(""))
    for pattern, to in ACTION_SPELLINGS:
        value = F.regexp_replace(value, pattern, to)
    return F.lower(value)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def parse_action(response: Column, admissible: Column, unique_prefix: bool = False) -> Column:
    """struct(candidate, normalized, action, valid, had_marker, failure); each text is normalised once."""
    stripped = F.regexp_replace(F.coalesce(response, F.lit("")), r"^\s+|\s+$", "")
    allowed = F.transform(admissible, lambda a: F.struct(F.trim(a).alias("action"), normalise_action(a).alias("norm")))

    def judged(x: Column) -> Column:
        hits = F.filter(x["allowed"], lambda a: a["norm"] == x["norm"])
        one = F.when(F.size(hits) == 1, hits[0]["action"])
        if unique_prefix:
            longer = F.filter(x["allowed"], lambda a: F.startswith(a["norm"], F.concat(x["norm"], F.lit(" "))))
            one = F.coalesce(one, F.when((F.size(hits) == 0) & (F.size(longer) == 1), longer[0]["action"]))
        action = F.when((x["markers"] == 1) & (x["norm"] != ""), one)
        failure = (
            F.when(x["text"] == "", "empty_content").when(x["markers"] == 0, "missing_action_marker").when(x["markers"] > 1, "multiple_action_markers")
            .when(x["norm"] == "", "empty_action").when(action.isNotNull(), None).when(F.size(hits) > 1,
                "ambiguous_normalized_action").otherwise("not_admissible")
        )
        known = x["markers"] == 1
        return F.struct(F.when(known, x["candidate"]).otherwise("").alias("candidate"), F.when(known, x["norm"]).otherwise("").alias("normalized"),
            action.alias("action"), action.isNotNull().alias("valid"), (x["markers"] > 0).alias("had_marker"), failure.alias("failure"))

    def found(text: Column) -> Column:
        candidate = F.trim(F.regexp_extract(text, rf"{ACTION_MARKER}([^\r\n]*)", 1))
        return _let(F.struct(text.alias("text"), F.regexp_count(text, F.lit(ACTION_MARKER)).alias("markers"), candidate.alias("candidate"),
            normalise_action(candidate).alias("norm"), allowed.alias("allowed")), judged)

    return _let(stripped, found)


def task_description(text: Column, label: str = "Your task is to") -> Column:
    """What follows the label on its line, else the last paragraph."""
    found = F.regexp_extract(text, rf"(?i){label}:?\s*([^\n]+)", 1)
    return F.when(found != "", F.trim(found)).otherwise(F.trim(F.element_at(F.split(F.trim(text), r"\n\s*\n"), -1)))


def type_from_path(path: Column) -> Column:
    """The directory above the file's, up to its first hyphen."""
    return F.split(F.element_at(F.split(path, "/"), -3), "-")[0]


def admissible_block(actions: Column) -> Column:
    return F.array_join(F.transform(actions, lambda a: F.concat(F.lit("- "), a)), "\n")


def capped_list(actions: Column, most: int = 30) -> Column:
    """The first actions joined by '; ', and how many more there are."""
    more = F.size(actions) - most
    return F.concat(F.array_join(F.slice(actions, 1, most), "; "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
