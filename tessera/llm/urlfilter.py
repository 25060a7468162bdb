"""URL filter: host and path rules first, then gradient-boosted trees over lexical features.

The tables carry no judgement of URLs, so labels are weak ones: a URL is bad if its host holds a word of a seed list, good if
not. The trees never see words, only lengths, depth, ratios, entropy, counts and suffix statistics, so they judge hosts by
their form and find bad ones whose words no seed names; `withheld` measures that, by leaving a seed's URLs out of the fit.
The fit reads at most `most` labelled rows, half of each kind where there are so many, the first by a hash of the URL. A
suffix's rate of bad URLs is taken, for a row of the fit, from the other folds of hosts only; there are rates of the host's last
label, last two and last three, each backed by the shorter one's where rows are few. Every URL is judged.

Cases: a null URL or one without `://` has an empty host and path, fits no rule and is judged by its features, all zero for
null; repeated rows are judged alike; if all URLs of the table are of one kind, those without a rule get that kind's verdict; rules
of equal length that fit are decided by their order, the later one holds; URLs of any length are judged whole; an empty table
gives an empty one; other columns play no part, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, durable, let

#: The rules, (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words of hosts that are labelled bad.
SEEDS = ("casino", "bets", "pills", "ads-track", "spam", "adult")
MAX_LABELLED = 20_000
#: Labels of a suffix, from the least specific on.
LEVELS = (1, 2, 3)
#: Folds of hosts, by which a row's suffix statistics leave out its own.
FOLDS = 5
#: Rows of the shorter suffix's rate that a suffix's own are mixed with.
BACKING = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    n = F.length(text)
    one = lambda c: let((n - F.length(F.replace(text, c, F.lit("")))) / n, lambda p: -p * F.log2(p))
    return F.aggregate(F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c != "", one(c)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


#: Lexical features by name; each takes url, host and path.
FEATURES = {
    "url_length": lambda u, h, p: F.length(u),
    "host_length": lambda u, h, p: F.length(h),
    "path_length": lambda u, h, p: F.length(p),
    "path_depth": lambda u, h, p: F.size(F.filter(F.split(p, "/"), lambda x: x != "")),
    "host_labels": lambda u, h, p: F.size(F.split(h, "[.]")),
    "host_hyphens": lambda u, h, p: F.regexp_count(h, F.lit("-")),
    "digit_ratio": lambda u, h, p: F.coalesce(F.try_divide(F.regexp_count(u, F.lit("[0-9]")).cast("double"), F.length(u).cast("double")), F.lit(0.0)),
    "host_entropy": lambda u, h, p: _entropy(h),
    "url_entropy": lambda u, h, p: _entropy(u),
    "parameters": lambda u, h, p: F.regexp_count(F.regexp_extract(u, r"[?]([^#]*)", 1), F.lit("[^&]+")),
    "fragment": lambda u, h, p: F.instr(u, "#").cast("boolean").cast("int"),
    "longest_label": lambda u, h, p: F.array_max(F.transform(F.split(h, "[.]"), lambda x: F.length(x))),
}


def featured(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, suffixes (the host's last label, last two and last three) and the features."""
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    made = [F.coalesce(f(F.col("url"), F.col("host"), F.col("path")).cast("double"), F.lit(0.0)).alias(name) for name, f in FEATURES.items()]
    labels = F.split("host", "[.]")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k, F.lit(0)) + 1, F.lit(k)), ".")
    return cut.select("*", *[last(k).alias(f"suffix_{k}") for k in LEVELS], *made)


def is_bad(host: Column, seeds=SEEDS) -> Column:
    bad = F.lit(False)
    for s in seeds:
        bad = bad | F.contains(host, F.lit(s))
    return bad


def labelled(rows: DataFrame, seeds=SEEDS, most: int = MAX_LABELLED) -> DataFrame:
    """At most `most` rows with `label` and `fold`, half of them of a kind, so a rare kind is there: the first by hash."""
    known = rows.select("*", is_bad(F.col("host"), seeds).cast("double").alias("label"), F.pmod(F.xxhash64("host"), F.lit(FOLDS)).alias("fold"))
    first = lambda kind: known.where(F.col("label") == kind).orderBy(F.xxhash64("url"), "page_id").limit(most // 2)
    return first(1.0).unionByName(first(0.0))


def _suffix_statistics(bad: str, n: str, prior: float) -> list[Column]:
    """A rate and a count for each level; what a suffix lacks in rows comes from the shorter one's rate."""
    out, rate = [], F.lit(float(prior))
    for k in LEVELS:
        here_bad, here_n = F.coalesce(F.col(f"{bad}_{k}"), F.lit(0.0)), F.coalesce(F.col(f"{n}_{k}"), F.lit(0))
        rate = (here_bad + BACKING * rate) / (here_n + BACKING)
        out += [rate.alias(f"suffix_rate_{k}"), F.log1p(here_n).alias(f"suffix_count_{k}")]
    return out


def fitted(rows: DataFrame, seeds=SEEDS, most: int = MAX_LABELLED):
    """rows -> rows with `score`, by trees fitted to a sample; None if the sample holds one kind, and that kind's rate."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    sample = durable(labelled(rows, seeds, most), "labelled-urls")
    kinds = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    prior = kinds.get(1.0, 0) / max(1, sum(kinds.values()))
    if len(kinds) < 2:
        return None, prior
    # as many suffixes of a level as labelled rows at most
    learned, of_all = sample, []
    for k in LEVELS:
        by_fold = sample.groupBy(f"suffix_{k}", "fold").agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
        whole = durable(by_fold.groupBy(f"suffix_{k}").agg(F.sum("bad").alias(f"bad_{k}"), F.sum("n").alias(f"n_{k}")), "suffixes")
        of_all.append(whole)
        learned = learned.join(F.broadcast(by_fold), [f"suffix_{k}", "fold"]).join(F.broadcast(whole), f"suffix_{k}")
        learned = learned.withColumns({f"other_bad_{k}": F.col(f"bad_{k}") - F.col("bad"), f"other_n_{k}": F.col(f"n_{k}") - F.col("n")}).drop("bad", "n")
    statistics = [f"suffix_{what}_{k}" for k in LEVELS for what in ("rate", "count")]
    vectors = VectorAssembler(inputCols=[*FEATURES, *statistics], outputCol="features")
    learned = learned.select(*FEATURES, "label", *_suffix_statistics("other_bad", "other_n", prior))
    trees = GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.3, seed=7, checkpointInterval=-1).fit(vectors.transform(learned).select("features", "label"))
    discard(sample)

    def scored(df: DataFrame) -> DataFrame:
        told = df
        for k, whole in zip(LEVELS, of_all):
            told = told.join(F.broadcast(whole), f"suffix_{k}", "left")
        told = told.select("*", *_suffix_statistics("bad", "n", prior))
        return trees.transform(vectors.transform(told)).withColumn("score", vector_to_array("probability")[1])

    scored.trees = trees
    return scored, prior


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS, most: int = MAX_LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score of each page."""
    rows = featured(pages)
    scored, prior = fitted(rows, seeds, most)
    told = scored(rows) if scored else rows.withColumn("score", F.lit(float(prior)))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return told.select("page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def withheld(pages: DataFrame, seed: str, seeds=SEEDS, most: int = MAX_LABELLED) -> DataFrame:
    """bad, found, good, spared: URLs of a seed that the fit saw nothing of, how many of them score as bad, and of the good
    URLs of hosts in a fold left out of the fit, how many score as good."""
    rows = featured(pages)
    own = F.contains(F.col("host"), F.lit(seed))
    aside = F.pmod(F.xxhash64("host"), F.lit(7)) == 0
    rest = [s for s in seeds if s != seed]
    scored, prior = fitted(rows.where(~own & ~aside), rest, most)
    test = rows.where(own | (aside & ~is_bad(F.col("host"), rest)))
    told = scored(test) if scored else test.withColumn("score", F.lit(float(prior)))
    hit = F.col("score") >= 0.5
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return told.agg(count(own).alias("bad"), count(own & hit).alias("found"), count(~own).alias("good"), count(~own & ~hit).alias("spared"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
