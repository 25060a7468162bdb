"""Top-k similarity join over an inverted index that never forms pairs out of reach.

Similarity is text_weight * cosine of token counts + (1 - text_weight) * Jaccard of action sets. The search has three steps.

1. Each source meets the targets of its rarest tokens, as many postings as RARE times k. The best of these pairs, scored
   exactly, give the source a floor: the kth similarity found, or the threshold.
2. A pair whose cosine is below what the floor needs beside the largest Jaccard is out of reach. The longest run of a
   source's most frequent tokens that can't give that cosine (by their norm, and by the largest weight that any target
   gives each of them) is left out of the index, so the long posting lists aren't read. What the other tokens add up to,
   with a bound of the rest, drops further pairs; the others are completed with the tokens left out.
3. Where actions alone can reach the floor, cosine plays no part: targets of one stratum, action and action set are alike,
   so the first k of each such set (by id, and k of a cluster at most) are enough, and sources meet the sets that share an action.
   At a threshold of 0, the first k of a stratum and action complete a list that is too short.

Postings of a token with over PART targets are dealt into parts, and only the sources of such a token are copied to each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import jaccard, token_counts
from tessera.sources.shared import discard, durable

RARE, PART = 32, 20_000
#: Rounding that bounds allow for.
SLIP = 1e-9


class Search:
    """sources, targets: unit_id, cluster_id, stratum, text and, with text_weight below 1, actions (sources also action)."""

    def __init__(self, sources: DataFrame, targets: DataFrame, k: int, min_similarity: float = 0.0, text_weight: float = 1.0, stop_words=()):
        self.k, self.least, self.weight = k, min_similarity, text_weight
        self.by_actions = text_weight < 1
        self.tables: list[DataFrame] = []
        none = F.lit(None).cast("array<string>")
        acts = lambda df: F.array_distinct("actions") if self.by_actions and "actions" in df.columns else none
        action = F.col("action") if self.by_actions else F.lit(None).cast("string")
        s = sources.select(F.col("unit_id").alias("source_id"), F.col("cluster_id").alias("source_cluster"), "stratum", action.alias("action"), acts(sources).alias("source_actions"), "text")
        t = targets.select(F.col("unit_id").alias("target_id"), F.col("cluster_id").alias("target_cluster"), "stratum", acts(targets).alias("target_actions"), "text")
        self.sources, self.targets = s.drop("text"), t.drop("text")
        counts = token_counts(s, "source_id", "text", stop_words, ["stratum"])
        raw = durable(token_counts(t, "target_id", "text", stop_words, ["stratum"]), "token-counts")
        self.target_norms = self.keep(raw.groupBy("target_id").agg(F.sum(F.col("n") * F.col("n")).alias("target_square")), "norms")
        weight = (F.col("n") / F.sqrt("target_square")).alias("weight")
        self.postings = self.keep(raw.join(self.target_norms, "target_id").select("stratum", "token", "target_id", "n", weight), "postings")
        discard(raw)
        index = self.postings.groupBy("stratum", "token").agg(F.count("*").alias("df"), F.max("weight").alias("top"))
        squares = counts.groupBy("source_id").agg(F.sum(F.col("n") * F.col("n")).alias("source_square"))
        known = counts.join(index, ["stratum", "token"]).join(squares, "source_id").withColumn("own", F.col("n") / F.sqrt("source_square"))
        often = Window.partitionBy("source_id").orderBy(F.desc("df"), "token").rowsBetween(Window.unboundedPreceding, 0)  # of one text's tokens
        rarely = Window.partitionBy("source_id").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, 0)
        bounds = known.select("*", F.least(F.sqrt(F.sum(F.col("own") * F.col("own")).over(often)), F.sum(F.col("own") * F.col("top")).over(often)).alias("reach"),
            F.sum("df").over(rarely).alias("read"))
        #: a source's tokens; reach: the most that this token and all more frequent ones can give a cosine
        self.tokens = self.keep(bounds.select("source_id", "stratum", "token", "n", "own", "df", "reach", "read", "source_square"), "source-tokens")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(durable(df, name))
        return self.tables[-1]

    def close(self) -> None:
        discard(*self.tables)

    def met(self, asked: DataFrame) -> DataFrame:
        """source_id, target_id, dot and what the shared tokens are of the target's squared norm, for pairs with one of the tokens asked."""
        parts = F.ceil(F.col("df") / PART).cast("int")
        left = asked.select("source_id", "stratum", "token", F.col("n").alias("asked_n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        spread = asked.select("stratum", "token", parts.alias("parts")).distinct()
        right = self.postings.join(spread, ["stratum", "token"]).withColumn("part", F.pmod(F.xxhash64("target_id"), F.col("parts")).cast("int"))
        return left.join(right, ["stratum", "token", "part"]).groupBy("source_id", "target_id").agg(F.sum(F.col("asked_n") * F.col("n")).alias("dot"), F.sum(F.col("weight") * F.col("weight")).alias("shared"))

    def eligible(self, pairs: DataFrame) -> DataFrame:
        """The pairs of one stratum, other clusters, and an admitted action, with their norms and Jaccard."""
        both = pairs.join(self.sources.withColumnRenamed("stratum", "source_stratum"), "source_id").join(self.targets, "target_id")
        both = both.where((F.col("source_stratum") == F.col("stratum")) & (F.col("source_cluster") != F.col("target_cluster")))
        if self.by_actions:
            both = both.where(F.array_contains("target_actions", F.col("action")))
            without = lambda c: F.array_except(F.col(c), F.array("action"))
            both = both.withColumn("alike", F.coalesce(jaccard(without("source_actions"), without("target_actions")), F.lit(0.0)))
        else:
            both = both.withColumn("alike", F.lit(0.0))
        squares = self.tokens.select("source_id", "source_square").distinct()
        return both.join(squares, "source_id", "left").join(self.target_norms, "target_id", "left").select(*pairs.columns, "alike", "source_square", "target_square")

    def similarity(self, dot: Column) -> Column:
        cosine = F.coalesce(F.try_divide(dot.cast("double"), F.sqrt("source_square") * F.sqrt("target_square")), F.lit(0.0))
        return self.weight * cosine + (1 - self.weight) * F.col("alike")

    def completed(self, pairs: DataFrame, tokens: DataFrame) -> DataFrame:
        """pairs, with what the given tokens of their sources add to the dot."""
        asked = tokens.select("source_id", "token", F.col("n").alias("asked_n"))
        held = self.postings.select("target_id", "token", "n").join(pairs.select("target_id").distinct(), "target_id", "left_semi")
        more = pairs.select("source_id", "target_id").join(asked, "source_id").join(held, ["target_id", "token"])
        more = more.groupBy("source_id", "target_id").agg(F.sum(F.col("asked_n") * F.col("n")).alias("more"))
        return pairs.join(more, ["source_id", "target_id"], "left").withColumn("dot", F.col("dot") + F.coalesce("more", F.lit(0))).drop("more")

    def best(self, scored: DataFrame) -> DataFrame:
        order = Window.partitionBy("source_id").orderBy(F.desc(F.round("similarity", 12)), "target_id")
        return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= self.k)

    def floors(self) -> DataFrame:
        """source_id, floor: no target below it is among the first k."""
        near = self.eligible(self.met(self.tokens.where(F.col("read") <= RARE * self.k)))
        first = self.keep(self.best(near.withColumn("similarity", self.similarity(F.col("dot")))).drop("rn", "similarity").withColumn("dot", F.lit(0).cast("long")), "first-pairs")
        exact = self.completed(first, self.tokens).withColumn("similarity", self.similarity(F.col("dot"))).where(F.col("similarity") >= self.least)
        kth = exact.groupBy("source_id").agg(F.count("*").alias("have"), F.min("similarity").alias("kth"))
        floor = F.when(F.col("have") >= self.k, F.greatest("kth", F.lit(float(self.least)))).otherwise(float(self.least))
        return self.sources.select("source_id").join(kth, "source_id", "left").select("source_id", floor.alias("floor"))

    def candidates(self, floors: DataFrame) -> DataFrame:
        """The pairs that are formed: source_id, target_id, dot over all tokens of the source, alike and norms."""
        need = (F.col("floor") - (1 - self.weight)) / self.weight if self.weight > 0 else F.lit(0.0)
        asked = self.keep(self.tokens.join(floors.select("source_id", "floor", need.alias("need")), "source_id").withColumn("left_out", (F.col("need") > 2 * SLIP) & (F.col("reach") < F.col("need") - SLIP)), "asked")
        rest = asked.where("left_out").groupBy("source_id").agg(F.max("reach").alias("rest"), F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("rest_norm"))
        pairs = self.eligible(self.met(asked.where("not left_out")).where("dot > 0")).join(floors, "source_id").join(rest, "source_id", "left")
        open_part = F.least(F.coalesce("rest", F.lit(0.0)), F.coalesce("rest_norm", F.lit(0.0)) * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("shared")) + SLIP))
        reachable = pairs.where(self.similarity(F.col("dot")) + self.weight * open_part >= F.col("floor") - SLIP)
        self.reachable = self.keep(reachable.select("source_id", "target_id", "dot", "alike", "source_square", "target_square"), "reachable")
        return self.completed(self.reachable, asked.where("left_out"))

    def first_of(self, keys: list[str], rows: DataFrame) -> DataFrame:
        """Of each key enough first targets for a source of any cluster: k of a cluster, and 2k in all."""
        own = Window.partitionBy(*keys, "target_cluster").orderBy("target_id")
        every = Window.partitionBy(*keys).orderBy("target_id")
        short = rows.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= self.k)
        return short.withColumn("rn", F.row_number().over(every)).where(F.col("rn") <= 2 * self.k).drop("rn")

    def by_sets(self, floors: DataFrame) -> DataFrame | None:
        """source_id, target_id of pairs that may count without a common token."""
        out = []
        few = floors.where(F.col("floor") <= (1 - self.weight) + 2 * SLIP)
        if self.by_actions and self.least <= 1 - self.weight:
            admitted = self.targets.withColumn("action", F.explode("target_actions")).withColumn("others", F.array_sort(F.array_except("target_actions", F.array("action"))))
            keys = ["stratum", "action", "others"]
            firsts = self.keep(self.first_of(keys, admitted.select(*keys, "target_cluster", "target_id")), "firsts")
            asked = self.sources.join(few, "source_id").withColumn("mine", F.array_except("source_actions", F.array("action"))).select("source_id", "stratum", "action", "mine", "floor", F.explode("mine").alias("act"))
            sets = firsts.select(*keys).distinct().withColumn("act", F.explode("others"))
            shared = asked.join(sets, ["stratum", "action", "act"]).groupBy("source_id", "floor", *keys).agg(F.first("mine").alias("mine"))
            good = shared.where((1 - self.weight) * jaccard(F.col("mine"), F.col("others")) >= F.col("floor") - SLIP)
            out.append(good.select("source_id", *keys).join(firsts, keys).select("source_id", "target_id"))
        if self.least <= 0:
            keys = ["stratum", "action"] if self.by_actions else ["stratum"]
            rows = self.targets.withColumn("action", F.explode("target_actions")) if self.by_actions else self.targets
            short = self.sources.join(few.where("floor <= 0"), "source_id")
            out.append(short.join(self.keep(self.first_of(keys, rows.select(*keys, "target_cluster", "target_id")), "firsts"), keys).select("source_id", "target_id"))
        found = None
        for part in out:
            found = part if found is None else found.unionByName(part)
        return found

    def result(self) -> DataFrame:
        """source_id, target_id, similarity, rn: the first k of each source, at or above the threshold."""
        floors = self.keep(self.floors(), "floors")
        columns = ["source_id", "target_id", "dot", "alike", "source_square", "target_square"]
        pairs = self.candidates(floors).select(*columns)
        more = self.by_sets(floors)
        if more is not None:
            fresh = more.distinct().join(self.reachable.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
            pairs = pairs.unionByName(self.completed(self.eligible(fresh.withColumn("dot", F.lit(0).cast("long"))), self.tokens).select(*columns))
        scored = pairs.select("source_id", "target_id", self.similarity(F.col("dot")).alias("similarity")).where(F.col("similarity") >= self.least)
        return self.best(scored)
