"""The kth of very many, without sorting them and without a task that sees them all.

First n by hash priority: radix passes over histograms of the priority's digits find the bucket of the nth smallest, until
few rows are in it; these are ranked exactly and give a threshold, and a filter takes what is at or below it. Each pass adds
counts up before its shuffle.

Quantiles: mergeable sketches (KLL) propose values around a rank, and exact counts of what is below and at each proposal
bracket the rank; what a sketch estimates decides how many passes there are, never what comes out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.rng import shuffle_key
from tessera.sources.shared import durable

#: Rows that are ranked exactly at the end, and the bits of a digit and of all digits.
FEW, DIGIT, BITS = 4_096, 12, 48
#: Parts of a sketch's ranks that may be asked for.
GRID = 200


def _keyed(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with its hash priority and the leading BITS of that as a number."""
    keyed = df.withColumn("shuffle_key", shuffle_key(seed, F.col(key)))
    return keyed.withColumn("__h", F.conv(F.substr("shuffle_key", F.lit(1), F.lit(BITS // 4)), 16, 10).cast("long"))


def _digit(shift: int) -> Column:
    return F.shiftright("__h", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))


def _up_to(key: str, last_hash: Column, last_key: Column) -> Column:
    return (F.col("shuffle_key") < last_hash) | ((F.col("shuffle_key") == last_hash) & (F.col(key) <= last_key))


def first_by_priority(df: DataFrame, take: int, key: str, seed: int = 42) -> DataFrame:
    """df with shuffle_key and `chosen`: whether a row is among the first `take` by priority, ties by key.

    `key` must tell rows apart; where it doesn't, rows that repeat the last key are all chosen.
    """
    keyed = _keyed(df, key, seed)
    if take <= 0:
        return keyed.drop("__h").withColumn("chosen", F.lit(False))
    inside, rest, shift = keyed, take, BITS
    while shift:
        shift -= DIGIT
        counts = sorted((r["d"], r["count"]) for r in inside.groupBy(_digit(shift).alias("d")).count().collect())  # at most 2^DIGIT rows
        for digit, held in counts:
            if rest <= held:
                break
            rest -= held
        else:
            return keyed.drop("__h").withColumn("chosen", F.lit(True))
        inside = inside.where(_digit(shift) == digit)
        if held <= FEW:
            break
    last = inside.orderBy("shuffle_key", key).select("shuffle_key", key).limit(rest).orderBy(F.desc("shuffle_key"), F.desc(key)).first()
    return keyed.drop("__h").withColumn("chosen", _up_to(key, F.lit(last[0]), F.lit(last[1])))


def first_by_priority_within(df: DataFrame, wanted: DataFrame, by: list[str], key: str, seed: int = 42) -> DataFrame:
    """As first_by_priority in each group; wanted: the columns `by` (without nulls) and take. Rows of other groups aren't chosen.

    A group of any size runs in many tasks; only its histograms and its last FEW rows come together.
    """
    keyed = _keyed(df, key, seed)
    size = df.groupBy(*by).agg(F.count("*").alias("__held"))
    active = durable(wanted.where("take > 0").join(size, by).select(*by, F.col("take").alias("__rest"), F.col("__held"), F.lit(0).cast("long").alias("__prefix"), F.lit(BITS).alias("__shift")), "selection")
    done = [active.where(F.col("__rest") >= F.col("__held")).select(*by, F.lit(None).cast("string").alias("__last_hash"), F.lit(None).cast(df.schema[key].dataType).alias("__last_key"))]
    active = active.where(F.col("__rest") < F.col("__held"))
    shift = BITS
    while True:
        few = active.where((F.col("__held") <= FEW) | (F.lit(shift) == 0))
        inside = keyed.join(few, by).where(F.shiftright("__h", shift) == F.col("__prefix"))
        ranked = inside.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy("shuffle_key", key))).where("__rn = __rest")
        done.append(durable(ranked.select(*by, F.col("shuffle_key").alias("__last_hash"), F.col(key).alias("__last_key")), "selection"))
        active = active.where((F.col("__held") > FEW) & (F.lit(shift) > 0))
        if active.isEmpty():
            break
        shift -= DIGIT
        counts = keyed.join(active, by).where(F.shiftright("__h", shift + DIGIT) == F.col("__prefix")).groupBy(*by, F.shiftright("__h", shift).alias("__next")).agg(F.count("*").alias("__count"))
        so_far = F.sum("__count").over(Window.partitionBy(*by).orderBy("__next"))  # of a group: at most 2^DIGIT counts
        located = counts.withColumn("__so_far", so_far).join(active, by).where((F.col("__so_far") >= F.col("__rest")) & (F.col("__so_far") - F.col("__count") < F.col("__rest")))
        active = durable(located.select(*by, (F.col("__rest") - F.col("__so_far") + F.col("__count")).alias("__rest"), F.col("__count").alias("__held"), F.col("__next").alias("__prefix"), F.lit(shift).alias("__shift")), "selection")
    ends = done[0]
    for more in done[1:]:
        ends = ends.unionByName(more)
    ends = ends.withColumn("__found", F.lit(True))
    inside = F.col("__last_hash").isNull() | _up_to(key, F.col("__last_hash"), F.col("__last_key"))
    return keyed.drop("__h").join(ends, by, "left").withColumn("chosen", F.coalesce(F.col("__found") & inside, F.lit(False))).drop("__last_hash", "__last_key", "__found")


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], k: int = 800) -> DataFrame:
    """by, n and a column for each name: the value at a 0-based rank among the group's sorted values.

    ranks: rank of each name from the number of values. Null and NaN values don't count. A group of any size runs in many
    tasks; groups themselves may be many.
    """
    v = F.col(value).cast("double")
    values = rows.select(*by, v.alias("__v")).where(v.isNotNull() & ~F.isnan(v))
    sizes = values.groupBy(*by).agg(F.count("*").alias("n"))
    # a constant stands for the group where there is none: one row for each name, which is broadcast
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("__name"), f(F.col("n")).cast("long").alias("__rank")) for name, f in ranks.items()]))
    state = sizes.where("n > 0").select(*by, "n", asked.alias("__a")).select(*by, F.col("__a.__name"), F.col("__a.__rank"), F.lit(0).cast("long").alias("__below"), F.col("n").alias("__held"),
        F.lit(None).cast("double").alias("__lo"), F.lit(None).cast("double").alias("__hi"))
    active = durable(state, "quantiles")
    within = lambda s: (values.join(s, by) if by else values.join(F.broadcast(s))).where(
        (F.col("__lo").isNull() | (F.col("__v") > F.col("__lo"))) & (F.col("__hi").isNull() | (F.col("__v") < F.col("__hi"))))
    keys, done = [*by, "__name"], []
    while True:
        few = active.where(F.col("__held") <= FEW)
        ranked = within(few).withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy("__v")) - 1).where("__rn = __rank - __below")
        done.append(durable(ranked.select(*keys, "__v"), "quantiles"))
        active = active.where(F.col("__held") > FEW)
        if active.isEmpty():
            break
        grid = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("__v", F.lit(k)), F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
        sketched = within(active).groupBy(*keys).agg(grid.alias("__s"))
        share = F.round((F.col("__rank") - F.col("__below") + 0.5) / F.col("__held") * GRID).cast("int")
        at = lambda d: F.get("__s", F.least(F.lit(GRID), F.greatest(F.lit(0), share + d)))
        proposed = durable(active.join(sketched, keys).select(*active.columns, *[at(d).alias(f"__p{i}") for i, d in enumerate((-2, 0, 2))]), "quantiles")
        counted = within(proposed).groupBy(*keys).agg(*[F.count_if(F.col("__v") < F.col(f"__p{i}")).alias(f"__less{i}") for i in range(3)], *[F.count_if(F.col("__v") == F.col(f"__p{i}")).alias(f"__same{i}") for i in range(3)])
        tried = F.array(*[F.struct(F.col(f"__p{i}").alias("p"), F.col(f"__less{i}").alias("less"), F.col(f"__same{i}").alias("same")) for i in range(3)])
        place = F.col("__rank") - F.col("__below")
        judged = durable(proposed.join(counted, keys).withColumn("__t", tried).select(*active.columns,
            F.get(F.filter("__t", lambda t: (t["less"] <= place) & (place < t["less"] + t["same"])), F.lit(0)).alias("__hit"),
            F.array_max(F.transform(F.filter("__t", lambda t: t["less"] + t["same"] <= place), lambda t: F.struct(t["p"], (t["less"] + t["same"]).alias("c")))).alias("__under"),
            F.array_min(F.transform(F.filter("__t", lambda t: t["less"] > place), lambda t: F.struct(t["p"], t["less"].alias("c")))).alias("__over")), "quantiles")
        done.append(judged.where(F.col("__hit").isNotNull()).select(*keys, F.col("__hit.p").alias("__v")))
        passed = F.coalesce("__under.c", F.lit(0))
        active = judged.where(F.col("__hit").isNull()).select(*keys, "__rank", (F.col("__below") + passed).alias("__below"), (F.coalesce("__over.c", "__held") - passed).alias("__held"),
            F.coalesce("__under.p", "__lo").alias("__lo"), F.coalesce("__over.p", "__hi").alias("__hi"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    columns = [F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks]
    if by:
        return sizes.join(found.groupBy(*by).agg(*columns), by)
    from tessera.operators.single import with_values

    return with_values(sizes, found.agg(*columns))


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by, n and linear quantiles by name, exact: between the two values around p * (n - 1)."""
    ranks = {}
    for name, p in wanted.items():
        ranks[f"__low_{name}"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"__high_{name}"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    found = at_ranks(rows, by, value, ranks)
    share = lambda p: (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
    return found.select(*by, "n", *[(F.col(f"__low_{name}") + (F.col(f"__high_{name}") - F.col(f"__low_{name}")) * share(p)).alias(name) for name, p in wanted.items()])
