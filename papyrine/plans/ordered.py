"""Windows over long groups in two levels.

A group (a conversation, a file) can hold a third of all rows, so it is never one
window partition: rows carry a chunk number that follows the order, windows run
inside (group, chunk), and what crosses a chunk's edge is taken from a table of one
row per chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.plans.layout import cut

#: Rows of a group that one window partition of ``rolling_mean`` holds, besides those it looks back on.
BLOCK = 50_000


def lag_across(df: DataFrame, group: list[str], chunk: str, order: list[str], cols: list[str], to: str) -> DataFrame:
    """Adds struct ``to``: ``cols`` of the row before in the group's whole order, null for the first row."""
    inside = Window.partitionBy(*group, chunk).orderBy(*order)
    here = df.withColumn("_prev", F.lag(F.struct(*cols)).over(inside))
    last = df.groupBy(*group, chunk).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*group).orderBy(chunk))).drop("_last")
    return here.join(carry, [*group, chunk], "left").withColumn(to, F.coalesce("_prev", "_carry")).drop("_prev", "_carry")


def running_sums(df: DataFrame, group: list[str], chunk: str, order: list[str], flags: dict) -> DataFrame:
    """Adds each name of ``flags``: the sum of its expression over the group's rows up to this one."""
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = df.withColumns({f"_f_{k}": f.cast("long") for k, f in flags.items()})
    total = here.groupBy(*group, chunk).agg(*[F.sum(f"_f_{k}").alias(f"_t_{k}") for k in flags])
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select(*group, chunk, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in flags])
    here = here.withColumns({f"_s_{k}": F.sum(f"_f_{k}").over(inside) for k in flags}).join(carry, [*group, chunk], "left")
    return here.withColumns({k: F.col(f"_s_{k}") + F.col(f"_c_{k}") for k in flags}).drop(*[f"_{x}_{k}" for k in flags for x in "fsc"])


def running_sum(df: DataFrame, group: list[str], chunk: str, order: list[str], flag, to: str) -> DataFrame:
    """Adds ``to``: the sum of ``flag`` over the group's rows up to this one."""
    return running_sums(df, group, chunk, order, {to: flag})


def dense_index(df: DataFrame, to: str) -> DataFrame:
    """Adds ``to``: row numbers from 0 in the order of the partitions, without bringing the rows together."""
    i = df.withColumn("_id", F.monotonically_increasing_id())
    i = i.withColumn("_p", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    size = i.groupBy("_p").agg(F.count("*").alias("_n"))
    before = size.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return i.join(before, "_p").withColumn(to, F.col("_at") + F.col("_before")).drop("_id", "_p", "_at", "_before")


def by_range(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``chunk``: the range that a row falls in by group and order, so that a group of any size is in many."""
    return cut(df.repartitionByRange(*group, *order).withColumn("chunk", F.spark_partition_id()))


def rolling_mean(df: DataFrame, group: list[str], order: list[str], value: str, n: int, to: str) -> DataFrame:
    """Adds ``to``: the mean of ``value`` over the last ``n`` rows of the group. ``order`` must tell all rows apart."""
    i = running_sum(by_range(df, group, order), group, "chunk", order, F.lit(1), "_i")
    block = F.floor((F.col("_i") - 1) / BLOCK)
    # The last rows of a block are looked back on by the next one.
    seen = F.when((F.col("_i") - 1) % BLOCK >= BLOCK - (n - 1), F.array(block, block + 1)).otherwise(F.array(block))
    w = Window.partitionBy(*group, "_b").orderBy("_i").rowsBetween(-(n - 1), 0)
    out = i.withColumn("_b", F.explode(seen)).withColumn(to, F.avg(value).over(w))
    return out.where(F.col("_b") == block).drop("_b", "_i", "chunk")


#: Error of the first look at a percentile, as a share of the rows.
NEAR = 2e-5


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, a column for each of ``shares``): percentiles with linear interpolation, exact, without one task that sees a group.

    A first pass brackets each percentile; a second counts what lies below the bracket and
    the different values inside it, few hundred-thousandths of the rows, among which it is found by rank.
    Nulls are left out.
    """
    v = df.where(F.col(value).isNotNull()).select(*[F.struct(*by).alias("_by") if by else F.lit(0).alias("_by")], F.col(value).cast("double").alias("_v"))
    names = list(shares)
    sides = [x for p in shares.values() for x in (max(0.0, p - NEAR), min(1.0, p + NEAR))]
    near = cut(v.groupBy("_by").agg(F.count("*").alias("n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", F.array(*map(F.lit, sides)), 100_000).alias("_e")))
    spans = [F.struct(F.lit(k).alias("k"), F.lit(float(shares[k])).alias("p"), (F.col("_least") if shares[k] <= NEAR else F.col("_e")[2 * i]).alias("lo"), (F.col("_most") if shares[k] >= 1 - NEAR else F.col("_e")[2 * i + 1]).alias("hi")) for i, k in enumerate(names)]
    near = near.select("_by", "n", F.array(*spans).alias("_s"))
    j = v.join(near, "_by")
    # The bracket may miss the two values between which a percentile lies by one place, so its neighbours are taken along.
    side = lambda i: (F.col("_v") < F.col("_s")[i]["lo"], F.col("_v") > F.col("_s")[i]["hi"])
    below = j.groupBy("_by").agg(*[F.struct(F.sum(side(i)[0].cast("long")).alias("b"), F.max(F.when(side(i)[0], F.col("_v"))).alias("before"), F.min(F.when(side(i)[1], F.col("_v"))).alias("after")).alias(f"_b{i}") for i in range(len(names))])
    inside = j.select("_by", "_v", F.explode(F.filter("_s", lambda s: (F.col("_v") >= s["lo"]) & (F.col("_v") <= s["hi"]))).alias("s")).groupBy("_by", "s.k", "s.p", "_v").agg(F.count("*").alias("c"))
    pick = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_b{i}").alias("x")) for i, k in enumerate(names)])
    start = below.select("_by", F.explode(pick).alias("x")).select("_by", "x.k", "x.x.*")
    w = Window.partitionBy("_by", "k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.join(start, ["_by", "k"]).join(near.select("_by", "n"), "_by").withColumn("upto", F.sum("c").over(w) + F.col("b"))
    place = F.col("p") * (F.col("n") - 1)
    at = ranked.withColumn("lower", F.floor(place)).withColumn("upper", F.ceil(place)).groupBy("_by", "k", "n", "p", "b", "before", "after", "lower", "upper").agg(F.min(F.when(F.col("upto") > F.col("lower"), F.col("_v"))).alias("x"), F.min(F.when(F.col("upto") > F.col("upper"), F.col("_v"))).alias("y"))
    inner = lambda c, rank: F.when(F.col("b") > F.col(rank), F.col("before")).otherwise(F.coalesce(c, "after"))
    at = at.select("_by", "k", "n", "p", inner("x", "lower").alias("x"), inner("y", "upper").alias("y"))
    done = at.withColumn("q", F.col("x") + (F.col("y") - F.col("x")) * (place - F.floor(place))).groupBy("_by", "n").agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(k) for k in names])
    return done.select(*[F.col("_by")[c].alias(c) for c in by], "n", *names)
