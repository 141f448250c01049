"""Exact order statistics and ranks of groups of any size, without one task holding a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import stage

#: Bits of a key that one round of the selection looks at, and the bits of a key.
DIGIT = 16
KEY_BITS = 64


def sort_key(value: Column) -> Column:
    """A 64-bit integer in the order of a double: its exponent and fraction, negated for negative numbers.

    NaN comes last, after infinity; both zeros are equal.
    """
    v, infinity = F.abs(value), F.lit(float("inf"))
    least, tiny = F.lit(2.0**-1022), F.lit(2.0**-1074)
    usual = F.when((v >= least) & (v < infinity), v).otherwise(F.lit(1.0))
    # the logarithm may be off by one next to a power of two
    guess = F.floor(F.log2(usual)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(usual < power(guess), guess - 1).when(usual / 2 >= power(guess), guess + 1).otherwise(guess)
    whole = F.lit(1 << 52)
    fraction = ((usual / power(e) - 1) * F.lit(2.0**52)).cast("bigint")
    size = (
        F.when(v < least, (F.least(v, least) / tiny).cast("bigint"))
        .when(v == infinity, F.lit(2047 << 52))
        .otherwise((e.cast("bigint") + 1023) * whole + fraction)
    )
    return F.when(F.isnan(value), F.lit((2047 << 52) + 1)).when(value < 0, -size).otherwise(size)


def _key_of(df: DataFrame, value: str) -> Column:
    if isinstance(df.schema[value].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(value).cast("bigint")
    return sort_key(F.col(value).cast("double"))


def _group(keys: list[str]) -> Column:
    """A group's keys as one value that is never NULL, so that joins keep groups with NULL keys."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))


def order_statistic(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group: count ``n`` and, for each named rank, the value at that 1-based rank; by radix selection.

    Equal values collapse to one counted row first, so ties cannot make a group hot. Each round counts
    the rows by the next ``DIGIT`` bits of an order-preserving key, finds the bin that holds a wanted rank and keeps the
    rows of such bins only; after the last round a bin is one value. A round's counts are at most 2 ** ``DIGIT`` rows for
    each group or bin. ``ranks`` maps a name to a function of the group count.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn("_g", _group(keys))
    counted = rows.groupBy("_g", value).agg(F.count(F.lit(1)).alias("_c"))
    # Read in every round: written once.
    counted = stage(counted.select("_g", F.col(value).alias("_v"), _key_of(df, value).alias("_k"), "_c"), "order-statistic")
    prefix = lambda bits: F.shiftright("_k", KEY_BITS - bits)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("bigint").alias("r")) for name, rank in ranks.items()])

    located, bins = None, ["_g"]
    for bits in range(DIGIT, KEY_BITS + 1, DIGIT):
        kept = counted if located is None else counted.withColumn("_p", prefix(bits - DIGIT)).join(located.select("_g", "_p").distinct(), ["_g", "_p"])
        counts = kept.withColumn("_b", prefix(bits)).groupBy(*bins, "_b").agg(F.sum("_c").alias("_bc"), F.min("_v").alias("_v"))
        own = Window.partitionBy(*bins)
        counts = counts.withColumn("_hi", F.sum("_bc").over(own.orderBy("_b"))).withColumn("_lo", F.col("_hi") - F.col("_bc"))
        if located is None:
            asked = counts.withColumn("_n", F.sum("_bc").over(own)).withColumn("_w", F.explode(wanted))
            asked = asked.select("*", F.col("_w.name").alias("_name"), F.col("_w.r").alias("_r"))
        else:
            asked = counts.join(located.drop("_v"), ["_g", "_p"])
        found = asked.filter((F.col("_r") > F.col("_lo")) & (F.col("_r") <= F.col("_hi")))
        # a row for each group and rank
        located = stage(found.select("_g", F.col("_b").alias("_p"), "_n", "_name", (F.col("_r") - F.col("_lo")).alias("_r"), "_v"), "located")
        bins = ["_g", "_p"]
    out = located.groupBy("_g").agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    return out.select(*[F.col("_g")[k].alias(k) for k in keys], "n", *ranks)


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Median per group from its two middle order statistics."""
    both = order_statistic(
        df, keys, value, {"_a": lambda n: F.floor((n + 1) / 2), "_b2": lambda n: F.floor(n / 2) + 1}
    )
    return both.select(*keys, ((F.col("_a") + F.col("_b2")) / 2).alias(out))


def higher_rank(q: float | Column) -> Callable[[Column], Column]:
    """1-based rank of the "higher" sample quantile: position ceil(q (n - 1)) counted from zero."""
    return lambda n: F.ceil(F.round(F.lit(q) * (n - 1), 9)) + 1


def average_ranks(df: DataFrame, keys: list[str], value: str, weights: dict[str, Column]) -> DataFrame:
    """Tie-averaged ranks of ``value`` within ``keys``, one row per distinct value.

    ``weights`` are aggregates carried per distinct value (such as counts of a sign). Distinct values are dealt by range of
    group and value, so a large group lies in many parts; ranks are what the parts before hold of the group plus a
    running count in the part.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn("_g", _group(keys))
    counted = rows.groupBy("_g", value).agg(F.count(F.lit(1)).alias("n_ties"), *[w.alias(n) for n, w in weights.items()])
    dealt = counted.repartitionByRange("_g", value).withColumn("_part", F.spark_partition_id())
    # written, as the parts must stay the same
    dealt = stage(dealt, "average-ranks")
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_g", "_part").agg(F.sum("n_ties").alias("_pc"))
    offsets = offsets.select("_g", "_part", F.coalesce(F.sum("_pc").over(before), F.lit(0)).alias("_lo"))
    upto = F.sum("n_ties").over(Window.partitionBy("_g", "_part").orderBy(value))
    ranked = dealt.repartition("_g", "_part").join(offsets, ["_g", "_part"])
    ranked = ranked.withColumn("rank", F.col("_lo") + upto - (F.col("n_ties") - 1) / 2.0)
    return ranked.select(*[F.col("_g")[k].alias(k) for k in keys], value, "n_ties", *weights, "rank")
