"""Ranks and exact quantiles of whole tables without a single-task sort.

Rows are cut into ranges of their keys; inside a range an ordinary window works, and the ranges are linked
by their counts. Quantiles order only the rows near the wanted rank. The results are exact: samples and
sketches only decide where the cuts fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comarca.session import settle

MIN_RANGES = 16
ACCURACY = 10_000
SLICES = 1024


def range_offsets(df: DataFrame, value: str, weight: str, by: list[str] | None = None):
    """(rows with ``_range``, offsets): the range of each row and the weight before each range of its group.

    The ranges are Spark's own, cut from a sample of the whole keys of any type; rows with equal keys share
    one. They are written once, since a second sample would cut elsewhere.
    """
    by = by or []
    ranges = max(MIN_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = df.repartitionByRange(ranges, *by, value)
    ranged = settle(spread.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*by, "_range").agg(F.sum(weight).alias("_in"))
    w = Window.partitionBy(*by, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_range", F.coalesce(F.sum("_in").over(w), F.lit(0)).alias("_before"))
    return ranged, offsets


def average_rank(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """(by, value, rank): the average rank of every distinct value, ties sharing their mean rank."""
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranged, offsets = range_offsets(counts, value, "_n", by)
    w = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .join(offsets, [*by, "_range"])
        .select(
            *by, value, (F.col("_before") + F.col("_inside") + (F.col("_n") + 1) / 2.0).alias(name)
        )
    )


def attach(df: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Join facts with one row per ``by``; without keys the single row comes in as a scalar subquery."""
    if by:
        return df.join(facts, by)
    packed = facts.select(F.struct(*facts.columns).alias("_facts"))
    return df.withColumn("_facts", packed.scalar()).select(*df.columns, "_facts.*")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per group, exact for groups of any size.

    A sketch brackets each quantile, by five times its rank error. Counts merged from partial aggregates say
    how many rows lie below and inside a bracket; one that misses a wanted rank, as in a group of few rows, is
    opened to that side. Only rows inside the brackets are grouped and ordered: no task holds a group.
    The values are written first, since they are read three times: sums of doubles computed anew may differ in
    their last bits and then miss their own bracket.
    """
    eps = 5.0 / ACCURACY
    names, k = list(probs), len(probs)
    edges = [max(0.0, p - eps) for p in probs.values()] + [min(1.0, p + eps) for p in probs.values()]
    present = settle(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), "values")
    sketch = settle(
        present.groupBy(*by).agg(
            F.count("*").alias("_total"),
            F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), ACCURACY).alias("_e"),
        ),
        "sketch",
    )
    v, e = F.col("_v"), F.col("_e")
    counts = (
        attach(present, sketch, by)
        .groupBy(*by)
        .agg(
            F.first("_total").alias("_total"),
            F.first("_e").alias("_e"),
            F.array(*[F.count_if(v < e[i]) for i in range(k)]).alias("_under"),
            F.array(*[F.count_if((v >= e[i]) & (v <= e[i + k])) for i in range(k)]).alias("_held"),
        )
    )

    def bracket(i: int, p: float) -> Column:
        rank = F.lit(p) * (F.col("_total") - 1)
        low = F.col("_under")[i] <= F.floor(rank)
        high = F.col("_under")[i] + F.col("_held")[i] > F.ceil(rank)
        return F.struct(
            F.lit(i).alias("_q"),
            rank.alias("_h"),
            F.when(low, e[i]).otherwise(F.lit(float("-inf"))).alias("_lo"),
            F.when(high, e[i + k]).otherwise(F.lit(float("inf"))).alias("_hi"),
            F.when(low, F.col("_under")[i]).otherwise(0).alias("_out"),
        )

    brackets = F.array(*[bracket(i, p) for i, p in enumerate(probs.values())])
    held = settle(counts.select(*by, brackets.alias("_b")), "brackets")
    below = held.select(*by, F.transform("_b", lambda b: b["_out"]).alias("_below"))
    located = attach(present, held, by)
    inside = (
        located.select(*by, "_v", F.inline(F.filter("_b", lambda b: (v >= b["_lo"]) & (v <= b["_hi"]))))
        .groupBy(*by, "_q", "_h", "_lo", "_hi", "_v")
        .agg(F.count("*").alias("_n"))
    )
    # Equal-width slices of each bracket: only the slices that hold the wanted ranks are ordered.
    width = F.col("_hi") - F.col("_lo")
    slot = F.when((width > 0) & (width < F.lit(float("inf"))), F.least(F.floor((F.col("_v") - F.col("_lo")) / width * SLICES), F.lit(SLICES - 1)))
    sliced = inside.withColumn("_slice", F.coalesce(slot, F.lit(0)))
    before = Window.partitionBy(*by, "_q").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = attach(sliced.groupBy(*by, "_q", "_slice").agg(F.sum("_n").alias("_in"), F.first("_h").alias("_rank")), below, by)
    start = F.get("_below", F.col("_q")) + F.coalesce(F.sum("_in").over(before), F.lit(0))
    wanted = (
        sizes.withColumn("_start", start)
        .filter((F.col("_start") <= F.ceil("_rank")) & (F.col("_start") + F.col("_in") > F.floor("_rank")))
        .select(*by, "_q", "_slice", "_start")
    )
    w = Window.partitionBy(*by, "_q", "_slice").orderBy("_v")
    ordered = sliced.join(wanted, [*by, "_q", "_slice"]).withColumn("_upto", F.sum("_n").over(w))
    end = F.col("_start") + F.col("_upto")  # ranks up to and including this value
    picked = ordered.groupBy(*by, "_q").agg(
        F.min(F.when(end > F.floor("_h"), F.col("_v"))).alias("_v0"),
        F.min(F.when(end > F.ceil("_h"), F.col("_v"))).alias("_v1"),
        F.first(F.col("_h") - F.floor("_h")).alias("_f"),
    )
    value_at = F.col("_v0") + F.col("_f") * (F.col("_v1") - F.col("_v0"))
    return picked.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == i, value_at)).alias(n) for i, n in enumerate(names)])


def top_and_bottom(df: DataFrame, order: list[Column], reverse: list[Column], top: int, bottom: int) -> tuple:
    """The first ``top`` and last ``bottom`` rows. Each is a distributed top-k, not a full sort."""
    return df.orderBy(*order).limit(top), df.orderBy(*reverse).limit(bottom)
