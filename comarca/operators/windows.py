"""Series operators per unit. A unit's series is short, so its window is a small group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comarca.functions.numeric import log_positive


def by_unit(unit="unit", time="year"):
    return Window.partitionBy(unit).orderBy(time)


def lag_lead_diff(df: DataFrame, column: str, unit="unit", time="year") -> DataFrame:
    w = by_unit(unit, time)
    c = F.col(column)
    return df.withColumns(
        {
            f"{column}_lag1": F.lag(c, 1).over(w),
            f"{column}_lag2": F.lag(c, 2).over(w),
            f"{column}_lead1": F.lead(c, 1).over(w),
            f"d_{column}": c - F.lag(c, 1).over(w),
        }
    )


def log_growth(value: Column, previous: Column) -> Column:
    """Log growth, only when both levels are positive."""
    return log_positive(value) - log_positive(previous)


def consecutive_diff(column: str, unit="unit", time="year") -> Column:
    """First difference between adjacent periods; a gap gives NULL."""
    w = by_unit(unit, time)
    return F.when(F.col(time) - F.lag(time).over(w) == 1, F.col(column) - F.lag(column).over(w))


def within_between(df: DataFrame, column: str, unit="unit") -> DataFrame:
    mean = F.avg(column).over(Window.partitionBy(unit))
    return df.withColumns({f"{column}_mean": mean, f"{column}_within": F.col(column) - mean})


def cumulative_index(rate_pct: Column, unit: str = "unit", time: str = "year", base: float = 100.0) -> Column:
    """Base times the running product of (1 + rate/100)."""
    w = by_unit(unit, time).rowsBetween(Window.unboundedPreceding, 0)
    return F.lit(base) * F.exp(F.sum(F.log1p(rate_pct / 100.0)).over(w))


def chain_levels(df: DataFrame, growth_pct: str, base: str, keys: list[str], time="year") -> DataFrame:
    """Level path from growth rates, chained from ``base`` within each key."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("level", F.col(base) * F.exp(F.sum(F.log1p(F.col(growth_pct) / 100.0)).over(w)))


def running_index(df: DataFrame, unit: str, order: list[str], bucket: Column, name: str) -> DataFrame:
    """1..n counter of each unit's rows in time order.

    The count is cut by a coarse time ``bucket``: a row's number is the size of the unit's earlier
    buckets plus its number inside the bucket, so a unit with very many rows spans many tasks.
    """
    keyed = df.withColumn("_b", bucket)
    before = Window.partitionBy(unit).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy(unit, "_b").agg(F.count("*").alias("_n"))
    offsets = sizes.select(unit, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(unit, "_b").orderBy(*order))
    return keyed.withColumn("_r", inside).join(offsets, [unit, "_b"]).withColumn(
        name, (F.col("_off") + F.col("_r")).cast("int")
    ).drop("_b", "_r", "_off")


def holm(df: DataFrame, p: str, family: list[str], order: list[str]) -> DataFrame:
    """Holm step-down p values inside each family of contrasts (a few dozen rows each)."""
    w = Window.partitionBy(*family).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(running)).drop("_step")
