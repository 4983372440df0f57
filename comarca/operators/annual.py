"""Entity aggregation, splicing of overlapping sources and the annualisation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUARTERS = 4


def complete_sum(value: Column, quarter: Column) -> Column:
    """Sum of the year, only if all four quarters are present."""
    return F.when(F.count_distinct(quarter) == QUARTERS, F.sum(value))


def last_quarter(value: Column, quarter: Column) -> Column:
    return F.max(F.when(quarter == QUARTERS, value))


def annualize_wide(
    quarterly: DataFrame,
    keys: list[str],
    flows: list[str],
    stocks: list[str] | None = None,
    quarter: str = "quarter",
    counted_stocks: list[str] | None = None,
) -> DataFrame:
    """Annual values from rows per (keys, quarter): flows are summed, stocks read at year end.

    With several rows per quarter a stock may be the number of rows in the last one
    (``counted_stocks``); it is NULL when that quarter is missing.

    The quarters seen travel as a bit mask, so no distinct count (and no second shuffle) is needed.
    """
    q = F.col(quarter)
    seen = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), q - 1)))
    aggs = [seen.cast("long").alias("quarters")]
    aggs += [F.when(seen == QUARTERS, F.sum(c)).alias(c) for c in flows]
    aggs += [last_quarter(F.col(c), q).alias(c) for c in stocks or []]
    at_end = F.count_if(q == QUARTERS)
    aggs += [F.when(at_end > 0, at_end).alias(c) for c in counted_stocks or []]
    return quarterly.groupBy(*keys).agg(*aggs)


def annualize_long(quarterly: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """Long form: one row per (keys, variable); the rule of each variable comes from ``rules``.

    ``rules`` has (variable, rule) with rule ``sum`` or ``last``. The most recent source is taken by
    date, not by the alphabetical order of its name.
    """
    q = F.col("quarter")
    yearly = quarterly.groupBy(*keys, "variable").agg(
        F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), q - 1))).cast("long").alias("quarters"),
        F.sum("value").alias("quarter_sum"),
        last_quarter(F.col("value"), q).alias("q4_value"),
        F.max_by("source", q).alias("latest_source"),
    )
    value = F.when((F.col("rule") == "sum") & (F.col("quarters") == QUARTERS), F.col("quarter_sum")).when(
        F.col("rule") == "last", F.col("q4_value")
    )
    return yearly.join(rules, "variable").withColumn("annual_value", value)


def splice(df: DataFrame, keys: list[str], value: str, source: str, preferred: str, other: str) -> DataFrame:
    """Keep the preferred source where both report a key, carrying the other value beside it.

    One conditional aggregation instead of a self join: a single shuffle on the keys.
    """
    new = F.max(F.when(F.col(source) == preferred, F.col(value)))
    old = F.max(F.when(F.col(source) == other, F.col(value)))
    has_new = F.max((F.col(source) == preferred).cast("int")) == 1
    return df.groupBy(*keys).agg(
        F.when(has_new, new).otherwise(old).alias(value),
        F.when(has_new, F.lit(preferred)).otherwise(F.lit(other)).alias(source),
        F.when(has_new, old).alias("previous_value"),
    )
