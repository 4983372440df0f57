"""Expectations. Each returns the violations as rows: an empty frame means the data passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca.functions.numeric import is_distinct


def row_count_check(loaded: DataFrame, declared: DataFrame, key: str, expected: str) -> DataFrame:
    got = loaded.groupBy(key).agg(F.count("*").alias("loaded"))
    return (
        declared.join(got, key, "full")
        .withColumn("loaded", F.coalesce("loaded", F.lit(0)))
        .filter(is_distinct(F.col(expected), F.col("loaded")))
        .select(key, expected, "loaded")
    )


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def is_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of missing values per column, one scan for all columns; clean columns do not appear."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "missing").filter("missing > 0")


def not_accepted(df: DataFrame, column: str, accepted: list) -> DataFrame:
    return (
        df.filter(~F.col(column).isin(accepted))
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def orphans(df: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Keys without a partner in the dimension and how many rows carry them."""
    lone = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return lone.join(dim.select(F.col(dim_key).alias(key)).distinct(), key, "left_anti")


def violates(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is false. An unknown outcome is not a violation."""
    return df.filter(~predicate)


def out_of_range(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.filter((F.col(column) < low) | (F.col(column) > high))


def schema_report(df: DataFrame, types: dict[str, str], rules: dict[str, Column]) -> DataFrame:
    """(check, failures): columns missing or of another type, and rows failing each named rule.

    All row rules are counted in one scan.
    """
    have = dict(df.dtypes)
    wrong = [f"type:{c}" for c, t in types.items() if have.get(c) != t]
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    rows = counts.unpivot([], list(rules), "check", "failures")
    if wrong:
        typed = df.sparkSession.createDataFrame([(w, 1) for w in wrong], "check string, failures long")
        rows = rows.unionByName(typed)
    return rows.filter("failures > 0")


def pinned_figures(measures: DataFrame, pinned: DataFrame) -> DataFrame:
    """Published figures the tables no longer produce. ``pinned``: measure, expected, tolerance."""
    gap = F.abs(F.col("got") - F.col("expected"))
    return pinned.join(measures, "measure", "left").filter(F.col("got").isNull() | (gap > F.col("tolerance")))


def total_vs_members(df: DataFrame, keys: list[str], value: str, is_total: Column, tolerance: Column) -> DataFrame:
    """Published total rows against the sum of their members, in one aggregation."""
    both = df.groupBy(*keys).agg(
        F.sum(F.when(is_total, F.col(value))).alias("total"),
        F.sum(F.when(~is_total, F.col(value))).alias("members"),
        F.first(tolerance).alias("tolerance"),
    )
    scale = F.greatest(F.abs("members"), F.lit(1.0))
    gap = F.abs(F.col("total") - F.col("members"))
    return both.filter(gap > scale * F.col("tolerance")).withColumn("relative_gap", gap / scale)


def share_at_most(df: DataFrame, bad: Column, limit: float) -> DataFrame:
    """One row when more than ``limit`` of the rows are bad."""
    return df.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).filter(F.col("bad") > limit * F.col("n"))


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tol: float = 1e-6) -> DataFrame:
    """Differences between two tables aligned by key, whatever their row order."""
    left = a.select(*keys, F.struct(*values).alias("_a"))
    right = b.select(*keys, F.struct(*values).alias("_b"))

    def differs(c: str) -> Column:
        x, y = F.col("_a")[c], F.col("_b")[c]
        far = F.abs(x - y) > F.lit(tol) * F.greatest(F.lit(1.0), F.abs(x))
        return F.when(x.isNull() & y.isNull(), False).otherwise(F.coalesce(far, F.lit(True)))

    cells = F.array_compact(
        F.array(
            *[
                F.when(
                    differs(c),
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col("_a")[c].cast("double").alias("old"),
                        F.col("_b")[c].cast("double").alias("new"),
                    ),
                )
                for c in values
            ]
        )
    )
    side = (
        F.when(F.col("_b").isNull(), "only_old").when(F.col("_a").isNull(), "only_new").otherwise("changed")
    )
    return left.join(right, keys, "full").select(*keys, side.alias("side"), F.inline(cells))


def ledger(obtained: DataFrame, expected: DataFrame, key: str, tol: str = "tol") -> DataFrame:
    """Verdict of each published figure by relative tolerance."""
    rel = F.abs(F.col("obtained") - F.col("expected")) / F.greatest(F.abs("expected"), F.lit(1e-9))
    verdict = (
        F.when(F.col("expected").isNull(), "no_data")
        .when(F.col("obtained").isNull(), "not_estimated")
        .when(rel <= F.col(tol), "ok")
        .otherwise("differs")
    )
    return expected.join(obtained, key, "full").withColumn("verdict", verdict)


def complete_rows(df: DataFrame, column_sets: dict[str, list[str]]) -> DataFrame:
    """Complete rows of each candidate column set, all counted in one scan."""

    def full(cols: list[str]) -> Column:
        return reduce(lambda p, c: p & F.col(c).isNotNull(), cols, F.lit(True))

    counts = df.agg(*[F.count_if(full(cols)).alias(name) for name, cols in column_sets.items()])
    return counts.unpivot([], list(column_sets), "sample", "rows")
