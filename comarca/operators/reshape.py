"""Wide/long reshaping, period spine and columnar export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comarca.functions.text import period_id

# Data status by the suffix of a published year.
STATUS = {"": "definitivo", "p": "provisional", "pr": "preliminar"}
YEAR_PATTERN = r"^\s*(\d{4})\s*(p|pr)?\s*$"
CHUNK = 4096


def year_of(label: Column) -> Column:
    return F.when(label.rlike(YEAR_PATTERN), F.regexp_extract(label, YEAR_PATTERN, 1).try_cast("int"))


def status_of(label: Column) -> Column:
    suffix = F.regexp_extract(label, YEAR_PATTERN, 2)
    out = F.lit(None).cast("string")
    for key, name in STATUS.items():
        out = F.when(suffix == key, F.lit(name)).otherwise(out)
    return F.when(label.rlike(YEAR_PATTERN), out)


def melt_year_columns(wide: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Columns headed by a year (``2024p``) to rows (keys, year, status, measure, value)."""
    import re

    year_cols = [c for c in wide.columns if re.match(YEAR_PATTERN, c)]
    long = wide.unpivot(keys, year_cols, "label", "value")
    return long.select(
        *keys,
        year_of(F.col("label")).alias("year"),
        status_of(F.col("label")).alias("status"),
        F.lit(measure).alias("measure"),
        "value",
    )


def widen_observed(long: DataFrame, keys: list[str], measure: str, value: str, measures: list[str]) -> DataFrame:
    """Measures as columns over the key combinations that exist; never their Cartesian product."""
    return long.groupBy(*keys).pivot(measure, measures).agg(F.first(value, ignorenulls=True))


def unpivot_blocks(df: DataFrame, keep: list[str], block: str, columns_of: dict[str, list[str]]) -> DataFrame:
    """One row per (row, column of its own block), in a single scan.

    Each row builds an array holding only the columns its block can carry; values outside the block
    never exist, so structural zeros disappear.
    """
    cells = F.lit(None).cast("array<struct<column:string,value:double>>")
    for name, cols in columns_of.items():
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
        )
        cells = F.when(F.col(block) == name, pairs).otherwise(cells)
    return df.select(*keep, block, F.inline(cells))


def date_spine(spark: SparkSession, first_year: int, last_year: int, q_from: int, m_from: int) -> DataFrame:
    """Annual, quarterly and monthly periods in one table, from a single monthly sequence."""
    months = spark.range(1).select(
        F.explode(
            F.sequence(
                F.make_date(F.lit(first_year), F.lit(1), F.lit(1)),
                F.make_date(F.lit(last_year), F.lit(12), F.lit(1)),
                F.expr("interval 1 month"),
            )
        ).alias("start_date")
    )
    return periods_from_months(months, q_from, m_from)


def periods_from_months(months: DataFrame, q_from: int, m_from: int) -> DataFrame:
    """``months`` has one ``start_date`` per month."""
    day = F.col("start_date")
    year, quarter, month = F.year(day), F.quarter(day), F.month(day)
    none = F.lit(None).cast("int")

    def row(freq: str, q: Column, m: Column, months_long: int, keep: Column) -> Column:
        return F.when(
            keep,
            F.struct(
                period_id(day, freq).alias("period_id"),
                F.lit(freq).alias("frequency"),
                year.alias("year"),
                q.alias("quarter"),
                m.alias("month"),
                day.alias("start_date"),
                F.last_day(F.add_months(day, months_long - 1)).alias("end_date"),
                year.cast("string").alias("year_id"),
            ),
        )

    rows = F.array_compact(
        F.array(
            row("A", none, none, 12, month == 1),
            row("Q", quarter, none, 3, month.isin(1, 4, 7, 10) & (year >= q_from)),
            row("M", quarter, month, 1, year >= m_from),
        )
    )
    return months.select(F.inline(rows))


def dense_index(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """0-based position of each distinct key in key order, without one global sort task.

    Keys are cut into ranges by their approximate quantiles; a position is the size of the earlier
    ranges plus the row number inside the range.
    """
    from comarca.operators.ranking import range_offsets

    keys = df.select(key).distinct()
    ranged, offsets = range_offsets(keys.withColumn("_n", F.lit(1)), key, "_n")
    w = Window.partitionBy("_range").orderBy(key)
    return (
        ranged.withColumn("_r", F.row_number().over(w))
        .join(offsets, "_range")
        .select(key, (F.col("_before") + F.col("_r") - 1).alias(name))
    )


def export_year_matrix(df: DataFrame, unit: str, year: str, indicators: dict[str, int], chunk: int = CHUNK) -> DataFrame:
    """Indicator by year as ordered arrays over the units, NULL where nobody measured.

    Units are cut into fixed-size chunks, so no row holds more than ``chunk`` cells however many
    units there are. Columns: indicator, year, chunk, values.
    """
    from comarca.functions.collect import ordered_values

    position = dense_index(df, unit)
    size = position.groupBy((F.col("position") / chunk).cast("int").alias("chunk")).agg(F.count("*").alias("_size"))
    cols = {k: F.round(F.col(k).cast("double"), d) for k, d in indicators.items()}
    long = (
        df.select(unit, year, *[c.alias(k) for k, c in cols.items()])
        .unpivot([unit, year], list(indicators), "indicator", "value")
        .join(position, unit)
        .withColumn("chunk", (F.col("position") / chunk).cast("int"))
        .withColumn("_slot", (F.col("position") % chunk).cast("int"))
    )
    cells = long.groupBy("indicator", year, "chunk").agg(F.collect_list(F.struct("_slot", "value")).alias("_cells"))
    return cells.join(size, "chunk").select(
        "indicator", year, "chunk", ordered_values(F.col("_cells"), F.col("_size")).alias("values")
    )


def attach_projection(observed: DataFrame, projected: DataFrame, unit: str, year: str, width: str) -> tuple:
    """(union with a ``projected`` flag, violations).

    Violations: a projected year that already exists as observed, and a projected cell without the
    width of its interval.
    """
    clash = (
        projected.select(year)
        .distinct()
        .join(observed.select(year).distinct(), year, "left_semi")
        .select(F.lit("year_already_observed").alias("check"), F.col(year).cast("string").alias("key"))
    )
    bare = projected.filter(F.col(width).isNull()).select(
        F.lit("interval_missing").alias("check"),
        F.concat_ws("/", F.col(unit).cast("string"), F.col(year).cast("string")).alias("key"),
    )
    joined = observed.withColumn("projected", F.lit(False)).unionByName(
        projected.withColumn("projected", F.lit(True)), allowMissingColumns=True
    )
    return joined, clash.unionByName(bare)
