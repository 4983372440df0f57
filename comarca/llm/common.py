"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comarca.session import settle

#: Rows and bytes of one Arrow batch handed to Python; whole texts of any length fit one by one.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20
SENT_ROWS = 500_000


def arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def unused(columns: list[str], name: str) -> str:
    """A column name that is not taken, whatever the input is called."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, xxhash64 of the text) is not among the (doc_id, row) of rows.

    A null doc_id equals a null doc_id. The keys are sent to the tasks up to SENT_ROWS of them, and joined by
    shuffle beyond.
    """
    name, row = unused(docs.columns, "gone"), unused(docs.columns, "gone_row")
    gone = settle(rows.select(F.col("doc_id").alias(name), F.col("row").alias(row)).distinct(), "gone")
    sent = F.broadcast(gone) if gone.count() <= SENT_ROWS else gone
    same = F.col("doc_id").eqNullSafe(F.col(name)) & (F.xxhash64("text") == F.col(row))
    return docs.join(sent, same, "left_anti")


def numbered(df: DataFrame, by: str, order: list[str], rank: str, rows_per_bucket: int = 20_000) -> DataFrame:
    """Add a gapless rank from 0 within each value of `by`.

    A class may hold most of the rows. Each is cut into buckets which are ordered on their own and linked by
    their counts, so that no task sorts a whole class. The bucket is written with the rows: reading it again
    after the loss of an executor gives the same ranks.
    """
    held = settle(df.withColumn("_spread", F.monotonically_increasing_id()), "numbered")
    buckets = max(8, math.ceil(held.count() / rows_per_bucket))
    held = held.withColumn("_bucket", F.pmod(F.xxhash64("_spread"), F.lit(buckets)).cast("int")).drop("_spread")
    before = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(F.col(by).alias("_by"), F.col("_bucket").alias("_at")).agg(F.count("*").alias("_n"))
    firsts = counts.select("_by", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order))
    return (
        held.withColumn("_inside", inside)
        .join(firsts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_at")), "inner")
        .withColumn(rank, (F.col("_inside") - 1 + F.col("_first")).cast("long"))
        .drop("_inside", "_first", "_by", "_at", "_bucket")
    )
