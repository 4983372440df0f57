"""Tables whose parts are replaced by micro-batches: a part is a folder, a batch writes a new version of it.

A version is made from the newest one of an earlier batch, so a batch that is retried after a failure makes the same
version again. Only the parts that a batch touches are read and written, and a reader takes the newest version of
each. Two versions are kept: the current one, and the one from which a retry of the current one would start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART, BATCH = "_part", "_batch"


def _store(spark: SparkSession, path: str):
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(context._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows ``prefix=`` in the names of a folder's subfolders."""
    where, store = _store(spark, path)
    if not store.exists(where):
        return []
    names = [s.getPath().getName() for s in store.listStatus(where) if s.isDirectory()]
    return sorted(n.removeprefix(f"{prefix}=") for n in names if n.startswith(f"{prefix}="))


def remove(spark: SparkSession, path: str) -> None:
    where, store = _store(spark, path)
    store.delete(where, True)


def newest(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The last batch of a part's versions, or the last one before a batch."""
    batches = [int(b) for b in folders(spark, path, BATCH)]
    return max((b for b in batches if before is None or b < before), default=None)


def part_name(value: Column) -> Column:
    """A folder name for any value of a column."""
    return F.coalesce(F.concat(F.lit("v"), F.hex(F.encode(value.cast("string"), "UTF-8"))), F.lit("null"))


def read_parts(spark: SparkSession, target: str, schema: str, parts: Iterable[str] | None = None, before: int | None = None) -> DataFrame:
    """The newest versions (before a batch) of some parts or of all."""
    paths = []
    for part in folders(spark, target, PART) if parts is None else parts:
        version = newest(spark, f"{target}/{PART}={part}", before)
        if version is not None:
            paths.append(f"{target}/{PART}={part}/{BATCH}={version}")
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replace_parts(
    batch: DataFrame, batch_id: int, target: str, part: Column, merge: Callable[[DataFrame, DataFrame], DataFrame]
) -> None:
    """Write merge(rows before, rows of the batch) as a new version of every part that the batch touches.

    ``batch`` has the columns of the table. The names of the touched parts reach the driver.
    """
    spark, columns = batch.sparkSession, batch.columns
    touched = [r[0] for r in batch.select(part_name(part).alias(PART)).distinct().collect()]
    if not touched:
        return
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    after = merge(read_parts(spark, target, schema, touched, batch_id), batch).select(*columns)
    write_parts(after.withColumn(PART, part_name(part)), batch_id, target)
    for name in touched:
        keep_two(spark, f"{target}/{PART}={name}", batch_id)


def write_parts(rows: DataFrame, batch_id: int, target: str) -> None:
    """Rows with a column of part names as versions of a batch; versions of other parts stay."""
    (
        rows.withColumn(BATCH, F.lit(batch_id))
        .write.option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .partitionBy(PART, BATCH)
        .parquet(target)
    )


def keep_two(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove the versions older than the one that a retry of this batch starts from."""
    start = newest(spark, path, batch_id)
    for b in folders(spark, path, BATCH):
        if start is not None and int(b) < start:
            remove(spark, f"{path}/{BATCH}={b}")
