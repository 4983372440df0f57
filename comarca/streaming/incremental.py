"""Incremental annualisation, load-once ingestion and current-vintage upserts.

All three run until the input is exhausted (``availableNow``) and resume from their checkpoint. A batch reads and
replaces only the parts of the target that its own rows touch; a batch that is retried after a failure replaces
its own version instead of adding rows twice. Nothing is kept in executor memory between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from comarca.operators.annual import QUARTERS
from comarca.streaming.store import PART, folders, keep_two, read_parts, remove, replace_parts, write_parts

SHARD_KEYS = 100_000  # keys that a shard of the key log holds, about


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A directory of Parquet files as a stream; files already seen are remembered by the checkpoint."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _run(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    started = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return started.trigger(availableNow=True).foreachBatch(write).start()


def annualize_stream(
    stream: DataFrame, keys: list[str], year: str, quarter: Column, value: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Maintain the annual aggregate: one row per key, in one part per year.

    ``keys`` include ``year``. Streams have no distinct count; the quarters seen are a four-bit mask. A batch is
    summed by key first and merged with the years it touches, so a year costs nothing once its rows have come, and
    a row that comes years later is still counted exactly. ``read_annual`` applies the annual rule.
    """

    def summed(rows: DataFrame) -> DataFrame:
        sums = {c: F.sum(c) for c in ("quarter_sum", "q4_value")} | {"_mask": F.expr("bit_or(_mask)")}
        return rows.groupBy(*keys).agg(*[total.alias(c) for c, total in sums.items()])

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_q", quarter).select(
            *keys,
            F.col(value).alias("quarter_sum"),
            F.when(F.col("_q") == QUARTERS, F.col(value)).alias("q4_value"),
            F.expr("shiftleft(1, _q - 1)").alias("_mask"),
        )
        replace_parts(summed(rows), batch_id, target, F.col(year), lambda before, now: summed(before.unionByName(now)))

    return _run(stream, checkpoint, write)


def read_annual(spark: SparkSession, target: str, schema: str, keys: list[str]) -> DataFrame:
    """keys, quarters, flow (all quarters) and stock (the last one) from the newest version of every year."""
    rows = read_parts(spark, target, f"{schema}, quarter_sum double, _mask int, q4_value double")
    seen = F.bit_count("_mask").cast("long")
    return rows.select(
        *keys,
        seen.alias("quarters"),
        F.when(seen == QUARTERS, F.col("quarter_sum")).alias("flow"),
        F.col("q4_value").alias("stock"),
    )


def ingest_once(
    stream: DataFrame, key: str, target: str, checkpoint: str, shard_keys: int = SHARD_KEYS
) -> StreamingQuery:
    """Load every file once and every key once, however late it comes.

    The checkpoint remembers the files. Keys are held against a log beside the target (``<target>_keys``) that is
    cut into shards by hash: a batch reads the shards of its own keys, of about ``shard_keys`` keys each, and writes
    new versions of them. When shards grow beyond that the log is dealt into twice as many, which happens once per
    doubling. Nothing depends on event time and no row is too late; a retried batch replaces its own output.
    """
    log = f"{target}_keys"

    def shard(depth: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(1 << depth))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[key].dataType.simpleString()
        depth, total = _log_size(spark, log, batch_id)
        layout = f"{log}/depth={depth}"
        for other in folders(spark, log, "depth"):
            if int(other) != depth:  # dealt anew by an earlier batch, or by a try of this one that failed
                remove(spark, f"{log}/depth={other}")
        candidates = batch.dropDuplicates([key])
        touched = [r[0] for r in candidates.select(shard(depth).alias("s")).distinct().collect()]
        names = [f"{s:X}" for s in touched]
        known = read_parts(spark, layout, f"{key} {kind}", names, batch_id)
        out = f"{target}/batch={batch_id}"
        candidates.join(known, key, "left_anti").write.mode("overwrite").parquet(out)
        fresh = spark.read.schema(batch.schema).parquet(out)
        added = fresh.count()
        named = lambda rows, d: rows.withColumn(PART, F.hex(shard(d)))
        if added:
            write_parts(named(known.unionByName(fresh.select(key)), depth), batch_id, layout)
            for name in names:
                keep_two(spark, f"{layout}/{PART}={name}", batch_id)
        deeper = depth
        while total + added > shard_keys << deeper:
            deeper += 1
        if deeper > depth:
            every = read_parts(spark, layout, f"{key} {kind}", before=batch_id + 1)
            write_parts(named(every, deeper), batch_id, f"{log}/depth={deeper}")
        size = spark.createDataFrame([(deeper, total + added)], "depth int, total long").coalesce(1)
        size.write.mode("overwrite").parquet(f"{log}/sizes/batch={batch_id}")

    return _run(stream, checkpoint, write)


def _log_size(spark: SparkSession, log: str, before: int) -> tuple[int, int]:
    """Depth and number of keys of the log as the last batch before this one left it; older notes are removed."""
    batches = sorted(int(b) for b in folders(spark, f"{log}/sizes", "batch") if int(b) < before)
    if not batches:
        return 0, 0
    for old in batches[:-2]:
        remove(spark, f"{log}/sizes/batch={old}")
    row = spark.read.schema("depth int, total long").parquet(f"{log}/sizes/batch={batches[-1]}").first()
    return row["depth"], row["total"]


def upsert_current(
    stream: DataFrame, source: str, pull: str, pulled_at: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Keep, for every source, the rows of its newest pull seen so far and no others.

    A source is a part of the target. A batch with a newer pull replaces it, one with more rows of the same pull adds
    them, and rows of older pulls are dropped. Pulls are ordered by the time they were taken, not by their names.
    """

    def newer(before: DataFrame, now: DataFrame) -> DataFrame:
        return _of_newest(before.unionByName(now), source, pull, pulled_at)

    def write(batch: DataFrame, batch_id: int) -> None:
        replace_parts(_of_newest(batch, source, pull, pulled_at), batch_id, target, F.col(source), newer)

    return _run(stream, checkpoint, write)


def _of_newest(rows: DataFrame, source: str, pull: str, pulled_at: str) -> DataFrame:
    """The rows of each source's newest pull; rows without a source are one source."""
    newest = rows.groupBy(F.col(source).alias("_s")).agg(F.max_by(pull, F.struct(pulled_at, pull)).alias("_p"))
    same = F.col(source).eqNullSafe(F.col("_s")) & F.col(pull).eqNullSafe(F.col("_p"))
    return rows.join(newest, same, "left_semi")


def read_current(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """All rows of the current pulls."""
    return read_parts(spark, target, schema)
