"""Typed ingestion, manifests and vintages."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.functions.numeric import clean_double, is_distinct
from comarca.session import settle

UNDATED = "sin_fecha"

MANIFEST_SCHEMA = (
    "pull_id string, source_id string, dataset_id string, url string, params map<string,string>, "
    "pulled_at string, source_updated_at string, row_count long, bytes long, sha256 string, "
    "path string, license string, tool string, notes string"
)


def type_columns(
    df: DataFrame,
    *,
    numeric: list[str] | None = None,
    numeric_regex: str | None = None,
    dates: list[str] | None = None,
    codes: list[str] | None = None,
) -> DataFrame:
    """Type text columns by metadata. Unreadable values become NULL; codes stay text."""
    codes_set = set(codes or [])
    kinds = dict(df.dtypes)
    wanted = set(numeric or [])
    if numeric_regex:
        wanted |= {c for c in df.columns if re.search(numeric_regex, c)}
    out: dict[str, Column] = {}
    for c in df.columns:
        if c in wanted - codes_set and kinds[c] == "string":
            out[c] = clean_double(F.col(c))
        elif c in (dates or []) and kinds[c] == "string":
            out[c] = F.col(c).try_cast("date")
    return df.withColumns(out) if out else df


def year_partition(day: Column) -> Column:
    """Partition value of a date or text date: the year, or the undated bucket."""
    return F.coalesce(F.year(day.try_cast("date")).cast("string"), F.lit(UNDATED))


def write_partitioned(df: DataFrame, path: str, day_col: str, only_changed: bool = False) -> None:
    """Replace a source, one partition per year; rows without a readable date get their own.

    Rows are rebalanced by year before writing: AQE merges small years into one task and splits a year
    that holds a third of the data into as many as its size needs. With ``only_changed`` the years
    absent from ``df`` survive.
    """
    keyed = df.withColumn("anio", year_partition(F.col(day_col)))
    writer = keyed.hint("rebalance", F.col("anio")).write.mode("overwrite").partitionBy("anio")
    writer.option("partitionOverwriteMode", "dynamic" if only_changed else "static").parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read a year-partitioned source; the year is text because of the undated bucket."""
    reader = spark.read
    if schema:
        reader = reader.schema(schema + ", anio string")
    return reader.parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON-lines manifest with a fixed schema; a broken line fails the read."""
    return spark.read.schema(MANIFEST_SCHEMA).option("mode", "FAILFAST").json(path)


def latest_pull(records: DataFrame, source: str, pull: str, order: str) -> DataFrame:
    """All rows of the newest pull of each source. The pull table is tiny next to the rows."""
    newest = records.groupBy(source).agg(F.max_by(pull, order).alias(pull))
    return records.join(newest, [source, pull], "left_semi")


def with_current_flag(records: DataFrame, source: str, pull: str, order: str) -> DataFrame:
    """Facts carry the pull they came from and whether it is the current one."""
    newest = records.groupBy(source).agg(F.max_by(pull, order).alias("_newest"))
    return records.join(newest, source).withColumn("is_current", F.col(pull) == F.col("_newest")).drop("_newest")


#: Read settings under which every file is one partition of its own, uncut: 16 TB a file, half a million files.
WHOLE_FILES = {
    "spark.sql.files.maxPartitionBytes": str(1 << 44),
    "spark.sql.files.openCostInBytes": str(1 << 44),
    "spark.sql.files.minPartitionNum": "1",
}
MARK = b"\xef\xbb\xbf"  # a byte order mark, which the line reader leaves out at the start of a file


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """path, length, sha256 of every file below root, hashed in blocks by the executors.

    A file is read by Spark's line reader, cut at newline bytes only, and its lines are hashed with the newlines put
    back: a task holds one batch of lines, whatever the size of the file (2 GB without a newline byte are too long for
    a line). The length that the file system tells is held against the bytes hashed, which also shows whether a
    newline ends the file and whether a byte order mark was left out; a file that fits neither way is an error.
    Names that begin with a dot or underscore are not read.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(root)
    lines = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # path: bytes so far, size, digest, digest with a mark in front
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes, bodies = batch.column(1), batch.column(2)
            cuts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]] + [len(ids)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                known = held.setdefault(ids[start], [-1, sizes[start].as_py(), hashlib.sha256(), hashlib.sha256(MARK)])
                block = b"\n".join(bodies.slice(start, end - start).to_pylist())
                block = b"\n" + block if known[0] >= 0 else block
                known[0] = max(known[0], 0) + len(block)
                known[2].update(block)
                known[3].update(block)
        rows = []
        for path, (n, size, plain, marked) in held.items():
            chosen = marked if size - n in (3, 4) else plain
            if size - n in (1, 4):
                chosen.update(b"\n")
            elif size - n not in (0, 3):
                raise ValueError(f"{path}: {n} bytes read of {size}")
            rows.append((path, chosen.hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "sha256"])

    before = {name: spark.conf.get(name, None) for name in WHOLE_FILES}
    try:
        for name, value in WHOLE_FILES.items():
            spark.conf.set(name, value)
        hashed = settle(lines.mapInArrow(run, "path string, sha256 string"), "digests")  # read under these settings
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    files = spark.createDataFrame(list(_files(spark, root)), "path string, length long")
    decoded = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    joined = files.join(hashed.withColumn("path", decoded), "path", "left")
    bare = {0: b"", len(MARK): MARK}  # files without a line
    digest = F.col("sha256")
    for size, body in bare.items():
        digest = F.when(F.col("length") == size, F.coalesce("sha256", F.lit(hashlib.sha256(body).hexdigest()))).otherwise(digest)
    return joined.select("path", "length", digest.alias("sha256"))


def _files(spark: SparkSession, root: str) -> Iterator[tuple[str, int]]:
    """Names and lengths of the files below root, as the file system lists them."""
    context = spark.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(root)
    found = top.getFileSystem(context._jsc.hadoopConfiguration()).listFiles(top, True)
    while found.hasNext():
        file = found.next()
        if not file.getPath().getName().startswith((".", "_")):
            yield re.sub("^file:/+", "/", file.getPath().toString()), file.getLen()


def checksum_audit(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """Files of the manifest that are missing or whose content hash changed.

    ``path`` in the manifest is relative to ``root``.
    """
    base = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    files = file_digests(spark, root).select(
        F.replace(F.col("path"), F.lit(base), F.lit("")).alias("path"), F.col("sha256").alias("_sha")
    )
    problem = F.when(F.col("_sha").isNull(), F.lit("missing")).when(
        F.col("_sha") != F.col("sha256"), F.lit("changed")
    )
    joined = manifest.withColumn("path", F.replace(F.col("path"), F.lit("\\"), F.lit("/"))).join(files, "path", "left")
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(
        "path", "pull_id", "problem"
    )


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows, fingerprint: a 128-bit hash of the rows as a set with repeats, whatever their order or partitioning.

    A row's columns are written as text with their lengths, so that no two rows look alike; null is different from
    every text. Its md5 is cut into two 64-bit numbers, which are added up modulo 2^64 over all rows. Columns must
    have a stable text: decimals instead of doubles.
    """
    text = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (F.col(c).cast("string") for c in columns)]
    row = F.md5(F.encode(F.concat_ws("|", *text), "UTF-8"))
    half = lambda at: F.conv(F.substring(row, at, 16), 16, 10).cast("decimal(20,0)")
    wrapped = lambda c: F.lpad(F.lower(F.conv((F.col(c) % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("string"), 10, 16)), 16, "0")
    sums = df.select(half(1).alias("a"), half(17).alias("b")).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.col("a").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("a"),
        F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("b"),
    )
    return sums.select("rows", F.concat(wrapped("a"), wrapped("b")).alias("fingerprint"))


def load_by_name(*parts: DataFrame) -> DataFrame:
    """Union matched by column name, case-insensitively; a column absent from a part is NULL there."""
    first = parts[0]
    out = first
    for part in parts[1:]:
        have = {c.lower(): c for c in out.columns}
        renamed = part.select(*[F.col(c).alias(have.get(c.lower(), c)) for c in part.columns])
        out = out.unionByName(renamed, allowMissingColumns=True)
    return out


def variant_long(df: DataFrame, payload: str, keep: list[str], known: dict[str, str]) -> DataFrame:
    """JSON payload to typed known keys plus one (key, value) row for every other key."""
    parsed = df.withColumn("_m", F.from_json(F.col(payload), "map<string,string>"))
    typed = [F.col("_m")[k].try_cast(t).alias(k) for k, t in known.items()]
    rest = F.map_filter("_m", lambda k, v: ~k.isin(list(known))) if known else F.col("_m")
    return parsed.select(*keep, *typed, F.explode(rest).alias("key", "val"))


def file_key(pattern: str = r"([^/]+)\.[A-Za-z0-9]+$") -> Column:
    """Pull id carried by the file name."""
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value changed, appeared or vanished between two vintages."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("_b"))
    return (
        a.join(b, keys, "full")
        .filter(F.col("_a").isNull() | F.col("_b").isNull() | is_distinct(F.col("old_value"), F.col("new_value")))
        .drop("_a", "_b")
    )


def snapshot_as_of(df: DataFrame, keys: list[str], order: str, at: Column) -> DataFrame:
    """The state of each key at a past moment: its newest row not later than ``at``.

    An aggregation, not a window: a key with a long history is reduced map-side.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = df.filter(F.col(order) <= at).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_s"))
    return newest.select(*keys, "_s.*")


def layout_by_period(df: DataFrame, path: str, day_col: str, grain: str, cluster: list[str]) -> None:
    """Write partitioned by period bucket and clustered by keys inside each file.

    The range split is over (period, keys), so a heavy period spans several files; their number
    follows the session's shuffle partitions.
    """
    bucketed = df.withColumn("period", F.to_date(F.date_trunc(grain, F.col(day_col))))
    (
        bucketed.repartitionByRange("period", *cluster)
        .sortWithinPartitions("period", *cluster)
        .write.mode("overwrite")
        .partitionBy("period")
        .parquet(path)
    )
