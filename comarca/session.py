"""Session settings and the shared scratch folder.

No module in this package hints a broadcast. Which side of a join is small enough is decided by
Spark from file sizes (``autoBroadcastJoinThreshold``) and, under AQE, from measured shuffle sizes;
beyond the threshold the same join runs as a shuffle join.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


#: Applications whose executors have the package already.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which may start in a folder without it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="comarca-")  # on the driver, whose file server reads it until the end
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "comarca.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for where, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every query relies on. Cluster sizing is left to the cluster."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("comarca")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, which the cluster names in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver gets a folder of its own; anywhere else a
    machine-local folder would lose rows, so a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    created = tempfile.mkdtemp(prefix="/tmp/spark-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


#: Below the shared folder each application writes to one of its own, which goes when the application ends.
_OWN: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the application's part of the shared folder."""
    context = spark.sparkContext
    key = (context.applicationId, shared_dir(spark))
    if key not in _OWN:
        own = f"{key[1].rstrip('/')}/comarca-{key[0]}-{uuid.uuid4().hex[:8]}"
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _OWN[key] = own
    return f"{_OWN[key]}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used where several later jobs need the same intermediate result. The written table survives the
    loss of executors and cuts the lineage.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
