"""No row, key or period is lost to a fixed bound: late rows, long keys, small and large groups, later years."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from comarca import session
from comarca.operators import ranking
from comarca.operators.reshape import dense_index
from comarca.session import scratch
from comarca.streaming import incremental as S


def test_late_rows_are_loaded_and_repeats_are_not(spark):
    landing, target, mark = (scratch(spark, n) for n in ("landing", "loaded", "mark"))
    schema = "event_id long, ts timestamp, value double"

    def land(*rows):
        frame = spark.createDataFrame(rows, "event_id long, ts string, value double")
        frame.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(landing)
        S.ingest_once(S.file_stream(spark, landing, schema), "event_id", target, mark).awaitTermination()

    land((1, "2024-06-01", 1.0), (1, "2024-06-01", 1.0), (2, "2024-06-02", 2.0))
    land((3, "2024-01-01", 3.0), (2, "2024-06-02", 2.0))
    land((4, "2023-01-01", 4.0))
    got = spark.read.schema(schema + ", batch long").parquet(target)
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3, 4]


def test_the_newest_pull_is_newest_by_time(spark):
    landing, target, mark = (scratch(spark, n) for n in ("landing", "current", "mark"))
    schema = "source string, pull string, at int, v int"
    for rows in ([("a", "p9", 9, 1), ("b", "p1", 1, 5)], [("a", "p10", 10, 2), ("a", "p10", 10, 3)], [("a", "p2", 2, 4)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)
        S.upsert_current(S.file_stream(spark, landing, schema, 1), "source", "pull", "at", target, mark).awaitTermination()
    got = S.read_current(spark, target, schema).select("source", "pull", "v").collect()
    assert sorted(map(tuple, got)) == [("a", "p10", 2), ("a", "p10", 3), ("b", "p1", 5)]


def test_keys_with_a_long_common_prefix_use_many_ranges(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("Customer#0000000"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("k"))
    ranged, _ = ranking.range_offsets(keys.withColumn("n", F.lit(1)), "k", "n")
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) >= ranking.MIN_RANGES - 1 and max(sizes) < 20_000 / 4
    got = dense_index(keys, "k").toPandas().sort_values("k")
    assert (got.position.to_numpy() == np.arange(20_000)).all()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 40_000])
def test_quantiles_of_groups_of_any_size(spark, n):
    draw = np.random.default_rng(n)
    pdf = pd.DataFrame({"g": np.repeat([0, 1], [n, 5]), "v": np.concatenate([draw.normal(size=n).round(3), [1, 1, 1, 2, 9]])})
    probs = {"a": 0.0, "q": 0.25, "m": 0.5, "h": 0.9, "z": 1.0}
    got = ranking.exact_quantiles(spark.createDataFrame(pdf).repartition(7), ["g"], "v", probs).toPandas().set_index("g")
    assert len(got) == 2
    for g, rows in pdf.groupby("g"):
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(rows.v.quantile(p), abs=1e-12)


def test_a_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Bare:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Bare())
