"""Streaming queries: the event table is landed as files and consumed incrementally."""

from __future__ import annotations

from pyspark.sql import functions as F

from comarca.plans.base import table
from comarca.plans.catalog import query
from comarca.plans.ingestion import _PULLS, _pulls
from comarca.session import scratch
from comarca.streaming import incremental as S


@query(
    "stream_annualize",
    """with q as (select user_id as unit, ts::date as day, hour(ts) // 6 + 1 as q, sum(value) as v from events group by 1, 2, 3)
    select unit, day, count(distinct q) as quarters, case when count(distinct q) = 4 then sum(v) end as flow, sum(v) filter (where q = 4) as stock
    from q group by 1, 2""",
    flow=6,
    stock=6,
)
def stream_annualize(spark, d):
    """Days play the years and six-hour blocks the quarters; files arrive in several micro-batches."""
    landing, target, mark = (scratch(spark, n) for n in ("landing", "annual", "mark"))
    ev = table(spark, d, "events").select(F.col("user_id").alias("unit"), "ts", "value")
    ev.repartitionByRange(6, "ts").write.parquet(landing)
    stream = S.file_stream(spark, landing, "unit long, ts timestamp_ntz, value double", 2)
    stream = stream.withColumn("day", F.to_date("ts"))
    quarter = F.floor(F.hour("ts") / 6).cast("int") + 1
    S.annualize_stream(stream, ["unit", "day"], "day", quarter, "value", target, mark).awaitTermination()
    return S.read_annual(spark, target, "unit long, day date", ["unit", "day"])


@query(
    "stream_ingest_once",
    "select event_type, count(*) as n, sum(value) as total from events group by 1",
    total=4,
)
def stream_ingest_once(spark, d):
    """Files land in two waves, the second repeats rows of the first; nothing is loaded twice."""
    landing, target, mark = (scratch(spark, n) for n in ("landing", "loaded", "mark"))
    ev = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    cut = F.lit("2024-01-15").cast("timestamp")
    again = F.lit("2024-01-12").cast("timestamp")
    schema = "event_id long, ts timestamp, event_type string, value double"

    def load() -> None:
        S.ingest_once(S.file_stream(spark, landing, schema), "event_id", target, mark).awaitTermination()

    ev.filter(F.col("ts") < cut).write.mode("append").parquet(landing)
    load()
    ev.filter(F.col("ts") >= again).write.mode("append").parquet(landing)
    load()
    loaded = spark.read.schema(schema + ", batch long").parquet(target)
    return loaded.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "stream_upsert_current",
    f"""with {_PULLS}, newest as (select source_id, max(pull_id) as pull_id from pulls group by 1)
    select source_id, pull_id, count(*) as n, sum(o_totalprice) as total from pulls join newest using (source_id, pull_id) group by 1, 2""",
    total=2,
)
def stream_upsert_current(spark, d):
    """Pulls arrive mixed over the files; the table always holds the newest pull of each source."""
    landing, target, mark = (scratch(spark, n) for n in ("landing", "current", "mark"))
    day = F.substring("pull_id", 2, 9).cast("int")  # pull number n was taken on day n
    pulls = _pulls(spark, d).select("source_id", "pull_id", day.alias("pulled_at"), "o_orderkey", "o_totalprice")
    pulls.repartition(4).write.parquet(landing)
    schema = "source_id string, pull_id string, pulled_at int, o_orderkey long, o_totalprice double"
    keys = ("source_id", "pull_id", "pulled_at")
    S.upsert_current(S.file_stream(spark, landing, schema, 1), *keys, target, mark).awaitTermination()
    current = S.read_current(spark, target, schema)
    return current.groupBy("source_id", "pull_id").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
