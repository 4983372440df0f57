"""Frames whose doubles differ in their last bits each time they are computed, as sums over a shuffle do."""

import random

import pytest
from pyspark.sql import functions as F

from comarca.operators import ranking
from comarca.plans import CATALOG, ingestion, joining


@pytest.fixture
def anew():
    """Makes a column that differs by some 1e-13 of itself at each evaluation."""
    jitter = F.udf(lambda v: v * (1 + random.SystemRandom().random() * 1e-13), "double").asNondeterministic()
    return jitter


def test_quantiles_lose_no_group(spark, anew):
    rows = [(g, 0.1 if g % 2 else 0.1 + i / 10) for g in range(40) for i in range(5)]
    df = spark.createDataFrame(rows, "g int, v double").select("g", anew("v").alias("v"))
    got = {r["g"]: r["m"] for r in ranking.exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == pytest.approx({g: 0.1 if g % 2 else 0.3 for g in range(40)}, rel=1e-9)


def test_vintages_share_their_sums(spark, anew, monkeypatch):
    rows = [(u, y, q, 1000.0 * u + y + q) for u in range(3) for y in range(1994, 2002) for q in range(1, 5)]
    facts = spark.createDataFrame(rows, "unit int, year int, quarter int, amount double")
    monkeypatch.setattr(ingestion, "quarterly", lambda spark, d: facts.withColumn("amount", anew("amount")))
    got = {(r["unit"], r["year"], r["quarter"]) for r in CATALOG["snapshot_diff"].run(spark, "").collect()}
    assert got == {(u, *at) for u in range(3) for at in ((1995, 1), (2000, 2), (2002, 1))}


def test_columns_are_summed_before_they_meet_their_variables(spark, monkeypatch):
    rows = [("old", "l_quantity", 1.5), ("old", "l_quantity", None), ("old", "x", 9.0), ("new", "qty", 2.0), ("new", "qty", 4.0)]
    long = spark.createDataFrame(rows, "source string, column string, value double")
    monkeypatch.setattr(joining, "two_sources_long", lambda spark, d: long)
    monkeypatch.setattr(joining, "VARIABLES", [*joining.VARIABLES, ("again", "l_quantity", "")])
    df = joining.join_variable_map(spark, "")
    want = {("quantity_total", "old", 2, 1.5), ("again", "old", 2, 1.5), ("quantity_total", "new", 2, 6.0)}
    assert {(r["variable"], r["source"], r["n"], r["total"]) for r in df.collect()} == want
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, x in enumerate(lines) if "Join" in x) < max(i for i, x in enumerate(lines) if "Aggregate" in x)
