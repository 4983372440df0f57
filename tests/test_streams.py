"""Micro-batches touch only their own parts of the target, survive a retry and lose no late row."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from comarca.session import scratch
from comarca.streaming import incremental as S
from comarca.streaming import store


def folder(spark, *names):
    return [scratch(spark, n) for n in names]


def forget_last_commit(mark):
    """As after a crash between the write of a batch and its commit: the batch is run again."""
    commits = sorted(glob.glob(f"{mark}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(commits[-1])
    for crc in glob.glob(f"{mark}/commits/.{os.path.basename(commits[-1])}.crc"):
        os.remove(crc)


def test_years_are_merged_alone_and_late_rows_count(spark):
    landing, target, mark = folder(spark, "landing", "annual", "mark")
    schema = "unit int, year int, q int, v double"
    draw, rows = np.random.default_rng(2), []
    waves = [[(u, y, q) for u in range(3) for q in range(1, 5)] for y in range(2000, 2005)] + [[(1, 2000, 2), (9, 2000, 4), (9, 2004, 1)]]
    versions = []
    for wave in waves:
        new = [(u, y, q, float(draw.integers(1, 90))) for u, y, q in wave for _ in range(2)] if len(wave[0]) == 3 else wave
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(landing)
        S.annualize_stream(S.file_stream(spark, landing, schema), ["unit", "year"], "year", F.col("q"), "v", target, mark).awaitTermination()
        versions.append({p: store.newest(spark, f"{target}/_part={p}") for p in store.folders(spark, target, "_part")})
    assert list(versions[4].values()) == [0, 1, 2, 3, 4]  # closed years were not written again
    assert list(versions[5].values()) == [5, 1, 2, 3, 5]
    forget_last_commit(mark)
    S.annualize_stream(S.file_stream(spark, landing, schema), ["unit", "year"], "year", F.col("q"), "v", target, mark).awaitTermination()
    got = {(r["unit"], r["year"]): (r["quarters"], r["flow"], r["stock"]) for r in S.read_annual(spark, target, "unit int, year int", ["unit", "year"]).collect()}
    want = {}
    for u, y in {(r[0], r[1]) for r in rows}:
        mine = [r for r in rows if r[:2] == (u, y)]
        seen, last = {r[2] for r in mine}, [r[3] for r in mine if r[2] == 4]
        want[u, y] = (len(seen), sum(r[3] for r in mine) if len(seen) == 4 else None, sum(last) if last else None)
    assert got == want
    assert all(len(store.folders(spark, f"{target}/_part={p}", "_batch")) <= 2 for p in store.folders(spark, target, "_part"))


def test_a_batch_reads_the_shards_of_its_own_keys(spark, monkeypatch):
    landing, target, mark = folder(spark, "landing", "loaded", "mark")
    schema = "k string, v int"
    reads = []

    def counted(spark_, layout, schema_, parts=None, before=None):
        df = store.read_parts(spark_, layout, schema_, parts, before)
        reads.append((parts is None, df.count()))
        return df

    monkeypatch.setattr(S, "read_parts", counted)
    sent, expected = [], {}
    for n in range(12):
        if n == 0:
            new = [(f"key{i}", 0) for i in range(3000)]
        else:  # ten new keys, some late repeats and a repeat within the batch
            new = [(f"key{3000 + 10 * n + i}", n) for i in range(10)] + [(f"key{7 * n}", n), (f"key{3000 + 10 * n}", n), (f"key{2999 - n}", n)]
        sent += new
        for k, v in new:
            expected.setdefault(k, v)
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(landing)
        S.ingest_once(S.file_stream(spark, landing, schema), "k", target, mark, shard_keys=40).awaitTermination()
        if n == 6:
            forget_last_commit(mark)
            S.ingest_once(S.file_stream(spark, landing, schema), "k", target, mark, shard_keys=40).awaitTermination()
    got = [(r["k"], r["v"]) for r in spark.read.schema(schema + ", batch long").parquet(target).collect()]
    assert sorted(got) == sorted(expected.items())
    small = [n for whole, n in reads[2:] if not whole]
    assert max(small) <= 13 * 80 and np.mean(small[-4:]) < 1.5 * np.mean(small[:4])
    assert sum(whole for whole, _ in reads) == 1  # dealt anew once, after the first batch


def test_only_current_pulls_are_held(spark):
    landing, target, mark = folder(spark, "landing", "current", "mark")
    schema = "source string, pull string, at int, v int"
    waves = [
        ([("a/ä", "p9", 9, 1), ("b", "p1", 1, 5), (None, "p1", 1, 0)], {("a/ä", 1), ("b", 5), (None, 0)}),
        ([("a/ä", "p10", 10, 2), ("a/ä", "p9", 9, 7)], {("a/ä", 2), ("b", 5), (None, 0)}),
        ([("a/ä", "p10", 10, 3), ("a/ä", "p2", 2, 4)], {("a/ä", 2), ("a/ä", 3), ("b", 5), (None, 0)}),
    ]
    for rows, want in waves:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        for _ in range(2):
            S.upsert_current(S.file_stream(spark, landing, schema), "source", "pull", "at", target, mark).awaitTermination()
            held = S.read_current(spark, target, schema).select("source", "v").collect()
            assert len(held) == len(want) and {tuple(r) for r in held} == want
            forget_last_commit(mark)
        S.upsert_current(S.file_stream(spark, landing, schema), "source", "pull", "at", target, mark).awaitTermination()


@pytest.mark.parametrize("value", ["x", "a/b=c", "", None, "é"])
def test_part_names_are_plain(spark, value):
    name = spark.createDataFrame([(value,)], "s string").select(store.part_name(F.col("s"))).first()[0]
    assert name.isalnum()
