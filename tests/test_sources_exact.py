"""Digests of files of any size, fingerprints of tables, refused panels, and borders with many holders."""

import hashlib
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from comarca.operators import forecast as P
from comarca.operators import star as S
from comarca.sources import ingest as I


def test_digests_in_blocks(spark, tmp_path):
    draw = random.Random(1)
    bodies = {
        "empty": b"", "newline": b"\n", "no_end": b"a\nb", "end": b"a\nb\n", "returns": b"a\r\nb\rc\r\n\n\n", "mark": b"\xef\xbb\xbfx\ny",
        "mark_end": b"\xef\xbb\xbfx\n", "mark_alone": b"\xef\xbb\xbf", "binary": draw.randbytes(3_000_000), "zeros": bytes(500_000),
        "many lines": b"\n".join(str(i).encode() for i in range(200_000)), "sub/a+b%20é": draw.randbytes(1000) + b"\n",
    }
    os.makedirs(tmp_path / "sub")
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    before = {k: spark.conf.get(k, None) for k in I.WHOLE_FILES}
    got = {os.path.relpath(r["path"], tmp_path): (r["length"], r["sha256"]) for r in I.file_digests(spark, str(tmp_path)).collect()}
    assert got == {name: (len(b), hashlib.sha256(b).hexdigest()) for name, b in bodies.items()}
    assert {k: spark.conf.get(k, None) for k in I.WHOLE_FILES} == before
    rows = [(n, "p", h if n != "end" else "0" * 64) for n, (_, h) in got.items()] + [("sub\\gone", "q", "1" * 64)]
    manifest = spark.createDataFrame(rows, "path string, pull_id string, sha256 string")
    found = {(r["path"], r["problem"]) for r in I.checksum_audit(spark, manifest, f"file:{tmp_path}/").collect()}
    assert found == {("end", "changed"), ("sub/gone", "missing")}


def test_fingerprints_do_not_depend_on_order_but_on_every_cell(spark):
    rows = [(i, "x" * (i % 3), None if i % 5 else "n") for i in range(500)]
    of = lambda r, n=3: tuple(I.table_fingerprint(spark.createDataFrame(r, "k int, a string, b string").repartition(n), ["k", "a", "b"]).first())
    want = of(rows)
    assert of(rows[::-1], 7) == want and len(want[1]) == 32
    changed = [(3, "", None), (3, "x", None), (3, "-", None), (3, None, ""), (3, None, None)]
    prints = {of([*rows[:3], c, *rows[4:]])[1] for c in changed}
    assert len(prints | {want[1]}) == 5 + (rows[3] not in changed)
    assert of([*rows, rows[0]])[0] == 501 and of([*rows, rows[0]])[1] != want[1]
    assert of([])[1] == "0" * 32


def test_a_panel_with_holes_is_refused(spark):
    rows = [(u, t, float(u + t)) for u in range(3) for t in range(4)]
    make = lambda r: P.require_complete(spark.createDataFrame(r, "unit int, t int, v double"), "unit", "t", "v")
    assert make(rows).agg(F.sum("v")).first()[0] == sum(r[2] for r in rows)
    for bad in (rows[1:], [*rows, rows[0]], [(0, 0, None), *rows[1:]]):
        with pytest.raises(PySparkException, match="holes"):
            make(bad).collect()


def test_crowded_arcs_stay_classes(spark):
    draw = random.Random(3)
    held = {u: {u % 7 + 100} for u in range(40)}  # small arcs of five or six holders
    for arc, share in ((1, 0.5), (2, 0.4), (3, 0.3)):
        for u in held:
            if draw.random() < share:
                held[u].add(arc)
    shapes = spark.createDataFrame([(u, [a if draw.random() < 0.5 else -a - 1 for a in arcs]) for u, arcs in held.items()], "unit int, arcs array<int>")
    want = {(u, v) for u in held for v in held if u != v and held[u] & held[v]}
    got = [(r["unit"], r["neighbour"]) for r in S.shared_boundary_edges(shapes, "unit", "arcs").collect()]
    assert set(got) == want and len(got) == len(want)
    edges, members = S.boundary_classes(shapes, "unit", "arcs", crowd=8)
    assert {r["class"] for r in members.select("class").distinct().collect()} == {1, 2, 3}
    assert edges.count() < len(want)
    values = {(u, y): draw.random() for u in held for y in (1, 2) if draw.random() < 0.8}
    panel = spark.createDataFrame([(u, y, v) for (u, y), v in values.items()], "unit int, year int, v double")
    lag = {(r["unit"], r["year"]): (r["w"], r["neighbours"]) for r in S.class_lag(panel, edges, members, "v", "w").collect()}
    for u in held:
        for y in (1, 2):
            near = [values[v, y] for a, v in want if a == u and (v, y) in values]
            assert lag.get((u, y), (0, 0)) == pytest.approx((sum(near) / max(len(near), 1), len(near)))


def test_an_arc_with_many_holders_makes_no_pairs(spark):
    shapes = spark.range(100_000).select(F.col("id").alias("unit"), F.array(F.lit(5)).alias("arcs"))
    edges, members = S.boundary_classes(shapes, "unit", "arcs")
    panel = spark.range(100_000).select(F.col("id").alias("unit"), F.lit(1).alias("year"), (F.col("id") % 2).cast("double").alias("v"))
    lag = S.class_lag(panel, edges, members, "v", "w").agg(F.count("*"), F.min("neighbours"), F.max("neighbours"), F.sum("w")).first()
    assert tuple(lag)[:3] == (100_000, 99_999, 99_999) and lag[3] == pytest.approx(50_000)
