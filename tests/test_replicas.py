"""Replica algebra: both ways of moving the data give the same numbers, and those of a plain loop."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from comarca.operators import designs as D
from comarca.operators import inference as I
from comarca.operators import replicas as R


def order(keys, *parts):
    return sorted(keys, key=lambda u: hashlib.md5("|".join(map(str, (*parts, u))).encode()).hexdigest())


@pytest.fixture(scope="module")
def panel():
    draw = np.random.default_rng(8)
    rows = [
        (u, t, *draw.normal(u % 3, 1, 3)) for u in range(14) for t in range(2001, 2008) if draw.random() < (0.7 if u % 4 else 1.0)
    ]
    return pd.DataFrame(rows, columns=["unit", "year", "y", "x", "c"])


@pytest.fixture(scope="module")
def frame(spark, panel):
    return spark.createDataFrame(panel, "unit int, year int, y double, x double, c double").repartition(3)


def dummy_fit(p, xs):
    d = np.column_stack([*[(p.unit == u) for u in p.unit.unique()], *[(p.year == t) for t in p.year.unique()], p[xs]])
    return np.linalg.lstsq(d.astype(float), p.y, rcond=None)[0][-len(xs) :]


@pytest.mark.parametrize("mode", ["trajectory", "within_period"])
def test_placebo_either_way_and_by_hand(monkeypatch, frame, panel, mode):
    sent = [r["coef"] for r in I.placebo(frame, "y", "x", ["c"], mode=mode, replicas=70).orderBy("r").collect()]
    monkeypatch.setattr(I, "SENT_CELLS", 0)
    joined = [r["coef"] for r in I.placebo(frame, "y", "x", ["c"], mode=mode, replicas=70).orderBy("r").collect()]
    assert sent == pytest.approx(joined, abs=1e-10) and len(sent) == 70
    for r in (1, 66):
        p = panel.copy()
        if mode == "trajectory":
            keys = sorted(p.unit.unique())
            donor = dict(zip(keys, order(keys, 11, r), strict=True))
            own = p.set_index(["unit", "year"]).x
            p["x"] = [own.get((donor[u], t), np.nan) for u, t in zip(p.unit, p.year, strict=True)]
        else:
            for t, some in p.groupby("year"):
                x = some.set_index("unit").x
                p.loc[some.sort_values("unit").index, "x"] = x.loc[order(sorted(some.unit), 11, r, t)].to_numpy()
        assert sent[r - 1] == pytest.approx(dummy_fit(p.dropna(), ["x", "c"])[0], abs=1e-9)


def test_moran_either_way_and_by_hand(monkeypatch, spark, frame, panel):
    edges = [(u, v, 1.0 / 3) for u in range(14) for v in ((u + 1) % 14, (u + 5) % 14, (u + 9) % 14)]
    links = spark.createDataFrame(edges, "unit int, neighbour int, weight double")
    z = frame.select(F.lit("a").alias("kind"), "unit", "year", F.col("y").alias("z"))
    z = z.unionByName(frame.select(F.lit("b").alias("kind"), "unit", "year", F.col("x").alias("z")))
    look = lambda: {(r["kind"], r["year"]): r for r in D.moran(z, links, replicas=99, scope=["kind"]).collect()}
    sent = look()
    monkeypatch.setattr(D, "SENT_CELLS", 0)
    joined = look()
    assert sent.keys() == joined.keys() and len(sent) == 14
    for key, r in sent.items():
        assert r["i"] == pytest.approx(joined[key]["i"], abs=1e-12) and r["p"] == joined[key]["p"]
        some = panel[panel.year == key[1]].set_index("unit")["y" if key[0] == "a" else "x"]
        units, v = sorted(some.index), some - some.mean()

        def index(v):
            return sum(w * v[a] * v[b] for a, b, w in edges if a in v.index and b in v.index) / (v**2).sum()

        drawn = [abs(index(pd.Series(v.loc[order(units, 13, k, key[1])].to_numpy(), units))) for k in range(1, 100)]
        assert r["i"] == pytest.approx(index(v))
        assert r["p"] == pytest.approx((sum(d >= abs(index(v)) - 1e-12 for d in drawn) + 1) / 100)


def test_leave_one_out_is_a_refit_for_every_unit(frame, panel):
    got = {r["unit"]: r["coef"] for r in D.leave_one_out(frame, "y", ["x", "c"]).collect()}
    for u in panel.unit.unique():
        assert got[u] == pytest.approx(dummy_fit(panel[panel.unit != u], ["x", "c"])[0], abs=1e-9)


def test_leave_one_out_without_its_only_link_or_period(spark):
    draw = np.random.default_rng(1)
    # units 0-3 see the first years, 4-7 the last ones; unit 8 alone links them, unit 9 alone sees 1990
    seen = {**{u: range(2000, 2004) for u in range(4)}, **{u: range(2004, 2008) for u in range(4, 8)}, 8: (2003, 2004), 9: (1990, 2001, 2002)}
    p = pd.DataFrame([(u, t, *draw.normal(0, 1, 2)) for u, ts in seen.items() for t in ts], columns=["unit", "year", "y", "x"])
    got = D.leave_one_out(spark.createDataFrame(p, "unit int, year int, y double, x double"), "y", ["x"]).collect()
    for r in got:
        assert r["coef"] == pytest.approx(dummy_fit(p[p.unit != r["unit"]], ["x"])[0], abs=1e-9), r["unit"]


def test_sums_travel_in_blocks(frame):
    """Replicas of the last, partly filled block are those of a longer run."""
    few, many = (I.run_replicas(frame, "y", ["x", "c"], [], replicas=n, weights="webb").table.collect() for n in (130, 200))
    assert 130 % R.RUN and [r["r"] for r in few] == list(range(1, 131))
    for a, b in zip(few, many[:130], strict=True):
        assert a["b"] == pytest.approx(b["b"], rel=1e-9) and a["meat"] == pytest.approx(b["meat"], rel=1e-9)
