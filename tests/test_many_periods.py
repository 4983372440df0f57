"""Period effects by iteration against dense least squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from comarca.operators import gram


def panel(units, periods, rows, seed, groups=1):
    draw = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        for u in range(units):
            seen = np.sort(draw.choice(periods, size=int(draw.integers(rows // 2, rows)), replace=False))
            x = draw.normal(u, 1, len(seen)) + np.sin(seen / 40)
            y = 0.3 * x + 0.01 * seen + draw.normal(0, 1, len(seen))
            out += [(g, u, int(t), float(a), float(b), float(w)) for t, a, b, w in zip(seen, y, x, draw.uniform(0.2, 3, len(seen)))]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, unit int, day int, y double, x double, w double").repartition(4)


def dense(rows, weighted):
    """Deviations from unit and period dummies by the reduced normal equations, with numpy alone."""
    u, t = (np.unique([r[i] for r in rows], return_inverse=True)[1] for i in (1, 2))
    v = np.array([r[3:5] for r in rows])
    w = np.array([r[5] if weighted else 1.0 for r in rows])
    cells = np.zeros((u.max() + 1, t.max() + 1))
    np.add.at(cells, (u, t), w)
    per_unit = cells.sum(1)
    mean = np.stack([np.bincount(u, w * c) / per_unit for c in v.T], 1)
    dev = v - mean[u]
    right = np.stack([np.bincount(t, w * c) for c in dev.T], 1)
    effects = np.linalg.lstsq(np.diag(cells.sum(0)) - cells.T @ (cells / per_unit[:, None]), right, rcond=1e-13)[0]
    shift = effects[t]
    return dev - shift + np.stack([np.bincount(u, w * c) / per_unit for c in shift.T], 1)[u]


def test_two_thousand_periods_unbalanced_and_weighted(spark, monkeypatch):
    rows = panel(40, 2000, 900, 1)
    got = gram.two_way(frame(spark, rows), ["y", "x"], time="day", weight="w").collect()
    want = {(r[1], r[2]): d for r, d in zip(rows, dense(rows, True), strict=True)}
    assert len({r[2] for r in rows}) > gram.EXACT_PERIODS and len(got) == len(rows)
    assert max(np.abs(np.array([r["y"], r["x"]]) - want[r["unit"], r["day"]]).max() for r in got) < 1e-9


@pytest.mark.parametrize("weight", [None, "w"])
def test_groups_and_lonely_rows_as_in_the_exact_solve(spark, weight):
    rows = panel(12, 30, 14, 2, groups=3)
    rows += [(0, 90, 77, 1.0, 2.0, 1.0), (1, 91, 3, 4.0, 1.0, 2.0), (2, 92, 88, 1.0, 1.0, 1.0), (2, 93, 88, 3.0, 1.0, 1.0)]
    df = frame(spark, rows)
    parts = [gram.two_way(df, ["y", "x"], time="day", group=["g"], weight=weight, iterate=i).orderBy("g", "unit", "day") for i in (True, False)]
    one, two = (np.array([(r["y"], r["x"]) for r in p.collect()]) for p in parts)
    assert len(one) == len(rows) and np.abs(one - two).max() < 1e-9


def test_a_balanced_panel_is_one_list(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(gram, "settle", lambda df, label: kept.setdefault(label, settle(df, label)))
    from comarca.session import settle

    rows = [(0, u, t, float(u * t % 7), float(t % 5 + u % 3), 1.0) for u in range(50) for t in range(20)]
    out = gram.two_way(frame(spark, rows), ["y", "x"], time="day", iterate=True, keep_within=True)
    assert {r["_periods"] for r in out.select("_periods").distinct().collect()} == {20}
    assert out.groupBy("unit").agg(F.abs(F.sum("y")).alias("s")).agg(F.max("s")).first()[0] < 1e-9
    assert kept["period-lists"].count() == 1
