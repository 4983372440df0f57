"""Moving-average forecasts from summed products against two plain regressions per unit and origin."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from comarca.operators import forecast as P


def two_regressions(g, d, p, q):
    """Constant, coefficients and residuals of an order on one history, by least squares on its rows."""
    use = [j for j in range(d.shape[1]) if d[:, j].any()]
    d, shocks, n = d[:, use], np.zeros(len(g)), len(g)
    if q:
        rows = np.arange(3, n)
        x = np.column_stack([np.ones(n - 3), *[g[rows - k] for k in (1, 2, 3)], d[rows]])
        shocks[rows] = g[rows] - x @ np.linalg.lstsq(x, g[rows], rcond=None)[0]
    start = 4 if q else p
    rows = np.arange(start, n)
    parts = [np.ones(n - start), *[g[rows - k] for k in range(1, p + 1)], *([shocks[rows - 1]] if q else []), d[rows]]
    x = np.column_stack(parts)
    b = np.linalg.lstsq(x, g[rows], rcond=None)[0]
    e = g[rows] - x @ b
    return b[: 1 + p + q], b[1 + p + q :], use, e, e @ e / (len(rows) - x.shape[1])


def expected(t, y, marks, origin, h):
    seen = t < origin
    if seen.sum() < P.MIN_TRAIN:
        return {}
    level = np.array([[float(a == m) for m in marks] for a in t[seen]]).reshape(seen.sum(), len(marks))
    g, out = np.diff(y[seen]), {}
    for name, (p, _, q) in P.ARMA_ORDERS.items():
        b, beta, use, e, s2 = two_regressions(g, np.diff(level, axis=0), p, q)
        ar, ma = b[1 : 1 + p], b[1 + p :]
        past, shock, at = list(g - np.diff(level, axis=0)[:, use] @ beta), e[-1], y[seen][-1]
        psi, mean = [1.0], []
        for k in range(h):
            new = b[0] + sum(ar[i] * past[-1 - i] for i in range(p)) + (ma[0] * shock if q and not k else 0.0)
            past.append(new)
            at += new - (level[-1, use] @ beta if not k else 0.0)
            mean.append(at)
            psi.append((ma[0] if q and not k else 0.0) + sum(ar[i] * psi[-1 - i] for i in range(min(p, k + 1))))
        psi = np.array(psi[:h])
        out[name] = mean, s2 * np.cumsum(np.cumsum(psi) ** 2), s2 * np.cumsum(psi**2)
    return out


@pytest.fixture(scope="module")
def panel():
    """Units of different lengths, one with a gap in its periods."""
    draw, rows = np.random.default_rng(6), {}
    for u, n in enumerate((11, 12, 14, 30, 57)):
        t = np.arange(1, n + 1)
        t = t[t != 9] if u == 3 else t
        e = draw.normal(0, 0.03, len(t))
        rows[u] = t, 5 + np.cumsum(0.02 + e + 0.5 * np.r_[0, e[:-1]])
    return rows


def frame(spark, panel):
    rows = [(u, int(a), float(b)) for u, (t, y) in panel.items() for a, b in zip(t, y, strict=True)]
    return spark.createDataFrame(rows, "unit int, t int, log_level double").repartition(3)


EVERY = [8, 13, 15, 16, 31, 58]


@pytest.mark.parametrize(("marks", "origins"), [([], None), ([13, 14], EVERY), ([12], EVERY), ([2, 40], None)])
def test_against_plain_regressions(spark, panel, marks, origins):
    got = P.arma_forecasts(frame(spark, panel), 3, marks, origins).collect()
    found = {(r["unit"], r["origin"], r["model"], r["h"]): (r["mean"], r["var_level"], r["var_growth"]) for r in got}
    assert len(found) == len(got)
    n = 0
    for u, (t, y) in panel.items():
        for o in origins or [int(t[-1]) + 1]:
            for model, columns in expected(t, y, marks, o, 3).items():
                for k in range(3):
                    row = found[u, o, model, k + 1]
                    assert row == pytest.approx([c[k] for c in columns], rel=1e-7, abs=1e-10), (u, o, model, k)
                    n += 1
    assert n == len(got)


def test_a_missing_value_fails_only_the_fits_that_see_it(spark, panel):
    holed = frame(spark, panel).withColumn("log_level", F.when(F.col("t") != 20, F.col("log_level")))
    got = P.arma_forecasts(holed, 1, [13], [18, 25]).collect()
    assert {r["origin"]: r["mean"] is None for r in got if r["unit"] == 4} == {18: False, 25: True}
    assert len([r for r in got if r["unit"] == 4]) == 8


def test_no_python_groups(spark, panel):
    plan = P.arma_forecasts(frame(spark, panel), 1, [13])._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan
