"""Estimators against dummy-variable regressions on an unbalanced panel with known truth."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from comarca.operators import designs as D
from comarca.operators import gram as G
from comarca.operators import inference as I


def make_panel(units=30, years=8, beta=0.5, seed=1, holes=0.15):
    rng = np.random.default_rng(seed)
    a, t = rng.normal(size=units), rng.normal(size=years)
    rows = []
    for u in range(units):
        for y in range(years):
            if rng.random() < holes:
                continue
            x = 0.5 * a[u] + 0.7 * t[y] + rng.normal()
            c = 0.3 * x + rng.normal()
            rows.append((u, 2000 + y, beta * x + 0.2 * c + a[u] + t[y] + rng.normal() * (0.3 + 0.02 * u), x, c, 1.0 + u))
    return pd.DataFrame(rows, columns=["unit", "year", "y", "x", "c", "w"])


@pytest.fixture(scope="module")
def pdf():
    return make_panel()


@pytest.fixture(scope="module")
def sdf(spark, pdf):
    return spark.createDataFrame(pdf).repartition(5).cache()


def dummies(p, time=True):
    parts = [np.ones((len(p), 1)), pd.get_dummies(p.unit, drop_first=True, dtype=float).to_numpy()]
    if time:
        parts.append(pd.get_dummies(p.year, drop_first=True, dtype=float).to_numpy())
    return np.column_stack(parts)


def brute(p, xs, time=True, w=None):
    w = np.ones(len(p)) if w is None else w
    d = dummies(p, time)
    x = np.column_stack([p[xs].to_numpy(), d])
    sw = np.sqrt(w)
    b = np.linalg.lstsq(x * sw[:, None], p.y.to_numpy() * sw, rcond=None)[0]
    e = p.y.to_numpy() - x @ b
    q = d * sw[:, None]
    m = p[xs].to_numpy() * sw[:, None]
    xt = m - q @ np.linalg.lstsq(q, m, rcond=None)[0]
    inv = np.linalg.inv(xt.T @ xt)
    sc = np.array([(xt[(p.unit == u).to_numpy()] * (e * sw)[(p.unit == u).to_numpy()][:, None]).sum(0) for u in p.unit.unique()])
    n, g = len(p), p.unit.nunique()
    slopes = len(xs) + (p.year.nunique() if time else 1)
    v = inv @ (sc.T @ sc) @ inv * g / (g - 1) * (n - 1) / (n - slopes)
    return b[: len(xs)], np.sqrt(np.diag(v)), xt, e, inv


@pytest.mark.parametrize("time", [True, False])
def test_fe_matches_dummies(sdf, pdf, time):
    b, se, *_ = brute(pdf, ["x", "c"], time)
    rows = {r["term"]: r for r in G.fe_fit(sdf, "y", ["x", "c"], time_effects=time).collect()}
    for i, name in enumerate(["x", "c"]):
        assert rows[name]["coef"] == pytest.approx(b[i], abs=1e-9)
        assert rows[name]["se"] == pytest.approx(se[i], rel=1e-8)
    assert rows["x"]["n"] == len(pdf)


def test_weighted_fe(sdf, pdf):
    b, se, *_ = brute(pdf, ["x", "c"], w=pdf.w.to_numpy())
    r = G.fe_fit(sdf, "y", ["x", "c"], weight="w").filter("term = 'x'").first()
    assert r["coef"] == pytest.approx(b[0], abs=1e-9)
    assert r["se"] == pytest.approx(se[0], rel=1e-8)


@pytest.mark.parametrize("ragged", [False, True])
def test_weights_that_vary_by_row(spark, pdf, ragged):
    draw = np.random.default_rng(5)
    some = pdf.assign(w=draw.uniform(0.2, 5.0, len(pdf)))
    if ragged:
        some = some[draw.random(len(some)) > 0.25].reset_index(drop=True)
    b, se, *_ = brute(some, ["x", "c"], w=some.w.to_numpy())
    r = G.fe_fit(spark.createDataFrame(some), "y", ["x", "c"], weight="w").filter("term = 'x'").first()
    assert r["coef"] == pytest.approx(b[0], abs=1e-9)
    assert r["se"] == pytest.approx(se[0], rel=1e-8)


def test_two_way_is_the_projection(sdf, pdf):
    d = dummies(pdf)
    want = pdf.x - d @ np.linalg.lstsq(d, pdf.x.to_numpy(), rcond=None)[0]
    got = G.two_way(sdf.select("unit", "year", "x"), ["x"]).toPandas().sort_values(["unit", "year"])
    assert np.allclose(got.x.to_numpy(), want.to_numpy(), atol=1e-9)


def test_robust_and_driscoll_kraay(sdf, pdf):
    _, _, xt, e, inv = brute(pdf, ["x", "c"])
    n, g, t = len(pdf), pdf.unit.nunique(), pdf.year.nunique()
    factor = n / (n - (2 + t) - (g - 1))
    hc = np.sqrt(np.diag(inv @ ((xt * e[:, None]).T @ (xt * e[:, None])) @ inv) * factor)
    got = G.fe_fit(sdf, "y", ["x", "c"], cov="hc").filter("term = 'x'").first()
    assert got["se"] == pytest.approx(hc[0], rel=1e-8)
    h = np.array([(xt * e[:, None])[(pdf.year == y).to_numpy()].sum(0) for y in sorted(pdf.year.unique())])
    s = h.T @ h
    for lag in (1, 2):
        c = h[lag:].T @ h[:-lag]
        s = s + (1 - lag / 3) * (c + c.T)
    dk = np.sqrt(np.diag(inv @ s @ inv) * factor)
    got = G.fe_fit(sdf, "y", ["x", "c"], cov="driscoll-kraay", bandwidth=2).filter("term = 'x'").first()
    assert got["se"] == pytest.approx(dk[0], rel=1e-8)
    with pytest.raises(ValueError):
        G.fe_table(sdf, "y", ["x"], cov="nonsense")


def test_groups_are_separate_fits(spark, sdf, pdf):
    tagged = sdf.withColumn("half", (F.col("unit") < 15).cast("int"))
    rows = {r["half"]: r for r in G.fe_fit(tagged, "y", ["x", "c"], group=["half"]).filter("term = 'x'").collect()}
    for half in (0, 1):
        b, se, *_ = brute(pdf[(pdf.unit < 15).astype(int) == half].reset_index(drop=True), ["x", "c"])
        assert rows[half]["coef"] == pytest.approx(b[0], abs=1e-9)
        assert rows[half]["se"] == pytest.approx(se[0], rel=1e-8)


def test_collinear_is_not_estimable(sdf):
    twin = sdf.withColumn("x2", F.col("x") * 2)
    assert G.fe_fit(twin, "y", ["x", "x2"]).filter("coef is not null").count() == 0


def test_partition_count_does_not_matter(spark, sdf):
    one = G.fe_fit(sdf.coalesce(1), "y", ["x"]).first()
    many = G.fe_fit(sdf.repartition(13, "year"), "y", ["x"]).first()
    assert one["coef"] == pytest.approx(many["coef"], abs=1e-12)
    assert one["se"] == pytest.approx(many["se"], rel=1e-10)


def test_leave_one_out(sdf, pdf):
    got = {r["unit"]: r["coef"] for r in D.leave_one_out(sdf, "y", ["x", "c"]).collect()}
    for u in (0, 7, 29):
        b, *_ = brute(pdf[pdf.unit != u].reset_index(drop=True), ["x", "c"])
        assert got[u] == pytest.approx(b[0], abs=1e-9)


def _sign(seed, r, u):
    return 1.0 if hashlib.md5(f"{seed}|{r}|{u}".encode()).hexdigest()[0] in "02468ace" else -1.0


def test_wild_bootstrap_with_controls(sdf, pdf):
    """Replicas against explicit dummy projections, and the test inverted at a non-zero null."""
    reps = 60
    q = np.column_stack([dummies(pdf), pdf.c])
    proj = lambda v: v - q @ np.linalg.lstsq(q, v, rcond=None)[0]
    x, y = proj(pdf.x.to_numpy()), proj(pdf.y.to_numpy())
    sxx = x @ x
    b = x @ y / sxx
    unit = pdf.unit.to_numpy()

    def score(e):
        return np.array([(x * e)[unit == u].sum() for u in range(30)])

    def p_at(beta0):
        seen = (b - beta0) / np.sqrt((score(y - b * x) ** 2).sum())
        ts = []
        for r in range(1, reps + 1):
            w = np.array([_sign(7, r, u) for u in unit])
            v = proj((y - beta0 * x) * w)
            n1 = x @ v / sxx
            ts.append(n1 / np.sqrt((score(v - n1 * x) ** 2).sum()))
        return (np.sum(np.abs(ts) >= abs(seen) - 1e-12) + 1) / (reps + 1)

    rep = I.run_replicas(sdf, "y", ["x"], ["c"], replicas=reps)
    _, se, *_ = brute(pdf, ["x", "c"])
    assert rep.coef[0] == pytest.approx(b, abs=1e-9)
    assert rep.se == pytest.approx(se[0], rel=1e-8)
    at = lambda v, side="both": rep.table.agg(I.p_at(rep, v, side)).first()[0]
    assert at(0.0) == pytest.approx(p_at(0.0))
    assert at(0.45) == pytest.approx(p_at(0.45))
    assert I.symmetric_p(rep).first()["p_bootstrap"] == pytest.approx(p_at(0.0))
    # the edges are where p crosses the level, and nothing further out is kept
    low, high = I.accepted_interval(rep, 0.9).select("low", "high").first()
    assert low < b < high
    step = 1e-7 * (high - low)
    assert at(low + step) > 0.1 >= at(low - step) and at(high - step) > 0.1 >= at(high + step)
    for out in (0.01, 0.1, 1.0, 5.0):
        assert max(at(low - out * rep.se), at(high + out * rep.se)) <= 0.1
    tests = I.equivalence(rep, [abs(b), abs(b) + 10 * rep.se]).collect()
    assert tests[1]["p"] <= tests[0]["p"] and tests[0]["p_lower"] == pytest.approx(at(-abs(b), "above"))
    margin = I.smallest_margin(rep, 0.1).first()["margin"]
    both = lambda m: max(at(-m, "above"), at(m, "below"))
    assert both(margin * (1 + 1e-7)) < 0.1 <= both(margin * (1 - 1e-7))


def test_wald_with_one_regressor_is_t_squared(sdf, pdf):
    b, se, *_ = brute(pdf, ["x", "c"])
    rep = I.run_replicas(sdf, "y", ["x"], ["c"], replicas=40)
    assert I.wald_test(rep)["f"] == pytest.approx((b[0] / se[0]) ** 2, rel=1e-7)
    joint = I.wald_test(I.run_replicas(sdf, "y", ["x", "c"], [], replicas=40))
    assert joint["q"] == 2 and joint["p_f"] < 0.01 and 0 < joint["p_bootstrap"] <= 1
    with pytest.raises(ValueError):
        I.replicate(I.prepare(sdf, "y", ["x"], []), replicas=5, weights="normal")


def test_placebo_on_an_unbalanced_panel(sdf, pdf):
    got = {r["r"]: r["coef"] for r in I.placebo(sdf, "y", "x", ["c"], replicas=4).collect()}
    keys = sorted(pdf.unit.unique())
    paths = {u: pdf[pdf.unit == u].set_index("year").x for u in keys}
    for r in (1, 4):
        order = sorted(keys, key=lambda u: hashlib.md5(f"11|{r}|{u}".encode()).hexdigest())
        donor = dict(zip(keys, order, strict=True))
        moved = pdf.copy()
        moved["x"] = [paths[donor[u]].get(a, np.nan) for u, a in zip(pdf.unit, pdf.year, strict=True)]
        b, *_ = brute(moved.dropna().reset_index(drop=True), ["x", "c"])
        assert got[r] == pytest.approx(b[0], abs=1e-8)
    with pytest.raises(ValueError):
        I.placebo(sdf, "y", "x", [], mode="other")


def test_pesaran_cd_with_holes(spark, pdf):
    e = pdf[["unit", "year", "y"]].rename(columns={"y": "e"})
    e = e[~((e.unit == 3) & (e.year > 2001))]
    wide = e.pivot(index="year", columns="unit", values="e")
    corr = wide.corr(min_periods=3).to_numpy()
    tri = corr[np.triu_indices(len(corr), 1)]
    tri = tri[~np.isnan(tri)]
    n = wide.shape[1]
    want = np.sqrt(2 * wide.notna().sum().mean() / (n * (n - 1))) * tri.sum()
    r = D.pesaran_cd(spark.createDataFrame(e)).first()
    assert r["cd"] == pytest.approx(want, rel=1e-8)
    assert r["pairs"] == len(tri)


def test_cadf(spark):
    rng = np.random.default_rng(5)
    units, t = 6, 20
    data = np.cumsum(rng.normal(size=(t, units)), axis=0)
    rows = [(u, s, float(data[s, u])) for u in range(units) for s in range(t) if not (u == 5 and s == 4)]
    got = {r["unit"]: r["t"] for r in D.cadf(spark.createDataFrame(rows, "unit int, t int, v double"), "v").collect()}
    assert 5 not in got
    frame = pd.DataFrame(rows, columns=["u", "t", "v"])
    mean = frame.groupby("t").v.mean().to_numpy()
    y = data[:, 2]
    x = np.column_stack([np.ones(t - 1), y[:-1], mean[:-1], np.diff(mean)])
    b = np.linalg.lstsq(x, np.diff(y), rcond=None)[0]
    res = np.diff(y) - x @ b
    se = np.sqrt(res @ res / (t - 1 - 4) * np.linalg.inv(x.T @ x)[1, 1])
    assert got[2] == pytest.approx(b[1] / se, rel=1e-7)


def test_random_effects(sdf, pdf):
    r = D.random_effects(sdf, "y", ["x", "c"])
    cols = ["y", "x", "c"]
    mean = pdf.groupby("unit")[cols].transform("mean")
    t = pdf.groupby("unit").y.transform("size")
    n, g, k = len(pdf), 30, 3

    def rss(m):
        a, b = m[:, 1:], m[:, 0]
        e = b - a @ np.linalg.lstsq(a, b, rcond=None)[0]
        return e @ e

    s2_e = rss((pdf[cols] - mean).to_numpy()) / (n - k - g + 1)
    by_unit = pdf.groupby("unit")[cols].mean().to_numpy()
    t_bar = g / (1 / pdf.groupby("unit").size()).sum()
    s2_u = max(0.0, rss(np.column_stack([by_unit, np.ones(g)])) / (g - k) - s2_e / t_bar)
    th = 1 - np.sqrt(s2_e / (t * s2_u + s2_e))
    q = np.column_stack([pdf[cols].to_numpy() - th.to_numpy()[:, None] * mean.to_numpy(), 1 - th])
    assert r["s2_e"] == pytest.approx(s2_e) and r["s2_u"] == pytest.approx(s2_u)
    assert r["beta"] == pytest.approx(np.linalg.lstsq(q[:, 1:], q[:, 0], rcond=None)[0])
    h = D.hausman(sdf, "y", ["x", "c"])
    assert h["valid"] is False and h["df"] == 2


def test_hash_rank_is_the_global_order(spark):
    df = spark.range(500).select(F.col("id").alias("unit"), (F.col("id") % 3).alias("g"))
    got = I.hash_rank(df, ["g"], F.md5(F.col("unit").cast("string")), 10_000_000, "k").toPandas()
    for _, part in got.groupby("g"):
        order = part.assign(h=[hashlib.md5(str(u).encode()).hexdigest() for u in part.unit]).sort_values("h")
        assert list(order.k) == list(range(len(part)))


def test_power_columns_reference(spark):
    fits = spark.createDataFrame([(0.1, 1.0, 33)], "coef double, se double, units int")
    r = I.power_columns(fits, [2.0]).first()
    assert r["mde80"] == pytest.approx(2.891, abs=2e-3)
    assert r["ci_high"] - r["coef"] == pytest.approx(2.0369, abs=1e-4)
    assert 0 < r["tost_2_0"] < 0.1
