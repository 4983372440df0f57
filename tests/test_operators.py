"""Ranks, quantiles, index, forecasts, reconciliation, quality and text on small known cases."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from comarca.functions import tails
from comarca.functions import text as T
from comarca.operators import composite as X
from comarca.operators import forecast as P
from comarca.operators import quality as Q
from comarca.operators import ranking as R
from comarca.operators import reshape
from comarca.operators import star as S
from comarca.operators.windows import holm


def test_text_golden_cases(spark):
    bad = spark.createDataFrame(
        [
            ("NARI" + chr(65425) + "O", "NARIÑO"),
            ("Corresponsales f" + chr(195) + chr(173) + "sicos", "Corresponsales físicos"),
            ("Bogot" + chr(195) + chr(161) + ", D.C.", "Bogotá, D.C."),
            ("NARI" + chr(195) + chr(8216) + "O", "NARIÑO"),
            ("sin cambios", "sin cambios"),
        ],
        "raw string, want string",
    )
    assert bad.filter(T.repair_text(F.col("raw")) != F.col("want")).count() == 0
    names = spark.createDataFrame(
        [
            ("San Andres,Prov Y Santa Catalina", "SAN ANDRES PROV Y SANTA CATALINA"),
            ("Bogotá, D.C.", "BOGOTA D C"),
            ("  NARIÑO ", "NARINO"),
        ],
        "raw string, want string",
    )
    assert names.filter(T.normalize_name(F.col("raw")) != F.col("want")).count() == 0
    day = spark.sql("select date '2021-03-01' as d")
    row = day.select(*[T.period_id(F.col("d"), f).alias(f) for f in "QMA"]).first()
    assert tuple(row) == ("2021Q1", "2021-03", "2021")
    with pytest.raises(ValueError):
        T.period_id(F.col("d"), "W")
    titles = spark.createDataFrame([("VILLA DE SAN DIEGO",), ("BOGOTA D.C.",), ("Ya Escrito",)], "n string")
    assert [r[0] for r in titles.select(T.title_case(F.col("n"))).collect()] == ["Villa de San Diego", "Bogota D.C.", "Ya Escrito"]
    years = spark.createDataFrame([("2024p",), ("2019",), ("2025pr",), ("x2019",)], "l string")
    got = years.select(reshape.year_of(F.col("l")), reshape.status_of(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [(2024, "provisional"), (2019, "definitivo"), (2025, "preliminar"), (None, None)]


def test_exact_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    big = np.round(rng.gamma(2.0, 1000.0, 60_000), 2)
    small = np.round(rng.normal(size=37), 3)
    pdf = pd.DataFrame({"g": ["hot"] * len(big) + ["cold"] * len(small), "v": np.concatenate([big, small])})
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    df = spark.createDataFrame(pdf).repartition(7)
    got = {r["g"]: r for r in R.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, values in (("hot", big), ("cold", small)):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), abs=1e-9)
    whole = R.exact_quantiles(df, [], "v", {"p50": 0.5}).first()[0]
    assert whole == pytest.approx(np.median(pdf.v), abs=1e-9)


def test_average_rank_and_dense_index(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"v": rng.integers(0, 300, 5000).astype(float)})
    got = R.average_rank(spark.createDataFrame(pdf), "v").toPandas().set_index("v")["rank"]
    assert np.allclose(pdf.v.map(got), pdf.v.rank())
    words = pd.DataFrame({"k": sorted({f"k{int(i):x}é" for i in rng.integers(0, 10**6, 800)})})
    pos = reshape.dense_index(spark.createDataFrame(words), "k").toPandas().set_index("k")["position"]
    want = sorted(words.k, key=lambda s: s.encode())
    assert [pos[w] for w in want] == list(range(len(want)))


def test_tails():
    assert tails.t_ppf(0.975, 32) == pytest.approx(2.0369, abs=1e-4)
    assert tails.normal_ppf(0.9) == pytest.approx(1.2815515655, abs=1e-9)
    assert 2 * tails.t_sf(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert tails.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.f_sf(3.0, 1, 24) == pytest.approx(2 * tails.t_sf(3.0**0.5, 24), abs=1e-12)


def test_holm(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "fam string, i int, p double")
    got = {r["i"]: r["p_holm"] for r in holm(df, "p", ["fam"], ["i"]).collect()}
    assert got == pytest.approx({0: 0.04, 1: 0.09, 2: 0.09, 3: 0.5})


CONTRACT = X.Contract(
    dimensions={"a": X.Dimension("single", {"v1": 1}), "b": X.Dimension("equal", {"v2": 1, "v3": 1})},
    rules={"v1": "per_head", "v2": "per_head", "v3": "pct_product"},
    weights={"a": 0.5, "b": 0.5},
    calibration=(2018, 2019),
    product="gdp",
)


def index_panel(years=(2018, 2019, 2020), seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(40):
        size = np.exp(rng.normal())
        for y in years:
            rows.append((u, y, 1e4 * size, 50.0 * size, *(size * np.exp(rng.normal(size=3)))))
    return pd.DataFrame(rows, columns=["unit", "year", "pop", "gdp", "v1", "v2", "v3"])


def test_index_history_does_not_move(spark):
    short, long = index_panel(), pd.concat([index_panel(), index_panel((2021,), seed=9)])
    out = []
    for p in (short, long):
        norm = X.normalize(spark.createDataFrame(p), CONTRACT)
        out.append(X.apply_index(norm, X.fit(norm, CONTRACT), CONTRACT).filter("year = 2020").toPandas().set_index("unit"))
    assert np.allclose(out[0].composite.sort_index(), out[1].composite.sort_index())


def test_index_refuses_what_it_cannot_support(spark):
    p = index_panel()
    norm = X.normalize(spark.createDataFrame(p), CONTRACT)
    with pytest.raises(ValueError, match="are needed"):
        X.fit(norm.filter("unit < 5"), CONTRACT)
    flat = X.normalize(spark.createDataFrame(p.assign(v1=p["pop"])), CONTRACT)
    with pytest.raises(ValueError, match="no variation"):
        X.fit(flat, CONTRACT)
    negative = replace(CONTRACT, dimensions={**CONTRACT.dimensions, "a": X.Dimension("single", {"v1": -1})})
    with pytest.raises(ValueError, match="negative"):
        X.fit(norm, negative)
    with pytest.raises(ValueError, match="denominator"):
        X.normalize(spark.createDataFrame(p), replace(CONTRACT, denominator="other"))
    with pytest.raises(KeyError):
        X.normalize(spark.createDataFrame(p.drop(columns=["v1"])), CONTRACT)
    low = X.Dimension("pca", {"v1": 1, "v2": 1, "v3": 1})
    mom = {"n": 50, "mean": [0, 0, 0], "sd": [1, 1, 1], "corr": np.array([[1, 0.5, -0.4], [0.5, 1, 0.4], [-0.4, 0.4, 1]])}
    with pytest.raises(ValueError, match="KMO"):
        X.fit_from_moments("d", low, mom, 0.5)
    missing = spark.createDataFrame(p.assign(v1=p.v1.where(p.unit != 3))).withColumn("v1", F.nanvl("v1", F.lit(None)))
    n2 = X.normalize(missing, CONTRACT)
    lost = X.apply_index(n2, X.fit(n2, CONTRACT), CONTRACT).filter("unit = 3")
    assert lost.filter("composite is not null").count() == 0


def test_principal_components_match_numpy(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 2))
    x = np.column_stack([base[:, 0], base[:, 0] + 0.5 * base[:, 1], base[:, 1], rng.normal(size=300)])
    cols = ["p", "q", "r", "s"]
    pdf = pd.DataFrame(x, columns=cols).assign(unit=range(300))
    f = X.fit_pca_multi(spark.createDataFrame(pdf), cols, "p", retention=2)
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert np.allclose(f.eigenvalues, values)
    out = X.apply_pca_multi(spark.createDataFrame(pdf), f, ["unit"]).toPandas().sort_values("unit")
    raw = z @ np.array(f.implied)
    assert np.allclose(out["index"], (raw - raw.min()) / (raw.max() - raw.min()) + 1e-4)
    assert np.corrcoef(out["first_component"], x[:, 0])[0, 1] > 0
    corr = np.corrcoef(x, rowvar=False)
    load, share = X.first_component(corr, [1, 1, 1, 1])
    assert (z @ load).std() == pytest.approx(1.0)
    assert share == pytest.approx(np.linalg.eigvalsh(corr)[-1] / 4)
    assert 0 < X.kmo_of(corr) < 1
    assert X.bartlett_of(corr, 300)[1] < 1e-6


def test_shared_borders_including_a_faulty_map(spark):
    shapes = spark.createDataFrame(
        [("a", [0, 1]), ("b", [-1, 2]), ("c", [-3]), ("x", [9]), ("y", [9]), ("z", [-10]), ("island", [50])],
        "unit string, arcs array<int>",
    )
    got = {(r["unit"], r["neighbour"]) for r in S.shared_boundary_edges(shapes, "unit", "arcs").collect()}
    want = {("a", "b"), ("b", "c"), ("x", "y"), ("x", "z"), ("y", "z")}
    assert got == want | {(b, a) for a, b in want}
    edges = spark.createDataFrame(sorted(got), "unit string, neighbour string")
    panel = spark.createDataFrame([(u, 1, v) for u, v in (("a", 1.0), ("b", 5.0), ("c", 9.0), ("island", 2.0))], "unit string, year int, v double")
    lag = {r["unit"]: r["w"] for r in S.spatial_lag(panel, edges, "v", "w").collect()}
    assert lag == {"a": 5.0, "b": 5.0, "c": 5.0, "island": None}


def series(spark, units=5, n=26, phi=0.6, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        g, lv = 0.01, 5.0
        for t in range(1, n + 1):
            rows.append((u, t, lv))
            g = 0.01 + phi * (g - 0.01) + rng.normal() * 0.02
            lv += g
    return spark.createDataFrame(rows, "unit int, t int, log_level double")


def test_autoregression_matches_least_squares(spark):
    s = series(spark)
    st = P.training_states(s).filter("origin = 27 and unit = 2").first()
    y = s.filter("unit = 2").orderBy("t").toPandas().log_level.to_numpy()
    g = np.diff(y)
    x = np.column_stack([np.ones(len(g) - 1), g[:-1]])
    b = np.linalg.lstsq(x, g[1:], rcond=None)[0]
    e = g[1:] - x @ b
    assert st["phi"] == pytest.approx(b[1], rel=1e-8)
    assert st["sigma2"] == pytest.approx(e @ e / (len(e) - 2), rel=1e-8)
    f = P.simple_forecasts(P.training_states(s).filter("origin = 27"), 3).filter("unit = 2 and model = 'ar1'").orderBy("h").collect()
    path, last = [], g[-1]
    for _ in range(3):
        last = b[0] + b[1] * last
        path.append(last)
    assert [r["mean"] for r in f] == pytest.approx(list(y[-1] + np.cumsum(path)))
    psi = b[1] ** np.arange(3)
    assert [r["var_growth"] for r in f] == pytest.approx(list(st["sigma2"] * np.cumsum(psi**2)))
    assert [r["var_level"] for r in f] == pytest.approx(list(st["sigma2"] * np.cumsum(np.cumsum(psi) ** 2)))


def test_arma_recovers_the_order_and_fails_softly(spark):
    s = series(spark, units=3, n=400)
    out = P.arma_forecasts(s, 2, []).toPandas()
    assert set(out.model) == set(P.ARMA_ORDERS) and out["mean"].notna().all()
    ar = out[(out.model == "arima_110") & (out.h == 1)].set_index("unit")["mean"]
    y = s.filter("unit = 1").orderBy("t").toPandas().log_level.to_numpy()
    g = np.diff(y)
    b = np.linalg.lstsq(np.column_stack([np.ones(len(g) - 1), g[:-1]]), g[1:], rcond=None)[0]
    assert ar[1] == pytest.approx(y[-1] + b[0] + b[1] * g[-1], abs=1e-10)
    short = P.arma_forecasts(series(spark, n=9), 2, [])
    assert short.count() == 0  # under the minimum training length
    marked = P.arma_forecasts(series(spark), 1, [13, 14]).filter("mean is not null")
    assert marked.count() == 20


def test_psi_weights(spark):
    psi = spark.range(1).select(P.psi_weights(F.array(F.lit(0.5), F.lit(0.2)), F.array(F.lit(0.3)), 4)).first()[0]
    want = [1.0, 0.8]
    want.append(0.5 * want[1] + 0.2 * want[0])
    want.append(0.5 * want[2] + 0.2 * want[1])
    assert psi == pytest.approx(want)


def detail(spark, gain, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for o in range(8):
        for u in range(20):
            base = rng.normal()
            rows.append((u, o, "naive", 0.0, base * 2, 1.0, 100 * base * 2))
            m = base * 2 * (1 - gain)
            rows.append((u, o, "m", 0.0, m, 1.0, 100 * m))
            z = None if u % 4 == 0 else 0.0
            rows.append((u, o, "holes", 0.0, z, 1.0, None if z is None else 1.0))
    return spark.createDataFrame(rows, "unit int, origin int, model string, real double, forecast double, variance double, error double")


def test_quality_gate(spark):
    good = P.verdicts(detail(spark, 0.4)).toPandas().set_index("model")
    assert good.loc["m", "approved"] and good.loc["m", "gain_pct"] == pytest.approx(40.0)
    assert good.loc["naive", "approved"]
    assert not good.loc["holes", "approved"]  # tiny errors, but it answered too rarely
    assert good.loc["holes", "coverage"] == pytest.approx(0.75)
    bad = P.verdicts(detail(spark, -0.1))
    with pytest.raises(P.QualityGate):
        P.require_approved(bad, "m")
    with pytest.raises(P.QualityGate):
        P.require_approved(bad, "absent")
    P.require_approved(P.verdicts(detail(spark, 0.4)), "m")
    p = P.dm_p(P.origin_table(P.by_origin(P.paired(detail(spark, 0.4))))).filter("model = 'm'").first()
    assert p["dm_p"] < 0.01 and p["origins_won"] == 8


def test_reconciliation(spark):
    base = spark.createDataFrame([(u, h, 10.0 * (u + 1), 0.01 * (u + 1)) for u in range(4) for h in (1, 2)], "unit int, h int, base double, var_level double")
    target = spark.createDataFrame([(1, 130.0), (2, 70.0)], "h int, target double")
    for fn in (P.reconcile_proportional, P.reconcile_mint_diag):
        got = fn(base, target, ["h"]).groupBy("h").agg(F.sum("reconciled").alias("s")).collect()
        assert {r["h"]: r["s"] for r in got} == pytest.approx({1: 130.0, 2: 70.0})
    prop = P.reconcile_proportional(base, target, ["h"]).filter("h = 1").orderBy("unit").collect()
    assert [r["reconciled"] / r["base"] for r in prop] == pytest.approx([1.3] * 4)
    broken = base.withColumn("base", F.when(F.col("unit") != 2, F.col("base")))
    with pytest.raises(PySparkException):
        P.reconcile_proportional(broken, target, ["h"]).collect()
    anchor = spark.createDataFrame([("c", 1, 2.0), ("c", 3, 2.0)], "scenario string, step int, growth_pct double")
    with pytest.raises(PySparkException):
        P.anchor_levels(anchor, F.lit(100.0), 3).collect()
    age, expired = P.anchor_age(F.lit("no date").try_cast("date"), F.current_date())
    assert spark.range(1).select(expired).first()[0] is True


def test_quality_rows(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, "b", None)], "k int, s string, v double")
    assert Q.not_unique(df, ["k"]).collect()[0]["n"] == 2
    assert Q.not_unique(df.filter("v is not null").dropDuplicates(["k"]), ["k"]).count() == 0
    assert [tuple(r) for r in Q.is_null(df, ["k", "v"]).collect()] == [("v", 1)]
    assert Q.violates(df, F.col("v") < 2).count() == 1  # the unknown row is not a violation
    same = Q.table_diff(df.filter("k = 2"), df.filter("k = 2"), ["k"], ["v"])
    assert same.count() == 0
    bad = df.withColumn("v", F.col("v") + 1e-9)
    assert Q.table_diff(df.filter("v = 1"), bad.filter("v < 2"), ["k"], ["v"]).count() == 0
