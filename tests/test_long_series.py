"""The pre-trend tests use every year of the series and hold initial income times year constant."""

import datetime

import numpy as np
import pandas as pd
import pytest
from test_regression import brute

from comarca.plans import designing
from comarca.plans.base import series

YEARS = range(1993, 2003)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """30 nations with orders in every quarter of ten years; one has no order in the base year."""
    folder, draw = str(tmp_path_factory.mktemp("long")), np.random.default_rng(3)
    nation = pd.DataFrame({"n_nationkey": range(30), "n_name": [f"n{u}" for u in range(30)], "n_regionkey": [u % 5 for u in range(30)]})
    customer = pd.DataFrame({"c_custkey": range(30), "c_nationkey": range(30)})
    orders = [
        (u, datetime.datetime(a, 3 * q + 2, 7), float(draw.lognormal(5, 0.4)), "1-URGENT", "F")
        for u in range(30) for a in YEARS if (u, a) != (29, 1996) for q in range(4) for _ in range(draw.integers(1, 6))
    ]
    orders = pd.DataFrame(orders, columns=["o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus"])
    schemas = {
        "nation": "n_nationkey int, n_name string, n_regionkey int",
        "customer": "c_custkey long, c_nationkey int",
        "orders": "o_custkey long, o_orderdate timestamp_ntz, o_totalprice double, o_orderpriority string, o_orderstatus string",
    }
    for name, frame in (("nation", nation), ("customer", customer), ("orders", orders)):
        spark.createDataFrame(frame, schemas[name]).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_pre_trends_on_all_years(spark, tables, monkeypatch):
    replicate = designing.I.replicate
    few = lambda prep, replicas, weights: replicate(prep, replicas=min(replicas, 9), weights=weights)
    monkeypatch.setattr(designing.I, "replicate", few)
    got = {(r["dependent"], r["initial"], r["block"], r["weights"]): r for r in designing.pre_trends(spark, tables).collect()}
    terms = {(r["dependent"], r["initial"], r["year"]): r for r in designing.pre_trend_terms(spark, tables).collect()}
    assert len(got) == 16
    s = series(spark, tables).select("unit", "year", "y", "x", "log_pc", "amount", "amount_lag").toPandas()
    s["y_total"] = np.log(s.amount.astype(float)) - np.log(s.amount_lag.astype(float))
    base = s[(s.year == 1996) & s.x.notna()].set_index("unit")
    z = (base.x - base.x.mean()) / base.x.std()
    p = s[s.y.notna() & s.unit.isin(base.index)].reset_index(drop=True)
    years = sorted(p.year.unique())
    assert years[0] < 1996 and years[-1] > 2000 and 29 not in set(p.unit)
    events, starts = [f"ev_{a}" for a in years if a != 1998], [f"i{a}" for a in years[1:]]
    for a in years:
        p[f"ev_{a}"] = p.unit.map(z) * (p.year == a)
        p[f"i{a}"] = p.unit.map(base.log_pc) * (p.year == a)
    per_head = p.y.copy()
    for dependent, initial, extra in [(y, *i) for y in ("y", "y_total") for i in (("none", []), ("log_pc", starts))]:
        p["y"] = p.y_total if dependent == "y_total" else per_head
        xs = events + extra
        b, _, xt, e, inv = brute(p, xs)
        score = np.array([(xt * e[:, None])[(p.unit == u).to_numpy()].sum(0) for u in p.unit.unique()])
        n, g = len(p), p.unit.nunique()
        v = inv @ (score.T @ score) @ inv * g / (g - 1) * (n - 1) / (n - len(xs) - len(years))
        for i, name in enumerate(events):
            r = terms[dependent, initial, int(name[3:])]
            assert (r["coef"], r["se"], r["n"]) == pytest.approx((b[i], v[i, i] ** 0.5, n), rel=1e-6)
        for block, keep in (("before", lambda a: a < 1998), ("after", lambda a: a > 1998)):
            at = [i for i, c in enumerate(events) if keep(int(c[3:]))]
            f = b[at] @ np.linalg.inv(v[np.ix_(at, at)]) @ b[at] / len(at)
            r = got[dependent, initial, block, "webb"]
            assert r["q"] == len(at) and r["df2"] == g - 1
            assert r["f"] == pytest.approx(f, rel=1e-6)
