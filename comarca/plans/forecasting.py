"""Forecasts, backtest and reconciliation on the quarterly series of the nations."""

from __future__ import annotations

from functools import cache

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from comarca.operators import forecast as P
from comarca.operators.quality import not_unique
from comarca.operators.ranking import exact_quantiles
from comarca.plans.base import INHABITANTS, moves, population, quarterly, table, with_ctes
from comarca.plans.catalog import query
from comarca.session import settle
from comarca.sources.ingest import table_fingerprint

# Fixed values of the analogue: period numbers, horizon, declared outliers and the anchor paths.
HORIZON = 3
FIRST_ORIGIN = 19
OUTLIERS = [13, 14]
ANCHOR = [
    ("central", 1, 2.40),
    ("central", 2, 2.29),
    ("central", 3, 2.29),
    ("pessimistic", 1, 2.10),
    ("pessimistic", 2, 1.60),
    ("pessimistic", 3, 1.60),
    ("optimistic", 1, 2.90),
    ("optimistic", 2, 3.40),
    ("optimistic", 3, 3.40),
]
ANCHOR_CUT = "2001-01-10"
Z80 = "1.2815515655446004"


@cache
def _last_quarter(application: str, d: str) -> int:
    spark = SparkSession.active()
    after = F.date_add(F.max(F.to_date("o_orderdate")), 1)
    row = table(spark, d, "orders").agg(((F.year(after) - 1995) * 4 + F.quarter(after) - 1).alias("t")).first()
    return int(row["t"] or 0)


def last_quarter(spark, d) -> int:
    """The last quarter that the orders cover to its end; period 1 is 1995Q1."""
    return _last_quarter(spark.sparkContext.applicationId, d)


_LAST = "(select (year(a) - 1995) * 4 + quarter(a) - 1 from (select max(o_orderdate)::date + 1 as a from orders))"


def levels(spark, d):
    t = (F.col("year") - 1995) * 4 + F.col("quarter")
    q = quarterly(spark, d).select("unit", t.cast("int").alias("t"), F.col("amount").alias("level"))
    return q.filter(F.col("t") <= last_quarter(spark, d)).withColumn("log_level", F.when(F.col("level") > 0, F.ln("level")))


def final_states(spark, d):
    return P.training_states(levels(spark, d)).filter(F.col("origin") == last_quarter(spark, d) + 1)


def rolling_forecasts(spark, d):
    """naive, drift, ar1 and their mixture at every origin, one step ahead."""
    s = settle(levels(spark, d), "levels")
    st = P.training_states(s).filter(F.col("origin").between(FIRST_ORIGIN, last_quarter(spark, d)) & (F.col("n_train") >= P.MIN_TRAIN))
    simple = P.simple_forecasts(st, 1).drop("n_train")
    both = simple.unionByName(P.combine(simple, ["unit", "origin"]).drop("models"))
    return s, both


def detail(spark, d):
    s, f = rolling_forecasts(spark, d)
    return P.backtest_detail(f, s, 1)


_LV = {
    "lv": f"select unit, ((year - 1995) * 4 + quarter)::int as t, amount as level, ln(amount) as v from q where (year - 1995) * 4 + quarter <= {_LAST}",
    "gr": "select *, v - lag(v) over (partition by unit order by t) as g, lag(v) over (partition by unit order by t) - lag(v, 2) over (partition by unit order by t) as g1 from lv",
}


def _states(origins: str) -> dict[str, str]:
    return _LV | {
        "st": f"""select unit, o as origin, arg_max(v, t) as last, arg_max(g, t) as g_last, count(*) as n_train, avg(g) as g_mean, var_samp(g) as g_var,
        regr_slope(g, g1) as phi, regr_intercept(g, g1) as const, (regr_syy(g, g1) - pow(regr_sxy(g, g1), 2) / regr_sxx(g, g1)) / (regr_count(g, g1) - 2) as sigma2
        from gr join ({origins}) oo(o) on t < o group by 1, 2"""
    }


_AR_MEAN = "last + list_sum([const * list_sum([pow(phi, i) for i in range(0, k)]) + pow(phi, k) * g_last for k in range(1, h + 1)])"
_AR_VG = "sigma2 * list_sum([pow(phi, 2 * j) for j in range(0, h)])"
_AR_VL = "sigma2 * list_sum([pow(list_sum([pow(phi, i) for i in range(0, j + 1)]), 2) for j in range(0, h)])"


def _forecasts(h: int) -> dict[str, str]:
    return {
        "fan": f"select st.*, hh.h::int as h from st, range(1, {h + 1}) hh(h)",
        "fc": f"""select unit, origin, 'naive' as model, h, last + g_last * h as mean, g_var * h as var_level, g_var as var_growth from fan
        union all select unit, origin, 'drift', h, last + g_mean * h, g_var * h, g_var from fan
        union all select unit, origin, 'ar1', h, {_AR_MEAN}, {_AR_VL}, {_AR_VG} from fan""",
        "fg": "select *, mean - coalesce(lag(mean) over (partition by unit, origin, model order by h), 0) as step from fc where mean is not null",
        "co": """select unit, origin, 'combined' as model, h, avg(mean) as mean, avg(var_level) + var_pop(mean) as var_level,
        avg(var_growth) + var_pop(step) as var_growth from fg group by unit, origin, h""",
    }


_FINAL = _states(f"select {_LAST} + 1") | _forecasts(HORIZON)
_ROLL = _states(f"select unnest(range({FIRST_ORIGIN}, {_LAST} + 1))") | {
    k: v.replace("from fan", f"from (select * from fan where n_train >= {P.MIN_TRAIN}) fan") for k, v in _forecasts(1).items()
} | {
    "dt": """select a.unit, a.origin, a.model, l.v as real, a.mean as forecast, a.var_level as variance, (a.mean - l.v) * 100 as error
    from (select * from fc union all select * from co) a join lv l on l.unit = a.unit and l.t = a.origin""",
}


def _sql(ctes: dict[str, str], tail: str) -> str:
    return with_ctes("q", extra=ctes) + tail


_F9 = {"mean": 8, "var_level": 8, "var_growth": 8}


def _model(name):
    return _sql(_FINAL, f"select unit, h, mean, var_level, var_growth from fc where model = '{name}'")


def _final(spark, d, name):
    f = P.simple_forecasts(final_states(spark, d), HORIZON)
    return f.filter(F.col("model") == name).select("unit", "h", "mean", "var_level", "var_growth")


@query("fc_naive", _model("naive"), **_F9)
def fc_naive(spark, d):
    return _final(spark, d, "naive")


@query("fc_drift", _model("drift"), **_F9)
def fc_drift(spark, d):
    return _final(spark, d, "drift")


@query("fc_ar", _model("ar1"), **_F9)
def fc_ar(spark, d):
    return _final(spark, d, "ar1")


def _over(expr: str) -> str:
    return f"{expr} over (partition by unit, o)"


def _swept(source: str, name: str, keep: list[str], cols: list[str]) -> tuple[dict[str, str], str]:
    """Relations that take the mean and then each of ``cols`` out of the columns after it, and the last one's name."""
    after = [*cols, *keep]
    ctes = {f"{name}_0": f"select unit, o, t, i, {', '.join(f'{c} - {_over(f"avg({c})")} as {c}' for c in after)} from {source}"}
    for n, c in enumerate(cols, 1):
        after = after[1:]
        slope = lambda x, c=c: f"{_over(f'sum({x} * {c})')} / nullif({_over(f'sum({c} * {c})')}, 0)"
        less = ", ".join(f"{x} - coalesce({slope(x)} * {c}, 0) as {x}" for x in after)
        ctes[f"{name}_{n}"] = f"select unit, o, t, i, {less} from {name}_{n - 1}"
    return ctes, f"{name}_{len(cols)}"


def _arma_ctes(origins: str) -> dict[str, str]:
    """The four orders by sequential projection. No declared outlier may lie at the end of a history."""
    marks = [f"d{m}" for m in OUTLIERS]
    lag = lambda k: f"lag(g, {k}) over (partition by unit order by t) as g{k}"
    step = lambda m: f"((t = {m})::int - (t = {m} + 1)::int)::double as d{m}"
    lags, out = ["g1", "g2", "g3"], {}
    out["ga"] = "select unit, t, v, v - lag(v) over (partition by unit order by t) as g, row_number() over (partition by unit order by t) - 2 as i from lv"
    out["gl"] = f"select *, {lag(1)}, {lag(2)}, {lag(3)}, {', '.join(step(m) for m in OUTLIERS)} from ga"
    out["go"] = f"select gl.*, o from gl join ({origins}) oo(o) on t < o"
    first, last = _swept("(select * from go where i >= 3)", "one", ["g"], [*marks, *lags])
    out |= first
    out["ge"] = f"select go.*, e.g as e1 from go left join {last} e on e.unit = go.unit and e.o = go.o and e.t = go.t - 1"
    fits = []
    for name, (p, _, q) in P.ARMA_ORDERS.items():
        x = [*lags[:p], *(["e1"] if q else [])]
        start = P.EARLY if q else p
        swept, clean = _swept(f"(select * from ge where i >= {start})", name, [*x, "g"], marks)
        out |= swept
        a, b = x[0], x[1] if len(x) > 1 else None
        s = lambda u, v: f"sum({u} * {v})"
        if b:
            det = f"({s(a, a)} * {s(b, b)} - pow({s(a, b)}, 2))"
            fa = f"({s(a, 'g')} * {s(b, b)} - {s(b, 'g')} * {s(a, b)}) / {det}"
            fb = f"({s(b, 'g')} * {s(a, a)} - {s(a, 'g')} * {s(a, b)}) / {det}"
        else:
            fa, fb = f"{s(a, 'g')} / {s(a, a)}", "0.0"
        out[f"{name}_b"] = f"select unit, o, {fa} as fa, {fb} as fb, {s('g', 'g')} as yy, {s(a, 'g')} as ya, {s(b or a, 'g')} as yb from {clean} group by 1, 2"
        mean_b = f"avg({b})" if b else "0"
        out[f"{name}_m"] = f"select unit, o, avg(g) as my, avg({a}) as ma, {mean_b} as mb, count(*) as n from ge where i >= {start} group by 1, 2"
        f1, f2 = ("fa" if p else "0.0"), ("fb" if p == 2 else "0.0")
        th = ("fb" if p else "fa") if q else "0.0"
        fits.append(
            f"select unit, o, '{name}' as model, my - fa * ma - fb * mb as c, {f1} as f1, {f2} as f2, {th} as th, "
            f"(yy - fa * ya - fb * yb) / (n - {1 + p + q + len(OUTLIERS)}) as s2 from {name}_b join {name}_m using (unit, o)"
        )
    out["fits"] = " union all ".join(fits)
    out["ends"] = f"select f.*, e.v, e.g as h0, e.g1 as h1, e.g - c - f1 * e.g1 - f2 * e.g2 - th * e.e1 as eps from fits f join ge e on e.unit = f.unit and e.o = f.o and e.t = f.o - 1 where i + 2 >= {P.MIN_TRAIN}"
    out["m1"] = "select *, c + f1 * h0 + f2 * h1 + th * eps as a1, f1 + th as w1 from ends"
    out["m2"] = "select *, c + f1 * a1 + f2 * h0 as a2, f1 * w1 + f2 as w2 from m1"
    out["m3"] = "select *, c + f1 * a2 + f2 * a1 as a3 from m2"
    out["af"] = """select unit, o::int as origin, model, h::int as h, v + a1 + if(h > 1, a2, 0) + if(h > 2, a3, 0) as mean,
    s2 * (1 + if(h > 1, pow(1 + w1, 2), 0) + if(h > 2, pow(1 + w1 + w2, 2), 0)) as var_level,
    s2 * (1 + if(h > 1, w1 * w1, 0) + if(h > 2, w2 * w2, 0)) as var_growth from m3, range(1, 4) hh(h)"""
    return {"lv": _LV["lv"]} | out


@query(
    "fc_arma",
    _sql(_arma_ctes(f"select {_LAST} + 1"), "select unit, model, h, mean, var_level, var_growth from af"),
    **_F9,
)
def fc_arma(spark, d):
    """The four orders with declared outliers, conditional least squares per unit."""
    return P.arma_forecasts(levels(spark, d), HORIZON, OUTLIERS).drop("origin")


@query(
    "psi_growth_variance",
    _sql(
        _FINAL,
        """, p as (select unit, phi, sigma2, h, [case when j = 0 then 1.0 else pow(phi, j - 1) * (phi + 0.3) end for j in range(0, h)] as psi from fan)
    select unit, h, psi[h] as psi, sigma2 * list_sum([x * x for x in psi]) as growth_var,
    sigma2 * list_sum([pow(list_sum(psi[1:j]), 2) for j in range(1, h + 1)]) as level_var from p""",
    ),
    psi=9,
    growth_var=9,
    level_var=9,
)
def psi_growth_variance(spark, d):
    """Growth and level variance of an ARMA(1,1) whose autoregressive part is each unit's own."""
    st = final_states(spark, d)
    psi = P.psi_weights(F.array("phi"), F.array(F.lit(0.3)), HORIZON)
    vg, vl = P.psi_variances(F.col("psi"), F.col("sigma2"))
    wide = st.withColumn("psi", psi).select("unit", "psi", vg.alias("vg"), vl.alias("vl"))
    zipped = F.arrays_zip(F.sequence(F.lit(1), F.lit(HORIZON)).alias("h"), F.col("psi"), F.col("vg"), F.col("vl"))
    return wide.select("unit", F.inline(zipped)).toDF("unit", "h", "psi", "growth_var", "level_var")


@query("fc_combine", _sql(_FINAL, "select unit, h, mean, var_level, var_growth from co"), **_F9)
def fc_combine(spark, d):
    return combined(spark, d).select("unit", "h", "mean", "var_level", "var_growth")


def combined(spark, d):
    f = P.simple_forecasts(final_states(spark, d), HORIZON)
    return P.combine(f, ["unit", "origin"])


@query(
    "rolling_origin",
    _sql(_ROLL, "select * from dt"),
    real=8,
    forecast=8,
    variance=8,
    error=6,
)
def rolling_origin(spark, d):
    return detail(spark, d)


@query(
    "rolling_origin_arma",
    _sql(
        _arma_ctes(f"select unnest(range({FIRST_ORIGIN}, {_LAST} + 1))"),
        """select a.unit, origin, model, l.v as real, mean as forecast, var_level as variance, (mean - l.v) * 100 as error
        from af a join lv l on l.unit = a.unit and l.t = origin where h = 1""",
    ),
    real=7,
    forecast=7,
    variance=7,
    error=6,
)
def rolling_origin_arma(spark, d):
    """The moving-average specifications at every origin, refitted each time."""
    s = settle(levels(spark, d), "levels")
    f = P.arma_forecasts(s, 1, OUTLIERS, list(range(FIRST_ORIGIN, last_quarter(spark, d) + 1)))
    return P.backtest_detail(f, s, 1)


@query(
    "interval_coverage",
    _sql(_ROLL, f"select model, avg(case when abs(real - forecast) <= {Z80} * sqrt(variance) then 1.0 else 0.0 end) as coverage, count(*) as n from dt group by 1"),
    coverage=9,
)
def interval_coverage(spark, d):
    return P.interval_coverage(detail(spark, d))


_PAIR = """, pr as (select a.model, a.unit, a.origin, abs(a.error) as m, abs(r.error) as r from dt a join dt r on r.unit = a.unit and r.origin = a.origin and r.model = 'naive'
    where a.model <> 'naive'), po as (select model, origin, avg(m - r) as d, count(*) as n, sum(m) as sm, sum(r) as sr from pr group by 1, 2),
    bo as (select model, arg_min(origin, d) as best_origin from po group by 1)"""


@query(
    "dm_by_origin",
    _sql(_ROLL, _PAIR + """ select model, (1 - sum(sm) / sum(sr)) * 100 as gain_pct, avg(d) / (stddev_samp(d) / sqrt(count(*))) as dm_t, count(*) as origins from po group by 1"""),
    gain_pct=6,
    dm_t=6,
)
def dm_by_origin(spark, d):
    pairs = P.paired(settle(detail(spark, d), "detail"))
    return P.origin_table(P.by_origin(pairs)).select("model", "gain_pct", "dm_t", "origins")


@query("dm_p_by_origin")
def dm_p_by_origin(spark, d):
    pairs = P.paired(settle(detail(spark, d), "detail"))
    table_ = settle(P.origin_table(P.by_origin(pairs)), "origins")
    return P.dm_p(table_).select("model", F.round("dm_t", 6).alias("dm_t"), F.round("dm_p", 6).alias("dm_p"))


_BYORIGIN = """ select po.model, count(*) filter (where d < 0) as origins_won, count(*) as origins, any_value(best_origin) as best_origin,
    (1 - sum(sm) filter (where origin <> best_origin) / sum(sr) filter (where origin <> best_origin)) * 100 as gain_without_best_pct from po join bo on bo.model = po.model group by 1"""


@query("by_origin", _sql(_ROLL, _PAIR + _BYORIGIN), gain_without_best_pct=6)
def by_origin(spark, d):
    pairs = P.paired(settle(detail(spark, d), "detail"))
    return P.origin_table(P.by_origin(pairs)).select(
        "model", "origins_won", "origins", "best_origin", "gain_without_best_pct"
    )


def _gate(regime: str = "") -> str:
    g = "regime, " if regime else ""
    using = "using (regime, model)" if regime else "using (model)"
    return f""", dr as (select *{', ' + regime if regime else ''} from dt),
    pr as (select {"a.regime, " if regime else ""}a.model, a.unit, a.origin, abs(a.error) as m, abs(r.error) as r from dr a join dr r on r.unit = a.unit and r.origin = a.origin and r.model = 'naive' where a.model <> 'naive'),
    po as (select {g}model, origin, avg(m - r) as d, sum(m) as sm, sum(r) as sr from pr group by all),
    bo as (select {g}model, arg_min(origin, d) as best_origin from po group by all),
    ga as (select {g}model, (1 - sum(sm) / sum(sr)) * 100 as gain_pct, (1 - sum(sm) filter (where origin <> best_origin) / sum(sr) filter (where origin <> best_origin)) * 100 as gain_without_best_pct
      from po join bo {using} group by all),
    ba as (select {g}model, avg(abs(error)) as mae, count(error)::double / count(*) as coverage from dr group by all)
    select {g}model, mae, coverage, gain_pct, gain_without_best_pct, model = 'naive' or coalesce(coverage >= 0.9 and gain_pct > 0 and gain_without_best_pct >= 0, false) as approved
    from ba left join ga {using}"""


_GATE = {"mae": 6, "coverage": 6, "gain_pct": 6, "gain_without_best_pct": 6}
_COLS = ["model", "mae", "coverage", "gain_pct", "gain_without_best_pct", "approved"]


@query("quality_gate", _sql(_ROLL, _gate()), **_GATE)
def quality_gate(spark, d):
    return P.verdicts(settle(detail(spark, d), "detail")).select(*_COLS)


@query(
    "by_regime",
    _sql(_ROLL, _gate("case when origin in (21, 22) then 'break' else 'calm' end as regime")),
    **_GATE,
)
def by_regime(spark, d):
    """The same verdict on calm origins and on the break."""
    det = settle(detail(spark, d), "detail")
    broken = F.col("origin").isin(21, 22)
    calm = P.verdicts(det.filter(~broken)).withColumn("regime", F.lit("calm"))
    crash = P.verdicts(det.filter(broken)).withColumn("regime", F.lit("break"))
    return calm.unionByName(crash).select("regime", *_COLS)


@query(
    "outlier_dummies",
    _sql(_LV, "select unit, t, level, case when t = 13 then 1.0::double else 0.0 end as out_13, case when t = 14 then 1.0::double else 0.0 end as out_14 from lv"),
    level=2,
)
def outlier_dummies(spark, d):
    return P.outlier_dummies(levels(spark, d).select("unit", "t", "level"), "t", OUTLIERS)


@cache
def _anchor_values() -> str:
    return ", ".join(f"('{s}', {k}, {g}::double)" for s, k, g in ANCHOR)


_TARGET = {
    "anchor": f"select * from (values {_anchor_values()}) a(scenario, step, growth_pct)",
    "nat": f"select sum(level) as last_total from lv where t = {_LAST}",
    "tg": "select scenario, step, growth_pct, last_total * exp(sum(ln(1 + growth_pct / 100)) over (partition by scenario order by step)) as target from anchor, nat",
    "bs": "select unit, h, exp(mean) as base, var_level, var_growth from co",
}
_RECON = _FINAL | _TARGET


def anchor(spark):
    return spark.createDataFrame(ANCHOR, "scenario string, step int, growth_pct double")


def targets(spark, d):
    total = levels(spark, d).filter(F.col("t") == last_quarter(spark, d)).agg(F.sum("level")).scalar()
    return P.anchor_levels(anchor(spark), total, HORIZON)


def base_levels(spark, d):
    return combined(spark, d).select("unit", "h", F.exp("mean").alias("base"), "var_level", "var_growth")


def central(spark, d):
    return targets(spark, d).filter("scenario = 'central'").select(F.col("step").alias("h"), "target")


@query(
    "reconcile_proportional",
    _sql(_RECON, """ select unit, h, base, base + (target - sum(base) over (partition by h)) * base / sum(base) over (partition by h) as reconciled
    from bs join tg on tg.step = bs.h and scenario = 'central'"""),
    base=2,
    reconciled=2,
)
def reconcile_proportional(spark, d):
    b = settle(base_levels(spark, d).select("unit", "h", "base"), "base")
    return P.reconcile_proportional(b, central(spark, d), ["h"]).select("unit", "h", "base", "reconciled")


@query(
    "reconcile_mint_diag",
    _sql(_RECON, """ select unit, h, base, base + (target - sum(base) over (partition by h)) * base * base * var_level / sum(base * base * var_level) over (partition by h) as reconciled
    from bs join tg on tg.step = bs.h and scenario = 'central'"""),
    base=2,
    reconciled=2,
)
def reconcile_mint_diag(spark, d):
    b = settle(base_levels(spark, d).select("unit", "h", "base", "var_level"), "base")
    return P.reconcile_mint_diag(b, central(spark, d), ["h"]).select("unit", "h", "base", "reconciled")


@query(
    "anchor_levels",
    _sql(
        _LV | {k: _TARGET[k] for k in ("anchor", "nat", "tg")},
        f""" select scenario, step, growth_pct, target, date_diff('day', date '{ANCHOR_CUT}', (select max(o_orderdate)::date from orders)) / (365.25 / 12) as age_months,
    date_diff('day', date '{ANCHOR_CUT}', (select max(o_orderdate)::date from orders)) / (365.25 / 12) > 6 as expired from tg""",
    ),
    target=2,
    age_months=6,
)
def anchor_levels(spark, d):
    """National targets of each scenario with the age of the anchor at the end of the data."""
    today = table(spark, d, "orders").agg(F.to_date(F.max("o_orderdate"))).scalar()
    age, expired = P.anchor_age(F.lit(ANCHOR_CUT).try_cast("date"), F.col("_today"))
    t = targets(spark, d).withColumn("_today", today)
    return t.select("scenario", "step", "growth_pct", "target", age.alias("age_months"), expired.alias("expired"))


@query(
    "scenario_fanout",
    _sql(_RECON, """ select scenario, unit, h, base + (target - sum(base) over (partition by scenario, h)) * base / sum(base) over (partition by scenario, h) as reconciled
    from bs join tg on tg.step = bs.h"""),
    reconciled=2,
)
def scenario_fanout(spark, d):
    """All scenarios reconciled in one pass: the scenario is one more key of the targets."""
    t = targets(spark, d).select("scenario", F.col("step").alias("h"), "target")
    b = settle(base_levels(spark, d).select("unit", "h", "base"), "base")
    fan = b.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in dict.fromkeys(a[0] for a in ANCHOR)])))
    return P.reconcile_proportional(fan, t, ["scenario", "h"]).select("scenario", "unit", "h", "reconciled")


@query(
    "per_capita_projection",
    with_ctes("q", "population", extra=_RECON)
    + f""", rc as (select unit, h, base + (target - sum(base) over (partition by h)) * base / sum(base) over (partition by h) as v from bs join tg on tg.step = bs.h and scenario = 'central'
      union all select unit, 0, level from lv where t = {_LAST}),
    pc as (select unit, h, v / (pop * (1 + 0.01 * h)) as per_head from rc join population using (unit))
    select * from (select unit, h, per_head, (per_head / lag(per_head) over (partition by unit order by h) - 1) * 100 as growth_pct from pc) where h > 0""",
    per_head=4,
    growth_pct=6,
)
def per_capita_projection(spark, d):
    """Reconciled level over projected population; growth is chained from the last observed value."""
    b = settle(base_levels(spark, d).select("unit", "h", "base"), "base")
    rec = P.reconcile_proportional(b, central(spark, d), ["h"]).select("unit", "h", F.col("reconciled").alias("v"))
    last = levels(spark, d).filter(F.col("t") == last_quarter(spark, d)).select("unit", F.lit(0).alias("h"), F.col("level").alias("v"))
    pop = population(spark, d).select("unit", "pop")
    pc = rec.unionByName(last).join(pop, "unit")
    pc = pc.withColumn("per_head", F.col("v") / (F.col("pop") * (1 + 0.01 * F.col("h"))))
    w = Window.partitionBy("unit").orderBy("h")
    growth = (F.col("per_head") / F.lag("per_head").over(w) - 1) * 100
    return pc.select("unit", "h", "per_head", growth.alias("growth_pct")).filter("h > 0")


@query(
    "shift_of_reconciliation",
    _sql(
        _RECON,
        f""", rc as (select unit, h, base, base + (target - sum(base) over (partition by h)) * base / sum(base) over (partition by h) as v from bs join tg on tg.step = bs.h and scenario = 'central'
      union all select unit, 0, level, level from lv where t = {_LAST}),
    sh as (select unit, h, (v / lag(v) over w - base / lag(base) over w) * 100 as d from rc window w as (partition by unit order by h))
    select h, min(d) as low, max(d) as high, median(d) as mid, max(d) - min(d) as spread, arg_min(unit, d) as unit_low, arg_max(unit, d) as unit_high from sh where h > 0 group by 1""",
    ),
    low=6,
    high=6,
    mid=6,
    spread=6,
)
def shift_of_reconciliation(spark, d):
    """How far the anchor moves each unit's growth."""
    b = settle(base_levels(spark, d).select("unit", "h", "base"), "base")
    rec = P.reconcile_proportional(b, central(spark, d), ["h"]).select("unit", "h", "base", F.col("reconciled").alias("v"))
    last = levels(spark, d).filter(F.col("t") == last_quarter(spark, d)).select(
        "unit", F.lit(0).alias("h"), F.col("level").alias("base"), F.col("level").alias("v")
    )
    w = Window.partitionBy("unit").orderBy("h")
    move = (F.col("v") / F.lag("v").over(w) - F.col("base") / F.lag("base").over(w)) * 100
    sh = settle(rec.unionByName(last).select("unit", "h", move.alias("d")).filter("h > 0"), "shift")
    stats = sh.groupBy("h").agg(
        F.min("d").alias("low"),
        F.max("d").alias("high"),
        (F.max("d") - F.min("d")).alias("spread"),
        F.min_by("unit", "d").alias("unit_low"),
        F.max_by("unit", "d").alias("unit_high"),
    )
    return stats.join(exact_quantiles(sh, ["h"], "d", {"mid": 0.5}), "h")


@query(
    "interval_width",
    _sql(_RECON, f" select unit, h, 2 * {Z80} * sqrt(var_level) * 100 as level_pp, 2 * {Z80} * sqrt(var_growth) * 100 as growth_pp from bs"),
    level_pp=6,
    growth_pp=6,
)
def interval_width(spark, d):
    level, growth = P.interval_width(F.col("var_level"), F.col("var_growth"))
    return base_levels(spark, d).select("unit", "h", level.alias("level_pp"), growth.alias("growth_pp"))


@query(
    "panel_with_vintage",
    with_ctes("moves")
    + """, u as (select count(distinct unit) as all_units from moves), c as (select year, count(distinct unit) as units, sum(amount) as total from moves group by 1),
    m as (select year, status, row_number() over (partition by year order by count(*) desc, status) as r from moves group by 1, 2),
    tx as (select concat_ws('|', coalesce(length(k) || ':' || k, '-'), coalesce(length(dy) || ':' || dy, '-'), coalesce(length(status) || ':' || status, '-'), coalesce(length(v) || ':' || v, '-')) as row
      from (select o_orderkey::varchar as k, o_orderdate::date::varchar as dy, o_orderstatus as status, o_totalprice::decimal(18, 2)::varchar as v from orders)),
    sm as (select count(*) as n, sum(('0x' || substr(md5(row), 1, 16))::ubigint::hugeint) % 18446744073709551616::hugeint as a,
      sum(('0x' || substr(md5(row), 17, 16))::ubigint::hugeint) % 18446744073709551616::hugeint as b from tx)
    select year, units, all_units - units as holes, ln(total) as log_total, status, n as source_rows,
    lpad(lower(to_hex(a::ubigint)), 16, '0') || lpad(lower(to_hex(b::ubigint)), 16, '0') as source_hash from c join m using (year), u, sm where r = 1""",
    log_total=9,
)
def panel_with_vintage(spark, d):
    """Year by year: units, holes against the full panel and the most frequent status, with the hash of the source.

    A panel of units and years with a hole or a repeated row is refused.
    """
    m = moves(spark, d)
    cells = m.groupBy("unit", "year").agg(F.sum("amount").alias("v"))
    per_year = P.require_complete(cells, "unit", "year", "v").groupBy("year").agg(F.count("*").alias("units"), F.sum("v").alias("total"))
    counts = m.groupBy("year", "status").agg(F.count("*").alias("n"))
    mode = counts.groupBy("year").agg(F.min_by("status", F.struct(-F.col("n"), F.col("status"))).alias("status"))
    everyone = m.agg(F.countDistinct("unit")).scalar()
    source = table(spark, d, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price")
    )
    hashed = table_fingerprint(source, ["o_orderkey", "day", "o_orderstatus", "price"]).select(F.struct("rows", "fingerprint")).scalar()
    return mode.join(per_year, "year").select(
        "year",
        "units",
        (everyone - F.col("units")).alias("holes"),
        F.ln("total").alias("log_total"),
        "status",
        hashed["rows"].alias("source_rows"),
        hashed["fingerprint"].alias("source_hash"),
    )


@query(
    "population_projection",
    """with p as (select c_nationkey as unit, count(*) * 100.0::double as pop from customer group by 1)
    select unit, y.y::int as year, pop * (1 + 0.01 * (y.y - 2000)) as population from p, range(2000, 2004) y(y)""",
    population=4,
)
def population_projection(spark, d):
    """The total area of the projection; a repeated unit and year would stop the run."""
    by_area = (
        table(spark, d, "customer")
        .rollup(F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("area"))
        .agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
        .filter("_g <= 1")
        .withColumn("area", F.when(F.col("_g") == 1, "total").otherwise(F.col("area")))
    )
    years = F.sequence(F.lit(2000), F.lit(2003))
    grown = by_area.withColumn("year", F.explode(years)).withColumn(
        "population", F.col("n") * F.lit(INHABITANTS) * (1 + 0.01 * (F.col("year") - 2000))
    )
    total = grown.filter("area = 'total'")
    clash = not_unique(total, ["unit", "year"]).agg(F.count("*")).scalar()
    checked = F.when(clash == 0, F.col("population")).otherwise(
        F.raise_error(F.lit("repeated unit and year in the projection")).cast("double")
    )
    return total.select("unit", "year", checked.alias("population"))
