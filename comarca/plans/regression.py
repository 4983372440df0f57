"""Panel regression and inference on the nation panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from comarca.functions.tails import t_quantile, t_two_sided
from comarca.operators import designs as D
from comarca.operators import gram as G
from comarca.operators import inference as I
from comarca.operators.ranking import exact_quantiles
from comarca.operators.windows import by_unit
from comarca.plans.aggregation import ex_section
from comarca.plans.base import CONTROLS, FIRST_SQL, LAST_SQL, panel, series, span, with_ctes
from comarca.plans.catalog import query
from comarca.plans.fe_sql import RADEMACHER_SQL, WEBB_SQL, fe_ctes, t_975_sql, t_two_sided_sql, wild_ctes, wild_row, with_more
from comarca.plans.index_base import DISTANCE_CTE, INDEX_SQL, PCA_CTE, index_scores, index_variants
from comarca.plans.setops import CONTROL_SETS, REGRESSORS, SAMPLES
from comarca.session import settle

X3 = ["x", *CONTROLS]
FIT = {"coef": 8, "se": 8}
_SELECT = "select coef, se, coef / se as t, n, units, periods from ffit"


def frame(spark, d):
    """The estimation sample, written once because several jobs read it."""
    return settle(panel(spark, d), "panel")


def first(fits, xs, group=None):
    """The coefficient of interest of each fit."""
    out = G.terms(fits, xs, group).filter(F.col("term") == xs[0])
    return out.select(*(group or []), "coef", "se", "t", "n", "units", "periods")


@query(
    "complete_cases",
    with_ctes("series")
    + "select unit, year, y, x, c1, c2 from series where y is not null and x is not null and c1 is not null and c2 is not null",
    y=9,
    x=9,
    c1=9,
    c2=9,
)
def complete_cases(spark, d):
    return G.complete_cases(series(spark, d), "y", X3, ["unit", "year"])


@query("demean_two_way", with_ctes("dm") + "select unit, year, y, x, c1, c2 from dm", y=8, x=8, c1=8, c2=8)
def demean_two_way(spark, d):
    return G.two_way(frame(spark, d).select("unit", "year", "y", *X3), ["y", *X3])


@query(
    "fe_fit",
    with_more(with_ctes("panel"), fe_ctes("panel", "y", X3))
    + f"""select coef, se, coef / se as t, {t_two_sided_sql('(coef / se)', '(units - 1)')} as p, coef - {t_975_sql('(units - 1)')} * se as low,
    coef + {t_975_sql('(units - 1)')} * se as high, n, units, periods from ffit""",
    t=6,
    p=7,
    low=6,
    high=6,
    **FIT,
)
def fe_fit(spark, d):
    """The coefficient of interest with its p and 95 % interval from t(units - 1)."""
    out = first(G.fe_table(frame(spark, d), "y", X3), X3)
    df = (F.col("units") - 1).cast("double")
    reach = t_quantile(F.lit(0.975), df) * F.col("se")
    p = t_two_sided(F.col("t"), df)
    return out.select(
        "coef", "se", "t", p.alias("p"), (F.col("coef") - reach).alias("low"), (F.col("coef") + reach).alias("high"),
        "n", "units", "periods",
    )


_TERMS = {t: [t, *[c for c in X3 if c != t]] for t in X3}


@query(
    "fe_fit_terms",
    with_more(
        with_ctes("panel"), {k: v for t, xs in _TERMS.items() for k, v in fe_ctes("panel", "y", xs, tag=f"f_{t}_").items()}
    )
    + " union all ".join(
        f"select '{t}' as term, coef, se, coef / se as t, {t_two_sided_sql('(coef / se)', '(units - 1)')} as p, n, units, periods from f_{t}_fit" for t in X3
    ),
    t=6,
    p=7,
    **FIT,
)
def fe_fit_terms(spark, d):
    """Every coefficient of the equation with its p against t(units - 1)."""
    out = G.terms(G.fe_table(frame(spark, d), "y", X3), X3)
    p = t_two_sided(F.col("t"), (F.col("units") - 1).cast("double"))
    return out.select("term", "coef", "se", "t", p.alias("p"), "n", "units", "periods")


@query(
    "fe_r2_within",
    with_more(with_ctes("panel"), fe_ctes("panel", "y", ["x"]))
    + """, w as (select y - avg(y) over (partition by unit) as y, x - avg(x) over (partition by unit) as x from panel)
    select 1 - sum(pow(w.y - coef * w.x, 2)) / sum(w.y * w.y) as r2_within from w, ffit""",
    r2_within=8,
)
def fe_r2_within(spark, d):
    return G.fe_table(frame(spark, d), "y", ["x"]).select("r2_within")


@query("fe_entity_only", with_more(with_ctes("panel"), fe_ctes("panel", "y", X3, time=False)) + _SELECT, t=6, **FIT)
def fe_entity_only(spark, d):
    return first(G.fe_table(frame(spark, d), "y", X3, time_effects=False), X3)


_CHANGES = """chg as (select unit, year, y, d_x, c1, c2 from (select *, x - lag(x) over (partition by unit order by year) as d_x from panel) where d_x is not null)"""


@query(
    "fe_changes",
    with_more(with_ctes("panel") + ", " + _CHANGES, fe_ctes("chg", "y", ["d_x", *CONTROLS])) + _SELECT,
    t=6,
    **FIT,
)
def fe_changes(spark, d):
    p = panel(spark, d).withColumn("d_x", F.col("x") - F.lag("x").over(by_unit()))
    return first(G.fe_table(settle(p, "changes"), "y", ["d_x", *CONTROLS]), ["d_x", *CONTROLS])


@query(
    "fe_by_group",
    with_more(with_ctes("panel"), fe_ctes("panel", "y", ["x", "c2"], group="region")) + "select region, coef, se, coef / se as t, n, units, periods from ffit",
    t=5,
    coef=7,
    se=7,
)
def fe_by_group(spark, d):
    """One regression per region, all in the same jobs."""
    xs = ["x", "c2"]
    return first(G.fe_table(frame(spark, d), "y", xs, group=["region"]), xs, ["region"])


DIMENSIONS_SQL = """, dims as (select dimension, p.unit, p.year, p.y, p.c1, p.c2, v from panel p join scores s on s.unit = p.unit and s.year = p.year,
        lateral (values ('access', s.access), ('usage', s.usage), ('depth', s.depth)) t(dimension, v))"""


@query(
    "fe_by_dimension",
    with_more(
        INDEX_SQL + DIMENSIONS_SQL,
        fe_ctes("dims", "y", ["v", *CONTROLS], group="dimension"),
    )
    + "select dimension, coef, se, coef / se as t, n, units, periods from ffit",
    t=6,
    **FIT,
)
def fe_by_dimension(spark, d):
    return first(dimension_fits(spark, d), ["v", *CONTROLS], ["dimension"])


def dimension_fits(spark, d):
    scores = index_scores(spark, d).select("unit", "year", "access", "usage", "depth")
    long = (
        panel(spark, d)
        .select("unit", "year", "y", *CONTROLS)
        .join(scores, ["unit", "year"])
        .unpivot(["unit", "year", "y", *CONTROLS], ["access", "usage", "depth"], "dimension", "v")
    )
    return G.fe_table(settle(long, "dimensions"), "y", ["v", *CONTROLS], group=["dimension"])


@query(
    "cov_cluster",
    with_more(with_ctes("panel"), fe_ctes("panel", "y", ["x", "c1"])) + "select coef, se * se as variance, units, n from ffit",
    coef=8,
    variance=12,
)
def cov_cluster(spark, d):
    xs = ["x", "c1"]
    return G.fe_table(frame(spark, d), "y", xs).select(
        F.col("beta")[0].alias("coef"), F.col("vcov")[0].alias("variance"), "units", "n"
    )


@query(
    "cov_hc",
    with_more(with_ctes("panel"), fe_ctes("panel", "y", X3))
    + """select b as coef, sqrt((select sum(x * x * e * e) from fres)) / sxx * sqrt(n::double / (n - slopes - (gg - 1))) as se from fb""",
    **FIT,
)
def cov_hc(spark, d):
    return first(G.fe_table(frame(spark, d), "y", X3, cov="hc"), X3).select("coef", "se")


@query(
    "cov_driscoll_kraay",
    with_more(with_ctes("panel"), fe_ctes("panel", "y", X3))
    + """, h as (select year, sum(x * e) as s from fres group by 1), l as (select s, lag(s, 1) over (order by year) as s1, lag(s, 2) over (order by year) as s2 from h),
    k as (select sum(s * s) + 2 * (2.0 / 3) * sum(s * s1) + 2 * (1.0 / 3) * sum(s * s2) as meat from l)
    select b as coef, sqrt(meat) / sxx * sqrt(n::double / (n - slopes - (gg - 1))) as se from fb, k""",
    **FIT,
)
def cov_driscoll_kraay(spark, d):
    fits = G.fe_table(frame(spark, d), "y", X3, cov="driscoll-kraay", bandwidth=2)
    return first(fits, X3).select("coef", "se")


@query(
    "fe_weighted",
    with_ctes("panel")
    + """, wp as (select *, pop as w from panel), d as (select unit, year, w,
      y - avg(y) over (partition by unit) - sum(w * y) over (partition by year) / sum(w) over (partition by year) + sum(w * y) over () / sum(w) over () as y,
      x - avg(x) over (partition by unit) - sum(w * x) over (partition by year) / sum(w) over (partition by year) + sum(w * x) over () / sum(w) over () as x from wp),
    b as (select sum(w * x * y) / sum(w * x * x) as b, sum(w * x * x) as sxx, count(*) as n, count(distinct unit) as g, count(distinct year) as t from d),
    s as (select unit, sum(w * x * (y - b * x)) as sg from d, b group by 1), m as (select sum(sg * sg) as meat from s)
    select b as coef, sqrt(meat) / sxx * sqrt(g::double / (g - 1) * (n - 1) / (n - 1 - t)) as se from b, m""",
    **FIT,
)
def fe_weighted(spark, d):
    """Least squares weighted by the population of the unit."""
    return first(G.fe_table(frame(spark, d), "y", ["x"], weight="pop"), ["x"]).select("coef", "se")


@query(
    "beta_convergence",
    with_ctes("series")
    + f""", sp as (select {LAST_SQL} - {FIRST_SQL} as years),
    c as (select a.unit, a.log_pc as x, (b.log_pc - a.log_pc) / years as g from sp, series a join series b using (unit) where a.year = {FIRST_SQL} and b.year = {LAST_SQL}
      and a.log_pc is not null and b.log_pc is not null), f as (select regr_slope(g, x) as b, regr_intercept(g, x) as a, avg(x) as mx, count(*) as n from c),
    v as (select sum(pow((x - mx) * (g - a - b * x), 2)) / pow(sum(pow(x - mx, 2)), 2) * any_value(n)::double / (any_value(n) - 2) as var,
      1 - sum(pow(g - a - b * x, 2)) / sum(pow(g - (select avg(g) from c), 2)) as r2 from c, f)
    select b as coef, sqrt(var) as se, n, r2, case when 1 + b * years > 0 then -ln(1 + b * years) / years end as speed from f, v, sp""",
    coef=8,
    se=8,
    r2=8,
    speed=8,
)
def beta_convergence(spark, d):
    """Mean growth on the initial level, robust errors; two passes of sums, no table is gathered."""
    s = series(spark, d)
    first_year, last_year = span(spark, d)
    years = float(last_year - first_year)
    cut = s.groupBy("unit").agg(
        F.max(F.when(F.col("year") == first_year, F.col("log_pc"))).alias("x"),
        F.max(F.when(F.col("year") == last_year, F.col("log_pc"))).alias("last"),
    )
    c = settle(cut.dropna().select("unit", "x", ((F.col("last") - F.col("x")) / years).alias("g")), "cross")
    fit = c.agg(
        F.struct(
            F.regr_slope("g", "x").alias("b"),
            F.regr_intercept("g", "x").alias("a"),
            F.avg("x").alias("mx"),
            F.avg("g").alias("mg"),
        )
    )
    e = F.col("g") - F.col("f.a") - F.col("f.b") * F.col("x")
    dx = F.col("x") - F.col("f.mx")
    n = F.count("*")
    b = F.first("f.b")
    out = c.withColumn("f", fit.scalar()).agg(
        b.alias("coef"),
        F.sqrt(F.sum(dx * dx * e * e) * n / (n - 2)).alias("_num"),
        F.sum(dx * dx).alias("_sxx"),
        n.alias("n"),
        (1 - F.sum(e * e) / F.sum(F.pow(F.col("g") - F.col("f.mg"), F.lit(2)))).alias("r2"),
    )
    speed = F.when(1 + F.col("coef") * years > 0, -F.ln(1 + F.col("coef") * years) / years)
    return out.select("coef", (F.col("_num") / F.col("_sxx")).alias("se"), "n", "r2", speed.alias("speed"))


@query(
    "sigma_convergence",
    with_ctes("series") + "select year, stddev_samp(log_pc) as sd, count(log_pc) as n from series group by 1",
    sd=9,
)
def sigma_convergence(spark, d):
    return series(spark, d).groupBy("year").agg(F.stddev_samp("log_pc").alias("sd"), F.count("log_pc").alias("n"))


@query("joint_wald")
def joint_wald(spark, d):
    """Are the regressor and a control jointly zero? F, its p, and the wild bootstrap p."""
    rep = I.run_replicas(frame(spark, d), "y", ["x", "c2"], ["c1"], replicas=999)
    r = I.wald_test(rep)
    return spark.createDataFrame(
        [(r["q"], r["f"], r["df2"], r["p_f"], r["p_bootstrap"], r["n"], r["clusters"])],
        "q int, f double, df2 int, p_f double, p_bootstrap double, n int, clusters int",
    )


def _boot_sql(weight: str, replicas: int = 999) -> str:
    return with_more(
        with_ctes("dm"),
        {
            "k": "select sum(x * y) / sum(x * x) as b, sum(x * x) as sxx, count(*) as n, count(distinct unit) as g, count(distinct year) as t from dm",
            "o": "select sum(pow(sg, 2)) as meat from (select unit, sum(x * (y - b * x)) as sg from dm, k group by 1)",
            "draws": f"select r, unit, {weight} as w from (select r, unit, md5('7|' || r::varchar || '|' || unit::varchar) as h from "
            f"(select unnest(range(1, {replicas + 1})) as r), (select distinct unit from dm))",
            "v0": "select r, unit, year, x, y * w as v from dm join draws using (unit)",
            "v": "select r, unit, year, x, v - avg(v) over (partition by r, year) as v from v0",
            "n1": "select r, sum(x * v) / any_value(sxx) as n1 from v, k group by 1",
            "sc": "select r, unit, any_value(n1) as n1, sum(x * (v - n1 * x)) as s from v join n1 using (r) group by 1, 2",
            "tr": "select r, any_value(n1) / (sqrt(sum(s * s)) / any_value(sxx)) as t from sc, k group by 1",
        },
    ) + """select b as coef, sqrt(meat) / sxx * sqrt(g::double / (g - 1) * (n - 1) / (n - 1 - t)) as se,
    b / (sqrt(meat) / sxx * sqrt(g::double / (g - 1) * (n - 1) / (n - 1 - t))) as t,
    ((select count(*) from tr where abs(t) >= abs(b / (sqrt(meat) / sxx)) - 1e-12) + 1)::double / ((select count(*) from tr) + 1) as p_bootstrap,
    (select count(*) from tr) as replicas from k, o"""


@query("wild_cluster_bootstrap", _boot_sql(RADEMACHER_SQL), coef=8, se=8, t=6, p_bootstrap=6)
def wild_cluster_bootstrap(spark, d):
    return I.symmetric_p(I.run_replicas(frame(spark, d), "y", ["x"], [], replicas=999))


@query("wild_cluster_bootstrap_webb", _boot_sql(WEBB_SQL), coef=8, se=8, t=6, p_bootstrap=6)
def wild_cluster_bootstrap_webb(spark, d):
    return I.symmetric_p(I.run_replicas(frame(spark, d), "y", ["x"], [], replicas=999, weights="webb"))


@query("wild_cluster_bootstrap_controls", with_more(with_ctes("panel"), wild_ctes("panel", "y", X3, RADEMACHER_SQL)) + wild_row(), coef=8, se=8, t=6, p_bootstrap=6)
def wild_cluster_bootstrap_controls(spark, d):
    """999 replicas with both controls projected out again inside every replica."""
    return I.symmetric_p(I.run_replicas(frame(spark, d), "y", ["x"], CONTROLS, replicas=999))


def _control_replicas(spark, d):
    return I.run_replicas(frame(spark, d), "y", ["x"], CONTROLS, replicas=999)


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    """Intervals by inverting the bootstrap test; the panel is not read again."""
    rep = _control_replicas(spark, d)
    return I.accepted_interval(rep, 0.90).unionByName(I.accepted_interval(rep, 0.95))


_TOST = """select unnest([-1.0, 1.0]) * m as b0 from
    (select k * se + abs(coef) as m from wfit, (select unnest([0.5, 1.5, 3.0]::double[]) as k))"""


@query(
    "bootstrap_tost",
    with_more(with_ctes("panel"), wild_ctes("panel", "y", X3, RADEMACHER_SQL, _TOST))
    + """, p as (select abs(b0) as margin, b0 < 0 as lower, (count(*) filter (where if(b0 < 0, t >= seen, t <= seen)) + 1)::double / (count(*) + 1) as p from wt group by 1, 2)
    select margin, greatest(p_lower, p_upper) as p, p_lower, p_upper, greatest(p_lower, p_upper) < 0.05 as equivalent
    from (select margin, max(p) filter (where lower) as p_lower, max(p) filter (where not lower) as p_upper from p group by 1)""",
    margin=8,
    p=6,
    p_lower=6,
    p_upper=6,
)
def bootstrap_tost(spark, d):
    """Two one-sided bootstrap tests at three margins (multiples of the standard error)."""
    rep = _control_replicas(spark, d)
    return I.equivalence(rep, [m * rep.se + abs(float(rep.coef[0])) for m in (0.5, 1.5, 3.0)])


@query("margin_min")
def margin_min(spark, d):
    return I.smallest_margin(_control_replicas(spark, d))


def _placebo_sql(moved: str) -> str:
    return with_more(
        with_ctes("panel"),
        {
            "reps": "select unnest(range(1, 500)) as r",
            "moved": moved,
            "dv": """select r, unit, year, x - avg(x) over (partition by r, unit) - avg(x) over (partition by r, year) + avg(x) over (partition by r) as x,
            y - avg(y) over (partition by r, unit) - avg(y) over (partition by r, year) + avg(y) over (partition by r) as y from moved""",
            "co": "select r, sum(x * y) / sum(x * x) as coef from dv group by 1",
            "tru": "select sum(x * y) / sum(x * x) as coef from dv0",
        },
    ).replace(
        "tru as (",
        """dv0 as (select x - avg(x) over (partition by unit) - avg(x) over (partition by year) + avg(x) over () as x,
        y - avg(y) over (partition by unit) - avg(y) over (partition by year) + avg(y) over () as y from panel), tru as (""",
    ) + """select tru.coef, ((count(*) filter (where abs(co.coef) >= abs(tru.coef) - 1e-15)) + 1)::double / (count(*) + 1) as p_placebo, avg(co.coef) as placebo_mean,
    stddev_samp(co.coef) as placebo_sd, quantile_cont(abs(co.coef), 0.95) as placebo_p95, count(*) as replicas from co, tru group by tru.coef"""


_PLACEBO = {"coef": 8, "p_placebo": 6, "placebo_mean": 8, "placebo_sd": 8, "placebo_p95": 8}
_TRAJ = """select r, a.unit, p.year, q.x, p.y from
    (select r, unit, row_number() over (partition by r order by unit) as k from reps, (select distinct unit from panel)) a
    join (select r, unit as donor, row_number() over (partition by r order by md5('11|' || r::varchar || '|' || unit::varchar)) as k
          from reps, (select distinct unit from panel)) b using (r, k)
    join panel p on p.unit = a.unit join panel q on q.unit = b.donor and q.year = p.year"""
_YEARLY = """select a.r, a.unit, a.year, b.x, p.y from
    (select r, unit, year, row_number() over (partition by r, year order by unit) as k from reps, panel) a
    join (select r, year, x, row_number() over (partition by r, year order by md5('11|' || r::varchar || '|' || year::varchar || '|' || unit::varchar)) as k
          from reps, panel) b on a.r = b.r and a.year = b.year and a.k = b.k
    join panel p on p.unit = a.unit and p.year = a.year"""


def _placebo(spark, d, mode):
    p = settle(frame(spark, d), "panel")
    seen = G.fe_table(p, "y", ["x"]).first()["beta"][0]
    return I.placebo_summary(I.placebo(p, "y", "x", [], mode=mode, replicas=499), seen)


@query("placebo_permute", _placebo_sql(_TRAJ), **_PLACEBO)
def placebo_permute(spark, d):
    """Whole trajectories reassigned between units."""
    return _placebo(spark, d, "trajectory")


@query("placebo_permute_within_year", _placebo_sql(_YEARLY), **_PLACEBO)
def placebo_permute_within_year(spark, d):
    return _placebo(spark, d, "within_period")


@query(
    "jackknife_units",
    with_more(
        with_ctes("panel")
        + ", lo as (select u.unit as left_out, p.* from panel p join (select distinct unit from panel) u on u.unit <> p.unit)",
        fe_ctes("lo", "y", ["x", "c2"], group="left_out"),
    )
    + "select left_out as unit, coef from ffit",
    coef=8,
)
def jackknife_units(spark, d):
    return D.leave_one_out(frame(spark, d), "y", ["x", "c2"])


_CUTS = """cuts as (select t.sample, p.* from panel p, lateral (values ('all', true), ('no_1998', p.year <> 1998), ('no_1998_1999', p.year not in (1998, 1999)),
    ('no_last', p.year <> 2000), ('no_first_unit', p.unit <> 0)) t(sample, keep) where keep)"""


def sample_tags():
    """The samples a row belongs to: the row is exploded once per sample, then all are fitted together."""
    year = F.col("year")
    keep = {
        "all": F.lit(True),
        "no_1998": year != 1998,
        "no_1998_1999": ~year.isin(1998, 1999),
        "no_last": year != 2000,
        "no_first_unit": F.col("unit") != 0,
    }
    return F.array_compact(F.array(*[F.when(keep[s], F.lit(s)) for s in SAMPLES]))


@query(
    "window_subsamples",
    with_more(with_ctes("panel") + ", " + _CUTS, fe_ctes("cuts", "y", X3, group="sample")) + "select sample, coef, se, coef / se as t, n, units, periods from ffit",
    t=5,
    **FIT,
)
def window_subsamples(spark, d):
    tagged = settle(panel(spark, d).withColumn("sample", F.explode(sample_tags())), "samples")
    return first(G.fe_table(tagged, "y", X3, group=["sample"]), X3, ["sample"])


_SPEC_LONG = (
    _CUTS.replace("from panel p,", "from lagged p,")
    + f""", long as (select regressor, sample, unit, year, y, c1, c2, v from cuts, lateral (values {', '.join(f"('{r}', {r})" for r in REGRESSORS)}) q(regressor, v)),
    spec as (select regressor || '|' || sample as g, * from long where v is not null)"""
)
_LAGGED = """, lagged as (select p.*, lag(x) over (partition by p.unit order by p.year) as x_lag1, x - lag(x) over (partition by p.unit order by p.year) as d_x,
    access, usage, depth, pca, distance from panel p left join scores s on s.unit = p.unit and s.year = p.year
    left join pcs c on c.unit = p.unit and c.year = p.year left join dist t on t.unit = p.unit and t.year = p.year)"""
_INDEXED = INDEX_SQL.rstrip().replace("with ", "with recursive ", 1) + f", {DISTANCE_CTE}, {PCA_CTE}"
_ARMS = [("both", CONTROLS), ("c2", ["c2"])]


def _spec_sql() -> str:
    ctes, parts = {}, []
    for name, ctl in _ARMS:
        for effects, time in (("two_way", True), ("unit_only", False)):
            tag = f"s_{name}_{effects}_"
            ctes |= fe_ctes("spec", "y", ["v", *ctl], tag=tag, group="g", time=time)
            parts.append(
                f"select string_split(g, '|')[1] as regressor, '{name}' as controls, string_split(g, '|')[2] as sample, '{effects}' as effects, "
                f"coef, se, n, units, sd_identifying, coef * sd_identifying * 100 as coef_pp, n < 40 or units < 10 as small from {tag}fit"
            )
    return with_more(_INDEXED + _LAGGED + ", " + _SPEC_LONG, ctes) + " union all ".join(parts)


def spec_fits(spark, d):
    """Every specification of the grid. Samples and regressors are groups of one table, so the whole
    curve takes four estimations (two control sets, two effect regimes)."""
    w = by_unit()
    p = panel(spark, d).withColumns({"x_lag1": F.lag("x").over(w), "d_x": F.col("x") - F.lag("x").over(w)})
    p = p.join(index_variants(spark, d), ["unit", "year"], "left")
    long = (
        p.withColumn("sample", F.explode(sample_tags()))
        .unpivot(["sample", "unit", "year", "y", *CONTROLS], REGRESSORS, "regressor", "v")
        .dropna(subset=["v"])
    )
    long = settle(long, "curve")
    g = ["regressor", "sample"]
    out = None
    for name, ctl in _ARMS:
        assert name in CONTROL_SETS
        for effects, time in (("two_way", True), ("unit_only", False)):
            xs = ["v", *ctl]
            fits = G.fe_table(long, "y", xs, group=g, time_effects=time)
            sd = fits.select(*g, F.sqrt(1 / F.col("inv")[0] / (F.col("n") - 1)).alias("sd_identifying"))
            rows = (
                G.terms(fits, xs, g)
                .filter("term = 'v'")
                .join(sd, g)
                .select(
                    *g,
                    F.lit(name).alias("controls"),
                    F.lit(effects).alias("effects"),
                    "coef",
                    "se",
                    "n",
                    "units",
                    "sd_identifying",
                    (F.col("coef") * F.col("sd_identifying") * 100).alias("coef_pp"),
                    F.expr("n < 40 or units < 10").alias("small"),  # kept, but too few rows to lean on
                )
            )
            out = rows if out is None else out.unionByName(rows)
    return out


@query("spec_curve", _spec_sql(), coef=7, se=7, sd_identifying=7, coef_pp=6)
def spec_curve(spark, d):
    return spec_fits(spark, d)


@query("spec_curve_summary")
def spec_curve_summary(spark, d):
    """Share of significant specifications by effect regime; those on few rows are counted as such, not left out."""
    fits = spec_fits(spark, d)
    p = t_two_sided(F.col("coef") / F.col("se"), (F.col("units") - 1).cast("double"))
    return (
        settle(fits.withColumn("p", p), "curve-p")
        .groupBy("effects")
        .agg(
            F.count("*").alias("specifications"),
            F.count_if("small").alias("small"),
            F.count_if(F.col("p") < 0.05).alias("significant"),
            F.round(F.avg((F.col("p") < 0.05).cast("int")), 4).alias("share"),
            F.round(F.median("coef"), 6).alias("median_coef"),  # at most one row per specification
            F.round(F.min("coef_pp"), 4).alias("low_pp"),
            F.round(F.max("coef_pp"), 4).alias("high_pp"),
        )
    )


_SQ = ["x", *CONTROLS, "x2"]
_SQR = ["x2", *CONTROLS, "x"]


@query(
    "quadratic_vertex",
    with_more(
        with_ctes("panel") + ", quad as (select *, x * x as x2 from panel)",
        fe_ctes("quad", "y", _SQ, tag="l") | fe_ctes("quad", "y", _SQR, tag="q"),
    )
    + """select lfit.coef as linear, qfit.coef as quadratic, qfit.se as se_quadratic, -lfit.coef / (2 * qfit.coef) as vertex,
    (select avg(case when x < -lfit.coef / (2 * qfit.coef) then 1.0 else 0.0 end) from quad) as share_below from lfit, qfit""",
    linear=6,
    quadratic=6,
    se_quadratic=6,
    vertex=4,
    share_below=6,
)
def quadratic_vertex(spark, d):
    p = settle(panel(spark, d).withColumn("x2", F.col("x") * F.col("x")), "quadratic")
    fit = G.fe_table(p, "y", _SQ)
    vertex = -F.col("beta")[0] / F.nullif(2 * F.col("beta")[3], F.lit(0.0))
    k = len(_SQ)
    out = fit.select(
        F.col("beta")[0].alias("linear"),
        F.col("beta")[3].alias("quadratic"),
        F.sqrt(F.col("vcov")[3 * k + 3]).alias("se_quadratic"),
        vertex.alias("vertex"),
    )
    below = p.withColumn("_v", fit.select(vertex).scalar()).agg(F.avg((F.col("x") < F.col("_v")).cast("double")))
    return out.withColumn("share_below", below.scalar())


@query(
    "natural_units",
    with_more(
        INDEX_SQL + ", acc as (select p.unit, p.year, p.y, p.c1, p.c2, s.access as v from panel p join scores s on s.unit = p.unit and s.year = p.year)",
        fe_ctes("acc", "y", ["v", *CONTROLS]),
    )
    + f""", wide as (select *, {t_975_sql('(units - 1)')} as tq from ffit)
    select coef, 10 / s_buyers * 100 as factor, coef * 10 / s_buyers * 100 as effect_pp,
    least(coef - tq * se, coef + tq * se) * 10 / s_buyers * 100 as low, greatest(coef - tq * se, coef + tq * se) * 10 / s_buyers * 100 as high from wide, fit_access""",
    coef=7,
    factor=6,
    effect_pp=5,
    low=5,
    high=5,
)
def natural_units(spark, d):
    """The access coefficient per ten buyers per 10,000 inhabitants, from the frozen scale."""
    from comarca.operators import composite as X
    from comarca.plans.index_base import CONTRACT, index_norm

    norm = index_norm(spark, d)
    fits = X.fit(norm, CONTRACT)
    f = fits["access"]
    access = X.apply_index(norm, fits, CONTRACT).select("unit", "year", F.col("access").alias("v"))
    p = settle(panel(spark, d).select("unit", "year", "y", *CONTROLS).join(access, ["unit", "year"]), "access")
    row = first(G.fe_table(p, "y", ["v", *CONTROLS]), ["v", *CONTROLS])
    factor = F.lit(10 / f.sd["buyers"] * f.loading["buyers"] * 100)
    t = t_quantile(F.lit(0.975), (F.col("units") - 1).cast("double"))
    ends = [(F.col("coef") + s * t * F.col("se")) * factor for s in (-1, 1)]
    return row.select(
        "coef",
        factor.alias("factor"),
        (F.col("coef") * factor).alias("effect_pp"),
        F.least(*ends).alias("low"),
        F.greatest(*ends).alias("high"),
    )


_EX = """, lvl as (select unit, year, sum(amount) as level from moves where priority not in ('1-URGENT', '5-LOW') group by 1, 2),
    epc as (select unit, year, case when level > 0 then ln(level / pop) end as lp from lvl join population using (unit)),
    exg as (select unit, year, lp - lag(lp) over (partition by unit order by year) as g from epc),
    clean as (select p.unit, p.year, e.g, p.x, p.c1, p.c2 from panel p join exg e on e.unit = p.unit and e.year = p.year where g is not null)"""


@query(
    "clean_dependent",
    with_more(with_ctes("panel") + _EX, fe_ctes("clean", "g", X3)) + _SELECT,
    t=6,
    **FIT,
)
def clean_dependent(spark, d):
    """The base equation with the growth that leaves two sections out."""
    g = ex_section(spark, d, ["1-URGENT", "5-LOW"]).select("unit", "year", F.col("growth").alias("g"))
    p = panel(spark, d).select("unit", "year", *X3).join(g.dropna(), ["unit", "year"])
    return first(G.fe_table(settle(p, "clean"), "g", X3), X3)


@query(
    "identifying_variation",
    with_more(with_ctes("panel"), fe_ctes("panel", "y", X3))
    + """, w as (select x, x - avg(x) over (partition by unit) as xu, x - avg(x) over (partition by unit) - avg(x) over (partition by year) + avg(x) over () as xt from panel)
    select stddev_samp(x) as sd_raw, count(*) as n, stddev_samp(xu) as sd_unit, stddev_samp(xt) as sd_two_way, (select stddev_samp(x) from fres) as sd_identifying,
    pow((select stddev_samp(x) from fres) / stddev_samp(x), 2) as share_identifying from w""",
    sd_raw=8,
    sd_unit=8,
    sd_two_way=8,
    sd_identifying=8,
    share_identifying=8,
)
def identifying_variation(spark, d):
    return D.identifying_variation(frame(spark, d), "x", CONTROLS)


@query(
    "aronow_samii_weights",
    with_more(with_ctes("panel"), fe_ctes("panel", "y", X3))
    + """, own as (select unit, sum(x * x) as ss from fres group by 1), w as (select unit, ss / sum(ss) over () as weight from own),
    pp as (select distinct unit, pop from panel), j as (select unit, weight, pop / sum(pop) over () as pop_share from w join pp using (unit))
    select unit, weight, pop_share, (select 1 / sum(weight * weight) from w) as effective_units, (select corr(weight, pop_share) from j) as weight_pop_corr from j""",
    weight=8,
    pop_share=8,
    effective_units=6,
    weight_pop_corr=6,
)
def aronow_samii_weights(spark, d):
    """Which units make the coefficient, beside their share of the population."""
    p = frame(spark, d)
    pops = p.groupBy("unit").agg(F.max("pop").alias("pop"))
    w = settle(D.influence_weights(p, "x", CONTROLS).join(pops, "unit"), "weights")
    total = w.agg(F.sum("pop")).scalar()
    effective = w.agg(1 / F.sum(F.col("weight") * F.col("weight"))).scalar()
    rho = w.agg(F.corr("weight", "pop")).scalar()
    return w.select(
        "unit",
        "weight",
        (F.col("pop") / total).alias("pop_share"),
        effective.alias("effective_units"),
        rho.alias("weight_pop_corr"),
    )


@query("power_columns")
def power_columns(spark, d):
    """Detectable effect, interval, equivalence p and smallest margin for every specification."""
    fits = settle(spec_fits(spark, d), "curve")
    out = I.power_columns(fits, [0.25, 0.5, 1.0], scale=F.col("sd_identifying") * 100)
    nums = ["mde80", "mde50", "ci_low", "ci_high", "margin_min", "tost_0_25", "tost_0_5", "tost_1_0"]
    return out.select("regressor", "controls", "sample", "effects", "coef", "se", *[F.round(c, 7).alias(c) for c in nums])


@query(
    "residual_ar1",
    with_more(with_ctes("panel"), fe_ctes("panel", "y", X3))
    + ", l as (select e, lag(e) over (partition by unit order by year) as e1 from fres) select corr(e, e1) as rho, count(*) as n from l where e1 is not null",
    rho=7,
)
def residual_ar1(spark, d):
    e = D.residuals(frame(spark, d), "y", X3)
    lagged = e.withColumn("e1", F.lag("e").over(Window.partitionBy("unit").orderBy("year"))).dropna()
    return lagged.agg(F.corr("e", "e1").alias("rho"), F.count("*").alias("n"))


@query(
    "between_within_corr",
    with_ctes("panel")
    + """, m as (select x, y, avg(x) over (partition by unit) as mx, avg(y) over (partition by unit) as my from panel)
    select corr(mx, my) as between_corr, corr(x - mx, y - my) as within_corr from m""",
    between_corr=8,
    within_corr=8,
)
def between_within_corr(spark, d):
    w = Window.partitionBy("unit")
    m = panel(spark, d).select("x", "y", F.avg("x").over(w).alias("mx"), F.avg("y").over(w).alias("my"))
    return m.agg(
        F.corr("mx", "my").alias("between_corr"),
        F.corr(F.col("x") - F.col("mx"), F.col("y") - F.col("my")).alias("within_corr"),
    )


@query(
    "granger_reverse",
    with_more(
        with_ctes("panel") + ", gr as (select * from (select unit, year, x - lag(x) over w as d_x, lag(y) over w as y_lag from panel window w as (partition by unit order by year)) where d_x is not null and y_lag is not null)",
        fe_ctes("gr", "d_x", ["y_lag"]),
    )
    + _SELECT,
    coef=7,
    se=7,
    t=6,
)
def granger_reverse(spark, d):
    w = by_unit()
    p = panel(spark, d).withColumns({"d_x": F.col("x") - F.lag("x").over(w), "y_lag": F.lag("y").over(w)})
    return first(G.fe_table(settle(p.select("unit", "year", "d_x", "y_lag"), "granger"), "d_x", ["y_lag"]), ["y_lag"])


_LEAD = ["x_lead", *CONTROLS, "x"]


@query(
    "lead_test",
    with_more(
        with_ctes("panel") + ", ld as (select * from (select *, lead(x) over (partition by unit order by year) as x_lead from panel) where x_lead is not null)",
        fe_ctes("ld", "y", _LEAD),
    )
    + _SELECT,
    coef=7,
    se=7,
    t=6,
)
def lead_test(spark, d):
    """Does tomorrow's regressor explain today's growth, the contemporaneous one inside?"""
    p = panel(spark, d).withColumn("x_lead", F.lead("x").over(by_unit()))
    return first(G.fe_table(settle(p, "lead"), "y", _LEAD), _LEAD)


@query(
    "trim",
    with_ctes("panel")
    + """, cut as (select quantile_cont(y, 0.01) as lo, quantile_cont(y, 0.99) as hi from panel) select unit, year, y from panel, cut where y between lo and hi""",
    y=9,
)
def trim(spark, d):
    p, lo, hi = _tails(spark, d, 0.01, 0.99)
    return p.withColumns({"_lo": lo, "_hi": hi}).filter("y between _lo and _hi").select("unit", "year", "y")


@query(
    "winsorize",
    with_ctes("panel")
    + """, cut as (select quantile_cont(y, 0.05) as lo, quantile_cont(y, 0.95) as hi from panel) select unit, year, least(greatest(y, lo), hi) as y from panel, cut""",
    y=9,
)
def winsorize(spark, d):
    p, lo, hi = _tails(spark, d, 0.05, 0.95)
    clipped = F.least(F.greatest(F.col("y"), F.col("_lo")), F.col("_hi"))
    return p.withColumns({"_lo": lo, "_hi": hi}).select("unit", "year", clipped.alias("y"))


def _tails(spark, d, low, high):
    p = settle(panel(spark, d).select("unit", "year", "y"), "tails")
    return p, *(exact_quantiles(p, [], "y", {"q": v}).scalar() for v in (low, high))

