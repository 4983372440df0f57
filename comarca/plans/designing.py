"""Complementary designs and residual diagnostics on the nation panel."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from comarca.functions.tails import normal_two_sided, t_two_sided
from comarca.operators import composite as X
from comarca.operators import designs as D
from comarca.operators import gram as G
from comarca.operators import inference as I
from comarca.operators import star as S
from comarca.operators.windows import holm
from comarca.plans.base import BASE_YEAR, CONTROLS, panel, quarterly, ring, series, span, with_ctes
from comarca.plans.catalog import query
from comarca.plans.fe_sql import fe_ctes, t_two_sided_sql, with_more
from comarca.plans.index_base import CONTRACT, INDEX_SQL, index_input
from comarca.plans.joining import _SHAPES, supplier_shapes
from comarca.plans.regression import DIMENSIONS_SQL, FIT, X3, dimension_fits, first, frame
from comarca.session import settle

_ROW = "select coef, se, coef / se as t, n, units, periods from ffit"
#: The years of the driver's tables, for twins that need one column per year.
YEARS = list(range(1996, 2001))


def panel_years(spark, d) -> list[int]:
    first, last = span(spark, d)
    return list(range(first + 1, last + 1))


@query(
    "cce_pooled",
    with_more(
        with_ctes("panel")
        + ", mm as (select *, unit as g, avg(y) over (partition by year) as my, avg(x) over (partition by year) as mx from panel)",
        fe_ctes("mm", "y", ["x", "my", "mx"], group="g", time=False),
    )
    + """, k as (select sum(x * y) / sum(x * x) as b, sum(x * x) as sxx, count(*) as n, count(distinct unit) as g from fres),
    s as (select unit, sum(x * (y - b * x)) as sg from fres, k group by 1)
    select b as coef, sqrt((select sum(sg * sg) from s)) / sxx * sqrt(g::double / (g - 1)) as se, n, g as units from k""",
    coef=7,
    se=7,
)
def cce_pooled(spark, d):
    return D.cce_pooled(frame(spark, d), "y", "x")


_EXPO = """, expo as (select unit, x as e0, log_pc as l0 from panel where year = 1996), nat as (select year, avg(x) as a from panel group by 1),
    sh as (select p.unit, p.year, p.y, p.c1, p.c2, e.e0 * n.a as ss, e.l0 * n.a as rival from panel p join expo e using (unit) join nat n using (year))"""


def exposures(p):
    """Base-year exposure times the national mean, for the index and for a rival exposure."""
    nat = p.groupBy("year").agg(F.avg("x").alias("a"))
    based = S.fixed_baseline(p, "unit", "year", BASE_YEAR, {"x": "e0", "log_pc": "l0"}).join(nat, "year")
    return based.withColumns({"ss": F.col("e0") * F.col("a"), "rival": F.col("l0") * F.col("a")})


@query("exposure_adoption", with_more(with_ctes("panel") + _EXPO, fe_ctes("sh", "y", ["ss", *CONTROLS])) + _ROW, t=6, **FIT)
def exposure_adoption(spark, d):
    p = settle(exposures(frame(spark, d)), "exposure")
    return first(G.fe_table(p, "y", ["ss", *CONTROLS]), ["ss", *CONTROLS])


_RACE = ["ss", "rival", *CONTROLS]


@query(
    "exposure_rivals",
    with_more(
        with_ctes("panel") + _EXPO,
        fe_ctes("sh", "y", _RACE, tag="m_") | fe_ctes("sh", "y", ["rival", "ss", *CONTROLS], tag="n_"),
    )
    + "select 'ss' as term, coef, se from m_fit union all select 'rival', coef, se from n_fit",
    coef=7,
    se=7,
)
def exposure_rivals(spark, d):
    """The exposure and its rival in one equation."""
    p = settle(exposures(frame(spark, d)), "exposure")
    return G.terms(G.fe_table(p, "y", _RACE), _RACE).filter("term in ('ss', 'rival')").select("term", "coef", "se")


_EVENT = """, ex as (select unit, (e - avg(e) over ()) / stddev_samp(e) over () as z from (select unit, x as e from panel where year = 1996)),
    dy as (select p.unit, p.year, p.y - r.y as v, z from panel p join panel r on r.unit = p.unit and r.year = 1997 join ex on ex.unit = p.unit where p.year <> 1997),
    bk as (select year, sum(z * v) / sum(z * z) as b, sum(z * z) as szz, avg(v) as mv from dy group by 1),
    vk as (select year, sum(pow(z * (v - mv - b * z), 2)) as meat, any_value(b) as b, any_value(szz) as szz from dy join bk using (year) group by 1),
    sz as (select count(*) as n, count(distinct unit) as g, count(distinct year) as t from panel)"""


@query(
    "event_study",
    with_ctes("panel")
    + _EVENT
    + """ select year, b as coef, sqrt(meat) / szz * sqrt(g::double / (g - 1) * (n - 1) / (n - (t - 1) - t)) as se, false as reference from vk, sz
    union all select 1997, 0.0, 0.0, true""",
    **FIT,
)
def event_study(spark, d):
    """Standardised base exposure times year, relative to the year before the event."""
    p, names = event_frame(spark, d, 1997)
    fits = G.terms(G.fe_table(p, "y", names), names)
    rows = fits.select(
        F.regexp_extract("term", r"(\d+)$", 1).cast("int").alias("year"), "coef", "se", F.lit(False).alias("reference")
    )
    ref = spark.createDataFrame([(1997, 0.0, 0.0, True)], "year int, coef double, se double, reference boolean")
    return rows.unionByName(ref)


_QUADRATIC = ["x2", *CONTROLS, "x"]
_FAMILY = with_more(
    INDEX_SQL.rstrip() + DIMENSIONS_SQL + _EXPO + _EVENT + ", quad as (select *, x * x as x2 from panel)",
    fe_ctes("panel", "y", X3, tag="b_")
    | fe_ctes("dims", "y", ["v", *CONTROLS], tag="d_", group="dimension")
    | fe_ctes("sh", "y", ["ss", *CONTROLS], tag="e_")
    | fe_ctes("quad", "y", _QUADRATIC, tag="q_")
    | {
        "named": """select 'base' as contrast, coef, se, units from b_fit union all select 'dimension ' || dimension, coef, se, units from d_fit
        union all select 'initial exposure', coef, se, units from e_fit union all select 'quadratic term', coef, se, units from q_fit
        union all select 'event ' || year, b, sqrt(meat) / szz * sqrt(g::double / (g - 1) * (n - 1) / (n - (t - 1) - t)), g from vk, sz where year >= 1998""",
        "tested": f"select *, {t_two_sided_sql('(coef / se)', '(units - 1)')} as p from named",
        "stepped": "select *, least(1, (count(*) over () - row_number() over (order by p, contrast) + 1) * p) as step from tested",
        "adjusted": "select *, max(step) over (order by p, contrast rows unbounded preceding) as p_holm from stepped",
    },
)


@query(
    "contrast_family",
    _FAMILY
    + """select 'main' as family, contrast, coef, se, p, p_holm, p_holm < 0.05 as rejected, count(*) over () as contrasts,
    count(*) filter (where p_holm < 0.05) over () as rejections, count(*) filter (where p < 0.05) over () as rejections_unadjusted from adjusted""",
    coef=7,
    se=7,
    p=7,
    p_holm=7,
)
def contrast_family(spark, d):
    """The contrasts a reader takes in, p on t(units - 1), Holm adjustment over the family.

    The base equation, the three dimensions, the initial exposure, every year from the event on and the
    quadratic term: as many contrasts as the panel has years after the event.
    """
    p = frame(spark, d)
    keep = lambda rows, name: rows.select(name.alias("contrast"), "coef", "se", "units")
    squared = settle(p.withColumn("x2", F.col("x") * F.col("x")), "quadratic")
    exposed = settle(exposures(p), "exposure")
    events, names = event_frame(spark, d, 1997)
    year = F.regexp_extract("term", r"(\d+)$", 1)
    parts = [
        keep(first(G.fe_table(p, "y", X3), X3), F.lit("base")),
        keep(first(dimension_fits(spark, d), ["v", *CONTROLS], ["dimension"]), F.concat(F.lit("dimension "), "dimension")),
        keep(first(G.fe_table(exposed, "y", ["ss", *CONTROLS]), ["ss", *CONTROLS]), F.lit("initial exposure")),
        keep(first(G.fe_table(squared, "y", _QUADRATIC), _QUADRATIC), F.lit("quadratic term")),
        keep(
            G.terms(G.fe_table(events, "y", names), names).where(year.cast("int") >= 1998),
            F.concat(F.lit("event "), year),
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = settle(rows, "contrasts")
    pt = t_two_sided(F.col("coef") / F.col("se"), (F.col("units") - 1).cast("double"))
    out = holm(rows.withColumns({"family": F.lit("main"), "p": pt}), "p", ["family"], ["contrast"])
    total = out.select(
        F.count("*").over(Window.partitionBy("family")).alias("contrasts"),
        F.count_if(F.col("p_holm") < 0.05).over(Window.partitionBy("family")).alias("rejections"),
        F.count_if(F.col("p") < 0.05).over(Window.partitionBy("family")).alias("rejections_unadjusted"),
        "*",
    )
    return total.select(
        "family", "contrast", "coef", "se", "p", "p_holm", (F.col("p_holm") < 0.05).alias("rejected"), "contrasts",
        "rejections", "rejections_unadjusted",
    )


def event_frame(spark, d, reference):
    p = frame(spark, d)
    base = p.filter(F.col("year") == BASE_YEAR).select("unit", F.col("x").alias("e0"))
    z = D.standardized(base, "e0", "z").select("unit", "z")
    out, names = D.event_dummies(p.join(z, "unit"), "z", panel_years(spark, d), reference)
    return settle(out, "events"), names


def long_event_frame(spark, d, reference):
    """Every unit and year that has growth, with exposure and initial income times year; no window, no controls.

    The exposure is x of the base year, standardised over the units that have it. Dummies come from the years in
    the data; initial income times year leaves out the first. Units without a base year take no part.
    """
    whole = F.when((F.col("amount") > 0) & (F.col("amount_lag") > 0), F.log("amount") - F.log("amount_lag"))
    s = series(spark, d).dropna(subset=["y"]).select("unit", "year", "y", whole.alias("y_total"))
    s = settle(s, "long")
    base = series(spark, d).filter(F.col("year") == BASE_YEAR).select("unit", F.col("x").alias("e0"), F.col("log_pc").alias("l0"))
    z = D.standardized(base.dropna(subset=["e0"]), "e0", "z").select("unit", "z", "l0")
    p = settle(s.join(z, "unit"), "exposed")
    years = [r[0] for r in p.select("year").distinct().orderBy("year").collect()]
    out, events = D.event_dummies(p, "z", years, reference)
    starts = {f"i{a}": F.col("l0") * F.when(F.col("year") == a, 1.0).otherwise(0.0) for a in years[1:]}
    return settle(out.withColumns(starts), "long-events"), events, list(starts)


@query("pre_trends")
def pre_trends(spark, d):
    """Joint tests of all years before and after the reference, on F and by wild bootstrap.

    For growth per head and total growth, on the long series, without and with initial income times year as untested regressors. A block without years
    in the data has no rows.
    """
    p, names, starts = long_event_frame(spark, d, 1998)
    years = {n: int(n.removeprefix("ev_")) for n in names}
    rows = []
    designs = [(y, *initial) for y in ("y", "y_total") for initial in (("none", []), ("log_pc", starts))]
    for y, initial, extra in designs:
        for block, keep in (("before", lambda a: a < 1998), ("after", lambda a: a > 1998)):
            tested = [n for n in names if keep(years[n])]
            if not tested:
                continue
            prep = I.prepare(p, y, tested, [n for n in names if n not in tested] + extra)
            for weights in ("rademacher", "webb"):
                r = I.wald_test(I.replicate(prep, replicas=999, weights=weights))
                rows.append((y, initial, block, weights, r["q"], r["f"], r["df2"], r["p_f"], r["p_bootstrap"]))
    return spark.createDataFrame(
        rows, "dependent string, initial string, block string, weights string, q int, f double, df2 int, p_f double, p_bootstrap double"
    )


@query("pre_trend_terms")
def pre_trend_terms(spark, d):
    """dependent, initial, year, coef, se, n, units: the event coefficients behind ``pre_trends``, the reference left out."""
    p, names, starts = long_event_frame(spark, d, 1998)
    rows = None
    for y in ("y", "y_total"):
        for initial, extra in (("none", []), ("log_pc", starts)):
            xs = [*names, *extra]
            fit = G.terms(G.fe_table(p, y, xs), xs).filter(F.col("term").startswith("ev_"))
            year = F.substring("term", 4, 4).cast("int").alias("year")
            one = fit.select(F.lit(y).alias("dependent"), F.lit(initial).alias("initial"), year, "coef", "se", "n", "units")
            rows = one if rows is None else rows.unionByName(one)
    return rows


_IC = [f"i{a}" for a in YEARS[1:]]


@query(
    "initial_conditions_x_year",
    with_more(
        with_ctes("panel")
        + ", ic as (select p.*, "
        + ", ".join(f"case when p.year = {a} then b.log_pc else 0.0 end as i{a}" for a in YEARS[1:])
        + " from panel p join (select unit, log_pc from panel where year = 1996) b using (unit))",
        fe_ctes("ic", "y", ["x", "c2", *_IC]),
    )
    + _ROW,
    coef=6,
    se=6,
    t=4,
)
def initial_conditions_x_year(spark, d):
    """The lagged income gives way to its base-year value times every year."""
    p = S.fixed_baseline(frame(spark, d), "unit", "year", BASE_YEAR, {"log_pc": "l0"})
    years = panel_years(spark, d)[1:]
    p = p.withColumns({f"i{a}": F.when(F.col("year") == a, F.col("l0")).otherwise(0.0) for a in years})
    xs = ["x", "c2", *[f"i{a}" for a in years]]
    return first(G.fe_table(settle(p, "initial"), "y", xs), xs)


_WX = ", wx as (select p.*, l.w_x from panel p join (select r.unit, q.year, avg(q.x) as w_x from ring r join panel q on q.unit = r.neighbour group by 1, 2) l using (unit, year))"


@query("spatial_lag", with_ctes("panel", "ring") + _WX + " select unit, year, x, w_x from wx", x=9, w_x=9)
def spatial_lag(spark, d):
    p = panel(spark, d).select("unit", "year", "x")
    return S.spatial_lag(p, ring(spark, d), "x", "w_x")


_SLX = ["x", *CONTROLS, "w_x"]


@query(
    "slx",
    with_more(
        with_ctes("panel", "ring") + _WX,
        fe_ctes("wx", "y", _SLX, tag="m_") | fe_ctes("wx", "y", ["w_x", *CONTROLS, "x"], tag="n_"),
    )
    + "select 'x' as term, coef, se from m_fit union all select 'w_x', coef, se from n_fit",
    **FIT,
)
def slx(spark, d):
    p = settle(S.spatial_lag(frame(spark, d), ring(spark, d), "x", "w_x").dropna(subset=["w_x"]), "slx")
    return G.terms(G.fe_table(p, "y", _SLX), _SLX).filter("term in ('x', 'w_x')").select("term", "coef", "se")


@query(
    "row_normalized_weights",
    f"""with {_SHAPES}, e as (select unit, nxt as neighbour from chain where nxt is not null union all select nxt, unit from chain where nxt is not null)
    select unit, neighbour, 1.0::double / count(*) over (partition by unit) as weight from e""",
)
def row_normalized_weights(spark, d):
    return S.row_normalized(S.shared_boundary_edges(supplier_shapes(spark, d), "unit", "arcs"))


def _moran_sql() -> str:
    base = with_more(with_ctes("panel", "ring"), fe_ctes("panel", "y", X3))
    more = {
        "ed": "select unit, neighbour, 1.0 / count(*) over (partition by unit) as weight from ring",
        "obj": "select 'raw' as what, unit, year, y as z from panel union all select 'residual', unit, year, e from fres",
        "dz": "select what, unit, year, z - avg(z) over (partition by what, year) as v from obj",
        "ss": "select what, year, sum(v * v) as ss, count(*) as n from dz group by 1, 2",
        "ob": "select a.what, a.year, sum(weight * a.v * b.v) as c from ed join dz a on a.unit = ed.unit join dz b on b.unit = ed.neighbour and b.year = a.year and b.what = a.what group by 1, 2",
        "oi": "select what, year, c / ss as i, n from ob join ss using (what, year)",
        "pk": "select r, what, year, unit, row_number() over (partition by r, what, year order by unit) as k from dz, (select unnest(range(1, 1000)) as r)",
        "dk": "select r, what, year, v, row_number() over (partition by r, what, year order by md5('13|' || r::varchar || '|' || year::varchar || '|' || unit::varchar)) as k from dz, (select unnest(range(1, 1000)) as r)",
        "pz": "select pk.r, pk.what, pk.year, pk.unit, dk.v from pk join dk on dk.r = pk.r and dk.what = pk.what and dk.year = pk.year and dk.k = pk.k",
        "nul": "select a.r, a.what, a.year, sum(weight * a.v * b.v) as c from ed join pz a on a.unit = ed.unit join pz b on b.unit = ed.neighbour and b.year = a.year and b.what = a.what and b.r = a.r group by 1, 2, 3",
    }
    return with_more(base, more) + """select what, year, any_value(i) as i, (count(*) filter (where abs(c / ss.ss) >= abs(i) - 1e-12) + 1)::double / (count(*) + 1) as p,
    any_value(oi.n) as n, -1.0 / (any_value(oi.n) - 1) as expected from nul join ss using (what, year) join oi using (what, year) group by 1, 2"""


@query("moran_i", _moran_sql(), i=7, p=6, expected=9)
def moran_i(spark, d):
    """Spatial autocorrelation per year of the raw growth and of the residuals."""
    p = settle(frame(spark, d), "panel")
    edges = settle(S.row_normalized(ring(spark, d)), "edges")
    raw = p.select(F.lit("raw").alias("what"), "unit", "year", F.col("y").alias("z"))
    res = D.residuals(p, "y", X3).select(F.lit("residual").alias("what"), "unit", "year", F.col("e").alias("z"))
    return D.moran(raw.unionByName(res), edges, scope=["what"])


@query(
    "pesaran_cd",
    with_more(with_ctes("panel"), fe_ctes("panel", "y", X3))
    + """, h as (select unit, year, e from fres),
    pr as (select a.unit as u, b.unit as w, corr(a.e, b.e) as rho from h a join h b on a.year = b.year and a.unit < b.unit group by 1, 2 having count(*) >= 3),
    tt as (select avg(k) as t, count(*) as n from (select unit, count(*) as k from h group by 1))
    select sqrt(2 * any_value(t) / (any_value(n) * (any_value(n) - 1))) * sum(rho) as cd, any_value(n) as n, avg(rho) as mean_rho, count(*) as pairs from pr, tt""",
    cd=6,
    mean_rho=7,
)
def pesaran_cd(spark, d):
    return D.pesaran_cd(D.residuals(frame(spark, d), "y", X3))


@query("pesaran_cd_test")
def pesaran_cd_test(spark, d):
    cd = D.pesaran_cd(D.residuals(frame(spark, d), "y", X3))
    return settle(cd, "cd-row").withColumn("p", normal_two_sided("cd"))


@query(
    "cips",
    with_more(
        with_ctes("q")
        + """, lv as (select unit, year * 4 + quarter as t, ln(amount) as v from q), mt as (select t, avg(v) as m from lv group by 1),
        lg as (select unit, unit as g, t as year, v - lag(v) over w as dy, lag(v) over w as y1, lag(m) over w as m1, m - lag(m) over w as dm,
          count(*) over (partition by unit) as nn from lv join mt using (t) window w as (partition by unit order by t)),
        cad as (select * from lg where dy is not null and nn = (select count(distinct t) from lv))""",
        fe_ctes("cad", "dy", ["y1", "m1", "dm"], group="g", time=False),
    )
    + """, ts as (select g, any_value(b) / sqrt(sum(e * e) / (any_value(n) - 4) / any_value(sxx)) as t from fres join fb using (g) group by 1)
    select avg(t) as cips, count(*) as units from ts""",
    cips=6,
)
def cips(spark, d):
    """Panel unit-root statistic on the quarterly log level."""
    q = quarterly(spark, d).select("unit", (F.col("year") * 4 + F.col("quarter")).alias("t"), F.ln("amount").alias("v"))
    return D.cadf(settle(q, "levels"), "v").agg(F.avg("t").alias("cips"), F.count("t").alias("units"))


@query("mundlak")
def mundlak(spark, d):
    """Random effects with the within deviation and the unit mean of the regressor."""
    from comarca.operators.windows import within_between

    p = within_between(frame(spark, d), "x")
    names = ["x_within", "x_mean", "c2"]
    r = D.random_effects(p, "y", names)
    rows = [
        (name, float(r["beta"][i]), float(r["vcov"][i, i] ** 0.5), r["n"], r["units"]) for i, name in enumerate(r["names"])
    ]
    out = spark.createDataFrame(rows, "term string, coef double, se double, n int, units int")
    return out.withColumn("p", t_two_sided(F.col("coef") / F.col("se"), (F.col("units") - 1).cast("double")))


@query("hausman")
def hausman(spark, d):
    """Kept for comparison and marked invalid: both covariances are clustered."""
    r = D.hausman(frame(spark, d), "y", ["x", "c2"])
    return spark.createDataFrame(
        [(r["chi2"], r["df"], r["p"], r["n"], r["valid"])], "chi2 double, df int, p double, n int, valid boolean"
    )


def denominator_frame(spark, d):
    """The composite with each denominator, real and with frozen numerators, one column each.

    With a fixed product the frozen amounts do not vary, so that placebo does not exist: its column is
    NULL and its rows stay in the table as not estimable.
    """
    source = settle(index_input(spark, d).join(panel(spark, d).select("unit", "year", "y", *CONTROLS), ["unit", "year"]), "denominators")
    out, names = source.select("unit", "year", "y", *CONTROLS), []
    for mode in ("current", "lagged", "fixed"):
        c = replace(CONTRACT, denominator=mode)
        for kind, rows in (("index", source), ("placebo", X.freeze_numerators(source, c))):
            name = f"{kind}_{mode}"
            names.append(name)
            norm = X.normalize(rows, c)
            try:
                scores = X.apply_index(norm, X.fit(norm, c), c).select("unit", "year", F.col("composite").alias(name))
            except ValueError:
                out = out.withColumn(name, F.lit(None).cast("double"))
                continue
            out = out.join(scores, ["unit", "year"], "left")
    return settle(out, "denominator-panel"), names


@query("denominator_grid")
def denominator_grid(spark, d):
    """Real and placebo index x denominator x window x controls; rows that cannot be estimated stay."""
    wide, names = denominator_frame(spark, d)
    year = F.col("year")
    windows = F.array_compact(F.array(F.lit("all"), F.when(~year.isin(1998, 1999), F.lit("no_1998_1999"))))
    long = wide.withColumn("window", F.explode(windows)).unpivot(
        ["window", "unit", "year", "y", *CONTROLS], names, "version", "v"
    )
    grid = long.select("version", "window").distinct()
    g = ["version", "window"]
    data = settle(long.dropna(subset=["v"]), "denominator-long")
    out = None
    for label, ctl in (("with", CONTROLS), ("without", [])):
        xs = ["v", *ctl]
        fits = first(G.fe_table(data, "y", xs, group=g), xs, g)
        rows = grid.join(fits, g, "left").withColumn("controls", F.lit(label))
        out = rows if out is None else out.unionByName(rows)
    p = t_two_sided(F.col("t"), (F.col("units") - 1).cast("double"))
    return settle(out, "grid").select(
        *g, "controls", F.col("coef").isNotNull().alias("estimable"), "coef", "se", p.alias("p"), "n"
    )
