"""Bootstrap and placebo of the coefficients that claim something: the initial exposure and the quadratic term."""

from __future__ import annotations

from pyspark.sql import functions as F

from comarca.operators import gram as G
from comarca.operators import inference as I
from comarca.plans.base import CONTROLS, with_ctes
from comarca.plans.catalog import query
from comarca.plans.designing import _EXPO, exposures
from comarca.plans.fe_sql import RADEMACHER_SQL, WEBB_SQL, fe_ctes, wild_ctes, wild_row, with_more
from comarca.plans.regression import frame
from comarca.session import settle

_P = {"coef": 8, "se": 8, "t": 6, "p_bootstrap": 6}
_XS = ["ss", *CONTROLS]
_MOVED = """moved as (select r, a.unit, p.year, q.ss, p.y, p.c1, p.c2 from
    (select r, unit, row_number() over (partition by r order by unit) as k from reps, (select distinct unit from sh)) a
    join (select r, unit as donor, row_number() over (partition by r order by md5('11|' || r::varchar || '|' || unit::varchar)) as k
          from reps, (select distinct unit from sh)) b using (r, k)
    join sh p on p.unit = a.unit join sh q on q.unit = b.donor and q.year = p.year)"""


@query(
    "exposure_bootstrap",
    with_more(
        with_ctes("panel") + _EXPO,
        wild_ctes("sh", "y", _XS, RADEMACHER_SQL, tag="ra") | wild_ctes("sh", "y", _XS, WEBB_SQL, tag="we"),
    )
    + f"select 'rademacher' as weights, * from ({wild_row('ra')}) union all select 'webb', * from ({wild_row('we')})",
    **_P,
)
def exposure_bootstrap(spark, d):
    """The wild bootstrap of the exposure design with both kinds of weights."""
    p = settle(exposures(frame(spark, d)), "exposure")
    prep = I.prepare(p, "y", ["ss"], CONTROLS)
    one = lambda kind: I.symmetric_p(I.replicate(prep, replicas=999, weights=kind)).select(F.lit(kind).alias("weights"), "*")
    return one("rademacher").unionByName(one("webb"))


@query(
    "exposure_placebo",
    with_more(
        with_ctes("panel") + _EXPO + ", reps as (select unnest(range(1, 500)) as r), " + _MOVED,
        fe_ctes("moved", "y", _XS, tag="p", group="r") | fe_ctes("sh", "y", _XS, tag="o"),
    )
    + """select o.coef, ((count(*) filter (where abs(p.coef) >= abs(o.coef) - 1e-15)) + 1)::double / (count(*) + 1) as p_placebo,
    avg(p.coef) as placebo_mean, stddev_samp(p.coef) as placebo_sd, quantile_cont(abs(p.coef), 0.95) as placebo_p95, count(*) as replicas
    from pfit p, ofit o group by o.coef""",
    coef=8,
    p_placebo=6,
    placebo_mean=7,
    placebo_sd=7,
    placebo_p95=7,
)
def exposure_placebo(spark, d):
    """The exposure design with the exposures of other units."""
    p = settle(exposures(frame(spark, d)), "exposure")
    seen = G.fe_table(p, "y", _XS).first()["beta"][0]
    return I.placebo_summary(I.placebo(p, "y", "ss", CONTROLS, replicas=499), seen)


@query(
    "quadratic_bootstrap",
    with_more(
        with_ctes("panel") + ", quad as (select *, x * x as x2 from panel)", wild_ctes("quad", "y", ["x2", *CONTROLS, "x"], RADEMACHER_SQL)
    )
    + wild_row(),
    coef=6,
    se=6,
    t=6,
    p_bootstrap=6,
)
def quadratic_bootstrap(spark, d):
    """The wild bootstrap of the quadratic term, the linear one being a control."""
    p = frame(spark, d).withColumn("x2", F.col("x") * F.col("x"))
    return I.symmetric_p(I.run_replicas(p, "y", ["x2"], [*CONTROLS, "x"], replicas=999))
