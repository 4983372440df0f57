"""The two-stage index on the nation panel: contract, SQL twin and shared frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from comarca.operators import composite as X
from comarca.plans.base import FIRST_SQL, LAST_SQL, series, span, with_ctes
from comarca.session import settle

# Fixed values of the analogue contract: three dimensions, equal weights, calibration 1996-1997.
CONTRACT = X.Contract(
    dimensions={
        "access": X.Dimension("single", {"buyers": 1}),
        "usage": X.Dimension("equal", {"orders": 1, "closed": 1}),
        "depth": X.Dimension("equal", {"amount": 1, "urgent": 1, "pending": 1}),
    },
    rules={
        "buyers": "per_head",
        "orders": "per_head",
        "closed": "per_head",
        "amount": "pct_product",
        "urgent": "per_head",
        "pending": "per_head",
    },
    weights={"access": 1 / 3, "usage": 1 / 3, "depth": 1 / 3},
    calibration=(1996, 1997),
    denominator="lagged",
    population="pop",
    product="amount",
)
VARS = list(CONTRACT.rules)


def index_input(spark, d):
    """Unit-year rows with the numerators, population and the product with its full-series lag."""
    first, last = span(spark, d)  # the first year has no product of the year before
    return (
        series(spark, d)
        .filter(F.col("year").between(first + 1, last))
        .withColumn("pending", F.col("orders") - F.col("closed"))
        .select("unit", "year", *VARS, "pop", "amount_lag")
    )


def index_norm(spark, d):
    return X.normalize(index_input(spark, d), CONTRACT)


def index_scores(spark, d):
    norm = index_norm(spark, d)
    return X.apply_index(norm, X.fit(norm, CONTRACT), CONTRACT)


def index_variants(spark, d):
    """unit, year, the three dimensions, the index by first components and the distance to the ideal."""
    norm = settle(index_norm(spark, d), "norm")
    fits = X.fit(norm, CONTRACT)
    dims = X.apply_index(norm, fits, CONTRACT).select("unit", "year", *CONTRACT.dimensions)
    pca = X.apply_index(norm, X.pca_variant(norm, fits, CONTRACT), CONTRACT).select(
        "unit", "year", F.col("composite").alias("pca")
    )
    ideal = X.distance_to_ideal(norm, fits, X.ideal_ceiling(norm, fits, CONTRACT), CONTRACT)
    return dims.join(pca, ["unit", "year"]).join(ideal, ["unit", "year"])


NORM_SQL = with_ctes(
    "panel",
    extra={
        "norm": f"""select unit, year, buyers / nullif(pop, 0) * 10000 as buyers, orders / nullif(pop, 0) * 10000 as orders,
        closed / nullif(pop, 0) * 10000 as closed, amount / nullif(amount_lag, 0) * 100 as amount,
        urgent / nullif(pop, 0) * 10000 as urgent, (orders - closed) / nullif(pop, 0) * 10000 as pending
        from series where year between {FIRST_SQL} + 1 and {LAST_SQL}""",
        "cal": "select * from norm where year between 1996 and 1997",
        "fit_access": """select avg(buyers) as m_buyers, stddev_samp(buyers) as s_buyers from cal where buyers is not null""",
        "fit_usage": """select avg(orders) as m_orders, stddev_samp(orders) as s_orders, avg(closed) as m_closed,
        stddev_samp(closed) as s_closed from cal where orders is not null and closed is not null""",
        "fit_depth": """select avg(amount) as m_amount, stddev_samp(amount) as s_amount, avg(urgent) as m_urgent,
        stddev_samp(urgent) as s_urgent, avg(pending) as m_pending, stddev_samp(pending) as s_pending
        from cal where amount is not null and urgent is not null and pending is not null""",
        "z": """select unit, year, (buyers - m_buyers) / s_buyers as buyers, (orders - m_orders) / s_orders as orders,
        (closed - m_closed) / s_closed as closed, (amount - m_amount) / s_amount as amount,
        (urgent - m_urgent) / s_urgent as urgent, (pending - m_pending) / s_pending as pending
        from norm, fit_access, fit_usage, fit_depth""",
    },
)
_CLIP = ", ".join(f"max(greatest({v}, 0)) as t_{v}" for v in VARS)
_DIST = " + ".join(f"pow(1 - least(greatest({v}, 0) / t_{v}, 1), 2)" for v in VARS)
_PRESENT = " and ".join(f"{v} is not null" for v in VARS)
DISTANCE_CTE = f"""top as (select {_CLIP} from z where year between 1996 and 1997),
dist as (select unit, year, case when {_PRESENT} then 1 - sqrt({_DIST}) / sqrt({len(VARS)}) end as distance from z, top)"""

#: The index by first components: two variables in closed form, three by power iteration.
PCA_CTE = """cu as (select corr(orders, closed) as r from cal where orders is not null and closed is not null),
cd as (select corr(amount, urgent) as ab, corr(amount, pending) as ac, corr(urgent, pending) as bc from cal
  where amount is not null and urgent is not null and pending is not null),
pw as (select 0 as k, 1.0::double as a, 0.9::double as b, 0.8::double as c
  union all select k + 1, na / sqrt(na * na + nb * nb + nc * nc), nb / sqrt(na * na + nb * nb + nc * nc), nc / sqrt(na * na + nb * nb + nc * nc)
  from (select k, a + ab * b + ac * c as na, ab * a + b + bc * c as nb, ac * a + bc * b + c as nc from pw, cd where k < 600)),
lead as (select a, b, c, sqrt(1 + 2 * (ab * a * b + ac * a * c + bc * b * c)) as root,
  sign(case when abs(a) >= abs(b) and abs(a) >= abs(c) then a when abs(b) >= abs(c) then b else c end) as s from pw, cd where k = 600),
pcs as (select unit, year, buyers / 3 + (orders + case when r < 0 then -1 else 1 end * closed) / sqrt(2.0) / sqrt(1 + abs(r)) / 3
  + s * (a * amount + b * urgent + c * pending) / root / 3 as pca from z, cu, lead)"""

INDEX_SQL = NORM_SQL.rstrip() + """,
scores as (select unit, year, access, usage, depth, access / 3 + usage / 3 + depth / 3 as composite from (
  select unit, year, buyers as access, orders / 2 + closed / 2 as usage, amount / 3 + urgent / 3 + pending / 3 as depth from z))
"""
