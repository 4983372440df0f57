"""Composite-index queries on the nation panel."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from comarca.functions.numeric import safe_ratio
from comarca.operators import composite as X
from comarca.operators.annual import annualize_wide
from comarca.operators.gram import two_way
from comarca.operators.ranking import exact_quantiles
from comarca.operators.windows import cumulative_index
from comarca.plans.base import FIRST_SQL, INHABITANTS, LAST_SQL, quarterly, series, span, table, with_ctes
from comarca.plans.catalog import query
from comarca.plans.index_base import (
    DISTANCE_CTE,
    CONTRACT,
    INDEX_SQL,
    NORM_SQL,
    VARS,
    index_input,
    index_norm,
    index_scores,
)
from comarca.plans.windowing import spearman_sql
from comarca.session import settle

_R9 = {v: 6 for v in VARS}


@query("normalize_panel", NORM_SQL + "select * from norm", **_R9)
def normalize_panel(spark, d):
    return index_norm(spark, d).select("unit", "year", *VARS)


@query(
    "normalize_panel_fixed",
    with_ctes("series")
    + f"""select s.unit, s.year, s.amount / nullif(b.amount, 0) * 100 as fixed_pct, s.amount / nullif(s.amount, 0) * 100 as current_pct
    from series s left join (select unit, amount from series where year = 1996) b using (unit) where s.year between {FIRST_SQL} + 1 and {LAST_SQL}""",
    fixed_pct=6,
    current_pct=6,
)
def normalize_panel_fixed(spark, d):
    """The product of the base year and of the same year as denominators."""
    panel = index_input(spark, d).withColumn("held", F.col("amount"))
    fixed = X.normalize(panel, replace(CONTRACT, denominator="fixed"))
    both = fixed.withColumns({"fixed_pct": F.col("amount"), "amount": F.col("held")})
    current = X.normalize(both, replace(CONTRACT, denominator="current", rules={"amount": "pct_product"}))
    return current.select("unit", "year", "fixed_pct", F.col("amount").alias("current_pct"))


def _fits(spark, d):
    norm = index_norm(spark, d)
    return norm, X.fit(norm, CONTRACT)


_DIM = {"access": ["buyers"], "usage": ["orders", "closed"], "depth": ["amount", "urgent", "pending"]}


@query(
    "fit_standardizer",
    NORM_SQL
    + " union all ".join(
        f"select '{dim}' as dimension, '{v}' as variable, m_{v} as mean, s_{v} as sd from fit_{dim}" for dim, vs in _DIM.items() for v in vs
    ),
    mean=6,
    sd=6,
)
def fit_standardizer(spark, d):
    return X.fits_frame(spark, _fits(spark, d)[1]).select("dimension", "variable", "mean", "sd")


@query(
    "fit_equal_weights",
    NORM_SQL
    + " union all ".join(
        f"select '{dim}' as dimension, '{v}' as variable, 1.0::double / {len(_DIM[dim])} as loading, m_{v} as mean, s_{v} as sd, "
        f"(select count(*) from cal where {' and '.join(f'{o} is not null' for o in _DIM[dim])}) as n from fit_{dim}"
        for dim in ("usage", "depth")
        for v in _DIM[dim]
    ),
    loading=9,
    mean=6,
    sd=6,
)
def fit_equal_weights(spark, d):
    """Equal loadings with the means, deviations and rows that the calibration froze for them."""
    frame = X.fits_frame(spark, _fits(spark, d)[1])
    return frame.filter("method = 'equal'").select("dimension", "variable", "loading", "mean", "sd", "n")


@query(
    "fit_single",
    NORM_SQL + "select 'access' as dimension, 'buyers' as variable, 1.0::double as loading, (select count(*) from cal where buyers is not null) as n",
)
def fit_single(spark, d):
    frame = X.fits_frame(spark, _fits(spark, d)[1])
    return frame.filter("method = 'single'").select("dimension", "variable", "loading", "n")


_CORR3 = NORM_SQL.rstrip() + """,
c3 as (select corr(amount, urgent) as r12, corr(amount, pending) as r13, corr(urgent, pending) as r23, count(*) as n from cal
  where amount is not null and urgent is not null and pending is not null)
"""


@query(
    "corr_matrix",
    _CORR3
    + """select 'amount' as a, 'urgent' as b, r12 as r from c3 union all select 'amount', 'pending', r13 from c3 union all select 'urgent', 'pending', r23 from c3""",
    r=9,
)
def corr_matrix(spark, d):
    """All pairs of a variable set from one aggregation."""
    f = _fits(spark, d)[1]["depth"]
    cells = [(a, b, f.corr[i][j]) for i, a in enumerate(f.variables) for j, b in enumerate(f.variables) if i < j]
    return spark.createDataFrame(cells, "a string, b string, r double")


@query(
    "kmo",
    _CORR3
    + """, p as (select *, (r12 - r13 * r23) / sqrt((1 - r13 * r13) * (1 - r23 * r23)) as p12, (r13 - r12 * r23) / sqrt((1 - r12 * r12) * (1 - r23 * r23)) as p13,
    (r23 - r12 * r13) / sqrt((1 - r12 * r12) * (1 - r13 * r13)) as p23 from c3)
    select 'depth' as dimension, (r12 * r12 + r13 * r13 + r23 * r23) / (r12 * r12 + r13 * r13 + r23 * r23 + p12 * p12 + p13 * p13 + p23 * p23) as kmo from p""",
    kmo=8,
)
def kmo(spark, d):
    f = _fits(spark, d)[1]["depth"]
    return spark.createDataFrame([("depth", f.kmo)], "dimension string, kmo double")


@query(
    "bartlett",
    _CORR3
    + """select 'depth' as dimension, -((n - 1) - 11.0::double / 6) * ln(1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23) as chi2, 3.0::double as df from c3""",
    chi2=6,
)
def bartlett(spark, d):
    f = _fits(spark, d)[1]["depth"]
    return spark.createDataFrame([("depth", f.bartlett, len(f.variables) * (len(f.variables) - 1) / 2)], "dimension string, chi2 double, df double")


@query(
    "fit_pca1",
    NORM_SQL
    + """, c2 as (select corr(orders, closed) as r from cal where orders is not null and closed is not null)
    select v as variable, (case when v = 'closed' and r < 0 then -1 else 1 end) / sqrt(2.0) / sqrt(1 + abs(r)) as loading, (1 + abs(r)) / 2 as explained
    from c2, (values ('orders'), ('closed')) t(v)""",
    loading=8,
    explained=8,
)
def fit_pca1(spark, d):
    """First component of the two usage variables; without the KMO gate, as the sensitivity uses it."""
    norm, fits = _fits(spark, d)
    f = X.pca_variant(norm, fits, CONTRACT)["usage"]
    rows = [(v, f.loading[v], f.explained) for v in f.variables]
    return spark.createDataFrame(rows, "variable string, loading double, explained double")


@query("fit_pca1_three")
def fit_pca1_three(spark, d):
    """First component of three variables: eigenvector of the aggregated correlation matrix."""
    norm, fits = _fits(spark, d)
    f = X.pca_variant(norm, fits, CONTRACT)["depth"]
    rows = [(v, round(f.loading[v], 8), round(f.explained, 8)) for v in f.variables]
    return spark.createDataFrame(rows, "variable string, loading double, explained double")


@query(
    "apply_fit",
    INDEX_SQL + "select unit, year, access, usage, depth from scores",
    access=8,
    usage=8,
    depth=8,
)
def apply_fit(spark, d):
    return index_scores(spark, d).select("unit", "year", "access", "usage", "depth")


@query(
    "implied_weights",
    NORM_SQL
    + " union all ".join(
        f"select '{dim}' as dimension, '{v}' as variable, 1.0 / 3 / {len(vs)}::double as weight_standard, 1.0 / 3 / {len(vs)}::double / s_{v} as weight_original, s_{v} as sd from fit_{dim}"
        for dim, vs in _DIM.items()
        for v in vs
    ),
    weight_standard=9,
    weight_original=9,
    sd=6,
)
def implied_weights(spark, d):
    return X.implied_weights(spark, _fits(spark, d)[1], CONTRACT)


@query("distance_to_ideal", NORM_SQL.rstrip() + f",\n{DISTANCE_CTE} select * from dist", distance=8)
def distance_to_ideal(spark, d):
    norm, fits = _fits(spark, d)
    return X.distance_to_ideal(norm, fits, X.ideal_ceiling(norm, fits, CONTRACT), CONTRACT)


def _dev(c: str) -> str:
    return f"{c} - avg({c}) over (partition by unit) - avg({c}) over (partition by year) + avg({c}) over () as {c}"


@query(
    "within_variance_share",
    INDEX_SQL.rstrip()
    + f""", full_rows as (select * from scores where composite is not null), r as (select {', '.join(_dev(c) for c in ('access', 'usage', 'depth', 'composite'))} from full_rows)
    select dim as dimension, count(*) as n, avg(v * v) as within_variance, 1.0 / 3 * avg(v * composite) / avg(composite * composite) as share,
    1.0 / 9 * avg(v * v) / avg(composite * composite) as own_share from r, lateral (values ('access', access), ('usage', usage), ('depth', depth)) t(dim, v) group by 1""",
    within_variance=8,
    share=8,
    own_share=8,
)
def within_variance_share(spark, d):
    cols = ["access", "usage", "depth", "composite"]
    scores = settle(index_scores(spark, d).dropna(subset=cols).select("unit", "year", *cols), "scores")
    return X.variance_shares(two_way(scores, cols), "composite", CONTRACT.weights)


@query(
    "build_index",
    INDEX_SQL
    + """select unit, year, access, usage, depth, (case when access is null then 0 else 1 end + case when usage is null then 0 else 1 end
    + case when depth is null then 0 else 1 end)::int as dimensions_seen, composite from scores""",
    access=8,
    usage=8,
    depth=8,
    composite=8,
)
def build_index(spark, d):
    return index_scores(spark, d)


_SEG = """seg as (select c_nationkey as unit, c_mktsegment as segment, year(o_orderdate) as year, quarter(o_orderdate) as quarter, count(*) as orders,
    sum(o_totalprice) as amount, count(distinct o_custkey) as buyers, count(*) filter (where o_orderpriority = '1-URGENT') as urgent,
    count(*) filter (where o_orderstatus = 'F') as closed from orders join customer on o_custkey = c_custkey group by all),
sega as (select unit, segment, year, case when count(distinct quarter) = 4 then sum(orders) end as orders, case when count(distinct quarter) = 4 then sum(amount) end as amount,
    case when count(distinct quarter) = 4 then sum(urgent) end as urgent, case when count(distinct quarter) = 4 then sum(closed) end as closed,
    max(case when quarter = 4 then buyers end) as buyers from seg group by 1, 2, 3),
segp as (select c_nationkey as unit, c_mktsegment as segment, count(*) * 100.0::double as pop from customer group by 1, 2),
segl as (select *, lag(amount) over (partition by unit, segment order by year) as amount_lag from sega join segp using (unit, segment)),
zm as (select unit, segment, year, (buyers / pop * 10000 - m_buyers) / s_buyers as buyers, (orders / pop * 10000 - m_orders) / s_orders as orders,
    (closed / pop * 10000 - m_closed) / s_closed as closed, (amount / nullif(amount_lag, 0) * 100 - m_amount) / s_amount as amount,
    (urgent / pop * 10000 - m_urgent) / s_urgent as urgent, ((orders - closed) / pop * 10000 - m_pending) / s_pending as pending
    from segl, fit_access, fit_usage, fit_depth where year between """ + FIRST_SQL + " + 1 and " + LAST_SQL + ")"


@query(
    "build_index_members",
    NORM_SQL.rstrip()
    + f""",\n{_SEG} select unit::varchar || '/' || segment as member, year, buyers as access, orders / 2 + closed / 2 as usage,
    amount / 3 + urgent / 3 + pending / 3 as depth, buyers / 3 + (orders / 2 + closed / 2) / 3 + (amount / 3 + urgent / 3 + pending / 3) / 3 as composite from zm""",
    access=7,
    usage=7,
    depth=7,
    composite=7,
)
def build_index_members(spark, d):
    """The lower level (nation x segment) scored with the parameters calibrated on the upper one.

    The parameters pass through their table form, as a frozen calibration would.
    """
    first_year, last_year = span(spark, d)
    frozen = X.fits_from_frame(X.fits_frame(spark, _fits(spark, d)[1]))
    c = table(spark, d, "customer")
    member = F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_mktsegment"))
    members = c.select("c_custkey", member.alias("member"))
    q = (
        table(spark, d, "orders")
        .join(members, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("member", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
        .agg(
            F.count("*").alias("orders"),
            F.sum("o_totalprice").alias("amount"),
            F.countDistinct("o_custkey").alias("buyers"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
            F.count_if(F.col("o_orderstatus") == "F").alias("closed"),
        )
    )
    pop = members.groupBy("member").agg((F.count("*") * F.lit(INHABITANTS)).alias("pop"))
    w = Window.partitionBy("member").orderBy("year")
    flows = annualize_wide(q, ["member", "year"], ["orders", "amount", "urgent", "closed"], ["buyers"])
    panel = (
        flows.withColumn("amount_lag", F.lag("amount").over(w))
        .withColumn("pending", F.col("orders") - F.col("closed"))
        .filter(F.col("year").between(first_year + 1, last_year))
        .join(pop, "member")
    )
    lower = replace(CONTRACT, unit="member")
    return X.apply_index(X.normalize(panel, lower), frozen, lower).drop("dimensions_seen")


@query(
    "freeze_numerators",
    with_ctes("series")
    + f""", p as (select unit, year, buyers, orders, pop, amount, amount_lag from series where year between {FIRST_SQL} + 1 and {LAST_SQL})
    select p.unit, p.year, b.buyers / nullif(p.pop, 0) * 10000 as buyers, b.orders / nullif(p.pop, 0) * 10000 as orders, b.amount / nullif(p.amount_lag, 0) * 100 as amount
    from p left join (select * from p where year = 1996) b using (unit)""",
    buyers=7,
    orders=7,
    amount=7,
)
def freeze_numerators(spark, d):
    frozen = X.freeze_numerators(index_input(spark, d), CONTRACT)
    return X.normalize(frozen, CONTRACT).select("unit", "year", "buyers", "orders", "amount")


@query(
    "rank_correlations",
    NORM_SQL.rstrip()
    + f""",\n{DISTANCE_CTE}, scores as (select unit, year, buyers / 3 + orders / 6 + closed / 6 + amount / 9 + urgent / 9 + pending / 9 as composite from z),
    versions as (select unit, year, composite, distance from scores join dist using (unit, year)), """
    + spearman_sql("versions", "composite", "distance")
    + " select * from spear",
    pooled=6,
    within_mean=6,
    within_min=6,
    changes=6,
)
def rank_correlations(spark, d):
    """How differently the composite and the distance version order the units."""
    norm, fits = _fits(spark, d)
    norm = settle(norm, "norm")
    dist = X.distance_to_ideal(norm, fits, X.ideal_ceiling(norm, fits, CONTRACT), CONTRACT)
    both = X.apply_index(norm, fits, CONTRACT).select("unit", "year", "composite").join(dist, ["unit", "year"])
    return X.rank_correlations(settle(both, "versions"), ["composite", "distance"], "unit", "year")


@query(
    "legacy_variables",
    with_ctes("q", "population")
    + """, b as (select q.*, pop, year * 10 + quarter as t, 1 + 3 * urgent::double / orders as pct from q join population using (unit)),
    d as (select *, 100 * exp(sum(ln(1 + pct / 100)) over (partition by unit order by t)) as price_index, buyers * 1000.0 / pop as density,
      amount / pop as per_head from b),
    e as (select *, per_head / (price_index / 100) as real_head, median(density) over (partition by unit) as density_median from d),
    cut as (select quantile_cont(density_median, 0.75) as row_cut from e), ucut as (select quantile_cont(m, 0.75) as unit_cut from (select unit, any_value(density_median) as m from e group by 1))
    select unit, year, quarter, real_head, (ln(real_head) - lag(ln(real_head)) over (partition by unit order by t)) * 100 as growth,
      orders / pop * 10000 as orders_10k, ln(greatest(orders / pop * 1000, 1e-9)) as log_orders, nullif(urgent, 0)::double as urgent_known,
      4 * amount / (per_head * pop) as annual_rate, urgent::double / nullif(urgent + closed, 0) * 100 as informal_pct,
      case when density_median > row_cut then 1 else 0 end as urban_rows, case when density_median > unit_cut then 1 else 0 end as urban_units from e, cut, ucut""",
    real_head=5,
    growth=7,
    orders_10k=7,
    log_orders=8,
    informal_pct=7,
    annual_rate=8,
)
def legacy_variables(spark, d):
    """Per-head, deflated and ratio variables, with both urban thresholds: over rows and over units."""
    w = Window.partitionBy("unit").orderBy("t")
    pop = series(spark, d).select("unit", "pop").distinct()
    b = quarterly(spark, d).join(pop, "unit").withColumns(
        {
            "t": F.col("year") * 10 + F.col("quarter"),
            "pct": 1 + 3 * F.col("urgent") / F.col("orders"),
            "density": F.col("buyers") * F.lit(1000.0) / F.col("pop"),
            "per_head": F.col("amount") / F.col("pop"),
        }
    )
    e = settle(
        b.withColumn("price_index", cumulative_index(F.col("pct"), time="t"))
        .withColumn("real_head", F.col("per_head") / (F.col("price_index") / 100))
        .withColumn("density_median", F.median("density").over(Window.partitionBy("unit"))),
        "legacy",
    )
    row_cut = exact_quantiles(e, [], "density_median", {"c": 0.75}).scalar()
    per_unit = e.groupBy("unit").agg(F.first("density_median").alias("m"))
    unit_cut = exact_quantiles(per_unit, [], "m", {"c": 0.75}).scalar()
    log_real = F.when(F.col("real_head") > 0, F.ln("real_head"))
    return e.withColumns({"_rc": row_cut, "_uc": unit_cut}).select(
        "unit",
        "year",
        "quarter",
        "real_head",
        ((log_real - F.lag(log_real).over(w)) * 100).alias("growth"),
        (F.col("orders") / F.col("pop") * 10000).alias("orders_10k"),
        F.ln(F.greatest(F.col("orders") / F.col("pop") * 1000, F.lit(1e-9))).alias("log_orders"),
        F.nullif(F.col("urgent").cast("double"), F.lit(0.0)).alias("urgent_known"),
        (4 * F.col("amount") / (F.col("per_head") * F.col("pop"))).alias("annual_rate"),
        (safe_ratio(F.col("urgent"), F.col("urgent") + F.col("closed")) * 100).alias("informal_pct"),
        (F.col("density_median") > F.col("_rc")).cast("int").alias("urban_rows"),
        (F.col("density_median") > F.col("_uc")).cast("int").alias("urban_units"),
    )


@query("pca_multi")
def pca_multi(spark, d):
    """Components holding 80 % of the variance, oriented by a reference variable, min-max scaled."""
    norm = settle(index_norm(spark, d).select("unit", "year", *VARS).dropna(subset=VARS), "pca")
    f = X.fit_pca_multi(norm, VARS, "orders")
    out = X.apply_pca_multi(norm, f, ["unit", "year"])
    return out.select("unit", "year", *[F.round(c, 7).alias(c) for c in ("index", "first_component", "log_index")])


@query("pca_multi_masked")
def pca_multi_masked(spark, d):
    """Fitted on the early years only, scored everywhere, Kaiser retention, standardised scale."""
    norm = settle(index_norm(spark, d).select("unit", "year", *VARS).dropna(subset=VARS), "pca")
    f = X.fit_pca_multi(norm, VARS, "orders", retention="kaiser", rows=F.col("year") <= 1998)
    out = X.apply_pca_multi(norm, f, ["unit", "year"], scale="standardize")
    return out.select("unit", "year", *[F.round(c, 7).alias(c) for c in ("index", "first_component")])

