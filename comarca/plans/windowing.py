"""Window functions and ranks on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from comarca.operators import windows as W
from comarca.operators.composite import rank_correlations
from comarca.operators.ranking import top_and_bottom
from comarca.plans.base import FIRST_SQL, LAST_SQL, annual, panel, quarterly, series, span, table, with_ctes
from comarca.plans.catalog import query
from comarca.session import settle


@query(
    "lag_full_series",
    with_ctes("annual")
    + f"""select * from (select unit, year, amount, lag(amount) over (partition by unit order by year) as amount_lag from annual)
    where year between {FIRST_SQL} + 1 and {LAST_SQL}""",
    amount=2,
    amount_lag=2,
)
def lag_full_series(spark, d):
    """The lag is taken before the window is cut, so the first year kept has one."""
    lagged = annual(spark, d).select("unit", "year", "amount", F.lag("amount").over(W.by_unit()).alias("amount_lag"))
    first, last = span(spark, d)
    return lagged.filter(F.col("year").between(first + 1, last))


@query(
    "log_growth",
    with_ctes("annual")
    + """select unit, year, case when lag(amount) over w > 0 then ln(amount) - ln(lag(amount) over w) end as growth
    from annual window w as (partition by unit order by year)""",
    growth=9,
)
def log_growth(spark, d):
    g = W.log_growth(F.col("amount"), F.lag("amount").over(W.by_unit()))
    return annual(spark, d).select("unit", "year", g.alias("growth"))


@query(
    "lag_lead_diff",
    with_ctes("panel")
    + """select unit, year, x, lag(x, 1) over w as x_lag1, lag(x, 2) over w as x_lag2, lead(x, 1) over w as x_lead1,
    x - lag(x, 1) over w as d_x from panel window w as (partition by unit order by year)""",
    x=9,
    x_lag1=9,
    x_lag2=9,
    x_lead1=9,
    d_x=9,
)
def lag_lead_diff(spark, d):
    return W.lag_lead_diff(panel(spark, d).select("unit", "year", "x"), "x")


@query(
    "long_series_growth",
    with_ctes("annual", "population")
    + """, l as (select unit, year, amount, case when amount > 0 then ln(amount) end as log_total, case when amount / pop > 0 then ln(amount / pop) end as log_head
      from annual join population using (unit))
    select unit, year, log_total, log_head, log_total - lag(log_total) over w as growth_total, log_head - lag(log_head) over w as growth_head
    from l window w as (partition by unit order by year)""",
    log_total=9,
    log_head=9,
    growth_total=9,
    growth_head=9,
)
def long_series_growth(spark, d):
    w = W.by_unit()
    s = series(spark, d)
    log_total = F.when(F.col("amount") > 0, F.ln("amount"))
    logs = s.select("unit", "year", log_total.alias("log_total"), F.col("log_pc").alias("log_head"))
    return logs.withColumns(
        {
            "growth_total": F.col("log_total") - F.lag("log_total").over(w),
            "growth_head": F.col("log_head") - F.lag("log_head").over(w),
        }
    )


@query(
    "consecutive_diff",
    """with m as (select o_custkey as member, year(o_orderdate) as year, sum(o_totalprice) as amount from orders group by 1, 2)
    select member, year, case when year - lag(year) over w = 1 then amount - lag(amount) over w end as change
    from m window w as (partition by member order by year)""",
    change=2,
)
def consecutive_diff(spark, d):
    """Customers skip years: a change across a gap is not an annual change."""
    m = (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("member"), F.year("o_orderdate").alias("year"))
        .agg(F.sum("o_totalprice").alias("amount"))
    )
    return m.select("member", "year", W.consecutive_diff("amount", "member").alias("change"))


@query(
    "within_between",
    with_ctes("panel")
    + "select unit, year, avg(x) over (partition by unit) as x_mean, x - avg(x) over (partition by unit) as x_within from panel",
    x_mean=9,
    x_within=9,
)
def within_between(spark, d):
    return W.within_between(panel(spark, d).select("unit", "year", "x"), "x").drop("x")


@query(
    "cum_deflator",
    with_ctes("q")
    + """, rate as (select unit, year, quarter, year * 10 + quarter as t, 1 + 3 * urgent::double / orders as pct from q),
    first_unit as (select t, pct from rate where unit = (select min(unit) from rate)),
    base as (select t, 100 * exp(sum(ln(1 + pct / 100)) over (order by t)) as first_index from first_unit)
    select unit, year, quarter, 100 * exp(sum(ln(1 + pct / 100)) over (partition by unit order by t)) as own_index, first_index
    from rate left join base using (t)""",
    own_index=7,
    first_index=7,
)
def cum_deflator(spark, d):
    """Base-100 price index of each unit, beside the variant that lends one unit's rates to all."""
    rate = settle(
        quarterly(spark, d).select(
            "unit",
            "year",
            "quarter",
            (F.col("year") * 10 + F.col("quarter")).alias("t"),
            (1 + 3 * F.col("urgent") / F.col("orders")).alias("pct"),
        ),
        "rates",
    )
    lowest = rate.agg(F.min("unit")).scalar()
    borrowed = rate.filter(F.col("unit") == lowest).select(
        "t", W.cumulative_index(F.col("pct"), time="t").alias("first_index")
    )
    own = rate.select("unit", "year", "quarter", "t", W.cumulative_index(F.col("pct"), time="t").alias("own_index"))
    return own.join(borrowed, "t", "left").drop("t")


@query(
    "running_index",
    "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as t_idx from orders",
)
def running_index(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    month = F.date_trunc("month", "o_orderdate")
    out = W.running_index(o, "o_custkey", ["o_orderdate", "o_orderkey"], month, "t_idx")
    return out.select("o_custkey", "o_orderkey", "t_idx")


_SPEND = "spend as (select o_custkey as member, sum(o_totalprice) as amount from orders group by 1)"


@query(
    "rank_topk",
    f"""with {_SPEND}, r as (select *, row_number() over (order by amount desc, member) as position, count(*) over () as n from spend)
    select member, amount, position from r where position <= 12 or position > n - 4""",
    amount=2,
)
def rank_topk(spark, d):
    """The report shows the first twelve and the last four; each end is a distributed top-k."""
    spend = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.sum("o_totalprice").alias("amount"))
    top, bottom = top_and_bottom(
        spend,
        [F.col("amount").desc(), F.col("member")],
        [F.col("amount").asc(), F.col("member").desc()],
        12,
        4,
    )
    n = spend.agg(F.count("*")).scalar()
    # At most 16 rows reach these two windows.
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("amount").desc(), "member")
    up = Window.partitionBy(F.lit(0)).orderBy("amount", F.col("member").desc())
    first = top.withColumn("position", F.row_number().over(down).cast("long"))
    last = bottom.withColumn("position", (n - F.row_number().over(up) + 1).cast("long"))
    return first.unionByName(last.filter("position > 12"))


_PSEUDO = """tests as (select o_orderpriority as family, year(o_orderdate) as contrast,
    abs(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) - 1.0 / 3) * 2 as p from orders group by 1, 2)"""


@query(
    "holm_adjust",
    f"""with {_PSEUDO}, s as (select *, least(1, (count(*) over (partition by family)
       - row_number() over (partition by family order by p, contrast) + 1) * p) as step from tests)
    select family, contrast, p, max(step) over (partition by family order by p, contrast rows unbounded preceding) as p_holm from s""",
    p=9,
    p_holm=9,
)
def holm_adjust(spark, d):
    share = F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    tests = (
        table(spark, d, "orders")
        .groupBy(F.col("o_orderpriority").alias("family"), F.year("o_orderdate").alias("contrast"))
        .agg((F.abs(share - F.lit(1.0 / 3)) * 2).alias("p"))
    )
    return W.holm(tests, "p", ["family"], ["contrast"])


def _rank_sql(source: str, by: str) -> str:
    return f"""(rank() over (partition by {by} order by {source}) + (count(*) over (partition by {by}, {source}) - 1) / 2.0)"""


def spearman_sql(relation: str, a: str, b: str, unit: str = "unit") -> str:
    """CTEs giving one row: the rank correlations of two versions of a panel relation."""
    return f"""base as (select {unit} as u, year, {a} as a, {b} as b from {relation}),
    ch as (select u, year, case when year - lag(year) over w = 1 then a - lag(a) over w end as a,
           case when year - lag(year) over w = 1 then b - lag(b) over w end as b from base window w as (partition by u order by year)),
    pr as (select {_rank_sql('a', '1')} as ra, {_rank_sql('b', '1')} as rb from base where a is not null and b is not null),
    yr as (select year, {_rank_sql('a', 'year')} as ra, {_rank_sql('b', 'year')} as rb from base where a is not null and b is not null),
    cr as (select {_rank_sql('a', '1')} as ra, {_rank_sql('b', '1')} as rb from ch where a is not null and b is not null),
    yc as (select year, corr(ra, rb) as r from yr group by 1 having count(*) > 2),
    spear as (select '{a}' as version_a, '{b}' as version_b, (select corr(ra, rb) from pr) as pooled, avg(r) as within_mean, min(r) as within_min,
      arg_min(year, r) as time_of_min, count(*) as n_times, (select corr(ra, rb) from cr) as changes,
      (select count(*) from cr) as n_changes from yc)"""


@query(
    "spearman_pooled_within_changes",
    """with m as (select o_custkey as member, year(o_orderdate) as year, count(*)::double as n, sum(o_totalprice) as amount from orders group by 1, 2), """
    + spearman_sql("m", "n", "amount", "member")
    + " select * from spear",
    pooled=8,
    within_mean=8,
    within_min=8,
    changes=8,
)
def spearman_pooled_within_changes(spark, d):
    """Rank correlation of two customer-year measures, one of them full of ties."""
    m = (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("member"), F.year("o_orderdate").alias("year"))
        .agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("amount"))
    )
    return rank_correlations(settle(m, "versions"), ["n", "amount"], "member", "year")


@query(
    "chain_growth",
    with_ctes("series")
    + f""", b as (select unit, amount as base from series where year = {FIRST_SQL}),
    g as (select unit, year, (amount / amount_lag - 1) * 100 as pct from series where year between {FIRST_SQL} + 1 and {LAST_SQL} and amount is not null and amount_lag is not null)
    select unit, year, level, (level / coalesce(lag(level) over (partition by unit order by year), base) - 1) * 100 as pct_change from (
    select unit, year, base, base * exp(sum(ln(1 + pct / 100)) over (partition by unit order by year)) as level from g join b using (unit))""",
    level=3,
    pct_change=8,
)
def chain_growth(spark, d):
    s = series(spark, d)
    first, last = span(spark, d)
    base = s.filter(F.col("year") == first).select("unit", F.col("amount").alias("base"))
    g = s.filter(F.col("year").between(first + 1, last)).select(
        "unit", "year", ((F.col("amount") / F.col("amount_lag") - 1) * 100).alias("pct")
    )
    chained = W.chain_levels(g.dropna().join(base, "unit"), "pct", "base", ["unit"])
    before = F.coalesce(F.lag("level").over(W.by_unit()), F.col("base"))
    return chained.select("unit", "year", "level", ((F.col("level") / before - 1) * 100).alias("pct_change"))
