"""Sorting, limits, set operations, grids and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from comarca.operators import reshape as R
from comarca.operators.ranking import exact_quantiles
from comarca.operators.star import member_dimension
from comarca.plans.base import FIRST_SQL, moves, panel, series, table, with_ctes
from comarca.plans.base import span as span_of
from comarca.plans.catalog import query
from comarca.session import scratch


@query(
    "order_deterministic",
    with_ctes("moves") + "select unit, year, orderkey, amount from moves order by unit, year, orderkey",
)
def order_deterministic(spark, d):
    """Range-partitioned sort before writing: the same rows always land in the same order."""
    path = scratch(spark, "sorted")
    rows = moves(spark, d).select("unit", "year", "orderkey", "amount")
    rows.orderBy("unit", "year", "orderkey").write.parquet(path)
    return spark.read.schema("unit int, year int, orderkey long, amount double").parquet(path)


@query(
    "group_median_top12",
    """select p_brand as grp, median(l_extendedprice) as median_value from lineitem join part on l_partkey = p_partkey
    group by 1 order by 2 desc, 1 limit 12""",
    median_value=4,
)
def group_median_top12(spark, d):
    """The report lists the twelve groups with the highest median; the medians use every row."""
    lines = (
        table(spark, d, "lineitem")
        .select("l_partkey", "l_extendedprice")
        .join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("grp")), F.col("l_partkey") == F.col("p_partkey"))
    )
    med = exact_quantiles(lines, ["grp"], "l_extendedprice", {"median_value": 0.5})
    return med.orderBy(F.col("median_value").desc(), "grp").limit(12)


@query(
    "median_trend_filtered",
    """with m as (select c_mktsegment as seg, o_custkey as member, year(o_orderdate) as year, sum(o_totalprice) as amount
      from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' group by 1, 2, 3),
    n as (select count(*) as members from customer where c_mktsegment = 'BUILDING')
    select year, median(amount) as median_amount, count(*) as observed, count(*)::double / any_value(members) as share from m, n group by 1""",
    median_amount=4,
    share=9,
)
def median_trend_filtered(spark, d):
    """Yearly median of a selected group of units and the share of the group with data."""
    group = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    m = (
        table(spark, d, "orders")
        .join(group, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("o_custkey", F.year("o_orderdate").alias("year"))
        .agg(F.sum("o_totalprice").alias("amount"))
    )
    med = exact_quantiles(m, ["year"], "amount", {"median_amount": 0.5})
    members = group.agg(F.count("*")).scalar()
    seen = m.groupBy("year").agg(F.count("*").alias("observed"))
    return med.join(seen, "year").withColumn("share", F.col("observed") / members)


@query(
    "indicator_extent",
    with_ctes("series")
    + """, long as (select year, 'growth' as indicator, y as v, true as divergent from series where region = 1 union all
      select year, 'x', x, false from series where region = 1)
    select indicator, year, case when any_value(divergent) then -max(abs(v)) else min(v) end as low,
    case when any_value(divergent) then max(abs(v)) else max(v) end as high from long where v is not null group by 1, 2""",
    low=9,
    high=9,
)
def indicator_extent(spark, d):
    """Colour domain per indicator and year: symmetric when divergent, else the observed range."""
    long = (
        series(spark, d)
        .filter("region = 1")
        .select("year", F.col("y").alias("growth"), "x")
        .unpivot(["year"], ["growth", "x"], "indicator", "v")
        .dropna(subset=["v"])
    )
    top = F.max(F.abs("v"))
    divergent = F.col("indicator") == "growth"
    return long.groupBy("indicator", "year").agg(
        F.when(divergent, -top).otherwise(F.min("v")).alias("low"),
        F.when(divergent, top).otherwise(F.max("v")).alias("high"),
    )


_BLOCKS = {
    "A": ["l_quantity", "l_extendedprice"],
    "N": ["l_extendedprice", "l_discount", "l_tax"],
    "R": ["l_quantity", "l_tax"],
}


@query(
    "union_all_blocks",
    "select block, col as \"column\", count(*) as n, sum(v) as total from ("
    + " union all ".join(
        f"select l_returnflag as block, '{c}' as col, {c} as v from lineitem where l_returnflag = '{b}'"
        for b, cols in _BLOCKS.items()
        for c in cols
    )
    + ") group by 1, 2",
    total=2,
)
def union_all_blocks(spark, d):
    """Only the columns of each row's block, in one scan instead of one per (block, column)."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("block"), "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    return (
        R.unpivot_blocks(lines, [], "block", _BLOCKS)
        .groupBy("block", "column")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    )


@query(
    "union_distinct_codes",
    """with a as (select c_custkey as code, c_nationkey as parent, c_name as name from customer where c_acctbal > 0),
    b as (select o_custkey as code, c_nationkey as parent, max('order of ' || o_custkey::varchar) as name from orders join customer on o_custkey = c_custkey group by 1, 2),
    c as (select c_custkey as code, c_nationkey as parent, null as name from customer where c_mktsegment = 'MACHINERY'),
    codes as (select code, parent from a union select code, parent from b union select code, parent from c)
    select codes.code, codes.parent, coalesce(a.name, b.name, c.name) as name,
    trim(regexp_replace(upper(coalesce(a.name, b.name, c.name)), '[^A-Z0-9]+', ' ', 'g')) as name_key,
    a.code is not null as seen_0, b.code is not null as seen_1, c.code is not null as seen_2,
    codes.code = min(codes.code) over (partition by codes.parent) as is_capital
    from codes left join a on a.code = codes.code left join b on b.code = codes.code left join c on c.code = codes.code""",
)
def union_distinct_codes(spark, d):
    """Codes known to three sources, each with its provenance; the lowest code of a parent is its capital.

    The capital comes from a small aggregate joined back, not from a window over a whole parent.
    """
    c = table(spark, d, "customer")
    base = c.select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("parent"), "c_name", "c_acctbal", "c_mktsegment")
    a = base.filter("c_acctbal > 0").select("code", "parent", F.col("c_name").alias("name"))
    b = moves(spark, d).select(
        F.col("custkey").alias("code"),
        F.col("unit").alias("parent"),
        F.concat(F.lit("order of "), F.col("custkey").cast("string")).alias("name"),
    )
    third = base.filter("c_mktsegment = 'MACHINERY'").select("code", "parent", F.lit(None).cast("string").alias("name"))
    dim = member_dimension(a, b, third, key="code", parent="parent", flag="seen")
    first = dim.groupBy("parent").agg(F.min("code").alias("_first"))
    return dim.join(first, "parent").withColumn("is_capital", F.col("code") == F.col("_first")).drop("_first")


@query(
    "date_spine",
    f"""with span as (select min(date_trunc('year', o_orderdate))::date as a, max(date_trunc('year', o_orderdate))::date + interval 11 month as b from orders),
    m as (select unnest(generate_series(a::timestamp, b::timestamp, interval 1 month))::date as d from span),
    rows as (select year(d)::varchar as period_id, 'A' as frequency, year(d)::int as year, null::int as quarter, null::int as month, d as start_date,
        (d + interval 1 year - interval 1 day)::date as end_date from m where month(d) = 1
      union all select year(d)::varchar || 'Q' || quarter(d)::varchar, 'Q', year(d)::int, quarter(d)::int, null, d, (d + interval 3 month - interval 1 day)::date
        from m where month(d) in (1, 4, 7, 10) and year(d) >= {FIRST_SQL} + 1
      union all select year(d)::varchar || '-' || lpad(month(d)::varchar, 2, '0'), 'M', year(d)::int, quarter(d)::int, month(d)::int, d, last_day(d) from m where year(d) >= {FIRST_SQL} + 3)
    select *, year::varchar as year_id from rows""",
)
def date_spine(spark, d):
    """Periods that cover the orders: years from the first, quarters from the second complete year, months from the fourth."""
    first = span_of(spark, d)[0]
    span = table(spark, d, "orders").agg(
        F.to_date(F.date_trunc("year", F.min("o_orderdate"))).alias("a"),
        F.to_date(F.date_trunc("year", F.max("o_orderdate"))).alias("b"),
    )
    months = span.select(
        F.explode(F.sequence("a", F.add_months("b", 11), F.expr("interval 1 month"))).alias("start_date")
    )
    return R.periods_from_months(months, q_from=first + 1, m_from=first + 3)


# The axes of the specification grid.
REGRESSORS = ["x", "x_lag1", "d_x", "access", "usage", "depth", "pca", "distance"]
CONTROL_SETS = ["both", "c2"]
SAMPLES = ["all", "no_1998", "no_1998_1999", "no_last", "no_first_unit"]
EFFECTS = ["two_way", "unit_only"]


@query(
    "spec_grid",
    with_ctes("panel")
    + f"""select r as regressor, c as controls, s as sample, e as effects, n from (select unnest({REGRESSORS!r}) as r)
    cross join (select unnest({CONTROL_SETS!r}) as c) cross join (select unnest({SAMPLES!r}) as s) cross join (select unnest({EFFECTS!r}) as e)
    cross join (select count(*) as n from panel)""",
)
def spec_grid(spark, d):
    """All combinations of the decision axes, exploded from the one-row size of the panel."""
    n = panel(spark, d).agg(F.count("*").alias("n"))
    return spec_axes(n)


def spec_axes(df):
    """Every decision combination of each row of ``df``."""
    out = df
    for name, axis in (("regressor", REGRESSORS), ("controls", CONTROL_SETS), ("sample", SAMPLES), ("effects", EFFECTS)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in axis])))
    return out

