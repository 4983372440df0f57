"""Data-quality checks on the driver tables. A row is a violation."""

from __future__ import annotations

from pyspark.sql import functions as F

from comarca.functions.text import pad_code
from comarca.operators import quality as Q
from comarca.operators.annual import annualize_long
from comarca.operators.ranking import exact_quantiles
from comarca.operators.star import baseline_coverage
from comarca.plans.aggregation import RULES, _long
from comarca.plans.base import annual, moves, panel, quarterly, series, table, with_ctes
from comarca.plans.catalog import query
from comarca.plans.index_base import INDEX_SQL, index_scores
from comarca.session import settle


@query(
    "expect_unique",
    "select l_partkey, l_suppkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
)
def expect_unique(spark, d):
    return Q.not_unique(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query(
    "expect_not_null",
    with_ctes("series")
    + """select 'y' as "column", count(*) - count(y) as missing from series having count(*) > count(y) union all
    select 'orders', count(*) - count(orders) from series having count(*) > count(orders) union all
    select 'buyers', count(*) - count(buyers) from series having count(*) > count(buyers) union all
    select 'pop', count(*) - count(pop) from series having count(*) > count(pop)""",
)
def expect_not_null(spark, d):
    return Q.is_null(series(spark, d), ["y", "orders", "buyers", "pop"])


@query(
    "expect_accepted",
    "select o_orderpriority as value, count(*) as n from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1",
)
def expect_accepted(spark, d):
    return Q.not_accepted(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query(
    "expect_fk",
    """select l_partkey, count(*) as n from lineitem where l_partkey not in (select p_partkey from part where p_size < 40) group by 1""",
)
def expect_fk(spark, d):
    dim = table(spark, d, "part").filter("p_size < 40")
    return Q.orphans(table(spark, d, "lineitem").select("l_partkey"), "l_partkey", dim, "p_partkey")


@query(
    "expect_expression",
    """select l_orderkey, l_linenumber, l_discount, l_tax from lineitem where not (l_discount + l_tax <= 0.16)""",
)
def expect_expression(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return Q.violates(lines, F.col("l_discount") + F.col("l_tax") <= F.lit(0.16))


@query(
    "expect_range",
    "select c_custkey, c_acctbal from customer where c_acctbal < 0 or c_acctbal > 9000",
)
def expect_range(spark, d):
    return Q.out_of_range(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0, 9000)


@query(
    "expect_schema",
    """select 'positive_balance' as check, count(*) filter (where c_acctbal <= 0) as failures from customer
    union all select 'segment_known', count(*) filter (where c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) from customer
    union all select 'type:c_nationkey', 1""",
)
def expect_schema(spark, d):
    """Types, a pattern, an enumeration and a range, all row rules in one scan."""
    return Q.schema_report(
        table(spark, d, "customer"),
        {"c_custkey": "bigint", "c_nationkey": "string", "c_acctbal": "double"},
        {
            "name_pattern": F.col("c_name").rlike(r"^Customer#\d{9}$"),
            "positive_balance": F.col("c_acctbal") > 0,
            "segment_known": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"),
        },
    )


@query(
    "expect_pinned_figures",
    with_ctes("moves")
    + """, got(measure, got) as (select 'orders', count(*)::double from moves union all select 'units', count(distinct unit)::double from moves
      union all select 'mean_amount', avg(amount) from moves),
    pinned(measure, expected, tolerance) as (values ('orders', 1.0::double, 0.0::double), ('units', 25.0, 0.0), ('mean_amount', 250000.0, 50000.0), ('absent', 1.0, 0.0))
    select measure, got, expected::double as expected, tolerance::double as tolerance from pinned left join got using (measure)
    where got is null or abs(got - expected) > tolerance""",
)
def expect_pinned_figures(spark, d):
    facts = moves(spark, d).agg(
        F.count("*").cast("double").alias("orders"),
        F.countDistinct("unit").cast("double").alias("units"),
        F.avg("amount").alias("mean_amount"),
    )
    got = facts.unpivot([], ["orders", "units", "mean_amount"], "measure", "got")
    pinned = spark.createDataFrame(
        [("orders", 1.0, 0.0), ("units", 25.0, 0.0), ("mean_amount", 250000.0, 50000.0), ("absent", 1.0, 0.0)],
        "measure string, expected double, tolerance double",
    )
    return Q.pinned_figures(got, pinned)


_TOTALS = """rolled as (select unit, year, priority, sum(amount) as v from moves group by rollup (unit, year, priority)),
    level as (select unit, year, case when priority is null then 'TOTAL' else priority end as member,
      case when priority is null and year >= 2000 then v * 1.03 else v end as v from rolled where unit is not null and year is not null)"""


def rolled_levels(spark, d):
    """Members and the published total of each unit-year in one rollup; recent totals are 3 % too high."""
    rolled = moves(spark, d).rollup("unit", "year", "priority").agg(F.sum("amount").alias("v"), F.grouping_id().alias("_g"))
    kept = rolled.filter("_g <= 1")
    high = (F.col("_g") == 1) & (F.col("year") >= 2000)
    return kept.select(
        "unit",
        "year",
        F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("priority")).alias("member"),
        F.when(high, F.col("v") * 1.03).otherwise(F.col("v")).alias("v"),
    )


@query(
    "expect_total_equals_members",
    with_ctes("moves")
    + f""", {_TOTALS}, b as (select unit, year, sum(v) filter (where member = 'TOTAL') as total, sum(v) filter (where member <> 'TOTAL') as members,
      case when year < 1998 then 1e-6 else 0.02 end as tolerance from level group by unit, year)
    select unit, year, total, members, tolerance::double as tolerance, abs(total - members) / greatest(abs(members), 1) as relative_gap from b
    where abs(total - members) > greatest(abs(members), 1) * tolerance""",
    total=4,
    members=2,
    relative_gap=8,
)
def expect_total_equals_members(spark, d):
    tolerance = F.when(F.col("year") < 1998, 1e-6).otherwise(0.02)
    return Q.total_vs_members(rolled_levels(spark, d), ["unit", "year"], "v", F.col("member") == "TOTAL", tolerance)


@query(
    "expect_overlap_small",
    """with src as (select c_nationkey as unit, o_orderpriority as col, sum(o_totalprice) filter (where o_orderdate < timestamp '1998-10-01') as old_value,
      sum(o_totalprice * case when c_nationkey < 5 then 1.1 else 1.001 end) filter (where o_orderdate >= timestamp '1998-07-01') as new_value
      from orders join customer on o_custkey = c_custkey where o_orderdate >= timestamp '1998-07-01' and o_orderdate < timestamp '1998-10-01' group by 1, 2)
    select unit, count(*) as pairs, median(abs(new_value - old_value) / abs(old_value)) as median_gap, max(abs(new_value - old_value) / abs(old_value)) as max_gap
    from src where old_value <> 0 group by 1 having median(abs(new_value - old_value) / abs(old_value)) > 0.02
    or max(abs(new_value - old_value) / abs(old_value)) > 0.10""",
    median_gap=8,
    max_gap=8,
)
def expect_overlap_small(spark, d):
    """Two sources of the overlap quarter: both the median and the largest gap are held to a limit."""
    o = moves(spark, d).filter(
        (F.col("day") >= F.lit("1998-07-01").cast("date")) & (F.col("day") < F.lit("1998-10-01").cast("date"))
    )
    factor = F.when(F.col("unit") < 5, 1.1).otherwise(1.001)
    pairs = o.groupBy("unit", "priority").agg(
        F.sum("amount").alias("old_value"), F.sum(F.col("amount") * factor).alias("new_value")
    )
    gap = F.abs(F.col("new_value") - F.col("old_value")) / F.abs("old_value")
    gaps = settle(pairs.filter("old_value <> 0").select("unit", gap.alias("gap")), "gaps")
    stats = gaps.groupBy("unit").agg(F.count("*").alias("pairs"), F.max("gap").alias("max_gap"))
    both = stats.join(exact_quantiles(gaps, ["unit"], "gap", {"median_gap": 0.5}), "unit")
    return both.filter("median_gap > 0.02 or max_gap > 0.10")


@query(
    "expect_rule_rows",
    with_ctes("q")
    + """, a as (select unit, year, count(distinct quarter) as quarters, sum(amount) as quarter_sum from q group by 1, 2)
    select unit, year, 'amount' as variable, quarters, case when quarters = 4 then quarter_sum when quarters = 3 then quarter_sum end as annual_value
    from a where quarters < 4 and quarters = 3""",
    annual_value=2,
)
def expect_rule_rows(spark, d):
    """A careless annual table that also publishes three-quarter sums breaks its rule row by row."""
    rules = spark.createDataFrame(list(RULES.items()), "variable string, rule string")
    rows = annualize_long(_long(spark, d), ["unit", "year"], rules)
    careless = F.when((F.col("variable") == "amount") & (F.col("quarters") == 3), F.col("quarter_sum")).otherwise(
        F.col("annual_value")
    )
    tested = rows.withColumn("annual_value", careless)
    flow = F.col("rule") == "sum"
    full = F.col("quarters") == 4
    right = (
        F.when(flow & full, F.col("annual_value").eqNullSafe(F.col("quarter_sum")))
        .when(flow, F.col("annual_value").isNull())
        .otherwise(F.col("annual_value").eqNullSafe(F.col("q4_value")))
    )
    return Q.violates(tested, right).select("unit", "year", "variable", "quarters", "annual_value")


@query(
    "expect_not_repeated",
    """with m as (select o_custkey as u, year(o_orderdate) as y, quarter(o_orderdate) as q, count(*) as v from orders group by 1, 2, 3),
    g as (select v - lag(v) over (partition by u order by y, q) as d from m)
    select count(*) as n, count(*) filter (where d = 0) as bad from g where d is not null having count(*) filter (where d = 0) > 0.05 * count(*)""",
)
def expect_not_repeated(spark, d):
    """Exact zero changes in more than five per cent of the rows are the mark of a repeated value."""
    from pyspark.sql import Window

    w = Window.partitionBy("u").orderBy("y", "q")
    m = (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("u"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
        .agg(F.count("*").alias("v"))
    )
    change = m.select((F.col("v") - F.lag("v").over(w)).alias("d")).filter("d is not null")
    return Q.share_at_most(change, F.col("d") == 0, 0.05)


@query(
    "expect_coverage",
    INDEX_SQL
    + """select count(*) as n, count(*) filter (where composite is null) as bad from panel p
    left join scores i on i.unit = p.unit and i.year + 1 = p.year
    having count(*) filter (where composite is null) > 0.05 * count(*)""",
)
def expect_coverage(spark, d):
    """The index of the year before, which the first year of the panel has not."""
    idx = index_scores(spark, d).select("unit", (F.col("year") + 1).alias("year"), "composite")
    joined = panel(spark, d).join(idx, ["unit", "year"], "left")
    return Q.share_at_most(joined, F.col("composite").isNull(), 0.05)


@query(
    "expect_prefix",
    """select c_custkey, lpad(c_nationkey::varchar, 2, '0') || lpad(c_custkey::varchar, 9, '0') as member_code, lpad(s_nationkey::varchar, 2, '0') as parent_code
    from customer left join (select s_suppkey, s_nationkey from supplier) on s_suppkey = c_custkey
    where s_suppkey is null or c_nationkey <> s_nationkey""",
)
def expect_prefix(spark, d):
    """Member codes must start with the code of the parent that claims them; unclaimed codes fail too."""
    member = F.concat(pad_code(F.col("c_nationkey"), 2), pad_code(F.col("c_custkey"), 9))
    claims = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), pad_code(F.col("s_nationkey"), 2).alias("parent_code")
    )
    rows = table(spark, d, "customer").select("c_custkey", member.alias("member_code")).join(claims, "c_custkey", "left")
    bad = F.col("parent_code").isNull() | ~F.startswith(F.col("member_code"), F.col("parent_code"))
    return rows.filter(bad)


@query(
    "expect_no_duplicates_strict",
    """select o_custkey, year(o_orderdate) as year, count(*) as n from orders group by 1, 2 having count(*) > 1""",
)
def expect_no_duplicates_strict(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return Q.not_unique(rows, ["o_custkey", "year"])


@query(
    "expect_contiguous_horizon",
    with_ctes("annual")
    + """, last as (select unit, max(year) filter (where amount is not null) as last_year from annual group by 1),
    asked as (select unit, last_year, unnest([2001, 2003]) as year, unnest([1, 2]) as step from last)
    select unit, last_year, year::int as year, (last_year + step)::bigint as expected from asked where year <> last_year + step""",
)
def expect_contiguous_horizon(spark, d):
    """Step k of a forecast must be the k-th year after the last observed one: 2003 is not step two."""
    last = annual(spark, d).groupBy("unit").agg(
        F.max(F.when(F.col("amount").isNotNull(), F.col("year"))).alias("last_year")
    )
    horizon = F.array(*[F.struct(F.lit(y).alias("year"), F.lit(k).alias("step")) for k, y in ((1, 2001), (2, 2003))])
    asked = last.select("unit", "last_year", F.inline(horizon))
    expected = (F.col("last_year") + F.col("step")).cast("long")
    return asked.filter(F.col("year") != expected).select("unit", "last_year", "year", expected.alias("expected"))


@query(
    "expect_national_current",
    with_ctes("annual")
    + """select max(year) filter (where amount is not null) as panel_end, (select max(year(o_orderdate)) from orders) as national_end
    from annual having max(year) filter (where amount is not null) <> (select max(year(o_orderdate)) from orders)""",
)
def expect_national_current(spark, d):
    """The national total must end with the panel: here the last year is incomplete in the units."""
    ends = annual(spark, d).agg(F.max(F.when(F.col("amount").isNotNull(), F.col("year"))).alias("panel_end"))
    national = table(spark, d, "orders").agg(F.max(F.year("o_orderdate"))).scalar()
    return ends.withColumn("national_end", national).filter("panel_end <> national_end or panel_end is null")


@query(
    "table_diff_tolerance",
    with_ctes("q")
    + """, b as (select unit, year, quarter, case when year = 1999 and quarter = 1 then amount * 1.001 when year = 1996 then amount * (1 + 1e-9) else amount end as amount,
      orders::double as orders from q where not (year = 1995 and quarter = 2)),
    j as (select q.unit, q.year, q.quarter, q.amount as old_amount, b.amount as new_amount, q.orders::double as old_orders, b.orders as new_orders, b.unit is null as gone
      from q left join b on q.unit = b.unit and q.year = b.year and q.quarter = b.quarter)
    select unit, year, quarter, case when gone then 'only_old' else 'changed' end as side, 'amount' as "column", old_amount as old, new_amount as new
      from j where gone or abs(old_amount - new_amount) > 1e-6 * greatest(1, abs(old_amount))
    union all select unit, year, quarter, 'only_old', 'orders', old_orders, null from j where gone""",
    old=2,
    new=5,
)
def table_diff_tolerance(spark, d):
    """A regenerated table against the published one: a real change, a rounding change and a lost quarter."""
    a = quarterly(spark, d).select("unit", "year", "quarter", "amount", F.col("orders").cast("double").alias("orders"))
    moved = (
        F.when((F.col("year") == 1999) & (F.col("quarter") == 1), F.col("amount") * 1.001)
        .when(F.col("year") == 1996, F.col("amount") * (1 + 1e-9))
        .otherwise(F.col("amount"))
    )
    b = a.filter("not (year = 1995 and quarter = 2)").withColumn("amount", moved)
    return Q.table_diff(a, b, ["unit", "year", "quarter"], ["amount", "orders"])


@query(
    "ledger_check",
    with_ctes("moves")
    + """, got(item, obtained) as (select 'orders per unit', count(*)::double / count(distinct unit) from moves union all
      select 'mean amount', avg(amount) from moves union all select 'no orders', avg(amount) from moves where unit < 0),
    doc(item, expected, tol) as (values ('orders per unit', 600.0::double, 0.02::double), ('mean amount', 1.0, 0.02), ('no orders', 5.0, 0.02), ('unpublished', null, 0.02))
    select item, expected, tol::double as tol, obtained, case when expected is null then 'no_data' when obtained is null then 'not_estimated'
      when abs(obtained - expected) / greatest(abs(expected), 1e-9) <= tol then 'ok' else 'differs' end as verdict from doc full join got using (item)""",
    obtained=4,
)
def ledger_check(spark, d):
    m = moves(spark, d)
    facts = m.agg(
        (F.count("*") / F.countDistinct("unit")).alias("orders per unit"),
        F.avg("amount").alias("mean amount"),
        F.avg(F.when(F.col("unit") < 0, F.col("amount"))).alias("no orders"),
    )
    got = facts.unpivot([], facts.columns, "item", "obtained")
    doc = spark.createDataFrame(
        [("orders per unit", 600.0, 0.02), ("mean amount", 1.0, 0.02), ("no orders", 5.0, 0.02), ("unpublished", None, 0.02)],
        "item string, expected double, tol double",
    )
    return Q.ledger(got, doc, "item")


@query(
    "expect_ratio",
    with_ctes("moves")
    + """, pub as (select unit, year, sum(amount) + sum(amount) as published from moves group by 1, 2),
    tru as (select unit, year, sum(amount) as total from moves group by 1, 2)
    select round(published / total, 6) as ratio, count(*) as n from pub join tru using (unit, year) group by 1""",
)
def expect_ratio(spark, d):
    """A table that added the total row to its members publishes exactly twice the truth everywhere."""
    levels = moves(spark, d).rollup("unit", "year", "priority").agg(F.sum("amount").alias("v"), F.grouping_id().alias("_g"))
    both = levels.filter("_g <= 1").groupBy("unit", "year").agg(
        F.sum("v").alias("published"), F.sum(F.when(F.col("_g") == 1, F.col("v"))).alias("total")
    )
    return both.groupBy(F.round(F.col("published") / F.col("total"), 6).alias("ratio")).agg(F.count("*").alias("n"))


@query(
    "sample_trace",
    with_ctes("series")
    + """, s as (select *, lag(x) over w as x_lag1, lag(x, 2) over w as x_lag2, lag(y) over w as y_lag1 from series window w as (partition by unit order by year))
    select 'y and x' as sample, count(*) filter (where y is not null and x is not null and c2 is not null) as rows from s union all
    select 'y and x lag', count(*) filter (where y is not null and x_lag1 is not null and y_lag1 is not null and c2 is not null) from s union all
    select 'y and x second lag', count(*) filter (where y is not null and x_lag2 is not null and y_lag1 is not null and c2 is not null) from s""",
)
def sample_trace(spark, d):
    from comarca.operators.windows import by_unit

    w = by_unit()
    s = series(spark, d).withColumns(
        {"x_lag1": F.lag("x").over(w), "x_lag2": F.lag("x", 2).over(w), "y_lag1": F.lag("y").over(w)}
    )
    return Q.complete_rows(
        s,
        {
            "y and x": ["y", "x", "c2"],
            "y and x lag": ["y", "x_lag1", "y_lag1", "c2"],
            "y and x second lag": ["y", "x_lag2", "y_lag1", "c2"],
        },
    )


@query(
    "expect_baseline_coverage",
    """with m as (select o_custkey as member, year(o_orderdate) as year, sum(o_totalprice) as amount from orders group by 1, 2)
    select count(distinct member) as units, count(distinct member) filter (where year = 1996) as covered from m
    having count(distinct member) filter (where year = 1996) < 0.9 * count(distinct member)""",
)
def expect_baseline_coverage(spark, d):
    """Fixing a base year needs it in nine of ten units; many customers bought nothing in 1996."""
    m = (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("member"), F.year("o_orderdate").alias("year"))
        .agg(F.sum("o_totalprice").alias("amount"))
    )
    return baseline_coverage(m, "member", "year", 1996, "amount")

