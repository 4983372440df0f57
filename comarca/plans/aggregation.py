"""Aggregations on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from comarca.functions.text import normalize_name, period_id
from comarca.operators.annual import annualize_long
from comarca.operators.ranking import exact_quantiles
from comarca.plans.base import annual, moves, quarterly, series, table, with_ctes
from comarca.plans.catalog import query
from comarca.plans.joining import SPLICE_SRC, spliced_input


@query(
    "agg_entities",
    with_ctes("moves")
    + """select unit, year::varchar || 'Q' || quarter::varchar as period_id, priority as entity_kind,
    sum(amount) as value, count(*) as n_rows from moves group by 1, 2, 3""",
    value=2,
)
def agg_entities(spark, d):
    return (
        moves(spark, d)
        .groupBy("unit", period_id(F.col("day"), "Q").alias("period_id"), F.col("priority").alias("entity_kind"))
        .agg(F.sum("amount").alias("value"), F.count("*").alias("n_rows"))
    )


# The annual rule of each variable of the analogue.
RULES = {"amount": "sum", "orders": "sum", "buyers": "last"}


@query(
    "annualize",
    with_ctes("q", "moves")
    + """, long as (select unit, year, quarter, 'amount' as variable, amount as value, case when year < 1998 then 'old' else 'new' end as source from q
      union all select unit, year, quarter, 'orders', orders::double, case when year < 1998 then 'old' else 'new' end from q
      union all select unit, year, quarter, 'buyers', buyers::double, case when year < 1998 then 'old' else 'new' end from q),
    agg as (select unit, year, variable, count(distinct quarter) as quarters, sum(value) as quarter_sum,
      max(case when quarter = 4 then value end) as q4_value, max_by(source, quarter) as latest_source from long group by 1, 2, 3)
    select *, case variable when 'buyers' then 'last' else 'sum' end as rule,
    case when variable = 'buyers' then q4_value when quarters = 4 then quarter_sum end as annual_value from agg""",
    quarter_sum=2,
    q4_value=2,
    annual_value=2,
)
def annualize(spark, d):
    rules = spark.createDataFrame(list(RULES.items()), "variable string, rule string")
    return annualize_long(_long(spark, d), ["unit", "year"], rules)


def _long(spark, d):
    source = F.when(F.col("year") < 1998, "old").otherwise("new")
    wide = quarterly(spark, d).select(
        "unit", "year", "quarter", source.alias("source"), *[F.col(v).cast("double").alias(v) for v in RULES]
    )
    return wide.unpivot(["unit", "year", "quarter", "source"], list(RULES), "variable", "value")


@query(
    "group_by_all",
    with_ctes("moves") + "select unit, year, status, sum(amount) as amount, count(*) as n from moves group by all",
    amount=2,
)
def group_by_all(spark, d):
    return spark.sql(
        "select unit, year, status, sum(amount) as amount, count(*) as n from {rows} group by all", rows=moves(spark, d)
    )


@query(
    "pivot_conditional",
    with_ctes("moves")
    + """select unit, year, sum(amount) filter (where priority = '1-URGENT') as urgent, sum(amount) filter (where priority = '2-HIGH') as high,
    sum(amount) filter (where priority = '3-MEDIUM') as medium, sum(amount) filter (where priority = '5-LOW') as low,
    sum(amount) filter (where priority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) as other from moves group by 1, 2""",
    urgent=2,
    high=2,
    medium=2,
    low=2,
    other=2,
)
def pivot_conditional(spark, d):
    """The named columns come from a metadata table, so the pivot needs no discovery job; the rest is one column."""
    heads = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
    named = F.when(F.col("priority").isin(heads), F.col("priority")).when(F.col("priority").isNotNull(), "other")
    wide = (
        moves(spark, d)
        .withColumn("priority", named)
        .groupBy("unit", "year")
        .pivot("priority", [*heads, "other"])
        .agg(F.sum("amount"))
    )
    return wide.toDF("unit", "year", "urgent", "high", "medium", "low", "other")


@query(
    "channel_month",
    """select user_id as unit, event_type as channel, strftime(ts, '%Y-%m') as period_id, sum(value) as points,
    sum(case when value > 10 then value end) as active_points, count(distinct regexp_extract(props, '[0-9]+')) as entities
    from events group by 1, 2, 3""",
    points=4,
    active_points=4,
)
def channel_month(spark, d):
    """Repeated keys are summed; the distinct entities are those that reported."""
    v = F.col("value")
    return (
        table(spark, d, "events")
        .groupBy(F.col("user_id").alias("unit"), F.col("event_type").alias("channel"), period_id(F.col("ts"), "M").alias("period_id"))
        .agg(
            F.sum(v).alias("points"),
            F.sum(F.when(v > 10, v)).alias("active_points"),
            F.countDistinct(F.get_json_object("props", "$.k")).alias("entities"),
        )
    )


@query(
    "stock_year_end",
    with_ctes("q")
    + """select unit, year, count(distinct quarter) as quarters, max(quarter) as last_quarter,
    max(case when quarter = 4 then buyers end) as q4_value, max(buyers) as top_value from q group by 1, 2""",
)
def stock_year_end(spark, d):
    return quarterly(spark, d).groupBy("unit", "year").agg(
        F.count("quarter").alias("quarters"),
        F.max("quarter").alias("last_quarter"),
        F.max(F.when(F.col("quarter") == 4, F.col("buyers"))).alias("q4_value"),
        F.max("buyers").alias("top_value"),
    )


@query(
    "weighted_mean_nonnull",
    """select l_suppkey, sum(l_quantity) as weight, sum(nullif(l_discount, 0) * l_quantity)
    / nullif(sum(case when nullif(l_discount, 0) is not null then l_quantity end), 0) as mean_rate from lineitem group by 1""",
    mean_rate=9,
)
def weighted_mean_nonnull(spark, d):
    """A missing rate leaves the numerator and the weight alike."""
    rate = F.nullif("l_discount", F.lit(0.0))
    weight = F.when(rate.isNotNull(), F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("weight"),
        (F.sum(rate * F.col("l_quantity")) / F.nullif(F.sum(weight), F.lit(0.0))).alias("mean_rate"),
    )


@query(
    "avg_with_coverage",
    with_ctes("q") + "select unit, year, avg(amount) as mean_amount, count(*) as periods from q group by 1, 2",
    mean_amount=4,
)
def avg_with_coverage(spark, d):
    return quarterly(spark, d).groupBy("unit", "year").agg(
        F.avg("amount").alias("mean_amount"), F.count("*").alias("periods")
    )


@query(
    "median_by_group",
    """select l_returnflag, l_linestatus, median(l_extendedprice) as median_price, count(*) as n from lineitem group by 1, 2""",
    median_price=4,
)
def median_by_group(spark, d):
    """Exact medians of groups that may each hold a third of all rows."""
    by = ["l_returnflag", "l_linestatus"]
    lines = table(spark, d, "lineitem").select(*by, "l_extendedprice")
    medians = exact_quantiles(lines, by, "l_extendedprice", {"median_price": 0.5})
    return medians.join(lines.groupBy(*by).agg(F.count("*").alias("n")), by)


@query("median_by_group_approx")
def median_by_group_approx(spark, d):
    """The bounded-memory variant: a sketch per group, no second pass."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("median_price"), F.count("*").alias("n")
    )


@query(
    "quantile_summary",
    """select p_brand, count(*) as n, median(l_extendedprice) as p50, quantile_cont(l_extendedprice, 0.9) as p90,
    max(l_extendedprice) as top from lineitem join part on l_partkey = p_partkey group by 1""",
    p50=4,
    p90=4,
)
def quantile_summary(spark, d):
    lines = (
        table(spark, d, "lineitem")
        .select("l_partkey", "l_extendedprice")
        .join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    )
    q = exact_quantiles(lines, ["p_brand"], "l_extendedprice", {"p50": 0.5, "p90": 0.9})
    rest = lines.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("top"))
    return rest.join(q, "p_brand")


@query(
    "having_count",
    "select o_custkey, count(*) as n from orders group by 1 having count(*) > 12",
)
def having_count(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12")


_BLOCK = "case l_returnflag when 'A' then 'accepted' else 'other' end"


@query(
    "count_nonzero_by_block",
    f"""with cells as (select l_returnflag, {_BLOCK} as block, u.c as col, u.v as v from lineitem, lateral (values ('discount', l_discount),
      ('tax', l_tax), ('quantity', l_quantity)) u(c, v)),
    one as (select l_returnflag, block, col, count(*) filter (where coalesce(v, 0) <> 0) as n_nonzero, count(*) as n from cells group by 1, 2, 3)
    select block, col as "column", cast(sum(n_nonzero) as bigint) as n_nonzero, max(n_nonzero::double / n) as share from one where n_nonzero > 0 group by 1, 2""",
    share=6,
)
def count_nonzero_by_block(spark, d):
    """Two spellings of a block are merged after each was counted: counts add up, shares take the larger."""
    cols = {"discount": "l_discount", "tax": "l_tax", "quantity": "l_quantity"}
    block = F.when(F.col("l_returnflag") == "A", "accepted").otherwise("other")
    wide = (
        table(spark, d, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(0.0)) != 0).alias(k) for k, c in cols.items()])
    )
    long = wide.withColumn("block", block).unpivot(["l_returnflag", "block", "n"], list(cols), "column", "n_nonzero")
    return (
        long.filter("n_nonzero > 0")
        .groupBy("block", "column")
        .agg(F.sum("n_nonzero").alias("n_nonzero"), F.max(F.col("n_nonzero") / F.col("n")).alias("share"))
    )


@query(
    "coverage_report",
    """select year(o_orderdate)::varchar || 'Q' || quarter(o_orderdate)::varchar as period_id, count(*) as n,
    count(c_custkey) as mapped, round(count(c_custkey)::double / count(*), 6) as share from orders
    left join (select c_custkey from customer where c_acctbal > 0) on o_custkey = c_custkey group by 1""",
)
def coverage_report(spark, d):
    known = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey")
    return (
        table(spark, d, "orders")
        .select("o_custkey", period_id(F.col("o_orderdate"), "Q").alias("period_id"))
        .join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
        .groupBy("period_id")
        .agg(F.count("*").alias("n"), F.count("c_custkey").alias("mapped"))
        .withColumn("share", F.round(F.col("mapped") / F.col("n"), 6))
    )


@query(
    "coverage_names",
    """select c_custkey, c_name as name_a, 'CUSTOMER ' || lpad(c_custkey::varchar, 9, '0') as name_b from customer
    where c_mktsegment = 'BUILDING' or c_acctbal < 0""",
)
def coverage_names(spark, d):
    """Names that still disagree after normalisation; the rest match although their spelling differs."""
    c = table(spark, d, "customer")
    broken = (F.col("c_mktsegment") == "BUILDING") | (F.col("c_acctbal") < 0)
    other = F.concat(F.lit("CUSTOMER "), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    named = c.select("c_custkey", F.col("c_name").alias("name_a"), other.alias("name_b"), broken.alias("broken"))
    seen = F.when(F.col("broken"), F.concat("name_b", F.lit(" x"))).otherwise(F.col("name_b"))
    return named.filter(normalize_name(F.col("name_a")) != normalize_name(seen)).select("c_custkey", "name_a", "name_b")


PROFILED = ["orders", "amount", "pop", "dead", "yearly"]


@query(
    "column_profile",
    with_ctes("q", "population")
    + """, wide as (select q.unit, q.year, q.quarter, q.orders::double as orders, q.amount, p.pop, 1.0::double as dead, (q.year * 7.0)::double as yearly
      from q join population p using (unit)),
    long as (select unit, year, u.c as col, u.v as v from wide, lateral (values ('orders', orders), ('amount', amount), ('pop', pop), ('dead', dead), ('yearly', yearly)) u(c, v)),
    ranges as (select col, count(distinct v) as n_distinct, min(v) as low, max(v) as high from long group by 1),
    per as (select col, max(k) as most from (select col, unit, year, count(distinct v) as k from long group by 1, 2, 3) group by 1),
    stat as (select col, max(k) as per_unit from (select col, unit, count(distinct v) as k from long group by 1, 2) group by 1)
    select col as "column", n_distinct, low, high, case when n_distinct = 1 then 'dead' when per_unit = 1 then 'static'
    when most = 1 then 'yearly_repeated' else 'quarterly' end as frequency from ranges join per using (col) join stat using (col)""",
    low=2,
    high=2,
)
def column_profile(spark, d):
    """Distinct values, range and real frequency of every column of the quarterly table."""
    pop = series(spark, d).select("unit", "pop").distinct()
    wide = quarterly(spark, d).join(pop, "unit").select(
        "unit",
        "year",
        F.col("orders").cast("double").alias("orders"),
        "amount",
        "pop",
        F.lit(1.0).alias("dead"),
        (F.col("year") * 7.0).alias("yearly"),
    )
    long = wide.unpivot(["unit", "year"], PROFILED, "column", "v")
    per_year = long.groupBy("column", "unit", "year").agg(F.countDistinct("v").alias("_k"))
    per_unit = long.groupBy("column", "unit").agg(F.countDistinct("v").alias("_k"))
    kinds = (
        per_year.groupBy("column").agg(F.max("_k").alias("_most"))
        .join(per_unit.groupBy("column").agg(F.max("_k").alias("_own")), "column")
    )
    glob = long.groupBy("column").agg(
        F.countDistinct("v").alias("n_distinct"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    frequency = (
        F.when(F.col("n_distinct") == 1, "dead")
        .when(F.col("_own") == 1, "static")
        .when(F.col("_most") == 1, "yearly_repeated")
        .otherwise("quarterly")
    )
    return glob.join(kinds, "column").select("column", "n_distinct", "low", "high", frequency.alias("frequency"))


@query(
    "repetition_diagnostic",
    with_ctes("q")
    + """, per as (select unit, year, count(distinct orders) as k from q group by 1, 2),
    lagged as (select orders, lag(orders) over (partition by unit order by year, quarter) as before from q)
    select (select min(k) from per) as k_min, (select max(k) from per) as k_max, (select avg(k) from per) as k_mean,
    (select count(*) filter (where orders = before)::double / count(*) from lagged) as share_repeated""",
    k_mean=9,
    share_repeated=9,
)
def repetition_diagnostic(spark, d):
    """Is a quarterly column a yearly value repeated inside the year? One window feeds both figures."""
    w = Window.partitionBy("unit").orderBy("year", "quarter")
    q = quarterly(spark, d).withColumn("before", F.lag("orders").over(w))
    per = q.groupBy("unit", "year").agg(
        F.countDistinct("orders").alias("k"),
        F.count("*").alias("n"),
        F.count_if(F.col("orders") == F.col("before")).alias("same"),
    )
    return per.agg(
        F.min("k").alias("k_min"),
        F.max("k").alias("k_max"),
        F.avg("k").alias("k_mean"),
        (F.sum("same") / F.sum("n")).alias("share_repeated"),
    )


DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "describe_table",
    " union all ".join(
        f"""select '{c}' as variable, count({c}) as n, avg({c}) as mean, stddev_samp({c}) as sd, min({c}) as low,
    quantile_cont({c}, 0.25) as p25, median({c}) as p50, quantile_cont({c}, 0.75) as p75, max({c}) as high from lineitem"""
        for c in DESCRIBED
    ),
    mean=6,
    sd=6,
    p25=4,
    p50=4,
    p75=4,
)
def describe_table(spark, d):
    long = table(spark, d, "lineitem").select(*DESCRIBED).unpivot([], DESCRIBED, "variable", "v")
    base = long.groupBy("variable").agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("sd"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
    )
    return base.join(exact_quantiles(long, ["variable"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "variable")


@query(
    "describe_by_year",
    with_ctes("series")
    + "select year, count(*) as n, avg(x) as x_mean, avg(y) as y_mean, avg(log_pc) as log_mean from series group by 1",
    x_mean=9,
    y_mean=9,
    log_mean=9,
)
def describe_by_year(spark, d):
    return series(spark, d).groupBy("year").agg(
        F.count("*").alias("n"),
        F.avg("x").alias("x_mean"),
        F.avg("y").alias("y_mean"),
        F.avg("log_pc").alias("log_mean"),
    )


@query(
    "additivity_gap",
    with_ctes("moves")
    + """, sec as (select unit, year, status, round(sum(amount), -6) as v from moves group by 1, 2, 3), s as (select unit, year, sum(v) as sections from sec group by 1, 2),
    t as (select unit, year, sum(amount) as published from moves group by 1, 2)
    select max(abs(sections / published - 1)) as max_gap, median(abs(sections / published - 1)) as median_gap, count(*) as n
    from s join t using (unit, year) where published > 0""",
    max_gap=9,
    median_gap=9,
)
def additivity_gap(spark, d):
    """Sections published in round millions do not add up to the published total: by how much."""
    m = moves(spark, d)
    keys = ["unit", "year"]
    sections = (
        m.groupBy(*keys, "status")
        .agg(F.sum("amount").alias("v"))
        .groupBy(*keys)
        .agg(F.sum(F.round("v", -6)).alias("sections"), F.sum("v").alias("published"))
    )
    gap = sections.filter("published > 0").select(F.abs(F.col("sections") / F.col("published") - 1).alias("gap"))
    both = gap.agg(F.max("gap").alias("max_gap"), F.count("*").alias("n"))
    median = exact_quantiles(gap, [], "gap", {"median_gap": 0.5})
    return both.select("max_gap", "n", median.scalar().alias("median_gap"))


@query(
    "ex_section_growth",
    with_ctes("moves", "population")
    + """, lvl as (select unit, year, sum(amount) as level from moves where priority not in ('1-URGENT', '5-LOW') group by 1, 2),
    pc as (select unit, year, case when pop > 0 and level > 0 then ln(level / pop) end as log_pc from lvl join population using (unit))
    select unit, year, log_pc - lag(log_pc) over (partition by unit order by year) as growth from pc""",
    growth=9,
)
def ex_section_growth(spark, d):
    return ex_section(spark, d, ["1-URGENT", "5-LOW"]).select("unit", "year", "growth")


def ex_section(spark, d, excluded):
    """Per-head growth of the sum of sections without the excluded ones."""
    from comarca.functions.numeric import log_positive
    from comarca.plans.base import population

    w = Window.partitionBy("unit").orderBy("year")
    level = (
        moves(spark, d)
        .filter(~F.col("priority").isin(excluded))
        .groupBy("unit", "year")
        .agg(F.sum("amount").alias("level"))
        .join(population(spark, d), "unit")
    )
    log_pc = log_positive(F.col("level") / F.col("pop"))
    return level.withColumn("growth", log_pc - F.lag(log_pc).over(w))


@query(
    "coherence_gap",
    with_ctes("annual")
    + """, nat as (select year(o_orderdate) as year, sum(o_totalprice) * 1.001 as national from orders group by 1)
    select year, (sum(amount) / any_value(national) - 1) * 100 as gap_pct from annual join nat using (year) where amount is not null group by 1""",
    gap_pct=9,
)
def coherence_gap(spark, d):
    """Sum of the units against a national total published with a revision of one per mille."""
    national = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        (F.sum("o_totalprice") * 1.001).alias("national")
    )
    units = annual(spark, d).filter("amount is not null").groupBy("year").agg(F.sum("amount").alias("total"))
    return units.join(national, "year").select("year", ((F.col("total") / F.col("national") - 1) * 100).alias("gap_pct"))


@query(
    "mode_by_year",
    with_ctes("moves")
    + """select year, status as mode_status from (select year, status, row_number() over (partition by year order by count(*) desc, status) as r
    from moves group by 1, 2) where r = 1""",
)
def mode_by_year(spark, d):
    """Most frequent status per year, ties by name."""
    counts = moves(spark, d).groupBy("year", "status").agg(F.count("*").alias("n"))
    best = F.min_by("status", F.struct(-F.col("n"), F.col("status")))
    return counts.groupBy("year").agg(best.alias("mode_status"))


@query(
    "splice_priority",
    with_ctes("moves")
    + f""", {SPLICE_SRC} select unit, year, quarter, coalesce(max(case when source = 'new' then value end), max(case when source = 'old' then value end)) as value,
    case when max(case when source = 'new' then 1 end) = 1 then 'new' else 'old' end as source,
    case when max(case when source = 'new' then 1 end) = 1 then max(case when source = 'old' then value end) end as previous_value
    from ag group by unit, year, quarter""",
    value=2,
    previous_value=2,
)
def splice_priority(spark, d):
    from comarca.operators.annual import splice

    return splice(spliced_input(spark, d), ["unit", "year", "quarter"], "value", "source", "new", "old")

