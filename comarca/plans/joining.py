"""Joins on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from comarca.functions.text import normalize_name
from comarca.operators import star as S
from comarca.operators.annual import splice
from comarca.plans.base import (
    BASE_YEAR,
    annual,
    moves,
    panel,
    population,
    quarterly,
    ring,
    series,
    table,
    units,
    with_ctes,
)
from comarca.plans.catalog import query
from comarca.plans.index_base import INDEX_SQL, index_scores


@query(
    "join_lookup_left",
    """select s_suppkey, s_nationkey, n_name as unit_name, r_name as region_name from supplier
    left join (select * from nation where n_nationkey < 20) n on s_nationkey = n_nationkey
    left join region on n_regionkey = r_regionkey""",
)
def join_lookup_left(spark, d):
    """A crosswalk that misses some codes: the rows stay, the names are NULL."""
    xw = table(spark, d, "nation").filter("n_nationkey < 20")
    return (
        table(spark, d, "supplier")
        .join(xw, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("s_suppkey", "s_nationkey", F.col("n_name").alias("unit_name"), F.col("r_name").alias("region_name"))
    )


@query(
    "join_star_inner",
    with_ctes("q", "units")
    + """select unit, name, r_name as region_name, year, quarter, orders, amount from q
    join (select * from units where region <> 4) using (unit) join region on region = r_regionkey""",
    amount=2,
)
def join_star_inner(spark, d):
    """Rows whose unit is absent from the dimension are dropped by the inner join."""
    dim = units(spark, d).filter("region <> 4")
    return (
        quarterly(spark, d)
        .join(dim, "unit")
        .join(table(spark, d, "region"), F.col("region") == F.col("r_regionkey"))
        .select("unit", "name", F.col("r_name").alias("region_name"), "year", "quarter", "orders", "amount")
    )


_SUPPLY = """supply as (select s_nationkey as unit, year(l_shipdate) as year, sum(l_extendedprice) as product,
    sum(l_quantity) as quantity from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2)"""


def supply(spark, d):
    """Output side of the panel: value shipped by the suppliers of each unit and year."""
    return (
        table(spark, d, "lineitem")
        .select("l_suppkey", F.year("l_shipdate").alias("year"), "l_extendedprice", "l_quantity")
        .join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("unit"), "year")
        .agg(F.sum("l_extendedprice").alias("product"), F.sum("l_quantity").alias("quantity"))
    )


@query(
    "join_multi_left",
    with_ctes("annual", "units", "population")
    + f""", {_SUPPLY}, coverage as (select unit, year, avg(buyers) as mean_buyers, count(*) as periods from q group by 1, 2)
    select unit, name, year, a.orders, a.amount, s.product, s.quantity, c.mean_buyers, c.periods, p.pop
    from annual a join units using (unit) left join supply s using (unit, year) left join coverage c using (unit, year)
    left join population p using (unit)""",
    amount=2,
    product=2,
    quantity=2,
    mean_buyers=6,
)
def join_multi_left(spark, d):
    cover = quarterly(spark, d).groupBy("unit", "year").agg(
        F.avg("buyers").alias("mean_buyers"), F.count("*").alias("periods")
    )
    return (
        annual(spark, d)
        .join(units(spark, d), "unit")
        .join(supply(spark, d), ["unit", "year"], "left")
        .join(cover, ["unit", "year"], "left")
        .join(population(spark, d).select("unit", "pop"), "unit", "left")
        .select("unit", "name", "year", "orders", "amount", "product", "quantity", "mean_buyers", "periods", "pop")
    )


@query(
    "join_index_to_panel",
    INDEX_SQL + "select p.unit, p.name, p.year, p.y, i.composite from panel p left join scores i "
    "on i.unit = p.unit and i.year = p.year",
    y=9,
    composite=8,
)
def join_index_to_panel(spark, d):
    """Panel rows are kept where the index does not exist."""
    idx = index_scores(spark, d).select("unit", "year", "composite")
    return panel(spark, d).select("unit", "name", "year", "y").join(idx, ["unit", "year"], "left")


@query(
    "dim_region",
    """select n_nationkey as unit, n_name as name, trim(regexp_replace(upper(n_name), '[^A-Z0-9]+', ' ', 'g')) as name_key,
    r_name as region_name, s.first_supplier, s.suppliers from nation left join region on n_regionkey = r_regionkey
    left join (select s_nationkey, min(s_suppkey) as first_supplier, count(*) as suppliers from supplier group by 1) s
    on s.s_nationkey = n_nationkey""",
)
def dim_region(spark, d):
    own = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("unit")).agg(
        F.min("s_suppkey").alias("first_supplier"), F.count("*").alias("suppliers")
    )
    return (
        units(spark, d)
        .join(table(spark, d, "region"), F.col("region") == F.col("r_regionkey"), "left")
        .join(own, "unit", "left")
        .select(
            "unit",
            "name",
            normalize_name(F.col("name")).alias("name_key"),
            F.col("r_name").alias("region_name"),
            "first_supplier",
            "suppliers",
        )
    )


# The canonical variables of the analogue and the column each source stores them in.
VARIABLES = [
    ("quantity_total", "l_quantity", "qty"),
    ("price_total", "l_extendedprice", "price"),
    ("discount_rate", "l_discount", ""),
    ("tax_rate", "", "tax"),
]
_VARS_SQL = """vars(variable, old_column, new_column) as (values ('quantity_total', 'l_quantity', 'qty'),
    ('price_total', 'l_extendedprice', 'price'), ('discount_rate', 'l_discount', ''), ('tax_rate', '', 'tax')),
    vmap as (select variable, 'old' as source, old_column as col from vars where old_column <> ''
             union all select variable, 'new', new_column from vars where new_column <> '')"""


def variables(spark):
    return spark.createDataFrame(VARIABLES, "variable string, old_column string, new_column string")


def two_sources_long(spark, d):
    """Line items as two sources report them: the old table and its renamed successor."""
    lines = table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.to_date("l_shipdate").alias("day")
    )
    old = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("l_quantity", "l_extendedprice", "l_discount")]
    )
    new = F.array(
        *[
            F.struct(F.lit(n).alias("column"), F.col(c).alias("value"))
            for c, n in (("l_quantity", "qty"), ("l_extendedprice", "price"), ("l_tax", "tax"), ("l_discount", "unmapped"))
        ]
    )
    is_old = F.col("day") < F.lit("1998-10-01").cast("date")
    return lines.select(
        F.when(is_old, "old").otherwise("new").alias("source"), "day", F.inline(F.when(is_old, old).otherwise(new))
    )


@query(
    "join_variable_map",
    f"""with {_VARS_SQL}, long as (
      select 'old' as source, u.c as col, u.v as value from lineitem, lateral (values ('l_quantity', l_quantity),
        ('l_extendedprice', l_extendedprice), ('l_discount', l_discount)) u(c, v) where l_shipdate < timestamp '1998-10-01'
      union all select 'new', u.c, u.v from lineitem, lateral (values ('qty', l_quantity), ('price', l_extendedprice),
        ('tax', l_tax), ('unmapped', l_discount)) u(c, v) where l_shipdate >= timestamp '1998-10-01')
    select m.variable, l.source, count(*) as n, sum(value) as total from long l join vmap m on m.source = l.source and m.col = l.col
    group by 1, 2""",
    total=2,
)
def join_variable_map(spark, d):
    """Columns are summed before they meet their variables, so that the join has a row per source and column."""
    vmap = S.variable_map(variables(spark), {"old_column": "old", "new_column": "new"})
    sums = two_sources_long(spark, d).groupBy("source", "column").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return (
        sums.join(vmap, ["source", "column"])
        .groupBy("variable", "source")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )


_MEMBER = """lvl as (select unit, year, case when priority = '5-LOW' then null else priority end as member,
    sum(amount) as amount, count(*) as n from moves group by 1, 2, 3)"""


def member_level(spark, d):
    member = F.when(F.col("priority") != "5-LOW", F.col("priority"))
    return (
        moves(spark, d)
        .groupBy("unit", "year", member.alias("member"))
        .agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    )


@query(
    "join_null_safe",
    with_ctes("moves")
    + f""", {_MEMBER} select a.unit, a.year, a.member, a.amount, b.amount as previous from lvl a
    join lvl b on a.unit = b.unit and a.year = b.year + 1 and coalesce(a.member, '') = coalesce(b.member, '')""",
    amount=2,
    previous=2,
)
def join_null_safe(spark, d):
    """Total rows carry a NULL member and must meet their own previous year."""
    lvl = member_level(spark, d)
    a, b = lvl.alias("a"), lvl.alias("b")
    on = (
        (F.col("a.unit") == F.col("b.unit"))
        & (F.col("a.year") == F.col("b.year") + 1)
        & F.col("a.member").eqNullSafe(F.col("b.member"))
    )
    return a.join(b, on).select("a.unit", "a.year", "a.member", "a.amount", F.col("b.amount").alias("previous"))


@query(
    "join_full_outer",
    """with k as (select c_custkey as code, c_nationkey as unit from customer where c_acctbal > -500),
    p as (select c_custkey as code, case when c_mktsegment = 'BUILDING' and c_acctbal < 0 then c_nationkey + 1 else c_nationkey end as unit
          from customer where c_mktsegment <> 'HOUSEHOLD' or c_acctbal < 9000)
    select coalesce(k.code, p.code) as code, k.unit as unit_new, p.unit as unit_old from k full join p on k.code = p.code
    where k.unit is null or p.unit is null or k.unit <> p.unit""",
)
def join_full_outer(spark, d):
    """Two crosswalks of all customers that disagree, each lacking some codes."""
    c = table(spark, d, "customer")
    moved = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 0)
    new = c.filter("c_acctbal > -500").select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("unit_new"))
    old = c.filter("c_mktsegment <> 'HOUSEHOLD' or c_acctbal < 9000").select(
        F.col("c_custkey").alias("code"),
        F.when(moved, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("unit_old"),
    )
    both = new.join(old, "code", "full")
    return both.filter("unit_new is null or unit_old is null or unit_new <> unit_old")


@query(
    "anti_join",
    f"""with {_VARS_SQL}, cols(source, col) as (values ('old', 'l_quantity'), ('old', 'l_extendedprice'), ('old', 'l_discount'),
      ('new', 'qty'), ('new', 'price'), ('new', 'tax'), ('new', 'unmapped')),
    seen as (select case when l_shipdate < timestamp '1998-10-01' then 'old' else 'new' end as source, count(*) as n from lineitem group by 1)
    select c.source, c.col as "column", s.n from cols c join seen s using (source) where not exists
      (select 1 from vmap m where m.source = c.source and m.col = c.col)""",
)
def anti_join(spark, d):
    """Columns that occur in the sources and have no variable."""
    vmap = S.variable_map(variables(spark), {"old_column": "old", "new_column": "new"})
    seen = two_sources_long(spark, d).groupBy("source", "column").agg(F.count("*").alias("n"))
    return seen.join(vmap, ["source", "column"], "left_anti")


@query(
    "anti_join_codes",
    """select o_custkey, count(*) as orders from orders where not exists
    (select 1 from customer where c_custkey = o_custkey and c_acctbal >= 0) group by 1""",
)
def anti_join_codes(spark, d):
    """Orders whose customer is not in the accepted list, by customer."""
    known = table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return (
        table(spark, d, "orders")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("orders"))
        .join(known, "o_custkey", "left_anti")
    )


@query(
    "semi_join",
    """select year(o_orderdate) as year, count(*) as n, count(*) filter (where c_custkey is not null) as mapped,
    count(*) filter (where c_custkey is not null)::double / count(*) as share from orders
    left join (select c_custkey from customer where c_mktsegment <> 'MACHINERY') on c_custkey = o_custkey group by 1""",
    share=9,
)
def semi_join(spark, d):
    """Membership in a set of known codes and its coverage by year."""
    known = table(spark, d, "customer").filter("c_mktsegment <> 'MACHINERY'").select("c_custkey")
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    total = o.groupBy("year").agg(F.count("*").alias("n"))
    mapped = (
        o.join(known, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .groupBy("year")
        .agg(F.count("*").alias("mapped"))
    )
    return total.join(mapped, "year", "left").select(
        "year",
        "n",
        F.coalesce("mapped", F.lit(0)).alias("mapped"),
        (F.coalesce("mapped", F.lit(0)) / F.col("n")).alias("share"),
    )


SPLICE_SRC = """src as (select 'old' as source, unit, day, amount, 1.0::double as weight from moves where day < date '1998-10-01'
    union all select 'new', unit, day, amount, 1.0::double from moves where day >= date '1998-07-01' and priority <> '5-LOW'),
    ag as (select source, unit, year(day) as year, quarter(day) as quarter, sum(amount) as value, count(*) as n_entities from src group by all)"""


def overlapping_sources(spark, d):
    """The same series from an old and a new source that both report 1998Q3.

    Each order is exploded into the sources that report it: one scan, not a union of two.
    """
    day = F.col("day")
    in_old = day < F.lit("1998-10-01").cast("date")
    in_new = (day >= F.lit("1998-07-01").cast("date")) & (F.col("priority") != "5-LOW")
    sources = F.array_compact(F.array(F.when(in_old, F.lit("old")), F.when(in_new, F.lit("new"))))
    return (
        moves(spark, d)
        .select("unit", "year", "quarter", "amount", "priority", F.explode(sources).alias("source"))
    )


def spliced_input(spark, d):
    return (
        overlapping_sources(spark, d)
        .groupBy("source", "unit", "year", "quarter")
        .agg(F.sum("amount").alias("value"), F.count("*").alias("n_entities"))
    )


@query(
    "self_join_overlap",
    with_ctes("moves")
    + f""", {SPLICE_SRC} select o.unit, o.value as old_value, n.value as new_value,
    abs(n.value - o.value) / abs(o.value) as gap from ag o join ag n on n.source = 'new' and o.source = 'old' and o.unit = n.unit
    and o.year = n.year and o.quarter = n.quarter where o.year = 1998 and o.quarter = 3 and o.value <> 0""",
    old_value=2,
    new_value=2,
    gap=9,
)
def self_join_overlap(spark, d):
    """Both sources' totals in the overlap quarter, paired in one aggregation."""
    overlap = spliced_input(spark, d).filter("year = 1998 and quarter = 3")
    paired = overlap.groupBy("unit").agg(
        F.max(F.when(F.col("source") == "old", F.col("value"))).alias("old_value"),
        F.max(F.when(F.col("source") == "new", F.col("value"))).alias("new_value"),
    )
    gap = F.abs(F.col("new_value") - F.col("old_value")) / F.abs("old_value")
    return paired.filter("old_value <> 0 and new_value is not null").withColumn("gap", gap)


@query(
    "self_join_prev_version",
    with_ctes("moves")
    + f""", {SPLICE_SRC} select n.unit, n.year, n.quarter, n.value, o.value as previous_value from ag n
    join ag o on o.source = 'old' and n.source = 'new' and n.unit = o.unit and n.year = o.year and n.quarter = o.quarter""",
    value=2,
    previous_value=2,
)
def self_join_prev_version(spark, d):
    kept = splice(spliced_input(spark, d), ["unit", "year", "quarter"], "value", "source", "new", "old")
    return kept.filter("previous_value is not null").select("unit", "year", "quarter", "value", "previous_value")


@query(
    "join_using",
    with_ctes("moves")
    + """, parts as (select unit, year, quarter, sum(v) as parts from (select unit, year, quarter, priority, sum(amount) as v
      from moves group by all) group by 1, 2, 3), whole as (select unit, year, quarter, sum(amount) as whole from moves group by 1, 2, 3)
    select unit, year, quarter, whole, abs(whole - parts) <= 1e-6 * greatest(abs(parts), 1) as agrees
    from whole join parts using (unit, year, quarter)""",
    whole=2,
)
def join_using(spark, d):
    keys = ["unit", "year", "quarter"]
    m = moves(spark, d)
    whole = m.groupBy(*keys).agg(F.sum("amount").alias("whole"))
    parts = m.groupBy(*keys, "priority").agg(F.sum("amount").alias("v")).groupBy(*keys).agg(F.sum("v").alias("parts"))
    agrees = F.abs(F.col("whole") - F.col("parts")) <= 1e-6 * F.greatest(F.abs("parts"), F.lit(1.0))
    return whole.join(parts, keys).select(*keys, "whole", agrees.alias("agrees"))


@query(
    "map_fixed_baseline",
    with_ctes("series")
    + f"""select s.unit, s.year, s.amount, b.amount as base_amount, s.amount / b.amount as relative
    from series s left join (select unit, amount from series where year = {BASE_YEAR}) b using (unit)""",
    amount=2,
    base_amount=2,
    relative=9,
)
def map_fixed_baseline(spark, d):
    s = series(spark, d).select("unit", "year", "amount")
    return S.fixed_baseline(s, "unit", "year", BASE_YEAR, {"amount": "base_amount"}).withColumn(
        "relative", F.col("amount") / F.col("base_amount")
    )


@query(
    "edge_join",
    with_ctes("panel", "ring")
    + """select r.unit, p.year, avg(p.x) as neighbour_x, count(*) as neighbours from ring r
    join panel p on p.unit = r.neighbour group by 1, 2""",
    neighbour_x=9,
)
def edge_join(spark, d):
    p = panel(spark, d).select(F.col("unit").alias("neighbour"), "year", "x")
    return (
        ring(spark, d)
        .join(p, "neighbour")
        .groupBy("unit", "year")
        .agg(F.avg("x").alias("neighbour_x"), F.count("*").alias("neighbours"))
    )


_SHAPES = """chain as (select s_suppkey as unit, lead(s_suppkey) over (partition by s_nationkey order by s_acctbal, s_suppkey) as nxt
    from supplier)"""


def supplier_shapes(spark, d):
    """A map of suppliers: within a nation, ordered by balance, each borders the next along one arc.

    The arc belongs to the supplier (its key) and, reversed, to its successor.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    prev = F.lag("s_suppkey").over(w)
    arcs = F.array_compact(F.array(F.col("s_suppkey"), F.when(prev.isNotNull(), -prev - 1)))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), arcs.alias("arcs"))


@query(
    "shared_boundary_edges",
    f"with {_SHAPES} select unit, nxt as neighbour from chain where nxt is not null union all "
    "select nxt, unit from chain where nxt is not null",
)
def shared_boundary_edges(spark, d):
    return S.shared_boundary_edges(supplier_shapes(spark, d), "unit", "arcs")


