"""The regional panel the queries share, built from the driver tables, and its SQL twins.

units = nations, members = customers, entities = order priorities, periods = quarters and years.
Every function returns a lazy DataFrame; ``with_ctes`` gives the same relations to the oracle.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comarca.functions.numeric import log_positive, safe_ratio
from comarca.operators.annual import annualize_wide

# Fixed values of the analogue: each customer stands for 100 inhabitants; the base year.
INHABITANTS = 100.0
BASE_YEAR = 1996
CONTROLS = ["c1", "c2"]


# Declared schemas: a read with a schema starts no inference job and keeps the types fixed.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


@cache
def _span(application: str, d: str) -> tuple[int, int]:
    days = table(SparkSession.active(), d, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    first = F.year("a") + (F.quarter("a") > 1).cast("int")
    last = F.year("b") - (F.quarter("b") < 4).cast("int")
    row = days.select(first.alias("first"), last.alias("last")).first()
    return (row["first"], row["last"]) if row["first"] is not None else (0, -1)


def span(spark: SparkSession, d: str) -> tuple[int, int]:
    """The first and the last year that the orders cover with all quarters."""
    return _span(spark.sparkContext.applicationId, d)


#: The same two years in the twins.
FIRST_SQL = "(select year(min(o_orderdate)) + (quarter(min(o_orderdate)) > 1)::int from orders)"
LAST_SQL = "(select year(max(o_orderdate)) - (quarter(max(o_orderdate)) < 4)::int from orders)"


def moves(spark: SparkSession, d: str) -> DataFrame:
    """One row per order with its unit (the customer's nation) and period parts."""
    orders = table(spark, d, "orders")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("unit"),
        F.to_date("o_orderdate").alias("day"),
        F.year("o_orderdate").alias("year"),
        F.quarter("o_orderdate").alias("quarter"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderkey").alias("orderkey"),
    )


def member_quarters(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer and quarter with its unit. Orders are summed before they meet the unit.

    The sum combines map-side, so a customer holding a large part of all orders reaches the join as
    one row per quarter, and distinct buyers are a plain count afterwards.
    """
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    member = (
        table(spark, d, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
        .agg(
            F.count("*").alias("orders"),
            F.sum("o_totalprice").alias("amount"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
            F.count_if(F.col("o_orderstatus") == "F").alias("closed"),
        )
    )
    return member.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "unit")


def quarterly(spark: SparkSession, d: str) -> DataFrame:
    """Unit-quarter facts."""
    return (
        member_quarters(spark, d)
        .groupBy("unit", "year", "quarter")
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("amount").alias("amount"),
            F.count("*").alias("buyers"),
            F.sum("urgent").alias("urgent"),
            F.sum("closed").alias("closed"),
        )
    )


def annual(spark: SparkSession, d: str) -> DataFrame:
    """Flows need all four quarters, stocks take the fourth.

    Built from the customer quarters directly: the quarters are bits of a mask and the buyers of the
    fourth quarter a conditional count, so the unit-quarter table need not exist in between.
    """
    return annualize_wide(
        member_quarters(spark, d),
        ["unit", "year"],
        flows=["orders", "amount", "urgent", "closed"],
        counted_stocks=["buyers"],
    )


def population(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "customer")
        .groupBy(F.col("c_nationkey").alias("unit"))
        .agg(F.count("*").alias("customers"))
        .withColumn("pop", F.col("customers") * F.lit(INHABITANTS))
    )


def units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")
    )


def series(spark: SparkSession, d: str) -> DataFrame:
    """The full unit-by-year series with lags, before any window is cut."""
    w = Window.partitionBy("unit").orderBy("year")
    s = (
        annual(spark, d)
        .join(population(spark, d), "unit")
        .join(units(spark, d), "unit")
        .withColumn("log_pc", log_positive(F.col("amount") / F.col("pop")))
    )
    return s.withColumns(
        {
            "x": F.col("orders") * F.lit(100.0) / F.col("pop"),
            "c2": safe_ratio(F.col("urgent"), F.col("orders")),
            "c1": F.lag("log_pc").over(w),
            "amount_lag": F.lag("amount").over(w),
        }
    ).withColumn("y", F.col("log_pc") - F.col("c1"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Estimation frame: growth ``y``, regressor ``x``, controls ``c1`` and ``c2``; all complete rows of all years."""
    return (
        series(spark, d)
        .select(
            "unit", "region", "name", "year", "y", "x", "c1", "c2", "log_pc", "pop", "orders", "amount", "buyers"
        )
        .dropna(subset=["y", "x", "c1", "c2"])
    )


def ring(spark: SparkSession, d: str) -> DataFrame:
    """Directed contiguity edges: inside a region each unit touches its successor, first and last do not.

    The unit with the highest key of each region therefore has one neighbour, inner units have two.
    """
    w = Window.partitionBy("region").orderBy("unit")
    nxt = units(spark, d).select("unit", F.lead("unit").over(w).alias("neighbour")).dropna()
    return nxt.unionByName(nxt.select(F.col("neighbour").alias("unit"), F.col("unit").alias("neighbour")))


# name -> (SQL body, names it needs)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "moves": (
        """select c_nationkey as unit, cast(o_orderdate as date) as day, year(o_orderdate) as year,
        quarter(o_orderdate) as quarter, o_orderstatus as status, o_orderpriority as priority,
        o_totalprice as amount, o_custkey as custkey, o_orderkey as orderkey
        from orders join customer on o_custkey = c_custkey""",
        (),
    ),
    "q": (
        """select unit, year, quarter, count(*) as orders, sum(amount) as amount,
        count(distinct custkey) as buyers, count(*) filter (where priority = '1-URGENT') as urgent,
        count(*) filter (where status = 'F') as closed from moves group by all""",
        ("moves",),
    ),
    "annual": (
        """select unit, year, count(distinct quarter) as quarters,
        cast(case when count(distinct quarter) = 4 then sum(orders) end as bigint) as orders,
        case when count(distinct quarter) = 4 then sum(amount) end as amount,
        cast(case when count(distinct quarter) = 4 then sum(urgent) end as bigint) as urgent,
        cast(case when count(distinct quarter) = 4 then sum(closed) end as bigint) as closed,
        max(case when quarter = 4 then buyers end) as buyers from q group by unit, year""",
        ("q",),
    ),
    "population": (
        "select c_nationkey as unit, count(*) as customers, count(*) * 100.0::double as pop from customer group by 1",
        (),
    ),
    "units": ("select n_nationkey as unit, n_name as name, n_regionkey as region from nation", ()),
    "series": (
        """select *, log_pc - c1 as y from (
        select *, orders * 100.0::double / pop as x, urgent::double / nullif(orders, 0) as c2,
               lag(log_pc) over (partition by unit order by year) as c1,
               lag(amount) over (partition by unit order by year) as amount_lag
        from (select annual.*, customers, pop, name, region,
                     case when amount > 0 then ln(amount / pop) end as log_pc
              from annual join population using (unit) join units using (unit)))""",
        ("annual", "population", "units"),
    ),
    "panel": (
        """select unit, region, name, year, y, x, c1, c2, log_pc, pop, orders, amount, buyers from series
        where y is not null and x is not null and c1 is not null and c2 is not null""",
        ("series",),
    ),
    "ring": (
        """select unit, neighbour from (select unit, lead(unit) over (partition by region order by unit) as neighbour
        from units) where neighbour is not null union all
        select neighbour, unit from (select unit, lead(unit) over (partition by region order by unit) as neighbour
        from units) where neighbour is not null""",
        ("units",),
    ),
    # Two-way deviations, closed form: exact on the balanced panel of the oracle scale.
    "dm": (
        """select unit, region, year, pop,
        y - avg(y) over (partition by unit) - avg(y) over (partition by year) + avg(y) over () as y,
        x - avg(x) over (partition by unit) - avg(x) over (partition by year) + avg(x) over () as x,
        c1 - avg(c1) over (partition by unit) - avg(c1) over (partition by year) + avg(c1) over () as c1,
        c2 - avg(c2) over (partition by unit) - avg(c2) over (partition by year) + avg(c2) over () as c2
        from panel""",
        ("panel",),
    ),
}


def with_ctes(*names: str, extra: dict[str, str] | None = None) -> str:
    """``with a as (...), b as (...)`` holding the named relations and everything they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][1]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} as ({CTES[n][0]})" for n in ordered]
    parts += [f"{n} as ({body})" for n, body in (extra or {}).items()]
    return "with " + ",\n".join(parts) + "\n"
