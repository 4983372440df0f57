"""Projections, filters and scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from comarca.functions import numeric as N
from comarca.functions import text as T
from comarca.plans.base import moves, quarterly, table, units, with_ctes
from comarca.plans.catalog import query
from comarca.sources.seeds import region_variants, seed_values_sql


@query(
    "stage_cast",
    """select o_orderkey::varchar as order_code, cast(o_orderdate as date) as day,
    o_totalprice::double as amount, year(o_orderdate)::varchar || 'Q' || quarter(o_orderdate)::varchar as period_id
    from orders""",
)
def stage_cast(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_code"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_totalprice").cast("double").alias("amount"),
        T.period_id(F.col("o_orderdate"), "Q").alias("period_id"),
    )


@query(
    "zero_to_null",
    """select l_orderkey, l_linenumber, nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax,
    nullif(l_quantity, 0) as l_quantity from lineitem""",
)
def zero_to_null(spark, d):
    rates = ["l_discount", "l_tax", "l_quantity"]
    return (
        table(spark, d, "lineitem")
        .select("l_orderkey", "l_linenumber", *rates)
        .withColumns(N.zero_to_null(rates))
    )


@query(
    "build_geo_key",
    """select o_orderkey, c_nationkey as unit, l_linenumber,
    case when l_linenumber <> 7 then lpad(c_nationkey::varchar, 2, '0') || lpad(l_linenumber::varchar, 3, '0') end as member_key,
    l_linenumber = 7 as is_total
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""",
)
def build_geo_key(spark, d):
    """Line 7 plays the reserved total line."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return lines.join(moves(spark, d).select("orderkey", "unit"), F.col("l_orderkey") == F.col("orderkey")).select(
        F.col("orderkey").alias("o_orderkey"),
        "unit",
        "l_linenumber",
        T.member_key(F.col("unit"), F.col("l_linenumber"), total_line=7).alias("member_key"),
        (F.col("l_linenumber") == 7).alias("is_total"),
    )


_NORMAL = """trim(regexp_replace(translate(upper({c}), 'ÁÉÍÓÚÜÑÀÈÌÒÙÂÊÎÔÛ', 'AEIOUUNAEIOUAEIOU'), '[^A-Z0-9]+', ' ', 'g'))"""


@query("normalize_name", f"select doc_id, {_NORMAL.format(c='text')} as name_key from documents")
def normalize_name(spark, d):
    """Whole document texts are normalised."""
    return table(spark, d, "documents").select("doc_id", T.normalize_name(F.col("text")).alias("name_key"))


def _broken_sql(col: str) -> str:
    out = col
    for points, letter in T.REPAIRS[:7]:
        out = f"replace({out}, '{letter}', {' || '.join(f'chr({p})' for p in points)})"
    return out


def _repaired_sql(col: str) -> str:
    out = col
    for points, letter in T.REPAIRS:
        out = f"replace({out}, {' || '.join(f'chr({p})' for p in points)}, '{letter}')"
    return out


@query(
    "repair_mojibake",
    f"""select doc_id, broken <> text as was_broken, repaired, repaired = {_repaired_sql('text')} as restored
    from (select doc_id, text, broken, {_repaired_sql('broken')} as repaired
          from (select doc_id, text, {_broken_sql('text')} as broken from documents))""",
)
def repair_mojibake(spark, d):
    """Break the accents of every document the way a wrong decoder does, then repair them."""
    broken = F.col("text")
    for points, letter in T.REPAIRS[:7]:
        broken = F.replace(broken, F.lit(letter), F.lit("".join(map(chr, points))))
    docs = table(spark, d, "documents").select("doc_id", "text", broken.alias("broken"))
    return docs.withColumn("repaired", T.repair_text(F.col("broken"))).select(
        "doc_id",
        (F.col("broken") != F.col("text")).alias("was_broken"),
        "repaired",
        (F.col("repaired") == T.repair_text(F.col("text"))).alias("restored"),
    )


@query(
    "period_id",
    """select o_orderkey, year(o_orderdate)::varchar as annual_id,
    year(o_orderdate)::varchar || 'Q' || quarter(o_orderdate)::varchar as quarter_id,
    year(o_orderdate)::varchar || '-' || lpad(month(o_orderdate)::varchar, 2, '0') as month_id from orders""",
)
def period_id(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        T.period_id(day, "A").alias("annual_id"),
        T.period_id(day, "Q").alias("quarter_id"),
        T.period_id(day, "M").alias("month_id"),
    )


@query(
    "simple_case_map",
    """select o_orderkey, case o_orderpriority when '1-URGENT' then 'U' when '2-HIGH' then 'H'
    when '5-LOW' then 'L' else o_orderpriority end as priority_code from orders""",
)
def simple_case_map(spark, d):
    codes = {"1-URGENT": "U", "2-HIGH": "H", "5-LOW": "L"}
    return table(spark, d, "orders").select(
        "o_orderkey", T.recode(F.col("o_orderpriority"), codes).alias("priority_code")
    )


@query(
    "title_case_es",
    """with w as (
        select p_partkey, p_name, upper(p_name) || ' DE LA ' || upper(p_type) || ' D.C.' as raw from part)
    select p_partkey, array_to_string(list_transform(string_split(raw, ' '), lambda w, i:
        case when contains(w, '.') or w in ('-', '(') then w
             when i > 1 and lower(w) in ('de','del','la','las','los','el','y','e','en') then lower(w)
             else upper(w[1:1]) || lower(w[2:]) end), ' ') as title, p_name as untouched from w""",
)
def title_case_es(spark, d):
    raw = F.concat(F.upper("p_name"), F.lit(" DE LA "), F.upper("p_type"), F.lit(" D.C."))
    return table(spark, d, "part").select(
        "p_partkey", T.title_case(raw).alias("title"), T.title_case(F.col("p_name")).alias("untouched")
    )


@query(
    "region_lookup",
    f"""with keys as (select * from (values {seed_values_sql()}) as v(variant, region_id)),
    asked as (select s_suppkey, v.variant as wanted from supplier
              left join keys v on v.region_id = s_nationkey)
    select s_suppkey, wanted, k.region_id from asked left join keys k on k.variant = trim(lower('  ' || upper(wanted)))""",
)
def region_lookup(spark, d):
    """Every supplier asks with each spelling its nation uses, padded and in capitals; some nations have none."""
    variants = region_variants(spark)
    asked = (
        table(spark, d, "supplier")
        .join(variants, F.col("region_id") == F.col("s_nationkey"), "left")
        .select("s_suppkey", F.col("variant").alias("wanted"))
    )
    key = F.trim(F.lower(F.concat(F.lit("  "), F.upper("wanted"))))
    return asked.join(variants, key == F.col("variant"), "left").select("s_suppkey", "wanted", "region_id")


@query(
    "is_distinct",
    """select l_orderkey, l_linenumber, nullif(l_discount, 0) is distinct from nullif(l_tax, 0) as differs
    from lineitem""",
)
def is_distinct(spark, d):
    zero = F.lit(0.0)
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        N.is_distinct(F.nullif("l_discount", zero), F.nullif("l_tax", zero)).alias("differs"),
    )


@query(
    "safe_ratio",
    """select l_orderkey, l_linenumber, case when l_discount > 0 then l_tax * 1e9 / l_discount end as per_head,
    case when l_quantity > 0 then l_extendedprice / l_quantity end as unit_price from lineitem""",
    per_head=2,
    unit_price=6,
)
def safe_ratio(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        N.safe_ratio(F.col("l_tax"), F.col("l_discount"), 1e9).alias("per_head"),
        N.safe_ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
    )


@query(
    "log_positive",
    """select c_custkey, case when c_acctbal > 0 then ln(c_acctbal) end as log_balance,
    ln(1 + abs(c_acctbal)) as log1p_size from customer""",
    log_balance=9,
    log1p_size=9,
)
def log_positive(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey",
        N.log_positive(F.col("c_acctbal")).alias("log_balance"),
        F.log1p(F.abs("c_acctbal")).alias("log1p_size"),
    )


@query(
    "filter_rows",
    """select o_orderkey, o_orderdate::date as day, o_orderpriority from orders
    where year(o_orderdate) between 1996 and 1999 and o_orderpriority not in ('5-LOW', '4-NOT SPECIFIED')
    and o_custkey is not null and o_orderstatus <> 'P'""",
)
def filter_rows(spark, d):
    """The year window is also given as a plain date range, which reaches the Parquet reader."""
    day = F.col("o_orderdate")
    return (
        table(spark, d, "orders")
        .filter((day >= F.lit("1996-01-01").cast("timestamp_ntz")) & (day < F.lit("2000-01-01").cast("timestamp_ntz")))
        .filter(~F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED"))
        .filter(F.col("o_custkey").isNotNull() & (F.col("o_orderstatus") != "P"))
        .select("o_orderkey", F.to_date(day).alias("day"), "o_orderpriority")
    )


@query(
    "pad_codes",
    """select p_partkey, case when length(p_size::varchar) <= 2 then lpad(p_size::varchar, 2, '0') else p_size::varchar end as code2,
    case when length(p_partkey::varchar) <= 5 then lpad(p_partkey::varchar, 5, '0') else p_partkey::varchar end as code5,
    p_retailprice as retail_price from part""",
)
def pad_codes(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        T.pad_code(F.col("p_size"), 2).alias("code2"),
        T.pad_code(F.col("p_partkey"), 5).alias("code5"),
        F.col("p_retailprice").alias("retail_price"),
    )


@query(
    "break_flag",
    with_ctes("q") + "select unit, year, quarter, buyers, year >= 1998 as after_break from q",
)
def break_flag(spark, d):
    return quarterly(spark, d).select(
        "unit", "year", "quarter", "buyers", (F.col("year") >= 1998).alias("after_break")
    )


@query(
    "implied_population",
    with_ctes("moves", "units")
    + """, cap as (select unit, year, sum(amount) as product, sum(amount) / nullif(count(distinct custkey), 0) as per_head
    from moves group by 1, 2) select unit, name, year, product * 1e9 / nullif(per_head, 0) as implied
    from cap join units using (unit)""",
    implied=0,
)
def implied_population(spark, d):
    year = moves(spark, d).groupBy("unit", "year").agg(
        F.sum("amount").alias("product"), F.countDistinct("custkey").alias("buyers")
    )
    per_head = N.ratio_or_null(F.col("product"), F.col("buyers"))
    return (
        year.withColumn("per_head", per_head)
        .join(units(spark, d), "unit")
        .select("unit", "name", "year", N.ratio_or_null(F.col("product") * 1e9, F.col("per_head")).alias("implied"))
    )
