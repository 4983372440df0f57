"""Sources, sinks, vintages and reshaping on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from comarca.functions.text import recode
from comarca.operators import reshape as R
from comarca.operators.quality import row_count_check
from comarca.plans.base import LAST_SQL, annual, moves, quarterly, span, table, with_ctes
from comarca.plans.catalog import query
from comarca.session import scratch, settle
from comarca.sources import ingest as I
from comarca.sources.seeds import read_seed


@query(
    "scan_partitioned",
    """select o_orderkey, o_totalprice, year(o_orderdate)::varchar as anio from orders
    where year(o_orderdate) between 1997 and 1998""",
)
def scan_partitioned(spark, d):
    """Written by year, read back with two columns and a year predicate that prunes partitions."""
    path = scratch(spark, "orders-by-year")
    I.write_partitioned(table(spark, d, "orders"), path, "o_orderdate")
    kept = I.read_partitioned(spark, path, "o_orderkey long, o_totalprice double")
    return kept.filter(F.col("anio").isin("1997", "1998")).select("o_orderkey", "o_totalprice", "anio")


@query(
    "scan_seed",
    """select lpad(c_custkey::varchar, 8, '0') as code, c_mktsegment as segment, c_nationkey as unit from customer""",
)
def scan_seed(spark, d):
    path = scratch(spark, "seed")
    table(spark, d, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("unit"),
    ).write.option("header", True).csv(path)
    return read_seed(spark, path, "code string, segment string, unit int")


def _pulls(spark, d):
    """Orders tagged by the pull that delivered them: three pulls, later ones newer."""
    digit = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 1)
    pull = F.when(digit < "5", "p1").when(digit < "a", "p2").otherwise("p3")
    return table(spark, d, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_orderpriority").alias("source_id"),
        pull.alias("pull_id"),
        "o_totalprice",
        "o_orderdate",
    )


_PULLS = """pulls as (select o_orderkey, o_custkey, o_orderpriority as source_id,
    case when substr(md5(o_orderkey::varchar), 1, 1) < '5' then 'p1' when substr(md5(o_orderkey::varchar), 1, 1) < 'a' then 'p2'
    else 'p3' end as pull_id, o_totalprice, o_orderdate from orders)"""


def _manifest(spark, d):
    return _pulls(spark, d).groupBy("source_id", "pull_id").agg(
        F.count("*").alias("row_count"),
        F.create_map(F.lit("unit"), F.lit("orders"), F.lit("pull"), F.first("pull_id")).alias("params"),
    )


@query(
    "scan_json_lines",
    f"with {_PULLS} select source_id, pull_id, count(*) as row_count, pull_id as pull_param from pulls group by 1, 2",
)
def scan_json_lines(spark, d):
    path = scratch(spark, "manifest")
    _manifest(spark, d).write.json(path)
    return I.read_manifest(spark, path).select(
        "source_id", "pull_id", "row_count", F.col("params")["pull"].alias("pull_param")
    )


_RAW = """raw as (select l_orderkey::varchar as unit_code, l_linenumber::varchar as line_no,
    case when l_returnflag = 'R' then 's/d' else replace(cast(cast(l_extendedprice as decimal(18, 2)) as varchar), '.', ',') end as val_price,
    cast(cast(l_quantity as bigint) as varchar) as val_qty,
    case when l_linestatus = 'F' then 'sin fecha' else cast(cast(l_shipdate as date) as varchar) end as shipped from lineitem)"""


@query(
    "type_columns",
    f"""with {_RAW} select unit_code, line_no, try_cast(replace(val_price, ',', '.') as double) as val_price,
    try_cast(val_qty as double) as val_qty, try_cast(shipped as date) as shipped from raw""",
)
def type_columns(spark, d):
    """Every line item as text, the way the sources deliver it, typed by metadata."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    raw = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("unit_code"),
        F.col("l_linenumber").cast("string").alias("line_no"),
        F.when(F.col("l_returnflag") == "R", "s/d").otherwise(F.replace(price, F.lit("."), F.lit(","))).alias("val_price"),
        F.col("l_quantity").cast("long").cast("string").alias("val_qty"),
        F.when(F.col("l_linestatus") == "F", "sin fecha")
        .otherwise(F.to_date("l_shipdate").cast("string"))
        .alias("shipped"),
    )
    return I.type_columns(raw, numeric_regex="^val_|_no$", dates=["shipped"], codes=["unit_code", "line_no"])


@query(
    "write_partitioned",
    """select case when o_orderstatus = 'P' then 'sin_fecha' else year(o_orderdate)::varchar end as anio,
    count(*) as n, sum(o_totalprice) as amount from orders group by 1""",
    amount=2,
)
def write_partitioned(spark, d):
    """Orders in status P lose their date: they land in the undated partition, none are dropped."""
    path = scratch(spark, "partitioned")
    day = F.when(F.col("o_orderstatus") == "P", "n/d").otherwise(F.to_date("o_orderdate").cast("string"))
    src = table(spark, d, "orders").select("o_orderkey", "o_totalprice", day.alias("day"))
    I.write_partitioned(src, path, "day")
    kept = I.read_partitioned(spark, path, "o_orderkey long, o_totalprice double, day string")
    return kept.groupBy("anio").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("amount"))


@query(
    "expect_row_count",
    f"""with {_PULLS}, declared as (select source_id, count(*) + case when source_id = '5-LOW' then 1 else 0 end as declared
    from pulls group by 1), loaded as (select source_id, count(*) as loaded from pulls group by 1)
    select source_id, declared, loaded from declared join loaded using (source_id) where declared <> loaded""",
)
def expect_row_count(spark, d):
    """One source declares a row more than it delivered and must be reported."""
    pulls = _pulls(spark, d)
    declared = pulls.groupBy("source_id").agg(F.count("*").alias("n")).select(
        "source_id", (F.col("n") + F.when(F.col("source_id") == "5-LOW", 1).otherwise(0)).alias("declared")
    )
    return row_count_check(pulls, declared, "source_id", "declared")


@query(
    "latest_pull",
    f"""with {_PULLS}, newest as (select source_id, max(pull_id) as pull_id from pulls group by 1)
    select p.o_orderkey, p.source_id, p.pull_id from pulls p join newest using (source_id, pull_id)""",
)
def latest_pull(spark, d):
    return I.latest_pull(_pulls(spark, d), "source_id", "pull_id", "pull_id").select(
        "o_orderkey", "source_id", "pull_id"
    )


@query(
    "current_vintage",
    f"""with {_PULLS} select o_orderkey, source_id, pull_id,
    pull_id = max(pull_id) over (partition by source_id) as is_current from pulls""",
)
def current_vintage(spark, d):
    return I.with_current_flag(_pulls(spark, d), "source_id", "pull_id", "pull_id").select(
        "o_orderkey", "source_id", "pull_id", "is_current"
    )


@query("file_checksum_audit")
def file_checksum_audit(spark, d):
    """Files of a written source against a manifest with one stale hash per year and a lost file."""
    path = scratch(spark, "audited")
    I.write_partitioned(table(spark, d, "orders"), path, "o_orderdate")
    files = I.file_digests(spark, path)
    relative = F.regexp_extract("path", "(anio=.*)$", 1)
    stale = F.col("path").contains("anio=1999")
    manifest = files.select(
        relative.alias("path"),
        F.lit("p1").alias("pull_id"),
        F.when(stale, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"),
    )
    lost = manifest.filter(F.col("path").contains("anio=1995")).withColumn(
        "path", F.concat("path", F.lit(".lost"))
    )
    return I.checksum_audit(spark, manifest.unionByName(lost), path).groupBy("problem").agg(
        F.count("*").alias("files")
    )


@query(
    "load_by_name",
    """select o_orderkey, o_totalprice, o_orderstatus as status, null as channel from orders where o_orderdate < timestamp '1998-01-01'
    union all select o_orderkey, o_totalprice, null, o_orderpriority from orders where o_orderdate >= timestamp '1998-01-01'""",
)
def load_by_name(spark, d):
    """The later files dropped a column, gained one and changed the case of a third."""
    o = table(spark, d, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    early = o.filter(F.col("o_orderdate") < cut).select(
        "o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status")
    )
    late = o.filter(F.col("o_orderdate") >= cut).select(
        F.col("o_orderpriority").alias("channel"), F.col("o_totalprice").alias("O_TOTALPRICE"), "o_orderkey"
    )
    return I.load_by_name(early, late)


@query(
    "variant_long",
    """select event_id, user_id::int as unit, event_type as kind, 'k' as key, regexp_extract(props, '[0-9]+') as val from events
    union all select event_id, user_id::int, event_type, 'channel', 'web' from events""",
)
def variant_long(spark, d):
    """The whole event stream as JSON payloads, known keys typed, the rest as key/value rows."""
    ev = table(spark, d, "events")
    payload = F.to_json(
        F.struct(
            F.col("user_id").alias("unit"),
            F.col("event_type").alias("kind"),
            F.get_json_object("props", "$.k").alias("k"),
            F.lit("web").alias("channel"),
        )
    )
    return I.variant_long(
        ev.select("event_id", payload.alias("payload")), "payload", ["event_id"], {"unit": "int", "kind": "string"}
    )


@query(
    "filename_key",
    "select event_type as folder, count(*) as n, true as named from events group by 1",
)
def filename_key(spark, d):
    """Pull ids read from the path and the name of each file."""
    path = scratch(spark, "events-by-type")
    ev = table(spark, d, "events").select("event_id", "value", F.col("event_type").alias("kind"))
    ev.write.partitionBy("kind").parquet(path)
    read = spark.read.schema("event_id long, value double, kind string").parquet(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "kind=([^/]+)/", 1)
    return (
        read.select("event_id", folder.alias("folder"), I.file_key().alias("name_key"))
        .groupBy("folder")
        .agg(F.count("*").alias("n"), F.min(F.length("name_key") > 0).alias("named"))
    )


_STATUS = f"case when g.yr = {LAST_SQL} then 'provisional' when g.yr = {LAST_SQL} + 1 then 'preliminar' else 'definitivo' end"


def _year_sheet(spark, d):
    """A wide sheet as the sources publish it: one column per year, late years marked p and pr."""
    whole = span(spark, d)[1]  # the last complete year is provisional, what follows preliminary
    marks = {whole: f"{whole}p", whole + 1: f"{whole + 1}pr"}
    label = recode(F.col("year").cast("string"), {str(y): mark for y, mark in marks.items()})
    first, last = moves(spark, d).agg(F.min("year"), F.max("year")).first()
    heads = [marks.get(y, str(y)) for y in range(first, last + 1)] if first else ["none"]
    return moves(spark, d).withColumn("label", label).groupBy("unit").pivot("label", heads).agg(F.sum("amount"))


@query(
    "melt_year_columns",
    with_ctes("moves")
    + f""", grid as (select distinct m.unit, y.yr from (select distinct unit from moves) m, (select unnest(range(min(year), max(year) + 1)) as yr from moves) y)
    select g.unit, g.yr::int as year, {_STATUS} as status, 'amount' as measure, sum(m.amount) as value
    from grid g left join moves m on m.unit = g.unit and m.year = g.yr group by 1, 2, 3""",
    value=2,
)
def melt_year_columns(spark, d):
    return R.melt_year_columns(_year_sheet(spark, d), ["unit"], "amount")


@query(
    "widen_observed",
    with_ctes("moves")
    + """select unit, year, priority, count(*)::double as n, sum(amount) as total, max(amount) as top
    from moves group by all""",
    total=2,
)
def widen_observed(spark, d):
    keys = ["unit", "year", "priority"]
    long = (
        moves(spark, d)
        .groupBy(*keys)
        .agg(
            F.count("*").cast("double").alias("n"),
            F.sum("amount").alias("total"),
            F.max("amount").alias("top"),
        )
        .unpivot(keys, ["n", "total", "top"], "measure", "value")
    )
    return R.widen_observed(long, keys, "measure", "value", ["n", "total", "top"])


@query(
    "layout_by_period",
    """select date_trunc('quarter', l_shipdate)::date as period, count(*) as n, min(l_orderkey) as first_key,
    max(l_orderkey) as last_key from lineitem group by 1""",
)
def layout_by_period(spark, d):
    path = scratch(spark, "layout")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    I.layout_by_period(lines, path, "l_shipdate", "quarter", ["l_suppkey", "l_orderkey"])
    read = spark.read.schema(
        "l_orderkey long, l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, period date"
    ).parquet(path)
    return read.groupBy("period").agg(
        F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key")
    )


@query(
    "export_year_matrix",
    """with member as (select o_custkey as member, year(o_orderdate) as year, count(*)::double as n, sum(o_totalprice) as amount
        from orders group by 1, 2),
    pos as (select member, row_number() over (order by member) - 1 as position from (select distinct member from member)),
    grid as (select p.member, p.position, y.year from pos p, (select distinct year from member) y),
    cells as (select g.*, m.n, m.amount from grid g left join member m using (member, year)),
    long as (select 'n' as indicator, year, position, cast(cast(n as decimal(20, 2)) as varchar) as v from cells
             union all select 'amount', year, position, cast(cast(amount as decimal(20, 2)) as varchar) from cells),
    packed as (select indicator, year, (position // 256)::int as chunk, count(v) as observed,
               string_agg(coalesce(v, 'null'), ',' order by position) as values_text from long group by 1, 2, 3)
    select * from packed where observed > 0""",
)
def export_year_matrix(spark, d):
    """Every customer is a unit: indicator x year matrices in chunks of 256 units."""
    member = (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("member"), F.year("o_orderdate").alias("year"))
        .agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("amount"))
    )
    packed = R.export_year_matrix(member, "member", "year", {"n": 0, "amount": 2}, chunk=256)
    text = F.transform(
        "values", lambda v: F.coalesce(v.cast("decimal(20,2)").cast("string"), F.lit("null"))
    )
    return packed.select(
        "indicator",
        "year",
        "chunk",
        F.size(F.filter("values", lambda v: v.isNotNull())).cast("long").alias("observed"),
        F.array_join(text, ",").alias("values_text"),
    )


@query(
    "attach_projection",
    with_ctes("annual")
    + """select unit, year, amount, null::double as width, false as projected from annual where year <= 2000
    union all select unit, year + 1, amount * 1.02, amount * 0.1, true from annual where year = 2000 and amount is not null""",
    amount=4,
    width=3,
)
def attach_projection(spark, d):
    a = annual(spark, d).select("unit", "year", "amount").filter("year <= 2000")
    ahead = a.filter((F.col("year") == 2000) & F.col("amount").isNotNull()).select(
        "unit", (F.col("year") + 1).alias("year"), (F.col("amount") * 1.02).alias("amount"), (F.col("amount") * 0.1).alias("width")
    )
    joined, _ = R.attach_projection(a.withColumn("width", F.lit(None).cast("double")), ahead, "unit", "year", "width")
    return joined


@query(
    "attach_projection_guard",
    with_ctes("annual")
    + """select 'year_already_observed' as check, '2000' as key union all
    select 'interval_missing', unit::varchar || '/2000' from annual where year = 2000 and buyers < 15""",
)
def attach_projection_guard(spark, d):
    """A projection of an observed year, with some intervals lost: both faults are reported."""
    a = annual(spark, d).select("unit", "year", "amount", "buyers")
    ahead = a.filter("year = 2000").withColumn("width", F.when(~(F.col("buyers") < 15), F.col("amount") * 0.1))
    _, faults = R.attach_projection(a, ahead.filter("buyers < 15 or width is not null"), "unit", "year", "width")
    return faults


_VINTAGE = """v1 as (select unit, year, quarter, amount from q),
    v2 as (select unit, year, quarter, case when year = 2000 and quarter = 2 then amount * 1.01 else amount end as amount
           from q where not (year = 1995 and quarter = 1)
           union all select unit, 2002, 1, amount from q where year = 2001 and quarter = 1)"""


@query(
    "snapshot_diff",
    with_ctes("q")
    + f""", {_VINTAGE} select unit, year, quarter, v1.amount as old_value, v2.amount as new_value
    from v1 full join v2 using (unit, year, quarter) where v1.amount is distinct from v2.amount""",
    old_value=2,
    new_value=4,
)
def snapshot_diff(spark, d):
    # written once: sums of doubles computed anew for the other vintage may differ in their last bits
    v1 = settle(quarterly(spark, d).select("unit", "year", "quarter", "amount"), "vintage")
    revised = F.when((F.col("year") == 2000) & (F.col("quarter") == 2), F.col("amount") * 1.01).otherwise(F.col("amount"))
    v2 = v1.filter("not (year = 1995 and quarter = 1)").withColumn("amount", revised)
    added = v1.filter("year = 2001 and quarter = 1").withColumn("year", F.lit(2002))
    return I.snapshot_diff(v1, v2.unionByName(added), ["unit", "year", "quarter"], "amount")


@query(
    "snapshot_as_of",
    """select o_custkey, o_orderkey, o_orderdate::date as day, o_totalprice from (
    select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r
    from orders where o_orderdate <= timestamp '1998-06-30') where r = 1""",
)
def snapshot_as_of(spark, d):
    """Customer state at a past date: the newest order not later than it, ties by order key."""
    o = table(spark, d, "orders").withColumn("moment", F.struct("o_orderdate", "o_orderkey"))
    at = F.struct(F.lit("1998-06-30").cast("timestamp_ntz").alias("o_orderdate"), F.lit(2**62).alias("o_orderkey"))
    return I.snapshot_as_of(o, ["o_custkey"], "moment", at).select(
        "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice"
    )
