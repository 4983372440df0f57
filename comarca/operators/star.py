"""Star-schema steps: variable maps, dimensions, baselines and contiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comarca.functions.text import normalize_name


def variable_map(variables: DataFrame, sources: dict[str, str]) -> DataFrame:
    """(variable, source, column) from a table with one column-name column per source."""
    long = variables.unpivot("variable", list(sources), "_src", "column").filter(
        F.col("column").isNotNull() & (F.col("column") != "")
    )
    name = F.create_map(*[F.lit(x) for pair in sources.items() for x in pair])
    return long.select("variable", name[F.col("_src")].alias("source"), "column")


def member_dimension(named: DataFrame, *others: DataFrame, key: str, parent: str, flag: str) -> DataFrame:
    """Union of the codes several sources know, with a provenance flag for each source.

    ``named`` and every frame of ``others`` hold (key, parent, name); the first name found wins. One
    aggregation replaces a distinct union followed by a left join per source.
    """
    parts = [p.select(key, parent, "name", F.lit(i).alias("_s")) for i, p in enumerate([named, *others])]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    flags = [F.max((F.col("_s") == i)).alias(f"{flag}_{i}") for i in range(len(parts))]
    name = F.min_by("name", F.when(F.col("name").isNotNull(), F.col("_s")))
    return stacked.groupBy(key, parent).agg(name.alias("name"), *flags).withColumn(
        "name_key", normalize_name(F.col("name"))
    )


def fixed_baseline(df: DataFrame, unit: str, time: str, base, columns: dict[str, str]) -> DataFrame:
    """Each unit's base-period value on all its rows; NULL when the base period is missing."""
    w = Window.partitionBy(unit)
    pick = {new: F.max(F.when(F.col(time) == base, F.col(old))).over(w) for old, new in columns.items()}
    return df.withColumns(pick)


def baseline_coverage(df: DataFrame, unit: str, time: str, base, column: str, least: float = 0.9) -> DataFrame:
    """One row when too few units have the base value."""
    facts = df.agg(
        F.countDistinct(unit).alias("units"),
        F.countDistinct(F.when((F.col(time) == base) & F.col(column).isNotNull(), F.col(unit))).alias("covered"),
    )
    return facts.filter(F.col("covered") < F.lit(least) * F.col("units"))


def arc_id(arc: Column) -> Column:
    """A border runs both ways: a reversed arc is stored as the bitwise complement of its id."""
    return F.when(arc < 0, -arc - 1).otherwise(arc)


#: Holders of one arc up to which its pairs are written out.
CROWD = 64


def boundary_classes(shapes: DataFrame, unit: str, arcs: str, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(edges, members): directed edges over arcs of up to ``crowd`` holders, and the holders of the other arcs.

    In a planar map an arc borders at most two units, so its smallest and largest holder name the edge and no pair is
    ever enumerated. Arcs with a few more (a faulty map) are joined to themselves. An arc with more than ``crowd``
    holders is a class: members has one row (class, unit) per holder, and every two members of a class are
    neighbours, without a row for each of them. Together they lose no edge; ``shared_boundary_edges`` expands the
    classes and ``class_lag`` sums over them without doing so.
    """
    held = shapes.select(unit, F.explode(arcs).alias("_arc")).select(unit, arc_id(F.col("_arc")).alias("_arc")).distinct()
    ends = held.groupBy("_arc").agg(
        F.min(unit).alias("_a"), F.max(unit).alias("_b"), F.count("*").alias("_n")
    )
    planar = ends.filter("_n = 2").select("_a", "_b")
    several = held.join(ends.filter(f"_n > 2 and _n <= {crowd}").select("_arc"), "_arc", "left_semi")
    pairs = planar.unionByName(_pairs(several, "_arc", unit)).distinct()
    members = held.join(ends.filter(f"_n > {crowd}").select("_arc"), "_arc", "left_semi")
    return _both_ways(pairs, unit), members.select(F.col("_arc").alias("class"), unit)


def _pairs(members: DataFrame, by: str, unit: str) -> DataFrame:
    return (
        members.select(by, F.col(unit).alias("_a"))
        .join(members.select(by, F.col(unit).alias("_b")), by)
        .filter("_a < _b")
        .select("_a", "_b")
    )


def _both_ways(pairs: DataFrame, unit: str) -> DataFrame:
    both = F.array(
        F.struct(F.col("_a").alias(unit), F.col("_b").alias("neighbour")),
        F.struct(F.col("_b").alias(unit), F.col("_a").alias("neighbour")),
    )
    return pairs.select(F.inline(both))


def shared_boundary_edges(shapes: DataFrame, unit: str, arcs: str) -> DataFrame:
    """Directed edges between units that share an arc, every pair written out; see ``boundary_classes``."""
    edges, members = boundary_classes(shapes, unit, arcs)
    return edges.unionByName(_both_ways(_pairs(members, "class", unit), unit)).distinct()


def _sets(members: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """(unit, _in): the classes of each unit; (_in, _other): the sets of classes that share one, themselves included.

    Units with the same classes have the same neighbours in them, so sets of classes meet, not units.
    """
    sets = members.groupBy(unit).agg(F.sort_array(F.collect_set("class")).alias("_in"))
    each = sets.select("_in").distinct().select("_in", F.explode("_in").alias("class"))
    met = each.join(each.withColumnRenamed("_in", "_other"), "class").select("_in", "_other").distinct()
    return sets, met


def class_lag(
    panel: DataFrame, edges: DataFrame, members: DataFrame, value: str, name: str, unit: str = "unit", time: str = "year"
) -> DataFrame:
    """(unit, time, name, neighbours): mean over, and number of, the neighbours observed in the period.

    As the mean over the edges of ``shared_boundary_edges``, without a row for the pairs of a class: values are summed
    by set of classes and period, a unit takes its own value off, and an edge between members of a class counts once.
    """
    sets, met = _sets(members, unit)
    seen = panel.select(unit, time, F.col(value).alias("_v")).dropna(subset=["_v"])
    inside = seen.join(sets, unit)
    sums = inside.groupBy("_in", time).agg(F.sum("_v").alias("_s"), F.count("*").alias("_n"))
    around = (
        met.join(sums.withColumnRenamed("_in", "_other"), "_other")
        .groupBy("_in", time)
        .agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    )
    own = inside.select(unit, time, F.col("_v").alias("_own"))
    crowd = sets.join(around, "_in").join(own, [unit, time], "left").select(
        unit, time,
        (F.col("_s") - F.coalesce("_own", F.lit(0.0))).alias("_s"),
        (F.col("_n") - F.col("_own").isNotNull().cast("long")).alias("_n"),
    )
    there = sets.select(F.col(unit).alias("neighbour"), F.col("_in").alias("_there"))
    apart = edges.join(sets, unit, "left").join(there, "neighbour", "left")
    apart = apart.filter(~F.coalesce(F.arrays_overlap("_in", "_there"), F.lit(False))).select(unit, "neighbour")
    single = (
        apart.join(seen.withColumnRenamed(unit, "neighbour"), "neighbour")
        .groupBy(unit, time)
        .agg(F.sum("_v").alias("_s"), F.count("*").alias("_n"))
    )
    both = crowd.unionByName(single).groupBy(unit, time).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("neighbours"))
    return both.filter("neighbours > 0").select(unit, time, (F.col("_s") / F.col("neighbours")).alias(name), "neighbours")


def row_normalized(edges: DataFrame, unit: str = "unit") -> DataFrame:
    """Weights 1/degree; a unit without neighbours has no row, so it gets no invented one."""
    return edges.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy(unit)))


def spatial_lag(panel: DataFrame, edges: DataFrame, value: str, name: str, unit: str = "unit", time: str = "year"):
    """Mean of the neighbours observed in the same period; isolates stay NULL."""
    around = (
        edges.join(panel.select(F.col(unit).alias("neighbour"), time, F.col(value).alias("_v")), "neighbour")
        .groupBy(unit, time)
        .agg(F.avg("_v").alias(name))
    )
    return panel.join(around, [unit, time], "left")
