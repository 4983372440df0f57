"""Complementary designs and residual diagnostics, as compositions of the cross-product core."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comarca.functions.tails import chi2_sf
from comarca.operators.gram import (
    _sandwich,
    _symmetric,
    cluster_meat,
    equations,
    fe_table,
    pairs,
    partial_out,
    period_equations,
    solve_groups,
    total,
    two_way,
    unit_blocks,
    unit_demean,
)
from comarca.operators.inference import permuted
from comarca.operators.replicas import SENT_CELLS, joined_moran, sent_moran
from comarca.session import settle


def residuals(df: DataFrame, y: str, xs: list[str], *, time_effects: bool = True) -> DataFrame:
    """(unit, year, e) of a fixed-effects fit."""
    cols = [y, *xs]
    dev = two_way(df.select("unit", "year", *cols).dropna(subset=cols), cols, time_effects=time_effects)
    return partial_out(dev, [y], xs).select("unit", "year", F.col(y).alias("e"))


def leave_one_out(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(unit, coef of the first regressor) without each unit: totals minus the unit's own products.

    Leaving a unit out changes the period means, so the period equations lose its share as well: with U the unit's
    centred period indicators, (M - UU')^+ acts on what is left as P + PU (I - U'PU)^+ U'P, P being the inverse of
    the whole. P is computed once; units with the same periods share U, and all that a batch has of them are solved
    together, at a cost of their periods squared. Null where the fit without the unit has no solution.
    """
    cols = [y, *xs]
    k = len(cols)
    dev = settle(unit_demean(df.select("unit", "year", *cols).dropna(subset=cols), cols, "unit", []), "leave")
    eq = period_equations(dev.withColumn("_g", F.lit(0)), cols, "unit", "year", ["_g"], None).first()
    times, normal, sums = equations(eq["_cells"])
    at = {t: i for i, t in enumerate(times)}
    flat = dev.agg(F.array(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs(k)])).first()[0]
    gram, inverse = _symmetric(flat, k), np.linalg.pinv(normal, rcond=1e-12)

    @F.pandas_udf(T.DoubleType())
    def without(rows: pd.Series) -> pd.Series:
        alike: dict[tuple, list[int]] = {}
        values = []
        for u, path in enumerate(rows):
            path = sorted(path, key=lambda r: r["year"])
            alike.setdefault(tuple(at[r["year"]] for r in path), []).append(u)
            values.append([r["v"] for r in path])
        out = np.full(len(rows), np.nan)
        for seen, units in alike.items():
            t, v = list(seen), np.array([values[u] for u in units], float)  # units x periods x columns
            centre = np.eye(len(t)) - 1 / len(t)
            bend = np.linalg.pinv(np.eye(len(t)) - centre @ inverse[np.ix_(t, t)] @ centre, rcond=1e-10, hermitian=True)
            s = np.repeat(sums[None], len(units), 0)
            s[:, t] -= v
            held = inverse @ s
            swept = centre @ held[:, t]
            g = gram - v.swapaxes(1, 2) @ v - s.swapaxes(1, 2) @ held - swept.swapaxes(1, 2) @ bend @ swept
            for u, m in zip(units, g, strict=True):
                scale = np.sqrt(np.clip(np.diag(m)[1:], 0, None))
                if (scale > 1e-9 * np.sqrt(np.clip(np.diag(gram)[1:], 0, None))).all():
                    unit = m[1:, 1:] / np.outer(scale, scale)
                    if np.linalg.eigvalsh(unit)[0] > 1e-10:
                        out[u] = np.linalg.solve(unit, m[1:, 0] / scale)[0] / scale[0]
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    path = dev.groupBy("unit").agg(F.collect_list(F.struct("year", F.array(*cols).alias("v"))).alias("path"))
    return path.select("unit", without("path").alias("coef"))


def influence_weights(df: DataFrame, x: str, controls: list[str]) -> DataFrame:
    """Share of each unit in the identifying variation of ``x`` (Aronow and Samii)."""
    cols = [x, *controls]
    dev = partial_out(two_way(df.select("unit", "year", *cols).dropna(), cols), [x], controls)
    own = settle(dev.groupBy("unit").agg(F.sum(F.col(x) * F.col(x)).alias("_ss")), "influence")
    return own.select("unit", (F.col("_ss") / own.agg(F.sum("_ss")).scalar()).alias("weight"))


def identifying_variation(df: DataFrame, x: str, controls: list[str], time_effects: bool = True) -> DataFrame:
    """One row: sample deviations of ``x`` raw, within units, two-way, and after the controls."""
    cols = [x, *controls]
    sample = df.select("unit", "year", *cols).dropna()
    raw = sample.agg(F.stddev_samp(x).alias("sd_raw"), F.count("*").alias("n"))
    within = unit_demean(sample, [x], "unit", []).agg(F.stddev_samp(x).alias("sd_unit"))
    dev = two_way(sample, cols, time_effects=time_effects)
    both = two_way(sample, [x]).agg(F.stddev_samp(x).alias("sd_two_way"))
    last = partial_out(dev, [x], controls).agg(F.stddev_samp(x).alias("sd_identifying"))
    out = raw.withColumns(
        {"sd_unit": within.scalar(), "sd_two_way": both.scalar(), "sd_identifying": last.scalar()}
    )
    share = F.pow(F.col("sd_identifying") / F.col("sd_raw"), F.lit(2))
    return out.withColumn("share_identifying", F.when(F.col("sd_raw") > 0, share))


def cce_pooled(df: DataFrame, y: str, x: str, controls: list[str] | None = None) -> DataFrame:
    """Common correlated effects: period means of y and x with a loading per unit, then pooled.

    Each unit is partialled out on (1, mean y, mean x) by its own small solve inside Spark's grouping;
    units too short for three loadings drop out with NULL loads.
    """
    cols = [y, x, *(controls or [])]
    sample = df.select("unit", "year", *cols).dropna(subset=cols)
    means = sample.groupBy("year").agg(F.avg(y).alias("_my"), F.avg(x).alias("_mx"))
    wide = sample.join(means, "year")
    dev = unit_demean(wide, [*cols, "_my", "_mx"], "unit", [])
    # The same residualisation as for controls, with the unit as the group.
    clean = partial_out(dev, cols, ["_my", "_mx"], group=["unit"]).dropna(subset=cols).withColumn("_g", F.lit(0))
    k = len(cols) - 1
    blocks = settle(unit_blocks(clean, cols, "unit", ["_g"]), "cce")
    fits = solve_groups(blocks, ["_g"], k)
    meat = cluster_meat(blocks, fits, ["_g"], k)
    se = F.sqrt(F.get(_sandwich("inv", "meat"), F.lit(0)) * F.col("units") / (F.col("units") - 1))
    return fits.join(meat, "_g").select(F.col("beta")[0].alias("coef"), se.alias("se"), "n", "units")


def event_dummies(df: DataFrame, exposure: str, years: list[int], reference: int) -> tuple[DataFrame, list[str]]:
    """Exposure times year indicators, all years but the reference."""
    names = {f"ev_{a}": F.col(exposure) * F.when(F.col("year") == a, 1.0).otherwise(0.0) for a in years if a != reference}
    return df.withColumns(names), list(names)


def standardized(df: DataFrame, column: str, name: str) -> DataFrame:
    """(x - mean) / sample deviation over the rows of ``df`` (one row per unit)."""
    stats = df.agg(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))).scalar()
    return df.withColumn("_st", stats).withColumn(name, (F.col(column) - F.col("_st.m")) / F.col("_st.s")).drop("_st")


def moran(
    z: DataFrame, edges: DataFrame, *, value: str = "z", replicas: int = 999, seed: int = 13, scope: list[str] | None = None
) -> DataFrame:
    """(scope, year, i, p, n, expected): spatial autocorrelation with permutation inference.

    ``z`` has (scope..., unit, year, value); ``edges`` has (unit, neighbour, weight). Values are permuted among
    the units observed in the year. The edges are walked once for all replicas: values and edges of up to SENT_CELLS
    numbers are sent to the tasks, larger ones are joined with each unit's values of all replicas in one array.
    """
    keys = [*(scope or []), "year"]
    seen = z.dropna(subset=[value])
    mean = seen.groupBy(*keys).agg(F.avg(value).alias("_m"))
    dev = settle(seen.join(mean, keys).select(*keys, "unit", (F.col(value) - F.col("_m")).alias("v")), "moran")
    base = dev.groupBy(*keys).agg(F.sum(F.col("v") * F.col("v")).alias("ss"), F.count("*").alias("n"))
    if dev.count() + 3 * edges.count() <= SENT_CELLS:
        found = sent_moran(dev, edges, keys, replicas, seed)
    else:
        moved = permuted(dev, "v", "unit", keys, replicas, seed, ["year"]).unionByName(dev.withColumn("r", F.lit(0)))
        listed = F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda s: s["v"])
        found = joined_moran(moved.groupBy(*keys, "unit").agg(listed.alias("vs")), edges, keys, replicas)
    i = F.col("c") / F.nullif("ss", F.lit(0.0))
    scaled = settle(found, "moran-replicas").join(base, keys).withColumn("i", i)
    own = scaled.filter("r = 0").select(*keys, "i", "n")
    hit = F.abs("_i") >= F.abs("i") - 1e-12
    drawn = scaled.filter("r > 0").select(*keys, F.col("i").alias("_i")).join(own, keys)
    p = drawn.groupBy(*keys).agg(((F.count_if(hit) + 1) / (F.count("*") + 1)).alias("p"))
    return own.join(p, keys).withColumn("expected", -1 / (F.col("n") - 1))


def pesaran_cd(e: DataFrame, value: str = "e", min_common: int = 3) -> DataFrame:
    """Cross-section dependence without enumerating pairs of units.

    Units that share an observation pattern are summed: for standardised series the correlations of
    all their pairs follow from the period sums, sum over i, j of r_ij = sum over t of (S_t)(S'_t).
    Only pairs of patterns are formed; a complete panel has one pattern.
    """
    rows = e.dropna(subset=[value])
    shape = rows.groupBy("unit").agg(F.sort_array(F.collect_set("year")).alias("p"))
    base = settle(rows.join(shape, "unit").select("unit", "year", F.col(value).alias("v"), "p"), "cd")
    kinds = settle(base.select("p").distinct(), "patterns")
    seen = kinds.select("p", F.explode("p").alias("year"))
    meets = (
        seen.join(seen.select(F.col("p").alias("q"), "year"), "year")
        .filter(F.array_join("p", ",") <= F.array_join("q", ","))
        .groupBy("p", "q")
        .agg(F.sort_array(F.collect_list("year")).alias("c"))
        .filter(F.size("c") >= min_common)
    )
    meets = settle(meets, "meets")
    uses = meets.select("p", "c").unionByName(meets.select(F.col("q").alias("p"), "c")).distinct()
    cut = base.join(uses, "p").filter(F.array_contains("c", F.col("year")))
    w = Window.partitionBy("unit", "c")
    centred = cut.withColumn("d", F.col("v") - F.avg("v").over(w))
    norm = F.sqrt(F.sum(F.col("d") * F.col("d")).over(w))
    scaled = centred.withColumn("s", F.when(norm > 1e-12, F.col("d") / norm)).dropna(subset=["s"])
    sums = scaled.groupBy("p", "c", "year").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    left = sums.select("p", "c", "year", F.col("s").alias("sp"), F.col("n").alias("np"))
    right = sums.select(F.col("p").alias("q"), "c", "year", F.col("s").alias("sq"), F.col("n").alias("nq"))
    joined = meets.join(left, ["p", "c"]).join(right, ["q", "c", "year"])
    own = F.col("p") == F.col("q")
    per_meet = joined.groupBy("p", "q").agg(
        F.sum(F.col("sp") * F.col("sq")).alias("dot"), F.max("np").alias("np"), F.max("nq").alias("nq")
    )
    rho = per_meet.select(
        F.when(own, (F.col("dot") - F.col("np")) / 2).otherwise(F.col("dot")).alias("rho"),
        F.when(own, F.col("np") * (F.col("np") - 1) / 2).otherwise(F.col("np") * F.col("nq")).alias("pairs"),
    ).agg(F.sum("rho").alias("rho"), F.sum("pairs").cast("long").alias("pairs"))
    n_units = shape.agg(F.count("*")).scalar()
    mean_t = shape.agg(F.avg(F.size("p"))).scalar()
    cd = F.sqrt(2 * F.col("t") / (F.col("n") * (F.col("n") - 1))) * F.col("rho")
    return rho.withColumns({"n": n_units, "t": mean_t}).select(
        cd.alias("cd"), "n", (F.col("rho") / F.nullif("pairs", F.lit(0))).alias("mean_rho"), "pairs"
    )


@F.pandas_udf(T.StructType([T.StructField("b", T.DoubleType()), T.StructField("t", T.DoubleType())]))
def _first_t(m: pd.Series, n: pd.Series, lost: pd.Series) -> pd.DataFrame:
    """Coefficient and classical t of the first regressor from a cross-product triangle."""
    bs, ts = [], []
    for flat, rows, gone in zip(m, n, lost, strict=True):
        size = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
        full = _symmetric(np.asarray(flat, float), size)
        xx, xy = full[1:, 1:], full[1:, 0]
        df = rows - gone
        b = t = None
        scale = np.sqrt(np.clip(np.diag(xx), 0, None))
        if df > 0 and np.all(scale > 0) and np.linalg.eigvalsh(xx / np.outer(scale, scale)).min() > 1e-10:
            inv = np.linalg.inv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
            beta = inv @ xy
            s2 = max(full[0, 0] - beta @ xy, 0.0) / df
            b = float(beta[0])
            t = float(b / np.sqrt(s2 * inv[0, 0])) if s2 > 0 else None
        bs.append(b)
        ts.append(t)
    return pd.DataFrame({"b": bs, "t": ts})


def cadf(df: DataFrame, value: str, time: str = "t") -> DataFrame:
    """(unit, t): augmented unit-root statistic of each complete unit, cross-section means included.

    ``time`` must number the periods consecutively. Units with a gap are left out, as a missing value
    anywhere invalidates the statistic.
    """
    rows = df.dropna(subset=[value]).select("unit", time, F.col(value).alias("v"))
    periods = rows.agg(F.countDistinct(time)).scalar()
    means = rows.groupBy(time).agg(F.avg("v").alias("m"))
    w = Window.partitionBy("unit").orderBy(time)
    lagged = rows.join(means, time).withColumns(
        {
            "dy": F.col("v") - F.lag("v").over(w),
            "y1": F.lag("v").over(w),
            "m1": F.lag("m").over(w),
            "dm": F.col("m") - F.lag("m").over(w),
            "_n": F.count("*").over(Window.partitionBy("unit")),
        }
    )
    full = lagged.filter((F.col("_n") == periods) & (F.col("_n") >= 4)).dropna(subset=["dy"])
    cols = ["dy", "y1", "m1", "dm"]
    dev = unit_demean(full, cols, "unit", [])
    blocks = unit_blocks(dev, cols, "unit", [])
    return blocks.select("unit", _first_t("m", "n", F.lit(4))["t"].alias("t"))


def random_effects(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Random-effects fit with clustered errors; xs without the constant.

    Within and between cross products come from one pass over unit means; the quasi-demeaned fit is a
    second pass. Only matrices of the regressors reach the driver.
    """
    cols = [y, *xs]
    k = len(cols)
    sample = df.select("unit", "year", *cols).dropna(subset=cols)
    w = Window.partitionBy("unit")
    rows = settle(
        sample.withColumns({f"_m_{c}": F.avg(c).over(w) for c in cols}).withColumn("_t", F.count("*").over(w)), "re"
    )

    def gram(frame: DataFrame, exprs: list[Column]) -> tuple[np.ndarray, int]:
        named = frame.select(*[e.alias(f"_{i}") for i, e in enumerate(exprs)])
        size = len(exprs)
        row = named.agg(
            F.array(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i, j in pairs(size)]), F.count("*")
        ).first()
        return _symmetric(row[0], size), row[1]

    within, n = gram(rows, [F.col(c) - F.col(f"_m_{c}") for c in cols])
    means = rows.groupBy("unit").agg(*[F.first(f"_m_{c}").alias(f"_m_{c}") for c in cols], F.first("_t").alias("_t"))
    between, groups = gram(means, [F.col(f"_m_{c}") for c in cols] + [F.lit(1.0)])
    t_bar = groups / means.agg(F.sum(1 / F.col("_t"))).first()[0]

    def rss(m: np.ndarray) -> float:
        beta = np.linalg.pinv(m[1:, 1:]) @ m[1:, 0]
        return float(m[0, 0] - beta @ m[1:, 0])

    n_vars = k  # regressors and the constant
    s2_e = rss(within) / (n - n_vars - groups + 1)
    s2_u = max(0.0, rss(between) / (groups - n_vars) - s2_e / t_bar)
    theta = 1 - F.sqrt(F.lit(s2_e) / (F.col("_t") * F.lit(s2_u) + F.lit(s2_e)))
    quasi = rows.withColumn("_th", theta).select(
        "unit", *[(F.col(c) - F.col("_th") * F.col(f"_m_{c}")).alias(c) for c in cols], (1 - F.col("_th")).alias("const")
    )
    names = [*xs, "const"]
    m, _ = gram(quasi, [F.col(c) for c in [y, *names]])
    inv = np.linalg.inv(m[1:, 1:])
    beta = inv @ m[1:, 0]
    e = F.col(y) - total([F.col(c) * F.lit(float(b)) for c, b in zip(names, beta, strict=True)])
    sc = quasi.groupBy("unit").agg(*[F.sum(F.col(c) * e).alias(c) for c in names])
    meat, _ = gram(sc, [F.col(c) for c in names])
    factor = groups / (groups - 1) * (n - 1) / (n - len(names))
    vcov = factor * inv @ meat @ inv
    return {"names": names, "beta": beta, "vcov": vcov, "n": n, "units": groups, "s2_e": s2_e, "s2_u": s2_u}


def hausman(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Fixed against random effects. With clustered covariances the difference need not be positive
    definite, so the statistic is kept with ``valid`` false; the Mundlak terms are the valid test."""
    row = fe_table(df, y, xs, time_effects=False).first()
    re = random_effects(df, y, xs)
    k = len(xs)
    gap = np.array(row["beta"]) - re["beta"][:k]
    v = np.array(row["vcov"]).reshape(k, k) - re["vcov"][:k, :k]
    stat = float(gap @ np.linalg.pinv(v) @ gap)
    return {"chi2": stat, "df": k, "p": chi2_sf(stat, k) if stat > 0 else 1.0, "n": int(row["n"]), "valid": False}
