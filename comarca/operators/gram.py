"""Fixed-effects estimation by cross-product aggregation.

No design matrix is ever built. Unit effects leave by subtracting unit means. Period effects leave by
one exact projection: the (periods x periods) normal equations are aggregated, solved once per group
and joined back, so unbalanced panels need no iteration. Everything after that is sums of products:
one block per unit, from which coefficients, clustered covariances, leave-one-out fits and influence
weights follow.

A *group* is a specification, a replica, a subsample or a region: all groups of a table are estimated
in the same jobs. The solves work on one small row per group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comarca.session import settle

VECTOR = T.ArrayType(T.DoubleType())
#: Periods up to which their normal matrix is built and inverted. Its cells grow with the square, its inverse with the
#: cube of the periods: at 400 these are 160,000 cells and 0.1 s. Beyond, the effects are found by iteration.
EXACT_PERIODS = 400
TOLERANCE, MOST_STEPS = 1e-12, 500
RIDGE = 1e-10  # relative size below which a pivot counts as zero


def complete_cases(df: DataFrame, y: str, xs: list[str], keys: list[str]) -> DataFrame:
    """One explicit estimation sample for all columns of a table."""
    return df.select(*keys, y, *xs).dropna(subset=[y, *xs])


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _symmetric(flat, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for (i, j), v in zip(pairs(k), flat, strict=True):
        m[i, j] = m[j, i] = v
    return m


def _keys(group: list[str], *more: str) -> str:
    return ", ".join([*group, *more])


def _products(cols: list[str], weight: str | None = None, tag: str = "") -> str:
    """SQL for the array of summed products of every pair of ``cols``."""
    w = f"{weight} * " if weight else ""
    return "array(" + ", ".join(f"sum({w}{tag}{cols[i]} * {tag}{cols[j]})" for i, j in pairs(len(cols))) + ")"


def _sums(column: str, size: int) -> str:
    return "array(" + ", ".join(f"sum({column}[{i}])" for i in range(size)) + ")"


def _outer(column: str, size: int) -> str:
    return "array(" + ", ".join(f"sum({column}[{i}] * {column}[{j}])" for i, j in pairs(size)) + ")"


def _unit_mean(column: str, over: str, weight: str | None) -> str:
    if weight is None:
        return f"avg({column}) {over}"
    return f"sum({weight} * {column}) {over} / sum({weight}) {over}"


def unit_demean(df: DataFrame, cols: list[str], unit: str, group: list[str], weight: str | None = None) -> DataFrame:
    rest = [c for c in df.columns if c not in cols]
    over = f"over (partition by {_keys(group, unit)})"
    return df.selectExpr(*rest, *[f"{c} - {_unit_mean(c, over, weight)} as {c}" for c in cols])


def period_equations(df: DataFrame, cols: list[str], unit: str, time: str, group: list[str], weight: str | None):
    """(group, _cells): the period normal equations of each group as cells.

    A cell (a, b, v, null) is an entry of the periods x periods matrix, a cell (a, null, null, s) holds
    the cross products of period a with the unit-demeaned ``cols``. Units with the same observed periods
    share one pattern, so a balanced panel contributes a single one however many units it has. Weights may
    vary from row to row; then each unit brings its own pattern, of as many cells as it has pairs of periods.
    """
    w = weight or "1.0D"
    sums = (
        df.groupBy(*group, time)
        .agg(F.expr("array(" + ", ".join(f"sum({w} * {c})" for c in cols) + ") as s"))
        .selectExpr(*group, f"{time} as a", f"cast(null as {dict(df.dtypes)[time]}) as b", "cast(null as double) as v", "s")
    )
    # (period, weight) lists of the units: equal lists count once, `_k` times
    own = (
        df.groupBy(*group, unit, time)
        .agg(F.expr(f"sum(cast({w} as double)) as _w"))
        .groupBy(*group, unit)
        .agg(F.expr(f"sort_array(collect_list(struct({time} as t, _w as w))) as _times"), F.expr("sum(_w) as _all"))
        .groupBy(*group, "_times", "_all")
        .agg(F.expr("cast(count(*) as double) as _k"))
    )
    normal = (
        own.selectExpr(*group, "_times", "_all", "_k", "explode(_times) as _a")
        .selectExpr(*group, "_a", "_all", "_k", "explode(_times) as _b")
        .groupBy(*group, F.expr("_a.t as a"), F.expr("_b.t as b"))
        .agg(F.expr("sum(_k * (if(_a.t = _b.t, _a.w, 0.0D) - _a.w * _b.w / _all)) as v"))
        .selectExpr(*group, "a", "b", "v", "cast(null as array<double>) as s")
    )
    return sums.unionByName(normal).groupBy(*group).agg(F.expr("collect_list(struct(a, b, v, s)) as _cells"))


def equations(cells) -> tuple[list, np.ndarray, np.ndarray]:
    """(periods, normal matrix, right-hand sides) of one group's cells."""
    right = {c["a"]: np.asarray(c["s"], float) for c in cells if c["s"] is not None}
    times = sorted(right)
    at = {t: i for i, t in enumerate(times)}
    m = np.zeros((len(times), len(times)))
    for c in cells:
        if c["s"] is None:
            m[at[c["a"]], at[c["b"]]] = c["v"]
    return times, m, np.array([right[t] for t in times])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("t", T.LongType()), T.StructField("e", VECTOR)])))
def _period_effects(cells: pd.Series) -> pd.Series:
    """The effect of every period on every column, one row per group."""
    out = []
    for c in cells:
        times, m, rhs = equations(c)
        effects = np.linalg.pinv(m, rcond=1e-12) @ rhs
        out.append([{"t": int(t), "e": e.tolist()} for t, e in zip(times, effects, strict=True)])
    return pd.Series(out)


_STATE = T.StructType([T.StructField(c, VECTOR) for c in ("x", "r", "p", "d", "size")]).add("left", T.DoubleType())


@F.pandas_udf(_STATE)
def _first_state(d: pd.Series, s: pd.Series) -> pd.DataFrame:
    """Conjugate gradients before the first step: no effects, the whole right-hand side left, period by column."""
    rows = []
    for diagonal, sums in zip(d, s, strict=True):
        m, r = np.asarray(diagonal, float), np.array([np.asarray(v, float) for v in sums])
        m = np.where(m > 0, m, 1.0)  # a period seen only by units without another one has no effect of its own
        size = np.sqrt((r * r).sum(0))
        rows.append((np.zeros(r.size).tolist(), r.ravel().tolist(), (r / m[:, None]).ravel().tolist(), m.tolist(), size.tolist(), 1.0))
    return pd.DataFrame(rows, columns=["x", "r", "p", "d", "size", "left"])


@F.pandas_udf(_STATE)
def _next_state(x: pd.Series, r: pd.Series, p: pd.Series, d: pd.Series, size: pd.Series, q: pd.Series) -> pd.DataFrame:
    """One preconditioned step for every column at once; q is the normal matrix times p."""
    rows = []
    for one in zip(x, r, p, d, size, q, strict=True):
        m, norm = np.asarray(one[3], float)[:, None], np.asarray(one[4], float)
        x_, r_, p_, q_ = (np.asarray(v, float).reshape(len(m), -1) for v in (one[0], one[1], one[2], one[5]))
        was, bend = (r_ * r_ / m).sum(0), (p_ * q_).sum(0)
        go = (bend > 0) & (np.sqrt((r_ * r_).sum(0)) > TOLERANCE * norm)
        step = np.divide(was, bend, out=np.zeros_like(was), where=go)
        x_, r_ = x_ + step * p_, r_ - step * q_
        turn = np.divide((r_ * r_ / m).sum(0), was, out=np.zeros_like(was), where=go)
        left = np.divide(np.sqrt((r_ * r_).sum(0)), norm, out=np.zeros_like(was), where=norm > 0).max()
        p_ = r_ / m + turn * p_
        rows.append((*(v.ravel().tolist() for v in (x_, r_, p_)), one[3], one[4], float(left)))
    return pd.DataFrame(rows, columns=["x", "r", "p", "d", "size", "left"])


def iterated_effects(dev: DataFrame, cols: list[str], unit: str, time: str, group: list[str], weight: str | None):
    """(group, time, _e, _periods): the period effects of unit-demeaned ``cols`` without a periods x periods matrix.

    Conjugate gradients, preconditioned by the diagonal, on the equations of ``period_equations``. The matrix times a
    vector needs one aggregation over the units' period lists: a unit subtracts its weighted mean of the vector and
    hands the rest to its periods. Equal lists count once. A group's state is one row of some vectors as long as its
    periods; it is written at every step, and so is the residual that ends the iteration.
    """
    w, k = weight or "1.0D", len(cols)
    sums = dev.groupBy(*group, time).agg(F.expr("array(" + ", ".join(f"sum({w} * {c})" for c in cols) + ") as s"))
    number = Window.partitionBy(*group).orderBy(time)
    sums = settle(sums.withColumn("i", F.row_number().over(number) - 1), "period-sums")
    lists = (
        dev.groupBy(*group, unit, time)
        .agg(F.expr(f"sum(cast({w} as double)) as _w"))
        .join(sums.select(*group, time, "i"), [*group, time])
        .groupBy(*group, unit)
        .agg(F.expr("sort_array(collect_list(struct(i, _w as w))) as _times"), F.expr("sum(_w) as _all"))
        .groupBy(*group, "_times", "_all")
        .agg(F.expr("cast(count(*) as double) as _k"))
    )
    lists = settle(lists, "period-lists")
    diagonal = (
        lists.selectExpr(*group, "_all", "_k", "inline(_times)")
        .groupBy(*group, "i")
        .agg(F.expr("sum(_k * (w - w * w / _all)) as d"))
    )
    start = sums.join(diagonal, [*group, "i"]).groupBy(*group).agg(F.expr("sort_array(collect_list(struct(i, d, s))) as c"))
    state = settle(start.select(*group, _first_state("c.d", "c.s").alias("c")).select(*group, "c.*"), "effects-0")
    mean = ", ".join(f"aggregate(_times, 0.0D, (a, e) -> a + e.w * p[e.i * {k} + {c}]) / _all" for c in range(k))
    moved = ", ".join(f"sum(_k * w * (p[i * {k} + {c}] - _m[{c}]))" for c in range(k))
    for step in range(1, MOST_STEPS + 1):
        product = (
            lists.join(state.select(*group, "p"), group)
            .selectExpr(*group, "_times", "_k", "p", f"array({mean}) as _m")
            .selectExpr(*group, "_k", "p", "_m", "inline(_times)")
            .groupBy(*group, "i")
            .agg(F.expr(f"array({moved}) as q"))
            .groupBy(*group)
            .agg(F.expr("flatten(transform(sort_array(collect_list(struct(i, q))), e -> e.q)) as q"))
        )
        after = state.join(product, group).select(*group, _next_state("x", "r", "p", "d", "size", "q").alias("c"))
        state = settle(after.select(*group, "c.*"), f"effects-{step}")
        left = state.agg(F.max("left")).first()[0]
        if left is None or left <= TOLERANCE:
            break
    else:
        raise ArithmeticError(f"period effects did not converge in {MOST_STEPS} steps: {left:.1e} is left")
    found = state.selectExpr(*group, f"cast(size(x) / {k} as int) as _periods", f"transform(sequence(0, cast(size(x) / {k} as int) - 1), j -> slice(x, j * {k} + 1, {k})) as _x")
    found = found.selectExpr(*group, "_periods", "posexplode(_x) as (i, _e)")
    return found.join(sums.select(*group, time, "i"), [*group, "i"]).select(*group, time, "_e", "_periods")


def _many_periods(df: DataFrame, time: str) -> bool:
    """Whether there are more periods than the exact solve is for. Calendar years are not counted."""
    return time != "year" and df.select(time).distinct().limit(EXACT_PERIODS + 1).count() > EXACT_PERIODS


def two_way(
    df: DataFrame,
    cols: list[str],
    *,
    unit: str = "unit",
    time: str = "year",
    group: list[str] | None = None,
    time_effects: bool = True,
    weight: str | None = None,
    keep_within: bool = False,
    iterate: bool | None = None,
) -> DataFrame:
    """``cols`` replaced by their deviations from unit (and period) effects. Exact for any panel.

    Period effects are solved in one step up to EXACT_PERIODS periods and by iteration beyond, or as ``iterate`` says.
    With ``keep_within`` the deviations from the unit means alone stay beside them as ``_u_<col>``, and
    the number of periods of the group as ``_periods``.
    """
    g = list(group or [])
    if not g:
        df, g = df.withColumn("_g", F.lit(0)), ["_g"]
    dev = unit_demean(df, cols, unit, g, weight)
    rest = [c for c in dev.columns if c not in cols and not (c == "_g" and not group)]
    within = [f"{c} as _u_{c}" for c in cols] if keep_within else []
    if keep_within and time_effects:
        within.append("_periods")
    if not time_effects:
        return dev.selectExpr(*rest, *cols, *within)
    if _many_periods(df, time) if iterate is None else iterate:
        effects = iterated_effects(settle(dev, "within"), cols, unit, time, g, weight)
    else:
        eq = period_equations(dev, cols, unit, time, g, weight)
        solved = eq.select(*g, _period_effects("_cells").alias("_p"))
        effects = solved.selectExpr(*g, "size(_p) as _periods", "inline(_p)").selectExpr(
            *g, f"cast(t as {dict(dev.dtypes)[time]}) as {time}", "e as _e", "_periods"
        )
    over = f"over (partition by {_keys(g, unit)})"
    out = [f"{c} - _e[{i}] + {_unit_mean(f'_e[{i}]', over, weight)} as {c}" for i, c in enumerate(cols)]
    return dev.join(effects, [*g, time]).selectExpr(*rest, *out, *within)


def unit_blocks(
    df: DataFrame, cols: list[str], unit: str, group: list[str], weight: str | None = None, keep_within: bool = False
) -> DataFrame:
    """(group, unit, n, m): the upper triangle of each unit's cross-product matrix of ``cols``."""
    aggs = ["count(*) as n", f"{_products(cols, weight)} as m"]
    if keep_within:
        aggs.append(f"{_products(cols, weight, '_u_')} as u")
    if "_periods" in df.columns:
        aggs.append("first(_periods) as periods")
    return df.groupBy(*group, unit).agg(*[F.expr(a) for a in aggs])


@F.pandas_udf(T.StructType([T.StructField("beta", VECTOR), T.StructField("inv", VECTOR)]))
def _solve(m: pd.Series) -> pd.DataFrame:
    """First variable on the others. Rank-deficient groups give NULL: not estimable is not zero."""
    betas, inverses = [], []
    for flat in m:
        size = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
        full = _symmetric(np.asarray(flat, float), size)
        xx, xy = full[1:, 1:], full[1:, 0]
        scale = np.sqrt(np.clip(np.diag(xx), 0, None))
        ok = np.all(np.isfinite(full)) and np.all(scale > 0)
        if ok:
            unit = xx / np.outer(scale, scale)
            ok = np.linalg.eigvalsh(unit).min() > RIDGE
        if not ok:
            betas.append(None)
            inverses.append(None)
            continue
        inv = np.linalg.inv(unit) / np.outer(scale, scale)
        betas.append((inv @ xy).tolist())
        inverses.append(inv.ravel().tolist())
    return pd.DataFrame({"beta": betas, "inv": inverses})


@F.pandas_udf(VECTOR)
def _sandwich(inv: pd.Series, meat: pd.Series) -> pd.Series:
    """Flattened covariance inv * meat * inv."""
    out = []
    for a, s in zip(inv, meat, strict=True):
        if a is None or s is None:
            out.append(None)
            continue
        k = int(np.sqrt(len(a)))
        m = np.asarray(a, float).reshape(k, k)
        out.append((m @ _symmetric(np.asarray(s, float), k) @ m).ravel().tolist())
    return pd.Series(out)


def solve_groups(blocks: DataFrame, group: list[str], k: int, keep_within: bool = False) -> DataFrame:
    """(group, n, units, m, beta, inv) from unit blocks of [y, x1..xk]."""
    size = len(pairs(k + 1))
    aggs = ["sum(n) as n", "count(*) as units", f"{_sums('m', size)} as m"]
    extra = ["u"] if keep_within else []
    if keep_within:
        aggs.append(f"{_sums('u', size)} as u")
    if "periods" in blocks.columns:
        aggs.append("first(periods) as periods")
        extra.append("periods")
    sums = blocks.groupBy(*group).agg(*[F.expr(a) for a in aggs])
    return sums.withColumn("_s", _solve("m")).selectExpr(*group, "n", "units", "m", *extra, "_s.beta", "_s.inv")


def _score(k: int) -> str:
    """SQL of the unit score X'e from the unit block and the group's coefficients."""
    at = {p: i for i, p in enumerate(pairs(k + 1))}
    rows = [
        f"m[{at[(0, j + 1)]}] - ("
        + " + ".join(f"m[{at[(min(j, i) + 1, max(j, i) + 1)]}] * beta[{i}]" for i in range(k))
        + ")"
        for j in range(k)
    ]
    return "array(" + ", ".join(rows) + ")"


def cluster_meat(blocks: DataFrame, fits: DataFrame, group: list[str], k: int) -> DataFrame:
    scores = blocks.join(fits.select(*group, "beta"), group).selectExpr(*group, f"{_score(k)} as _sc")
    return scores.groupBy(*group).agg(F.expr(f"{_outer('_sc', k)} as meat"))


def _row_scores(dev: DataFrame, fits: DataFrame, y: str, xs: list[str], group: list[str], weight: str | None) -> DataFrame:
    w = f"{weight} * " if weight else ""
    e = f"({y} - (" + " + ".join(f"{x} * beta[{i}]" for i, x in enumerate(xs)) + "))"
    scores = "array(" + ", ".join(f"{w}{x} * {e}" for x in xs) + ") as _sc"
    return dev.join(fits.select(*group, "beta"), group).selectExpr("*", scores)


def hc_meat(dev, fits, y, xs, group, weight=None) -> DataFrame:
    rows = _row_scores(dev, fits, y, xs, group, weight)
    return rows.groupBy(*group).agg(F.expr(f"{_outer('_sc', len(xs))} as meat"))


def driscoll_kraay_meat(dev, fits, y, xs, group, time, bandwidth: int, weight=None) -> DataFrame:
    """Bartlett-weighted products of the period score sums. The period table has one row per period."""
    k = len(xs)
    rows = _row_scores(dev, fits, y, xs, group, weight)
    per = rows.groupBy(*group, time).agg(F.expr(f"{_sums('_sc', k)} as _sc"))
    w = Window.partitionBy(*group).orderBy(time)
    lags = [F.lag("_sc", lag).over(w).alias(f"_l{lag}") for lag in range(1, bandwidth + 1)]
    table = per.select(*group, "_sc", *lags)

    def cell(i: int, j: int) -> str:
        parts = [f"_sc[{i}] * _sc[{j}]"]
        for lag in range(1, bandwidth + 1):
            share = 1 - lag / (bandwidth + 1)
            parts.append(f"{share!r}D * coalesce(_sc[{i}] * _l{lag}[{j}] + _l{lag}[{i}] * _sc[{j}], 0.0D)")
        return "sum(" + " + ".join(parts) + ")"

    return table.groupBy(*group).agg(F.expr("array(" + ", ".join(cell(i, j) for i, j in pairs(k)) + ") as meat"))


def fe_table(
    df: DataFrame,
    y: str,
    xs: list[str],
    *,
    unit: str = "unit",
    time: str = "year",
    group: list[str] | None = None,
    time_effects: bool = True,
    cov: str = "cluster",
    weight: str | None = None,
    bandwidth: int | None = None,
) -> DataFrame:
    """One row per group with coefficients, covariance and sizes.

    Columns: group..., n, units, periods, beta, vcov and inv (flattened k x k), m, r2_within. ``cov`` is
    ``cluster`` (by unit, CR1 with the unit dummies not counted), ``hc`` or ``driscoll-kraay``.
    """
    if cov not in ("cluster", "hc", "driscoll-kraay"):
        raise ValueError(f"unknown covariance {cov!r}: use cluster, hc or driscoll-kraay")
    g = list(group or [])
    base = df if g else df.withColumn("_g", F.lit(0))
    g = g or ["_g"]
    k, cols = len(xs), [y, *xs]
    start = base.select(*g, unit, time, *cols, *([weight] if weight else [])).dropna(subset=cols)
    dev = two_way(
        start, cols, unit=unit, time=time, group=g, time_effects=time_effects, weight=weight, keep_within=True
    )
    if cov != "cluster":
        dev = settle(dev, "deviations")  # read twice: for the products and for the row scores
    # One row per unit from here on. Written once: the fit and its covariance both read it.
    blocks = settle(unit_blocks(dev, cols, unit, g, weight, keep_within=True), "blocks")
    fits = solve_groups(blocks, g, k, keep_within=True)
    if cov == "cluster":
        meat = cluster_meat(blocks, fits, g, k)
    elif cov == "hc":
        meat = hc_meat(dev, fits, y, xs, g, weight)
    else:
        meat = driscoll_kraay_meat(dev, fits, y, xs, g, time, 1 if bandwidth is None else bandwidth, weight)
    if not time_effects:
        fits = fits.join(start.groupBy(*g).agg(F.expr(f"count(distinct {time}) as periods")), g)

    slopes = f"({k} + {'periods' if time_effects else '1'})"  # regressors, constant, period dummies
    if cov == "cluster":
        factor = f"units / (units - 1) * (n - 1) / greatest(n - {slopes}, 1)"
    else:
        factor = f"n / greatest(n - {slopes} - (units - 1), 1)"
    at = {p: i for i, p in enumerate(pairs(k + 1))}
    fitted = " + ".join(f"beta[{j}] * u[{at[(0, j + 1)]}]" for j in range(k))
    square = " + ".join(
        f"beta[{i}] * beta[{j}] * u[{at[(min(i, j) + 1, max(i, j) + 1)]}]" for i in range(k) for j in range(k)
    )
    out = fits.join(meat, g).withColumn("_v", _sandwich("inv", "meat"))
    out = out.selectExpr(
        *g,
        "n",
        "units",
        "cast(periods as bigint) as periods",
        "beta",
        f"transform(_v, v -> v * if(units > 1, {factor}, null)) as vcov",
        "inv",
        "m",
        f"if(u[0] > 0, ((2 * ({fitted})) - ({square})) / u[0], null) as r2_within",
    )
    return out if group else out.drop("_g")


def terms(fits: DataFrame, xs: list[str], group: list[str] | None = None) -> DataFrame:
    """One row per coefficient: term, coef, se, t and the sizes of its fit."""
    k = len(xs)
    rows = ", ".join(f"struct('{x}' as term, beta[{i}] as coef, sqrt(vcov[{i * k + i}]) as se)" for i, x in enumerate(xs))
    out = fits.selectExpr(*(group or []), "n", "units", "periods", "r2_within", f"inline(array({rows}))")
    return out.selectExpr("*", "if(se > 0, coef / se, null) as t")


def fe_fit(df: DataFrame, y: str, xs: list[str], **options) -> DataFrame:
    """``fe_table`` followed by ``terms``."""
    return terms(fe_table(df, y, xs, **options), xs, options.get("group"))


@F.pandas_udf(T.ArrayType(VECTOR))
def _loads(cc: pd.Series, ct: pd.Series) -> pd.Series:
    """Loads of every target on the controls; NULL when the controls are collinear."""
    out = []
    for flat, targets in zip(cc, ct, strict=True):
        rhs = np.array([np.asarray(t, float) for t in targets])
        m = _symmetric(np.asarray(flat, float), rhs.shape[1])
        scale = np.sqrt(np.clip(np.diag(m), 0, None))
        good = np.all(np.isfinite(m)) and np.all(scale > 0)
        if good:
            unit = m / np.outer(scale, scale)
            good = np.linalg.eigvalsh(unit).min() > RIDGE
        out.append((rhs @ (np.linalg.inv(unit) / np.outer(scale, scale))).tolist() if good else None)
    return pd.Series(out)


def partial_out(df: DataFrame, targets: list[str], controls: list[str], group: list[str] | None = None) -> DataFrame:
    """Residualise already demeaned ``targets`` on demeaned ``controls`` (Frisch-Waugh-Lovell)."""
    if not controls:
        return df
    g = list(group or [])
    base, g2 = (df, g) if g else (df.withColumn("_g", F.lit(0)), ["_g"])
    cross = ", ".join("array(" + ", ".join(f"sum({t} * {c})" for c in controls) + ")" for t in targets)
    sums = base.groupBy(*g2).agg(F.expr(f"{_products(controls)} as _cc"), F.expr(f"array({cross}) as _ct"))
    fixed = [c for c in base.columns if c not in targets]
    cleaned = [
        f"{t} - (" + " + ".join(f"_b[{i}][{j}] * {c}" for j, c in enumerate(controls)) + f") as {t}"
        for i, t in enumerate(targets)
    ]
    out = base.join(sums.select(*g2, _loads("_cc", "_ct").alias("_b")), g2).selectExpr(*fixed, *cleaned)
    return out if group else out.drop("_g")
