"""Per-unit forecasts, rolling-origin evaluation and hierarchical reconciliation.

A forecast is long: (unit, origin, model, h, mean, var_level, var_growth). Every origin of a unit is
the row before it, so expanding-window fits are running aggregates over the unit's own series: no
history is copied per origin. Orders with moving-average terms are solved from summed products, one small
row per unit and origin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comarca.functions.tails import normal_ppf, t_two_sided
from comarca.operators.gram import pairs

REFERENCE = "naive"
MIN_TRAIN = 12
MIN_COVERAGE = 0.90
MIN_ORIGINS = 3
# The orders of the published specifications.
ARMA_ORDERS = {"arima_110": (1, 1, 0), "arima_111": (1, 1, 1), "arima_011": (0, 1, 1), "arima_210": (2, 1, 0)}


def _expanding(unit: str, time: str):
    return Window.partitionBy(unit).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)


def require_complete(panel: DataFrame, unit: str, time: str, value: str) -> DataFrame:
    """The panel, whose ``value`` is an error if a unit and period repeats, or if one is absent or has no value.

    Forecasts need a complete panel: a hole is not a zero, and a repeated row would be a level nobody published.
    """
    cells = panel.groupBy(unit, time).agg(F.count("*").alias("_n"), F.count(value).alias("_v"))
    facts = cells.agg(
        (F.countDistinct(unit) * F.countDistinct(time) - F.count_if(F.col("_v") > 0)).alias("holes"),
        F.count_if(F.col("_n") > 1).alias("repeats"),
    )
    state = facts.select(F.struct("holes", "repeats")).scalar()
    told = F.concat(F.lit("the panel has "), state["holes"].cast("string"), F.lit(" holes and "), state["repeats"].cast("string"), F.lit(" repeated rows"))
    kind = dict(panel.dtypes)[value]
    whole = (state["holes"] == 0) & (state["repeats"] == 0)
    return panel.withColumn(value, F.when(whole, F.col(value)).otherwise(F.raise_error(told).cast(kind)))


def training_states(series: DataFrame, value: str = "log_level", unit: str = "unit", time: str = "t") -> DataFrame:
    """One row per unit and origin (= last seen period + 1) with everything simple models need.

    naive and drift use the last level, the last and the mean growth and the growth variance; the
    first-order autoregression on growth is the running regression of growth on its lag.
    """
    w = Window.partitionBy(unit).orderBy(time)
    ex = _expanding(unit, time)
    g = series.withColumn("g", F.col(value) - F.lag(value).over(w)).withColumn("g1", F.lag("g").over(w))
    both = F.col("g").isNotNull() & F.col("g1").isNotNull()
    x, y = F.when(both, F.col("g1")), F.when(both, F.col("g"))
    out = g.withColumns(
        {
            "n_train": F.count(value).over(ex),
            "g_mean": F.avg("g").over(ex),
            "g_var": F.var_samp("g").over(ex),
            "_n": F.count(x).over(ex),
            "_mx": F.avg(x).over(ex),
            "_my": F.avg(y).over(ex),
            "_sxx": F.var_pop(x).over(ex) * F.count(x).over(ex),
            "_syy": F.var_pop(y).over(ex) * F.count(x).over(ex),
            "_sxy": F.covar_pop(y, x).over(ex) * F.count(x).over(ex),
        }
    )
    phi = F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx"))
    out = out.withColumn("phi", phi).withColumn("const", F.col("_my") - F.col("phi") * F.col("_mx"))
    rss = F.greatest(F.col("_syy") - F.col("phi") * F.col("_sxy"), F.lit(0.0))
    return out.withColumn("sigma2", F.when(F.col("_n") > 2, rss / (F.col("_n") - 2))).select(
        unit,
        (F.col(time) + 1).cast("int").alias("origin"),
        F.col(value).alias("last"),
        F.col("g").alias("g_last"),
        "n_train",
        "g_mean",
        "g_var",
        "phi",
        "const",
        "sigma2",
    )


def psi_weights(ar: Column, ma: Column, h: int) -> Column:
    """First ``h`` weights of the moving-average form of an ARMA, as an array."""

    def step(acc: Column, j: Column) -> Column:
        own = F.coalesce(F.get(ma, j - 1), F.lit(0.0))
        lags = F.sequence(F.lit(1), F.greatest(F.least(F.size(ar), j), F.lit(1)))
        past = F.aggregate(
            lags, F.lit(0.0), lambda s, i: s + F.coalesce(F.get(ar, i - 1), F.lit(0.0)) * F.get(acc, j - i)
        )
        return F.concat(acc, F.array(own + past))

    if h == 1:
        return F.array(F.lit(1.0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(h - 1)), F.array(F.lit(1.0)), step)


def psi_variances(psi: Column, sigma2: Column) -> tuple[Column, Column]:
    """(growth, level) variances by step: cumulated squares, and cumulated squares of cumulated weights."""

    def growth(k: Column) -> Column:
        return sigma2 * F.aggregate(F.slice(psi, 1, k), F.lit(0.0), lambda s, v: s + v * v)

    def level(k: Column) -> Column:
        cum = lambda j: F.aggregate(F.slice(psi, 1, j), F.lit(0.0), lambda s, v: s + v)
        return sigma2 * F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda s, j: s + cum(j) * cum(j))

    steps = F.sequence(F.lit(1), F.size(psi))
    return F.transform(steps, growth), F.transform(steps, level)


def simple_forecasts(states: DataFrame, h: int, unit: str = "unit") -> DataFrame:
    """naive, drift and ar1 for steps 1..h; a model that cannot be fitted gives NULL, not an error."""
    k = F.col("h")
    psi = psi_weights(F.array("phi"), F.array(F.lit(0.0)), h)
    vg, vl = psi_variances(psi, F.col("sigma2"))
    fan = states.withColumns({"_vg": vg, "_vl": vl}).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
    path = F.aggregate(
        F.sequence(F.lit(1), k),
        F.struct(F.col("g_last").alias("g"), F.col("last").alias("l")),
        lambda s, _: F.struct(
            (F.col("const") + F.col("phi") * s["g"]).alias("g"),
            (s["l"] + F.col("const") + F.col("phi") * s["g"]).alias("l"),
        ),
    )["l"]

    def row(name: str, mean: Column, level: Column, growth: Column) -> Column:
        return F.struct(
            F.lit(name).alias("model"), mean.alias("mean"), level.alias("var_level"), growth.alias("var_growth")
        )

    rows = F.array(
        row("naive", F.col("last") + F.col("g_last") * k, F.col("g_var") * k, F.col("g_var")),
        row("drift", F.col("last") + F.col("g_mean") * k, F.col("g_var") * k, F.col("g_var")),
        row("ar1", path, F.get("_vl", k - 1), F.get("_vg", k - 1)),
    )
    return fan.select(unit, "origin", "h", "n_train", F.inline(rows))


#: Lags of the first pass of orders with a moving-average term: two more than the order.
LONG = 3
EARLY = LONG + 1  # growth rows before the first one that every order uses
LAGS = LONG + 2  # a row carries its growth and the four before it


def _lag_rows(series: DataFrame, marks: list[int], value: str) -> DataFrame:
    """(unit, t, v, i, level, z): each growth row i = 0, 1, ... with its constant, growths and dummy steps.

    z holds 1, the growths at lags 0 to 4 and the steps of the outlier dummies of this row and the one before.
    """
    w = Window.partitionBy("unit").orderBy("t")
    v, dbl = F.col("v"), lambda c: c.cast("double")
    rows = series.select("unit", "t", F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("g", v - F.lag("v").over(w)).withColumn("i", F.row_number().over(w) - 2)
    rows = rows.withColumns({f"d{j}": dbl(F.col("t") == m) - dbl(F.lag("t").over(w) == m) for j, m in enumerate(marks)})
    steps = [F.col(f"d{j}") for j in range(len(marks))]
    # a missing growth makes every fit that sees it fail; what lies before the series is not used by any
    lagged = lambda c, k: F.when(F.col("i") >= k, F.lag(c, k).over(w) if k else c).otherwise(F.lit(0.0))
    z = F.array(
        F.lit(1.0),
        *[lagged(F.col("g"), k) for k in range(LAGS)],
        *[lagged(d, 0) for d in steps],
        *[lagged(d, 1) for d in steps],
    )
    level = F.array(*[dbl(F.col("t") == m) for m in marks]) if marks else F.lit(None).cast("array<double>")
    return rows.select("unit", "t", "v", "i", level.alias("level"), z.alias("z"))


def _history(series: DataFrame, marks: list[int], origins: list[int] | None, value: str) -> DataFrame:
    """One row per unit and origin: summed products of z over its rows, the first rows, and the last one.

    Rows are summed between two origins and the sums are run over the origins, so no history is copied. The first
    pass of a moving-average fit needs no pass of its own: its residuals are linear in z, so the products of any
    regression on them follow from these sums.
    """
    size = 1 + LAGS + 2 * len(marks)
    rows = _lag_rows(series, marks, value)
    ends = rows.groupBy("unit").agg((F.max("t") + 1).cast("int").alias("end"))
    if origins:
        wanted = F.array(*[F.lit(int(o)) for o in sorted(set(origins))])
        grid = ends.select("unit", F.explode(wanted).alias("origin"))
        rows = rows.withColumn("origin", F.array_min(F.filter(wanted, lambda o: o > F.col("t")))).dropna(subset=["origin"])
    else:
        grid = ends.select("unit", F.col("end").alias("origin"))
        rows = rows.join(grid, "unit")
    late, cells = F.col("i") >= EARLY, pairs(size)
    part = rows.groupBy("unit", "origin").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("v").isNull()).alias("gone"),
        F.array(*[F.sum(F.when(late, F.get("z", F.lit(a)) * F.get("z", F.lit(b))).otherwise(0.0)) for a, b in cells]).alias("m"),
        F.collect_list(F.when(~late & (F.col("i") >= 0), F.struct("i", "z"))).alias("early"),
        F.max(F.struct("i", "v", "level", "z")).alias("last"),
    )
    upto = Window.partitionBy("unit").orderBy("origin").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(c).over(upto)
    return (
        grid.join(part, ["unit", "origin"], "left")
        .select(
            "unit",
            "origin",
            run("n").alias("n"),
            run("gone").alias("gone"),
            F.array(*[run(F.get("m", F.lit(c))) for c in range(len(cells))]).alias("m"),
            F.sort_array(F.flatten(F.collect_list("early").over(upto))).alias("early"),
            F.last("last", True).over(upto).alias("last"),
        )
        .filter((F.col("n") >= MIN_TRAIN))
        .select("unit", "origin", "n", "gone", "m", F.col("early.z").alias("early"), "last")
    )


_NUMBER, _VECTOR = T.DoubleType(), T.ArrayType(T.DoubleType())
FITTED = T.ArrayType(
    T.StructType()
    .add("model", T.StringType())
    .add("const", _NUMBER)
    .add("ar", _VECTOR)
    .add("ma", _VECTOR)
    .add("past", _VECTOR)
    .add("shock", _NUMBER)
    .add("step", _NUMBER)
    .add("sigma2", _NUMBER)
)


def _least_squares(gram: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of y on x, both given as combinations of z, and the residual as a combination of z, per row."""
    xx, xy = x @ gram @ x.swapaxes(1, 2), (x @ gram @ y[..., None])[..., 0]
    scale = np.sqrt(np.clip(np.diagonal(xx, axis1=1, axis2=2), 0, None))
    scale[scale == 0] = 1.0
    inverse = np.linalg.pinv(xx / scale[:, :, None] / scale[:, None, :], rcond=1e-12, hermitian=True)
    b = (inverse @ (xy / scale)[..., None])[..., 0] / scale
    return b, y - (b[:, None, :] @ x)[:, 0]


def _fit_orders(m: np.ndarray, early: np.ndarray, n: np.ndarray, z: np.ndarray, level: np.ndarray) -> list[dict]:
    """Conditional least squares of every order for a batch of rows, with batched matrix algebra."""
    rows, size, marks = len(m), z.shape[1], level.shape[1]
    from_row = {EARLY: np.zeros((rows, size, size))}
    for c, (a, b) in enumerate(pairs(size)):
        from_row[EARLY][:, a, b] = from_row[EARLY][:, b, a] = m[:, c]
    for i in range(EARLY - 1, -1, -1):
        from_row[i] = from_row[i + 1] + early[:, i, :, None] * early[:, i, None, :]
    one = np.broadcast_to(np.eye(size), (rows, size, size))
    now = list(range(1 + LAGS, 1 + LAGS + marks))
    used = (np.diagonal(from_row[0], axis1=1, axis2=2)[:, now] > 0).sum(1)
    y = one[:, 1]
    out = []
    for name, (p, _, q) in ARMA_ORDERS.items():
        start, shocks = p, []
        if q:
            start = EARLY
            b, _ = _least_squares(from_row[LONG], one[:, [0, *range(2, 2 + LONG), *now]], y)
            shock = one[:, 2].copy()  # the first pass's residual of the row before
            shock[:, 0] -= b[:, 0]
            shock[:, 3 : 3 + LONG] -= b[:, 1 : 1 + LONG]
            shock[:, 1 + LAGS + marks :] -= b[:, 1 + LONG :]
            shocks = [shock[:, None]]
        x = np.concatenate([one[:, [0, *range(2, 2 + p)]], *shocks, one[:, now]], axis=1)
        b, e = _least_squares(from_row[start], x, y)
        beta = b[:, 1 + p + q :]
        free = n - 1 - start - (1 + p + q + used)
        rss = np.clip((e[:, None] @ from_row[start] @ e[..., None])[:, 0, 0], 0, None)
        with np.errstate(divide="ignore", invalid="ignore"):
            sigma2 = np.where(free > 0, rss / free, np.nan)
        past = [z[:, 1] - (beta * z[:, now]).sum(1), z[:, 2] - (beta * z[:, 1 + LAGS + marks :]).sum(1)]
        out.append({
            "model": name, "const": b[:, 0], "ar": np.pad(b[:, 1 : 1 + p], ((0, 0), (0, 2 - p))),
            "ma": np.pad(b[:, 1 + p : 1 + p + q], ((0, 0), (0, 1 - q))), "past": np.stack(past, 1),
            "shock": (e * z).sum(1), "step": -(beta * level).sum(1), "sigma2": sigma2,
        })
    return out


@F.pandas_udf(FITTED)
def _arma_fits(m: pd.Series, early: pd.Series, n: pd.Series, z: pd.Series, level: pd.Series, gone: pd.Series) -> pd.Series:
    """The fit of every order, one small row each; NULL values where it cannot be made."""
    table = lambda s: np.array(s.tolist(), float)
    none = [{"model": name} for name in ARMA_ORDERS]
    found: list[list[dict]] = [none] * len(m)
    whole = np.flatnonzero(gone.to_numpy() == 0)
    if len(whole):
        marks = table(level.iloc[whole]) if level.iloc[0] is not None else np.zeros((len(whole), 0))
        fits = _fit_orders(
            table(m.iloc[whole]), np.array([np.stack(e) for e in early.iloc[whole]], float), n.to_numpy()[whole],
            table(z.iloc[whole]), marks,
        )
        for i, at in enumerate(whole):
            made = []
            for fit in fits:
                row = {k: fit[k] if k == "model" else fit[k][i].tolist() for k in fit}
                made.append(row if np.isfinite(np.hstack(list(row.values())[1:])).all() else {"model": fit["model"]})
            found[at] = made
    return pd.Series(found)


def arma_forecasts(
    series: DataFrame, h: int, outliers: list[int], origins: list[int] | None = None, value: str = "log_level"
) -> DataFrame:
    """The four ARIMA specifications with declared-outlier dummies for every origin of every unit.

    Two-pass conditional least squares from summed products: a unit's series stays in rows, only one small row per
    unit and origin is solved. Origins that see fewer than MIN_TRAIN periods have no rows; a fit that cannot be made
    (a missing value in the history, no degrees of freedom) gives NULL.
    """
    known = _history(series, list(outliers), origins, value)
    fits = known.select(
        "unit", "origin", F.col("last.v").alias("v"),
        F.inline(_arma_fits("m", "early", "n", "last.z", "last.level", "gone")),
    )
    psi = psi_weights(F.col("ar"), F.col("ma"), h)
    vg, vl = psi_variances(F.col("psi"), F.col("sigma2"))

    def ahead(s: Column, k: Column) -> Column:
        own = F.get("ar", F.lit(0)) * s["past"][0] + F.get("ar", F.lit(1)) * s["past"][1]
        new = F.col("const") + own + F.get("ma", F.lit(0)) * s["shock"]
        return F.struct(
            F.array(new, s["past"][0]).alias("past"),
            F.lit(0.0).alias("shock"),
            (s["level"] + new + F.when(k == 1, F.col("step")).otherwise(0.0)).alias("level"),
            F.concat(s["path"], F.array(s["level"] + new + F.when(k == 1, F.col("step")).otherwise(0.0))).alias("path"),
        )

    start = F.struct("past", "shock", F.col("v").alias("level"), F.array().cast("array<double>").alias("path"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(h)), start, ahead, lambda s: s["path"])
    fan = fits.withColumn("psi", psi).withColumns({"_vg": vg, "_vl": vl, "_path": path})
    k = F.col("h")
    finite = F.when(~F.isnan(F.get("_path", k - 1)) & ~F.isnan(F.get("_vl", k - 1)), F.lit(True))
    return fan.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h)))).select(
        "unit",
        "origin",
        "model",
        "h",
        F.when(finite, F.get("_path", k - 1)).alias("mean"),
        F.when(finite, F.get("_vl", k - 1)).alias("var_level"),
        F.when(finite, F.get("_vg", k - 1)).alias("var_growth"),
    )


def combine(forecasts: DataFrame, keys: list[str], name: str = "combined") -> DataFrame:
    """Equal mixture of the models that converged: mean, and mean variance plus disagreement."""
    w = Window.partitionBy(*keys, "model").orderBy("h")
    alive = forecasts.filter(F.col("mean").isNotNull())
    step = alive.withColumn("_g", F.col("mean") - F.coalesce(F.lag("mean").over(w), F.lit(0.0)))
    return step.groupBy(*keys, "h").agg(
        F.lit(name).alias("model"),
        F.avg("mean").alias("mean"),
        (F.avg("var_level") + F.var_pop("mean")).alias("var_level"),
        (F.avg("var_growth") + F.var_pop("_g")).alias("var_growth"),
        F.count("*").alias("models"),
    )


def backtest_detail(forecasts: DataFrame, series: DataFrame, h: int, value: str = "log_level") -> DataFrame:
    """Forecast at step ``h`` against the observed value of period origin + h - 1."""
    real = series.select("unit", (F.col("t") - (h - 1)).cast("int").alias("origin"), F.col(value).alias("real"))
    hit = forecasts.filter(F.col("h") == h).join(real, ["unit", "origin"])
    return hit.select(
        "unit",
        "origin",
        "model",
        "real",
        F.col("mean").alias("forecast"),
        F.col("var_level").alias("variance"),
        ((F.col("mean") - F.col("real")) * 100).alias("error"),
    )


def interval_coverage(detail: DataFrame, level: float = 0.80) -> DataFrame:
    """Share of observed values inside the nominal interval; rows without a forecast do not count."""
    z = normal_ppf(0.5 + level / 2)
    inside = F.abs(F.col("real") - F.col("forecast")) <= F.lit(z) * F.sqrt("variance")
    valid = detail.dropna(subset=["forecast", "variance"])
    return valid.groupBy("model").agg(F.avg(inside.cast("double")).alias("coverage"), F.count("*").alias("n"))


def paired(detail: DataFrame, reference: str = REFERENCE) -> DataFrame:
    """Every model's absolute error beside the reference's on the same (unit, origin)."""
    ref = detail.filter(F.col("model") == reference).select("unit", "origin", F.abs("error").alias("_r"))
    return detail.filter(F.col("model") != reference).join(ref, ["unit", "origin"]).select(
        "model", "unit", "origin", F.abs("error").alias("_m"), "_r"
    ).dropna()


def by_origin(pairs: DataFrame) -> DataFrame:
    """One row per model and origin: pairs and sums of absolute errors."""
    return pairs.groupBy("model", "origin").agg(
        F.count("*").alias("_n"), F.sum("_m").alias("_sm"), F.sum("_r").alias("_sr")
    )


def origin_table(per: DataFrame) -> DataFrame:
    """Per model: gain, origins won, best origin, gain without it, and the t of the origin means.

    Units of one origin share its shock, so the test runs on origin means with n - 1 degrees.
    """
    diff = per.withColumn("_d", (F.col("_sm") - F.col("_sr")) / F.col("_n"))
    best = F.min_by(F.struct("origin", "_sm", "_sr", "_n"), F.struct("_d", "origin"))
    agg = diff.groupBy("model").agg(
        F.sum("_n").alias("n"),
        F.sum("_sm").alias("_sm"),
        F.sum("_sr").alias("_sr"),
        F.count("*").alias("origins"),
        F.count_if(F.col("_d") < 0).alias("origins_won"),
        best.alias("_b"),
        F.avg("_d").alias("_md"),
        F.stddev_samp("_d").alias("_sd"),
    )
    gain = F.when(F.col("_sr") > 0, (1 - F.col("_sm") / F.col("_sr")) * 100)
    rest_r = F.col("_sr") - F.col("_b._sr")
    without = F.when((rest_r > 1e-12) & (F.col("n") > F.col("_b._n")), (1 - (F.col("_sm") - F.col("_b._sm")) / rest_r) * 100)
    t = F.when((F.col("origins") >= MIN_ORIGINS) & (F.col("_sd") > 0), F.col("_md") / (F.col("_sd") / F.sqrt("origins")))
    return agg.select(
        "model",
        "n",
        F.when(F.col("n") > 5, gain).alias("gain_pct"),
        "origins",
        "origins_won",
        F.col("_b.origin").alias("best_origin"),
        without.alias("gain_without_best_pct"),
        F.when(F.col("n") > 5, t).alias("dm_t"),
    )


def verdicts(detail: DataFrame, reference: str = REFERENCE) -> DataFrame:
    """Mean absolute error, coverage, gains and the verdict of every model."""
    basic = detail.groupBy("model").agg(
        F.avg(F.abs("error")).alias("mae"), (F.count("error") / F.count("*")).alias("coverage")
    )
    table = basic.join(origin_table(by_origin(paired(detail, reference))), "model", "left")
    good = (
        (F.col("coverage") >= MIN_COVERAGE) & (F.col("gain_pct") > 0) & (F.col("gain_without_best_pct") >= 0)
    )
    return table.withColumn("approved", (F.col("model") == reference) | F.coalesce(good, F.lit(False)))


class QualityGate(RuntimeError):
    """The forecast does not beat the reference and is not published."""


def require_approved(table: DataFrame, model: str) -> None:
    """Raise unless ``model`` passed; the verdict table has one row per model."""
    row = table.filter(F.col("model") == model).select("approved").first()
    if row is None:
        raise QualityGate(f"{model} is not in the backtest")
    if not row["approved"]:
        raise QualityGate(f"{model} does not pass the gate")


def dm_p(table: DataFrame) -> DataFrame:
    """Two-sided p of the origin-mean test."""
    return table.withColumn("dm_p", t_two_sided("dm_t", (F.col("origins") - 1).cast("double")))


def outlier_dummies(df: DataFrame, time: str, marks: list[int]) -> DataFrame:
    return df.withColumns({f"out_{m}": F.when(F.col(time) == m, 1.0).otherwise(0.0) for m in marks})


def _with_totals(base: DataFrame, aggs: dict[str, Column], by: list[str]) -> DataFrame:
    """Totals per step joined back: no task holds all units of a step."""
    totals = base.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return base.join(totals, by)


def reconcile_proportional(base: DataFrame, targets: DataFrame, by: list[str], value: str = "base") -> DataFrame:
    """Spread the gap to the target in proportion to size. Impossible inputs raise.

    ``base`` has (unit, by..., value), ``targets`` (by..., target).
    """
    v = F.col(value)
    sums = _with_totals(base, {"_sum": F.sum(v), "_bad": F.count_if(v.isNull() | F.isnan(v))}, by)
    joined = sums.join(targets, by)
    ok = (F.col("_bad") == 0) & (F.col("_sum") > 0) & F.col("target").isNotNull() & ~F.isnan("target")
    out = F.when(ok, v + (F.col("target") - F.col("_sum")) * v / F.nullif("_sum", F.lit(0.0))).otherwise(
        F.raise_error(F.lit("reconciliation needs finite values, a positive sum and a finite target")).cast("double")
    )
    return joined.withColumn("reconciled", out).drop("_sum", "_bad", "target")


def reconcile_mint_diag(base: DataFrame, targets: DataFrame, by: list[str], value="base", variance="var_level") -> DataFrame:
    """Spread the gap by forecast variance in levels; proportional where no variance is left."""
    v = F.col(value)
    level_var = v * v * F.col(variance)
    sums = _with_totals(
        base,
        {
            "_sum": F.sum(v),
            "_var": F.sum(level_var),
            "_bad": F.count_if(v.isNull() | F.col(variance).isNull() | F.isnan(level_var)),
        },
        by,
    )
    share = F.when(F.col("_var") > 0, level_var / F.nullif("_var", F.lit(0.0))).otherwise(
        v / F.nullif("_sum", F.lit(0.0))
    )
    out = F.when(F.col("_bad") == 0, v + (F.col("target") - F.col("_sum")) * share).otherwise(
        F.raise_error(F.lit("reconciliation received missing values or variances")).cast("double")
    )
    return sums.join(targets, by).withColumn("reconciled", out).drop("_sum", "_var", "_bad", "target")


def anchor_levels(anchor: DataFrame, last_total: Column, years_needed: int) -> DataFrame:
    """Chain every scenario's growth (scenario, step, growth_pct) from the last national total.

    A scenario that does not cover a step raises: a missing year is not zero growth.
    """
    w = Window.partitionBy("scenario").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy("scenario"))
    hole = (n != years_needed) | F.col("growth_pct").isNull() | (F.row_number().over(
        Window.partitionBy("scenario").orderBy("step")) != F.col("step"))
    level = F.when(~hole, last_total * F.exp(F.sum(F.log1p(F.col("growth_pct") / 100)).over(w))).otherwise(
        F.raise_error(F.lit("the anchor does not cover every step")).cast("double")
    )
    return anchor.withColumn("target", level)


def anchor_age(cut: Column, today: Column, limit_months: float = 6.0) -> tuple[Column, Column]:
    """(age in months, expired). A date that cannot be read counts as expired."""
    age = F.datediff(today, cut) / F.lit(365.25 / 12)
    return age, F.coalesce(age > limit_months, F.lit(True))


def interval_width(level_var: Column, growth_var: Column, level: float = 0.80) -> tuple[Column, Column]:
    """Widths of the level and the growth interval, in percentage points."""
    z = 2 * normal_ppf(0.5 + level / 2) * 100
    return F.lit(z) * F.sqrt(level_var), F.lit(z) * F.sqrt(growth_var)
