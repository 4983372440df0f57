"""Replicas as array algebra: sign vectors and permutations inside tasks, sums of fixed size between them.

A unit stays one row however many replicas there are. Tasks multiply matrices of units by replicas and hand on one
block of sums per RUN replicas, whose size does not depend on the number of units. The draws are the hashes that the
SQL twins use: md5 of seed, replica and keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from comarca.functions.text import draw_hex, hex_to_long

# The six points of the Webb distribution.
WEBB = [-(1.5**0.5), -1.0, -(0.5**0.5), 0.5**0.5, 1.0, 1.5**0.5]
RUN = 64  # replicas whose sums travel as one row
SLICE = 1024  # units that a task multiplies at once
#: Numbers of a panel up to which all of it is sent to the tasks, which then deal the replicas among themselves.
#: Beyond (32 MB) units and their donors meet by joins instead.
SENT_CELLS = 4 << 20

BLOCK = "block int, body binary"


def sign_letters(kind: str, seed: int, replicas: int, unit: Column) -> Column:
    """One letter for each replica of a unit; ``sign_values`` has the weight of every letter."""
    if kind not in ("rademacher", "webb"):
        raise ValueError(f"unknown weights {kind!r}: use rademacher or webb")

    def letter(r: Column) -> Column:
        drawn = draw_hex(seed, r, unit)
        return F.substring(drawn, 1, 1) if kind == "rademacher" else (hex_to_long(drawn) % 6).cast("string")

    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(replicas)), letter), "")


def sign_values(kind: str) -> np.ndarray:
    """Mean-zero, unit-variance weight of each letter."""
    values = np.full(256, -1.0)
    if kind == "webb":
        values[[ord(str(i)) for i in range(6)]] = WEBB
    else:
        values[[ord(c) for c in "02468ace"]] = 1.0
    return values


def _added(rows: DataFrame, replicas: int) -> np.ndarray:
    """The blocks of all tasks summed: one row of numbers for each replica, on the driver."""

    def add(table: pa.Table) -> pa.Table:
        body = np.sum([np.frombuffer(b) for b in table.column("body").to_pylist()], axis=0)
        return table.slice(0, 1).set_column(1, "body", pa.array([body.tobytes()], pa.binary()))

    found = sorted(rows.groupBy("block").applyInArrow(add, BLOCK).collect(), key=lambda r: r["block"])
    if not found:
        return np.zeros((replicas, 0))
    return np.concatenate([np.frombuffer(bytes(r["body"])).reshape(min(RUN, replicas - r["block"] * RUN), -1) for r in found])


def _blocks(total: np.ndarray | None) -> pa.RecordBatch:
    starts = range(0, 0 if total is None else len(total), RUN)
    bodies = [np.ascontiguousarray(total[a : a + RUN], float).tobytes() for a in starts]
    return pa.RecordBatch.from_arrays(
        [pa.array([a // RUN for a in starts], pa.int32()), pa.array(bodies, pa.binary())], names=["block", "body"]
    )


def sums_by_replica(units: DataFrame, kind: str, replicas: int, products: Callable[[dict], np.ndarray]) -> np.ndarray:
    """products(columns) summed over all units, replicas x whatever numbers.

    ``units`` has a column ``signs`` of letters and columns of equally long arrays. products gets slices of units:
    the weights (units x replicas) as ``w`` and every other column as a matrix.
    """
    others = [c for c in units.columns if c != "signs"]
    values = sign_values(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                letters = np.frombuffer("".join(some.column("signs").to_pylist()).encode(), np.uint8)
                held = {"w": values[letters].reshape(some.num_rows, replicas)}
                for c in others:
                    flat = some.column(c).flatten().to_numpy(zero_copy_only=False).astype(float)
                    held[c] = flat.reshape(some.num_rows, -1)
                total = products(held) + (0 if total is None else total)
        yield _blocks(total)

    return _added(units.select("signs", *others).mapInArrow(run, BLOCK), replicas)


# ----------------------------------------------------------------------------------------------- permutations


def hash_order(texts: list[str], seed: int, *parts: object) -> np.ndarray:
    """Positions of the texts by md5 of seed, parts and text."""
    head = "|".join(str(p) for p in (seed, *parts))
    drawn = np.frombuffer(b"".join(hashlib.md5(f"{head}|{t}".encode()).digest() for t in texts), ">u8").reshape(-1, 2)
    return np.lexsort((drawn[:, 1], drawn[:, 0]))


def panel_sums(values: np.ndarray, donated: np.ndarray) -> np.ndarray:
    """All sums that the two-way regression of one replica needs.

    values is units x columns x periods, y first and NaN where a unit is not observed; donated is units x periods,
    the regressor that replaces the second column. Only cells with both take part. The sums are the products of the
    unit-demeaned columns, their period sums and the period equations, so panels with holes are exact.
    """
    z = values.copy()
    z[:, 1] = donated
    seen = ~np.isnan(z).any(1)
    n = np.maximum(seen.sum(1), 1)
    z = np.where(seen[:, None], z, 0.0)
    z = (z - z.sum(2, keepdims=True) / n[:, None, None]) * seen[:, None]
    share = seen / np.sqrt(n)[:, None]
    flat = z.transpose(0, 2, 1).reshape(-1, z.shape[1])
    normal = np.diag(seen.sum(0).astype(float)) - share.T @ share
    return np.concatenate([(flat.T @ flat).ravel(), z.sum(0).ravel(), normal.ravel()])


def panel_coefficient(sums: np.ndarray, k: int, periods: int) -> float:
    """The second column's coefficient in the two-way regression of the first on the others; NaN if there is none."""
    gram, by_period, normal = np.split(sums, [k * k, k * k + k * periods])
    s = by_period.reshape(k, periods)
    gram = gram.reshape(k, k) - s @ np.linalg.pinv(normal.reshape(periods, periods), rcond=1e-12) @ s.T
    xx, xy = gram[1:, 1:], gram[1:, 0]
    scale = np.sqrt(np.clip(np.diag(xx), 0, None))
    if not (scale > 0).all():
        return float("nan")
    unit = xx / np.outer(scale, scale)
    return float(np.linalg.solve(unit, xy / scale)[0] / scale[0]) if np.linalg.eigvalsh(unit)[0] > 1e-10 else float("nan")


def dense(paths: list, times: dict, columns: int) -> np.ndarray:
    """units x columns x periods from lists of (year, values), NaN where nothing is observed."""
    out = np.full((len(paths), columns, len(times)), np.nan)
    for u, path in enumerate(paths):
        for year, values in path:
            out[u, :, times[year]] = values
    return out


def sent_placebo(sample: DataFrame, cols: list[str], mode: str, replicas: int, seed: int) -> list[float]:
    """Placebo coefficients of a panel that is sent to the tasks; each task takes some of the replicas."""
    spark = sample.sparkSession
    rows = sample.select("unit", F.col("unit").cast("string").alias("text"), "year", *cols).orderBy("unit", "year").collect()
    times = {t: i for i, t in enumerate(sorted({r["year"] for r in rows}))}
    texts: dict = {}
    for r in rows:
        texts.setdefault(r["unit"], r["text"])
    at = {u: i for i, u in enumerate(texts)}
    values = np.full((len(at), len(cols), len(times)), np.nan)
    for r in rows:
        values[at[r["unit"]], :, times[r["year"]]] = [r[c] for c in cols]
    sent = spark.sparkContext.broadcast((list(texts.values()), values))
    periods = list(times)

    def moved(r: int, names: list[str], table: np.ndarray) -> np.ndarray:
        x = table[:, 1]
        if mode == "trajectory":
            return x[hash_order(names, seed, r)]
        out = np.full(x.shape, np.nan)
        for j, year in enumerate(periods):
            here = np.flatnonzero(~np.isnan(x[:, j]))
            out[here, j] = x[here[hash_order([names[i] for i in here], seed, r, year)], j]
        return out

    @F.pandas_udf(T.DoubleType())
    def coef(r: pd.Series) -> pd.Series:
        names, table = sent.value
        return pd.Series([panel_coefficient(panel_sums(table, moved(int(i), names, table)), len(cols), len(periods)) for i in r])

    tasks = spark.range(1, replicas + 1, 1, min(replicas, spark.sparkContext.defaultParallelism))
    found = tasks.select(F.col("id").alias("r"), coef("id").alias("c")).collect()
    return [r["c"] for r in sorted(found, key=lambda r: r["r"])]


def joined_placebo(pairs_: DataFrame, cols: list[str], times: list, replicas: int) -> list[float]:
    """Placebo coefficients from rows (r, path, donated): lists of (year, values) and of (year, x)."""
    at = {t: i for i, t in enumerate(times)}
    k = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicas, k * k + k * len(at) + len(at) ** 2))
        for batch in batches:
            r = batch.column(0).to_numpy()
            own = dense([[(p["year"], p["v"]) for p in path] for path in batch.column(1).to_pylist()], at, k)
            given = dense([[(p["year"], p["x"]) for p in path] for path in batch.column(2).to_pylist()], at, 1)[:, 0]
            for i in np.unique(r):
                total[i - 1] += panel_sums(own[r == i], given[r == i])
        yield _blocks(total)

    sums = _added(pairs_.select("r", "path", "donated").mapInArrow(run, BLOCK), replicas)
    return [panel_coefficient(s, k, len(at)) for s in sums]


def sent_moran(values: DataFrame, edges: DataFrame, keys: list[str], replicas: int, seed: int) -> DataFrame:
    """(keys, r, c): the cross product over all edges in every replica, 0 being the observed one, in one look at them.

    values has (keys, unit, v), its last key being the period that enters the hash; edges (unit, neighbour, weight).
    """
    spark = values.sparkSession
    kinds = dict(values.dtypes)
    rows = values.select(*keys, "unit", F.col("unit").cast("string").alias("text"), F.col(keys[-1]).cast("string").alias("when"), "v")
    groups: dict = {}
    for r in rows.orderBy("unit").collect():
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    links = edges.select("unit", "neighbour", "weight").collect()
    tables = []
    for key, held in groups.items():
        at = {r["unit"]: i for i, r in enumerate(held)}
        known = [(at[e["unit"]], at[e["neighbour"]], e["weight"]) for e in links if e["unit"] in at and e["neighbour"] in at]
        if known:
            a, b, w = (np.array(c) for c in zip(*known, strict=True))
            tables.append((key, held[0]["when"], [r["text"] for r in held], np.array([r["v"] for r in held], float), a, b, w.astype(float)))
    sent = spark.sparkContext.broadcast(tables)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "r int", "c double"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame["id"]:
                for key, when, names, v, a, b, w in sent.value:
                    moved = v[hash_order(names, seed, r, when)] if r else v
                    out.append((*key, int(r), float((w * moved[a] * moved[b]).sum())))
            yield pd.DataFrame(out, columns=[*keys, "r", "c"])

    tasks = spark.range(0, replicas + 1, 1, min(replicas + 1, spark.sparkContext.defaultParallelism))
    return tasks.mapInPandas(run, schema)


def joined_moran(spread: DataFrame, edges: DataFrame, keys: list[str], replicas: int) -> DataFrame:
    """(keys, r, c) from rows (keys, unit, vs), vs holding a unit's value in every replica: one join along the edges."""
    other = spread.select(*keys, F.col("unit").alias("neighbour"), F.col("vs").alias("others"))
    met = edges.join(spread, "unit").join(other, [*keys, "neighbour"]).select(*keys, "weight", "vs", "others")
    kinds = dict(met.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "body binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            w = batch.column("weight").to_numpy(zero_copy_only=False)
            a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("vs", "others"))
            found = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            for key in set(found):
                rows = [i for i, f in enumerate(found) if f == key]
                totals[key] = totals.get(key, 0) + (w[rows, None] * a[rows] * b[rows]).sum(0)
        columns = [pa.array([key[i] for key in totals], met_schema.field(k).type) for i, k in enumerate(keys)]
        bodies = pa.array([v.tobytes() for v in totals.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([*columns, bodies], names=[*keys, "body"])

    met_schema = to_arrow_schema(met.schema)

    def add(table: pa.Table) -> pa.Table:
        body = np.sum([np.frombuffer(b) for b in table.column("body").to_pylist()], axis=0)
        return table.slice(0, 1).set_column(len(keys), "body", pa.array([body.tobytes()], pa.binary()))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def numbers(body: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b).tolist() for b in body])

    summed = met.mapInArrow(run, schema).groupBy(*keys).applyInArrow(add, schema)
    return summed.select(*keys, F.posexplode(numbers("body")).alias("r", "c"))
