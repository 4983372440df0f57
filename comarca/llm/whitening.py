"""Whitening of embeddings by spectrum slicing.

Vectors become integers, whose sums and deviations are exact; products of centred vectors are added up per task. The
leading eigenvalues of the covariance V are isolated one by one: LDL' of V - sI, with symmetric pivoting, has as many
positive pivots as V has eigenvalues above s, so bisection on these counts ends at a slice with one eigenvalue.
Rayleigh quotient iteration converges there cubically, and the counts just beside the value found certify its number.
Each component is a row of a Spark job of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm.common import arrow_batches
from comarca.session import settle

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LARGEST = float(1 << 62)  # entries beyond it, scaled, count as this large
#: Shares of the trace: eigenvalues up to FLAT are no variance; values closer than CLOSE are sliced off together.
FLAT, CLOSE = 1e-10, 1e-9
CELLS = 4 << 20  # of the covariances that are worked on at a time

SUMS = "dim int, i int, n long, total decimal(38,0)"
PRODUCTS = "dim int, i int, body binary"
FOUND = "dim int, component int, value double, vector array<double>, above long, level long"
WHITE = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integers): the valid vectors of a batch of (vec_id, embedding as doubles), by length."""
    ids, lists = batch.column(0), batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        values = flat[starts[rows][:, None] + np.arange(size)]
        valid = np.isfinite(values).all(1)
        if valid.any():
            scaled = np.clip(np.floor(values[valid] * SCALE), -LARGEST, LARGEST)
            yield ids.take(pa.array(rows[valid])), scaled.astype(np.int64) + SHIFT


def _table(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(),
             "decimal(38,0)": pa.decimal128(38, 0), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def exact_sum(x: np.ndarray) -> list[int]:
    """Column sums without overflow."""
    if len(x) * float(np.abs(x).max()) < 2.0**62:
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def sums_of(vectors: DataFrame) -> DataFrame:
    """dim, i, n, total: exact sums of the integers for each length of vectors and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for ids, x in blocks(batch):
                n, total = totals.get(x.shape[1], (0, [0] * x.shape[1]))
                totals[x.shape[1]] = (n + len(ids), [a + b for a, b in zip(total, exact_sum(x), strict=True)])
        rows = [(d, i, n, Decimal(s)) for d, (n, total) in totals.items() for i, s in enumerate(total)]
        yield _table(list(zip(*rows, strict=True)) if rows else [[]] * 4, SUMS)

    partial = vectors.mapInArrow(run, SUMS)
    return partial.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))


class Fit:
    """The fit list of one length: n vectors, whole parts and remainders of their means, later the components."""

    def __init__(self, n: int, totals: list[int]):
        self.n = n
        self.whole = np.array([t // n for t in totals], np.int64)
        self.rest = np.array([t % n for t in totals], np.int64)
        self.values = self.vectors = self.explained = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None where one does not fit into 64 bits."""
        y = x - self.whole
        peak = float(np.abs(y).max()) + 1
        if x.shape[1] * (self.n * peak) ** 2 < 2.0**62:
            return ((self.n * y - self.rest) ** 2).sum(1).tolist()
        found = ((self.n * y.astype(object) - self.rest) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in found]


def _added(vectors: DataFrame, fits, values) -> dict[int, np.ndarray]:
    """Products of values(fit, x) summed over all rows, for each length: k x k numbers each, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _ids, x in blocks(batch):
                fit = fits.value.get(x.shape[1])
                if fit is not None:
                    y = values(fit, x)
                    held[x.shape[1]] = held.get(x.shape[1], 0) + y.T @ y
        rows = [(d, i, row.tobytes()) for d, square in held.items() for i, row in enumerate(square)]
        yield _table(list(zip(*rows, strict=True)) if rows else [[]] * 3, PRODUCTS)

    def add(table: pa.Table) -> pa.Table:
        body = np.frombuffer(b"".join(table.column("body").to_pylist())).reshape(table.num_rows, -1).sum(0)
        return table.slice(0, 1).set_column(2, "body", pa.array([body.tobytes()], pa.binary()))

    rows = vectors.mapInArrow(run, PRODUCTS).groupBy("dim", "i").applyInArrow(add, PRODUCTS).collect()
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["i"])):
        found.setdefault(r["dim"], []).append(np.frombuffer(bytes(r["body"])))
    return {dim: np.array(square) for dim, square in found.items()}


# ------------------------------------------------------------------------------------------------------ slicing

ALPHA = (1 + 17**0.5) / 8  # balances the growth of one-by-one and two-by-two pivots


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric v exceed shift: the positive pivots of LDL' of v - shift I.

    A two-by-two pivot is taken where no single one is large enough; it has one eigenvalue of each sign.
    """
    a = v - shift * np.eye(len(v))
    positive = 0
    while len(a):
        column = np.abs(a[1:, 0])
        r = 1 + int(column.argmax()) if len(column) else 0
        largest = float(column[r - 1]) if r else 0.0
        if r and abs(a[0, 0]) < ALPHA * largest:
            row = np.abs(a[r])
            row[r] = 0
            peak = float(row.max())
            if abs(a[0, 0]) * peak < ALPHA * largest**2:
                pair = abs(a[r, r]) < ALPHA * peak
                swap = np.arange(len(a))
                at = 1 if pair else 0
                swap[[at, r]] = swap[[r, at]]
                a = a[np.ix_(swap, swap)]
                if pair:
                    side = a[2:, :2]
                    a = a[2:, 2:] - side @ np.linalg.solve(a[:2, :2], side.T)
                    positive += 1
                    continue
        pivot = a[0, 0]
        positive += int(pivot > 0)
        a = a[1:, 1:] if pivot == 0 else a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:] / pivot)
    return positive


def solve(v: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    for turn in range(4):
        try:
            found = np.linalg.solve(v - (shift + turn * 1e-15) * np.eye(len(v)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    return right


def rayleigh(v: np.ndarray, start: float, x: np.ndarray) -> tuple[float, np.ndarray, float]:
    """An eigenvalue near start, its unit vector and the residual, by Rayleigh quotient iteration."""
    for _ in range(2):
        x = solve(v, start, x)
        x /= np.linalg.norm(x)
    best = (np.inf, start, x)
    for _ in range(12):
        value = float(x @ v @ x)
        residual = float(np.linalg.norm(v @ x - value * x))
        if residual >= best[0] / 2:
            break
        best = (residual, value, x)
        x = solve(v, value, x)
        x /= np.linalg.norm(x)
    return best[1], best[2], best[0]


def together(v: np.ndarray, high: float, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and orthonormal vectors, by falling value, of the eigenvalues first to last that lie just below high."""
    block = np.random.default_rng(first).standard_normal((len(v), last - first + 1))
    for _ in range(60):
        block = np.linalg.qr(solve(v, high + CLOSE, block))[0]
        values, turn = np.linalg.eigh(block.T @ v @ block)  # within the slice only
        block = block @ turn
        if np.linalg.norm(v @ block - block * values, axis=0).max() < 1e-14:
            break
    return values[::-1], block[:, ::-1]


def component(v: np.ndarray, number: int) -> tuple[float, np.ndarray, int, int] | None:
    """(value, unit vector, count above it, count from it on): the eigenvalue of v with that number, from the top.

    v has trace 1. The two counts are taken just above and just below the value (of the whole slice where values are
    too close to be told apart): number lies above the first and up to the second. None if the value is no variance.
    """
    low, high = FLAT, 1 + CLOSE
    over_low, over_high = above(v, low), 0
    if over_low < number:
        return None
    rng = np.random.default_rng(number)
    sure = 64 * len(v) * np.finfo(float).eps
    while high - low > CLOSE:
        if over_low - over_high == 1:
            value, x, residual = rayleigh(v, (low + high) / 2, rng.standard_normal(len(v)))
            beside = max(4 * residual, sure)
            if low < value <= high and residual <= sure:
                counts = above(v, value + beside), above(v, value - beside)
                if counts == (number - 1, number):
                    return value, _turned(x), *counts
        middle = (low + high) / 2
        over = above(v, middle)
        if over >= number:
            low, over_low = middle, over
        else:
            high, over_high = middle, over
    values, vectors = together(v, high, over_high + 1, over_low)
    at = number - over_high - 1
    return float(values[at]), _turned(vectors[:, at]), over_high, over_low


def _turned(x: np.ndarray) -> np.ndarray:
    """One of the two signs: the largest entry is positive."""
    return x * np.sign(x[np.abs(x).argmax()])


def components(spark: SparkSession, covariances: dict[int, np.ndarray], most: int) -> dict[int, list]:
    """The components of each length by number: (value, vector), found by one task row each."""
    scaled = {dim: v / np.trace(v) for dim, v in covariances.items() if np.trace(v) > 0}
    asked = [(dim, k) for dim in scaled for k in range(1, min(most, dim) + 1)]
    if not asked:
        return {}
    sent = spark.sparkContext.broadcast(scaled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for dim, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = component(sent.value[dim], number)
                if found:
                    value, x, over, level = found
                    rows.append((dim, number, value, x.tolist(), over, level))
            yield _table(list(zip(*rows, strict=True)) if rows else [[]] * 6, FOUND)

    tasks = spark.createDataFrame(asked, "dim int, component int").repartition(min(64, len(asked)))
    found: dict[int, list] = {}
    for r in sorted(tasks.mapInArrow(run, FOUND).collect(), key=lambda r: (r["dim"], r["component"])):
        if not r["above"] < r["component"] <= r["level"]:
            raise ArithmeticError("a component's number is not certified")
        found.setdefault(r["dim"], []).append((r["value"] * np.trace(covariances[r["dim"]]), np.array(r["vector"])))
    return found


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every valid vector.

    vectors has vec_id and embedding. Vectors that are null, empty or hold null or non-finite entries are left out;
    vectors of another length are a fit list of their own. Repeated rows and rows without a vec_id count and stay.
    An entry becomes floor(64 c) + 1000000, at most 2^62 in size before the shift. Components whose eigenvalue is at
    most 1e-10 of the trace have no variance to divide by and no rows, so a list of equal vectors has none; of equal
    eigenvalues any orthonormal vectors are taken. A deviation beyond 64 bits is null. What is sent to the tasks is
    at most CELLS numbers at a time (or one length), whatever the rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    sums = settle(sums_of(vectors), "sums")
    dims, parts = [r["dim"] for r in sums.select("dim").distinct().orderBy("dim").collect()], []
    while dims:
        some = [dims.pop(0)]
        while dims and sum(d * d for d in some) + dims[0] ** 2 <= CELLS:
            some.append(dims.pop(0))
        parts.append(_white(vectors, sums.where(F.col("dim").isin(some)), most))
    if not parts:
        return spark.createDataFrame([], WHITE)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def _white(vectors: DataFrame, sums: DataFrame, most: int) -> DataFrame:
    spark = vectors.sparkSession
    totals: dict[int, list] = {}
    for r in sums.orderBy("dim", "i").collect():
        totals.setdefault(r["dim"], []).append((r["n"], int(r["total"])))
    fits = {dim: Fit(t[0][0], [s for _, s in t]) for dim, t in totals.items()}
    squares = _added(vectors, spark.sparkContext.broadcast(fits), Fit.centred)
    covariances = {dim: (square + square.T) / 2 / fits[dim].n for dim, square in squares.items()}
    found = components(spark, covariances, most)
    for dim, parts in found.items():
        fits[dim].values = np.array([value for value, _ in parts])
        fits[dim].vectors = np.array([x for _, x in parts]).T
        fits[dim].explained = fits[dim].values / np.trace(covariances[dim])
    fits = {dim: fits[dim] for dim in found}
    sent = spark.sparkContext.broadcast(fits)
    # whitened values are projections of centred vectors, so their products need no centring
    again = _added(vectors, sent, Fit.whitened) if fits else {}
    errors = {dim: float(np.abs(square / fits[dim].n - np.eye(len(square))).max()) for dim, square in again.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in blocks(batch):
                fit = sent.value.get(x.shape[1])
                if fit is None:
                    continue
                k, rows = len(fit.values), np.repeat(np.arange(len(x)), len(fit.values))
                yield _table(
                    [
                        ids.take(pa.array(rows)),
                        np.tile(np.arange(1, k + 1), len(x)),
                        np.full(len(rows), fit.n),
                        pa.array(fit.deviations(x), pa.int64()).take(pa.array(rows)),
                        fit.whitened(x).ravel(),
                        np.tile(fit.explained, len(x)),
                        np.full(len(rows), errors[x.shape[1]]),
                    ],
                    WHITE,
                )

    return vectors.mapInArrow(run, WHITE)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
