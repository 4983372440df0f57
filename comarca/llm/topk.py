"""Exact top-k inner-product search with vector-approximation files.

Vectors become integers. An index has two tables in the shared folder: `cells`, blocks of vectors with the number
of the cell that every component falls into, six bits each, and the edges of the cells; and `exact`, the vectors
themselves. A search scans the cells alone: they bound each score from below and above, and whatever lies above
the k-th lower bound stays a candidate. Exact vectors are then fetched for candidates from the highest bound
down, until the k-th exact score is above everything that the bounds still allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comarca.llm.common import arrow_batches
from comarca.session import scratch, settle

SCALE = 1024
K = 10
BITS = 6  # of a component's cell number
QUERY_BYTES = 16 << 20  # queries sent to the tasks at a time; more take further passes over the cells
FIRST = 2  # exact vectors first read for a query, in multiples of k
EXACT = float(1 << 53)  # sums of products below this are exact in double precision
DIGITS = 700  # of the largest score that finite doubles can have, and some to spare

VECTORS = "vec_id long, dim int, peak double, body binary"
CELLS = "dim int, ids binary, rows binary, low binary, width binary, codes binary"
BOUNDS = "query long, row long, lower double, upper double"


def packed(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim, peak (largest magnitude) and the integers floor(scale * x), as doubles, of valid vectors.

    Vectors that are null, empty or hold null or non-finite components, and rows without an id, are left out; so
    are those with a component that times scale is no finite double.
    """
    arrow_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = vector.values
                if values is None or not len(values) or values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    whole = np.floor(np.asarray(values.to_numpy(zero_copy_only=False), np.float64) * scale)
                if not np.isfinite(whole).all():
                    continue
                rows.append((vec_id, len(whole), float(np.abs(whole).max()), whole.astype("<f8").tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["vec_id", "dim", "peak", "body"]
            )

    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null")
    return rows.mapInArrow(run, VECTORS)


# ------------------------------------------------------------------------------------------------------ cells


def cells_of(vectors: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, width, codes): cells of equal width in each dimension of a block; cell c is [low + c w, low + (c+1) w]."""
    low, high = vectors.min(0), vectors.max(0)
    n = 1 << bits
    width = np.maximum(high / n - low / n, np.finfo(np.float64).tiny)
    with np.errstate(over="ignore", invalid="ignore"):
        place = np.floor((vectors - low) / width)
    return low, width, np.clip(np.nan_to_num(place, nan=0.0), 0, n - 1).astype(np.uint8)


def pack(codes: np.ndarray, bits: int = BITS) -> bytes:
    return np.packbits(np.unpackbits(codes[..., None], axis=2)[..., 8 - bits :].reshape(len(codes), -1), axis=1).tobytes()


def unpack(codes: bytes, n: int, dim: int, bits: int = BITS) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(codes, np.uint8).reshape(n, -1), axis=1)[:, : dim * bits].reshape(n, dim, bits)
    return flat @ (1 << np.arange(bits - 1, -1, -1))


def bounds_of(queries: np.ndarray, low: np.ndarray, width: np.ndarray, codes: np.ndarray):
    """(lower, upper): between them lies the score of every query with every vector in the cells, rounding included."""
    floor, ceiling = low + codes * width, low + (codes + 1) * width
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        upper = up @ ceiling.T + down @ floor.T
        lower = up @ floor.T + down @ ceiling.T
        reach = np.maximum(np.abs(floor), np.abs(ceiling)).max(1)
        slack = 1e-12 * queries.shape[1] * np.abs(queries).max(1)[:, None] * reach[None, :]
        return np.nan_to_num(lower - slack, nan=-np.inf), np.nan_to_num(upper + slack, nan=np.inf, posinf=np.inf)


@dataclass
class VectorFile:
    cells: DataFrame
    exact: DataFrame


def index_of(vectors: DataFrame) -> VectorFile:
    """The approximation file and the exact vectors, each written once; row names a vector in both."""
    exact = settle(packed(vectors).withColumn("row", F.monotonically_increasing_id()), "exact-vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = batch.column(2).to_numpy(), []
            for dim in np.unique(dims):
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                numbers = np.frombuffer(b"".join(some.column(3).to_pylist()), "<f8").reshape(-1, dim)
                low, width, codes = cells_of(numbers)
                ids, rows = some.column(1).to_numpy(), some.column(0).to_numpy()
                out.append((int(dim), *(x.tobytes() for x in (ids, rows, low, width)), pack(codes)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int32(), *[pa.binary()] * 5]
            names = ["dim", "ids", "rows", "low", "width", "codes"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    made = exact.select("row", "vec_id", "dim", "body").mapInArrow(run, CELLS)
    return VectorFile(settle(made, "vector-cells"), exact)


# ----------------------------------------------------------------------------------------------------- search


def _scanned(cells: DataFrame, sent, k: int) -> DataFrame:
    """(query, row, lower, upper) that a task's k-th lower bound so far does not rule out, from the cells alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {}
        for dim, rows in sent.value.items():
            numbers = np.frombuffer(b"".join(r[2] for r in rows), "<f8").reshape(len(rows), dim)
            best = np.full((len(rows), k), -np.inf)  # the k largest lower bounds of each query
            asked[dim] = (numbers, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), best)
        for batch in batches:
            for block in batch.to_pylist():
                if block["dim"] not in asked:
                    continue
                numbers, query, own, best = asked[block["dim"]]
                ids, rows = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["rows"], np.int64)
                low, width = np.frombuffer(block["low"], np.float64), np.frombuffer(block["width"], np.float64)
                codes = unpack(block["codes"], len(ids), block["dim"])
                for start in range(0, len(query), 256):
                    some = slice(start, start + 256)
                    lower, upper = bounds_of(numbers[some], low, width, codes)
                    other = ids[None, :] != own[some, None]
                    every = np.concatenate([best[some], np.where(other, lower, -np.inf)], axis=1)
                    best[some] = np.partition(every, every.shape[1] - k, axis=1)[:, -k:]
                    q, v = np.nonzero(other & (upper >= best[some].min(1)[:, None]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query[some][q]), pa.array(rows[v]), pa.array(lower[q, v]), pa.array(upper[q, v])],
                        names=["query", "row", "lower", "upper"],
                    )

    return cells.mapInArrow(run, BOUNDS)


def candidates(file: VectorFile, asked: DataFrame, k: int) -> DataFrame:
    """(query, row, upper) of the vectors whose upper bound reaches the k-th lower bound of the query.

    asked has query, vec_id, dim and body. Queries go to the tasks in passes of about QUERY_BYTES, one job each.
    """
    spark = asked.sparkSession
    size = asked.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    passes = max(1, -(-size // QUERY_BYTES))
    path = scratch(spark, "vector-bounds")
    for turn in range(passes):
        some = asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == turn).orderBy("query").collect()
        by_dim: dict[int, list] = {}
        for r in some:  # QUERY_BYTES, about
            by_dim.setdefault(r["dim"], []).append((r["query"], r["vec_id"], bytes(r["body"])))
        _scanned(file.cells, spark.sparkContext.broadcast(by_dim), k).write.mode("append").parquet(path)
    found = spark.read.schema(BOUNDS).parquet(path)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower"), "row"))
    least = found.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("query").agg(
        F.when(F.count("*") == k, F.min("lower")).alias("least")
    )
    kept = found.join(least, "query").where("least is null or upper >= least")
    return settle(kept.select("query", "row", "upper"), "vector-candidates")


@F.pandas_udf(T.StructType().add("score", "long").add("beyond", "string"))
def products(left: pd.Series, right: pd.Series, reach: pd.Series) -> pd.DataFrame:
    """Inner products without rounding. One beyond 64 bits has no score, but its sign and digits in sortable form."""
    scores, beyond = [], []
    for a, b, most in zip(left, right, reach, strict=True):
        x, y = np.frombuffer(a, "<f8"), np.frombuffer(b, "<f8")
        if most < EXACT:
            value = int(x @ y)
        else:
            value = sum(int(i) * int(j) for i, j in zip(x, y, strict=True))
        fits = -(1 << 63) <= value < 1 << 63
        scores.append(value if fits else None)
        beyond.append(None if fits else f"{value + 10**DIGITS:0{DIGITS + 1}d}")
    return pd.DataFrame({"score": pd.array(scores, "Int64"), "beyond": beyond})


def _by_score() -> list[Column]:
    """Highest score first: those above 64 bits, those within, those below; ties by the smaller id."""
    above = F.col("beyond") >= "1"
    kind = F.when(F.col("beyond").isNull(), 1).when(above, 2).otherwise(0)
    return [F.desc(kind), F.desc("score"), F.desc("beyond"), F.asc("vec_id"), F.asc("row")]


def read(file: VectorFile, asked: DataFrame, some: DataFrame) -> DataFrame:
    """query, query_id, row, vec_id, upper, score, beyond of candidates, by their exact vectors."""
    asks = asked.select("query", F.col("vec_id").alias("query_id"), F.col("peak").alias("q_peak"), F.col("body").alias("q_body"))
    both = some.join(file.exact, "row").join(asks, "query")
    done = both.withColumn("p", products("body", "q_body", F.col("peak") * F.col("q_peak") * F.col("dim")))
    return done.select("query", "query_id", "row", "vec_id", "upper", "p.score", "p.beyond")


def read_in_order(file: VectorFile, asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The candidates whose exact vectors are read, with their scores; the k best of every query are among them.

    The highest bounds of each query come first. Their k-th exact score then says which others may still count;
    where it is beyond 64 bits, all are read.
    """
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("upper"), "row"))
    ordered = settle(found.withColumn("nth", nth), "vector-order")
    first = settle(read(file, asked, ordered.where(F.col("nth") <= FIRST * k).drop("nth")), "vector-scores")
    place = F.row_number().over(Window.partitionBy("query").orderBy(*_by_score()))
    certain = first.withColumn("place", place).where(F.col("place") == k).select("query", "score")
    rest = ordered.where(F.col("nth") > FIRST * k).join(certain, "query", "left")
    rest = rest.where("score is null or upper >= score").select("query", "row", "upper")
    return first.unionByName(read(file, asked, rest))


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k best vectors of every query row: query_id, rank, vec_id, score.

    Both tables have vec_id and embedding. A query meets every valid vector of its own dimension but those of
    its own id; ties go to the smaller id. Repeated query rows are answered each, repeated vectors count each.
    Queries that are not valid vectors, and queries without a partner, have no rows. Scores beyond 64 bits keep
    their rank and are null. Other columns are not read; empty tables give no rows.
    """
    asked = settle(packed(queries).withColumn("query", F.monotonically_increasing_id()), "queries")
    file = index_of(vectors)
    scored = read_in_order(file, asked, candidates(file, asked, k), k)
    best = Window.partitionBy("query").orderBy(*_by_score())
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH whole AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, vec_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
