"""Which of five quality filters removes what, in every order, and each filter's Shapley share of the removals.

A text fails a set of filters, one of 32. Counting the documents that fail any filter of a coalition, for all 32
coalitions, holds everything: what a step of an order removes is the difference of two coalitions, and the Shapley
values are the weighted least-squares fit of an additive game to the table, with the Shapley kernel as weights and
the whole removal as an equality constraint. The normal equations are solved in rationals, so the values are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm.common import arrow_batches, documents
from comarca.session import settle

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"

FACTS = "doc_id long, part string, body binary, mask int"
COUNTED = ("", "_good", "_toxic")
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def own_failures(text: str) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at blanks and the controls 9 to 13
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 2 * len(text)) << 2
        | (len(raw.translate(None, MARKS)) < len(raw)) << 3
    )


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, a 128-bit digest of the text and the mask of filters A to D of every row."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, failed = [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                bodies.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                failed.append(own_failures(text))
            columns = [batch.column(0), batch.column(1), pa.array(bodies, pa.binary()), pa.array(failed, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "body", "mask"])

    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    return docs.select(F.col("doc_id").cast("long"), part, F.col("text").cast("string")).mapInArrow(run, FACTS)


def profiles(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """n documents for each part, mask of failed filters, good and toxic: at most 128 rows a part.

    Copies are told by the smallest doc_id of each text, found with map-side minima, and joined on text and doc_id
    together, so that a text of very many copies is no hot key.
    """
    known = settle(facts(docs), "facts")
    rows = known.groupBy("body", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    firsts = known.where("doc_id is not null").groupBy("body").agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.withColumn("is_first", F.lit(True))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    copied = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return (
        rows.join(firsts, ["body", "doc_id"], "left")
        .join(marked, "doc_id", "left")
        .groupBy(
            "part",
            (F.col("mask") + F.when(copied, 16).otherwise(0)).alias("mask"),
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
        .agg(F.sum("n").alias("n"))
    )


def coalitions(profiled: DataFrame) -> DataFrame:
    """One row for each part: its documents, failures of each filter, and removals of all 32 coalitions.

    removed, removed_good and removed_toxic are arrays with the coalition's bits as index.
    """
    n = F.col("n")
    kinds = {"": F.lit(True), "_good": F.col("good"), "_toxic": F.col("toxic")}
    sums = [
        F.sum(F.when(holds & (F.col("mask").bitwiseAND(F.lit(c)) != 0), n).otherwise(0)).alias(f"v{kind}{c}")
        for kind, holds in kinds.items()
        for c in range(ALL + 1)
    ]
    wide = profiled.groupBy("part").agg(F.sum("n").alias("n"), *sums)
    return wide.select(
        "part", "n", *[F.array(*[f"v{kind}{c}" for c in range(ALL + 1)]).alias(f"removed{kind}") for kind in kinds]
    )


@lru_cache(maxsize=1)
def kernel_solution() -> list[list[Fraction]]:
    """The rows that turn the removals of the coalitions 1 to ALL into the filters' Shapley values.

    Coalitions that are neither empty nor whole weigh (m - 1) / (C(m, s) s (m - s)). The fitted values and the
    multiplier of the constraint solve [[X'WX, 1], [1', 0]] [phi, mu] = [X'Wv, v(all)]; the matrix is the same for
    every part and is inverted once, by Gauss-Jordan elimination in rationals.
    """
    m = len(FILTERS)
    weight = {c: Fraction(m - 1, comb(m, s) * s * (m - s)) for c in range(1, ALL) for s in [c.bit_count()]}
    has = lambda c, i: c >> i & 1
    left = [[sum((w for c, w in weight.items() if has(c, i) and has(c, j)), Fraction(0)) for j in range(m)] + [Fraction(1)] for i in range(m)]
    left.append([Fraction(1)] * m + [Fraction(0)])
    # right-hand sides: how each coalition's removal enters the equations
    right = [[weight[c] * has(c, i) if c != ALL else Fraction(0) for c in range(1, ALL + 1)] for i in range(m)]
    right.append([Fraction(int(c == ALL)) for c in range(1, ALL + 1)])
    rows = [a + b for a, b in zip(left, right, strict=True)]
    for i in range(m + 1):
        pivot = next(r for r in range(i, m + 1) if rows[r][i] != 0)
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(m + 1):
            if r != i and rows[r][i] != 0:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [row[m + 1 :] for row in rows[:m]]


def shapley(removed: list[int]) -> list[Fraction]:
    """The Shapley value of each filter from the removals of all coalitions, index 0 being the empty one."""
    return [sum((w * v for w, v in zip(row, removed[1:], strict=True)), Fraction(0)) for row in kernel_solution()]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Parts are the values of `source`; null and empty are one part. A null text is empty. A row with a null doc_id is
    never a copy and makes no other row one; rows that share text and doc_id are no copies of each other. Repeated
    rows count each. A document is good or toxic if any of its label rows says so. Empty tables give no rows; other
    columns are not read.
    """
    orders = list(permutations(range(len(FILTERS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                removed, good, toxic = (part[f"removed{kind}"] for kind in COUNTED)
                shares = [int(len(orders) * x) for x in shapley(removed)]
                out = []
                for order in orders:
                    before = 0
                    for step, i in enumerate(order):
                        now = before | 1 << i
                        gone = removed[now] - removed[before]
                        out.append((
                            part["part"], "".join(FILTERS[j] for j in order), step + 1, part["n"] - removed[now], gone,
                            removed[1 << i] - gone, removed[ALL] - removed[ALL ^ 1 << i], good[now] - good[before],
                            toxic[now] - toxic[before], shares[i],
                        ))
                        before = now
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                names = [f.split()[0] for f in AUDIT.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return coalitions(profiles(docs, labels)).mapInArrow(run, AUDIT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH RECURSIVE body AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM body),
firsts AS (SELECT text, min(doc_id) AS least FROM body GROUP BY text),
marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(least < s.doc_id, false) AS e
  FROM split s JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
masks AS (
  SELECT part, good, toxic, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT)
    + 16 * CAST(e AS INT) AS mask, count(*) AS n FROM failed GROUP BY ALL),
letters AS (SELECT substr('ABCDE', i + 1, 1) AS letter, 1 << i AS bit FROM (SELECT unnest(range(5)) AS i)),
orders AS (
  SELECT '' AS filter_order, 0 AS used
  UNION ALL
  SELECT filter_order || letter, used | bit FROM orders, letters WHERE used & bit = 0),
steps AS (
  SELECT filter_order, s AS step, l.bit,
    list_sum([1 << (ascii(substr(filter_order, j, 1)) - 65) FOR j IN range(1, s)]) AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS s FROM orders WHERE length(filter_order) = 5)
  JOIN letters l ON l.letter = substr(filter_order, s, 1)),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (CAST(coalesce(before, 0) AS INT) | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & CAST(coalesce(before, 0) AS INT) = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & CAST(coalesce(before, 0) AS INT) <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN good AND mask & CAST(coalesce(before, 0) AS INT) = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN toxic AND mask & CAST(coalesce(before, 0) AS INT) = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS toxic_lost
  FROM steps, masks GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
