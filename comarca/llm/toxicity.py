"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its lower-case words and the four-byte grams inside its blank-padded words, hashed into a
fixed number of buckets. From a bounded sample of labelled texts the buckets that tell the labels apart are
kept; on their presence a factorization machine is fitted, whose factors score pairs of terms (an insult with
the mention of a group) that a sum of single weights misses. Scoring reads whole texts in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm.common import arrow_batches, documents, held_out
from comarca.session import settle

BUCKETS = 1 << 20
#: The sample a machine is fitted on: at most so many labelled documents of each label, whose ids hash lowest.
SAMPLE_ROWS = 6_000
KEPT = 2_048  # buckets with a weight
FACTORS = 8
EPOCHS = 20
RATE = 0.1
DECAY = 1e-3
SEED = 11
GRAM = 4

OTHER = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)


def terms(text: str | None) -> np.ndarray:
    """The bucket of every term of a text, repeated as often as it occurs."""
    body = OTHER.sub(b" ", (text or "").lower().encode("utf-8", "surrogatepass")).strip()
    if not body:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(b" " + body + b" ", np.uint8)
    with np.errstate(over="ignore"):
        codes = raw.astype(np.uint64)
        shift = np.uint64(64 - int(np.log2(BUCKETS)))
        found = []
        if len(raw) >= GRAM:
            n = len(raw) - GRAM + 1
            gram = codes[:n] | codes[1 : n + 1] << np.uint64(8)
            gram |= codes[2 : n + 2] << np.uint64(16)
            gram |= codes[3 : n + 3] << np.uint64(24)
            inner = (raw[1 : n + 1] != 32) & (raw[2 : n + 2] != 32)  # no gram lies across a blank
            found.append((gram[inner] * MIX) >> shift)
        # words: sums of code times a power of the place inside the word
        blank = raw == 32
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        place = np.arange(len(raw), dtype=np.int64)
        first = np.zeros(len(raw), np.int64)
        first[starts] = starts
        place -= np.maximum.accumulate(first)
        powers = np.cumprod(np.full(int(place.max()) + 1, BASE, np.uint64))
        weighed = np.where(blank, np.uint64(0), codes * powers[place])
        words = np.add.reduceat(weighed, starts)
        found.append(((words ^ (words >> np.uint64(29))) * MIX) >> shift)
    return np.concatenate(found).astype(np.int64)


@dataclass
class Machine:
    """Bias, weights and factors of the kept buckets; `place` is the row of a bucket or -1."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, text: str | None) -> float:
        rows = self.place[terms(text)]
        rows = np.unique(rows[rows >= 0])
        chosen = self.factors[rows]
        pairs = 0.5 * float((chosen.sum(0) ** 2 - (chosen**2).sum(0)).sum())
        return float(_sigmoid(self.bias + float(self.weights[rows].sum()) + pairs))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of the sampled documents.

    Labels that contradict each other for one doc_id count once each; null labels, ids and texts are left out. Of
    each label at most `rows` documents are taken, different texts of one doc_id being documents of their own and
    repeated rows one.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    marks = marks.where("_id is not null and _toxic in (0, 1)").distinct()
    chosen = [marks.where(f"_toxic = {y}").orderBy(F.xxhash64("_id"), "_id").limit(rows) for y in (0, 1)]
    wanted = chosen[0].unionByName(chosen[1])  # 2 * rows at most
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text"))
    texts = texts.where("text is not null").withColumn("_text", F.xxhash64("text"))
    keys = texts.select("_doc", "_text").join(F.broadcast(wanted), F.col("_doc") == F.col("_id")).distinct()
    order = [F.xxhash64("_id"), "_id", "_text"]
    parts = [keys.where(f"_toxic = {y}").orderBy(*order).limit(rows).select("_doc", "_text", "_toxic") for y in (0, 1)]
    bounded = settle(parts[0].unionByName(parts[1]), "sample-keys")
    picked = texts.join(F.broadcast(bounded), ["_doc", "_text"]).dropDuplicates(["_doc", "_text", "_toxic"])
    return settle(picked.select("text", F.col("_toxic").alias("toxic")), "sample")


def telling(examples: DataFrame, kept: int = KEPT) -> tuple[np.ndarray, tuple[int, int]]:
    """The buckets whose shares among the two labels lie furthest apart, and the number of texts of each label."""
    arrow_batches(examples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS + 1), np.int64)  # the last one counts the texts
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[label, np.unique(terms(text.as_py()))] += 1
                counts[label, BUCKETS] += 1
        some = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["bucket", "clean", "toxic"]
        )

    parts = examples.select("text", "toxic").mapInArrow(run, "bucket long, clean long, toxic long")
    sums = parts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = settle(sums, "bucket-counts")
    texts = sums.where(F.col("bucket") == BUCKETS).first()
    total = (int(texts["clean"]), int(texts["toxic"])) if texts else (0, 0)
    if not all(total):
        return np.zeros(0, np.int64), total
    share = [(F.col(c) + 0.5) / (n + 1.0) for c, n in zip(("clean", "toxic"), total, strict=True)]
    error = F.sqrt(share[0] * (1 - share[0]) / total[0] + share[1] * (1 - share[1]) / total[1])
    ranked = (
        sums.where((F.col("bucket") < BUCKETS) & (F.col("clean") + F.col("toxic") >= 5))
        .withColumn("apart", F.round(F.abs(share[1] - share[0]) / error, 9))
        .where("apart > 2")
        .orderBy(F.desc("apart"), "bucket")
        .limit(kept)
    )
    best = np.array([r["bucket"] for r in ranked.collect()], np.int64)  # kept at most
    return best, total


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, kept: int = KEPT) -> Machine:
    """A machine fitted on the sample.

    Without examples of both labels every text gets the same score, near 1 or 0 by the label there is.
    """
    examples = sample(docs, labels, rows)
    best, total = telling(examples, kept)
    place = np.full(BUCKETS, -1, np.int32)
    place[best] = np.arange(len(best))
    if not all(total):
        return Machine(place, 30.0 if total[1] else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = [known[terms(t.as_py())] for t in batch.column(0)]
            found = [np.unique(f[f >= 0]).astype("<i4").tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["rows", "toxic"])

    # 2 * rows texts of at most `kept` numbers, in an order that does not depend on the partitions
    got = sorted((bytes(r["rows"]), r["toxic"]) for r in examples.mapInArrow(run, "rows binary, toxic int").collect())
    x = np.zeros((len(got), len(best)), np.float32)
    for i, (found, _) in enumerate(got):
        x[i, np.frombuffer(found, "<i4")] = 1
    return Machine(place, *fit(x, np.array([y for _, y in got], np.float64)))


def fit(x: np.ndarray, y: np.ndarray, factors: int = FACTORS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by AdaGrad on the balanced logistic loss of a presence matrix."""
    draw = np.random.default_rng(SEED)
    bias, weights, v = 0.0, np.zeros(x.shape[1]), draw.normal(0, 0.01, (x.shape[1], factors))
    seen_w, seen_v, seen_b = np.full(x.shape[1], 1e-8), np.full(v.shape, 1e-8), 1e-8
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    for _ in range(EPOCHS):
        for some in np.array_split(draw.permutation(len(y)), max(1, len(y) // 256)):
            rows = x[some]
            sums = rows @ v
            out = bias + rows @ weights + 0.5 * (sums**2 - rows @ (v**2)).sum(1)
            wrong = (_sigmoid(out) - y[some]) * balance[some] / len(some)
            g_b = float(wrong.sum())
            g_w = rows.T @ wrong + DECAY * weights / x.shape[1]
            g_v = rows.T @ (wrong[:, None] * sums) - v * (rows.T @ wrong)[:, None] + DECAY * v
            seen_b, seen_w, seen_v = seen_b + g_b**2, seen_w + g_w**2, seen_v + g_v**2
            bias -= RATE * g_b / np.sqrt(seen_b)
            weights -= RATE * g_w / np.sqrt(seen_w)
            v -= RATE * g_v / np.sqrt(seen_v)
    return bias, weights, v


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row, from its whole text alone.

    Null and empty texts get the score of no terms. Repeated rows stay; rows with a null doc_id too; an empty
    table gives no rows. Other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS and KEPT set its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            scores = [known.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    machine = learn(docs, labels)
    return score(docs, machine).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
