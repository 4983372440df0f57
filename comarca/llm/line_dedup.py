"""Line deduplication with sharded cuckoo filters over exact reference counts.

The index of a corpus has three tables in the shared folder:

* refs (shard, key, doc_id): one row for each document and long line key in it, the exact references;
* counts (shard, key, n_docs, keeper): their number and the largest doc_id, for each key;
* filters (shard, slots, buckets): a cuckoo filter of the keys that have reached the threshold.

Inserting or deleting documents touches the counts of their own keys alone, and adds to or takes from the
filters the keys that cross the threshold, so that a deletion undoes an insertion. Cleaning asks the filters
first, which never miss a repeated key, and settles what they let through against the exact counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm.common import arrow_batches, documents, unused
from comarca.session import settle

MIN_CHARS = 40
MIN_DOCS = 5
BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4  # fingerprints of a bucket
KICKS = 500
SHARD_KEYS = 50_000  # keys of a filter shard, about
SALT_REFS = 500_000  # references that meet one copy of their shard's filter; a shard with more is split

REFS = "shard int, key binary, doc_id long"
COUNTS = "shard int, key binary, n_docs long, keeper long"
FILTERS = "shard int, slots binary, buckets int"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def long_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """For each line the 16-byte digest of its key, or None for a short one."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line_key(line)
        if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars:
            out.append(None)
        else:
            out.append(hashlib.blake2b(key, digest_size=16).digest())
    return out


class Cuckoo:
    """A cuckoo filter of 64-bit hashes: 16-bit fingerprints, two buckets of four slots for each."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(1 << max(4, math.ceil(math.log2(max(1, keys) / (SLOTS * 0.85)))))

    @classmethod
    def read(cls, slots: bytes, buckets: int) -> Cuckoo:
        return cls(buckets, np.frombuffer(slots, np.uint16).reshape(buckets, SLOTS).copy())

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (hashes >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (hashes & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, at, prints):
        with np.errstate(over="ignore"):
            mixed = (np.asarray(prints).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return np.asarray(at) ^ (mixed & np.uint64(self.buckets - 1)).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        prints, first, second = self.places(hashes)
        return (self.slots[first] == prints[:, None]).any(1) | (self.slots[second] == prints[:, None]).any(1)

    def _put(self, at: int, value: int) -> bool:
        free = np.flatnonzero(self.slots[at] == 0)
        if len(free):
            self.slots[at, free[0]] = value
        return bool(len(free))

    def add(self, hashes: np.ndarray) -> bool:
        """False if a fingerprint finds no place; the filter must then be built anew, larger."""
        for value, a, b in zip(*self.places(hashes), strict=True):
            if self._put(a, value) or self._put(b, value):
                continue
            at = b
            for kick in range(KICKS):
                turn = kick % SLOTS
                value, self.slots[at, turn] = self.slots[at, turn], value
                at = int(self.other(at, value))
                if self._put(at, value):
                    break
            else:
                return False
        return True

    def remove(self, hashes: np.ndarray) -> None:
        """Take out one fingerprint of each hash; they must have been added."""
        for value, a, b in zip(*self.places(hashes), strict=True):
            for at in (a, b):
                found = np.flatnonzero(self.slots[at] == value)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break


def key_hashes(keys) -> np.ndarray:
    """64 bits of each digest for the filter."""
    return np.frombuffer(b"".join(keys), np.uint64)[::2].copy()


def shard_numbers(keys, shards: int) -> np.ndarray:
    """The shard of each digest, from the 64 bits that the filter leaves."""
    return (np.frombuffer(b"".join(keys), np.uint64)[1::2] % np.uint64(shards)).astype(np.int32)


@dataclass
class LineIndex:
    shards: int
    min_chars: int
    min_docs: int
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame


def empty_index(
    spark: SparkSession, shards: int, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> LineIndex:
    make = spark.createDataFrame
    return LineIndex(shards, min_chars, min_docs, make([], REFS), make([], COUNTS), make([], FILTERS))


def references(docs: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """The distinct (shard, key, doc_id) of the long lines of documents with an id."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {k for k in long_keys(text.as_py(), min_chars) if k is not None}
                keys += own
                ids += [doc_id] * len(own)
            shard = shard_numbers(keys, shards) if keys else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(keys, pa.binary()), pa.array(ids, pa.int64())],
                names=["shard", "key", "doc_id"],
            )

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text"))
    return rows.mapInArrow(run, REFS).groupBy("shard", "key", "doc_id").agg(F.lit(1).alias("_")).drop("_")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("shard", "key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def _refiltered(index: LineIndex, counts: DataFrame, crossed: DataFrame | None) -> DataFrame:
    """The filters after the keys in crossed (shard, key, added) have reached or left the threshold.

    crossed None: built anew from counts. A shard holds distinct keys and as many as the number of shards sets.
    A filter that overflows is built anew from its shard's counts.
    """
    often = counts.where(F.col("n_docs") >= index.min_docs).select("shard", "key")

    def build(keys) -> Cuckoo:
        hashes, size = key_hashes(keys), len(keys)
        made = Cuckoo.sized(size)
        while not made.add(hashes):
            size = size * 2 + 1
            made = Cuckoo.sized(size)
        return made

    def frame(shard: int, made: Cuckoo) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "slots": [made.slots.tobytes()], "buckets": [made.buckets]})

    if crossed is None:

        def anew(group: pd.DataFrame) -> pd.DataFrame:
            return frame(int(group["shard"].iloc[0]), build(group["key"].tolist()))

        return settle(often.groupBy("shard").applyInPandas(anew, FILTERS), "line-filters")

    def changed(key, old: pd.DataFrame, news: pd.DataFrame) -> pd.DataFrame:
        adds, removed = news[news["added"]]["key"].tolist(), news[~news["added"]]["key"].tolist()
        if len(old):
            made = Cuckoo.read(old["slots"].iloc[0], int(old["buckets"].iloc[0]))
        else:
            made = Cuckoo.sized(len(adds))
        if removed:
            made.remove(key_hashes(removed))
        if adds and not made.add(key_hashes(adds)):
            return pd.DataFrame({"shard": [key[0]], "slots": [None], "buckets": [0]})  # built anew below
        return frame(key[0], made)

    updated = settle(
        index.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(changed, FILTERS), "line-filters"
    )
    full = updated.where("slots is null").select("shard")

    def anew(group: pd.DataFrame) -> pd.DataFrame:
        return frame(int(group["shard"].iloc[0]), build(group["key"].tolist()))

    rebuilt = often.join(full, "shard", "left_semi").groupBy("shard").applyInPandas(anew, FILTERS)
    return settle(updated.where("slots is not null").unionByName(rebuilt), "line-filters")


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """Add documents. Those already present are left as they are, repeated rows count once."""
    first = not index.refs.take(1)
    fresh = references(docs, index.shards, index.min_chars)
    if not first:
        fresh = fresh.join(index.refs.select("doc_id").distinct(), "doc_id", "left_anti").select("shard", "key", "doc_id")
    fresh = settle(fresh, "line-refs")
    if first:
        counts = settle(_counted(fresh), "line-counts")
        return LineIndex(
            index.shards, index.min_chars, index.min_docs, fresh, counts, _refiltered(index, counts, None)
        )
    merged = (
        index.counts.withColumn("was", F.col("n_docs"))
        .unionByName(_counted(fresh).withColumn("was", F.lit(0).cast("long")))
        .groupBy("shard", "key")
        .agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"), F.sum("was").alias("was"))
    )
    merged = settle(merged, "line-counts")
    return _moved(index, index.refs.unionByName(fresh), merged)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """Take documents out again; ids that are not present change nothing."""
    gone = doc_ids.select("doc_id").where("doc_id is not null").distinct()
    lost = settle(index.refs.join(gone, "doc_id", "left_semi").select("shard", "key", "doc_id"), "line-lost")
    refs = settle(index.refs.join(gone, "doc_id", "left_anti").select("shard", "key", "doc_id"), "line-refs")
    touched = lost.select("shard", "key").distinct()
    left = _counted(refs.join(touched, ["shard", "key"], "left_semi"))
    was = index.counts.join(touched, ["shard", "key"], "left_semi").select("shard", "key", F.col("n_docs").alias("was"))
    changed = was.join(left, ["shard", "key"], "left").select(
        "shard", "key", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), "keeper", "was"
    )
    same = index.counts.join(touched, ["shard", "key"], "left_anti").withColumn("was", F.col("n_docs"))
    return _moved(index, refs, settle(same.unionByName(changed), "line-counts"))


def _moved(index: LineIndex, refs: DataFrame, merged: DataFrame) -> LineIndex:
    now, was = F.col("n_docs") >= index.min_docs, F.col("was") >= index.min_docs
    crossed = merged.where(now != was).select("shard", "key", now.alias("added"))
    counts = merged.where("n_docs > 0").drop("was")
    return LineIndex(
        index.shards, index.min_chars, index.min_docs, refs, counts, _refiltered(index, counts, crossed)
    )


def _sides(index: LineIndex) -> DataFrame:
    """References and the filters of their shards in one table, placed by (shard, salt) with the filter first.

    A shard of many references is split by document, and every part gets a copy of the filter.
    """
    sizes = index.refs.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SALT_REFS)
    salts = settle(sizes.select("shard", F.ceil(F.col("n") / SALT_REFS).cast("int").alias("salts")), "line-salts")
    salts_of = F.coalesce("salts", F.lit(1))
    refs = index.refs.join(salts, "shard", "left").select(
        "shard",
        F.pmod(F.xxhash64("doc_id"), salts_of).cast("int").alias("salt"),
        "key",
        "doc_id",
        F.lit(None).cast("binary").alias("slots"),
        F.lit(None).cast("int").alias("buckets"),
    )
    filters = index.filters.join(salts, "shard", "left").select(
        "shard",
        F.explode(F.sequence(F.lit(0), salts_of - 1)).alias("salt"),
        F.lit(None).cast("binary").alias("key"),
        F.lit(None).cast("long").alias("doc_id"),
        "slots",
        "buckets",
    )
    placed = refs.unionByName(filters).repartition("shard", "salt")
    return placed.sortWithinPartitions("shard", "salt", F.col("slots").isNull())


def passed(index: LineIndex) -> DataFrame:
    """(key, doc_id) of the references that the filter of their shard lets through; a task holds one filter at a time."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ready = None, None
        for batch in batches:
            shard, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, sent = batch.column(2), batch.column(4)
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
            hit = np.zeros(len(shard), bool)
            for start, end in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if start == end:
                    continue
                if place != (shard[start], salt[start]):
                    place, ready = (shard[start], salt[start]), None
                if sent[start].is_valid:
                    ready = Cuckoo.read(sent[start].as_py(), batch.column(5)[start].as_py())
                    start += 1
                if ready is not None and start < end:
                    hit[start:end] = ready.holds(key_hashes(keys[start:end].to_pylist()))
            yield batch.select(["key", "doc_id"]).filter(pa.array(hit))

    return _sides(index).mapInArrow(probe, "key binary, doc_id long")


def droppable(index: LineIndex) -> DataFrame:
    """(doc_id, keys): the repeated keys that each document must give up."""
    often = index.counts.where(F.col("n_docs") >= index.min_docs).select("key", "keeper")
    return (
        passed(index)
        .join(often, "key")
        .where("doc_id <> keeper")
        .groupBy("doc_id")
        .agg(F.collect_list("key").alias("keys"))
    )


CLEANED = "text string, n_lines long, n_dropped long"


def clean(docs: DataFrame, index: LineIndex) -> DataFrame:
    """Replace text by the lines that stay, and append n_lines and n_dropped.

    A line is dropped if its key is long, is in at least min_docs indexed documents and the document is not
    the largest doc_id with it; that one keeps every copy of the line. Null and empty texts are one empty line
    and become empty. Rows with a null doc_id stay whole. Repeated rows of a document lose the same lines.
    Columns n_lines and n_dropped of the input are replaced; other columns pass through.
    """
    arrow_batches(docs.sparkSession)
    min_chars = index.min_chars
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]

    @F.pandas_udf(CLEANED)
    def strip(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for text, drop in zip(texts, keys, strict=True):
            text = text or ""
            lines = text.split("\n")
            if drop is None or not len(drop):
                out.append((text, len(lines), 0))
                continue
            gone = {bytes(k) for k in drop}
            stay = [x for x, k in zip(lines, long_keys(text, min_chars), strict=True) if k not in gone]
            out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    owner, drop, done = (unused(columns, n) for n in ("drop_id", "drop_keys", "done"))
    drops = droppable(index).select(F.col("doc_id").alias(owner), F.col("keys").alias(drop))
    rows = docs.select(*columns).join(drops, F.col("doc_id") == F.col(owner), "left").drop(owner)
    cleaned = rows.withColumn(done, strip("text", drop))
    return cleaned.select(
        *[F.col(f"{done}.text").alias("text") if c == "text" else F.col(c) for c in columns],
        f"{done}.n_lines",
        f"{done}.n_dropped",
    )


def index_of(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    """An index of all documents, its shards set by the bytes of the texts."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(16, math.ceil(size / 100 / SHARD_KEYS))  # lines of 100 bytes or more, all of them repeated
    return insert(empty_index(docs.sparkSession, shards, min_chars, min_docs), docs)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return clean(docs, index_of(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
flat AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (
  SELECT doc_id, pos, line, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM flat),
often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone
  FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
