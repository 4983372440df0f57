"""SimHash near-duplicates by multi-index hashing.

Every text becomes a 64-bit fingerprint. Equal fingerprints are one class; classes link at RADIUS or fewer differing
bits. The bits are cut into two segments. If two codes differ in at most two bits, then either the first segments
differ in at most one bit or the second ones are equal, so a code looks up the small Hamming ball around its first
segment and its second segment itself in a table of all codes, and complete distances are verified.

A table entry that more than CROWD codes share is indexed again by the halves of the bits that are still free, down
to entries of at most 256 codes (8 free bits). So a family of any size costs each of its codes a bounded number of
looks, never all pairs, and no link between different codes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm.common import arrow_batches, documents
from comarca.llm.jaccard_join import components
from comarca.session import settle

WORDS = 3
SEED = 42
RADIUS = 2
CROWD = 64  # codes that one table entry compares directly; beyond it the entry is indexed again
BLOCK = 1 << 16  # shingles hashed at a time
FREE = (32, 16, 8)  # bits still free in the entries of each level

PRINTS = "doc_id long, code long"


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text as a signed number: a bit is set if it is in over half the shingles' hashes."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    after_word = np.concatenate([[False], ~blank[:-1]]) if len(raw) else blank
    kept = ~blank | after_word  # one blank behind each word
    single = np.where(blank, np.uint8(32), raw)[kept]
    ends = np.flatnonzero(single == 32)
    if len(single) and single[-1] != 32:
        ends = np.append(ends, len(single))
    if not len(ends):
        return 0
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WORDS, len(ends))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    body, digest = single.tobytes(), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(body[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (code, a signed 64-bit number) of every row of docs."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pa.array([fingerprint(text.as_py()) for text in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), codes], names=["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PRINTS)


def bits_of(value: int) -> Column:
    """64 bits as a signed number."""
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def halves(fixed: int) -> tuple[int, int]:
    """The bits outside `fixed` in two halves, the higher ones first."""
    free = [b for b in range(63, -1, -1) if not fixed >> b & 1]
    middle = len(free) // 2
    return sum(1 << b for b in free[:middle]), sum(1 << b for b in free[middle:])


def masks(level: int) -> list[int]:
    """The sets of fixed bits by which the tables of a level are indexed."""
    found = [0]
    for _ in range(level + 1):
        found = [fixed | half for fixed in found for half in halves(fixed)]
    return found


def _entries(codes: DataFrame, parents: list[int], fixed: Column) -> DataFrame:
    """(fixed, key, code): each code under the segments of its table; `fixed` is the parent's set of bits."""
    rows = None
    for parent in parents:
        below = [bits_of(parent | half) for half in halves(parent)]
        keys = F.array(*[F.struct(m.alias("fixed"), F.col("code").bitwiseAND(m).alias("key")) for m in below])
        here = fixed == bits_of(parent)
        rows = F.when(here, keys) if rows is None else rows.when(here, keys)
    return codes.select("code", F.explode(rows).alias("e")).select("e.fixed", "e.key", "code")


def _balls(mask: Column, bits: list[Column], place: int, radius: int) -> list[Column]:
    """Arrays of what a probe looks up in one segment: its own value, and those one bit away."""
    near, left = F.col("near"), F.col("left")

    def look(code: Column, rest: Column) -> Column:
        return F.struct(
            mask.alias("fixed"), code.bitwiseAND(mask).alias("key"), code.alias("near"), rest.alias("left")
        )

    flips = F.filter(F.array(*bits), lambda b: (left < radius) | (near.bitwiseAND(b) != 0))
    ball = F.transform(flips, lambda b: look(near.bitwiseXOR(b), left - 1))
    own = F.array(look(near, left))
    none = F.filter(own, lambda _: F.lit(False))
    # of two segments the first differ in at most half of what is left, or the second in less
    return [F.when(left >= place, own).otherwise(none), F.when(left >= 2 + place, ball).otherwise(none)]


def _looks(probes: DataFrame, parents: list[int], radius: int) -> DataFrame:
    """(fixed, key, code, near, left): the balls that each probe looks up one level further down.

    near is the code with the bits flipped so far, left the differences that the free bits may still have. Of two
    codes that differ in a bit the one that has it looks first, so the first flip only clears bits.
    """
    rows = None
    for parent in parents:
        looks = [
            ball
            for place, half in enumerate(halves(parent))
            for ball in _balls(bits_of(parent | half), [bits_of(1 << b) for b in range(64) if half >> b & 1], place, radius)
        ]
        every = F.concat(*looks)
        here = F.col("fixed") == bits_of(parent)
        rows = F.when(here, every) if rows is None else rows.when(here, every)
    return probes.select("code", F.explode(rows).alias("e")).select("e.fixed", "e.key", "code", "e.near", "e.left")


def linked(codes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct `code`s in 1 to `radius` bits of each other (radius up to 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("balls of one bit in two segments cover up to three differences")
    table = codes.select(F.lit(0).cast("long").alias("fixed"), "code")
    probes = table.select("fixed", "code", F.col("code").alias("near"), F.lit(radius).alias("left"))
    found = None
    for level, free in enumerate(FREE):
        parents = [0] if level == 0 else masks(level - 1)
        entries = _entries(table, parents, F.col("fixed"))
        looks = _looks(probes, parents, radius)
        last = 1 << free <= max(crowd, 256)
        if not last:
            many = entries.groupBy("fixed", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
            many = settle(many.select("fixed", "key"), "crowded")
            last = not many.take(1)
        few = entries if last else entries.join(many, ["fixed", "key"], "left_anti")
        met = looks.join(few.withColumnRenamed("code", "other"), ["fixed", "key"])
        differ = F.bit_count(F.col("code").bitwiseXOR(F.col("other")))
        # without a flip both codes look each other up
        met = met.where((differ <= radius) & (differ > 0) & ((F.col("left") < radius) | (F.col("code") < F.col("other"))))
        pairs = met.select(F.least("code", "other").alias("a"), F.greatest("code", "other").alias("b"))
        pairs = settle(pairs.distinct(), "links")
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        table = settle(entries.join(many, ["fixed", "key"], "left_semi").select("fixed", "code"), "table")
        probes = settle(
            looks.join(many, ["fixed", "key"], "left_semi").select("fixed", "code", "near", "left"), "probes"
        )
    return found.distinct()


def dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row of docs.

    component_id is the smallest doc_id among the rows whose fingerprints links connect, itself included. Null and
    empty texts and texts of blanks have fingerprint zero and are linked like any other. Repeated rows stay, equal
    fingerprints are one class. Rows with a null doc_id take part; a component without any id is null. Other columns
    are not read; an empty table gives no rows.
    """
    prints = settle(fingerprints(docs), "prints")
    codes = settle(prints.groupBy("code").agg(F.min("doc_id").alias("smallest")), "codes")
    roots = components(linked(codes.select("code"), radius))
    rooted = codes.join(roots, F.col("code") == F.col("node"), "left")
    rooted = rooted.select("code", "smallest", F.coalesce("root", "code").alias("root"))
    named = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    labels = rooted.select("code", "root").join(named, "root").select("code", "component_id")
    return prints.join(labels, "code").select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id"
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
