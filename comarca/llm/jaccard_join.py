"""Exact n-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

A document is its set of shingle hashes. Two sets of l <= s shingles reach the threshold only if they differ
in at most (l + s) / 9 of them (at 0.8). The universe of hashes is cut into more segments than that by size
band, so two linked sets agree in some segments. Each set indexes a signature of every segment and, for its
first segments, of the segment less each one of its hashes (one-deletion neighbourhood).

A segment costs what its signature meets. One that meets nothing, or nothing outside the set's own component,
is free: a partner from elsewhere must differ there. A set with more free units than differences allowed is
done; the others buy the units they lack where signatures are rarest (a whole segment is one unit, a segment
with its neighbourhood two), and only those candidates are verified, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comarca.llm.common import arrow_batches, documents
from comarca.session import settle

WORDS = 5
#: Linked at 100 * intersection >= 80 * union; sets of l and s then differ in (l + s) // 9 hashes at most.
SHARE, WHOLE = 80, 100
BAND = 1.5  # ratio of the bands of set sizes; a partner lies in the same band or the next
SKETCH = 16  # 64-bit words of a set's parities; sets whose parities differ in more bits than allowed can't be linked
NEIGHBOURED = 6  # first segments that index their one-deletion neighbourhoods
BUCKET = 250_000  # signatures that are grouped in one go, about
FLUSH = 500_000  # signatures that a task holds before it hands them on
HUB_ROUNDS, HUBS = 2, 2  # rounds in which so many likely partners of a set are tried before the exhaustive search
STEPS = np.array([1, 2, 3, 5, 8, 13])  # how far before a set its likely partners stand in a meeting
SENT_BYTES = 16 << 20  # hashes sent to every task up to this size
SENT_ROWS = 500_000  # set ids sent to every task up to this count; beyond it they are joined by shuffle

U = np.uint64
ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]
BASE = U(0x8CB92BA72F3D8DD7)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


#: What a byte adds to its word: A-Z count as a-z, blanks as nothing.
BYTE = np.array([0 if b == 32 or 9 <= b <= 13 else b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], U)
BLANK = BYTE == 0
BACK = U(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 16
_POWERS: dict[np.uint64, np.ndarray] = {}


def powers(base: np.uint64, at: np.ndarray) -> np.ndarray:
    """base to the power of each place, mod 2^64: two short tables serve texts of any length below 2^32 bytes."""
    if base not in _POWERS:
        with np.errstate(over="ignore"):
            small = np.cumprod(np.concatenate([[U(1)], np.full(CHUNK, base, U)]))
            _POWERS[base] = np.concatenate([small[:-1], np.cumprod(np.concatenate([[U(1)], np.full(CHUNK - 1, small[-1], U)]))])
    table = _POWERS[base]
    if not len(at) or at[-1] < CHUNK:  # places rise
        return table[at]
    with np.errstate(over="ignore"):
        return table[at % CHUNK] * table[CHUNK + at // CHUNK]


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    hashes = np.sort(hashes)
    new = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    return hashes[new]


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text; a shorter text is one shingle.

    A word is hashed as a polynomial in BASE. Its bytes are multiplied by the powers of their places in the text,
    and the sum is moved back to one place before the word, as BASE is odd and has an inverse.
    """
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass") + b" ", np.uint8)
    blank = BLANK[raw]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if not len(starts):
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        sums = BYTE[raw] * powers(BASE, np.arange(len(raw)))
        words = mix(np.add.reduceat(sums, starts) * powers(BACK, starts - 1))
        n = max(1, len(words) - WORDS + 1)
        total = np.full(n, U(len(words) if len(words) < WORDS else WORDS))
        for i in range(min(WORDS, len(words))):
            total += words[i : i + n] * ODD[i]
    return distinct(mix(total))


# ------------------------------------------------------------------------------------------------- size bands


class Bands:
    """Bands of set sizes with the segments of each: pairs whose smaller set lies in a band meet in its scheme."""

    def __init__(self) -> None:
        low, self.tops = 1, []
        while low < 1 << 40:
            after = max(low + 1, math.ceil(low * BAND))
            self.tops.append(after - 1)
            low = after
        self.ends = np.array(self.tops)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.ends, size))

    def segments(self, band: int) -> int:
        """More than the differences allowed, and some to spare for those that are empty or common."""
        most = (self.tops[band] + self.tops[band] * WHOLE // SHARE) // 9 + 1
        return 1 if most == 1 else most + 2 + most // 6

    def neighboured(self, band: int) -> int:
        m = self.segments(band)
        return 0 if m == 1 else min(m, NEIGHBOURED)

    def schemes(self, size: int) -> list[tuple[int, int]]:
        """(band, 0 for the own one or 1 for the one below) in which a set of this size takes part."""
        own = self.of(size)
        below = own > 0 and -(-size * SHARE // WHOLE) <= self.tops[own - 1]
        return [(own, 0), (own - 1, 1)] if below else [(own, 0)]


BANDS = Bands()
EXACT, DELETED, EMPTY = 0, 1, 2  # kinds of a signature
KIND, BELOW, SEGMENT = "code % 4", "shiftright(code, 2) % 2", "shiftright(code, 3)"  # what a code tells, in SQL


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (hashes >> U(24)) % U(segments)


def signatures(hashes: np.ndarray, band: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures of a set in a scheme and their codes: segment * 8 + below * 4 + kind."""
    segment = segment_of(hashes, BANDS.segments(band))
    order = np.argsort(segment, kind="stable")
    segment, hashes = segment[order], hashes[order]
    at = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(hashes, at)
        salt = lambda s: (s + U(1) + U(band) * U(1 << 40)) * ODD[0]
        present = segment[at]
        first = BANDS.neighboured(band)
        within = int(np.searchsorted(segment, first))
        less = np.repeat(sums, np.diff(np.append(at, len(segment))))[:within] - hashes[:within]
        missing = np.ones(first, bool)
        missing[present[present < U(first)].astype(np.int64)] = False
        empty = np.flatnonzero(missing).astype(U)
        signs = mix(np.concatenate([sums + salt(present), less + salt(segment[:within]), salt(empty)]))
    kinds = [(present, EXACT), (segment[:within], DELETED), (empty, EMPTY)]
    return signs, np.concatenate([s.astype(np.uint32) * 8 + below * 4 + kind for s, kind in kinds]).astype(np.uint32)


# ------------------------------------------------------------------------------------------------------ passes

BITS = [f"bits{i}" for i in range(SKETCH)]
SETS = "doc_id long, row long, n_shingles long, set_id long, own int, own_first int, low int, low_first int, low_top long"


def parities(hashes: np.ndarray) -> list[int]:
    """Every hash flips one bit: two sets differ in at least as many hashes as their parities in bits.

    What two sets share leaves no trace in the difference, so that it tells sets apart that fill all bits.
    """
    places = (mix(hashes ^ ODD[3]) % U(64 * SKETCH)).astype(np.int64)
    flips = np.bincount(places, minlength=64 * SKETCH) % 2
    return np.packbits(flips.astype(np.uint8)).view(np.int64).tolist()


def plausible(a: str, b: str) -> str:
    """SQL that holds for every linked pair with columns {a}n, {b}n and {a}bits0 ..."""
    differ = " + ".join(f"bit_count({a}{c} ^ {b}{c})" for c in BITS)
    return f"{WHOLE} * least({a}n, {b}n) >= {SHARE} * greatest({a}n, {b}n) and {differ} <= floor(({a}n + {b}n) / 9)"


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have the same."""
    with np.errstate(over="ignore"):
        a = mix(np.array([np.add.reduce(mix(hashes ^ ODD[1])) + U(len(hashes)) * ODD[2]], U))
    return int(a.view(np.int64)[0])


def sets_of(docs: DataFrame) -> DataFrame:
    """One row for each document: its set's size and name, and how many segments it fills in its schemes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, at = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc_id, text, key in zip(ids, batch.column(1), at, strict=True):
                h = shingles(text.as_py())
                row = [doc_id, key, len(h), set_id(h) if len(h) else None, None, None, None, None, None]
                for band, below in BANDS.schemes(len(h)) if len(h) else []:
                    row[4 + 2 * below] = len(distinct(segment_of(h, BANDS.segments(band))))
                    row[5 + 2 * below] = BANDS.neighboured(band)
                    row[8] = BANDS.tops[band] if below else None
                rows.append(row)
            schema = pa.schema(
                [("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("own", pa.int32()),
                 ("own_first", pa.int32()), ("low", pa.int32()), ("low_first", pa.int32()), ("low_top", pa.int64())]
            )
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(run, SETS)


PACKED = "bucket int, signs binary, sets binary, codes binary"


def packed_signatures(docs: DataFrame, buckets: int) -> DataFrame:
    """Signatures of all sets, grouped by bucket in packed arrays; copies within a task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, seen = 0, set()

        def out() -> pa.RecordBatch:
            signs, owners, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (signs >> U(32)) % U(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            short = signs[order].astype(np.uint32)
            rest = [short, owners[order], codes[order]]
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            columns = [pa.array([c[a:b].tobytes() for a, b in spans], pa.binary()) for c in rest]
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts[:-1]].astype(np.int32)), *columns], names=["bucket", "signs", "sets", "codes"]
            )

        for batch in batches:
            for text in batch.column(0):
                h = shingles(text.as_py())
                if not len(h) or (name := set_id(h)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(name)
                for band, below in BANDS.schemes(len(h)):
                    signs, codes = signatures(h, band, below)
                    held.append((signs, np.full(len(signs), name, np.int64), codes))
                    size += len(signs)
                if size >= FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, PACKED)


MET = "set_id long, code int, meeting long, earlier long"


def meetings(packed: DataFrame) -> DataFrame:
    """(set_id, code, meeting, earlier) of every signature that several sets have.

    meeting numbers the signature; earlier is a set before this one in the order of set ids, if any, at a
    distance that the segment chooses, so that a set's segments name several likely partners. Within a bucket signatures are told apart by 32 bits: a chance meeting costs a verification and changes nothing.
    """

    def group(table: pa.Table) -> pa.Table:
        kinds = (("signs", np.uint32), ("sets", np.int64), ("codes", np.uint32))
        signs, owners, codes = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in kinds)
        order = np.lexsort((codes, owners, signs))
        signs, owners, codes = signs[order], owners[order], codes[order]
        new_sign = np.concatenate([[True], signs[1:] != signs[:-1]])
        new_set = new_sign | np.concatenate([[True], owners[1:] != owners[:-1]])
        new_row = new_set | np.concatenate([[True], codes[1:] != codes[:-1]])  # copies from other tasks end here
        at = np.cumsum(new_sign) - 1
        sets_there = np.bincount(at, weights=new_set)
        firsts = np.flatnonzero(new_set)  # the sets of each signature, in order
        start = np.maximum.accumulate(np.where(new_sign[firsts], np.arange(len(firsts)), 0))
        back = STEPS[(codes[firsts] >> 3) % len(STEPS)]
        before = np.maximum(np.arange(len(firsts)) - back, start)
        before = np.where(before < np.arange(len(firsts)), firsts[before], -1)[np.cumsum(new_set) - 1]
        keep = new_row & (sets_there[at] > 1)
        number = int(table.column("bucket")[0].as_py()) << 32
        earlier = pa.array(owners[np.maximum(before[keep], 0)], mask=before[keep] < 0)
        return pa.table(
            {
                "set_id": owners[keep],
                "code": codes[keep].astype(np.int32),
                "meeting": signs[keep].astype(np.int64) + number,
                "earlier": earlier,
            }
        )

    return packed.groupBy("bucket").applyInArrow(group, MET)


BODIES = "set_id long, body binary, n long, " + ", ".join(f"{b} long" for b in BITS)


def bodies(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The hashes of the wanted sets, their sizes and parities. Of the texts with a wanted set one is hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for text in batch.column(0):
                h = shingles(text.as_py())
                if len(h):
                    found[set_id(h)] = (h.tobytes(), len(h), *parities(h))
            columns = list(zip(*found.values(), strict=True)) if found else [[]] * (2 + SKETCH)
            kinds = [pa.binary(), *[pa.int64()] * (1 + SKETCH)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                names=["set_id", "body", "n", *BITS],
            )

    texts = sets.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min("row").alias("wanted_row"))
    texts = settle(texts.select("wanted_row").distinct(), "wanted-texts")
    sent = F.broadcast(texts) if texts.count() <= SENT_ROWS else texts
    every = docs.join(sent, F.xxhash64("text") == F.col("wanted_row"), "left_semi").select("text").mapInArrow(run, BODIES)
    return every.dropDuplicates(["set_id"])


def sketched(sketches: DataFrame, side: str) -> DataFrame:
    """set_id as {side}, its size and its parities."""
    return sketches.select(F.col("set_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", *BITS)])


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs that sizes and parities do not rule out."""
    both = pairs.join(sketched(sketches, "a"), "a").join(sketched(sketches, "b"), "b")
    return both.where(plausible("a_", "b_")).select("a", "b")


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The (a, b) of pairs whose sets reach the threshold, by their whole intersections."""

    @F.pandas_udf("boolean")
    def linked(left, right):
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = np.frombuffer(x, U), np.frombuffer(y, U)
            both = len(a) + len(b) - len(np.union1d(a, b))
            out.append(WHOLE * both >= SHARE * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    pairs = settle(pairs.select("a", "b").distinct(), "pairs")
    left = bodies.select(F.col("set_id").alias("a"), F.col("body").alias("left"))
    left = left.join(pairs.select("a").distinct(), "a", "left_semi")
    right = bodies.select(F.col("set_id").alias("b"), F.col("body").alias("right"))
    size = left.agg(F.coalesce(F.sum(F.octet_length("left")), F.lit(0))).first()[0]
    left = F.broadcast(left) if size <= SENT_BYTES else left
    return pairs.join(right, "b").join(left, "a").where(linked("left", "right")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by alternating large and small stars.

    Links live in written tables; a round joins each node with the smallest of its neighbours, so that paths
    halve and every node of a component ends one link from its root.
    """
    now = settle(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links"
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.unionByName(floor.withColumnRenamed("m", "v")).distinct(), "links")
        shape = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if shape == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = shape


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    component_id is the smallest doc_id among the documents that links reach. Null and empty texts, and texts of
    blanks, have an empty set and stay alone; equal sets are one class from the start. Repeated rows stay.
    Rows with a null doc_id take part; their component is null if no row of it has an id. Other columns are not
    read; an empty table gives no rows.
    """
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, root and component_id of every row of docs.

    row is the xxhash64 of the text. Rows that links connect share a root, whatever their ids; empty sets have none.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = settle(sets_of(docs), "sets")
    facts = sets.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("smallest"),
        *[F.first(c).alias(c) for c in ("n_shingles", "own", "own_first", "low", "low_first", "low_top")],
    )
    facts = settle(facts, "set-facts")
    size = facts.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(64, math.ceil(size * 0.6 / BUCKET))
    met = settle(meetings(packed_signatures(docs, buckets)), "meetings")
    links = linked_sets(docs, sets, facts, met)
    roots = components(links)
    rooted = facts.select("set_id", "smallest").join(roots, F.col("set_id") == F.col("node"), "left")
    rooted = rooted.select("set_id", "smallest", F.coalesce("root", "set_id").alias("root"))
    named = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    labels = rooted.select("set_id", "root").join(named, "root").select("set_id", "root", "component_id")
    return sets.join(labels, "set_id", "left").select(
        "doc_id",
        "row",
        "n_shingles",
        "root",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def linked_sets(docs: DataFrame, sets: DataFrame, facts: DataFrame, met: DataFrame) -> DataFrame:
    """Links (a, b) between sets, enough to connect all sets that similarity connects."""
    n = F.col("n_shingles")
    allowed = lambda other: F.floor((n + other) / 9) + 1  # noqa: E731  units that no partner can take
    larger = F.floor(n * WHOLE / SHARE)
    rows = lambda below, filled, first, asks, keeps: facts.where(f"{filled} is not null").select(
        "set_id", "n_shingles", F.lit(below).alias("below"), F.col(filled).alias("filled"), F.col(first).alias("first"),
        asks.cast("long").alias("asks"), keeps.cast("long").alias("keeps"),
    )
    roles = rows(0, "own", "own_first", allowed(n), allowed(larger)).unionByName(
        rows(1, "low", "low_first", allowed(F.col("low_top")), allowed(F.col("low_top")))
    )
    roles = settle(roles, "roles")
    key = ["set_id", "below"]
    narrow = met.select("set_id", "meeting", "code")
    live = settle(_live(narrow, roles), "live-sets")
    member = settle(_mixed(_of(narrow, live.select(*key)).drop("below"), "set_id"), "live-meetings")
    wanted = settle(live.select("set_id").distinct(), "wanted-sets")
    known = settle(bodies(docs, sets, wanted), "bodies")
    sketches = settle(known.select("set_id", "n", *BITS), "sketches")

    # the set that stands before a set most often is tried first
    tries = (
        met.where(f"{KIND} = {EXACT} and earlier is not null")
        .join(wanted, "set_id", "left_semi")
        .join(wanted.withColumnRenamed("set_id", "earlier"), "earlier", "left_semi")
        .groupBy("set_id", "earlier")
        .agg(F.count("*").alias("c"))
    )
    best = tries.groupBy("set_id").agg(F.max_by("earlier", F.struct("c", "earlier")).alias("earlier"))
    best = best.select(F.col("set_id").alias("a"), F.col("earlier").alias("b"))
    roots = components(verified(likely(best, sketches), known))
    # then the hubs of the meetings that still join several components: copies lie nearer to what they were
    # copied from than to each other, and that shares most of their meetings; components only grow, so that a
    # meeting within one never counts again
    for _ in range(HUB_ROUNDS):
        member = settle(_mixed(_rooted(member, roots), "root"), "mixed-meetings")
        apart = settle(likely(_hub_tries(member), sketches), "hub-tries")
        if not apart.take(1):
            break
        roots = components(roots.toDF("a", "b").unionByName(verified(apart, known)))

    # meetings within one component cost nothing any more
    member = settle(_mixed(_rooted(member, roots), "root"), "mixed-meetings")
    live = settle(_live(member, roles), "live-sets")
    member = settle(_costed(_of(member, live.select(*key)).drop("below")), "costed-members")
    short = live.join(_dear(member), key).withColumn("lacks", F.col("asks") - _free()).where("lacks > 0")
    # units to buy are a set's cheapest mixed segments; if all do not suffice, neighbourhoods as well
    all_of_them = (F.col("filled") < F.col("asks")).alias("all_of_them")
    enough = F.col("filled") + F.col("first") >= F.col("asks")
    short = settle(
        short.withColumn(
            "lacks", F.when(enough, F.col("lacks")).otherwise(F.raise_error(F.lit("a set fills too few segments")))
        ).select(*key, "lacks", all_of_them),
        "short-sets",
    )
    cheapest = Window.partitionBy(*key).orderBy(F.expr(f"{KIND} <> {EXACT}"), "all", "meeting")
    bought = (
        _of(member, short)
        .withColumn("nth", F.row_number().over(cheapest))
        .where(f"all_of_them or {KIND} = {EXACT} and nth <= lacks")
    )
    # dealt by meeting while the rows are narrow
    side = lambda rows, a: rows.select(
        F.col("set_id").alias(a), "meeting", F.col("root").alias(f"{a}_root"), F.col("is_major").alias(f"{a}_major")
    ).repartition("meeting").join(sketched(sketches, a), a)
    bought, held = side(bought, "a"), side(member.where(f"{BELOW} = 0"), "b")
    # the largest component of a meeting is never joined with itself
    wanted = f"a_root <> b_root and (b_n < a_n or b_n = a_n and b < a) and {plausible('a_', 'b_')}"
    pairs = (
        bought.where("a_major").join(held.where("not b_major"), "meeting").where(wanted)
        .unionByName(bought.where("not a_major").join(held, "meeting").where(wanted))
        .select("a", "b")
    )
    second = verified(pairs, known)
    return roots.toDF("a", "b").unionByName(second)


def _rooted(met: DataFrame, roots: DataFrame) -> DataFrame:
    found = met.select("set_id", "meeting", "code").join(roots, F.col("set_id") == F.col("node"), "left")
    return found.withColumn("root", F.coalesce("root", "set_id")).drop("node")


def _hub_tries(member: DataFrame) -> DataFrame:
    """(a, b): for each set the hubs that most of its mixed meetings have in another component.

    A set weighs as much as its meetings have members; the heaviest set of a meeting is its hub.
    """
    weights = settle(member.groupBy("set_id").agg(F.sum("all").alias("weight")), "weights")
    heaviest = F.max(F.struct("weight", F.col("set_id").alias("hub"), F.col("root").alias("hub_root")))
    found = member.join(weights, "set_id").select(
        "set_id", "root", heaviest.over(Window.partitionBy("meeting")).alias("h")
    )
    tries = found.where("root <> h.hub_root").groupBy("set_id", F.col("h.hub").alias("hub")).agg(F.count("*").alias("c"))
    nth = Window.partitionBy("set_id").orderBy(F.desc("c"), "hub")
    best = tries.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= HUBS)
    return best.select(F.col("set_id").alias("a"), F.col("hub").alias("b"))


def _mixed(met: DataFrame, apart: str) -> DataFrame:
    """The meetings of sets that differ in `apart`, with the number of their members as `all`."""
    there = Window.partitionBy("meeting")
    ends = {"low": F.min(apart).over(there), "high": F.max(apart).over(there), "all": F.count("*").over(there)}
    return met.withColumns(ends).where("low < high").drop("low", "high")


def _costed(met: DataFrame) -> DataFrame:
    """The mixed meetings, with the component that has most members there marked as major."""
    of_root = _mixed(met.drop("all"), "root").withColumn("c", F.count("*").over(Window.partitionBy("meeting", "root")))
    most = F.max(F.struct("c", "root")).over(Window.partitionBy("meeting"))
    return of_root.withColumn("most", most).withColumn("is_major", F.expr("root = most.root")).drop("c", "most")


def _live(met: DataFrame, roles: DataFrame) -> DataFrame:
    """The roles of sets that may still have a partner: others have more free units than differences allowed."""
    return roles.join(_dear(met), ["set_id", "below"]).where(_free() < F.col("keeps")).drop("dear", "near")


def _of(met: DataFrame, roles: DataFrame) -> DataFrame:
    """The meetings of the given roles. Those that then join nothing are free in turn."""
    return met.withColumn("below", F.expr(BELOW)).join(roles, ["set_id", "below"])


def _dear(met: DataFrame) -> DataFrame:
    """For each set and scheme, its segments that meet others and its first ones that do so in any way."""
    first = F.expr(f"if({SEGMENT} < {NEIGHBOURED}, shiftleft(1, {SEGMENT}), 0)")
    return met.groupBy("set_id", F.expr(BELOW).alias("below")).agg(
        F.count_if(F.expr(f"{KIND} = {EXACT}")).alias("dear"), F.bit_count(F.bit_or(first)).alias("near")
    )


def _free() -> Column:
    """Segments that cost nothing, one unit each, and first ones whose neighbourhoods do not either, one more."""
    return F.col("filled") - F.col("dear") + F.greatest(F.col("first") - F.col("near"), F.lit(0))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE body AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[s : s + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS s FROM body WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS hits
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * hits >= 80 * (p.n + q.n - hits)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT x, y FROM edges
  UNION
  SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON x = d.doc_id
"""
