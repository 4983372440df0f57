"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Packing looks at lengths alone, so the plan is made on the histogram of lengths, of at most as many entries as
a sequence has tokens: dominating sets are fixed with their whole multiplicity, the rest goes by best fit in
decreasing order. The plan is a list of patterns (lengths of one sequence) with counts; its size depends on
the capacity, not on the corpus. Pieces are then ranked within their length and the rank says which copy of
which pattern a piece fills, so no task sees more than its own rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm.common import arrow_batches, documents, numbered
from comarca.session import settle

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary for the encoder that takes single words fast
#: Fixed value: the vocabulary's own split of a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000  # words whose ids a task keeps
PROBED = 256  # words of a task's first batch on which the two encoders are held against each other
#: White space of the tokenizer's own pattern; a word never crosses from a sign to white space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------------------------------------- the plan


def reduce_instance(lengths: dict[int, int], capacity: int) -> tuple[Counter, dict[int, int]]:
    """Fix dominating sets: (patterns with counts, the lengths that remain).

    From the longest item down, an item and a partner are fixed together when no other set that holds the item
    can beat it: the partner fills the sequence exactly; or nothing else fits with the item; or the longest
    partner that fits is at least as long as any pair that fits, and three never fit. Such a set can be
    exchanged for any other without needing more sequences.
    """
    left = Counter({n: c for n, c in lengths.items() if c > 0})
    fixed: Counter = Counter()

    def fix(items: tuple[int, ...], times: int) -> None:
        fixed[items] += times
        for n in items:
            left[n] -= times
            if not left[n]:
                del left[n]

    for item in sorted(left, reverse=True):
        while left.get(item):
            room = capacity - item
            sizes = sorted(n for n in left if n <= room)
            if sizes and sizes[-1] == item and left[item] == 1:
                sizes.pop()  # the only one of its length is not its own partner
            if not sizes:
                fix((item,), left[item])
                continue
            partner = sizes[-1]
            count = left[item] // 2 if partner == item else min(left[item], left[partner])
            if partner == room:
                fix((item, partner), count)
                continue
            free = Counter({n: left[n] - (n == item) for n in sizes})
            least = sorted(n for n in sizes for _ in range(min(3, free[n])))[:3]
            if len(least) == 3 and sum(least) <= room:
                break  # three partners fit: no rule applies
            if len(least) >= 2 and sum(least[:2]) <= room and _best_pair(sizes, free, room) > partner:
                break
            # the smallest partners only grow as copies are fixed, so the rule holds for every copy
            fix((item, partner), count)
    return fixed, dict(left)


def _best_pair(sizes: list[int], free: Counter, room: int) -> int:
    """The largest sum of two partners within room."""
    best, low, high = 0, 0, len(sizes) - 1
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room:
            high -= 1
        elif low == high:
            if free[sizes[low]] > 1:
                best = max(best, total)
            break
        else:
            best = max(best, total)
            low += 1
    for n in sizes:
        if free[n] > 1 and 2 * n <= room:
            best = max(best, 2 * n)
    return best


def best_fit(lengths: dict[int, int], capacity: int) -> Counter:
    """Best fit in decreasing order on counted lengths: patterns with counts.

    Sequences with the same content are handled as one entry, so that a step moves whole counts.
    """
    rooms: list[Counter] = [Counter() for _ in range(capacity + 1)]  # by free tokens: pattern -> sequences
    for size in sorted(lengths, reverse=True):
        waiting = lengths[size]
        while waiting:
            room = next((r for r in range(size, capacity + 1) if rooms[r]), None)
            if room is None:
                each = min(capacity // size, waiting)
                rooms[capacity - each * size][(size,) * each] += waiting // each
                waiting -= waiting // each * each
                continue
            pattern, there = next(iter(rooms[room].items()))
            each = min(room // size, waiting)
            used = min(there, waiting // each)
            rooms[room][pattern] -= used
            if not rooms[room][pattern]:
                del rooms[room][pattern]
            rooms[room - each * size][pattern + (size,) * each] += used
            waiting -= used * each
    packed: Counter = Counter()
    for at in rooms:
        packed.update(at)
    return packed


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with counts that hold every length as often as it occurs."""
    fixed, left = reduce_instance(lengths, capacity)
    packed = fixed + best_fit(left, capacity)
    return sorted(packed.items(), reverse=True)


def runs_of(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length its runs of ranks: (first rank, sequence of the first rank, offset)."""
    runs: dict[int, tuple[list[int], list[int], list[int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            first, base, place = runs.setdefault(size, ([], [], []))
            first.append(taken[size])
            base.append(sequence)
            place.append(offset)
            taken[size] += count
            offset += size
        sequence += count
    return runs


# ---------------------------------------------------------------------------------------------- the pieces


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes, words kept in a bounded cache.

    The vocabulary's pattern ends a word wherever white space follows a sign, so the ids of a text are those of
    its parts from one such place to the next; invented or natural, words repeat, and most parts are cached.
    New parts go through the rank form of the vocabulary, whose encoder spends a fraction of the time on a
    short text; each task holds it against the tokenizer itself first. Without a folder the vocabularies are those
    of the installed package.
    """

    def __init__(self, folder: str | None = None, vocabulary: str = VOCABULARY, ranks: str = RANKS):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        place = public_tokenizers.path if folder is None else (lambda name: f"{folder}/{name}")
        self.tokenizer = Tokenizer.from_file(place(vocabulary))
        with open(place(ranks), "rb") as lines:
            known = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.probed = False
        self.uneven = re.compile(f" [{SPACES}]|[{SPACES}] ")
        self.part = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def parts(self, text: str) -> list[str]:
        if self.uneven.search(text):
            return self.part.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]

    def of(self, texts: list[str]) -> list[bytes]:
        split = [None if any(s in t for s in self.special) else self.parts(t) for t in texts]
        unknown = list({p for parts in split if parts for p in parts}.difference(self.known))
        if len(self.known) + len(unknown) > CACHE:
            self.known.clear()
            unknown = list({p for parts in split if parts for p in parts})
        if not self.probed and unknown:
            self.probed = True
            for part in unknown[:PROBED]:
                if self.words.encode_ordinary(part) != self.tokenizer.encode(part, add_special_tokens=False).ids:
                    raise ValueError("the rank file holds another vocabulary")
        for part in unknown:
            found = self.words.encode_ordinary(part)
            self.known[part] = struct.pack(f"<{len(found)}I", *found)
        ids = self.known.__getitem__
        return [
            self.whole(t) if parts is None else b"".join(map(ids, parts)) for t, parts in zip(texts, split, strict=True)
        ]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of capacity, the first one shorter if need be."""
    head = length % capacity or capacity
    return [(0, head), *((start, capacity) for start in range(head, length, capacity))]


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    folder: str | None = None,
    vocabulary: str = VOCABULARY,
    end: int = END,
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row; a null text is empty."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Ids(folder, vocabulary)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, body in zip(batch.column(0).to_pylist(), coder.of(texts), strict=True):
                ids = body + last
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Place every piece of every document in a sequence of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one piece
    that holds the end id alone. Rows with a null or repeated doc_id are packed like any other. Ties among
    equal lengths are broken by rank: any piece may take any place of its length. An empty table gives no rows.
    """
    cut_up = settle(pieces(docs, capacity, folder, vocabulary), "pieces")
    lengths = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}  # capacity rows at most
    runs = runs_of(plan(lengths, capacity))
    sent = docs.sparkSession.sparkContext.broadcast(runs)  # bounded by the capacity, not by the corpus

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = [], []
        for size, nth in zip(length, rank, strict=True):
            first, base, places = sent.value[size]
            at = bisect_right(first, nth) - 1
            sequence.append(base[at] + nth - first[at])
            offset.append(places[at])
        return pd.DataFrame({"sequence_id": sequence, "offset": offset}, dtype="int64")

    ranked = numbered(cut_up, "length", ["doc_id", "piece", "ids_crc32"], "_rank")
    return ranked.withColumn("_at", place("length", "_rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset"
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
