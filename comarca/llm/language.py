"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from a bounded sample of its labelled documents. A
text is encoded against every dictionary, in blocks so that the dictionary counts over its whole length; the
smallest total names the language. The relative distance to the second smallest total is the score, and texts
with a narrow one can be rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from comarca.llm.common import arrow_batches, documents, held_out
from comarca.session import settle

#: The sample a dictionary is cut from: at most so many different texts of a language, those that hash lowest, and
#: at most so many bytes of each, so that no document fills a dictionary alone. A longer text gives them in PLACES
#: pieces, one from each of as many equal parts, at a place in it that the text's hash chooses.
SAMPLE_DOCS = 60
SAMPLE_BYTES = 1024
PLACES = 8
LANGUAGES = 512  # languages that give SAMPLE_DOCS texts each; more languages give fewer texts each
PARTS = 64  # in which the texts of a language are ranked before they are ranked together
BLOCK = 8192  # bytes encoded at once
#: Lazy matching with tables fitted to the size of a dictionary: they are set up anew for every block.
CODER = {
    "strategy": zstandard.STRATEGY_LAZY,
    "window_log": 17,
    "hash_log": 15,
    "chain_log": 15,
    "search_log": 3,
    "min_match": 4,
    "target_length": 8,
}
NARROW = 0.005  # a score below this is rejected
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The words of a text in lower case, parted by single blanks: case, digits and signs name no language."""
    return OTHER.sub(" ", text.lower()).strip()


def pieces(text: Column, size: int, places: int = PLACES) -> Column:
    """The text as one piece if it has at most `size` bytes, else `places` pieces from all over it."""
    part = F.floor(F.length(text) / places)
    each = F.least(part, F.lit(size // places)).cast("int")

    def at(i: int) -> Column:
        start = F.lit(i) * part + F.pmod(F.xxhash64(text, F.lit(i)), part - each + 1)
        return F.substring(text, (start + 1).cast("int"), each)

    return F.when(F.octet_length(text) <= size, F.array(text)).otherwise(F.array(*[at(i) for i in range(places)]))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """One raw-content dictionary per value of lang, from rows with a text and a lang; copies count once.

    At most LANGUAGES * sample_docs texts are taken: with more languages than LANGUAGES each gives fewer, but one.
    """
    rows = (
        docs.select("lang", F.col("text").cast("string").alias("text"))
        .where("lang is not null and text is not null and length(text) > 0")
        .withColumn("_hash", F.xxhash64("text"))
    )
    # the lowest hashes of each part of a language, then of those: no task orders a whole language
    part = F.pmod("_hash", F.lit(PARTS))
    inside = Window.partitionBy("lang", part).orderBy("_hash")
    chosen = rows.select("lang", "_hash").distinct().withColumn("_nth", F.row_number().over(inside))
    chosen = chosen.where(F.col("_nth") <= sample_docs).drop("_nth")
    lowest = Window.partitionBy("lang").orderBy("_hash")
    chosen = chosen.withColumn("_nth", F.row_number().over(lowest)).where(F.col("_nth") <= sample_docs)
    chosen = settle(chosen, "chosen")
    languages = max(1, chosen.select("lang").distinct().count())
    chosen = chosen.where(F.col("_nth") <= max(1, min(sample_docs, LANGUAGES * sample_docs // languages)))
    sample = (
        rows.join(F.broadcast(chosen), ["lang", "_hash"])  # LANGUAGES * sample_docs rows at most, or one a language
        .select("lang", "_nth", pieces(F.col("text"), sample_bytes).alias("pieces"))
        .groupBy("lang", "_nth")
        .agg(F.min("pieces").alias("pieces"))
    )
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for row in sample.toLocalIterator():
        each = sample_bytes // len(row["pieces"])
        body = b" ".join(letters(t).encode()[:each] for t in row["pieces"])
        texts.setdefault(row["lang"], []).append((row["_nth"], body))
    return {lang: b"\n".join(t for _, t in sorted(rows, reverse=True)) for lang, rows in sorted(texts.items())}


class Encoders:
    """Compressors of all languages, built once in each task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.coders = []
        bare = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        params = zstandard.ZstdCompressionParameters(**CODER, **bare)
        for raw in dictionaries.values():
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params))
        self.frame = len(zstandard.ZstdCompressor(compression_params=params).compress(b""))

    def sizes(self, words: str) -> list[int]:
        body = words.encode()
        blocks = [body[i : i + BLOCK] for i in range(0, len(body), BLOCK)]
        return [sum(len(c.compress(b)) - self.frame for b in blocks) for c in self.coders]

    def classify(self, text: str | None) -> tuple[str, float]:
        words = letters(text) if text is not None and self.langs else ""
        if not words:
            return UNKNOWN, 0.0
        sizes = self.sizes(words)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        others = [s for i, s in enumerate(sizes) if i != best]
        if not others:
            return self.langs[best], 1.0
        second = max(1, min(others))
        return self.langs[best], min(1.0, max(0.0, 1.0 - sizes[best] / second))


def classify(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """Append lang_pred, lang_score and lang_rejected to the rows of docs, from their text alone.

    A null text and one without a letter are `und` with score 0 and rejected. Texts whose two best languages
    compress them nearly alike (score under `narrow`) keep the better one and are marked rejected. Ties go to
    the first language in order. Repeated rows stay; an empty table gives no rows. Input columns of the three
    names are replaced.
    """
    arrow_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "lang_score", "lang_rejected")
    at = kept.columns.index("text")
    raw = docs.sparkSession.sparkContext.broadcast(dictionaries)  # LANGUAGES * SAMPLE_DOCS * SAMPLE_BYTES, or one text a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Encoders(raw.value)
        for batch in batches:
            found = [coders.classify(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[0] == UNKNOWN or f[1] < narrow for f in found], pa.bool_()),
                ],
                names=[*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"],
            )

    added = StructType().add("lang_pred", "string").add("lang_score", "double").add("lang_rejected", "boolean")
    schema = StructType([*kept.schema.fields, *added.fields])
    return kept.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = learn(training_rows(docs))
    return classify(docs.select("doc_id", "text"), known).select(
        "doc_id",
        held_out().alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )
