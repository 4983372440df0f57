"""A training corpus from raw documents: every stage is written and read again as the documents of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm import decontaminate, jaccard_join, language, line_dedup, packing
from comarca.llm.common import SENT_ROWS, unused, without
from comarca.session import configure, settle

WORDED = r"[^\x20\x09-\x0D]"  # a text with any of these has words to the near-duplicate join


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; what the classifier rejects goes."""
    configure(spark)
    columns = docs.columns
    known = language.learn(language.training_rows(docs))
    return language.classify(docs, known).where(~F.col("lang_rejected")).select(*columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines stay in one document only; n_chars follows the text."""
    configure(spark)
    cleaned = line_dedup.clean(docs, line_dedup.index_of(docs))
    return cleaned.select(
        *[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    )


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the texts that near-duplicate links connect, the one with the smallest doc_id, nulls last.

    Rows are told apart by doc_id and text: unlinked texts under one doc_id stay, and linked rows without a doc_id
    count as copies. A row repeated with its text stays once. Texts without words have no links and all stay.
    """
    configure(spark)
    groups = settle(jaccard_join.grouped(docs).where("root is not null").select("doc_id", "row", "root"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row")
    first = groups.groupBy("root").agg(F.min(order).alias("kept"), F.count("*").alias("n")).where("n > 1")
    first = settle(first.select(F.col("root").alias("of"), "kept"), "kept")
    sent = F.broadcast(first) if first.count() <= SENT_ROWS else first
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("row") == F.col("kept.row"))
    kept = without(docs, groups.join(sent, F.col("root") == F.col("of")).where(~same))
    if not groups.groupBy("doc_id", "row").count().where("count > 1").take(1):
        return kept
    row, part = unused(docs.columns, "text_row"), unused(docs.columns, "text_part")
    empty = F.monotonically_increasing_id()
    worded = F.coalesce(F.col("text").rlike(WORDED), F.lit(False))
    once = kept.withColumns({row: F.xxhash64("text"), part: F.when(worded, F.lit(-1)).otherwise(empty)})
    return once.dropDuplicates(["doc_id", row, part]).drop(row, part)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a benchmark passage, whatever their doc_id: each row goes or stays by its own text."""
    configure(spark)
    return without(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, placed in sequences."""
    configure(spark)
    return packing.pack(docs)


STAGES = [
    ("language", keep_language),
    ("line_dedup", drop_lines),
    ("ngram_join", one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Compression and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again by the next; the rows are those of the last.

    Empty documents give no rows; an empty benchmark contaminates nothing.
    """
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
