"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

Every text is cut into words once; a written table holds the 64-bit hashes of each text's words in order. Benchmark
items are cut into phrases (windows). Their terms are counted over all texts; the two rarest terms of a phrase are
its anchors. The index stores the postings (term, doc_id, row, position, words beside it) of every anchor. Postings
moved back by the anchor's place in the phrase are starts; on starts that both anchors share the whole phrase is
held against the text. Words are told apart by their hashes.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comarca.llm.common import documents
from comarca.session import settle

WORDS = 10
#: Words before lower-casing: everything but ASCII signs, blanks and controls.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000  # benchmark terms or phrases sent to every task up to this count, else joined by shuffle


def lowered(words: Column) -> Column:
    return F.translate(words, ascii_uppercase, ascii_lowercase)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def term(word: Column) -> Column:
    """The hash of a word with A-Z lower-cased; the faster function does so in words of ASCII alone."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.xxhash64(F.when(plain, F.lower(word)).otherwise(lowered(word)))


def tokens_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_words, terms) of every text, written. row is a hash of the text."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("row"), F.transform(words_of(F.col("text")), term).alias("terms"))
    return settle(cut.select("doc_id", "row", F.size("terms").cast("long").alias("n_words"), "terms"), "tokens")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A frame to be broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def phrases(items: DataFrame, words: int = WORDS) -> DataFrame:
    """(phrase, item_id): windows of `words` words, or the whole of a shorter item, as arrays of terms."""
    body = items.select("item_id", F.transform(words_of(F.col("text")), term).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (words - 1), F.lit(1)))
    return (
        body.select("item_id", "words", F.explode(starts).alias("start"))
        .select("item_id", F.slice("words", F.col("start"), words).alias("phrase"))
        .distinct()
    )


def frequency_of(tokens: DataFrame, vocabulary: DataFrame, n_terms: int) -> DataFrame:
    """(term, n): how often each term of the vocabulary stands in all texts."""
    every = tokens.select(F.explode("terms").alias("term"))
    return every.join(bounded(vocabulary, n_terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def anchored(spans: DataFrame, frequency: DataFrame) -> DataFrame:
    """For each phrase its two rarest terms with their places; a phrase of one term has one anchor.

    spans has phrase_id, phrase; frequency has term, n. A phrase with a term that is nowhere cannot occur and
    is left out.
    """
    terms = spans.select("phrase_id", F.posexplode("phrase").alias("place", "term"))
    known = terms.join(frequency, "term", "left")
    absent = known.where("n is null").select("phrase_id").distinct()
    order = Window.partitionBy("phrase_id").orderBy("n", "term", "place")
    rarest = (
        known.join(absent, "phrase_id", "left_anti")
        .groupBy("phrase_id", "term")
        .agg(F.min("place").alias("place"), F.min("n").alias("n"))
        .withColumn("rank", F.row_number().over(order))
        .where("rank <= 2")
    )
    return rarest.select("phrase_id", "term", "place", "rank")


def occurrences(tokens: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, row, start, length, phrase_id, items) of every occurrence of a phrase in a text of ``tokens_of``.

    row is a hash of the text, which tells different texts of one doc_id apart.
    """
    held = settle(
        phrases(items, words)
        .groupBy("phrase")
        .agg(F.collect_set("item_id").alias("items"))  # bounded by the benchmark
        .withColumn("phrase_id", F.monotonically_increasing_id()),
        "phrases",
    )
    spans = held.select("phrase_id", "phrase")
    vocabulary = settle(spans.select(F.explode("phrase").alias("term")).distinct(), "terms")
    n_terms = vocabulary.count()
    frequency = settle(frequency_of(tokens, vocabulary, n_terms), "frequency")
    anchors = settle(anchored(spans, frequency), "anchors")
    postings = settle(index_of(tokens, anchors.select("term").distinct(), n_terms), "postings")
    n_anchors = anchors.count()
    # offset-adjusted lists: the start that a posting gives to each phrase anchored on its term; a posting whose
    # neighbours are not those of the anchor in the phrase gives none
    beside = anchors.join(spans, "phrase_id").select(
        "term", "phrase_id", "place", "rank",
        F.get("phrase", F.col("place") - 1).alias("left"), F.get("phrase", F.col("place") + 1).alias("right"),
    )
    agree = lambda there, wanted: F.col(wanted).isNull() | (F.col(there) == F.col(wanted))
    aligned = (
        postings.join(bounded(beside, n_anchors), "term")
        .where((F.col("position") >= F.col("place")) & agree("before", "left") & agree("after", "right"))
        .select("doc_id", "row", (F.col("position") - F.col("place")).alias("start"), "phrase_id", "rank")
    )
    # starts on which all anchors of a phrase agree
    needed = anchors.groupBy("phrase_id").agg(F.bit_or("rank").alias("needed"))
    shared = (
        aligned.groupBy("doc_id", "row", "start", "phrase_id")
        .agg(F.bit_or("rank").alias("met"))
        .join(bounded(held.join(needed, "phrase_id"), n_anchors), "phrase_id")
        .where("met = needed")
        .select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "start", "phrase_id", "phrase", "items")
    )
    shared = settle(shared, "starts")
    # the whole phrase against the text; repeated rows give their occurrences each
    suspects = shared.select(F.col("_id").alias("_s"), F.col("_row").alias("_r")).distinct()
    asked = F.col("doc_id").eqNullSafe(F.col("_s")) & (F.col("row") == F.col("_r"))
    bodies = tokens.join(bounded(suspects, suspects.count()), asked, "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    length = F.size("phrase")
    return (
        bodies.join(shared, same)
        .where(F.slice("terms", F.col("start") + 1, length) == F.col("phrase"))
        .select("doc_id", "row", "start", length.alias("length"), "phrase_id", "items")
    )


def index_of(tokens: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Postings (term, doc_id, row, position, before, after) of the given terms in all texts.

    before and after are the terms beside a posting, null at the ends of a text.
    """
    spread = tokens.select("doc_id", "row", "terms", F.posexplode("terms").alias("position", "term"))
    return spread.join(bounded(terms, n_terms), "term", "left_semi").select(
        "term",
        "doc_id",
        "row",
        "position",
        F.when(F.col("position") > 0, F.get("terms", F.col("position") - 1)).alias("before"),
        F.get("terms", F.col("position") + 1).alias("after"),
    )


def proximity(docs: DataFrame, items: DataFrame, within: int, words: int = WORDS) -> DataFrame:
    """(doc_id, row, first, phrase_id, gap): places where the two anchors of a phrase stand near each other.

    One row for each posting of the rarest term that has one of the other term at most `within` words away in
    its text, in either order, with the distance to the nearest. Phrases of one term have no such place.
    """
    held = phrases(items, words).select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id())
    held = settle(held, "phrases")
    terms = settle(held.select(F.explode("phrase").alias("term")).distinct(), "terms")
    tokens, n_terms = tokens_of(docs), terms.count()
    anchors = settle(anchored(held, frequency_of(tokens, terms, n_terms)), "anchors")
    postings = settle(
        index_of(tokens, anchors.select("term").distinct(), n_terms).select("term", "doc_id", "row", "position").distinct(), "postings"
    )
    cell = F.floor(F.col("position") / within)
    both = postings.join(anchors, "term").select("doc_id", "row", "phrase_id", "rank", "position", cell.alias("cell"))
    first = both.where("rank = 1").withColumnRenamed("position", "first")
    # a posting is near those of its own cell and of the two beside it at most
    second = both.where("rank = 2").select(
        "doc_id",
        "row",
        "phrase_id",
        F.col("position").alias("other"),
        F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"),
    )
    gap = F.abs(F.col("first") - F.col("other"))
    near = first.join(second, ["doc_id", "row", "phrase_id", "cell"]).where(gap <= within)
    return near.groupBy("doc_id", "row", "first", "phrase_id").agg(F.min(gap).alias("gap"))


def decontaminate(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs.

    Null and empty texts have no words and no hits; items without words, with a null text or id, are never
    found. Repeated rows are reported each. Rows with a null doc_id are kept and searched. The digest of no
    items is that of an empty string. Other columns of either table are not read.
    """
    tokens = tokens_of(docs.select("doc_id", "text"))
    hits = settle(occurrences(tokens, items.where("item_id is not null"), words), "hits")
    at = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))
    hit = hits.select("doc_id", "row", at.alias("position")).distinct()
    of_words = hit.groupBy("doc_id", "row").agg(F.count("*").alias("n_hit"))
    item = hits.select("doc_id", "row", F.explode(F.col("items").cast("array<string>")).alias("item")).distinct()
    of_items = item.groupBy("doc_id", "row").agg(
        F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("names")
    )
    keys = [F.col("w.doc_id").eqNullSafe(F.col("i.doc_id")), F.col("w.row") == F.col("i.row")]
    dirty = of_words.alias("w").join(of_items.alias("i"), keys).select(
        F.col("w.doc_id").alias("_id"), F.col("w.row").alias("_row"), "n_hit", "n_items", "names"
    )
    counts = tokens.select("doc_id", "row", "n_words")
    joined = counts.join(dirty, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, row) of the texts with a benchmark passage, once each; row is the xxhash64 of the text."""
    hits = occurrences(tokens_of(docs.select("doc_id", "text")), items.where("item_id is not null"), words)
    return hits.select("doc_id", "row").distinct()


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
goal AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
spans AS (
  SELECT DISTINCT item_id, words[s : s + least(10, len(words)) - 1] AS phrase
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM goal WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT len(phrase) AS n FROM spans),
windows AS (
  SELECT doc_id, s, n, words[s : s + n - 1] AS phrase
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM cut, sizes WHERE len(words) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM windows JOIN spans USING (phrase)),
spots AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS spot FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)
"""
