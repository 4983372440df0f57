"""Preference formatting of paired conversations, in DataFrame operations only.

A pair is two lists of turns, a chosen and a rejected one. The turns they begin with in common are the prompt,
rendered once; what follows on either side is that side's completion, in which only the assistant's own words
are trained on. Turns are rows until they are joined to whole texts, which are cut after a fixed number of turn
numbers, so that no conversation, however long, becomes one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comarca.operators.ranking import range_offsets

OPEN, HEAD_END, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
PIECE_TURNS = 1024  # turn numbers whose texts are joined in one row


def tidy(turns: DataFrame, key: str) -> DataFrame:
    """pair_id, turn, role, text: one row for each turn.

    Null roles and texts are empty. Repeated turns count once; of turns with the same number that differ, the
    first in order of role and text stays. Rows without a pair or a number belong to no conversation.
    """
    kept = turns.select(
        F.col(key).alias("pair_id"),
        F.col("turn").cast("long").alias("turn"),
        F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"),
    ).where("pair_id is not null and turn is not null")
    return kept.groupBy("pair_id", "turn").agg(F.min("said").alias("said")).select("pair_id", "turn", "said.*")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(HEAD_END), text, F.lit(CLOSE))


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """pair_id, part, turn, role, rendered, train_from, train_to.

    part is `prompt` (the common turns, once), `chosen` or `rejected`. The characters of rendered from train_from
    to before train_to are trained on: an assistant's words and their end mark in a completion; elsewhere the
    two are equal. Sides that are alike have only a prompt; a pair with one side has only that completion.
    """
    sides = tidy(chosen, key).alias("c").join(tidy(rejected, key).alias("r"), ["pair_id", "turn"], "full")
    both = sides.select(
        "pair_id",
        "turn",
        F.struct("c.role", "c.text").alias("c"),
        F.struct("r.role", "r.text").alias("r"),
        ((F.col("c.role") == F.col("r.role")) & (F.col("c.text") == F.col("r.text"))).alias("same"),
    )
    differ = both.where(~F.coalesce("same", F.lit(False))).groupBy("pair_id").agg(F.min("turn").alias("split"))
    placed = both.join(differ, "pair_id", "left")
    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    part = lambda name, side: F.struct(
        F.lit(name).alias("part"), F.col(f"{side}.role").alias("role"), F.col(f"{side}.text").alias("text")
    )
    parts = F.when(common, F.array(part("prompt", "c"))).otherwise(F.array(part("chosen", "c"), part("rejected", "r")))
    turns = placed.select("pair_id", "turn", F.explode(parts).alias("p")).select("pair_id", "turn", "p.*")
    head = F.lit(len(OPEN) + len(HEAD_END)) + F.char_length("role")
    whole = rendered(F.col("role"), F.col("text"))
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED_ROLE)
    return turns.where("role is not null").select(
        "pair_id",
        "part",
        "turn",
        "role",
        whole.alias("rendered"),
        F.when(trained, head).otherwise(0).cast("long").alias("train_from"),
        F.when(trained, F.char_length(whole)).otherwise(0).cast("long").alias("train_to"),
    )


def paired(turns: DataFrame) -> DataFrame:
    """pair_id, piece, prompt, chosen, rejected, chosen_train, rejected_train: the texts of pairs, joined.

    turns are the rows of format_pairs. A pair has one row, piece 0, if its turns are numbered from 0 to
    PIECE_TURNS - 1; a longer one has a row for every PIECE_TURNS numbers, in order of piece. A text that a piece
    lacks is empty. chosen_train and rejected_train name the characters of the completions that are trained on, as
    `from-to` (from 0, to excluded) joined by commas; all others, and the prompt, are masked.
    """
    said = turns.select(
        "pair_id",
        F.floor(F.col("turn") / PIECE_TURNS).cast("long").alias("piece"),
        F.struct("turn", "part", "rendered", "train_from", "train_to").alias("t"),
    )
    whole = said.groupBy("pair_id", "piece").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    of = lambda part: F.filter("turns", lambda t: t["part"] == part)
    text = lambda part: F.array_join(F.transform(of(part), lambda t: t["rendered"]), "")

    def spans(part: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

        def step(state: Column, t: Column) -> Column:
            named = F.concat_ws("-", state["at"] + t["train_from"], state["at"] + t["train_to"])
            grown = F.when(t["train_from"] < t["train_to"], F.array_append(state["spans"], named)).otherwise(state["spans"])
            return F.struct((state["at"] + F.char_length(t["rendered"])).alias("at"), grown.alias("spans"))

        return F.aggregate(of(part), start, step, lambda state: F.array_join(state["spans"], ","))

    return whole.select(
        "pair_id",
        "piece",
        text("prompt").alias("prompt"),
        text("chosen").alias("chosen"),
        text("rejected").alias("rejected"),
        spans("chosen").alias("chosen_train"),
        spans("rejected").alias("rejected_train"),
    )


def successors(ids: DataFrame) -> DataFrame:
    """(pair_id, next_id) of distinct ids of any orderable type: each with the one that follows, the last with none."""
    ranged, before = range_offsets(ids.select("pair_id", F.lit(1).alias("one")), "pair_id", "one")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("pair_id"))
    placed = ranged.withColumn("_nth", inside).join(before, "_range")
    placed = placed.select("pair_id", (F.col("_before") + F.col("_nth")).alias("place"))
    after = placed.select(F.col("pair_id").alias("next_id"), (F.col("place") - 1).alias("place"))
    return placed.join(after, "place", "left").select("pair_id", "next_id")


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs made of a table of conversations: each one up to its last reply, against the same turns with the
    last reply of the next conversation in order of the ids, whatever their gaps, or without one for the last."""
    said = tidy(turns, "conv_id")
    last = said.where(F.col("role") == TRAINED_ROLE).groupBy("pair_id").agg(F.max("turn").alias("last"))
    upto = said.join(last, "pair_id").where("turn <= last")
    reply = upto.where("turn = last").select(F.col("pair_id").alias("next_id"), "role", "text")
    rejected = upto.where("turn < last").select("pair_id", "turn", "role", "text")
    other = last.join(successors(last), "pair_id").join(reply, "next_id")
    other = other.select("pair_id", F.col("last").alias("turn"), "role", "text")
    return upto.select("pair_id", "turn", "role", "text"), rejected.unionByName(other)


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with a reply as a preference pair: prompt, masked completions and their trained spans."""
    chosen, rejected = swapped_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return paired(format_pairs(chosen, rejected)).withColumnRenamed("pair_id", "conv_id")


SQL = """
WITH said AS (
  SELECT conv_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS s
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
last AS (SELECT conv_id, max(turn) AS last FROM said WHERE s.role = 'assistant' GROUP BY conv_id),
upto AS (SELECT conv_id, turn, last, s.role AS role, s.text AS text FROM said JOIN last USING (conv_id) WHERE turn <= last),
followed AS (SELECT conv_id, last, lead(conv_id) OVER (ORDER BY conv_id) AS next_id FROM last),
other AS (
  SELECT conv_id, turn, role, text FROM upto WHERE turn < last
  UNION ALL
  SELECT l.conv_id, l.last, u.role, u.text FROM followed l JOIN upto u ON u.conv_id = l.next_id AND u.turn = u.last),
paired AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn,
    c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text
  FROM upto c FULL JOIN other r ON c.conv_id = r.conv_id AND c.turn = r.turn),
differ AS (
  SELECT conv_id, min(turn) AS split FROM paired
  WHERE NOT coalesce(c_role = r_role AND c_text = r_text, false) GROUP BY conv_id),
parts AS (
  SELECT p.conv_id, 'prompt' AS part, turn, c_role AS role, c_text AS text
  FROM paired p LEFT JOIN differ USING (conv_id) WHERE split IS NULL OR turn < split
  UNION ALL
  SELECT p.conv_id, 'chosen', turn, c_role, c_text FROM paired p JOIN differ USING (conv_id) WHERE turn >= split
  UNION ALL
  SELECT p.conv_id, 'rejected', turn, r_role, r_text FROM paired p JOIN differ USING (conv_id) WHERE turn >= split),
shown AS (
  SELECT conv_id, part, turn, role, CAST(floor(turn / 1024.0) AS BIGINT) AS piece,
    '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
  FROM parts WHERE role IS NOT NULL),
placed AS (
  SELECT *, sum(length(rendered)) OVER (PARTITION BY conv_id, piece, part ORDER BY turn) - length(rendered) AS begun
  FROM shown),
spans AS (
  SELECT *, CASE WHEN role = 'assistant' THEN CAST(begun + 13 + length(role) AS BIGINT) || '-'
    || CAST(begun + length(rendered) AS BIGINT) END AS span FROM placed)
SELECT conv_id, piece,
  coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (WHERE part = 'prompt'), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (WHERE part = 'chosen'), '') AS chosen,
  coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (WHERE part = 'rejected'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn) FILTER (WHERE part = 'chosen'), '') AS chosen_train,
  coalesce(string_agg(span, ',' ORDER BY turn) FILTER (WHERE part = 'rejected'), '') AS rejected_train
FROM spans GROUP BY conv_id, piece
"""
