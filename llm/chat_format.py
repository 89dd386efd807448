"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The longest common prefix of turns is rendered once, as the prompt. What follows on either side is its completion,
rendered with the character spans that take part in the loss: texts of assistant turns with their end marks.
All work is in expressions over one row a pair; the only shuffle gathers turns to conversations.

* Turns are ordered by number, then role, then text; a null number comes last. Equal rows are one turn.
* A null role is rendered as ``unknown``, a null text as empty; two turns are equal if both then are.
* A mark inside a text is broken up (``<|`` becomes ``< |``), so that no text can end its turn.
* If one side is a prefix of the other its completion is empty. A pair is trainable if both completions have a
  loss span. Null or empty conversations are empty lists. A null id is an id like any other. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SPEAKER = "assistant"


def conversations(turns: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as an array of (role, text)."""
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).isNull().alias("unnumbered"),
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    return ordered.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )


def stale_reply_pairs(convs: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) of (conv_id, turns): a conversation up to its last reply, against one that repeats itself.

    In the rejected conversation the last reply is the first one over again. With a single reply, or two equal
    ones, it is missing. Without any reply both sides are the whole conversation.
    """
    said = F.filter("turns", lambda t: t["role"] == SPEAKER)
    # The place of the last reply, counted from 1; 0: none.
    last = F.aggregate(
        F.transform("turns", lambda t, i: F.when(t["role"] == SPEAKER, i + 1).otherwise(0)),
        F.lit(0),
        lambda a, b: F.greatest(a, b),
    )
    placed = convs.withColumn("last", last).withColumn("first_reply", F.get(said, F.lit(0)))
    before = F.when(F.col("last") > 0, F.slice("turns", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0))))
    differs = F.get("turns", F.col("last") - 1)["text"] != F.col("first_reply")["text"]
    return placed.select(
        F.col("conv_id").alias("pair_id"),
        F.when(F.col("last") > 0, F.slice("turns", F.lit(1), F.greatest("last", F.lit(0))))
        .otherwise(F.col("turns"))
        .alias("chosen"),
        F.when(F.col("last") == 0, F.col("turns"))
        .when(differs, F.concat(before, F.array("first_reply")))
        .otherwise(before)
        .alias("rejected"),
    )


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _plain(turn["role"]), F.lit("\n"))


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _body(turn: Column) -> Column:
    return F.concat(_plain(turn["text"]), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _loss_spans(turns: Column) -> Column:
    """``start:end`` of each assistant text with its end mark in the rendered turns, joined by commas."""
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(_head(t)) + F.length(_body(t)) + 1).alias("at"),
            F.when(
                t["role"] == SPEAKER,
                F.array_append(
                    acc["spans"],
                    F.concat_ws(
                        ":",
                        (acc["at"] + F.length(_head(t))).cast("string"),
                        (acc["at"] + F.length(_head(t)) + F.length(_body(t))).cast("string"),
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return F.array_join(step["spans"], ",")


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, chosen_loss, rejected, rejected_loss, trainable) of every row.

    ``chosen`` and ``rejected`` of the input are arrays of (role, text).
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select(
        F.col("pair_id").cast("long").alias("pair_id"),
        *(
            F.transform(
                F.coalesce(F.col(side), empty),
                lambda t: F.struct(
                    F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")
                ),
            ).alias(side)
            for side in ("chosen", "rejected")
        ),
    )
    # Beyond the end of the shorter side its turn is null and equals nothing.
    differs = F.zip_with("chosen", "rejected", lambda a, b: ~a.eqNullSafe(b))
    at = F.array_position(differs, True)
    rows = rows.withColumn(
        "n", F.when(at > 0, at - 1).otherwise(F.greatest(F.size("chosen"), F.size("rejected"))).cast("int")
    )

    def after(side: str) -> Column:
        return F.slice(side, F.col("n") + 1, F.size(side))

    shown = rows.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        _render(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        _render(after("chosen")).alias("chosen"),
        _loss_spans(after("chosen")).alias("chosen_loss"),
        _render(after("rejected")).alias("rejected"),
        _loss_spans(after("rejected")).alias("rejected_loss"),
    )
    return shown.withColumn("trainable", (F.col("chosen_loss") != "") & (F.col("rejected_loss") != ""))


#: The same for the stale-reply pairs of ``conversations``, row by row instead of by arrays.
ORACLE_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos
  FROM t
), c AS (
  SELECT conv_id, coalesce(max(pos) FILTER (role = 'assistant'), 0) AS last, count(*) AS n,
         arg_min(text, pos) FILTER (role = 'assistant') AS first_text,
         arg_max(text, pos) FILTER (role = 'assistant') AS last_text
  FROM p GROUP BY conv_id
), s AS (
  SELECT p.conv_id, side, pos, role, CASE WHEN side = 'rejected' AND pos = last THEN first_text ELSE text END AS text
  FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id, (VALUES ('chosen'), ('rejected')) v(side)
  WHERE last = 0 OR pos < last OR pos = last AND (side = 'chosen' OR first_text != last_text)
), e AS (
  SELECT conv_id, pos, bool_and(role = first_role AND text = first_text) AND count(*) = 2 AS same
  FROM (SELECT *, first_value(role) OVER w AS first_role, first_value(text) OVER w AS first_text FROM s
        WINDOW w AS (PARTITION BY conv_id, pos ORDER BY side))
  GROUP BY conv_id, pos
), l AS (
  SELECT conv_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS n_prompt FROM e GROUP BY conv_id
), r AS (
  SELECT s.conv_id, side, pos, role, n_prompt, '<|im_start|>' || replace(role, '<|', '< |') || chr(10) AS head,
         replace(text, '<|', '< |') || '<|im_end|>' AS body
  FROM s JOIN l ON s.conv_id IS NOT DISTINCT FROM l.conv_id
), m AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
              PARTITION BY conv_id, side, pos > n_prompt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM r
), f AS (
  SELECT conv_id, any_value(n_prompt) AS n_prompt,
         string_agg(head || body || chr(10), '' ORDER BY pos) FILTER (side = 'chosen' AND pos <= n_prompt) AS prompt,
         string_agg(head || body || chr(10), '' ORDER BY pos) FILTER (side = 'chosen' AND pos > n_prompt) AS chosen,
         string_agg(head || body || chr(10), '' ORDER BY pos) FILTER (side = 'rejected' AND pos > n_prompt) AS rejected,
         string_agg(CAST(begins + length(head) AS BIGINT) || ':' || CAST(begins + length(head) + length(body) AS BIGINT), ',' ORDER BY pos)
           FILTER (side = 'chosen' AND pos > n_prompt AND role = 'assistant') AS chosen_loss,
         string_agg(CAST(begins + length(head) AS BIGINT) || ':' || CAST(begins + length(head) + length(body) AS BIGINT), ',' ORDER BY pos)
           FILTER (side = 'rejected' AND pos > n_prompt AND role = 'assistant') AS rejected_loss
  FROM m GROUP BY conv_id
)
SELECT conv_id AS pair_id, CAST(n_prompt AS INT) AS n_prompt_turns, coalesce(prompt, '') AS prompt,
       coalesce(chosen, '') AS chosen, coalesce(chosen_loss, '') AS chosen_loss,
       coalesce(rejected, '') AS rejected, coalesce(rejected_loss, '') AS rejected_loss,
       chosen_loss IS NOT NULL AND rejected_loss IS NOT NULL AS trainable
FROM f
"""
