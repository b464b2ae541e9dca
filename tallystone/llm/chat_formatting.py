"""Preference pairs rendered as one prompt and two masked completions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.session import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """Control markers inside a text are broken up, so that no text can end its own turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _plain(t["role"]), F.lit("\n"))


def _body(t: Column) -> Column:
    return F.concat(_plain(t["text"]), F.lit(CLOSE + "\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _spans(turns: Column, trained: str) -> Column:
    """[start, end) of the characters of the completion that carry loss: text and end mark of the
    trained role's turns, never a header or another role's words."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        head, body = F.length(_head(t)), F.length(_body(t))
        span = F.array(F.struct((acc["at"] + head).alias("start"), (acc["at"] + head + body).alias("end")))
        return F.struct((acc["at"] + head + body).alias("at"), F.when(F.coalesce(t["role"] == trained, F.lit(False)), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def format_preferences(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per pair from ``turns`` (pair_id, side 'chosen' or 'rejected', turn, role, text).

    The longest common prefix of whole turns (role and text equal, nulls equal to nulls) is rendered
    once as prompt; the rest of each side is its completion, with the spans that carry loss. Turns
    are ordered by number, then role and text. A pair with one side only has null for the other
    side and an empty common prefix; null texts and roles render as empty; null pair ids form no
    pair; further columns are ignored; an empty table gives an empty result. One shuffle by pair;
    a row holds one conversation per side, as the result must.
    """
    turn = F.struct("turn", "role", "text")
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, turn)))
    paired = turns.filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    common = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    cut = paired.withColumn("n_common", common).select("pair_id", "n_common", F.slice("c", F.lit(1), F.col("n_common")).alias("p"), F.when(F.size("c") > 0, rest(F.col("c"))).alias("c"), F.when(F.size("r") > 0, rest(F.col("r"))).alias("r"))
    return cut.select(
        "pair_id",
        F.col("n_common").alias("prompt_turns"),
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _spans(F.col("c"), trained).alias("chosen_loss"),
        _spans(F.col("r"), trained).alias("rejected_loss"),
    )


def pairs_with_other_answers(conversations: DataFrame) -> DataFrame:
    """Every conversation as chosen, and as rejected with the text of its last assistant turn taken
    from the next conversation (conv_id + 1); the table holds no preferences of its own.

    Of several last turns that with the greatest text is taken, and its repeats change with it. Without
    such a turn in the next conversation the rejected answer is empty; without one of its own, both
    sides are equal. Null ids are left out. The joined side has a row per conversation.
    """
    answers = conversations.filter(F.col("role") == "assistant").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("own"))
    following = answers.select((F.col("conv_id") - 1).alias("conv_id"), F.col("own.text").alias("other"))
    ends = answers.join(following, "conv_id", "left").select("conv_id", "own", F.coalesce("other", F.lit("")).alias("other"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).join(ends, "conv_id", "left")
    last = (F.col("role") == "assistant") & F.col("own").eqNullSafe(F.struct("turn", "text"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), "text"), F.struct(F.lit("rejected").alias("side"), F.when(last, F.col("other")).otherwise(F.col("text")).alias("text")))
    return turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_preferences(pairs_with_other_answers(table(spark, sf_dir, "conversations")))
    marks = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.withColumns({"chosen_loss": marks(F.col("chosen_loss")), "rejected_loss": marks(F.col("rejected_loss"))})


ORACLE_SQL = r"""
WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) = 1),
b AS (SELECT c.conv_id AS pair_id, c.turn, c.role, c.text,
        CASE WHEN c.role = 'assistant' AND a.conv_id IS NOT NULL AND c.turn IS NOT DISTINCT FROM a.turn AND c.text IS NOT DISTINCT FROM a.text THEN coalesce(o.text, '') ELSE c.text END AS other
      FROM conversations c LEFT JOIN a ON a.conv_id = c.conv_id LEFT JOIN a o ON o.conv_id = c.conv_id + 1 WHERE c.conv_id IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS n
      FROM (SELECT pair_id, 0 AS side, turn, role, text FROM b UNION ALL SELECT pair_id, 1, turn, role, other FROM b)),
m AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.n, r.n) AS n,
        coalesce(c.n = r.n AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text, false) AS same
      FROM (SELECT * FROM s WHERE side = 0) c FULL JOIN (SELECT * FROM s WHERE side = 1) r ON c.pair_id = r.pair_id AND c.n = r.n),
p AS (SELECT pair_id, coalesce(min(n) FILTER (WHERE NOT same) - 1, max(n)) AS k, count(*) FILTER (WHERE same) AS ignore_me FROM m GROUP BY pair_id),
h AS (SELECT s.*, p.k, '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<| im_') || chr(10) AS head,
        replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS body FROM s JOIN p USING (pair_id)),
o AS (SELECT *, CAST(coalesce(sum(CASE WHEN n > k THEN length(head) + length(body) END) OVER (PARTITION BY pair_id, side ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM h)
SELECT pair_id, CAST(any_value(k) AS INTEGER) AS prompt_turns,
  coalesce(string_agg(head || body, '' ORDER BY n) FILTER (WHERE side = 0 AND n <= k), '') AS prompt,
  CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg(head || body, '' ORDER BY n) FILTER (WHERE side = 0 AND n > k), '') END AS chosen,
  CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg(head || body, '' ORDER BY n) FILTER (WHERE side = 1 AND n > k), '') END AS rejected,
  CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body)), ',' ORDER BY n) FILTER (WHERE side = 0 AND n > k AND role = 'assistant'), '') END AS chosen_loss,
  CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body)), ',' ORDER BY n) FILTER (WHERE side = 1 AND n > k AND role = 'assistant'), '') END AS rejected_loss
FROM o GROUP BY pair_id
"""
