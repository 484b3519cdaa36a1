"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The longest common prefix of turns (same role and text) of the chosen and the rejected
conversation is rendered once, as the prompt; what is left of each is its completion. A
completion's mask lists the spans of characters that count for training: the assistant's
texts with their end marks. All of it is DataFrame expressions; a conversation is the
largest unit that meets in one row.

Turns are ordered by turn, then role and text, so ties and repeated rows have one order. A
null role or text is empty. Pairs that miss one side give no row. Equal conversations have
two empty completions; conversations without a common first turn have an empty prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import table

TURN_END = "<|end|>\n"
#: Conversations among which the query looks for another answer.
BUCKET = 64


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(TURN_END))), "")


def _mask(turns: Column, trained: str) -> Column:
    """Spans ``[begin, end)`` of the trained role's texts with their end marks, as "b-e,b-e"."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(_head(t["role"]))
        end = begin + F.length(t["text"]) + len(TURN_END)
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == trained, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, empty, step)["spans"], ",")


def listed(turns: DataFrame, pair: str, name: str) -> DataFrame:
    """A row per pair with its turns in order."""
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.where(F.col(pair).isNotNull()).groupBy(pair).agg(F.sort_array(F.collect_list(item)).alias("list"))
    return whole.select(pair, F.transform("list", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def format_lists(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", trained: str = "assistant") -> DataFrame:
    """Format rows that hold both conversations as arrays of (role, text); other columns stay, but for those named like a result."""
    a, b = F.col(chosen), F.col(rejected)
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    shared = F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")
    made = {"n_prompt_turns", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask"}
    kept = [c for c in pairs.columns if c not in (chosen, rejected) and c.lower() not in made]
    pairs = pairs.withColumn("n_prompt_turns", shared)
    rest = lambda turns: F.slice(turns, F.col("n_prompt_turns") + 1, F.size(turns))
    return pairs.select(
        *kept,
        "n_prompt_turns",
        _rendered(F.slice(a, F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        _rendered(rest(a)).alias("chosen_completion"),
        _mask(rest(a), trained).alias("chosen_mask"),
        _rendered(rest(b)).alias("rejected_completion"),
        _mask(rest(b), trained).alias("rejected_mask"),
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", trained: str = "assistant") -> DataFrame:
    """Format pairs given as two tables of turns: pair, turn, role, text."""
    return format_lists(listed(chosen, pair, "chosen").join(listed(rejected, pair, "rejected"), pair), trained=trained)


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation that has an answer, against itself with its last answer taken from another one.

    The other is the next with an answer among ids with the same ``id div 64``, after the last the first again; a conversation
    that is alone there meets itself, and both completions are empty. One without any answer has nothing to prefer and gives
    no row. ``PREFERENCE_SQL`` has the same rule.
    """
    convs = listed(table(spark, sf_dir, "conversations"), "conv_id", "chosen")
    answers = F.filter("chosen", lambda t: t["role"] == "assistant")
    convs = convs.withColumn("answers", answers).where(F.size("answers") > 0)
    last = F.size("chosen") - F.array_position(F.reverse(F.transform("chosen", lambda t: t["role"] == "assistant")), True) + 1
    convs = convs.select("conv_id", "chosen", last.cast("int").alias("last"), F.element_at("answers", -1)["text"].alias("answer"))
    near = Window.partitionBy(F.floor(F.col("conv_id") / BUCKET)).orderBy("conv_id")  # BUCKET rows at most
    first = F.first("answer").over(near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pairs = convs.withColumn("other", F.coalesce(F.lead("answer").over(near), first))
    swapped = F.transform("chosen", lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == F.col("last"), F.col("other")).otherwise(t["text"]).alias("text")))
    return format_lists(pairs.select("conv_id", "chosen", swapped.alias("rejected")))


PREFERENCE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS idx
  FROM conversations WHERE conv_id IS NOT NULL
), la AS (
  SELECT conv_id, max(idx) AS li, arg_max(text, idx) AS lt FROM t WHERE role = 'assistant' GROUP BY conv_id
), p AS (
  SELECT conv_id, li, coalesce(lead(lt) OVER (PARTITION BY floor(conv_id / 64) ORDER BY conv_id),
    first_value(lt) OVER (PARTITION BY floor(conv_id / 64) ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS lt FROM la
), r AS (
  SELECT t.conv_id, idx, role, text, CASE WHEN idx = li THEN lt ELSE text END AS other FROM t JOIN p USING (conv_id)
), f AS (
  SELECT conv_id, CAST(coalesce(min(CASE WHEN text <> other THEN idx END), count(*) + 1) - 1 AS INTEGER) AS n FROM r GROUP BY conv_id
), s AS (
  SELECT r.*, f.n, '<|' || role || '|>' || chr(10) AS head,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS x,
         '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) AS y
  FROM r JOIN f USING (conv_id)
), o AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN idx > n THEN length(x) END) OVER w, 0) AS BIGINT) AS bx,
         CAST(coalesce(sum(CASE WHEN idx > n THEN length(y) END) OVER w, 0) AS BIGINT) AS by_
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, any_value(n) AS n_prompt_turns,
  coalesce(string_agg(x, '' ORDER BY idx) FILTER (WHERE idx <= n), '') AS prompt,
  coalesce(string_agg(x, '' ORDER BY idx) FILTER (WHERE idx > n), '') AS chosen_completion,
  coalesce(string_agg((bx + length(head)) || '-' || (bx + length(x)), ',' ORDER BY idx) FILTER (WHERE idx > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(y, '' ORDER BY idx) FILTER (WHERE idx > n), '') AS rejected_completion,
  coalesce(string_agg((by_ + length(head)) || '-' || (by_ + length(y)), ',' ORDER BY idx) FILTER (WHERE idx > n AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY conv_id
"""
