"""Preference formatting with DataFrame functions only.

Each pair has a chosen and a rejected conversation. Their longest common prefix of turns (same role, same text) is rendered
once as the prompt; what follows on either side is rendered as its completion, with a mask of the code points that a model
should learn: the texts and end marks of assistant turns. One shuffle, by pair; a pair's turns are together only in the row
that holds their rendered text anyway.

Defined results
---------------
* turns are ordered by ``turn``, then role, then text, nulls first; repeated turns are turns of their own;
* null role: rendered as ``unknown``; null text: as the empty text; both equal only another null;
* equal conversations: the whole is prompt, both completions are empty; nothing in common: the prompt is empty;
* a side without turns: its completion and mask are null, the prompt is empty;
* turns without a conversation id are dropped; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm import common

LEARNED_ROLE = "assistant"
END = "<|end|>\n"


def _head(x: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(x: Column) -> Column:
    return F.concat(F.coalesce(x["text"], F.lit("")), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x), _body(x))), "")


def _mask(turns: Column) -> Column:
    """``start:end`` of the learned spans, end exclusive, comma-joined."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(_head(x))
        end = begin + F.char_length(_body(x))
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        learned = F.coalesce(x["role"] == LEARNED_ROLE, F.lit(False))
        spans = F.when(~learned, acc["spans"]).when(acc["spans"] == "", span).otherwise(F.concat(acc["spans"], F.lit(","), span))
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def format_preferences(turns: DataFrame) -> DataFrame:
    """``pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask`` from rows ``pair_id, side, turn, role, text``.

    ``side`` is ``chosen`` or ``rejected``.
    """
    one = F.struct("turn", "role", "text")
    pairs = turns.filter("pair_id is not null").groupBy("pair_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("side") == side, one))).alias(f"_{side}") for side in ("chosen", "rejected")]
    )
    same = F.zip_with("_chosen", "_rejected", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    shorter = F.least(F.size("_chosen"), F.size("_rejected"))
    differ = F.array_position(same, False)
    n = F.when(differ > 0, F.least(differ - 1, shorter)).otherwise(shorter).cast("int")
    pairs = pairs.withColumn("n_prompt_turns", n)
    columns = [F.col("pair_id"), F.col("n_prompt_turns"), _render(F.slice("_chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt")]
    for side in ("chosen", "rejected"):
        rest = F.slice(f"_{side}", F.col("n_prompt_turns") + 1, F.greatest(F.size(f"_{side}"), F.lit(1)))
        there = F.size(f"_{side}") > 0
        columns += [F.when(there, _render(rest)).alias(side), F.when(there, _mask(rest)).alias(f"{side}_mask")]
    return pairs.select(*columns)


def with_cut_answers(turns: DataFrame) -> DataFrame:
    """Rows ``pair_id, side, turn, role, text`` that prefer each conversation over itself with its last answer cut in half."""
    last = F.max(F.when(F.col("role") == LEARNED_ROLE, F.col("turn"))).over(Window.partitionBy("conv_id"))
    cut = F.when((F.col("role") == LEARNED_ROLE) & (F.col("turn") == F.col("last")), F.substring("text", F.lit(1), F.floor(F.char_length("text") / 2).cast("int")))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), F.coalesce(cut, F.col("text")).alias("text")))
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", "role", "text", last.alias("last"))
    return rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")


def op4_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names no preferences: whole answers are preferred over cut ones."""
    common.prepare(spark)
    return format_preferences(with_cut_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = """
with l as (select conv_id as pair_id, turn, role, text, max(case when role = 'assistant' then turn end) over (partition by conv_id) as last from conversations where conv_id is not null),
s as (
  select pair_id, 0 as side, turn, role, text from l
  union all select pair_id, 1, turn, role, case when role = 'assistant' and turn = last then substr(text, 1, length(text) // 2) else text end from l),
t as (
  select pair_id, side, role, text,
    row_number() over (partition by pair_id, side order by turn nulls first, role nulls first, text nulls first) as rn,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) as head, coalesce(text, '') || '<|end|>' || chr(10) as body
  from s),
c as (select * from t where side = 0), r as (select * from t where side = 1),
cut as (
  select pair_id, coalesce(min(case when c.rn is null or r.rn is null or c.role is distinct from r.role or c.text is distinct from r.text then coalesce(c.rn, r.rn) end) - 1, max(c.rn))::int as n
  from c full join r using (pair_id, rn) group by pair_id),
placed as (
  select t.*, n, sum(length(head) + length(body)) over (partition by pair_id, side, rn <= n order by rn rows between unbounded preceding and current row) as stop
  from t join cut using (pair_id)),
sides as (
  select pair_id, side, coalesce(string_agg(head || body, '' order by rn) filter (rn > n), '') as completion,
    coalesce(string_agg((stop - length(body))::bigint::varchar || ':' || stop::bigint::varchar, ',' order by rn) filter (rn > n and role = 'assistant'), '') as mask,
    coalesce(string_agg(head || body, '' order by rn) filter (rn <= n), '') as prompt
  from placed group by pair_id, side)
select cut.pair_id, n as n_prompt_turns, coalesce(a.prompt, '') as prompt, a.completion as chosen, a.mask as chosen_mask, b.completion as rejected, b.mask as rejected_mask
from cut left join sides a on a.pair_id = cut.pair_id and a.side = 0 left join sides b on b.pair_id = cut.pair_id and b.side = 1"""
