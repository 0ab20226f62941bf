"""Chat formatting by prefix-target expansion: each assistant turn is an example of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pick

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def expand(turns: DataFrame, target_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn of target_role: conv_id, turn, n_context, prompt, target, text, train_start, train_end.

    The prompt holds all preceding turns of the conversation in order of (turn, role,
    text), each as <|role|>, newline, text, <|end|>, newline, and the opening of the
    target's own turn. text = prompt + target; only its characters [train_start,
    train_end) are trainable: the reply and its <|end|> mark.

    A NULL text reads as empty and a NULL role as `unknown`. Turns with a NULL number come
    first; turns that share a number keep the order above; exact repeats both count. Rows
    with NULL conv_id are one conversation. An empty table gives an empty result.
    """
    base = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = base.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("o"), "role", "text", "turn"))).alias("ts"))
    talks = talks.select("conv_id", "ts", F.transform("ts", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(CLOSE))).alias("shown"))
    wanted = talks.select("conv_id", "shown", F.posexplode("ts").alias("at", "t")).where(F.col("t.role") == target_role)
    prompt = F.concat(F.array_join(F.slice("shown", F.lit(1), F.col("at")), ""), F.lit(OPEN.format(target_role)))
    rows = wanted.select("conv_id", F.col("t.turn").alias("turn"), F.col("at").cast("long").alias("n_context"), prompt.alias("prompt"), F.concat("t.text", F.lit(CLOSE)).alias("target"))
    return rows.select("*", F.concat("prompt", "target").alias("text"), F.length("prompt").cast("long").alias("train_start"), (F.length("prompt") + F.length("target")).cast("long").alias("train_end"))


def expand_sql(target_role: str = "assistant") -> str:
    return f"""
with base as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
shown as (select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as s from base),
ordered as (select *, row_number() over w - 1 as n_context, coalesce(string_agg(s, '') over (w rows between unbounded preceding and 1 preceding), '') as before_t
  from shown window w as (partition by conv_id order by coalesce(turn, -4611686018427387904), role, text)),
built as (select conv_id, turn, cast(n_context as bigint) as n_context, before_t || '<|{target_role}|>' || chr(10) as prompt, text || '<|end|>' || chr(10) as target from ordered where role = '{target_role}')
select *, prompt || target as text, cast(length(prompt) as bigint) as train_start, cast(length(prompt) + length(target) as bigint) as train_end from built"""
