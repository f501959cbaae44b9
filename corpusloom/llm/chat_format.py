"""Chat formatting: conversations to one training text each, with a loss mask, and back again.

Template: <|turn|>ROLE<|text|>TEXT<|done|>, and TEXT<|also|>TEXT where adjacent turns have the same role. In roles and
texts "&", "<" and "[" become "&amp;", "&lt;" and "&#91;", so that no control string ("<|done|>", "</s>", "[INST]" ...)
can stand in a text, and reading back is exact. Only Spark expressions are used.

Cases: null texts and roles are empty ones; turns are ordered by (turn, role, text), null turns first, and repeated rows
stay; rows without a conv_id make one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the template, in the order in which they stand.
TURN, TEXT, ALSO, DONE = "<|turn|>", "<|text|>", "<|also|>", "<|done|>"
LEARNED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&#91;"), F.lit("[")), F.lit("&amp;"), F.lit("&"))


def _split(c: Column, mark: str) -> Column:
    return F.split(c, mark.replace("|", r"\|"), -1)


def format_chats(rows: DataFrame, learned: str = LEARNED) -> DataFrame:
    """rows(conv_id, turn, role, text) -> conv_id, formatted, loss_spans.

    loss_spans: (start, length) in code points of formatted, one for each text of the learned role.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        first = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        last = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        return F.struct(
            F.when(first, F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))).otherwise(ALSO).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(last, DONE).otherwise("").alias("tail"),
            (t["role"] == learned).alias("loss"),
        )

    pieces = turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    start = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"), start["spans"].alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans -> the same with turns (role, text) and the text under the loss mask, as they were before."""
    runs = F.slice(_split(F.col("formatted"), DONE), 1, F.greatest(F.size(_split(F.col("formatted"), DONE)) - 1, F.lit(0)))

    def turns_of(run: Column) -> Column:
        parts = _split(run, TEXT)
        role = unescape(F.replace(parts[0], F.lit(TURN), F.lit("")))
        return F.transform(_split(parts[1], ALSO), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"])))
    return formatted.withColumns({"turns": F.flatten(F.transform(runs, turns_of)), "loss_text": F.array_join(loss, "")})


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    back = read_chats(format_chats(rows.unionByName(probe)))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(role, '<', ''))) + 4 * (length(role) - length(replace(role, '[', ''))) as role_n,
    length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', ''))) + 4 * (length(text) - length(replace(text, '[', ''))) as text_n,
    lag(role) over w is distinct from role as starts
  from t window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(text_n + case when starts then role_n + 24 else 8 end) as bigint) as formatted_chars
from e group by conv_id
"""
