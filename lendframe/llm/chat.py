"""Preference formatting of chosen and rejected conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import pack, unpack

OPEN, CLOSE, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """One row per conversation with ``turns``, an array of (role, text) in turn order.

    Turns of equal number are ordered by role, then text; repeated rows are repeated turns. Null
    role and text become empty, a null turn number comes first, null ids form one conversation.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return conversations.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def shared_turns(a: Column, b: Column) -> Column:
    """Length of the longest common turn prefix."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(n).cast("long")


def _clean(text: Column) -> Column:
    """Text may not open or close a turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _clean(t["role"]), F.lit("\n"), _clean(t["text"]), F.lit(CLOSE + "\n"))


def render(ts: Column) -> Column:
    return F.array_join(F.transform(ts, _turn), "")


def trained_spans(ts: Column) -> Column:
    """(start, length) in characters of what is trained on in ``render(ts)``: text and closing mark of the trained role's turns."""
    lengths = F.transform(ts, lambda t: F.struct(
        F.length(_turn(t)).alias("all"), (F.length(F.lit(OPEN)) + F.length(_clean(t["role"])) + 1).alias("head"),
        (F.length(_clean(t["text"])) + F.length(F.lit(CLOSE))).alias("body"), (t["role"].eqNullSafe(F.lit(TRAINED))).alias("on")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(lengths, start, lambda acc, x: F.struct(
        (acc["at"] + x["all"]).alias("at"),
        F.when(x["on"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["body"].alias("length")))))
        .otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])


def preference_examples(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """Paired completions after a prompt that is rendered once.

    ``chosen`` and ``rejected`` are arrays of (role, text). Their longest common turn prefix is the
    prompt; the rest of each is a completion with its trained spans, all else in it is masked.
    The other columns are kept; ``n_prompt, prompt, chosen, rejected, chosen_spans,
    rejected_spans, usable`` are added or replaced. A null conversation is an empty one. A pair is
    ``usable`` if both completions have a trained span and differ; equal conversations, or one
    that is a prefix of the other, are not. An empty table stays empty.
    """
    made = ("n_prompt", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans", "usable")
    empty = F.array().cast("array<struct<role:string,text:string>>")
    rest = [c for c in pairs.columns if c not in (*made, chosen_col, rejected_col)]
    both = pairs.select(pack(rest).alias("_row"), F.coalesce(F.col(chosen_col), empty).alias("_c"), F.coalesce(F.col(rejected_col), empty).alias("_r"))
    cut = both.withColumn("n_prompt", shared_turns(F.col("_c"), F.col("_r")))
    after = lambda c: F.slice(c, (F.col("n_prompt") + 1).cast("int"), F.greatest(F.size(c), F.lit(1)))
    cut = (cut.withColumn("_prompt", F.slice("_c", F.lit(1), F.col("n_prompt").cast("int")))
           .withColumn("_c", after("_c")).withColumn("_r", after("_r")))
    out = cut.select(*unpack("_row", rest), "n_prompt",
                     render(F.col("_prompt")).alias("prompt"), render(F.col("_c")).alias("chosen"),
                     render(F.col("_r")).alias("rejected"), trained_spans(F.col("_c")).alias("chosen_spans"),
                     trained_spans(F.col("_r")).alias("rejected_spans"))
    return out.withColumn("usable", (F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0) & (F.col("chosen") != F.col("rejected")))


def swapped_reply_pairs(conversations: DataFrame, block: int = 64) -> DataFrame:
    """Preference pairs from conversations alone: chosen is a conversation up to its last reply,
    rejected the same with the last reply of the next conversation in a block of ``block`` ids
    (the last takes the first's). Conversations without a reply, and a block with one
    conversation, give no pair; so do null ids.
    """
    ts = turns(conversations).filter("conv_id IS NOT NULL")
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == TRAINED)), F.lit(True)) + 1
    replied = ts.withColumn("_last", last.cast("int")).filter(F.exists("turns", lambda t: t["role"] == TRAINED)).select(
        "conv_id", F.slice("turns", F.lit(1), F.col("_last")).alias("chosen"), F.element_at("turns", F.col("_last")).alias("reply"))
    w = Window.partitionBy(F.expr(f"conv_id div {block}")).orderBy("conv_id")
    other = F.coalesce(F.lead("reply").over(w), F.first("reply").over(w))
    lone = F.count(F.lit(1)).over(Window.partitionBy(F.expr(f"conv_id div {block}"))) > 1
    paired = replied.withColumn("_other", other).withColumn("_ok", lone).filter("_ok")
    cut = F.slice("chosen", F.lit(1), F.size("chosen") - 1)
    return paired.select("conv_id", "chosen", F.concat(cut, F.array("_other")).alias("rejected"))
