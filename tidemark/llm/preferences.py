"""Preference formatting: paired conversations become one prompt and two masked completions.

The longest common prefix of turns (equal role and text, in turn order) of the chosen and the rejected conversation is
rendered once, as the prompt; what follows in each is its completion, with the character spans a loss counts over.
Written in DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BETWEEN, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(df: DataFrame, pair: str, turn: str, role: str, text: str, name: str) -> DataFrame:
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return df.select(F.col(pair).alias("pair"), one.alias("one"), F.lit(name).alias("side"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(BETWEEN), t["text"], F.lit(END))), "")


def _spans(turns: Column, learn: str) -> Column:
    """[start, end) in characters, within the rendered turns, of the text and end mark of each turn with role `learn`."""
    head = len(START) + len(BETWEEN)
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + head + len(END)

    def step(acc, t):
        start = acc["at"] + F.length(t["role"]) + head
        span = F.struct(start.alias("start"), (start + F.length(t["text"]) + len(END)).alias("end"))
        return F.struct((acc["at"] + size(t)).alias("at"), F.when(t["role"] == learn, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(turns, zero, step, lambda acc: acc["out"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row for each pair id of either side: pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    Turns go by `turn`, ties by role, then text; repeated turns stay. A null role or text is empty; rows with a null
    pair id or turn are no turns. A pair that has one side only has an empty prompt and an empty other completion; of
    equal conversations all is prompt. The sides meet in one aggregation, whose groups are the pairs, that is, the
    output rows; no join, so no key but a conversation itself can be large.
    """
    both = _turns(chosen, pair, turn, role, text, "c").union(_turns(rejected, pair, turn, role, text, "r")).where(F.col("pair").isNotNull() & F.col("one.turn").isNotNull())
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("one"))))
    g = both.groupBy("pair").agg(side("c").alias("c"), side("r").alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"])
    # one pass: the prefix goes on while turns are equal
    length = F.aggregate(
        F.slice(F.arrays_zip("c", "r"), 1, shorter),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, z: F.struct((a["n"] + F.when(a["on"] & same(z["c"], z["r"]), 1).otherwise(0)).alias("n"), (a["on"] & same(z["c"], z["r"])).alias("on")),
        lambda a: a["n"],
    )
    g = g.withColumn("n", length)
    rest = lambda s: F.slice(F.col(s), F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0)))
    g = g.select("pair", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return g.select(F.col("pair").alias("pair_id"), F.col("n").cast("long").alias("n_prompt_turns"), _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _spans(F.col("c"), learn).alias("chosen_spans"), _spans(F.col("r"), learn).alias("rejected_spans"))


def swapped_answers(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) pairs from plain conversations: rejected is the conversation with its last answer replaced by
    that of its neighbour (2k and 2k + 1), and cut off there; without an answer in the neighbour it ends before.

    pair_id is the conversation's id. Of several last answers the greatest text counts.
    """
    c = conversations.select(F.col(conv).alias("pair_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).where("pair_id is not null and turn is not null")
    last = c.where(F.col("role") == learn).groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("x")).select("pair_id", F.col("x.turn").alias("last"), F.col("x.text").alias("answer"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("answer").alias("other"))
    plan = last.select("pair_id", "last").join(other, "pair_id", "left")
    before = c.join(plan.select("pair_id", "last"), "pair_id", "left").where("last is null or turn < last").select("pair_id", "turn", "role", "text")
    swapped = plan.where("other is not null").select("pair_id", F.col("last").alias("turn"), F.lit(learn).alias("role"), F.col("other").alias("text"))
    return c, before.union(swapped)


def spans_text(spans: Column) -> Column:
    """start-end;start-end as a string."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ";")
