"""Operator 9: chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example: all turns before it are its context, its own reply the only trainable text. What follows the last reply (or all turns,
where none is an assistant's) is a last example with an empty target, so that the output holds every turn.

Template: a turn is `<s>[role]text</s>`. Inside role and text `\\`, `<`, `[` and `]` are written `\\0`, `\\1`, `\\2`, `\\3`, so no control string
can occur in them, and the escape is undone exactly.

examples() keeps an example as what it adds to the one before: `lead` (turns since the last reply, and the opening of its own) and `target`. Its context
is all that earlier examples of the conversation hold, then its lead, `context_chars` long; `expand()` writes contexts out. So turns are shuffled once, and the contexts, which for n turns
add up to n * n / 2, are made after that. examples() sorts and numbers a long conversation by spilling window functions; a row of expand() holds one conversation.

Nulls: a null text or role is empty; null turns come first; rows with a null conversation are one conversation. Ties of turn go by role, then text. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3")]  # the backslash first; undone in reverse
END = "</s>"
TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def examples(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each example: conv_id, example (from 0), lead, target (empty in a last one without a reply), context_chars."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    trained = F.col("role") == TRAINABLE
    rows = rows.select(
        "conv_id", trained.alias("trained"), F.row_number().over(order).alias("pos"),
        F.coalesce(F.sum(trained.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("example"),
        F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]")).alias("opening"), F.concat(escape(F.col("text")), F.lit(END)).alias("body"),
    )
    lead = F.when(F.col("trained"), F.col("opening")).otherwise(F.concat("opening", "body"))
    made = rows.groupBy("conv_id", "example").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", lead.alias("lead")))), lambda x: x["lead"]), "").alias("lead"),
        F.coalesce(F.max(F.when(F.col("trained"), F.col("body"))), F.lit("")).alias("target"),
    )
    before = F.sum(F.char_length("lead") + F.char_length("target")).over(W.partitionBy("conv_id").orderBy("example").rowsBetween(W.unboundedPreceding, -1))
    return made.withColumn("context_chars", F.coalesce(before, F.lit(0)) + F.char_length("lead"))


def expand(rows: DataFrame) -> DataFrame:
    """The training examples as texts: conv_id, example, context (not trainable), target (trainable)."""
    before = F.collect_list(F.concat("lead", "target")).over(W.partitionBy("conv_id").orderBy("example").rowsBetween(W.unboundedPreceding, -1))
    return rows.select("conv_id", "example", F.concat(F.array_join(before, ""), "lead").alias("context"), "target")


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(unescape(F.substring_index(F.substring(x, 5, 2**31 - 1), "]", 1)).alias("role"), unescape(F.substring(x, F.instr(x, F.lit("]")) + 1, F.lit(2**31 - 1))).alias("text")))


def with_contract_case(turns: DataFrame) -> DataFrame:
    """The table and conversation -7, which says what the template itself uses."""
    said = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.sql(f"select -7L conv_id, t turn, r role, '{said}' text from values (0L, 'user'), (1L, 'assistant') as x(t, r)")
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


def op9(spark, turns: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its expanded examples: the turns from the last one, which holds them all, the loss from all targets, the size from all texts as they are."""
    rows = expand(examples(with_contract_case(turns)))
    per = rows.groupBy("conv_id").agg(
        F.max_by(F.concat("context", "target"), "example").alias("whole"), F.array_sort(F.collect_list(F.struct("example", "target"))).alias("e"),
        F.sum(F.char_length("context") + F.char_length("target")).alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("e", lambda x: unescape(F.regexp_replace(x["target"], END + "$", ""))), "")
    out = per.select("conv_id", "formatted_chars", parse(F.col("whole")).alias("t"), loss.alias("loss"))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
