"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted by turn, and runs of one role
are merged under one header by array aggregation:

    <|im_start|>role\\ntext<|im_more|>text<|im_end|>\\n

Inside texts and roles ``~`` becomes ``~0``, and a ``<`` or ``[`` that begins a control
string becomes ``~1`` or ``~2``, so that no control string of a text survives and reading
back is exact.  ``segments`` is the loss mask: its pieces joined are ``formatted``, and those
with ``loss`` are the assistant texts, without headers, separators and ends.

Defined cases: null text or role is empty; equal turn numbers are ordered by role, then
text; repeated rows are turns of their own; null turns come first; rows with a null conv_id
are one conversation; extra columns are ignored.  A formatted conversation is one value and
so under 2 GB; collecting starts before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

START, MORE, END = "<|im_start|>", "<|im_more|>", "<|im_end|>"
ANGLE = r"<(?=\|im_start\|>|\|im_more\|>|\|im_end\|>|/?s>|</?SYS>>|\|endoftext\|>|/?SYS>>)"
SQUARE = r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    out = F.regexp_replace(text, "~", "~0")
    return F.regexp_replace(F.regexp_replace(out, ANGLE, "~1"), SQUARE, "~2")


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("~3"), F.lit("\n")), F.lit("~2"), F.lit("["))
    return F.replace(F.replace(out, F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, segments (array of text and loss) of ``turns`` (conv_id, turn, role, text)."""
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # in the order of the texts as they are: escapes sort otherwise
    chats = chats.withColumn("turns", F.transform("turns", lambda t: F.struct(
        F.replace(escape(t["role"]), F.lit("\n"), F.lit("~3")).alias("role"), escape(t["text"]).alias("text"))))
    role = lambda k: F.try_element_at("turns", k)["role"]

    def pieces(turn: Column, k: Column) -> Column:
        here = turn["role"]
        first = (k == 0) | (role(F.greatest(k, F.lit(1))) != here)
        last = (k + 1 == F.size("turns")) | ~role(k + 2).eqNullSafe(here)
        plain = F.lit(False).alias("loss")
        head = F.when(first, F.concat(F.lit(START), here, F.lit("\n"))).otherwise(F.lit(MORE))
        tail = F.when(last, F.lit(END + "\n")).otherwise(F.lit(""))
        return F.array(
            F.struct(head.alias("text"), plain),
            F.struct(turn["text"].alias("text"), (here == "assistant").alias("loss")),
            F.struct(tail.alias("text"), plain),
        )

    chats = chats.withColumn("segments", F.flatten(F.transform("turns", pieces)))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, k: k > 0)

    def turns(block: Column) -> Column:
        cut = F.instr(block, "\n")
        role = F.substring(block, F.lit(1), cut - 1)
        body = F.substring(block, cut + 1, F.length(block) - cut - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_more\|>", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', :t), (-1L, 1L, 'assistant', :t) AS v(conv_id, turn, role, text)", args={"t": probe}))
    chats = format_chats(turns).withColumn("read", read_turns(F.col("formatted")))
    flat = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return chats.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS before,
    length(text) + length(regexp_extract_all(text, '~'))
      + length(regexp_extract_all(text, '<\|im_start\|>|<\|im_more\|>|<\|im_end\|>|</?s>|<</?SYS>>|<\|endoftext\|>|</?SYS>>|\[/?INST\]')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rn), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN before = role THEN 11 ELSE 12 + length(role) + 1 + 11 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
