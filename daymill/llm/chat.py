"""Prefix-target expansion of conversations: one training example per assistant turn.

An example is a turn with all turns before it as context; only that turn's reply is trainable.
Each turn is written as ``<s>[INST] role [/INST]text</s>``.  Marks inside a role or text get a
backslash after their first character, and marks that have backslashes there one more, so texts
never form a mark and :func:`unescape` gives them back exactly.

A conversation whose last turn has no reply to train on gets one more row without a target, so
no turn is lost.  Rows: turns go by ``turn``, then role and text (nulls first), so ties and
repeated rows have one order; a null role or text counts as empty; a null conversation id is one
conversation; an empty table gives no examples.  Extra columns are left out.

A conversation is one row of turns: the output holds each prefix, so a conversation must fit in
memory anyhow.  One shuffle by conversation; the examples stay where their conversation is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymill.llm.base import query, table

OPEN, TEXT, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
_MARK = r"(/?(?:s>|INST\]))"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _MARK, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _MARK, r"$1$2$3")


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           trainable: str = "assistant") -> DataFrame:
    """One row per example.

    ``example`` numbers a conversation's examples from 0; ``formatted`` is context and target;
    ``loss_start`` and ``loss_length`` mark the reply in ``formatted`` in code points (length null
    where there is no target); ``last`` marks the row that holds the whole conversation.
    """
    rows = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                    F.coalesce(text, F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(rows)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(TEXT))
    written = grouped.select(
        "conv_id", F.size("turns").alias("n"), F.transform("turns", lambda t: t["role"] == trainable).alias("is_target"),
        F.transform("turns", lambda t: F.length(head(t))).alias("heads"),
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(CLOSE))).alias("pieces"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.get("is_target", i - 1) | (i == F.col("n")))
    examples = written.select("*", F.posexplode(ends).alias("example", "upto"))
    formatted = F.array_join(F.slice("pieces", F.lit(1), F.col("upto")), "")
    own, head_chars = F.length(F.get("pieces", F.col("upto") - 1)), F.get("heads", F.col("upto") - 1)
    return examples.select(
        "conv_id", F.col("example").cast("long").alias("example"), F.col("upto").cast("long").alias("n_turns"),
        formatted.alias("formatted"), (F.length(formatted) - own + head_chars).cast("long").alias("loss_start"),
        F.when(F.get("is_target", F.col("upto") - 1), own - head_chars - len(CLOSE)).cast("long").alias("loss_length"),
        (F.col("upto") == F.col("n")).alias("last"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def one(p: Column) -> Column:
        body = F.substr(p, F.lit(len(OPEN) + 1))
        at = F.locate(TEXT.strip(), body)
        return F.struct(unescape(F.substr(body, F.lit(1), at - 2)).alias("role"),
                        unescape(F.substr(body, at + len(TEXT) - 1)).alias("text"))

    return F.transform(pieces, one)


def digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from ``formatted`` and the loss span."""
    back = read_turns(F.col("formatted"))
    whole = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescape(F.substr("formatted", (F.col("loss_start") + 1).cast("int"), F.coalesce(F.col("loss_length"), F.lit(0)).cast("int")))
    read = examples.select(
        "conv_id", F.length("formatted").cast("long").alias("chars"), F.struct("example", loss.alias("text")).alias("loss"),
        F.when(F.col("last"), F.size(back)).cast("long").alias("n"), F.when(F.col("last"), F.sha2(whole, 256)).alias("sha"))
    done = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"))
    return done.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_ADDED = "</s>[INST] ok [/INST]"


@query("op1_prefix_targets", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
l AS (
  SELECT *, 22 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
      + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS chars FROM c),
s AS (
  SELECT *, sum(chars) OVER w AS upto, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last FROM l
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(length(string_agg(text, '') FILTER (role = 'assistant')), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id""")
def op1_prefix_targets(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", _ADDED), (-7, 1, "assistant", _ADDED)], turns.schema)
    return digests(expand(turns.unionByName(added)))
