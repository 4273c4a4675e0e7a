"""Chat formatting by prefix-target expansion (native: DataFrame and SQL functions only).

Every assistant turn becomes one example: the formatted text of all turns up to it, of which only that reply is
trainable. A conversation whose last turn is not an assistant's (or that has none) also gets one context-only row
without a trainable span, so that no turn is lost.

Template: each turn is ``<s>`` + role + newline + text + ``</s>``. Control strings inside roles and texts are escaped
reversibly: a backslash is doubled and the first character of a control string becomes ``\\l`` (for ``<``) or ``\\b``
(for ``[``). Newlines inside a role become ``\\n``. Hence an unescaped control string is always a turn mark.

Defined results: null role or text counts as empty; rows of one conversation are ordered by (turn, role, text) with
nulls first, so repeated and tied rows keep their place whatever the partitioning; a null conv_id is a conversation
of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<s>", "</s>"
CONTROL = r"<(?=/?s>|</?SYS>>|/?SYS>>|\|im_(?:start|end)\|>)"
CONTROL_SQUARE = r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(doubled, CONTROL, r"\\l"), CONTROL_SQUARE, r"\\b")


def unescape(text: Column) -> Column:
    # each escape starts with a backslash and has two characters, so the leftmost pair of backslashes is a doubled one
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end, n_turns): loss offsets are code points, end exclusive.

    One shuffle by conv_id brings a conversation's turns together; the expansion is a Generate above it.
    """
    blank = F.lit("")
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), F.coalesce(F.col("role"), blank).alias("role"), F.coalesce(F.col("text"), blank).alias("text")
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rendered = grouped.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == "assistant").alias("target"), _head(t["role"]).alias("head"), escape(t["text"]).alias("body")
            ),
        ).alias("r"),
    )
    n = F.size("r")
    last_open = ~F.coalesce(F.element_at("r", -1)["target"], F.lit(False))
    ends = F.filter(
        F.transform("r", lambda t, i: F.when(t["target"] | ((i == n - 1) & last_open), i + 1)), lambda i: i.isNotNull()
    )
    picked = rendered.select("conv_id", "r", F.posexplode(ends).alias("example", "n_turns"))
    text = F.array_join(F.transform(F.slice("r", F.lit(1), F.col("n_turns")), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    own = F.element_at("r", F.col("n_turns"))
    made = picked.select("conv_id", "example", "n_turns", text.alias("formatted"), own["target"].alias("target"), F.length(own["body"]).alias("body_len"))
    end = F.length("formatted") - len(CLOSE)
    return made.select(
        "conv_id",
        "example",
        "formatted",
        F.when(F.col("target"), end - F.col("body_len")).alias("loss_start"),
        F.when(F.col("target"), end).alias("loss_end"),
        "n_turns",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted texts and masks alone: turns, trained text and their digests."""
    loss = F.when(
        F.col("loss_start").isNotNull(), unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    )
    one = examples.select("conv_id", "example", F.length("formatted").alias("chars"), loss.alias("loss"), "formatted")
    per = one.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.max_by("formatted", "chars").alias("longest"),
    )
    marks = F.filter(F.split("longest", CLOSE, -1), lambda x: x != "")
    turns = F.transform(marks, lambda x: F.substring(x, len(OPEN) + 1, F.length(x)))
    cut = lambda x: F.instr(x, "\n")
    plain = F.transform(turns, lambda x: F.concat(unescape(F.substring(x, F.lit(1), cut(x) - 1)), F.lit("\n"), unescape(F.substring(x, cut(x) + 1, F.length(x))), F.lit("\n")))
    return per.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(plain, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


PROBE_ID = -7
PROBE_TEXT = "</s>[INST] ok [/INST]"


def op9_chat_prefix_target(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return read_back(format_examples(conversations.unionByName(probe)))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length(text) + length(role) + 8
        + length(text) - length(replace(text, '\', '')) + length(role) - length(replace(role, '\', ''))
        + length(role) - length(replace(role, chr(10), ''))
        + len(regexp_extract_all(text, '</?s>|<</?SYS>>|<\|im_(?:start|end)\|>|\[/?INST\]'))
        + len(regexp_extract_all(role, '</?s>|<</?SYS>>|<\|im_(?:start|end)\|>|\[/?INST\]'))) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN upto END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
