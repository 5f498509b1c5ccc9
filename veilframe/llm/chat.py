"""Chat formatting of reply trees, with DataFrame operations only.

Messages point to the message they answer. Pointer doubling, a self-join in
each round, gives every message its ancestor 1, 2, 4, ... steps up and the score
of its way from the root. The leaves of a conversation are its branches; they
are ranked by mean score, and the chosen ones are walked back to the root by the
same pointers. Each path is formatted as one conversation with a loss mask.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, written

START, BETWEEN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What a text may not hold as it is: this template's marks and those of other common ones.
_CONTROL = r"(<|\[)(\|im_(?:start|sep|end)\|>|/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    """Double each backslash and put one after the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """The best paths of each conversation: conv, path (its leaf), rank, node, step (0 at the leaf).

    messages: conv long, node long (unique within conv), parent long, score
    double. A message whose parent is null or missing is a root. Messages in a
    cycle hang on no root and are left out. A branch's score is the mean over its
    messages, null as 0; ties go to the smaller leaf. Runs one self-join for each
    doubling of the depth.
    """
    nodes = messages.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("known"))
    nodes = nodes.join(known, ["conv", "parent"], "left").withColumn("parent", F.when(F.col("known"), F.col("parent")))
    up = written(nodes.select("conv", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "up")
    levels, number, done = [], up.count(), [up.where(F.col("up").isNull())]
    while up.where(F.col("up").isNotNull()).limit(1).count() and 2 ** len(levels) <= number:
        levels.append(up)
        above = up.select("conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        # only pointers that have not reached a root go on; each one's target is in the table
        joined = up.where(F.col("up").isNotNull()).join(above, ["conv", "up"])
        moved = written(joined.select("conv", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth")), "up")
        done.append(moved.where(F.col("up").isNull()))
        ended = up.where(F.col("up").isNull()).unionByName(moved.where(F.col("up").isNull()))
        going = moved.where(F.col("up").isNotNull())
        up = written(going.unionByName(ended.join(going.select("conv").distinct(), "conv", "left_semi")), "up")
    answered = nodes.where(F.col("parent").isNotNull()).select("conv", F.col("parent").alias("node")).distinct()
    leaves = reduce(DataFrame.unionByName, done).join(answered, ["conv", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("depth")), "node"))
    path = leaves.withColumn("rank", rank).where(F.col("rank") <= top).select("conv", F.col("node").alias("path"), "rank", "node", F.lit(0).cast("long").alias("step"))
    for k in reversed(range(len(levels))):
        above = levels[k].where(F.col("up").isNotNull()).select("conv", "node", "up")
        both = F.array(F.struct("node", "step"), F.struct(F.col("up").alias("node"), (F.col("step") + 2**k).alias("step")))
        one = F.array(F.struct("node", "step"))
        path = path.join(above, ["conv", "node"], "left").select("conv", "path", "rank", F.inline(F.when(F.col("up").isNull(), one).otherwise(both)))
    return path


def formatted(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """conv, path, rank, formatted, loss: one row for each path.

    texts: conv, node, role, text; null counts as empty. loss lists start (from
    1) and length, in characters of formatted, of the assistant's texts.
    """
    turn = F.concat(F.lit(START), escape(F.coalesce("role", F.lit(""))), F.lit(BETWEEN))
    rows = paths.join(texts, ["conv", "node"]).withColumns({"head": turn, "body": escape(F.coalesce("text", F.lit("")))})
    rows = rows.withColumn("turn", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv", "path", "rank").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.char_length("turn")).over(order) - F.char_length("turn") + F.char_length("head") + 1
    span = F.when((F.col("role") == "assistant") & (F.char_length("body") > 0), F.struct(start.cast("long").alias("start"), F.char_length("body").cast("long").alias("length")))
    rows = rows.withColumn("span", span)
    one = F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("at"), "turn", "span")))
    rows = rows.groupBy("conv", "path", "rank").agg(one.alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return rows.select("conv", "path", "rank", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss"))


def read_back(out: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, both from formatted alone."""
    parts = F.slice(F.split("formatted", r"<\|im_end\|>", -1), 1, F.size(F.split("formatted", r"<\|im_end\|>", -1)) - 1)
    role = lambda t: unescape(F.substring_index(F.substring(t, len(START) + 1, 2**30), BETWEEN, 1))
    text = lambda t: unescape(F.substring_index(t, BETWEEN, -1))
    turns = F.transform(parts, lambda t: F.struct(role(t).alias("role"), text(t).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int"), s["length"].cast("int"))))
    return out.withColumns({"turns": turns, "loss_text": F.array_join(loss, "")})


def chains(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose rows answer each other in order of turn, as messages and texts.

    rows: conv_id, turn, role, text. Rows of one turn follow by role, then text;
    repeated rows are turns of their own. A null conv_id is one conversation.
    """
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_last("turn"), "role", "text")
    keyed = rows.select(F.coalesce("conv_id", F.lit(NULL_ID)).alias("conv"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    keyed = written(keyed.select("conv", "node", "role", "text"), "turns")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return keyed.select("conv", "node", parent.alias("parent"), F.char_length(F.coalesce("text", F.lit(""))).cast("double").alias("score")), keyed


def op2_chat_format(spark, sf_dir):
    """All conversations and one of control strings, formatted and read back; nulls and repeats as in chains()."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages, texts = chains(rows)
    out = read_back(formatted(branches(messages), texts))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        F.when(F.col("conv") != NULL_ID, F.col("conv")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
plain AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM rows),
escaped AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '(<|\[)(\|im_(?:start|sep|end)\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g') AS e_role,
         regexp_replace(replace(text, '\', '\\'), '(<|\[)(\|im_(?:start|sep|end)\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g') AS e_text
  FROM plain)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, r, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(e_role) + length(e_text) + 32)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
