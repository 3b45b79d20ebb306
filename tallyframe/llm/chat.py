"""Operator 10: chat formatting by reply trees, with DataFrame functions only.

Messages form trees by their parent. Iterative self-joins, each doubling the distance that a message knows its
ancestor at, enumerate the path from every chosen leaf to its root in as many joins as the depth has binary digits.

Template, with a begin mark and an end mark for each turn:
    <s>[INST:role] text [/INST]</s>
The marks are told from the same strings inside roles and texts by a backslash: inside, a backslash is doubled and one
is put behind the first character of each control string. Taking away the backslash before any character undoes it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Strings that mark turns, here or in common chat templates; inside a text they are escaped.
CONTROL = ("<s>", "</s>", "[INST", "[/INST]", "<|", "<<SYS>>", "<</SYS>>")
#: Rows of trees that are broadcast.
MOST_BROADCAST = 2_000_000
BEGIN, ROLE_END, END = "<s>[INST:", "] ", " [/INST]</s>"


def escape(text: Column) -> Column:
    """A text in which no control string is left; unescape() gives the text back."""
    text = F.regexp_replace(text, r"\\", r"\\\\")
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(text, f"({heads})", r"$1\\")


def escape_role(role: Column) -> Column:
    """A role, in which nothing may look like its end either."""
    return F.regexp_replace(escape(role), r"\](?= )", r"]\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def reply_paths(messages: DataFrame, top: int | None = None) -> DataFrame:
    """Paths of reply trees: (tree, leaf, depth, node), depth 0 at the root, for each leaf that is chosen.

    messages: (tree, node, parent, score), parent null at a root. A branch's score is the mean score of its messages,
    nulls left out; with `top`, each tree keeps its best `top` branches, ties by the smaller leaf. A parent that isn't
    there makes its child a root; a node that comes twice counts once, with its least parent and score; nulls in tree
    or node are dropped; messages on a cycle, or that hang from one, have no root and are in no path. Extra columns aren't
    carried; an empty table gives an empty table.
    """
    nodes = messages.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.min("score").alias("score"))
    nodes = common.written(nodes, "tree-nodes")
    ids = nodes.select("tree", F.col("node").alias("parent"), F.lit(1).alias("there"))
    # at level i, the nodes that have an ancestor 2**i steps up are open and know it as `up`; the others are done and know
    # their depth. Only open nodes climb on, and only their trees are read
    up = F.when(F.col("there") == 1, F.col("parent"))
    climb = common.written(nodes.join(ids, ["tree", "parent"], "left").select("tree", "node", up.alias("up"), F.when(up.isNull(), F.lit(0)).cast("long").alias("depth")), "tree-climb")
    levels, done, steps_made = [climb], climb.where("up is null"), [climb]
    while not (climb := levels[-1].where("up is not null")).isEmpty():
        trees = climb.select("tree").distinct()
        trees = common.small(trees, trees.count(), MOST_BROADCAST)
        far = done.unionByName(climb).join(trees, "tree", "left_semi").select("tree", F.col("node").alias("up"), F.col("up").alias("farther"), F.col("depth").alias("rest"))
        depth = F.when(F.col("farther").isNull(), F.col("rest") + (1 << len(levels) - 1))
        higher = common.written(climb.select("tree", "node", "up").join(far, ["tree", "up"]).select("tree", "node", F.col("farther").alias("up"), depth.alias("depth")), "tree-climb")
        new = higher.where("up is null")
        if new.isEmpty():
            # depths double with each level: once none is new, what is still open hangs from a cycle
            common.forget(higher)
            levels.pop()
            break
        levels.append(higher)
        steps_made.append(higher)
        done = done.unionByName(new)
    inner = nodes.select("tree", F.col("parent").alias("node"))
    leaves = done.join(inner, ["tree", "node"], "left_anti")
    paths = common.written(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")), "paths")
    for i, climb in reversed([*enumerate(levels)]):
        steps = climb.where("up is not null").select("tree", "node", "up")
        higher = paths.join(steps, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << i)).alias("back"))
        # written, as each level reads the paths so far twice: the plan would double with every level
        paths, before = common.written(paths.union(higher), "paths"), paths
        common.forget(before)
    common.forget(*steps_made)
    if top is not None:
        scored = paths.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc_nulls_last(), "leaf"))
        best = scored.select("tree", "leaf", rank.alias("r")).where(F.col("r") <= top).select("tree", "leaf")
        paths = paths.join(best, ["tree", "leaf"])
    return paths


def linear_replies(turns: DataFrame) -> DataFrame:
    """conversations as reply trees: (tree, node, parent, score, role, text); each turn answers the one before it.

    node numbers the turns of a conversation from 0 in the order of turn, role and text, so equal or null turns (first)
    stay apart. A null conversation id is an id of its own; tree is the id as text, so that it isn't null.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = (F.row_number().over(order) - 1).cast("long")
    numbered = turns.select("conv_id", "turn", "role", "text", node.alias("node"))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return numbered.select("conv_id", tree.alias("tree"), "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def format_paths(messages: DataFrame, top: int | None = None, trained_role: str = "assistant") -> DataFrame:
    """One conversation for each chosen branch: tree, leaf, n_turns, formatted, loss_spans.

    messages: (tree, node, parent, score, role, text). loss_spans lists (start, end) in code points of formatted, end
    exclusive: the escaped texts of trained_role. Null role or text: empty. A node that comes twice counts once, with its
    least role and text (ties). Very long texts are formatted whole. Other columns, whatever their names, are not carried;
    an empty table gives an empty table.
    """
    paths = reply_paths(messages.select("tree", "node", "parent", "score"), top)
    said = messages.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    turn = F.struct((-F.col("back")).alias("at"), F.col("m.role").alias("role"), F.concat(F.lit(BEGIN), escape_role(F.col("m.role")), F.lit(ROLE_END)).alias("head"), escape(F.col("m.text")).alias("body"))
    grouped = paths.join(said, ["tree", "node"]).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    # spans: a running length over the turns
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + F.lit(len(END))).alias("at"), F.when(t["role"] == trained_role, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate("turns", zero, add, lambda state: state["spans"])
    return grouped.select("tree", "leaf", F.size("turns").cast("long").alias("n_turns"), whole.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    # Only marks are free of backslashes, so the text falls apart at them whatever the turns say.
    turns = F.filter(F.split(formatted, re.escape(END)), lambda t: t != "")
    cut = lambda t: F.instr(t, ROLE_END)
    role = lambda t: F.substr(t, F.lit(len(BEGIN) + 1), cut(t) - F.lit(len(BEGIN) + 1))
    text = lambda t: F.substr(t, cut(t) + F.lit(len(ROLE_END)))
    return F.transform(turns, lambda t: F.struct(unescape(role(t)).alias("role"), unescape(text(t)).alias("text")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    messages = common.written(linear_replies(turns.unionByName(own)), "replies")
    formatted = common.written(format_paths(messages.drop("conv_id"), top=1), "formatted")
    common.forget(messages)
    said = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    read = formatted.select(
        F.when(F.col("tree") != "null", F.col("tree").cast("long")).alias("conv_id"),
        F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read


QUERIES = {"op10_chat": op10_chat}
ORACLES: dict[str, str] = {
    "op10_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '\[(INST|/INST\])', '[\\\1', 'g'), '<(\||<SYS>>|</SYS>>)', '<\\\1', 'g') AS body,
    regexp_replace(regexp_replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '\[(INST|/INST\])', '[\\\1', 'g'), '<(\||<SYS>>|</SYS>>)', '<\\\1', 'g') AS head
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST:' || head || '] ' || body || ' [/INST]</s>')) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
}
