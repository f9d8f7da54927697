"""Operator 9: reply trees formatted as conversations, with DataFrame functions only.

Messages form trees by their parents.  Iterative self-joins enumerate the paths: in round r every
known (leaf, ancestor) pair is joined with the table of 2^r-step ancestors, which is then joined with
itself, so a tree of depth d takes log2(d) rounds and each path is found once.  Paths are ranked by
the mean score of their messages, and each chosen one becomes one conversation.

Template: ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>`` line break, for each turn.  Inside
roles and texts, ``<`` then n >= 0 backslashes then ``|`` gets one backslash more, so ``<|`` only
occurs in marks; taking one away gives the text back.  The loss mask covers assistant texts, as spans
of code points in the formatted string.

Defined results: null texts and roles are empty; a null tree id is a tree of its own; a message whose
parent is null or missing is a root; messages that only reach a cycle belong to no path; equal scores
are ranked by leaf; null scores count as 0; an empty table gives no rows; extra columns are ignored.
A conversation is one output row, so the longest one must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Shelf

START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<\\$1|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\(\\*)\|", r"<$1|")


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every message of every root-to-leaf path, ``up`` steps above the leaf.

    ``nodes`` has tree, node and parent, none null but a root's parent.
    """
    shelf = Shelf(nodes.sparkSession)
    own = nodes.select("tree", "node", "parent")
    known = own.select("tree", F.col("node").alias("parent"))
    linked = own.filter(F.col("parent").isNotNull()).join(known, ["tree", "parent"], "left_semi")
    jumps = shelf.put(linked.select("tree", "node", F.col("parent").alias("above")))
    leaves = own.select("tree", "node").join(jumps.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti")
    found = shelf.put(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    deepest = own.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < deepest and not jumps.isEmpty():
        higher = found.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        more = shelf.put(found.unionByName(higher))
        twice = jumps.join(jumps.select("tree", F.col("node").alias("above"), F.col("above").alias("top")), ["tree", "above"])
        next_jumps = shelf.put(twice.select("tree", "node", F.col("top").alias("above")))
        shelf.drop(found, jumps)
        found, jumps, step = more, next_jumps, 2 * step
    # a leaf above a cycle never meets a root
    rooted = found.join(linked.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "leaf")
    return found.join(rooted, ["tree", "leaf"], "left_semi")


def best_paths(found: DataFrame, nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """The ``branches`` best paths of each tree by mean score; all if None."""
    if branches is None:
        return found
    scored = found.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.asc("leaf"))
    chosen = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= branches)
    return found.join(chosen.select("tree", "leaf"), ["tree", "leaf"], "left_semi")


def formatted(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """tree, leaf, formatted, loss (spans of assistant texts): one row for each chosen path.

    ``nodes`` has tree, node, parent, role, text and, where branches are ranked, score.
    """
    chosen = best_paths(paths(nodes), nodes, branches)
    turns = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    whole = chosen.join(turns, ["tree", "node"])
    mark = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    turn = F.concat(mark, F.col("text"), F.lit(STOP))
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    start = F.coalesce(F.sum(F.char_length(turn)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.char_length(mark)
    laid = whole.select("tree", "leaf", "up", "role", turn.alias("turn"), start.alias("start"), F.char_length("text").alias("size"))
    rows = laid.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn", "role", "start", "size"))).alias("t"))
    spoken = F.filter("t", lambda x: x["role"] == "assistant")
    return rows.select(
        "tree",
        "leaf",
        F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.transform(spoken, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["size"]).alias("end"))).alias("loss"),
    )


def chain(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Reply trees of plain conversations: every row answers the one before it."""
    order = Window.partitionBy(id_col).orderBy(turn_col, "role", "text")
    tree = F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000"))
    place = F.row_number().over(order).cast("long")
    rows = turns.select(tree.alias("tree"), place.alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def read_back(rows: DataFrame) -> DataFrame:
    """What a formatted conversation says: turns (role, text) and the text under the loss mask."""
    pieces = F.split("formatted", r"\Q" + STOP.strip() + r"\E\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1)
    text = lambda p: F.substr(p, F.lit(len(START) + len(SEP) + 1) + F.char_length(role(p)))
    turns = F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return rows.withColumns({"turns": turns, "loss_text": F.array_join(loss, "")})


def report(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -1, formatted and read back from the output."""
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(id AS BIGINT) AS turn, IF(id = 0, 'user', 'assistant') AS role, :t AS text FROM range(2)", {"t": control})
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    back = read_back(formatted(chain(own.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").try_cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
