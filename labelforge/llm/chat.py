"""Chat formatting of reply trees, with DataFrame operations only.

Root-to-leaf paths are enumerated by iterative self-joins: the links of 2**r generations are joined with themselves to those of 2**(r+1),
and every leaf meets its ancestors of each distance once, so the number of rounds is the logarithm of the depth. Branches are ranked by
the mean score of their messages, and each chosen path is written as one conversation.

Template: ``### role``, a line feed, the text, ``</turn>`` and a line feed per turn. Inside roles and texts ``\\``, ``#`` and ``<`` (in roles
the line feed too) are written as ``\\b``, ``\\h``, ``\\l`` (``\\n``), so no control string can occur inside and reading back is exact.

Defined cases: a null text or role is empty; null tree ids are one tree; a parent that is missing or not smaller than the message makes
the message a root (links cannot run in circles); of repeated message ids the smallest row stays; ties between branches go to the longer,
then to the smaller leaf; messages without an id take no part; an empty table gives an empty result; other columns are never read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import durable

HEAD, END = "### ", "</turn>\n"
_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(c: Column, line: bool = False) -> Column:
    for a, b in (*_ESCAPES, *((("\n", "\\n"),) if line else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, line: bool = False) -> Column:
    for a, b in reversed((*_ESCAPES, *((("\n", "\\n"),) if line else ()))):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, id, up) of every node on every root-to-leaf path; ``up`` counts generations above the leaf. ``nodes`` has unique
    (tree, id) and a parent that is null or present and smaller."""
    links = durable(nodes.filter("parent is not null").select("tree", "id", "parent"))
    inner = links.select("tree", F.col("parent").alias("id")).distinct()
    paths = nodes.join(inner, ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    step = 1
    while not links.isEmpty():
        further = paths.join(links, ["tree", "id"]).select("tree", "leaf", F.col("parent").alias("id"), (F.col("up") + step).alias("up"))
        paths = durable(paths.unionByName(further))
        upper = links.select("tree", F.col("id").alias("parent"), F.col("parent").alias("top"))
        links = durable(links.join(upper, ["tree", "parent"]).select("tree", "id", F.col("top").alias("parent")))
        step *= 2
    return paths


def format_trees(messages: DataFrame, tree_col: str = "tree_id", id_col: str = "msg_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text",
                 score_col: str | None = None, branches: int | None = None, learn_role: str = "assistant") -> DataFrame:
    """One row per chosen path: the tree id, ``leaf``, ``score``, ``formatted`` and ``loss`` (start, length in code points of the texts under
    the loss mask, in order). ``branches`` keeps that many best branches of a tree, None all."""
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    rows = messages.select(F.coalesce(F.col(tree_col).cast("string"), F.lit("\0")).alias("tree"), F.col(id_col).cast("long").alias("id"), F.struct(
        F.col(parent_col).cast("long").alias("parent"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        score.alias("score"), F.col(tree_col).alias("own")).alias("m"))
    nodes = durable(rows.filter("id is not null").groupBy("tree", "id").agg(F.min("m").alias("m")).select("tree", "id", "m.*"))
    there = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    linked = nodes.select("tree", "id", F.when(F.col("parent") < F.col("id"), F.col("parent")).alias("parent"))
    known = linked.filter("parent is not null").join(there, ["tree", "parent"], "left_semi").select("tree", "id", "parent")
    paths = leaf_paths(durable(linked.drop("parent").join(known, ["tree", "id"], "left")))
    full = paths.join(nodes.drop("parent"), ["tree", "id"])
    if branches is not None:
        rated = full.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
        w = Window.partitionBy("tree").orderBy(F.col("mean").desc(), F.col("n").desc(), "leaf")
        chosen = rated.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= branches)
        full = full.join(chosen.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    head = F.concat(F.lit(HEAD), escape(F.col("role"), True), F.lit("\n"))
    body = escape(F.col("text"))
    turns = full.select("tree", "leaf", "own", "up", "score", "role", head.alias("head"), body.alias("body"))
    turns = turns.select("tree", "leaf", "own", "up", "score", F.concat("head", "body", F.lit(END)).alias("piece"), F.length("head").alias("h"),
                         F.when(F.col("role") == learn_role, F.length("body")).alias("n"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.col("up").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("h"))
    out = placed.groupBy("tree", "leaf").agg(F.max("own").alias(tree_col), F.avg("score").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("o"), "piece", "at", "n"))).alias("t"))
    loss = F.transform(F.filter("t", lambda x: x["n"].isNotNull()), lambda x: F.struct(x["at"].cast("long").alias("start"), x["n"].cast("long").alias("length")))
    return out.select(tree_col, "leaf", "score", F.array_join(F.col("t.piece"), "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, END)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p):
        line = F.substring_index(p, "\n", 1)
        return F.struct(unescape(F.substr(line, F.lit(len(HEAD) + 1)), True).alias("role"), unescape(F.substr(p, F.length(line) + 2)).alias("text"))
    return F.transform(parts, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
