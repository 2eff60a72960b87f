"""Operator 7, chat formatting: reply trees, all in DataFrame functions.

Messages form trees by their parent. Iterated self-joins enumerate the paths from
each leaf to its root: a round k joins every path so far with the ancestors 2^k
steps up, so depth costs its logarithm in rounds, each written to the shared
folder. Branches are ranked by the sum of their messages' scores (ties: longer
first, then the smaller leaf), and each chosen path is one conversation. Texts take
no part in the joins: at the end they are dealt by tree, once, and meet the chosen
paths there. A conversation is one row, put together by one task, so that is the
size which has to fit a task; trees are many.

A formatted turn is ``<s>[role]``, a line break, the text, ``</s>`` and a line
break. In roles and texts a backslash is put after each of ``< [ ] \\``: then no
control string can appear inside, and dropping it again is exact.

Null texts and roles are empty; long texts stay whole. A message whose parent isn't
in its tree is a root; messages on a cycle have no leaf below and no path. Rows
that repeat a node id in their tree must be told apart before (``linear_nodes``
numbers rows, so repeated rows are turns of their own). Rows without conv_id are one
conversation, in the order of their turns. Columns besides those named aren't looked
at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

ESCAPED = r"([<\[\]\\])"
OPEN, HEAD_END, CLOSE = "<s>[", "]\n", "</s>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED + r"\\", "$1")


def linear_nodes(turns: DataFrame) -> DataFrame:
    """Nodes (tree, node, parent, score, role, text) of conversations without
    branches: rows by turn, each the reply to the one before."""
    role, text = F.coalesce(turns["role"], F.lit("")), F.coalesce(turns["text"], F.lit(""))
    rows = turns.select(tree_of(turns).alias("tree"), turns["turn"].alias("turn"), role.alias("role"), text.alias("text"))
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    return rows.select("tree", nth.cast("long").alias("node"), F.when(nth > 1, nth - 1).cast("long").alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def tree_of(turns: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("="), turns["conv_id"].cast("string")), F.lit("-"))


def linear_ids(turns: DataFrame) -> DataFrame:
    """tree, node, parent and score of ``linear_nodes``: numbers from 1 in each tree,
    for which texts needn't be read."""
    sizes = turns.select(tree_of(turns).alias("tree")).groupBy("tree").count()
    rows = sizes.select("tree", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("node"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"))


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): the nodes from each leaf to its root; up: steps from the leaf."""
    with scratch(nodes.sparkSession) as keep:
        ids = materialize(nodes.select("tree", "node", "parent"), "ids")
        up = materialize(ids.join(ids.select("tree", F.col("node").alias("parent")).distinct(), ["tree", "parent"]).select("tree", "node", F.col("parent").alias("above")), "up")
        inner = up.select("tree", F.col("above").alias("node")).distinct()
        paths = materialize(ids.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
        most = ids.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
        for k in range(int(most).bit_length()):  # a path has at most so many nodes; cycles end here too
            longer = paths.join(up, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
            farther = up.join(up.select("tree", F.col("node").alias("above"), F.col("above").alias("next")), ["tree", "above"]).select("tree", "node", F.col("next").alias("above"))
            paths, up = materialize(paths.unionByName(longer), "paths"), materialize(farther, "up")
            if up.isEmpty():
                break
        keep(paths)
    return paths


def best_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, node, up) of the ``top`` branches of each tree (None: all)."""
    paths = leaf_paths(nodes)
    scored = paths.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    branches = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.count("*").alias("depth"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "leaf"))
    ranked = branches.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return paths.join(ranked.select("tree", "leaf", "rank"), ["tree", "leaf"])


def format_paths(nodes: DataFrame, top: int | None = 1, trained: tuple[str, ...] = ("assistant",), ids: DataFrame | None = None) -> DataFrame:
    """tree, rank, formatted, n_turns and spans of the chosen paths.

    spans: where in ``formatted`` the loss mask holds, as (start from 1, length)
    of each text of a ``trained`` role, in order. ids: tree, node, parent and score of
    ``nodes``, where they can be had without the texts.
    """
    ids = nodes.select("tree", "node", "parent", "score") if ids is None else ids
    chosen = best_paths(ids, top).select("tree", "node", "leaf", "rank", "up")
    none = F.lit(None)
    said = nodes.select("tree", "node", none.cast("long").alias("leaf"), none.cast("int").alias("rank"), none.cast("long").alias("up"), "role", "text")
    asked = chosen.select("*", none.cast("string").alias("role"), none.cast("string").alias("text"))
    here = Window.partitionBy("tree", "node")
    met = said.unionByName(asked).repartition("tree").select("tree", "leaf", "rank", "up", *(F.max(c).over(here).alias(c) for c in ("role", "text")))
    met = met.where("up is not null and text is not null")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD_END))
    body = escape(F.col("text"))
    rows = met.select("tree", "leaf", "rank", "up", F.col("role").isin(*trained).alias("loss"), head.alias("head"), body.alias("body"))
    long = lambda c: F.length(c).cast("long")
    # where a body begins: behind the turns before it and its own head
    before = F.sum(long("head") + long("body") + len(CLOSE)).over(Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(before, F.lit(0)) + long("head") + 1)
    turn = F.struct((-F.col("up")).alias("at"), "loss", "start", long("body").alias("length"), F.concat("head", "body", F.lit(CLOSE)).alias("segment"))
    grouped = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return grouped.select("tree", "rank", F.array_join(F.col("turns.segment"), "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"), spans.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss (texts under the mask), from ``formatted`` and ``spans``."""
    parts = F.split("formatted", CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        at = F.instr(part, F.lit(HEAD_END))
        role = F.substr(part, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(part, at + len(HEAD_END))).alias("text"))

    loss = F.transform("spans", lambda s: unescape(F.substr("formatted", s["start"].cast("int"), s["length"].cast("int"))))
    return formatted.select("*", F.transform(parts, turn).alias("turns"), loss.alias("loss"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """What formatted conversations say when they are read back."""
    back = read_back(format_paths(linear_nodes(turns), ids=linear_ids(turns)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    conv = F.when(F.col("tree") != "-", F.substring("tree", 2, 40).cast("long"))
    return back.select(conv.alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
