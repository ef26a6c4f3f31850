"""Chat formatting: reply trees to single conversations, by iterative self-joins.  DataFrame functions only.

Messages are rows (tree, node, parent, role, text, score).  Ancestor tables of distance 1, 2, 4, ... are made by
joining each with itself until no row is left, which takes as many rounds as the logarithm of the longest path; they
hold node ids only.  They give each node the score of its path from the root, leaves are ranked by it within their
tree, and the same tables list the nodes of the chosen leaves' paths, so that texts are joined once.

The template writes ``<turn role>``, a line end, the text, ``</turn>`` and a line end.  In roles and texts ``\\`` is
written ``\\\\``, ``<`` as ``\\l``, ``>`` as ``\\g`` and ``#`` as ``\\h``: no control string can stand in a text, and
``unescape`` restores it.  The loss mask is an array of (start, length) in code points of the formatted text, one span
for each assistant text.

Null texts and roles are empty strings, null scores 0.  Nodes whose parent is missing are roots; a message that is its
own ancestor belongs to no path.  Equal scores go to the smaller leaf id.  Repeated messages (same tree and node) must
be numbered apart first, as ``linear_messages`` does for tables of turns.  An empty table gives no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: fixed values of the template
OPEN, CLOSE_OPEN, CLOSE = "<turn ", ">\n", "</turn>\n"
#: no path may be longer than two to this power
ROUNDS = 40


def escape(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"), ("#", "\\h")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape(x: Column) -> Column:
    """Pairs of backslashes are cut out from the left first, so that each code is read as it was written."""

    def plain(part: Column) -> Column:
        for a, b in (("\\l", "<"), ("\\g", ">"), ("\\h", "#")):
            part = F.replace(part, F.lit(a), F.lit(b))
        return part

    return F.array_join(F.transform(F.split(x, r"\\\\"), plain), "\\")


def linear_messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns of a table as reply trees without branches: each row answers the one before it (ties by role and text)."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = df.select(
        F.col(conv).alias("tree"), F.col(turn).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conversations_of(spark: SparkSession, messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, rank (from 1), path_score, n_turns, formatted, loss_spans: the best ``branches`` leaves of each tree."""
    disk = Scratch(spark, "chat")
    # a struct is never null: messages of a null tree are a tree of their own
    messages = disk.save(messages.withColumn("tree", F.struct("tree")), "messages")
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"))
    step = nodes.filter(F.col("parent").isNotNull()).join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up"))
    # total: the score of the nodes from this one up to, and without, "up"; of the whole path once "up" is null
    total = disk.save(nodes.join(step, ["tree", "node"], "left").select("tree", "node", "up", F.col("score").alias("total")), "total0")
    steps = []
    for i in range(ROUNDS):
        step = total.filter(F.col("up").isNotNull()).select("tree", "node", "up")
        if step.isEmpty():
            break
        steps.append(step)
        # only nodes that have not reached their root take part; one very long path doesn't make all others go on
        above = total.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"))
        moved = total.filter(F.col("up").isNotNull()).join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        total = disk.save(total.filter(F.col("up").isNull()).unionByName(moved), f"total{i + 1}")
    leaves = total.filter(F.col("up").isNull()).join(nodes.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    chosen = disk.save(chosen.select("tree", F.col("node").alias("leaf"), "rank", F.col("total").alias("path_score")), "chosen")

    path = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("height"))
    for i, step in enumerate(steps):
        more = path.join(step, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("height") + (1 << i)).alias("height"))
        path = path.unionByName(more)
        path = disk.save(path, f"path{i}")
    texts = messages.select("tree", "node", "role", "text")
    rows = path.join(texts, ["tree", "node"])

    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    rows = rows.select("tree", "leaf", (-F.col("height")).alias("at"), F.concat(F.lit(OPEN), role, F.lit(CLOSE_OPEN)).alias("head"), text.alias("body"), (F.col("role") == "assistant").alias("learn"))
    turn = F.concat("head", "body", F.lit(CLOSE))
    before = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("size", F.length(turn).cast("long"))
    start = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head")
    rows = rows.withColumn("span", F.when(F.col("learn"), F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length"))))
    packed = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", turn.alias("turn"), "span"))).alias("turns"))
    packed = packed.join(chosen, ["tree", "leaf"])
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return packed.select(
        F.col("tree")["tree"].alias("tree"), "leaf", "rank", "path_score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"</turn>\n"), lambda p: p != "")

    def one(part: Column) -> Column:
        head = F.substring_index(part, CLOSE_OPEN, 1)
        role = F.substr(head, F.lit(len(OPEN) + 1))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(part, F.length(head) + len(CLOSE_OPEN) + 1)).alias("text"))

    return F.transform(parts, one)


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one assistant text after the other."""
    one = lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, one), "")


def digest_rows(formatted: DataFrame) -> DataFrame:
    """The digests of formatted conversations, from the output alone."""
    turns = parse(F.col("formatted"))
    whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = under_mask(F.col("formatted"), F.col("loss_spans"))
    return formatted.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
