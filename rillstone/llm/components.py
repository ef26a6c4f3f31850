"""Connected components of a link table, by alternating joins and minima; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: rounds at most; each at least squares the reach of a label along a chain
ROUNDS = 60


def connected(links: DataFrame, disk: Scratch, name: str) -> DataFrame:
    """node, component (the smallest node reachable) for each node of the links (a, b); nodes without links are left out.

    Each round hooks every node's current root to the smallest root among its neighbours, and then replaces each
    pointer by its pointer's pointer until none changes.  All groupings are minima, which are combined before the
    shuffle.  The links of a node with very many meet its one pointer in a join, which Spark splits where the partition is
    skewed (spark.sql.adaptive.skewJoin)."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = disk.save(both.filter("node <> other").distinct(), f"{name}-links")
    state = disk.save(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")), f"{name}-0")
    state = _shorten(state, disk, f"{name}-0")
    for i in range(1, ROUNDS):
        near = both.join(state.select(F.col("node").alias("other"), F.col("root").alias("theirs")), "other")
        near = near.join(state, "node").filter("theirs < root").groupBy(F.col("root").alias("at")).agg(F.min("theirs").alias("lower"))
        near = disk.save(near, f"{name}-{i}-hooks")
        if near.isEmpty():
            break
        moved = state.join(near, state["root"] == near["at"], "left").select("node", F.coalesce("lower", "root").alias("root"))
        state = _shorten(disk.save(moved, f"{name}-{i}"), disk, f"{name}-{i}")
    return state.select("node", F.col("root").alias("component"))


def _shorten(state: DataFrame, disk: Scratch, name: str) -> DataFrame:
    """Pointers to the end of their chain of pointers."""
    for j in range(ROUNDS):
        up = state.select(F.col("node").alias("root"), F.col("root").alias("next")).filter("root <> next")
        if up.isEmpty():
            break
        jumped = state.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("changed"))
        jumped = disk.save(jumped, f"{name}-s{j}")
        if jumped.filter("changed").isEmpty():
            return jumped.select("node", "root")
        state = jumped.select("node", "root")
    return state
