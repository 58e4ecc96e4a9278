"""Connected components of an edge list: alternating large-star and small-star steps, shared between all tasks, until the links
are few enough for one task, which ends the work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _mins(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.min("v").alias("m"))


def _with_mins(arcs: DataFrame, hubs: int = 1000) -> DataFrame:
    """arcs with the least neighbour m of u. Minima are formed in each task before the shuffle. Arcs of a node that has more
    than one in `hubs` of all meet its minimum by a broadcast, of at most `hubs` rows, and so never gather in one task."""
    total = arcs.count()
    mins = arcs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    large = F.broadcast(mins.where(F.col("n") > total // hubs + 1).select("u", "m"))
    return arcs.join(large, "u").unionByName(arcs.join(large, "u", "left_anti").join(mins.select("u", "m"), "u"))


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of it and its neighbours."""
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_mins(arcs).where("v > u").select(F.least("u", "m").alias("a"), F.col("v").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of those."""
    arcs = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    moved = _with_mins(arcs).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionAll(_mins(arcs).select(F.col("m").alias("a"), F.col("u").alias("b")))


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node reachable from each) of the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            nodes, least = joined(*(np.concatenate(x) for x in zip(*got)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, one_task: int = 2_000_000, rounds: int = 60) -> DataFrame:
    """(a, b) links of long ids, in any order, repeated or not -> (node, component), component the least node reachable.

    Nodes without a link do not appear; self links and links with a null end are ignored; no links, no rows. Links stay on the
    executors; the driver sees counts alone. While there are more than one_task distinct links (of 16 bytes), star steps run
    over all tasks, and a hub's links never gather in one; the links that are left, at most one_task, end in one task.
    Every round is written to the shared scratch folder. Both ways give the same rows."""
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, before = materialize(e, "links"), None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] <= one_task:
            return _in_one_task(now)
        if state == before:
            break
        before = state
        after = materialize(_small(_large(now).where("a <> b").distinct()).where("a <> b").distinct(), "links")
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
