"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component: the smallest node reachable.

    Each round gives all nodes a new random order (a hash of round and node)
    and moves every node to the least one at two steps at most, then renames
    the ends of edges and drops loops and repeats. A star is gone in one round.
    On a chain, whatever its numbering, a node is the least of its surroundings
    once in three or five, so rounds are logarithmic in the longest path. Moves
    and edges of a round are written, which cuts the lineage; the moves of all
    rounds, each a fraction of the one before, are joined up at the end. Nothing but the fact that edges are left reaches the
    driver. Null ends, loops and repeated edges are ignored; no edges give no
    rows. ``edges`` is read several times, so it should be a table.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    moves: list[DataFrame] = []
    while not e.isEmpty():
        moves.append(materialize(_moved(e, len(moves)), "moves"))
        at_u, at_v = moves[-1], moves[-1].select(F.col("u").alias("v"), F.col("p").alias("pv"))
        renamed = e.join(at_u, "u").join(at_v, "v").select(F.least("p", "pv").alias("u"), F.greatest("p", "pv").alias("v"))
        e = materialize(renamed.where("u <> v").distinct(), "edges")
    if not moves:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = moves[-1]
    for move in reversed(moves[:-1]):
        later = labels.select(F.col("u").alias("p"), F.col("p").alias("last"))
        labels = move.join(later, "p", "left").select("u", F.coalesce("last", "p").alias("p"))
    low = labels.groupBy("p").agg(F.min("u").alias("component"))
    return materialize(labels.join(low, "p").select(F.col("u").alias("node"), "component"), "components")


def _moved(e: DataFrame, number: int) -> DataFrame:
    """(u, p): each node and the one of least place within two steps."""
    place = lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("h"), F.col(c).alias("x"))
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.min(place("v")).alias("m")).select(F.col("u").alias("v"), F.least("m", place("u")).alias("m"))
    # Each node is among its neighbours' neighbours, so its own least one is not missed.
    return both.join(near, "v").groupBy("u").agg(F.min("m").alias("m")).select("u", F.col("m.x").alias("p"))
