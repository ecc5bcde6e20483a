"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.session import cut_lineage

#: Tables of later rounds are written in pieces of about this many rows.
PIECE_ROWS = 100_000


def _written(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, ``most`` at most, as a table in as few pieces as that many rows need."""
    return cut_lineage(rows.coalesce(max(1, -(-most // PIECE_ROWS))))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the edges (u, v): a row (node, component) for each node, by its least node.

    Each round takes every node to the first one of its neighbourhood, relabels the edges and
    drops those within one label, until none is left; the rounds' labels are then followed from
    the last to the first. First is the least number, which ends stars around their least node
    at once, or, if that left more than half of the edges, the least hash of the round, which is
    expected to leave at most three quarters of the labels whatever the graph.

    A round is one aggregate of minima, combined on the map side, and two joins with one row a
    node on one side; as the minima are written first, a join can part the edges of a node that
    has many. The graph never leaves the cluster; only counts of edges do. Self-loops and nulls
    are dropped, so a node without another neighbour is not in the result.
    """
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rounds, plain, hashed = [], True, False
    left = edges.count()
    while left:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if plain:
            first = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        else:
            hashed = True
            at = [F.struct(F.xxhash64(F.lit(len(rounds)), n).alias("h"), F.col(n).alias("n")) for n in ("u", "v")]
            first = both.groupBy("u").agg(F.least(F.first(at[0]), F.min(at[1]))["n"].alias("m"))
        first = _written(first, 2 * left)
        rounds.append(first)
        ends = [first.select(F.col("u").alias(n), F.col("m").alias(f"{n}m")) for n in ("u", "v")]
        met = edges.join(ends[0], "u").join(ends[1], "v").where("um <> vm")
        edges = _written(met.select(F.greatest("um", "vm").alias("u"), F.least("um", "vm").alias("v")).distinct(), left)
        before, left = left, edges.count()
        plain = 2 * left <= before
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = rounds.pop()
    while rounds:
        # A label without an edge in the next round is not in its table and stays as it is.
        later = found.select(F.col("u").alias("m"), F.col("m").alias("top"))
        found = rounds.pop().join(later, "m", "left").select("u", F.coalesce("top", "m").alias("m"))
    if hashed:
        found = cut_lineage(found)
        names = cut_lineage(found.groupBy("m").agg(F.min("u").alias("least")))
        found = found.join(names, "m").select("u", F.col("least").alias("m"))
    return found.select(F.col("u").alias("node"), F.col("m").alias("component"))
