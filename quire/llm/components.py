"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.llm.workspace import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``edges`` has (u, v), u > v, without repeats. A large star joins each
    node's larger neighbours to the least node around it; a small star joins its smaller
    neighbours and itself to that. The least neighbour comes from a grouped minimum, which
    combines before the shuffle, and the join back is one that can be split by size, so a
    node with very many neighbours needs no task of its own."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for each node on an edge (a, b); component is the least node
    reachable. Nulls and self-edges are ignored; an edge may repeat or be reversed.
    Every round's edges are written to the shared folder, and those of the round before deleted."""
    now = stored(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        last, now = now, stored(_star(_star(now, large=True), large=False), "edges")
        discard(last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        mark = (mark[0], mark[1])
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    member = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
