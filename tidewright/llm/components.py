"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (partly aggregated before the shuffle) joined
back to the edges. The minima of vertices with very many edges, which are few
however many edges there are, are broadcast, so such a vertex's edges stay spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Keys that are broadcast at most, and rows up to which a key stays with the others.
HOT_KEYS, HOT_ROWS = 20_000, 256


def spread_join(rows: DataFrame, per_key: DataFrame, key: str | list[str], total: int | None = None, n: str | None = None) -> DataFrame:
    """``rows`` joined to ``per_key``, which has a row for each ``key``; a key with very many rows is not one task's.

    Keys with more than ``max(HOT_ROWS, total / HOT_KEYS)`` of the ``total`` rows are at
    most ``HOT_KEYS``: their side is broadcast. All others are joined by a shuffle.
    ``n`` names the column of ``per_key`` that has each key's rows, which are counted otherwise.
    """
    keys = [key] if isinstance(key, str) else key
    total = rows.count() if total is None else total
    if total <= HOT_ROWS:
        return rows.join(per_key, keys)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n")) if n is None else per_key.select(*keys, F.col(n).alias("__n"))
    hot = counts.where(F.col("__n") > max(HOT_ROWS, total // HOT_KEYS)).select(*keys, F.lit(True).alias("__hot"))
    if hot.isEmpty():
        return rows.join(per_key, keys)
    marked = rows.join(F.broadcast(hot), keys, "left")
    few = per_key.join(F.broadcast(hot), keys, "left_semi")
    return marked.where("__hot").drop("__hot").join(F.broadcast(few), keys).unionByName(marked.where("__hot is null").drop("__hot").join(per_key, keys))


def _least(rows: DataFrame) -> DataFrame:
    """Of each u of ``rows`` (u, v): the smallest v, the rows, and those whose v is smaller than u."""
    return rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"), F.sum((F.col("v") < F.col("u")).cast("long")).alias("down"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): component is the smallest node reachable.

    Loops, repeated and reversed edges are fine; edges with a null end are left
    out. No edges give no rows. Each round is written to the shared folder, and
    the one before it deleted. The minima of a step are written once too, as its
    join reads them up to three times. It ends when all edges are stars around
    the smallest nodes, which the minima tell.
    """
    now = scratch.save(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = scratch.save(_least(both), "least")
        # in a star a node has one smaller neighbour and no other, or larger ones alone
        total, more = least.agg(F.sum("down"), F.max((F.col("down") > 0) & (F.col("n") > 1))).first()
        if not more:
            scratch.forget(least)
            break
        met = spread_join(both, least, "u", 2 * total, "n").where(F.col("v") > F.col("u"))
        large = scratch.save(met.select(F.col("v").alias("a"), F.least("u", "m").alias("b")), "edges")
        for done in (now, least):
            scratch.forget(done)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = scratch.save(_least(down), "least")
        met = spread_join(down, least, "u", total, "n")
        pairs = met.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = scratch.save(pairs.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct(), "edges")
        for done in (large, least):
            scratch.forget(done)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
