"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import Scratch, lookup


def _written(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, dict]:
    """The edges, written, and what tells whether they changed: how many they are, and a sum of their hashes."""
    return scratch.write(edges, name, edges=F.count(F.lit(1)), mark=F.bit_xor(F.xxhash64("u", "v"))), scratch.seen(name)


def _least(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Each edge with m, the least v of its u; the edges of a node with very many are not brought together."""
    least = scratch.sized(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name, "n")
    return lookup(edges, least, "u", "n").drop("n")


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Each node's larger neighbours point to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = _least(both, scratch, name).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return out.distinct()


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Each node and its smaller neighbours point to the least of those neighbours."""
    found = _least(edges, scratch, name)
    below = found.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(found.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of every node with an edge: label is the least node of its component.

    ``edges`` has long columns u and v; loops and repeats do no harm. A node's edges meet in
    aggregations that combine where they are read and in lookups whose hot keys are split.
    """
    oriented = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, state = _written(oriented, scratch, f"{name}-0")
    k = 0
    while state["edges"]:
        k += 1
        large = scratch.write(_large_star(now, scratch, f"{name}-large-{k}"), f"{name}-half-{k}")
        before = state
        now, state = _written(_small_star(large, scratch, f"{name}-small-{k}"), scratch, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-half-{k}", f"{name}-large-{k}", f"{name}-small-{k}")
        if state == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())
