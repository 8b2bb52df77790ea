"""Connected components of a table of links, by contraction within tasks and alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Links that one task contracts (16 bytes each).
LOCAL = 1_000_000
#: A node with so many neighbours has them joined where they are; such nodes are HUBS at most.
DEGREE, HUBS = 100_000, 1_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of links (a, b) but the least of its component, and that least one."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    low = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[low], nodes[root[low]]


def _contract(batches) -> Iterator:
    """All links of a task to stars."""
    import pyarrow as pa

    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if held:
        u, v = contract(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _with_least(pairs: DataFrame, degree: int, n: int) -> DataFrame:
    """pairs (u, v), n at most, with m, the least of u and its v; the rows of a hub never meet in one task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    if n <= degree:
        return pairs.join(least.drop("n"), "u")
    # n rows have n / degree hubs at most
    hubs = least.filter(F.col("n") > max(degree, -(-n // HUBS))).select("u", F.col("m").alias("hub"))
    marked = pairs.join(F.broadcast(hubs), "u", "left")
    calm = marked.filter("hub IS NULL").select("u", "v").join(least.select("u", "m"), "u")
    return calm.unionByName(marked.filter("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m")))


def components(links: DataFrame, local: int = LOCAL, degree: int = DEGREE) -> DataFrame:
    """node, component (the smallest node reachable) for every node that stands in links (a, b: long).

    Tasks contract ``local`` links each into stars; what one task can hold is done
    then.  Otherwise rounds point a node's larger neighbours, then its smaller ones, to
    the smallest neighbour it has; the rounds needed grow with the logarithm of the
    longest chain.  A node's neighbours are only ever reduced to their minimum and
    joined, never gathered; those of a node with more than ``degree`` are joined
    by broadcasting the node.
    """
    n = links.count()
    parts = max(1, -(-n // local))
    stars = links.filter("a <> b").select("a", "b").repartition(parts).mapInArrow(_contract, "u long, v long")
    new = save(stars, "links")
    size = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
    before = size(new) if parts > 1 else None
    while parts > 1:
        both = new.unionByName(new.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, degree, 2 * before["n"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large.filter("u <> v"), degree, 2 * before["n"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = save(small.filter("u <> v").distinct(), "links")
        after = size(new)  # equal sets of rows have equal numbers
        if after == before:
            break
        before = after
    found = new.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
