"""Connected components of a distributed link table: a union-find by star contraction."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.session import scratch_path


TOGETHER = 200_000  # links that a task joins at a time


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """`df` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.parquet(path)


def _toward(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) as (neighbour, least of u and u's neighbours); a node with any number of
    neighbours is combined before the shuffle, and its join is of the kind that Spark splits."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def _unsettled(edges: DataFrame) -> DataFrame:
    """`w`: the nodes `v` of edges (u, v) that do not form a whole star yet, in which every `u` has
    one edge and no node is on both sides."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    counts = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    busy = counts.where("up > 1 OR up > 0 AND down > 0").select("id")
    above = edges.join(busy.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("w"))
    return stored(above.unionByName(busy.select(F.col("id").alias("w"))).distinct(), "unsettled")


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1, the least one reachable over the links (a, b)."""
    least = np.arange(n)
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return least
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := least[least], least):
            least = further


def local_stars(links: DataFrame) -> DataFrame:
    """Links (`a`, `b`) that join the same nodes as the given ones, but of those that a task holds
    TOGETHER at a time only one from each node to the least one it reaches: as many as nodes at
    most, however dense the groups are."""

    def run(batches):
        held, rows = [], 0

        def close():
            table = pa.Table.from_batches(held)
            ids = pa.concat_arrays([*table.column("a").chunks, *table.column("b").chunks])
            names, at = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
            least = _least(*at.reshape(2, -1), len(names))
            node = np.flatnonzero(least != np.arange(len(names)))
            kind = table.schema.field("a").type
            held.clear()
            return pa.record_batch([pa.array(names[node], kind), pa.array(names[least[node]], kind)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= TOGETHER:
                yield close()
                rows = 0
        if rows:
            yield close()

    return links.mapInArrow(run, links.schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`id`, `component` (least id reachable) of every node that has a link.

    Alternates two steps until nothing is left: every node hands its larger neighbours to its
    least neighbour, then its smaller ones; each halves the depth of long chains. Components that
    are whole stars leave after each round, so pairs and small groups are not joined again while
    the deepest goes on.
    """
    pair = [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    edges = stored(links.where(F.col(a) != F.col(b)).select(*pair).distinct(), "edges")
    stars = []
    while True:
        unsettled = _unsettled(edges)
        match = F.col("v") == F.col("w")
        stars.append(edges.join(unsettled, match, "left_anti"))
        if unsettled.isEmpty():
            break
        edges = edges.join(unsettled, match, "left_semi")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _toward(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "edges")
    done = reduce(DataFrame.unionByName, stars)
    roots = done.select("v").distinct()
    return done.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("id"), F.col("v").alias("component"))
    )
