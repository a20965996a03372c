"""Block joins: compare two tables inside tasks and keep only the best rows.

Each side is cut into blocks of bounded size; a pair of blocks is one task group, which
returns at most k rows per left row. A hot key gets as many blocks as its size asks for, so
no group grows with the data, and no row pair is ever written out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEFT_ROWS = 4_096
RIGHT_ROWS = 32_768
MAX_PARTITIONS = 20_000


def _block(id_col: str, blocks) -> Column:
    return F.pmod(F.xxhash64(id_col), blocks)


def block_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    key: str | None = None,
    max_keys: int = 100_000,
    left_rows: int = LEFT_ROWS,
    right_rows: int = RIGHT_ROWS,
) -> DataFrame:
    """Apply `score(left_block, right_block)` to every pair of blocks (of equal `key`)."""
    parallelism = left.sparkSession.sparkContext.defaultParallelism
    if key is None:
        return _grid(left, right, left_id, right_id, score, schema, left_rows, right_rows, parallelism)

    sizes = (
        left.groupBy(key)
        .agg(F.count("*").alias("_nl"))
        .join(right.groupBy(key).agg(F.count("*").alias("_nr")), key)
        .select(
            key,
            F.ceil(F.col("_nl") / left_rows).cast("long").alias("_lbs"),
            F.ceil(F.col("_nr") / right_rows).cast("long").alias("_rbs"),
        )
        .persist()
    )
    n_keys, cells = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("_lbs") * F.col("_rbs")), F.lit(0))).first()
    # keys are cells, buckets or length classes: few. Past the bound Spark picks the join.
    if n_keys <= max_keys:
        sizes = F.broadcast(sizes)
    lhs = (
        left.join(sizes, key)
        .withColumn("_lb", _block(left_id, F.col("_lbs")))
        .withColumn("_rb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rbs") - 1)))
        .drop("_lbs", "_rbs")
    )
    rhs = (
        right.join(sizes, key)
        .withColumn("_rb", _block(right_id, F.col("_rbs")))
        .withColumn("_lb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lbs") - 1)))
        .drop("_lbs", "_rbs")
    )
    # many small keys share partitions; the blocks of a large key each have one
    return _cogroup(lhs, rhs, [key, "_lb", "_rb"], score, schema, max(cells - n_keys, min(n_keys, 4 * parallelism)))


def _grid(left, right, left_id, right_id, score, schema, left_rows, right_rows, parallelism):
    nl, nr = left.count(), right.count()
    n_left = max(1, math.ceil(nl / left_rows))
    n_right = max(1, math.ceil(nr / right_rows))
    # small inputs: still enough cells to keep all cores busy
    while n_left * n_right < parallelism and max(nl / n_left, nr / n_right) > 512:
        if nl / n_left >= nr / n_right:
            n_left *= 2
        else:
            n_right *= 2

    def all_of(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    lhs = left.withColumn("_lb", _block(left_id, F.lit(n_left))).withColumn("_rb", all_of(n_right))
    rhs = right.withColumn("_rb", _block(right_id, F.lit(n_right))).withColumn("_lb", all_of(n_left))
    return _cogroup(lhs, rhs, ["_lb", "_rb"], score, schema, n_left * n_right)


def _cogroup(lhs, rhs, keys, score, schema, cells):
    # a fixed number of partitions: the work is in the groups, not in their bytes, so the
    # runtime must not merge small partitions
    parts = max(1, min(4 * cells, MAX_PARTITIONS))
    # both sides may stem from one table: fresh column identities on the right
    rhs = rhs.select(*[F.col(c).alias(c) for c in rhs.columns])
    lhs = lhs.repartition(parts, *keys)
    rhs = rhs.repartition(parts, *keys)

    def run(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        return plain(score(lpdf, rpdf))

    return lhs.groupBy(*keys).cogroup(rhs.groupBy(*keys)).applyInPandas(run, schema)


def plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strings, and columns without rows, as Python objects: an empty column has no type of
    its own, and Arrow does not turn an empty number column into strings."""
    other = [c for c in pdf.columns if pdf.empty or pdf[c].dtype.kind not in "iufb"]
    return pdf.astype({c: object for c in other})


def best_per(df: DataFrame, group: str | list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts to k before the shuffle as well."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


# --- in-task top-k ------------------------------------------------------------------------


def top_cells(scores: np.ndarray, k: int, decimals: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best of every row, best first, lowest column first among
    equals. Ties at the cut are resolved exactly. With `decimals` scores are rounded; only those that
    can then be among the best are."""
    n = scores.shape[1]
    if n <= k:
        least = np.full((len(scores), 1), -np.inf)
    elif k == 1:
        least = scores.max(axis=1, keepdims=True)
    else:
        least = np.partition(scores, n - k, axis=1)[:, n - k, None]
    if decimals is not None:  # rounding moves a score by half a unit at most, and its last bits
        least = least - 2 * 10.0**-decimals - 4 * np.spacing(np.abs(least), where=np.isfinite(least), out=np.zeros_like(least))
    rows, cols = np.nonzero(scores >= least)
    found = scores[rows, cols]
    if decimals is not None:
        found = np.round(found, decimals)
    order = np.lexsort((cols, -found, rows))
    rows, cols, found = rows[order], cols[order], found[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], cols[kept], found[kept]
