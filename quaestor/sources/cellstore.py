"""A stored cell index: vectors partitioned by cell, read only where a search probes.

`create` publishes the centres with the first vectors, `append` assigns more vectors to the same
centres; both are versions of `sources.versions`, each with a content digest, so a search sees whole
appends only. `search` takes the cells that the batch probes, at most as many as there are
centres, and reads those partitions: the scan prunes the rest, and nothing is trained again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators import vectors as ve
from quaestor.sources import versions


@dataclass
class StoredCells:
    centres: np.ndarray
    vectors: DataFrame  # faq_id, embedding, cell_id (partition column)
    probes: int | None  # measured when the index was made


def _facts(kind: str, probes: int | None):
    def describe(stored: dict[str, DataFrame]) -> DataFrame:
        digest = F.bit_xor(F.xxhash64("faq_id", "embedding"))
        return stored["vectors"].agg(
            F.count("*").alias("row_count"),
            F.coalesce(digest, F.lit(0)).alias("digest"),
            F.lit(kind).alias("kind"),
            F.lit(probes).cast("long").alias("probes"),
        )

    return describe


def create(index: ve.CellIndex, path: str, probes: int | None = None) -> None:
    """Publish an index; `probes` is how many cells a search takes by default."""
    spark = index.assigned.sparkSession
    rows = [(k, [float(x) for x in centre]) for k, centre in enumerate(index.centres)]
    centres = spark.createDataFrame(rows, "cell_id long, centre array<double>")
    tables = {"vectors": _by_cell(index.assigned), "centres": centres}
    versions.publish(tables, path, _facts("index", probes), {"vectors": "cell_id"})


def _by_cell(assigned: DataFrame) -> DataFrame:
    """Few files a cell; a cell of any size is split by the runtime."""
    return assigned.select("faq_id", "embedding", "cell_id").hint("rebalance", "cell_id")


def append(vectors: DataFrame, path: str) -> None:
    """Add vectors (faq_id, embedding) to the cells of the stored centres."""
    stored = load(vectors.sparkSession, path)
    cell = ve._nearest_cells(vectors, stored.centres, 1)("embedding")[0].alias("cell_id")
    tables = {"vectors": _by_cell(vectors.select("faq_id", "embedding", cell))}
    versions.publish(tables, path, _facts("append", None), {"vectors": "cell_id"})


def load(spark: SparkSession, path: str) -> StoredCells:
    """The last published index and its appends."""
    done = versions.commits(spark, path)
    if done is None:
        raise FileNotFoundError(f"no index at {path}")
    rows = done.select("commit", "kind", "probes").orderBy("commit").collect()  # one per append
    start = max(k for k, r in enumerate(rows) if r["kind"] == "index")
    centres = versions.table(spark, path, "centres", rows[start]["commit"]).orderBy("cell_id").collect()
    vectors = None
    for row in rows[start:]:
        part = versions.table(spark, path, "vectors", row["commit"], "faq_id long, embedding array<float>, cell_id long")
        vectors = part if vectors is None else vectors.unionByName(part)
    return StoredCells(np.array([r["centre"] for r in centres]), vectors, rows[start]["probes"])


def compact(spark: SparkSession, path: str) -> None:
    """Publish all parts as one version."""
    stored = load(spark, path)
    create(ve.CellIndex(stored.centres, stored.vectors), path, stored.probes)


def probed(queries: DataFrame, stored: StoredCells, probes: int) -> DataFrame:
    """The stored vectors in the cells that any query probes; other partitions are not read."""
    if probes >= len(stored.centres):
        return stored.vectors
    pick = ve._nearest_cells(queries, stored.centres, probes)
    cells = queries.select(F.explode(pick("embedding")).alias("cell")).distinct().collect()  # at most the centres
    return stored.vectors.where(F.col("cell_id").isin([r["cell"] for r in cells]))


def search(queries: DataFrame, stored: StoredCells, k: int = 5, probes: int | None = None) -> DataFrame:
    """Best k by distance among the probed cells: query_id, rank, faq_id, similarity."""
    probes = min(probes or stored.probes or len(stored.centres), len(stored.centres))
    held = probed(queries, stored, probes)
    return ve.knn_cells(queries, ve.CellIndex(stored.centres, held), k, probes)
