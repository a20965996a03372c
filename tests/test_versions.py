"""Versioned publication and the stored cell index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.operators import vectors as ve
from quaestor.session import scratch_path
from quaestor.sources import cellstore, tables, versions


def corpus(spark, n):
    rows = [(k, f"question {k}", f"answer {k}", "") for k in range(n)]
    return spark.createDataFrame(rows, "faq_id long, question string, answer string, source_url string")


def test_a_failed_writer_leaves_the_last_version(spark):
    path = scratch_path(spark, "snapshot")
    assert versions.latest(spark, path) is None
    tables.write_snapshot(corpus(spark, 10), path, "first", None, F.lit(1.0))

    def broken(stored):
        assert stored["corpus"].count() == 99  # the rows are there, the commit is not
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        versions.publish({"corpus": corpus(spark, 99)}, path, broken)
    failing = corpus(spark, 7).withColumn("question", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.write_snapshot(failing, path, "never", None, F.lit(2.0))
    status = tables.snapshot_status(spark, path).first()
    assert (status.expected_count, status.row_count, status.dataset_name, status.reusable) == (10, 10, "first", True)
    assert tables.load_snapshot(spark, path).count() == 10

    open_before = tables.load_snapshot(spark, path)
    tables.write_snapshot(corpus(spark, 20), path, "second", None, F.lit(3.0))
    assert tables.load_snapshot(spark, path).count() == 20
    assert open_before.count() == 10  # a reader goes on with its version
    assert versions.commits(spark, path).count() == 2


def test_nothing_published(spark):
    path = scratch_path(spark, "none")
    with pytest.raises(FileNotFoundError):
        versions.table(spark, path, "corpus")
    with pytest.raises(FileNotFoundError):
        cellstore.load(spark, path)


def clustered(spark, n, seed):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(0, 4, (12, 8))
    rows = [(seed * 10_000 + k, (centres[k % 12] + rng.normal(0, 1, 8)).astype(float).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "faq_id long, embedding array<float>")


def test_stored_cells_prune_and_equal_exact_search(spark, monkeypatch):
    path = scratch_path(spark, "cells")
    first, more = clustered(spark, 600, 1), clustered(spark, 300, 2)
    queries = clustered(spark, 40, 3).withColumnRenamed("faq_id", "query_id")
    index = ve.build_cells(first, 12)
    cellstore.create(index, path, probes=ve.enough_probes(queries, index, 5))
    cellstore.append(more, path)
    # from here on nothing may be trained or measured
    monkeypatch.setattr(ve, "build_cells", None)
    monkeypatch.setattr(ve, "enough_probes", None)
    stored = cellstore.load(spark, path)
    assert stored.vectors.count() == 900 and stored.probes is not None

    key = lambda df: {(r.query_id, r["rank"]): (r.faq_id, round(r.similarity, 9)) for r in df.collect()}
    exact = key(ve.knn_l2(queries, first.unionByName(more), 5))
    assert key(cellstore.search(queries, stored, 5, probes=12)) == exact
    found = key(cellstore.search(queries, stored, 5))
    hits = sum(found.get(k, (None,))[0] in {v[0] for q, v in exact.items() if q[0] == k[0]} for k in exact)
    assert hits >= 0.9 * len(exact)

    one = queries.where("query_id = 30000")
    held = cellstore.probed(one, stored, 2)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell_id" in plan or "PartitionFilters: [cell_id" in plan
    assert 0 < held.count() < 450
    assert len(held.select("cell_id").distinct().collect()) <= 2

    cellstore.compact(spark, path)
    again = cellstore.load(spark, path)
    assert key(cellstore.search(queries, again, 5, probes=12)) == exact
    assert versions.commits(spark, path).orderBy("commit").select("row_count").collect()[-1][0] == 900


def test_an_empty_append(spark):
    path = scratch_path(spark, "cells")
    first = clustered(spark, 50, 1)
    cellstore.create(ve.build_cells(first, 3), path, probes=3)
    cellstore.append(first.limit(0), path)
    assert cellstore.load(spark, path).vectors.count() == 50
