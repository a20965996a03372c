"""Atomic, versioned publication of tables that belong together.

Every publication writes its tables to a folder of its own and then one commit row, which also
describes them. Readers start from the commits: they see a version whole or not at all, never new
tables with an old description, and a writer that fails leaves the last version in place. Folders
without a commit are garbage that `uncommitted` lists. Nothing is overwritten, so a reader that
has opened a version can go on with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def commits(spark: SparkSession, path: str) -> DataFrame | None:
    """All commit rows (`commit`, the version's name, and what the writer described), or None before the first."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def latest(spark: SparkSession, path: str) -> str | None:
    """The name of the last committed version."""
    rows = commits(spark, path)
    return None if rows is None else rows.agg(F.max("commit")).first()[0]


def publish(
    tables: dict[str, DataFrame],
    path: str,
    describe: Callable[[dict[str, DataFrame]], DataFrame],
    partition: dict[str, str] | None = None,
) -> str:
    """Write `tables` as one version; `describe` turns the stored tables into the one row of the
    commit. `partition` names a partition column for a table. Of two writers at the same time the
    one with the greater name is the later version, and both are kept."""
    spark = next(iter(tables.values())).sparkSession
    before = commits(spark, path)
    number = 0 if before is None else before.count()
    version = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    stored = {}
    for name, df in tables.items():
        place = f"{path}/versions/{version}/{name}"
        by = (partition or {}).get(name)
        (df.write.partitionBy(by) if by else df.write).parquet(place)
        # an empty partitioned table leaves no file to tell its columns
        stored[name] = spark.read.schema(df.schema).parquet(place)
    row = describe(stored).withColumn("commit", F.lit(version))
    # one file, which appears whole
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def table(spark: SparkSession, path: str, name: str, version: str | None = None, schema=None) -> DataFrame:
    """A table of a version, the last by default."""
    version = version or latest(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/versions/{version}/{name}")


def described(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The commit row of a version, the last by default."""
    version = version or latest(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return commits(spark, path).where(F.col("commit") == version).drop("commit")
