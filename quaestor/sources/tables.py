"""Readers and stored artefacts: items, corpus snapshots, vector sets, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor import schemas
from quaestor.operators.embed import manifest, validate
from quaestor.operators.spelling import export_vocabulary
from quaestor.sources import versions

REUSE_SHARE = 0.8  # fixed value: a snapshot may fall this far short of what was expected


def read_items(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Nested items with a declared schema (parquet, JSON or ORC)."""
    return spark.read.schema(schemas.ITEM).format(fmt).load(path)


def write_snapshot(
    corpus: DataFrame, path: str, dataset: str, max_faqs: int | None, created_at: Column
) -> None:
    """The processed corpus and its manifest, published together as one version."""

    def describe(stored: dict[str, DataFrame]) -> DataFrame:
        return stored["corpus"].agg(F.count("*").alias("expected_count")).select(
            "expected_count",
            F.lit(dataset).alias("dataset_name"),
            F.lit(max_faqs).cast("long").alias("max_faqs"),
            created_at.alias("created_at"),
        )

    versions.publish({"corpus": corpus}, path, describe)


def snapshot_status(spark: SparkSession, path: str, max_faqs: int | None = None) -> DataFrame:
    """Manifest, stored rows and whether the snapshot serves a corpus of `max_faqs`."""
    version = versions.latest(spark, path)
    rows = versions.table(spark, path, "corpus", version).agg(F.count("*").alias("row_count"))
    described = versions.described(spark, path, version).unionByName(rows, allowMissingColumns=True)
    one = described.agg(*[F.max(c).alias(c) for c in described.columns])
    enough = (
        F.col("row_count") >= F.least(F.lit(float(max_faqs)), F.col("expected_count") * REUSE_SHARE)
        if max_faqs
        else F.lit(True)
    )
    return one.withColumn("reusable", (F.col("row_count") > 0) & enough)


def load_snapshot(spark: SparkSession, path: str, max_faqs: int | None = None) -> DataFrame | None:
    """The stored corpus, or None if it has to be built again."""
    if not snapshot_status(spark, path, max_faqs).first()["reusable"]:
        return None
    return versions.table(spark, path, "corpus")


def write_vectors(
    store: DataFrame, path: str, model: str, dataset: str, max_faqs: int | None, created_at: Column
) -> None:
    """Vectors (key, embedding) and their manifest, published together as one version."""
    versions.publish(
        {"vectors": store}, path, lambda stored: manifest(stored["vectors"], model, dataset, max_faqs, created_at)
    )


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vectors and manifest of one version, the last."""
    version = versions.latest(spark, path)
    return versions.table(spark, path, "vectors", version), versions.described(spark, path, version)


def load_vectors(
    spark: SparkSession, path: str, rows: int, dim: int, model: str, dataset: str, position: str = "key"
) -> DataFrame | None:
    """The stored vectors, if they pass `validate` for `rows` texts, cut to the first `rows` under
    `position` where there are a few more; None if they have to be made again."""
    vectors, described = read_vectors(spark, path)
    stored = described.select("model_name", "dataset_name").first()
    if stored is None:
        return None
    status = validate(vectors, rows, dim, stored["model_name"], model, stored["dataset_name"], dataset).first()["status"]
    if status == "truncate":
        return vectors.orderBy(position).limit(rows)
    return vectors if status == "ok" else None


def write_dictionary(
    dictionary: DataFrame, vocabulary: DataFrame, path: str, fmt: str = "parquet", n: int | None = None
) -> None:
    """The accepted words and the learned words (the `n` most frequent ones, if given)."""
    dictionary.select("word").distinct().write.mode("overwrite").format(fmt).save(f"{path}/accepted")
    export_vocabulary(vocabulary, n).write.mode("overwrite").format(fmt).save(f"{path}/vocabulary")


def read_dictionary(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Both tables; they replace, not extend, what was learned before."""
    return (
        spark.read.schema(schemas.WORD).format(fmt).load(f"{path}/accepted"),
        spark.read.schema(schemas.VOCABULARY).format(fmt).load(f"{path}/vocabulary"),
    )
