"""Corpus, index, evaluation and usage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.labels import NO_ANSWER_PHRASE

# Width of a length bucket and the size tiers that `index_profile` reports.
BUCKET_WIDTH = 50
FLAT_FROM = 5_000
GRAPH_FROM = 10_000
CELLS_FROM = 100_000
BUCKETS_ABOVE = 50_000


def corpus_stats(corpus: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return corpus.agg(
        F.count("*").alias("total_faqs"),
        F.avg(F.length("question")).alias("avg_question_length"),
        F.avg(F.length("answer")).alias("avg_answer_length"),
        distinct("source_url").alias("unique_sources"),
    )


def corpus_info(corpus: DataFrame, approximate: bool = False) -> DataFrame:
    """`corpus_stats` plus how much of the corpus carries a cleaned question."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return corpus.agg(
        F.count("*").alias("total_faqs"),
        F.avg(F.length("question")).alias("avg_question_length"),
        F.avg(F.length("answer")).alias("avg_answer_length"),
        distinct("source_url").alias("unique_sources"),
        F.count("question").alias("original_questions"),
        F.count("question_clean").alias("cleaned_questions"),
        (F.count("question") == F.count("question_clean")).alias("cleaning_done"),
    )


def source_bytes(table: DataFrame, columns: list[str]) -> DataFrame:
    """UTF-8 size of the text columns in MB."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return table.agg((F.sum(size) / F.lit(1048576)).alias("size_mb"))


def bucket_of(length: Column) -> Column:
    return F.floor(length / BUCKET_WIDTH).cast("long")


def with_length_bucket(corpus: DataFrame, column: str = "question") -> DataFrame:
    """Membership stays one row per question; the bucket is a join key, not a list."""
    return corpus.withColumn("len_bucket", bucket_of(F.length(column)))


def length_buckets(corpus: DataFrame) -> DataFrame:
    return (
        with_length_bucket(corpus)
        .groupBy("len_bucket")
        .agg(
            F.count("*").alias("members"),
            F.min("faq_id").alias("first_id"),
            F.max("faq_id").alias("last_id"),
        )
    )


def strategy_of(rows: Column) -> Column:
    """The size tier that a report names; no search follows it."""
    return (
        F.when(rows < FLAT_FROM, "brute_force")
        .when(rows < GRAPH_FROM, "flat_l2")
        .when(rows < CELLS_FROM, "graph")
        .otherwise("cells")
    )


def index_profile(corpus: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Items, dimension, number of length buckets (kept above 50,000 items), strategy."""
    base = corpus.agg(
        F.count("*").alias("total_items"),
        F.coalesce(F.max(F.size(embedding)), F.lit(0)).cast("long").alias("embedding_dimension"),
        F.count_distinct(bucket_of(F.length("question"))).alias("_buckets"),
        F.count(embedding).alias("index_vectors"),
    )
    n = F.col("total_items")
    return base.select(
        "total_items",
        "embedding_dimension",
        F.when(n > BUCKETS_ABOVE, F.col("_buckets")).otherwise(F.lit(0)).alias("length_buckets"),
        strategy_of(n).alias("index_type"),
        "index_vectors",
    )


def is_success(response: Column) -> Column:
    """A non-empty response without the no-answer phrase; a guard message counts."""
    return F.coalesce(
        (F.length(response) > 0) & ~response.contains(NO_ANSWER_PHRASE), F.lit(False)
    )


def eval_summary(
    responses: DataFrame, response: str = "response", seconds: str = "seconds"
) -> DataFrame:
    """Success rate and mean response time of a query batch; null for an empty batch."""
    hits = F.coalesce(F.sum(is_success(F.col(response)).cast("long")), F.lit(0))
    return responses.agg(
        F.count("*").alias("queries"),
        hits.alias("successes"),
        F.when(F.count("*") > 0, hits / F.count("*") * 100).alias("success_rate"),
        (F.avg(seconds) * 1000).alias("avg_ms"),
    )


def access_rollup(accesses: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Per entry: created, last accessed, access count and size."""
    return accesses.groupBy(*keys).agg(
        F.min("ts").alias("created_at"),
        F.max("ts").alias("accessed_at"),
        F.count("*").alias("access_count"),
        F.sum(size).alias("size_bytes"),
    )


def usage_stats(entries: DataFrame, hits: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Entries, hits, misses, hit rate and sizes. `hits` has one row per access: `hit` boolean.

    Rounding is half to even, as Python rounds.
    """
    mb = F.lit(1048576)
    # one aggregated row each, then summed into one
    e = entries.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("_bytes"),
        F.coalesce(F.avg("access_count"), F.lit(0.0)).alias("_mean"),
    )
    h = hits.agg(
        F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"),
        F.coalesce(F.sum((~F.col("hit")).cast("long")), F.lit(0)).alias("misses"),
    )
    both = e.unionByName(h, allowMissingColumns=True).agg(
        *[F.sum(c).alias(c) for c in ("entries", "_bytes", "_mean", "hits", "misses")]
    )
    total = F.col("hits") + F.col("misses")
    columns = [
        F.col("entries"),
        F.col("hits"),
        F.col("misses"),
        F.when(total > 0, F.bround(F.col("hits") / total * 100, 2))
        .otherwise(F.lit(0.0))
        .alias("hit_rate_percent"),
        F.bround(F.col("_bytes") / mb, 2).alias("total_size_mb"),
        F.bround("_mean", 1).alias("avg_access_count"),
    ]
    if max_bytes is not None:
        columns.append(F.bround(F.col("_bytes") / F.lit(max_bytes) * 100, 1).alias("usage_percent"))
    return both.select(*columns)
