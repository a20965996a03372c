"""A training corpus from raw documents, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet
and read again as the next one's `docs`. All but the last return the columns of `documents`.

1. language: documents whose language is rejected go; `lang` becomes the predicted language.
2. lines: lines that another document keeps go; a document that loses every line goes.
3. near_duplicates: one document of each group stays.
4. decontamination: documents with benchmark passages go.
5. mixture: the rest is drawn to the recipe's weights; one row per document and epoch, with
   `epoch`, `n_tokens` and `take_tokens` besides the document's columns.

`n_chars` follows the text. Empty tables pass through every stage; without any `lang` nothing
can be told and all go in the first. A document with a null id takes part in every stage but
near-duplicate linking, which keeps it. Of rows that repeat an id, near-duplicate removal keeps
or drops all, and the mixture takes those of equal length alike. Further columns are carried along,
except those that the mixture's own replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import decontaminate, langid, linededup, mixture, neardup
from quaestor.llm.graph import stored

PERCENT = 80  # of shingles in common, from which documents are near duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what is written in a learned language, under its predicted name."""
    model = langid.train(docs)
    plain = [c for c in docs.columns if c != "lang"]
    found = langid.predict(docs, model, tuple(plain), prefix="__").where("NOT __rejected")
    return found.select(*[F.col("__lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that are kept elsewhere, and documents of which nothing is left."""
    rows = linededup.dedup_lines(docs).where("__n_lines = 0 OR __n_removed < __n_lines")
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.withColumn("n_chars", size).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each component."""
    gone = neardup.near_duplicates(docs, PERCENT).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with passages of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents to the recipe's weights."""
    added = ["epoch", "n_tokens", "take_tokens"]
    drawn = mixture.mix(docs).select(F.col("doc_id").alias("__id"), *added)
    # rows that repeat an id are drawn one by one, but joined once
    drawn = drawn.dropDuplicates(["__id", "epoch", "n_tokens"])
    given = docs.select(*[c for c in docs.columns if c not in added], mixture.word_count().alias("__n"))
    return given.join(drawn, F.expr("doc_id <=> __id AND __n = n_tokens")).drop("__id", "__n")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mix),
]

# language identification and the fuzzy stages have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
