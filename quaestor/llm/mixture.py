"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). The token budget is handed down the tree by weight. A
node that has fewer tokens (times `max_epochs`) than its share gives the rest to its siblings
in proportion to their weights; only what a whole family cannot use reaches the level above.
Each leaf then reads its documents in seeded epochs: whole epochs as often as its quota allows
and of the next one the first tokens of a hashed order.

A leaf may hold any share of the rows: its order is cut into hash buckets whose token sums
are added up first, and only the bucket in which the quota ends is sorted.

Defined cases: a null text, or one of white space, has no tokens and is never taken; null
languages and sources are the child `unknown`; weights that are null, missing or not positive
mean that nothing is taken; rows with equal ids are taken independently, the one with fewer
tokens first; an empty table gives an empty mixture.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.session import scratch_path

LEAF = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"
LEAVES_BROADCAST = 100_000  # rows of (leaf, quota) that are sent to every task at most


@dataclass(frozen=True)
class Recipe:
    """Weights are whole numbers, so that their sums are exact in any order."""

    domain_of: str  # SQL expression over the documents' columns
    domains: dict[str, int]
    languages: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    other_language: int = 1
    other_source: int = 1
    share: tuple[int, int] = (1, 2)  # of the available tokens, as a fraction
    max_epochs: int = 2
    seed: int = 17


RECIPE = Recipe(
    domain_of="CASE WHEN source = 'src0' THEN 'web' WHEN length(source) = 4 THEN 'news' "
    "WHEN length(source) = 5 THEN 'books' ELSE 'other' END",
    domains={"web": 3, "news": 4, "books": 2, "other": 1},
    languages={"en": 5, "de": 3, "fr": 2, "es": 2},
)


def _weight(column: str, weights: dict[str, int], other: int) -> Column:
    value = F.lit(other)
    for name, weight in sorted(weights.items()):
        value = F.when(F.col(column) == name, weight).otherwise(value)
    return value.cast("long")


def word_count() -> Column:
    """Tokens of `text`: its words."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def tokens(docs: DataFrame, recipe: Recipe) -> DataFrame:
    """`doc_id`, leaf and `n_tokens` (words) of every document."""
    return docs.select(
        "doc_id",
        F.expr(recipe.domain_of).alias("domain"),
        F.coalesce("lang", F.lit("unknown")).alias("lang"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        word_count().alias("n_tokens"),
    )


def _fill(nodes: DataFrame, parents: list[str], child: str, weight: str, cap: str, budget: str, out: str) -> DataFrame:
    """Split `budget` among the children of each parent, none above its `cap`."""
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ranked = family.orderBy("_ratio", child)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    onward = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum(weight).over(onward)
    return (
        nodes.where(F.col(weight) > 0)
        .withColumn("_ratio", F.col(cap) / F.col(weight))
        .withColumn("_level", level)
        # the level rises while children are sated and falls after the first that is not
        .withColumn("_level", F.max("_level").over(family))
        .withColumn(
            out,
            F.when(F.col("_ratio") <= F.col("_level"), F.col(cap))
            .otherwise(F.least(F.col(cap), F.floor(F.col("_level") * F.col(weight))))
            .cast("long"),
        )
        .drop("_ratio", "_level")
    )


def allocate(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """Leaves (`domain`, `lang`, `source`, `available` tokens) with their token `quota`."""
    weighed = leaves.select(
        *LEAF,
        "available",
        _weight("domain", recipe.domains, 0).alias("w_domain"),
        _weight("lang", recipe.languages, recipe.other_language).alias("w_lang"),
        _weight("source", recipe.sources, recipe.other_source).alias("w_source"),
    ).withColumn("cap", F.col("available") * recipe.max_epochs)
    weighed = weighed.where("w_domain > 0 AND w_lang > 0 AND w_source > 0 AND cap > 0")
    langs = weighed.groupBy("domain", "lang", "w_domain", "w_lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain", "w_domain").agg(F.sum("cap").alias("cap"))
    part, whole = recipe.share
    # one number
    total = leaves.agg(F.floor(F.coalesce(F.sum("available"), F.lit(0)) * part / whole).cast("long")).first()[0]
    domains = domains.withColumn("total", F.lit(total).cast("long"))
    domains = _fill(domains, [], "domain", "w_domain", "cap", "total", "domain_quota")
    langs = langs.join(domains.select("domain", "domain_quota"), "domain")
    langs = _fill(langs, ["domain"], "lang", "w_lang", "cap", "domain_quota", "lang_quota")
    out = weighed.join(langs.select("domain", "lang", "lang_quota"), ["domain", "lang"])
    return _fill(out, ["domain", "lang"], "source", "w_source", "cap", "lang_quota", "quota").select(
        *LEAF, "available", "quota"
    )


def _hash(seed: int, epoch: Column) -> Column:
    key = F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.md5(key.cast("binary"))


def mix(docs: DataFrame, recipe: Recipe = RECIPE) -> DataFrame:
    """One row per document and epoch in which it is read: `doc_id`, the leaf, `epoch`,
    `n_tokens`, and `take_tokens`, which is smaller only where a quota ends inside a text."""
    spark = docs.sparkSession
    path = scratch_path(spark, "mixture")
    tokens(docs, recipe).write.parquet(path)  # whole texts are read once
    rows = spark.read.parquet(path).where("n_tokens > 0")

    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("available"))
    quotas = allocate(leaves, recipe).where("quota > 0")
    quotas = quotas.select(
        *LEAF,
        F.floor(F.col("quota") / F.col("available")).cast("int").alias("full"),
        (F.col("quota") % F.col("available")).alias("rest"),
    )
    quota_path = scratch_path(spark, "quotas")
    quotas.write.parquet(quota_path)
    quotas = spark.read.parquet(quota_path)
    if quotas.count() <= LEAVES_BROADCAST:
        quotas = F.broadcast(quotas)

    placed = rows.join(quotas, LEAF)
    whole = placed.where("full > 0").select(
        "doc_id", *LEAF, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"),
        "n_tokens", F.col("n_tokens").alias("take_tokens"),
    )
    rest = placed.where("rest > 0").withColumn("_h", _hash(recipe.seed, F.col("full")))
    rest = rest.withColumn("_bucket", F.substring("_h", 1, 3))
    sums = rest.groupBy(*LEAF, "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    earlier = Window.partitionBy(*LEAF).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    rest = rest.join(sums, [*LEAF, "_bucket"]).where("_before < rest")
    done = rest.where("_before + _sum <= rest").withColumn("take_tokens", F.col("n_tokens"))
    inside = Window.partitionBy(*LEAF, "_bucket").orderBy("_h", "doc_id", "n_tokens")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    ending = (
        rest.where("_before + _sum > rest")
        .withColumn("_before", F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .where("_before < rest")
        .withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("_before")))
    )
    columns = ["doc_id", *LEAF, F.col("full").alias("epoch"), "n_tokens", "take_tokens"]
    return whole.unionByName(done.select(*columns)).unionByName(ending.select(*columns))
