"""Global positions and running sums without a one-task window.

Rows are range-partitioned by their order and checkpointed, so that partition numbers stay
fixed even if executors are lost. Each partition contributes one total; only those totals
(one row per partition) meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.session import cut

_ROW_MASK = (1 << 33) - 1  # low bits of monotonically_increasing_id


def _sorted(df: DataFrame, order: list) -> DataFrame:
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order))


def dense_positions(df: DataFrame, order: list[str | Column], out: str = "position") -> DataFrame:
    """Add the dense 0-based position of every row under `order` (which must be total)."""
    tagged = _sorted(df, order).withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_part", F.shiftrightunsigned("_mid", 33))
    # one row per partition: small whatever the data
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_mid").bitwiseAND(F.lit(_ROW_MASK)))
        .drop("_part", "_mid", "_offset")
    )


def running_before(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    value: str | None = None,
    out: str = "before",
) -> DataFrame:
    """Sum of `value` (or the row count) over the earlier rows of the same group.

    A group may span any number of partitions: the running sum is taken per partition, and
    the one group a partition can inherit from its predecessors gets an offset.
    """
    amount = F.col(value) if value else F.lit(1)
    sort = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    tagged = _sorted(df, sort).withColumn("_part", F.spark_partition_id())
    tagged = tagged.withColumn("_amount", amount.cast("long"))

    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_part", *group)
        .agg(F.sum("_amount").alias("_subtotal"))
        .withColumn("_offset", F.sum("_subtotal").over(earlier))
        # a partition continues at most one group, so this keeps at most one row per partition
        .where(F.col("_offset").isNotNull())
        # null is a group like any other
        .select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_offset")
    )
    local = (
        Window.partitionBy("_part", *group)
        .orderBy(*[F.col(o) if isinstance(o, str) else o for o in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        tagged.withColumn("_local", F.coalesce(F.sum("_amount").over(local), F.lit(0)))
        .join(F.broadcast(offsets), same, "left")
        .withColumn(out, F.col("_local") + F.coalesce("_offset", F.lit(0)))
        .drop("_part", "_amount", "_local", "_offset", "_p", *[f"_g{i}" for i in range(len(group))])
    )
