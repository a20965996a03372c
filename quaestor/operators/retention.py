"""Expiry, hit/miss labelling and size retention over tables of cached entries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators.blocks import plain
from quaestor.operators.ordering import running_before
from quaestor.session import cut

DAY_SECONDS = 24 * 3600
KEEP_SHARE = 0.8  # fixed value: retention shrinks to this share of the limit
HOT_KEY_TIMES = 1_000_000  # distinct access times one group may hold
BROADCAST_NUMBERS = 1_000_000
MAX_QUANTILES = 5_000
BUCKET_TIMES = 250_000  # access times of hot keys in a bucket, about


def expired(entries: DataFrame, now: Column, ttl_seconds: int = DAY_SECONDS) -> DataFrame:
    """Entries strictly older than the time to live."""
    return entries.where(_micros(now) - _micros(F.col("created_at")) > ttl_seconds * 1_000_000)


def unexpired(entries: DataFrame, now: Column, ttl_seconds: int = DAY_SECONDS) -> DataFrame:
    return entries.where(_micros(now) - _micros(F.col("created_at")) <= ttl_seconds * 1_000_000)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def evict(
    entries: DataFrame, limit_bytes: int, namespace: str = "namespace", key: str = "key"
) -> DataFrame:
    """Entries to remove, least recently and least often used first, per namespace.

    An entry goes while what is left before it exceeds 80 % of the limit; namespaces within
    the limit lose nothing. The running sum is distributed even inside one huge namespace.
    """
    totals = entries.groupBy(namespace).agg(F.sum("size_bytes").alias("_total"))
    over = totals.where(F.col("_total") > limit_bytes)
    over = over.withColumnRenamed(namespace, "_namespace")
    affected = entries.join(over, F.col(namespace).eqNullSafe(F.col("_namespace"))).drop("_namespace")
    ranked = running_before(
        affected, [namespace], ["accessed_at", "access_count", key], "size_bytes", "_removed"
    )
    return ranked.where(
        F.col("_total") - F.col("_removed") > F.lit(limit_bytes * KEEP_SHARE)
    ).drop("_total", "_removed")


# --- hit / miss labelling -----------------------------------------------------------------
#
# A miss creates the entry; later accesses hit until one comes more than `ttl` after the
# creation. Only distinct access times matter, and the walk over them is sequential per key.
# Ordinary keys are walked whole. A hot key is cut into phases: slot s holds the times whose
# offset inside their ttl-long period falls between two bounds. "created + ttl" lies one
# period on at the same offset, so a walk stays in its slot until it finds no later time
# there; it then goes on at the first time of the next non-empty part. Those first times
# (heads) form a short chain per key, solved separately.


def label_accesses(
    accesses: DataFrame,
    ttl_seconds: int = DAY_SECONDS,
    key: str = "key",
    ts: str = "ts",
    tie: str = "event_id",
    hot_key_times: int = HOT_KEY_TIMES,
) -> DataFrame:
    """Add `hit` (boolean) to every access; equal times are ordered by `tie`."""
    stamped = accesses.withColumn("_t", _micros(F.col(ts)))
    times = cut(stamped.groupBy(key, "_t").agg(F.min(tie).alias("_first")))
    created = miss_times(times.select(key, "_t"), ttl_seconds, key, hot_key_times)
    # the row that creates: the first of its (key, time); both joins are on nearly unique keys
    creators = times.join(created, [key, "_t"], "left_semi").select(
        key, "_t", F.col("_first").alias(tie), F.lit(False).alias("hit")
    )
    return (
        stamped.join(creators, [key, "_t", tie], "left")
        .withColumn("hit", F.coalesce("hit", F.lit(True)))
        .drop("_t")
    )


def miss_times(
    times: DataFrame, ttl_seconds: int, key: str = "key", hot_key_times: int = HOT_KEY_TIMES
) -> DataFrame:
    """Creation times (key, _t) out of distinct access times (key, _t in microseconds)."""
    ttl = ttl_seconds * 1_000_000
    hot = (
        times.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > hot_key_times)
        .select(key, F.ceil(F.col("_n") / hot_key_times).cast("long").alias("_slots"))
        .persist()
    )
    n_hot, most_slots, all_slots = hot.agg(F.count("*"), F.max("_slots"), F.sum("_slots")).first()
    if n_hot == 0:
        return _walk_keys(times, ttl, key)
    # each hot key carries its slot bounds
    small = n_hot * most_slots <= BROADCAST_NUMBERS
    if small:
        hot = F.broadcast(hot)
    ordinary = _walk_keys(times.join(hot, key, "left_anti"), ttl, key)
    return ordinary.unionByName(
        _hot_miss_times(
            times.join(hot, key), ttl, key, min(most_slots, MAX_QUANTILES), small, all_slots * hot_key_times
        )
    )


def _walk_keys(times: DataFrame, ttl: int, key: str) -> DataFrame:
    """Walk each key's times in order; at most `hot_key_times` numbers meet in a row."""

    def step(found, t):
        due = F.coalesce(F.element_at(found, -1) + F.lit(ttl) < t, F.lit(True))
        return F.when(F.size(found) == 0, F.array(t)).when(due, F.concat(found, F.array(t))).otherwise(found)

    walked = times.groupBy(key).agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    return walked.select(
        key, F.explode(F.aggregate("_ts", F.array().cast("array<bigint>"), step)).alias("_t")
    )


def _hot_miss_times(
    times: DataFrame, ttl: int, key: str, quantiles: int, small: bool, most_times: int
) -> DataFrame:
    period = F.floor(F.col("_t") / F.lit(ttl)).cast("long")
    placed = times.select(
        key, "_t", period.alias("_period"), (F.col("_t") - period * F.lit(ttl)).alias("_offset"), "_slots"
    )
    # slots of equal size, however the accesses crowd within the period: the bounds of a key
    # with n slots are n - 1 of the quantiles of its offsets
    shares = [n / quantiles for n in range(1, quantiles)]
    last = F.lit(quantiles - 1).cast("long")

    def bound(n):
        at = F.floor(n * quantiles / F.col("_n_slots")).cast("long")
        return F.get("_q", (F.least(F.greatest(at, F.lit(1)), last) - 1).cast("int"))

    bounds = (
        placed.groupBy(key)
        .agg(
            F.percentile_approx("_offset", shares, 10_000).alias("_q"),
            F.max("_slots").alias("_n_slots"),
        )
        .select(
            key,
            F.transform(
                F.sequence(F.lit(1).cast("long"), F.col("_n_slots") - 1), bound
            ).alias("_bounds"),
        )
    )
    if small:
        bounds = F.broadcast(bounds)
    slotted = placed.join(bounds, key).select(
        key,
        "_t",
        "_period",
        F.size(F.filter("_bounds", lambda c: c <= F.col("_offset"))).cast("long").alias("_slot"),
        "_slots",
    )
    # part number grows with time, so parts of one key are ordered by it
    slotted = slotted.withColumn("_part", F.col("_period") * F.col("_slots") + F.col("_slot"))
    key_type = times.schema[key].dataType.simpleString()
    # a task takes a bucket of keys, or of their slots, at once: slots may be many and small
    buckets = max(1, math.ceil(most_times / BUCKET_TIMES))
    of = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(buckets)).alias("_bucket")
    slotted = slotted.select("*", of(key, "_slot"))

    hops = slotted.groupBy("_bucket").applyInPandas(
        lambda pdf: _slot_hops(pdf, ttl, key),
        f"{key} {key_type}, _slot long, _head_part long, _exit_part long",
    )
    visited = hops.select("*", of(key)).groupBy("_bucket").applyInPandas(
        lambda pdf: _chain_heads(pdf, key), f"{key} {key_type}, _slot long, _head_part long"
    )
    return (
        slotted.groupBy("_bucket")
        .cogroup(visited.select("*", of(key, "_slot")).groupBy("_bucket"))
        .applyInPandas(
            lambda rows, heads: _slot_walks(rows, heads, ttl, key), f"{key} {key_type}, _t long"
        )
    )


def _after(group: np.ndarray, value: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each row, the first row of its group with a value above its bound, or -1. Rows are
    ordered by group and value."""
    n = len(value)
    whose, is_bound = np.concatenate([group, group]), np.repeat([False, True], n)
    order = np.lexsort((is_bound, np.concatenate([value, bound]), whose))
    at = np.empty(n, np.int64)
    ordered = is_bound[order]
    at[order[ordered] - n] = np.cumsum(~ordered)[ordered]  # rows up to the bound
    found = at < n
    found[found] = group[at[found]] == group[found]
    return np.where(found, at, -1)


def _reached(start: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """All rows on the walks from `start`."""
    steps = [np.asarray(start, np.int64)]
    while len(steps[-1]):
        to = nxt[steps[-1]]
        steps.append(to[to >= 0])
    return np.concatenate(steps)


def _grouped(pdf: pd.DataFrame, by: list[str], value: str) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows ordered by group and value, and their group's number; null is a key like any other."""
    group = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    order = np.lexsort((pdf[value].to_numpy(), group))
    return pdf.iloc[order], group[order]


def _slot_steps(pdf: pd.DataFrame, ttl: int, key: str):
    """Rows by slot and time, their slot's number, parts, the part after which each walk that stays
    no longer leaves, and each time's next creation in its slot."""
    pdf, group = _grouped(pdf, [key, "_slot"], "_t")
    t, part = pdf["_t"].to_numpy(), pdf["_part"].to_numpy()
    due = part + pdf["_slots"].to_numpy()  # the part that holds "created + ttl"
    nxt = _after(group, t, t + ttl)
    return pdf, group, part, due, np.where((nxt >= 0) & (part[nxt] == due), nxt, -1)


def _slot_hops(pdf: pd.DataFrame, ttl: int, key: str) -> pd.DataFrame:
    """For the first time of every part: the part after which its walk leaves the slot."""
    pdf, group, part, leave, nxt = _slot_steps(pdf, ttl, key)
    # the end of every walk, by pointers that double their reach
    end = np.where(nxt >= 0, nxt, np.arange(len(nxt)))
    while not np.array_equal(further := end[end], end):
        end = further
    heads = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (group[1:] != group[:-1])])
    rows = pdf.iloc[heads]
    return plain(
        pd.DataFrame(
            {
                key: rows[key].to_numpy(),
                "_slot": rows["_slot"].to_numpy(),
                "_head_part": part[heads],
                "_exit_part": leave[end[heads]],
            }
        )
    )


def _chain_heads(pdf: pd.DataFrame, key: str) -> pd.DataFrame:
    pdf, group = _grouped(pdf, [key], "_head_part")
    nxt = _after(group, pdf["_head_part"].to_numpy(), pdf["_exit_part"].to_numpy())
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return plain(pdf.iloc[_reached(first, nxt)][[key, "_slot", "_head_part"]])


def _slot_walks(rows: pd.DataFrame, heads: pd.DataFrame, ttl: int, key: str) -> pd.DataFrame:
    if rows.empty or heads.empty:
        return plain(pd.DataFrame({key: [], "_t": np.array([], dtype=np.int64)}))
    # a part belongs to one slot of a key, and its head is its first time
    started = pd.MultiIndex.from_frame(heads[[key, "_head_part"]])
    rows, group, part, _, nxt = _slot_steps(rows, ttl, key)
    first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (group[1:] != group[:-1])])
    first = first[pd.MultiIndex.from_frame(rows.iloc[first][[key, "_part"]]).isin(started)]
    picked = rows.iloc[_reached(first, nxt)]
    return plain(pd.DataFrame({key: picked[key].to_numpy(), "_t": picked["_t"].to_numpy()}))
