"""Verified links between the members of hash buckets, for sets of 64-bit shingles.

Buckets come from MinHash tables: (`key`, `id`, `n`), n being about the set's size. Members of
a bucket are compared on their full sets, exactly, and nothing is sampled:

* of a bucket of two or three, the ids follow from its count, least, greatest and exclusive-or,
  which one aggregation gives; most buckets are such, and their rows never move again;
* a bucket of up to SMALL members gives its pairs, at most SMALL / 2 for each row;
* a larger one gives none. Its members are dealt to blocks of bounded bytes, one task group
  compares two blocks by counting common shingles in a sparse matrix, and returns a spanning
  forest of the links it found: as many rows as members at most, and the same components.
  First all blocks are compared with one block of pivots. What the links so far leave outside the
  bucket's largest component is then compared with every member; pairs inside one component
  would add nothing. A group of near copies so costs its members times two, not squared, and
  only a bucket of many texts that are not linked at all is compared pair by pair.

Equal large buckets, which copies of one template make in many tables, are compared once.

What a set is made from travels as a `payload`: the set itself, or a shorter text that `decode`
turns into the set inside the comparing task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm.arrays import slices, tuned
from quaestor.llm.graph import components, local_stars, stored

SMALL = 12
BLOCK_MEMBERS = 512
BLOCK_ITEMS = 400_000  # shingles in a block, about
BROADCAST_BYTES = 48 << 20
ROW_BYTES = 48  # of a broadcast row besides its values
COLUMNS = 4_096  # of the matrix at a time
PARTS = 16  # of shared keys, before they are split or joined by size
PAIR_BYTES = 256 << 10  # payloads of the pairs decoded at a time

Decode = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def lists_of(payload: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Decode of payloads that are the sorted sets themselves."""
    offsets = payload.offsets.to_numpy()
    return payload.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _weight(kind: T.DataType, value: Column) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((_weight(f.dataType, value[f.name]) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        sizes = F.aggregate(value, F.lit(24).cast("long"), lambda total, x: total + _weight(kind.elementType, x))
        return F.coalesce(sizes, F.lit(24).cast("long"))
    return F.lit(16 if isinstance(kind, T.DecimalType) else 8).cast("long")


def bounded(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A stored table, to be broadcast if its values take at most `limit` (BROADCAST_BYTES) bytes."""
    row = sum((_weight(f.dataType, F.col(f.name)) for f in df.schema.fields), F.lit(ROW_BYTES).cast("long"))
    size = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if size <= (BROADCAST_BYTES if limit is None else limit) else df


def split_buckets(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (`a`, `b`) of the buckets of two and three, which may repeat, and the rows of larger ones
    with the bucket's size `members` and `items`."""
    # sums, since an id with several sets may be in a bucket more than once
    mark = lambda shift: F.sum(F.shiftrightunsigned(F.xxhash64("id"), shift).bitwiseAND(F.lit(0x7FFFFFFF)))
    # counted in each task first, so a bucket with any share of the rows is one row per task
    shared = stored(
        buckets.groupBy("key")
        .agg(
            F.count("*").alias("members"), F.sum("n").alias("items"), F.min("id").alias("lo"), F.max("id").alias("hi"),
            F.bit_xor("id").alias("x"), mark(0).alias("f"), mark(32).alias("g"),
        )
        .where("members > 1")
        # few of the keys are left, which would be a file of every task; large ones of these parts are split
        .hint("rebalance", PARTS, "key"),
        "keys",
    )
    third = F.expr("x ^ lo ^ hi")
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    lo, hi = F.col("lo"), F.col("hi")
    few = shared.where("members <= 3").select(
        F.inline(F.when(F.col("members") == 2, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, hi), pair(lo, third), pair(third, hi))))
    )
    # of equal buckets one goes on
    wide = shared.where("members > 3").groupBy("members", "items", "lo", "hi", "x", "f", "g").agg(F.min("key").alias("key"))
    wide = bounded(stored(wide.select("key", "members", "items"), "wide"))
    return few.where("a <> b"), stored(buckets.join(wide, "key"), "buckets")


def small_pairs(company: DataFrame) -> DataFrame:
    """Pairs (`a` < `b`) of the buckets up to SMALL, which may repeat."""
    rows = company.where(F.col("members") <= SMALL)
    groups = rows.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("m"))
    x = groups.select("m", F.posexplode_outer("m").alias("i", "x"))
    y = x.select(F.col("x").alias("a"), F.explode_outer(F.slice("m", F.col("i") + 2, F.lit(SMALL))).alias("b"))
    return y.where("a <> b")


def overlaps(values: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the common parts of the sorted sets left[k] and right[k], for all k at once."""
    if len(left) <= 1:  # a very long pair is alone
        sets_ = [values[first[k] : first[k + 1]] for k in (*left, *right)]
        return np.array([len(np.intersect1d(*sets_, assume_unique=True))] if len(sets_) else [], np.int64)
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    distinct = int(ranks.max(initial=0)) + 1

    def laid_out(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen sets one after the other, their numbers growing throughout."""
        sizes = first[which + 1] - first[which]
        owner = np.repeat(np.arange(len(which)), sizes)
        at = np.arange(len(owner)) + np.repeat(first[which] - (np.cumsum(sizes) - sizes), sizes)
        return owner * distinct + ranks[at], owner

    (xs, _), (ys, owner) = laid_out(left), laid_out(right)
    if not len(xs):
        return np.zeros(len(left), np.int64)
    hit = xs[np.minimum(np.searchsorted(xs, ys), len(xs) - 1)] == ys
    return np.bincount(owner[hit], minlength=len(left))


def verified(pairs: DataFrame, payloads: DataFrame, percent: int, decode: Decode | None) -> DataFrame:
    """Pairs of sets with 100 * common >= percent * union."""
    left = payloads.select(F.col("id").alias("a"), F.col("payload").alias("xs"))
    right = payloads.select(F.col("id").alias("b"), F.col("payload").alias("ys"))
    joined = pairs.join(left, "a").join(right, "b")
    if decode is None:
        sizes = joined.select("a", "b", "xs", "ys", F.size("xs").alias("na"), F.size("ys").alias("nb"))
        fit = sizes.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        counted = fit.select("a", "b", "na", "nb", F.size(F.array_intersect("xs", "ys")).alias("both"))
        return counted.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def check(batches):
        for part in (p for batch in batches for p in slices(batch, "xs", "ys", limit=PAIR_BYTES)):
            # a payload that meets many others is decoded once
            coded = pa.concat_arrays([part.column("xs"), part.column("ys")]).dictionary_encode()
            values, first = decode(coded.dictionary)
            x, y = coded.indices.to_numpy().astype(np.int64).reshape(2, part.num_rows)
            size = np.diff(first)
            fit = np.flatnonzero(100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
            x, y = x[fit], y[fit]
            both = overlaps(values, first, x, y)
            keep = fit[100 * both >= percent * (size[x] + size[y] - both)]
            yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return tuned(joined.select("a", "b", "xs", "ys")).mapInArrow(check, f"a {kind}, b {kind}")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of two lists of sets, as a matrix."""
    out = np.zeros((len(left), len(right)), np.float32)
    xs, ys = np.concatenate(left), np.concatenate(right)
    row = np.repeat(np.arange(len(left)), [len(s) for s in left])
    col = np.repeat(np.arange(len(right)), [len(s) for s in right])
    shared = np.intersect1d(xs, ys)
    i, j = np.searchsorted(shared, xs), np.searchsorted(shared, ys)
    in_x = np.flatnonzero((i < len(shared)) & (shared[np.minimum(i, len(shared) - 1)] == xs)) if len(shared) else []
    in_y = np.flatnonzero((j < len(shared)) & (shared[np.minimum(j, len(shared) - 1)] == ys)) if len(shared) else []
    for lo in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - lo)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        p = in_x[(i[in_x] >= lo) & (i[in_x] < lo + width)]
        q = in_y[(j[in_y] >= lo) & (j[in_y] < lo + width)]
        a[row[p], i[p] - lo] = 1
        b[col[q], j[q] - lo] = 1
        out += a @ b.T
    return out


def forest(ids: list, at: np.ndarray, to: np.ndarray) -> list[tuple]:
    """The links that join what earlier ones have not, by position in `ids`."""
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for p, q in zip(at.tolist(), to.tolist()):
        rp, rq = root(p), root(q)
        if rp != rq:
            parent[rp] = rq
            out.append((ids[p], ids[q]))
    return out


def _compared(dealt: DataFrame, payloads: DataFrame, percent: int, decode: Decode | None) -> DataFrame:
    """Spanning links of every group (`key`, `p`, `q`) of `dealt`: between its rows of side 0 and
    of side 1; a row of side 2 is on both."""
    kind = dealt.schema["id"].dataType.simpleString()
    sets_in = decode or lists_of

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        ids = table.column("id").to_pylist()
        mine, theirs = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        found: list[tuple] = []
        if len(mine) and len(theirs):
            values, first = sets_in(table.column("payload").chunk(0))
            sets_ = [values[a:b] for a, b in zip(first[:-1], first[1:])]
            both = common([sets_[i] for i in mine], [sets_[i] for i in theirs])
            sizes = np.array([len(s) for s in sets_], np.float64)
            union = sizes[mine][:, None] + sizes[theirs][None, :] - both
            r, c = np.nonzero(100 * both.astype(np.float64) >= percent * union)
            found = forest(ids, mine[r], theirs[c])
        kept = table.schema.field("id").type
        return pa.table({"a": pa.array([x for x, _ in found], kept), "b": pa.array([y for _, y in found], kept)})

    dealt = dealt.select("key", "p", "q", "side", "id").join(payloads.select("id", "payload"), "id")
    return tuned(dealt).groupBy("key", "p", "q").applyInArrow(compare, f"a {kind}, b {kind}")


def _blocks(members: Column, items: Column) -> Column:
    return F.greatest(F.ceil(members / BLOCK_MEMBERS), F.ceil(items / BLOCK_ITEMS)).cast("int")


def _numbers(n: str) -> Column:
    return F.sequence(F.lit(0), F.col(n) - 1)


def large_links(
    company: DataFrame, payloads: DataFrame, percent: int, decode: Decode | None, known: DataFrame
) -> DataFrame:
    """Links (100 * common >= percent * union) that together with `known` span the components of
    the buckets above SMALL."""
    # an id with several sets may be in a bucket more than once; `split_buckets` has left one of equal buckets
    rows = company.where(F.col("members") > SMALL).dropDuplicates(["key", "id"])
    rows = rows.select("key", "id", "n", _blocks(F.col("members"), F.col("items")).alias("blocks"))
    rows = stored(rows.withColumn("own", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int")), "large")
    # block 0 holds the pivots: it meets every block, the others meet only it
    met = rows.withColumn("other", F.explode(F.when(F.col("own") == 0, _numbers("blocks")).otherwise(F.array(F.lit(0)))))
    side = F.when((F.col("own") == 0) & (F.col("other") == 0), 2).when(F.col("own") == 0, 0).otherwise(1)
    dealt = met.select("key", F.lit(0).alias("p"), F.greatest("own", "other").alias("q"), side.alias("side"), "id")
    found = stored(_compared(dealt, payloads, percent, decode), "pivots")
    cut = rows.where("blocks > 1")
    if cut.isEmpty():
        return found
    joined = components(found.unionByName(known))
    placed = cut.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    rest = stored(placed.join(main, "key").where("component <> main").select("key", "id", "n", "blocks"), "rest")
    parts = rest.groupBy("key").agg(_blocks(F.count("*"), F.sum("n")).alias("parts"))
    left = rest.join(parts, "key").select(
        "key", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int").alias("p"),
        F.explode(_numbers("blocks")).alias("q"), F.lit(0).alias("side"), "id",
    )
    right = cut.join(parts, "key").select(
        "key", F.explode(_numbers("parts")).alias("p"), F.col("own").alias("q"), F.lit(1).alias("side"), "id"
    )
    return found.unionByName(_compared(left.unionByName(right), payloads, percent, decode))


def links(buckets: DataFrame, payload_of, percent: int, decode: Decode | None = None) -> DataFrame:
    """Links that span the components of all buckets, whose ids are whole numbers. What the union-find
    shuffles are stars, in which a dense group is as many links as members, not pairs.
    `payload_of(ids)` gives `id` and `payload` of the ids that share a bucket with another."""
    few, company = split_buckets(buckets)
    few = stored(few.unionByName(small_pairs(company)).distinct(), "pairs")
    ids = few.select(F.col("a").alias("id")).unionByName(few.select(F.col("b").alias("id")))
    ids = stored(ids.unionByName(company.select("id")).distinct(), "ids")
    payloads = stored(payload_of(bounded(ids)), "payloads")
    exact = stored(verified(few, payloads, percent, decode), "exact")
    found = stored(exact.unionByName(large_links(company, payloads, percent, decode, exact)), "found")
    return stored(local_stars(found), "links")
