"""SimHash near-duplicates of whole documents by deletion-variant signatures.

A document's fingerprint has the majority bits of the 64-bit hashes of its word shingles, repeats
included. Fingerprints link at DISTANCE or fewer differing bits. Cut into SEGMENTS pieces, two
such fingerprints have a piece that differs in at most one bit, since DISTANCE < 2 * SEGMENTS. So
each piece is indexed once for every bit of it, with that bit left out: two pieces that differ in
that bit alone, or not at all, have an index key in common. Fewer pieces than exact matching needs
(DISTANCE + 1) make longer keys and smaller buckets. Every candidate is verified by counting bits.

Only distinct fingerprints are indexed: copies are one row. Of a bucket of two or three the
members follow from its count, least, greatest and exclusive-or, in one aggregation inside the
JVM. Larger ones are dealt to blocks of BLOCK members, and a task compares two blocks and returns
a spanning forest of the links, no more rows than members: exact, and no bucket is in one place.

Defined cases: a text without words (or null) has fingerprint zero and is linked like any other;
one of fewer words than SHINGLE is one shingle; rows of one id with several fingerprints tie their
classes together; a null id takes part but is no component's name, unless it is alone, when that
is null; a very long text is a slice of its own, its bit counts added up in bounded pieces; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.arrays import LOWER, SPACE, Words, buffer, map_slices, tuned
from quaestor.llm.graph import components, stored
from quaestor.llm.similar import bounded

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = 3
PIECE = 1 << 15  # shingles whose bits are counted at a time
BLOCK = 4_096  # members of a block


def _spaced(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text joined by single spaces, with where each starts and ends."""
    kept = ~SPACE[data]
    apart = words.starts > 0
    apart[apart] = SPACE[data[words.starts[apart] - 1]]
    kept[words.starts[apart] - 1] = True
    out = data[kept]
    ends = np.cumsum(words.ends - words.starts + apart)
    starts = ends - (words.ends - words.starts)
    out[starts[apart] - 1] = 32
    return out, starts, ends


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Bits set in over half of the hashes of each text's shingles; zero for a text without any."""
    data, offsets = buffer(texts)
    data = LOWER[data]
    words = Words(data, offsets)
    n = np.where(words.counts >= SHINGLE, words.counts - SHINGLE + 1, np.minimum(words.counts, 1))
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    joined, starts, ends = _spaced(data, words)
    view, of = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    counts = np.zeros((len(n), 64), np.int64)
    for low in range(0, int(first[-1]), PIECE):
        high = min(low + PIECE, int(first[-1]))
        a, b = np.searchsorted(first, low, "right") - 1, np.searchsorted(first, high, "left")
        owner = np.searchsorted(first, np.arange(low, high), "right") - 1
        at = np.arange(low, high) - first[owner] + words.first[owner]
        last = at + np.minimum(words.counts[owner], SHINGLE) - 1
        hashed = (of(view[x:y], SEED) for x, y in zip(starts[at].tolist(), ends[last].tolist()))
        values = np.fromiter(hashed, np.dtype("<u8"), high - low)
        bits = np.unpackbits(values.view(np.uint8), bitorder="little").reshape(-1, 64)
        cuts = np.maximum(first[a:b] - low, 0)
        full = np.diff(np.append(cuts, high - low)) > 0
        counts[a:b][full] += np.add.reduceat(bits, cuts[full], axis=0, dtype=np.int64)
    most = counts * 2 > n[:, None]
    return np.packbits(most, axis=1, bitorder="little").reshape(-1).view("<u8")


def _sign(part: pa.RecordBatch) -> dict:
    return {"doc_id": part.column("doc_id"), "fp": pa.array(fingerprints(part.column("text")).view(np.int64))}


def segments() -> list[tuple[int, int]]:
    """Lowest bit and width of every piece."""
    cuts = [64 * k // SEGMENTS for k in range(SEGMENTS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fp: Column) -> Column:
    """Index keys of a fingerprint: each piece without each one of its bits."""
    keys = []
    for low, width in segments():
        piece = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            # the number of the bit is part of the key: 6 bits above the piece's
            keys.append(piece.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit))) + F.lit((low + bit) << width))
    return F.array(*keys)


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def spanning(left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block, or between two. Every member that was
    reached looks once through those that were not."""
    out: list[tuple[int, int]] = []
    open_ = [left] if right is None else [left, right]
    while all(len(side) for side in open_):
        front = [(open_[0][0], 0)]
        open_[0] = open_[0][1:]
        while front:
            one, side = front.pop()
            there = (side + 1) % len(open_)
            hit = np.bitwise_count(open_[there] ^ one) <= DISTANCE
            if hit.any():
                out += [(int(one), int(other)) for other in open_[there][hit]]
                front += [(other, there) for other in open_[there][hit]]
                open_[there] = open_[there][~hit]
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the buckets of a partition that is sorted by key; none is larger than BLOCK."""
    keys, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if b - a > 1:
                out += spanning(ids[a:b])
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        ids = np.concatenate([ids, batch.column("fp").to_numpy()])
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
        yield links(keys[:whole], ids[:whole])
        keys, ids = keys[whole:], ids[whole:]
    yield links(keys, ids)


def _between(table: pa.Table) -> pa.Table:
    """Links of one block, or between two, of a large bucket."""
    p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
    own, ids = table.column("own").to_numpy(), table.column("fp").to_numpy()
    found = spanning(ids) if p == q else spanning(ids[own == p], ids[own == q])
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def links(prints: DataFrame) -> DataFrame:
    """Links (`a`, `b`) that connect all of the distinct fingerprints `fp` within DISTANCE."""
    index = prints.select("fp", F.explode(variants(F.col("fp"))).alias("key"))
    shared = stored(
        index.groupBy("key")
        .agg(F.count("*").alias("members"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor("fp").alias("x"))
        .where("members > 1")
        .where((F.col("members") > 2) | near(F.col("lo"), F.col("hi"))),
        "keys",
    )
    third = F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    two = shared.where("members = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    three = shared.where("members = 3").select(F.inline(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in ((F.col("lo"), F.col("hi")), (F.col("lo"), third), (third, F.col("hi")))])))
    few = two.unionByName(three.where(near(F.col("a"), F.col("b"))))

    wide = bounded(stored(shared.where("members > 3").select("key", "members"), "wide"))
    company = index.join(wide, "key")
    middling = company.where(F.col("members") <= BLOCK).select("key", "fp").repartition("key").sortWithinPartitions("key")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    large = company.where(F.col("members") > BLOCK).select("key", "fp", blocks.alias("blocks"))
    large = large.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp")
    found = few.unionByName(tuned(middling).mapInArrow(_runs, "a long, b long"))
    return found.unionByName(dealt.groupBy("key", "p", "q").applyInArrow(_between, "a long, b long"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """`doc_id` and the 64-bit `fp` of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", "text"), _sign, f"doc_id {kind}, fp long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id`, `fingerprint` (hexadecimal), `component_id` (least id reachable) of every row."""
    signed = stored(fingerprint(docs), "fingerprints")
    # combined in each task first: copies, however many, are one row
    prints = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    found = links(prints.select("fp"))
    # an id with several fingerprints joins them; min and max differ for none but repeated ids
    several = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("_top"))
    several = several.where("a <> _top").select("doc_id", "a")
    ties = signed.join(several, "doc_id").select("a", F.col("fp").alias("b")).where("a <> b").distinct()
    of = stored(components(found.unionByName(ties)), "components")
    classes = prints.join(of.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    names = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classes.select("fp", "class").join(names, "class").select(F.col("fp").alias("_fp"), "component_id")
    rows = signed.join(named, F.col("fp") == F.col("_fp"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
