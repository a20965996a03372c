"""Fuzzy line deduplication: one line of each group of similar lines stays in the corpus.

Lines are compared without case (A-Z) and with white space as single spaces. Equal lines are
one class. The set of a class is that of its SHINGLE-character shingles; its MinHash signature
comes from one hash per shingle, whose BANDS * ROWS bins each keep their minimum (empty bins
borrow from the next full one). Classes that agree on a band of ROWS values are candidates:
at similarity s with probability 1 - (1 - s**4)**10, which is 0.995 at 0.8 and 0.9999 at 0.9.
Candidates are verified on full sets, a distributed union-find joins the links, and of every
component the occurrence with the least (document, line) is kept.

Inside the linking a line is known by 64 bits of its 128-bit digest; among n distinct lines
about n**2 / 2**65 pairs share them and count as one line.

Defined cases: lines without a word are neither compared nor removed; null and empty texts stay
as they are; lines of fewer than SHINGLE characters are one shingle; rows that share id and
text get the same result each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm import similar
from quaestor.llm.arrays import Rolling, distinct_sorted, lists, map_slices, mix
from quaestor.llm.graph import components, stored

SHINGLE = 7
PERCENT = 80
BANDS = 10
ROWS = 4
WHITE = " \t\n\x0b\x0c\r"
_BINS = BANDS * ROWS
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def normal(line: str) -> bytes:
    """The line as it is compared: lower case (A-Z), white space collapsed."""
    raw = line.encode().lower().strip()
    # most lines have no other white space than single spaces
    if b"  " in raw or b"\t" in raw or b"\r" in raw or b"\x0b" in raw or b"\x0c" in raw:
        return b" ".join(raw.split())
    return raw


def _shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of every line, and each line's first."""
    codes = np.frombuffer((b"\n".join(lines) + b"\n").decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    rolling = Rolling(codes + np.uint64(1))
    grams = rolling.grams(SHINGLE)
    # positions whose shingle ends inside their line; a short line has its whole text instead
    inside = np.ones(len(grams) + 1, bool)
    inside[-1] = False
    for k in range(SHINGLE):
        inside[np.clip(ends - k, 0, len(grams))] = False
    short = np.flatnonzero(ends - starts < SHINGLE)
    at = np.flatnonzero(inside)
    values = np.concatenate([grams[at], rolling.ranges(starts[short], ends[short])])
    place = np.concatenate([at, starts[short]])
    order = np.argsort(place, kind="stable") if len(short) else slice(None)
    values, place = values[order], place[order]
    return values, np.append(np.searchsorted(place, starts), len(place))


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of BANDS keys."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    bins = ((values >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
    least = np.full(n * _BINS, _TOP, np.uint64)
    # inside a bin the high bits are alike and the rest decides
    np.minimum.at(least, owner * _BINS + bins, values)
    least = least.reshape(n, _BINS)
    row, col = np.nonzero(least == _TOP)
    filled = least.copy()
    for k in range(1, _BINS):
        borrowed = least[row, (col + k) % _BINS]
        full = borrowed != _TOP
        filled[row[full], col[full]] = mix(borrowed[full] + np.uint64(k))
        row, col = row[~full], col[~full]
        if not len(row):
            break
    least = filled
    parts = least.reshape(n, BANDS, ROWS)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def _lines(part: pa.RecordBatch) -> dict:
    rows, numbers, compared = [], [], []
    for i, text in enumerate(part.column("text").to_pylist()):
        for k, line in enumerate((text or "").split("\n")):
            norm = normal(line)
            if norm:
                rows.append(i), numbers.append(k), compared.append(norm)
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in compared), np.int64)
    values, first = _shingles(compared) if compared else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    keys = signatures(values, first) if compared else np.zeros((0, BANDS), np.uint64)
    at = pa.array(rows, pa.int64())
    return {
        "doc_id": part.column("doc_id").take(at),
        "t": part.column("t").take(at),
        "line": pa.array(numbers, pa.int32()),
        "id": pa.array(digests[0::2].copy()),
        "rest": pa.array(digests[1::2].copy()),
        "n": pa.array(np.diff(first).astype(np.int32)),
        "bands": lists(keys.ravel(), np.arange(0, keys.size + 1, BANDS)),
    }


def _chosen_lines(part: pa.RecordBatch) -> dict:
    ids, chosen = [], []
    for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
        lines = text.split("\n")
        for w in wanted:
            ids.append(w["id"]), chosen.append(normal(lines[w["line"]]))
    return {"id": pa.array(ids, pa.int64()), "payload": pa.array(chosen, pa.binary())}


def _decode(payload: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return distinct_sorted(*_shingles(payload.to_pylist()))


def removals(docs: DataFrame) -> DataFrame:
    """`doc_id`, `t` (hash of the text), `removed`: the lines that every document loses."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    lines = stored(
        map_slices(texts, _lines, f"doc_id {kind}, t long, line int, id long, rest long, n int, bands array<bigint>"), "lines"
    )
    place = F.struct("doc_id", "t", "line")
    heads = stored(
        lines.groupBy("id", "rest").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    buckets = heads.select(F.explode("bands").alias("key"), "id", "n")

    def lines_of(wanted: DataFrame) -> DataFrame:
        where = heads.select("id", "first").join(wanted, "id", "left_semi")
        where = where.groupBy(F.col("first.doc_id").alias("d"), F.col("first.t").alias("u")).agg(
            F.collect_list(F.struct("id", F.col("first.line").alias("line"))).alias("wanted")
        )
        where = similar.bounded(stored(where, "wanted"))
        found = texts.join(where, F.expr("doc_id <=> d AND t = u")).select("text", "wanted")
        # rows that repeat an id and text give their lines once each
        return map_slices(found, _chosen_lines, "id long, payload binary").dropDuplicates(["id"])

    joined = components(similar.links(buckets, lines_of, PERCENT, _decode))
    heads = heads.select("id", "rest", "first").join(joined, "id", "left")
    linked = heads.where("component IS NOT NULL")
    keeper = linked.groupBy("component").agg(F.min("first").alias("keeper"))
    # classes without a component stay out of the join, where null would be one hot key
    alone = heads.where("component IS NULL").select("id", "rest", F.col("first").alias("keeper"))
    heads = linked.join(keeper, "component").select("id", "rest", "keeper").unionByName(alone)
    return (
        lines.select("id", "rest", place.alias("place"))
        .join(heads, ["id", "rest"])
        .where(~F.col("place").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.t").alias("t"))
        .agg(F.collect_set("place.line").alias("removed"))
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with their columns, the text without its removed lines, and two more:
    `__n_lines` (lines with a word) and `__n_removed`."""
    gone = removals(docs).select(F.col("doc_id").alias("__d"), F.col("t").alias("__u"), "removed")
    gone = similar.bounded(stored(gone.withColumnRenamed("removed", "__removed"), "gone"))
    tagged = docs.withColumn("__t", F.xxhash64("text"))
    joined = tagged.join(gone, F.expr("doc_id <=> __d AND __t = __u"), "left").select(*docs.columns, "__removed")
    names = docs.columns

    def cut(part: pa.RecordBatch) -> dict:
        texts, counts, cuts = [], [], []
        for text, removed in zip(part.column("text").to_pylist(), part.column("__removed").to_pylist()):
            lines = (text or "").split("\n")
            counts.append(sum(1 for x in lines if x.strip(WHITE)))
            cuts.append(len(removed or ()))
            if removed:
                drop = set(removed)
                text = "\n".join(x for k, x in enumerate(lines) if k not in drop)
            texts.append(text)
        out = {c: part.column(c) for c in names}
        out["text"] = pa.array(texts, pa.string())
        return out | {"__n_lines": pa.array(counts, pa.int64()), "__n_removed": pa.array(cuts, pa.int64())}

    schema = T.StructType(
        [*docs.schema.fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_removed", T.LongType())]
    )
    return map_slices(joined, cut, schema)
