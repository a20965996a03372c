"""MinHash near-duplicates of whole documents with tensored banding.

A document's set is that of its distinct SHINGLE-word shingles. Two collections of COLLECTION
half-keys, of HALF minhashes each, are computed; a table's key is a pair of one half-key from
either collection. 2 * COLLECTION half-keys so make COLLECTION ** 2 tables: with 8 and 3, 48
minhashes do the work of 384. Two documents meet in some table if any half-key agrees in each
collection; at similarity s that has probability (1 - (1 - s**3)**8)**2, which is 0.994 at 0.8, 0.9990 at
0.85, 0.99997 at 0.9. Documents with equal sets are one class from the start, and every other
candidate is verified on full sets.

Defined cases: texts without words (or null) have no shingles and are linked with nothing;
fewer words than SHINGLE are one shingle; rows repeated under one id are one document when
their sets are equal, otherwise the id joins the classes of its sets; a null id takes part in
nothing and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm import similar
from quaestor.llm.arrays import LOWER, Words, buffer, distinct_sorted, lists, map_slices, mix, segment, shingles
from quaestor.llm.graph import components, stored

SHINGLE = 5
PERCENT = 85
COLLECTION = 8
HALF = 3
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, (2 * COLLECTION * HALF, 2), dtype=np.uint64) | np.uint64(1)


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffer(texts)
    data = LOWER[data]
    words = Words(data, offsets)
    values, first = shingles(words.hashes(data), words.first, SHINGLE)
    return distinct_sorted(values, first)


def half_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of 2 * COLLECTION half-keys, the second collection after the first."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = [segment(np.minimum, (values ^ s) * t, first, top) for s, t in _SEEDS]
    keys = np.stack(least, axis=1).reshape(len(first) - 1, 2 * COLLECTION, HALF)
    out = np.zeros(keys.shape[:2], np.uint64)
    for k in range(HALF):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + keys[:, :, k])
    return out


def _signature(part: pa.RecordBatch) -> dict:
    values, first = _sets(part.column("text"))
    raw = values.astype("<u8").tobytes()
    digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(first[:-1], first[1:])]
    halves = half_keys(values, first)
    flat = np.arange(0, halves.size + 1, 2 * COLLECTION)
    return {
        "doc_id": part.column("doc_id"),
        "n": pa.array(np.diff(first)),
        "digest": pa.array(digests, pa.binary()),
        "halves": lists(halves.ravel(), flat),
    }


def _full_sets(part: pa.RecordBatch) -> dict:
    return {"id": part.column("doc_id"), "payload": lists(*_sets(part.column("text")))}


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` (least id reachable over links, itself included)
    and `kept` (the document is that least one) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(
        map_slices(
            docs.select("doc_id", "text"), _signature, f"doc_id {kind}, n long, digest binary, halves array<bigint>"
        ),
        "signatures",
    )
    filled = signed.where("n > 0 AND doc_id IS NOT NULL")
    # one class per distinct set; ids with several sets tie their classes together
    classes = stored(filled.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    members = stored(filled.select("doc_id", "digest").join(classes, "digest").select("doc_id", "digest", "id"), "members")
    heads = filled.join(classes.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("id")))
    # rows repeated under one id with one set are one head
    heads = heads.dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("id"), "n", "halves")
    tables = F.explode(
        F.array(
            *[
                F.xxhash64(F.lit(i * COLLECTION + j), F.get("halves", F.lit(i)), F.get("halves", F.lit(COLLECTION + j)))
                for i in range(COLLECTION)
                for j in range(COLLECTION)
            ]
        )
    )
    buckets = heads.select("id", "n", tables.alias("key")).select("key", "id", "n")

    def sets_of(wanted: DataFrame) -> DataFrame:
        rows = docs.select("doc_id", "text").join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        return map_slices(rows, _full_sets, f"id {kind}, payload array<bigint>")

    found = similar.links(buckets, sets_of, percent)
    ties = members.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    # only an id that heads a class and belongs to another one needs a tie; copies do not
    ties = ties.join(classes.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    joined = stored(components(found.unionByName(ties)), "components")
    of_class = members.join(joined, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id"))
    # an id with several sets: the least of its classes' components, which the ties made one
    of_doc = of_class.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"))
        .join(of_doc, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
