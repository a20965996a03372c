"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every WINDOW consecutive words the GRAM-word hashes are taken and their minimum is the
window's fingerprint (WINDOW - GRAM + 1 hashes slide in it). Equal windows have equal
fingerprints, so every shared span of WINDOW words or more is found. Neighbouring windows
mostly share their fingerprint: one entry is kept for each run of windows. The entries of
documents are joined with those of the benchmark; the runs that meet are extended, which
compares the whole text of each window in the run, so no hash collision is ever reported.

Items of fewer than WINDOW words are one window of their own length. For each such length in
the benchmark (there are at most WINDOW - 1) every document window is an entry.

The benchmark side is broadcast only below BROADCAST_ROWS entries; beyond that both joins are
shuffles, where only (id, hash, range) of the documents moves.

Defined cases: null or wordless texts have no words and no hits; null or wordless items occur
nowhere; a null item_id counts for hits but not as an item; rows that share id and text get the
same result each, rows that share an id only are judged apart; empty tables are fine.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.session import scratch_path

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 8
BROADCAST_ROWS = 200_000


def _let(value: Column, body) -> Column:
    """`body` over `value`, which is computed once (a plain reference may be inlined into a
    lambda by the optimizer and computed per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: str = "text") -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATOR), "")


def _entries(words: Column, lengths: list[int]) -> Column:
    """array<struct<len, hash, from, to>>: fingerprints and the runs of windows they stand for."""

    def hashes(w: Column, k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - k + 1)
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, k)))

    def entry(length: int, value: Column, first: Column, last: Column) -> Column:
        return F.struct(
            F.lit(length).alias("len"), value.alias("hash"), first.cast("int").alias("from"), last.cast("int").alias("to")
        )

    def winnowed(w: Column) -> Column:
        def runs(least: Column) -> Column:
            n = F.size(least)
            changes = F.filter(
                F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(least, i - 1) != F.get(least, F.greatest(i - 2, F.lit(0))))
            )
            return _let(
                changes,
                lambda c: F.transform(
                    c, lambda i, k: entry(WINDOW, F.get(least, i - 1), i, F.coalesce(F.get(c, k + 1) - 1, n))
                ),
            )

        slide = WINDOW - GRAM + 1
        return _let(
            hashes(w, GRAM),
            lambda h: _let(
                F.transform(F.sequence(F.lit(1), F.size(h) - slide + 1), lambda i: F.array_min(F.slice(h, i, slide))), runs
            ),
        )

    def every(w: Column, length: int) -> Column:
        return F.transform(hashes(w, length), lambda h, i: entry(length, h, i + 1, i + 1))

    none = F.filter(F.array(entry(0, F.xxhash64(F.lit(0)), F.lit(0), F.lit(0))), lambda e: F.lit(False))
    parts = []
    for length in lengths:
        make = winnowed if length == WINDOW else (lambda w, n=length: every(w, n))
        parts.append(lambda w, make=make, n=length: F.when(F.size(w) >= n, make(w)).otherwise(none))
    return _let(words, lambda w: F.concat(none, *[p(w) for p in parts]))


def _windows(words: Column, length: Column, first: Column, last: Column) -> Column:
    """array<struct<at, window>>: the text of every window of a run."""
    return _let(
        words,
        lambda w: F.transform(
            F.sequence(first, last), lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.slice(w, i, length)).alias("window"))
        ),
    )


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """`len`, `window` (text) and `item_id` of every window of every item, once each."""
    items = benchmark.select("item_id", words_of().alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(WINDOW))
    windows = _windows(F.col("w"), F.col("len"), F.lit(1), F.size("w") - F.col("len") + 1)
    rows = items.withColumn("len", length).select("item_id", "len", F.explode_outer(windows).alias("x"))
    return rows.select("len", F.col("x.window").alias("window"), "item_id").distinct()


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """`doc_id`, `_text` (hash of the text), `len`, `at`, `window`: every occurrence of a
    benchmark window in a document. `windows` is a stored table."""
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # WINDOW at most
    distinct = windows.select("len", "window").distinct()
    base = docs.select("doc_id", F.xxhash64("text").alias("_text"), words_of().alias("_words"))
    # a window's own entry: for WINDOW words its fingerprint, otherwise its hash
    entries = (
        distinct.select(_entries(F.split("window", " "), lengths).alias("e"), "len")
        .select("len", F.explode_outer("e").alias("e"))
        .where(F.col("e.len") == F.col("len"))
        .select("len", F.col("e.hash").alias("hash"))
        .distinct()
    )
    small = distinct.count() <= BROADCAST_ROWS  # there are no more entries than windows
    if small:
        entries, distinct = F.broadcast(entries), F.broadcast(distinct)
    # outer: an inner explode would compute the entries twice, once in an inferred filter
    found = base.withColumn("_e", _entries(F.col("_words"), lengths))
    if small:
        runs = found.select("doc_id", "_text", "_words", F.explode_outer("_e").alias("_e"))
    else:
        runs = found.select("doc_id", "_text", F.explode_outer("_e").alias("_e"))
    runs = runs.select("*", F.col("_e.len").alias("len"), F.col("_e.hash").alias("hash")).join(entries, ["len", "hash"])
    if not small:
        runs = runs.alias("r").join(
            base.alias("b"), F.expr("r.doc_id <=> b.doc_id AND r._text <=> b._text")
        ).select("r.*", "b._words")
    extended = runs.select(
        "doc_id", "_text", "len",
        F.explode_outer(_windows(F.col("_words"), F.col("len"), F.col("_e.from"), F.col("_e.to"))).alias("_x"),
    )
    return (
        extended.select("doc_id", "_text", "len", F.col("_x.at").alias("at"), F.col("_x.window").alias("window"))
        .join(distinct, ["len", "window"])
        .select("doc_id", "_text", "len", "at", "window")
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: `n_words`, `n_hit` words inside an occurrence, `n_items`, `items_sha256`
    and `contaminated` (at least one word in twenty is hit), with the text's hash `_text`."""
    spark = docs.sparkSession
    window_path, hit_path = scratch_path(spark, "windows"), scratch_path(spark, "hits")
    benchmark_windows(benchmark).write.parquet(window_path)
    windows = spark.read.parquet(window_path)
    hits(docs, windows).write.parquet(hit_path)
    found = spark.read.parquet(hit_path)

    key = ["doc_id", "_text"]
    spans = F.array_sort(F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("len")).alias("b"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"),
            F.greatest(x["b"], s["end"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    hit = found.groupBy(*key).agg(covered.cast("long").alias("n_hit"))
    items = (
        found.select(*key, "len", "window")
        .distinct()
        .join(windows, ["len", "window"])
        .select(*key, F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    judged = (
        hit.alias("h")
        .join(items.alias("i"), F.expr("h.doc_id <=> i.doc_id AND h._text <=> i._text"), "left")
        .select("h.*", F.coalesce("i.items", F.array().cast("array<string>")).alias("items"))
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.size(words_of()).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return (
        rows.alias("d")
        .join(judged.alias("j"), F.expr("d.doc_id <=> j.doc_id AND d._text <=> j._text"), "left")
        .select(
            "d.doc_id",
            "d._text",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    bad = contamination(docs, benchmark).where("contaminated").select("doc_id", "_text").distinct()
    tagged = docs.withColumn("__text", F.xxhash64("text"))
    joined = tagged.alias("t").join(bad.alias("b"), F.expr("t.doc_id <=> b.doc_id AND t.__text = b._text"), "left_anti")
    return joined.select(*docs.columns)
