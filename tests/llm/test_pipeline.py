from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaestor.llm import langid, registry

from .test_decontaminate import brute
from .test_duplicates import brute_lines, groups, shingle_set

SF = "/root/testdata/sf0.001"


def brute_stages(docs, benchmark, language_of):
    """The pipeline's decisions on a list of (doc_id, text, lang, source) by plain loops."""
    rows = [(i, t, language_of[i], s) for i, t, _, s in docs if language_of[i]]
    texts = brute_lines([(i, t) for i, t, _, _ in rows])
    rows = [(i, texts.get((i, t), t), la, s) for i, t, la, s in rows]
    rows = [r for r in rows if (r[1] or "").split() or not (dict((i, t) for i, t, _, _ in docs)[r[0]] or "").split()]
    sets = {i: shingle_set(t) for i, t, _, _ in rows}
    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    near = {(a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b}
    edges = [(a, b) for a, b in near if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = groups(sets, edges)
    rows = [r for r in rows if of[r[0]] == r[0]]
    return [r for r in rows if not brute(r[1], benchmark)[4]]


def test_run_equals_brute_force(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    # the model's decisions are taken as they are: their accuracy has its own test
    told = langid.predict(table, langid.train(table)).collect()
    rows = brute_stages(given, benchmark, {r.doc_id: None if r.rejected else r.lang_pred for r in told})
    db = duckdb.connect()
    db.execute("CREATE TABLE left_over (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO left_over VALUES (?, ?, ?, ?)", rows)
    want = set(db.execute(registry.mixture_sql("left_over", "doc_id, epoch, n_tokens, take_tokens")).fetchall())
    text_of = {r[0]: (r[1], r[2]) for r in rows}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.epoch, r.n_tokens, r.take_tokens) for r in out} == want and len(out) == len(want)
    assert all((r.text, r.lang) == text_of[r.doc_id] and r.n_chars == len(r.text) for r in out)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("score", "rejected", "epoch", "n_tokens", "kept", "id", "t", "_text"):
        docs = docs.withColumn(name, F.lit(7))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "mixture":
            assert len(set(out.columns)) == len(out.columns) and out.where("take_tokens > 0").count() > 0
        else:
            assert sorted(out.dtypes) == sorted(docs.dtypes)
            assert 0.7 * docs.count() < out.count() <= docs.count()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id and some words", "en", "s", 20)]])
def test_empty_and_odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(rows)
