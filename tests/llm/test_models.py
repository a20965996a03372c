"""Language identification and the quality classifier."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.llm import langid, quality

from .common import ODD, docs

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_rows(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(given).join(given.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n, rejected = out.agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))
    ).first()
    assert n > 200 and right > 0.98 and rejected <= 0.01 * n


def test_language_odd_rows(spark):
    known = [(100 + i, "the thing and that of the then", "en", "s") for i in range(60)]
    known += [(200 + i, "le chat et la souris une des", "fr", "s") for i in range(60)]
    table = docs(spark, [*ODD, *known, (300, "a"), (301, "é"), (302, "le la les une souris", None)], extra=True)
    rows = langid.identify(table).collect()
    assert len(rows) == table.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].rejected for i in (1, 2, 3, 8))
    assert by_id[300].lang_pred in ("en", "fr") and by_id[301].lang_pred in ("en", "fr")
    assert by_id[302].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id in (5, 6)}) == 1


def test_nothing_to_learn(spark):
    table = docs(spark, [(1, "text", None), (2, None, None)])
    assert {r.lang_pred for r in langid.identify(table).collect()} == {"und"}
    assert langid.identify(table.limit(0)).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(table, labels).collect()} == {0.5}
    assert quality.classify(table.limit(0), labels).collect() == []


def test_a_language_model_rejects_what_it_cannot_tell():
    rows = [("x", np.array([1, 2, 3]), np.array([1, 1, 2])), ("y", np.array([7, 8, 9]), np.array([3, 1, 1]))] * 40
    model = langid.fit(rows)
    p = langid._softmax(np.stack([model.table[[1, 2]].mean(axis=0), model.table[[50]].mean(axis=0)]) / model.temperature)
    assert p[0].max() > p[1].max() and 0 < model.threshold <= 0.5


def test_language_gradients_match_differences():
    rng = np.random.default_rng(1)
    x, y = np.zeros((3, langid.BUCKETS)), np.array([0, 1, 1])
    x[:, :4] = [[0.5, 0.5, 0, 0], [0, 0.25, 0.75, 0], [0, 0, 0, 1]]
    embedding, weight = rng.normal(0, 1, (langid.BUCKETS, langid.DIM)), rng.normal(0, 1, (langid.DIM, 2))

    def loss():
        return -np.log(langid._softmax(x @ embedding @ weight)[np.arange(3), y]).mean()

    by_embedding, by_weight = langid.gradients(x, y, embedding, weight)
    for layer, grad, at in ((embedding, by_embedding, (2, 5)), (weight, by_weight, (3, 1)), (embedding, by_embedding, (9, 0))):
        layer[at] += 1e-5
        up = loss()
        layer[at] -= 2e-5
        down = loss()
        layer[at] += 1e-5
        assert grad[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


def _one_by_one(text, model):
    """A text's score in plain loops over its subwords."""
    data = np.frombuffer(text.lower().encode() if text.isascii() else text.encode(), np.uint8)
    total, count = np.zeros(len(model.languages)), 0
    for n in langid.ORDERS:
        for k in range(len(data) - n + 1):
            bucket = langid.Rolling(langid._BYTE[data[k : k + n]]).grams(n)[0] & np.uint64(langid.BUCKETS - 1)
            total += model.table[int(bucket)]
            count += 1
    z = np.exp(total / count / model.temperature)
    return z / z.sum()


@pytest.mark.parametrize("chunk", [1 << 18, 7])
def test_language_scores_in_plain_loops(spark, monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    table = rng.normal(0, 1, (langid.BUCKETS, 3)).astype(np.float32)
    model = langid.LanguageModel(["x", "y", "z"], table, 0.3, 0.0)
    texts = ["the first text", "ab", "", "and ANOTHER one, longer than that", None, "abc" * 40, "x1"]
    import pyarrow as pa

    given = pa.array(texts, pa.string())
    data, offsets = langid.buffer(given)
    total, count = np.zeros((len(texts), 3)), np.zeros(len(texts))
    for buckets, a, b in langid._grams(data, offsets):
        total += langid._sums(table, buckets, a, b)
        count += b - a
    for i, text in enumerate(texts):
        if text:
            z = np.exp(total[i] / count[i] / model.temperature)
            assert z / z.sum() == pytest.approx(_one_by_one(text, model), rel=1e-4)


def _auc(score, label):
    rank = np.argsort(np.argsort(score))
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_of_held_out_rows(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality.classify(given, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 200
    assert _auc(out.score.to_numpy(), out.quality.to_numpy()) > 0.97
    assert out.predicted[out.quality == 1].mean() > 0.97


def test_quality_odd_rows(spark):
    table = docs(spark, ODD, extra=True)
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (77, 1), (5, 0)], "doc_id long, quality int")
    rows = quality.classify(table, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (5, 6)}) == 1


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = quality.AttentionModel()
    model.p = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in model.p.items()}
    first = np.array([0, 3, 4, 9])
    x, y = rng.normal(0, 1, (9, quality.FEATURES)), np.array([1, 0, 1])

    def loss():
        p = model.forward(x, first)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = model.gradients(model.forward(x, first), first, y)
    for key, g in grads.items():
        at = tuple(rng.integers(0, s) for s in model.p[key].shape)
        kept = model.p[key][at]
        model.p[key][at] = kept + 1e-5
        up = loss()
        model.p[key][at] = kept - 1e-5
        down = loss()
        model.p[key][at] = kept
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6), key
