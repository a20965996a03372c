from collections import defaultdict
from dataclasses import replace

import pytest

from quaestor.llm import mixture

from .common import ODD, docs


def test_a_shortage_goes_to_siblings_first(spark):
    recipe = mixture.Recipe("'d' || length(lang)", {"d1": 1, "d2": 1}, {"a": 1, "b": 1, "cc": 1}, max_epochs=1, share=(1, 2))
    leaves = spark.createDataFrame(
        [("d1", "a", "s1", 10), ("d1", "a", "s2", 100), ("d1", "b", "s1", 300), ("d2", "cc", "s1", 590), ("d3", "x", "s", 0)],
        "domain string, lang string, source string, available long",
    )
    quota = {(r.domain, r.lang, r.source): r.quota for r in mixture.allocate(leaves, recipe).collect()}
    # 500 tokens: 250 a domain; 125 a language, of which `a` has 110 and `b` takes the rest
    assert quota == {("d1", "a", "s1"): 10, ("d1", "a", "s2"): 100, ("d1", "b", "s1"): 140, ("d2", "cc", "s1"): 250}


def test_epochs_and_prefixes(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "en" if i % 3 else "de", f"src{i % 4}") for i in range(400)]
    recipe = replace(mixture.RECIPE, max_epochs=3, share=(3, 4))
    table = docs(spark, rows, extra=True)
    out = mixture.mix(table, recipe).collect()
    leaves = mixture.tokens(table, recipe).groupBy(*mixture.LEAF).agg({"n_tokens": "sum"})
    quota = {r[:3]: r.quota for r in mixture.allocate(leaves.withColumnRenamed("sum(n_tokens)", "available"), recipe).collect()}
    taken, seen = defaultdict(int), set()
    for r in out:
        taken[r.domain, r.lang, r.source] += r.take_tokens
        assert 0 < r.take_tokens <= r.n_tokens and (r.doc_id, r.epoch) not in seen
        seen.add((r.doc_id, r.epoch))
    assert taken == quota
    # at most one text of a leaf is cut
    cut = [(r.domain, r.lang, r.source) for r in out if r.take_tokens < r.n_tokens]
    assert len(cut) == len(set(cut))
    assert {tuple(r) for r in mixture.mix(table.repartition(7), recipe).collect()} == {tuple(r) for r in out}
    other = {(r.doc_id, r.epoch) for r in mixture.mix(table, replace(recipe, seed=18)).collect()}
    assert other != seen


@pytest.mark.parametrize("broadcast", [100, 0])
def test_odd_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixture, "LEAVES_BROADCAST", broadcast)
    rows = [(*r, None, None) if i % 2 else r for i, r in enumerate(ODD)]
    out = mixture.mix(docs(spark, rows, extra=True), replace(mixture.RECIPE, share=(1, 1), max_epochs=1)).collect()
    assert {r.doc_id for r in out} <= {4, 5, 6, 7, 8, 9, None} and sum(r.take_tokens for r in out) > 40_000
    assert mixture.mix(docs(spark, [])).collect() == []
    assert mixture.mix(docs(spark, [(1, None), (2, " ")])).collect() == []
