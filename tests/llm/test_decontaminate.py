import hashlib
import re

import pytest

from quaestor.llm import decontaminate

from .common import ODD, docs


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


def cases():
    import random

    rng = random.Random(0)
    draw = lambda n, v=30: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    items = [(i, draw(20 + i)) for i in range(12)] + [(20, "short item of five words"), (21, "one"), (22, draw(13)), (23, None), (24, "..."),
             (25, "la " * 40), (10, "second text of item ten " + draw(15)), (26, "É été")]
    rows = [(100 + i, draw(30) + " " + " ".join(items[i % 12][1].upper().split()[k : k + n]) + "; " + draw(i * 9))
            for i in range(16) for k, n in ((0, 12), (1, 13), (3, 17))]
    rows += [*ODD, (300, "x short ITEM, of five-words y"), (301, "la " * 3000), (302, "one"), (303, "É été"), (304, "é été")]
    return items, [(1000 + k, t) for k, (_, t) in enumerate(rows)] + [(None, "one two")]


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    items, rows = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS len", "'x' AS window")
    out = decontaminate.contamination(docs(spark, rows, extra=True), benchmark).collect()
    assert len(out) == len(rows)
    texts = {i: t for i, t in rows}
    for r in out:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(texts[r.doc_id], items), r.doc_id


def test_only_built_in_functions_run(spark):
    items, rows = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = decontaminate.benchmark_windows(benchmark)
    plan = decontaminate.hits(docs(spark, rows), windows)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_clean_and_empty(spark):
    items, rows = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = docs(spark, rows)
    kept = {r.doc_id for r in decontaminate.clean(table, benchmark).collect()}
    assert kept == {i for i, t in rows if not brute(t, items)[4]}
    assert decontaminate.clean(table, benchmark).columns == table.columns
    assert decontaminate.contamination(table.limit(0), benchmark).collect() == []
    assert {r.n_hit for r in decontaminate.contamination(table, benchmark.limit(0)).collect()} == {0}
