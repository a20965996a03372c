"""Near-duplicate documents, fuzzy lines, and what they share."""

import random
from collections import defaultdict

import pytest

from quaestor.llm import graph, linededup, neardup, similar
from quaestor.llm.arrays import distinct_sorted

from .common import ODD, docs


def groups(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(1)
    if shape == "chain":
        order = rng.sample(range(200), 200)
        edges = list(zip(order, order[1:]))
    elif shape == "star":
        edges = [(150, k) for k in range(300) if k != 150]
    else:
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == groups(nodes, [e for e in edges if e[0] != e[1]])


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_rows():
    rng = random.Random(2)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(120):  # copies of one template, some chained only through others
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(150)] = f"e{rng.randrange(999)}"
        rows.append((1000 - i, " ".join(copy)))
    rows += [(2000 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for i in range(60)]
    return rows + [(i, t) for i, t in ODD if i is not None] + [(3000, "Same  TEXT\nhere"), (50, rows[3][1]), (50, rows[-1][1])]


@pytest.mark.parametrize("small", [12, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(similar, "SMALL", small)
    monkeypatch.setattr(similar, "BLOCK_MEMBERS", 25)
    rows = near_rows()
    sets = defaultdict(list)
    for i, t in rows:
        if s := shingle_set(t):
            sets[i].append(s)
    ids = sorted(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and any(100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])]
    want = groups({i for i, _ in rows}, edges)
    out = neardup.near_duplicates(docs(spark, [*rows, (None, "no id")], extra=True)).collect()
    assert len(out) == len(rows) + 1
    assert {r.doc_id: r.component_id for r in out} == want | {None: None}
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert sorted((r.doc_id, r.n_shingles) for r in out if r.doc_id) == sorted((i, len(shingle_set(t))) for i, t in rows)


def test_doubled_rows_keep_large_groups_apart(spark):
    """Every row twice: the ids of a large bucket must not cancel and make two groups look alike."""
    rng = random.Random(7)
    rows = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(200)]
        for i in range(30):
            rows.append((100 * (g + 1) + i, " ".join([*base, f"own{g}x{i}"])))
    rng.shuffle(rows)
    want = {i: i // 100 * 100 for i, _ in rows}
    out = neardup.near_duplicates(docs(spark, rows + rows)).collect()
    assert len(out) == 2 * len(rows) and {r.doc_id: r.component_id for r in out} == want


def test_large_bucket_of_several_components(spark, monkeypatch):
    """One bucket holds a chain, a group of near copies, unlinked sets and an id of two sets."""
    monkeypatch.setattr(similar, "BLOCK_MEMBERS", 5)
    rng = random.Random(11)
    chain = [(i, list(range(10 * i, 10 * i + 100))) for i in range(40)]  # neighbours share 90 of 110
    copies = [(100 + i, [*range(5000, 5095), *rng.sample(range(6000, 6400), 5)]) for i in range(60)]
    alone = [(200 + i, list(range(10_000 + 200 * i, 10_090 + 200 * i))) for i in range(12)]
    rows = [*chain, *copies, *alone, (300, list(range(5000, 5100))), (300, list(range(10_000, 10_100)))]
    sets = spark.createDataFrame([(i, sorted(s)) for i, s in rows], "id long, payload array<long>")
    buckets = sets.selectExpr("7L AS key", "id", "size(payload) AS n")
    edges = [(a, b) for a, x in rows for b, y in rows if a < b and 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})]
    found = similar.links(buckets, lambda ids: sets.join(ids, "id", "left_semi"), 80)
    got = {r.id: r.component for r in graph.components(found).collect()}
    want = groups({i for i, _ in rows}, edges)
    assert {i: got.get(i, i) for i in want} == want
    assert found.count() < 10 * len(rows)


def test_distinct_sorted_segments():
    import numpy as np

    rng = np.random.default_rng(6)
    for sizes in ([0], [0, 3, 0, 0, 40, 1, 0], [5, 5], [1]):
        values = rng.integers(0, 9, sum(sizes)).astype(np.uint64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        got, begin = distinct_sorted(values, first)
        want = [np.unique(values[a:b]).tolist() for a, b in zip(first[:-1], first[1:])]
        assert [got[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == want and len(got) == begin[-1]


def test_overlaps_equal_sets():
    import numpy as np

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, k)).astype(np.uint64) << np.uint64(58) for k in (0, 1, 40, 30, 90, 5)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    left, right = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6)))
    for take in (slice(None), slice(0, 6, 6), slice(0, 0), slice(14, 15)):
        want = [len({*sets[a]} & {*sets[b]}) for a, b in zip(left[take], right[take])]
        assert similar.overlaps(np.concatenate(sets), first, left[take], right[take]).tolist() == want


def test_broadcasts_are_bounded_by_bytes(spark):
    table = spark.createDataFrame([(1, [("x" * 1000, 2)]), (2, None)], "id long, found array<struct<t:string,k:int>>")
    hinted = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(similar.bounded(table, 2000)) and not hinted(similar.bounded(table, 1000))


def test_half_keys_find_links_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(0)
    met = 0
    for _ in range(300):
        shared = rng.integers(0, 1 << 63, 170, dtype=np.uint64)
        own = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
        values = np.concatenate([shared, own[:15], shared, own[15:]])  # 170 of 200
        keys = neardup.half_keys(values, np.array([0, 185, 370]))
        same = keys[0] == keys[1]
        met += same[:8].any() and same[8:].any()
    assert met >= 297


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs(spark, [])).collect() == []
    only = neardup.near_duplicates(docs(spark, [(1, None), (2, "")])).collect()
    assert [(r.n_shingles, r.kept) for r in only] == [(0, True), (0, True)]


def line_set(line):
    s = linededup.normal(line).decode()
    return frozenset(s[i : i + 7] for i in range(max(1, len(s) - 6)))


def brute_lines(rows):
    place = {}
    for i, t in sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate(t.split("\n")):
            n = linededup.normal(line)
            if n:
                place.setdefault(n, (i, k))
    lines = list(place)
    sets = {n: line_set(n.decode()) for n in lines}
    edges = [(x, y) for x in range(len(lines)) for y in range(x)
             if 100 * len(sets[lines[x]] & sets[lines[y]]) >= 80 * len(sets[lines[x]] | sets[lines[y]])]
    of = groups(range(len(lines)), edges)
    keeper = {n: place[lines[of[k]]] for k, n in enumerate(lines)}
    return {
        (i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if not linededup.normal(x) or keeper[linededup.normal(x)] == (i, k))
        for i, t in rows
        if t
    }


@pytest.mark.parametrize("small", [12, 2])
def test_lines_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(similar, "SMALL", small)
    monkeypatch.setattr(similar, "BLOCK_MEMBERS", 20)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randrange(60, 160))) for _ in range(12)]

    def line():
        text = rng.choice(base)
        at = rng.randrange(len(text) - 2)
        return rng.choice([text, text.upper(), text[:at] + "X" + text[at + 1 :], text + " tail", f"only {rng.random()}", "", "  ", "ok"])

    rows = [(100 + i, "\n".join(line() for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(i, t) for i, t in ODD if i not in (None, 5)] + [(5, "same text here"), (70, "été à la plage\nÉté à la plage")]
    out = linededup.dedup_lines(docs(spark, rows, extra=True)).collect()
    want = brute_lines(rows)
    assert len(out) == len(rows)
    for r in out:
        given = dict(rows)[r.doc_id]
        assert r.text == (want[r.doc_id, given] if given else given)
        worded = [sum(bool(linededup.normal(x)) for x in (t or "").split("\n")) for t in (given, r.text)]
        assert (r["__n_lines"], r["__n_removed"]) == (worded[0], worded[0] - worded[1])


def test_line_rows_that_repeat_and_empty_tables(spark):
    table = docs(spark, [(1, "a line that repeats\nx"), (1, "a line that repeats\nx"), (None, "a line that repeats"), (2, None)])
    out = linededup.dedup_lines(table).collect()
    # the null id sorts first and keeps the line; equal rows lose it alike
    assert sorted((str(r.doc_id), r.text) for r in out) == [("1", "x"), ("1", "x"), ("2", None), ("None", "a line that repeats")]
    assert linededup.dedup_lines(table.limit(0)).collect() == []


def test_finished_stars_are_not_joined_again(spark, monkeypatch):
    joined = []
    toward = graph._toward
    monkeypatch.setattr(graph, "_toward", lambda edges: joined.append(edges.count()) or toward(edges))
    pairs = [(1000 + 2 * n, 1001 + 2 * n) for n in range(300)] + [(9000, 9001 + n) for n in range(50)]
    chain = [(n, n + 1) for n in range(12)]
    links = spark.createDataFrame(pairs + chain, "a long, b long")
    got = {r.id: r.component for r in graph.components(links).collect()}
    want = {x: a for a, b in pairs for x in (a, b)} | {n: 0 for n in range(13)}
    assert got == want
    assert joined and max(joined) <= 2 * len(chain)  # pairs and stars took no part


def test_of_equal_buckets_one_is_joined(spark):
    rows = [(key, i, 9) for key in range(20) for i in range(6)] + [(99, i, 9) for i in (1, 2, 3, 4, 5, 7)]
    buckets = spark.createDataFrame(rows, "key long, id long, n long")
    company = similar.split_buckets(buckets)[1].collect()
    assert sorted((r.key, r.id) for r in company) == sorted({(0, i) for i in range(6)} | {(99, i) for i in (1, 2, 3, 4, 5, 7)})


@pytest.fixture
def written(spark, monkeypatch):
    """Files of the tables that `similar` stores, by name, where no shuffle of the buckets is small."""
    files = defaultdict(list)
    stored = similar.stored

    def count(df, name):
        table = stored(df, name)
        files[name].append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(similar, "stored", count)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield files
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_shared_keys_are_few_files(spark, written):
    """20,000 keys of which 4 are shared: what is left of them is not a file for every task."""
    sets = spark.createDataFrame([(i, list(range(100 * (i // 2), 100 * (i // 2) + 50))) for i in range(8)], "id long, payload array<long>")
    buckets = spark.range(20_000).selectExpr("id + 100 AS key", "id + 1000 AS id", "50 AS n").repartition(8)
    buckets = buckets.unionByName(spark.range(8).selectExpr("id DIV 2 AS key", "id", "50 AS n"))
    found = similar.links(buckets, lambda ids: sets.join(ids, "id", "left_semi"), 80)
    assert {(r.a, r.b) for r in found.collect()} in [{(2 * k, 2 * k + 1) for k in range(4)}, {(2 * k + 1, 2 * k) for k in range(4)}]
    assert max(written["keys"] + written["pairs"] + written["ids"]) <= 4


def test_large_buckets_are_joined_once_with_their_keys(spark, monkeypatch):
    """Equal large buckets have left before: their rows meet the keys in `split_buckets` only."""
    rows = [(key, i, 50) for key in range(6) for i in range(30)] + [(9, i, 50) for i in range(1, 31)]
    sets = spark.createDataFrame([(i, [*range(50), 100 + i]) for i in range(31)], "id long, payload array<long>")
    company = similar.split_buckets(spark.createDataFrame(rows, "key long, id long, n long"))[1]
    plans = []
    stored = similar.stored
    monkeypatch.setattr(similar, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    none = spark.createDataFrame([], "a long, b long")
    found = similar.large_links(company, sets, 80, None, none)
    assert {r.component for r in graph.components(found).collect()} == {0}
    assert "Join" not in plans[0]


def test_links_of_dense_groups_become_stars_before_they_are_shuffled(spark, monkeypatch):
    from quaestor.llm import graph

    rows = [(100 * g + i, 100 * g + j) for g in range(4) for i in range(40) for j in range(i)] + [(39, 130), (7, 7)]
    links = spark.createDataFrame(rows, "a long, b long").repartition(3)
    assert graph.local_stars(links).count() <= 3 * 4 * 40 < len(rows)
    for together in (200_000, 50):
        monkeypatch.setattr(graph, "TOGETHER", together)
        got = {r.id: r.component for r in graph.components(graph.local_stars(links)).collect()}
        assert got == {100 * g + i: 0 if g < 2 else 100 * g for g in range(4) for i in range(40)}
    texts = spark.createDataFrame([("b", "a"), ("c", "b"), ("é", "z")], "a string, b string")
    assert {(r.id, r.component) for r in graph.components(graph.local_stars(texts)).collect()} == {(x, "a") for x in "abc"} | {("é", "z"), ("z", "z")}
