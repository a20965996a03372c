import random
from difflib import get_close_matches

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaestor import schemas
from quaestor.functions.labels import GUARD_MESSAGE, NO_ANSWER_MESSAGE, confidence_label
from quaestor.functions.strings import indel_score
from quaestor.operators import embed as em
from quaestor.operators import fuzzy as fz
from quaestor.operators import spelling as sp
from quaestor.operators import vectors as ve
from quaestor.operators.blocks import top_cells
from quaestor.plans.cascade import Knowledge, answer, evaluate, guard
from quaestor.plans.pipeline import build_knowledge
from quaestor.session import scratch_path
from quaestor.sources import tables as tb
from quaestor.streaming import jobs


def corpus_of(spark, vectors):
    return spark.createDataFrame(
        [(n, f"question {n}", f"answer {n}", [float(x) for x in v]) for n, v in enumerate(vectors)],
        "faq_id long, question string, answer string, embedding array<float>",
    )


def queries_of(spark, vectors):
    return spark.createDataFrame(
        [(n, [float(x) for x in v]) for n, v in enumerate(vectors)], "query_id long, embedding array<float>"
    )


def matches(df):
    return sorted((r.query_id, r["rank"], r.faq_id, round(r.similarity, 6)) for r in df.collect())


def test_knn_ties_zero_and_opposite(spark):
    corpus = corpus_of(spark, [(1, 0), (1, 0), (0, 0), (-1, 0)])
    asked = queries_of(spark, [(2, 0)])
    assert matches(ve.knn_exact(asked, corpus, 9)) == [
        (0, 1, 0, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 0.0), (0, 4, 3, -1.0)
    ]
    unit = queries_of(spark, [(1, 0)])
    assert matches(ve.knn_l2(unit, corpus, 4))[-1] == (0, 4, 3, 0.0)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(300, 8))
    corpus[100:200] = corpus[0]  # a third of the corpus is one copied vector
    corpus /= np.linalg.norm(corpus, axis=1, keepdims=True)
    asked = corpus[::9] + 0.1 * rng.normal(size=(34, 8))
    return corpus_of(spark, corpus).repartition(5).cache(), queries_of(spark, asked).repartition(3).cache()


def test_block_path_equals_broadcast_path(cloud):
    corpus, asked = cloud
    for fn in (ve.knn_exact, ve.knn_l2):
        assert matches(fn(asked, corpus, 7)) == matches(fn(asked, corpus, 7, broadcast_bytes=0))


def test_cells_with_all_probes_are_exact_and_fewer_are_a_subset(cloud):
    corpus, asked = cloud
    index = ve.build_cells(corpus, cells=12, max_iter=3)
    exact = matches(ve.knn_l2(asked, corpus, 5))
    assert matches(ve.knn_cells(asked, index, 5, probes=12)) == exact
    every = {(q, f): s for q, _, f, s in matches(ve.knn_l2(asked, corpus, 300))}
    few = matches(ve.knn_cells(asked, index, 5, probes=3))
    assert all(every[q, f] == s for q, _, f, s in few)
    recall = len({(q, f) for q, _, f, _ in few} & {(q, f) for q, _, f, _ in exact}) / len(exact)
    assert recall > 0.6


def test_hashing_finds_clustered_vectors_among_few_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (60, 32))
    vectors = (centres[rng.integers(0, 60, 3000)] + rng.normal(0, 0.15, (3000, 32))).tolist()
    corpus, asked = corpus_of(spark, vectors), queries_of(spark, vectors[:100])
    exact = matches(ve.knn_l2(asked, corpus, 5))
    every = {(q, f): s for q, _, f, s in matches(ve.knn_l2(asked, corpus, 3000))}
    found = matches(ve.knn_lsh(asked, corpus, 5))
    assert all(every[q, f] == pytest.approx(s) for q, _, f, s in found)
    assert len({(q, f) for q, _, f, _ in found} & {(q, f) for q, _, f, _ in exact}) >= 0.9 * len(exact)
    bits, tables = ve.hash_layout(3000)
    planes = np.random.default_rng(0).normal(0, 1, (tables, bits, 32))
    pairs = ve._sign_buckets(asked, "query_id", planes).drop("embedding").join(
        ve._sign_buckets(corpus, "faq_id", planes).drop("embedding"), "bucket"
    )
    assert pairs.select("query_id", "faq_id").distinct().count() < 0.1 * 100 * 3000


def test_registered_index_searches_reach_their_recall(spark):
    """Neighbours of the given vectors are far: cosines of 0.35 to 0.45 after the first."""
    from registry import search_queries as sq

    sf = "/root/testdata/sf0.1"
    key = lambda df: {(r.query_id, r.faq_id): r.similarity for r in df.collect()}
    exact = key(sq.knn_l2(spark, sf))
    for name in ("knn_ivf_probes", "knn_lsh"):
        rows = sq.QUERIES[name](spark, sf).collect()
        found = {(r.query_id, r.faq_id): r.similarity for r in rows}
        assert len(found) == len(rows) == len(exact)
        same = found.keys() & exact.keys()
        print(name, len(same) / len(exact))
        assert len(same) >= 0.9 * len(exact)
        assert all(abs(found[p] - exact[p]) < 1e-6 for p in same)


def test_hashing_answers_lonely_queries_exactly(cloud):
    corpus, asked = cloud
    assert matches(ve.knn_lsh(asked, corpus, 5, bits=40, tables=1)) == matches(ve.knn_l2(asked, corpus, 5))


def test_a_task_merges_what_it_found_in_many_places(cloud, monkeypatch):
    queries, corpus = cloud
    found = [pd.DataFrame({"query_id": [0, 0, 1], "faq_id": [p, 9, p], "score": [-float(p), -0.5, -1.0]}) for p in (3, 1, 2)]
    assert ve._merged(found, 2).values.tolist() == [[0, 9, -0.5], [0, 1, -1.0], [1, 1, -1.0], [1, 2, -1.0]]
    index = ve.build_cells(corpus, 8)
    want = matches(ve.knn_cells(queries, index, 3, probes=8))
    monkeypatch.setattr(ve, "MERGED_ROWS", 1)
    assert matches(ve.knn_cells(queries, index, 3, probes=8)) == want


def test_search_is_exact_at_every_size(spark):
    """12,000 short vectors: negative similarities stay, nothing is left out."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(0, 1, (12_000, 4))
    asked = rng.normal(0, 1, (8, 4))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.round(unit(asked) @ unit(vectors).T, 12)
    got = ve.search(queries_of(spark, asked.tolist()), corpus_of(spark, vectors.tolist()), 3).collect()
    want = {(q, n + 1, int(c)) for q in range(8) for n, c in enumerate(np.lexsort((np.arange(12_000), -cos[q]))[:3])}
    # the rows are stored as float
    assert len({(r.query_id, r["rank"], r.faq_id) for r in got} & want) >= 23
    opposite = ve.best_match(queries_of(spark, [(-1.0, 0.0)]), corpus_of(spark, [(1.0, 0.0)])).first()
    assert opposite.similarity == -1.0
    with pytest.raises(ValueError):
        ve.search(queries_of(spark, [(1.0, 0.0)]), corpus_of(spark, [(1.0, 0.0)]), strategy="auto")
    assert ve.default_cells(400) == 100 and ve.default_cells(40000) == 200


def test_top_cells_resolves_ties():
    rows, cols, found = top_cells(np.array([[1.0, 3, 2, 2, 2, 0], [5, 5, 5, 5, 5, 5]]), 3)
    assert rows.tolist() == [0, 0, 0, 1, 1, 1] and cols.tolist() == [1, 2, 3, 0, 1, 2]
    assert found.tolist() == [3, 2, 2, 5, 5, 5]


def test_threshold_is_inclusive(spark):
    corpus = corpus_of(spark, [(0.78, np.sqrt(1 - 0.78**2))])
    asked = queries_of(spark, [(1, 0), (0.99, 0.2)])
    sim = {r.query_id: r.similarity for r in ve.knn_exact(asked, corpus, 1).collect()}
    hit = ve.best_match(asked, corpus, sim[0]).where("query_id = 0").first()
    assert hit.answer == "answer 0"
    miss = ve.best_match(asked, corpus, sim[0] + 1e-9).where("query_id = 0").first()
    assert miss.answer is None and miss.similarity == sim[0]
    none = ve.best_match(asked, corpus.where("false")).first()
    assert none.answer is None and none.similarity == 0.0


@pytest.mark.parametrize("scheme, want", [
    ("match", ["Good", "Good", "Good", "Good", "High"]),
    ("ranked", ["Low", "Medium", "Medium", "Medium", "High"]),
    ("response", ["Good", "Medium", "Medium", "High", "High"]),
])
def test_labels(spark, scheme, want):
    df = spark.createDataFrame([(s,) for s in (0.7, 0.70001, 0.8, 0.85, 0.85001)], "s double").coalesce(1)
    assert [r[0] for r in df.select(confidence_label(F.col("s"), scheme)).collect()] == want


def test_length_buckets_fallback_and_unscored(spark):
    corpus = spark.createDataFrame(
        [(n, "x" * size, [1.0, float(n)]) for n, size in enumerate([10, 49, 50, 120, 260])],
        "faq_id long, question string, embedding array<float>",
    )
    asked = spark.createDataFrame(
        [(0, "y" * 40, [1.0, 0.0]), (1, "y" * 2000, [1.0, 0.0])],
        "query_id long, query string, embedding array<float>",
    )
    # length 40: buckets 0 and 1 hold ids 0, 1, 2; length 2000: nothing near, so the whole corpus
    got = matches(ve.length_bucket_search(asked, corpus, 2))
    assert [q for q, _, _, _ in got] == [0, 0, 1, 1] and {f for q, _, f, _ in got if q == 0} <= {0, 1, 2}
    few = matches(ve.length_bucket_search(asked.where("query_id = 0"), corpus, 4))
    assert {f for _, _, f, _ in few} == {0, 1, 2} and all(s != 0.0 for _, _, _, s in few)


def test_length_buckets_score_every_candidate(spark):
    """Against a walk over buckets."""
    rng = random.Random(2)
    questions = [(n, "x" * rng.randrange(1, 400), [rng.random(), rng.random()]) for n in range(120)]
    asked = [(n, "y" * size, [rng.random(), rng.random()]) for n, size in enumerate([5, 60, 149, 150, 153, 390, 3000])]
    want = set()
    for q, text, v in asked:
        slack = max(50, len(text) // 3)
        span = range(max(0, (len(text) - slack) // 50), (len(text) + slack) // 50 + 1)
        near = [c for b in span for c in questions if len(c[1]) // 50 == b] or questions
        cos = lambda c: np.dot(c[2], v) / np.linalg.norm(c[2]) / np.linalg.norm(v)
        best = sorted(near, key=cos, reverse=True)[:4]
        want |= {(q, n, c[0]) for n, c in enumerate(best, 1)}
    schema = "embedding array<double>"
    got = ve.length_bucket_search(
        spark.createDataFrame(asked, f"query_id long, query string, {schema}"),
        spark.createDataFrame(questions, f"faq_id long, question string, {schema}"),
        4,
    ).collect()
    assert {(r.query_id, r["rank"], r.faq_id) for r in got} == want


# --- fuzzy


def test_indel_score_against_recurrence():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            above = 0
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(1, 90))) for _ in "ab")
        assert indel_score(a, b) == round(200 * lcs(a, b) / (len(a) + len(b)))


def test_fuzzy_brute_force(spark):
    rng = random.Random(8)
    letters = "abcdef"

    def phrase():
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(rng.randint(1, 9)))

    questions = [phrase() for _ in range(150)]
    questions[50:100] = [questions[0]] * 50
    asked = [phrase() for _ in range(25)] + [questions[0], "", "!!"]
    corpus = spark.createDataFrame(list(enumerate(questions)), "faq_id long, question string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")

    def sort_key(text):
        return " ".join(sorted(text.split()))

    want = set()
    for q, text in enumerate(asked):
        if not text:
            continue
        near = [(i, x) for i, x in enumerate(questions) if abs(len(x) - len(text)) <= max(30, len(text) // 2)]
        hits = [(indel_score(sort_key(text.replace("!", " ")), sort_key(x)), i) for i, x in near]
        hits = sorted((h for h in hits if h[0] >= 70), key=lambda h: (-h[0], h[1]))[:5]
        want |= {(q, n, i, s) for n, (s, i) in enumerate(hits, 1)}
    got = fz.fuzzy_match(queries, corpus).collect()
    assert {(r.query_id, r["rank"], r.faq_id, r.score) for r in got} == want


def test_fuzzy_match_at_the_end_of_many(spark):
    rng = random.Random(4)
    questions = ["".join(rng.choices("abcdefgh ", k=60)) for _ in range(2000)] + ["the only question that can match at all"]
    corpus = spark.createDataFrame(list(enumerate(questions)), "faq_id long, question string")
    asked = spark.createDataFrame([(1, "match at all the only question that can")], "query_id long, query string")
    best = fz.fuzzy_match(asked, corpus, k=1).first()
    assert (best.faq_id, best.score) == (2000, 100)


def test_fuzzy_compares_equal_texts_once_and_copies_get_their_rows(spark, monkeypatch):
    met = []

    def join(left, right, *args, **kw):
        met.append((left.select("_qkey").distinct().count(), right.count()))
        return block_join(left, right, *args, **kw)

    block_join = fz.block_join
    monkeypatch.setattr(fz, "block_join", join)
    questions = ["how to reset a password", "where is the invoice"] * 20
    corpus = spark.createDataFrame(list(enumerate(questions)), "faq_id long, question string")
    asked = spark.createDataFrame([(i, "reset a password how to") for i in range(30)], "query_id long, query string")
    got = fz.fuzzy_match(asked, corpus, k=3).collect()
    assert {(r.query_id, r["rank"], r.faq_id) for r in got} == {(q, n, 2 * n - 2) for q in range(30) for n in (1, 2, 3)}
    assert met == [(1, 2)]


def test_fuzzy_passes_over_texts_below_the_best(monkeypatch):
    compared = []
    common = fz.TextCodes.common
    monkeypatch.setattr(fz.TextCodes, "common", lambda self, keys, left, which: compared.append(len(which)) or common(self, keys, left, which))
    rng = random.Random(7)
    texts = ["".join(rng.sample("aabbccddeeffgghh", 16)) for _ in range(500)]
    texts += ["".join(rng.sample("aabbccddeeffggxyz", 16)) for _ in range(500)] + ["aabbccddeeffgghhi"]
    rhs = pd.DataFrame({"_ckey": texts, "_clen": 16, "_ids": [[i] for i in range(len(texts))]})
    lhs = pd.DataFrame({"_qkey": ["aabbccddeeffgghhi"], "_qlen": [17], "_floor": [70]})
    out = fz._score_blocks(1)(lhs, rhs)
    assert out[["faq_id", "score"]].values.tolist() == [[1000, 100]]
    assert sum(compared) < 20  # all but the first few are bounded below 100


def test_fuzzy_floor_over_several_blocks_changes_nothing(spark, monkeypatch):
    rng = random.Random(9)
    questions = [" ".join(rng.choices(["red", "green", "blue", "dark", "light", "pale"], k=4)) for _ in range(120)]
    corpus = spark.createDataFrame(list(enumerate(questions)), "faq_id long, question string")
    asked = spark.createDataFrame([(i, q[:-1]) for i, q in enumerate(questions[:20])], "query_id long, query string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(fz.fuzzy_match(asked, corpus, k=3))
    monkeypatch.setattr(fz, "TEXT_ROWS", 16)
    assert rows(fz.fuzzy_match(asked, corpus, k=3)) == want


def test_fuzzy_length_gap(spark):
    corpus = spark.createDataFrame([(0, "a" * 40), (1, "a" * 41)], "faq_id long, question string")
    asked = spark.createDataFrame([(0, "a" * 10)], "query_id long, query string")
    assert [r.faq_id for r in fz.fuzzy_match(asked, corpus, min_score=0).collect()] == [0]


# --- spelling


def words_of(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def vocab_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, freq long")


def test_unknown_words(spark):
    got = sp.unknown_words(words_of(spark, ["at", "123", "HELLO", "wrld", "wrld"]), words_of(spark, ["hello"]))
    assert [r.word for r in got.collect()] == ["wrld"]


@pytest.mark.parametrize("text, want", [
    ("soooo", "soo"), ("sooo", "sooo"), ("wwwhat", "what"), ("wwwwhat", "wwhat"), ("a    b", "a b"), (".....", ".."),
])
def test_pattern_repair(spark, text, want):
    from quaestor.functions.text import repair

    assert spark.createDataFrame([(text,)], "t string").select(repair(F.col("t"))).first()[0] == want


def test_close_matches_equal_difflib(spark):
    rng = random.Random(11)
    parts = ["ba", "bo", "ter", "tion", "an", "s", "e", "qui", "mor"]
    vocabulary = sorted({"".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(300)} | {"x" * 70})
    words = sorted({"".join(rng.choices(parts, k=rng.randint(1, 5))) + rng.choice("aeiou") for _ in range(80)} | {"x" * 66})
    got = {}
    for r in sp.close_matches(words_of(spark, words), vocab_of(spark, dict.fromkeys(vocabulary, 1))).collect():
        got.setdefault(r.word, []).append((r.ratio, r.suggestion))
    for word in words:
        want = get_close_matches(word, [v for v in vocabulary if len(v) > 3], n=3, cutoff=0.7)
        assert [s for _, s in sorted(got.get(word, []), reverse=True)] == want


def test_close_matches_pass_over_bags_below_the_best(monkeypatch):
    compared = []
    common = sp.LetterCodes.common

    def counted(self, words, left, right, longest):
        compared.append(len(left))
        return common(self, words, left, right, longest)

    monkeypatch.setattr(sp.LetterCodes, "common", counted)
    rng = random.Random(2)
    near = ["instalation", "installatio", "nstallation"]
    far = sorted({"".join(rng.sample("installati", 8)) + "xy" for _ in range(400)})  # bags of 16 / 21
    out = sp._close_blocks(3, 0.7)(pd.DataFrame({"word": ["installation"]}), pd.DataFrame({"suggestion": near + far}))
    assert sorted(out["suggestion"]) == sorted(near)
    assert sum(compared) < 20


def test_letter_bags_bound_every_common_subsequence():
    texts = ["", "aab", "ab\ud800", "日本語", "baa b"]
    bags = sp.LetterBags(texts)
    counts = [[sum(min(a.count(ch), b.count(ch)) for ch in set(a)) for b in texts] for a in texts]
    assert (bags.rows(texts) @ bags.rows(texts).T).astype(int).tolist() == counts
    assert bags.rows(["zz"]).sum() == 0 and sp.LetterBags([]).rows(["a"]).shape == (1, 1)


def test_suggestions_and_words(spark):
    vocabulary = vocab_of(spark, {"receive": 9, "receiver": 2, "deceive": 5, "recieve": 1})
    dictionary = words_of(spark, ["receive", "receiver", "deceive", "hello"])
    ranked = sp.suggest(words_of(spark, ["recieve"]), vocabulary).orderBy("rank").collect()
    assert [r.suggestion for r in ranked][0] == "receive"
    out = {r.word: (r.corrected, round(r.confidence, 3), r.method) for r in sp.correct_words(
        words_of(spark, ["recieve", "helllo", "zqzqzq", "HELLO"]), dictionary, vocabulary, 0.7).collect()}
    assert out["recieve"] == ("receive", round(1 - 2 / 7, 3), "suggestion")
    assert out["hello"] == ("hello", 1.0, "known")
    assert out["zqzqzq"] == ("zqzqzq", 0.0, "none")
    assert out["helllo"][2] == "none"  # one l is left: helo is no word


def test_vocabulary_from_first_rows_and_export(spark):
    texts = spark.createDataFrame([(2, "c c"), (0, "It's a-b 1x"), (1, "B b")], "n int, t string")
    freq = lambda df: {r.word: r.freq for r in df.collect()}
    assert freq(sp.learn_vocabulary(texts, "t")) == {"it": 1, "s": 1, "a": 1, "b": 3, "c": 2}
    assert freq(sp.learn_vocabulary(texts, "t", 2, ["n"])) == {"it": 1, "s": 1, "a": 1, "b": 3}
    assert [r.word for r in sp.export_vocabulary(sp.learn_vocabulary(texts, "t"), 3).collect()] == ["b", "c", "a"]
    terms = vocab_of(spark, {"often": 3, "rarely": 2, "four": 9})
    assert [r.word for r in sp.domain_terms(terms).collect()] == ["often"]
    merged = sp.merge_dictionary(words_of(spark, ["often"]), words_of(spark, ["OFTEN", "New"]))
    assert sorted(r.word for r in merged.collect()) == ["new", "often"]


def test_checker_table(spark):
    checker = spark.createDataFrame([("teh", "the", 1)], "word string, suggestion string, position int")
    got = sp.correct_words(words_of(spark, ["teh"]), words_of(spark, ["the"]), vocab_of(spark, {"other": 1}), 0.3, checker)
    assert got.first().corrected == "the"


def test_correct_text(spark):
    vocabulary = vocab_of(spark, {"receive": 9, "weather": 7})
    dictionary = words_of(spark, ["receive", "weather", "what"])
    texts = spark.createDataFrame(
        [(1, "RECIEVE  the Weathr, recieve!"), (2, "wwwhat"), (3, "mIxed Recieve9 été")],
        "text_id long, text string",
    )
    out = {r.text_id: r for r in sp.correct_text(texts, dictionary, vocabulary).collect()}
    assert out[1].corrected_text == "RECEIVE the Weather, receive!"
    assert [(c.original, c.corrected, c.position) for c in out[1].corrections] == [
        ("RECIEVE", "RECEIVE", 0), ("Weathr", "Weather", 12), ("recieve", "receive", 20)
    ]
    assert out[1].correction_count == 3
    assert (out[2].corrected_text, out[2].has_corrections, out[2].corrections) == ("what", False, [])
    assert out[3].corrected_text == "mIxed Recieve9 été"


# --- embedding


def test_embedding_reuse(spark):
    enc = em.HashingEncoder(16)
    old = spark.createDataFrame([("alpha beta",), ("gamma",)], "t string")
    now = spark.createDataFrame([("alpha beta",), ("alpha beta",), ("delta",), ("",)], "t string")
    store = em.embed_distinct(old, "t", enc, enc.name)
    merged = em.embed_incremental(now, store, "t", enc, enc.name)
    assert sorted(r.reused for r in merged.collect()) == [False, False, True]
    assert tuple(em.reuse_report(now, store, "t", enc.name).first()) == (4, 2, 50.0)
    back = em.attach(now, merged.drop("reused"), "t", enc.name).collect()
    direct = {r.t: r.embedding for r in em.embed(now, "t", lambda: em.HashingEncoder(16)).collect()}
    assert all(r.embedding == direct[r.t] for r in back)


def test_validate(spark):
    v = spark.createDataFrame([([0.6, 0.8],)] * 30, "embedding array<float>")
    status = lambda n, dim=2, model="m", data="d": em.validate(v, n, dim, "m", model, "d", data).first().status
    assert [status(30), status(25), status(35), status(41), status(19)] == [
        "ok", "truncate", "too_few_rows", "count_changed", "count_changed"
    ]
    assert [status(30, 3), status(30, model="x"), status(30, data="x")] == [
        "bad_vectors", "model_changed", "dataset_changed"
    ]


# --- cascade


def test_guard(spark):
    df = spark.createDataFrame([(1, "  "), (2, " ab "), (3, "abc")], "query_id long, query string")
    assert {r.query_id: r.response for r in guard(df).collect()} == {2: GUARD_MESSAGE, 3: None}


def test_cascade_stages(spark):
    items = spark.createDataFrame(
        [
            (0, "u", [("how does tomorrow weather influence harvest planning", "it depends on the rain")]),
            (1, "u", [("which document proves ownership of registered vehicles", "the registration paper")]),
            (2, "u", [("how does tomorrow weather influence harvest planning in winter", "not at all, mostly")]),
            (3, "u", [("where does tomorrow weather influence harvest", "in the northern valleys")]),
        ],
        "item_id long, url string, faq_pairs array<struct<question:string,answer:string>>",
    )
    known = build_knowledge(items)
    asked = {
        1: "How does tomorrow weather influence harvest planning?",
        2: "how does tomorow wether influense harvst planing",
        3: "whixh documxnt provxs ownershxp xf regixtered vehxcles",
        4: "zz",
        5: "completely unrelated banana bread recipe",
        6: "   ",
    }
    rows = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    got = {r.query_id: r for r in answer(rows.unionByName(rows.where("query_id = 1").selectExpr("7L as query_id", "query")), known).collect()}
    assert (got[1].stage, got[1].answer, got[1].similarity) == ("semantic", "it depends on the rain", 1.0)
    assert got[1].confidence == "High" and got[7].answer == got[1].answer
    assert got[2].answer and got[2].stage.startswith("spell_")
    assert (got[3].stage[:6], got[3].answer) == ("spell_", "the registration paper")
    assert (got[4].stage, got[4].response) == ("guard", GUARD_MESSAGE)
    assert (got[5].stage, got[5].answer, got[5].response) == ("none", None, NO_ANSWER_MESSAGE)
    assert 6 not in got


@pytest.mark.parametrize("limit, size, stage", [(300, 299, "fuzzy"), (300, 300, "none"), (None, 350, "fuzzy")])
def test_fuzzy_length_limit(spark, limit, size, stage):
    question = ("abcdefgh " * 40)[:size]
    corpus = spark.createDataFrame(
        [(0, question, "the answer", [1.0, 0.0])],
        "faq_id long, question string, answer string, embedding array<float>",
    )

    class Blind:
        name, dim = "blind", 2

        def encode(self, texts, normalize=True):
            return np.tile([0.0, 1.0], (len(texts), 1))

    empty = vocab_of(spark, {"none": 1}).where("false")
    known = Knowledge(corpus, empty.select("word"), empty, Blind(), fuzzy_below=limit)
    asked = spark.createDataFrame([(1, question)], "query_id long, query string")
    # strip may shorten a trailing blank: compare on the stripped length
    assert len(question.strip()) == size
    assert answer(asked, known).first().stage == stage


@pytest.mark.parametrize("limit, size, stage", [(200, 199, "spell_semantic"), (200, 200, "none"), (None, 349, "spell_semantic")])
def test_spelling_length_limit(spark, limit, size, stage):
    """One misspelt word makes the encoder miss; correcting it finds the question."""
    tail = (" abcdefgh" * 40)[: size - len("recieve")]
    good = ("receive" + tail).strip()

    class Exact:
        name, dim = "exact", 2

        def encode(self, texts, normalize=True):
            return np.array([[1.0, 0.0] if t == good else [0.0, 1.0] for t in texts])

    corpus = spark.createDataFrame(
        [(0, "short question", "the answer", [1.0, 0.0])],
        "faq_id long, question string, answer string, embedding array<float>",
    )
    words = words_of(spark, ["receive", *set(good.split())])
    known = Knowledge(corpus, words, vocab_of(spark, {"receive": 5}), Exact(), spell_below=limit)
    asked = spark.createDataFrame([(1, "recieve" + tail)], "query_id long, query string")
    assert len(("recieve" + tail).strip()) == size
    assert answer(asked, known).first().stage == stage


def test_correction_goes_on_until_nothing_is_new(spark):
    """Each round repairs one step of a chain of six words; a circle ends as well."""
    words = ["abcdefghij", "abcdefghik", "abcdefghlk", "abcdefgmlk", "abcdefnmlk", "abcdeonmlk"]

    class Last:
        name, dim = "last", 2

        def encode(self, texts, normalize=True):
            return np.array([[1.0, 0.0] if t == words[-1] else [0.0, 1.0] for t in texts])

    corpus = spark.createDataFrame(
        [(0, "zzzz", "the answer", [1.0, 0.0])], "faq_id long, question string, answer string, embedding array<float>"
    )
    checker = spark.createDataFrame([(a, b, 0) for a, b in zip(words, words[1:])], "word string, suggestion string, position int")
    none = vocab_of(spark, {"none": 1}).where("false")
    known = Knowledge(corpus, none.select("word"), none, Last(), checker=checker)
    asked = spark.createDataFrame([(1, words[0])], "query_id long, query string")
    got = answer(asked, known).first()
    assert (got.stage, got.answer) == ("spell_semantic", "the answer")
    circle = checker.where(F.col("suggestion") != words[-1]).unionByName(
        spark.createDataFrame([(words[1], words[0], 0), (words[3], words[2], 0)], checker.schema)
    )
    assert answer(asked, Knowledge(corpus, none.select("word"), none, Last(), checker=circle)).first().stage == "none"


def test_two_factories_of_one_name(spark):
    class Constant:
        def __init__(self, value):
            self.name, self.dim, self.value = "constant", 1, value

        def encode(self, texts, normalize=True):
            return np.full((len(texts), 1), self.value)

    one, two = (lambda: Constant(1.0)), (lambda: Constant(2.0))
    texts = spark.createDataFrame([(1, "x")], "id long, text string").coalesce(1)
    assert [em.embed(texts, "text", f).first().embedding[0] for f in (one, two)] == [1.0, 2.0]


def _known(spark):
    class Exact:
        name, dim = "exact", 2

        def encode(self, texts, normalize=True):
            return np.array([[1.0, 0.0] if "shipping" in t else [0.0, 1.0] for t in texts])

    corpus = spark.createDataFrame(
        [(0, "about shipping costs", "the answer", [1.0, 0.0])],
        "faq_id long, question string, answer string, embedding array<float>",
    )
    none = vocab_of(spark, {"none": 1}).where("false")
    return Knowledge(corpus, none.select("word"), none, Exact())


def test_a_batch_is_evaluated_as_one_job(spark):
    asked = spark.createDataFrame(
        [(1, "shipping please"), (2, "qqqq wwww"), (3, "??")], "query_id long, query string"
    )
    row = evaluate(asked, _known(spark)).first()
    # the guard's message counts as a success
    assert (row.queries, row.successes) == (3, 2) and row.success_rate == pytest.approx(200 / 3) and row.avg_ms > 0
    assert evaluate(asked.where("false"), _known(spark)).first().queries == 0


def test_a_stream_answers_with_the_cascade_and_writes_the_history(spark):
    source = scratch_path(spark, "asked")
    for rows in ([(7, 1, "shipping one"), (7, 2, "qqqq wwww")], [(7, 3, "shipping two"), (8, 4, "shipping three")]):
        spark.createDataFrame(rows, schemas.CHAT_QUERY).coalesce(1).write.mode("append").parquet(source)
    out, history = scratch_path(spark, "answers"), scratch_path(spark, "history")
    known = _known(spark)
    stream = jobs.converse(
        jobs.read_files(spark, source, schemas.CHAT_QUERY), lambda batch: answer(batch, known), out, history, scratch_path(spark, "state")
    )
    assert stream.awaitTermination(600)
    told = sorted((r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(history).collect())
    assert told == [
        (7, 0, "user", "shipping one"), (7, 1, "assistant", "the answer"), (7, 2, "user", "qqqq wwww"), (7, 3, "assistant", NO_ANSWER_MESSAGE),
        (7, 4, "user", "shipping two"), (7, 5, "assistant", "the answer"), (8, 0, "user", "shipping three"), (8, 1, "assistant", "the answer"),
    ]


def test_stored_vectors_are_checked_when_loaded(spark):
    path = scratch_path(spark, "vectors")
    store = spark.createDataFrame([(f"{n:03d}", [1.0, 0.0]) for n in range(30)], "key string, embedding array<float>")
    tb.write_vectors(store, path, "m", "d", None, F.current_timestamp())

    def loaded(rows, dim=2, model="m", dataset="d"):
        found = tb.load_vectors(spark, path, rows, dim, model, dataset)
        return None if found is None else sorted(r.key for r in found.collect())

    assert loaded(30) == [f"{n:03d}" for n in range(30)]
    assert loaded(25) == [f"{n:03d}" for n in range(25)]
    assert [loaded(31), loaded(5), loaded(30, dim=3), loaded(30, model="x"), loaded(30, dataset="x")] == [None] * 5


def test_confidence_forms(spark):
    pairs = spark.createDataFrame([("kitten", "sitting"), ("same", "same"), ("", "a")], "word string, suggestion string")
    ratio = {r.word: r.confidence for r in sp.confidence(pairs, method="ratio").collect()}
    assert ratio == {"kitten": 0.62, "same": 1.0, "": 0.0}
    assert {r.word: r.confidence for r in sp.confidence(pairs).collect()}["kitten"] == pytest.approx(1 - 3 / 7)


def test_probed_buckets_of_a_table_are_in_few_groups(spark):
    """Dealt by a hash, a query's buckets were in nearly as many groups, each with its vector."""
    planes = np.random.default_rng(0).normal(0, 1, (9, 10, 16))
    group, groups = ve._bucket_groups(300_000, planes, 8)
    assert groups == 9 * 8  # 300,000 rows by 3 bits: some 37,500 a group
    rng = np.random.default_rng(1)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(0, 1, (200, 16)))], "query_id long, embedding array<double>")
    probed = queries.select("query_id", F.explode(ve._probed_buckets(queries, planes, 14)("embedding")).alias("place"))
    probed = probed.withColumn("group", group("place")).withColumn("table", F.col("place") % 9)
    assert probed.where("group < 0 OR group >= 72").isEmpty()
    assert probed.groupBy("group").agg(F.countDistinct("table").alias("n")).where("n > 1").isEmpty()
    copies = probed.select("query_id", "group").distinct().count() / 200
    assert 9 <= copies < 50  # a hash: some 60 of 72


def test_top_cells_rounds_only_what_can_be_among_the_best():
    rng = np.random.default_rng(2)
    raw = rng.normal(0, 1, (30, 400))
    raw[:, 200:] = raw[:, :200] + rng.choice([0, 3e-13, -3e-13, 1e-12], (30, 200))  # ties once rounded
    for k in (1, 2, 7, 399, 400, 500):
        for got, want in zip(top_cells(raw, k, 12), top_cells(np.round(raw, 12), k)):
            assert np.array_equal(got, want)
