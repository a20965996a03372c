import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaestor import schemas
from quaestor.functions import text as tx
from quaestor.operators import corpus as co
from quaestor.operators import ordering
from quaestor.operators import stats
from quaestor.sources import tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_extract_defaults_and_order(spark):
    items = spark.createDataFrame(
        [
            (1, "u1", [("\t q one ", " a "), (None, "x")]),
            (0, None, [("first", None)]),
            (2, "u2", []),
            (3, "u3", None),
        ],
        schemas.ITEM,
    )
    got = rows(co.extract_pairs(items), "item_id", "pair_pos")
    assert got == [(0, 0, "first", "", ""), (1, 0, "q one", "a", "u1"), (1, 1, "", "x", "u1")]


@pytest.mark.parametrize(
    "question, answer, kept",
    [
        ("q" * 5, "a" * 11, False),
        ("q" * 6, "a" * 11, True),
        ("q" * 6, "a" * 10, False),
        ("q" * 999, "a" * 11, True),
        ("q" * 1000, "a" * 11, False),
        ("http://x", "a" * 11, False),
        ("HTTP://x", "a" * 11, True),
    ],
)
def test_quality_boundaries(spark, question, answer, kept):
    df = spark.createDataFrame([(question, answer)], "question string, answer string")
    assert co.quality_filter(df).count() == int(kept)


def test_limit(spark):
    df = spark.range(10).repartition(4)
    assert [r[0] for r in co.limit_pairs(df, 3, ["id"]).collect()] == [0, 1, 2]
    for n in (None, 0, 99):
        assert co.limit_pairs(df, n, ["id"]).count() == 10


@pytest.mark.parametrize(
    "text, flags, want",
    [
        ("Hello, World! 123", {}, "hello world"),
        ("a1b", {}, "ab"),
        ("a-b", {}, "a b"),
        ("12?!", {}, ""),
        (None, {}, ""),
        ("A-b 1", {"lowercase": False}, "A b"),
        ("A-b 1", {"remove_punctuation": False}, "a-b"),
        ("A-b 1", {"remove_digits": False}, "a b 1"),
    ],
)
def test_clean(spark, text, flags, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.clean(F.col("t"), **flags)).first()[0] == want


TEXT = st.text(
    st.characters(min_codepoint=9, max_codepoint=0x2FF, exclude_characters="İ"), max_size=40
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=20, max_size=20))
def test_text_expressions_equal_python(spark, texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = df.select(
        tx.strip(F.col("t")), tx.words(F.col("t")), tx.repair(F.col("t")), tx.segments(F.col("t"))
    ).collect()
    for text, (stripped, words, repaired, parts) in zip(texts, got):
        assert stripped == text.strip()
        assert words == re.findall(r"\b[a-zA-Z]+\b", text.lower())
        want = re.sub(r"(.)\1{3,}", r"\1\1", text)
        want = re.sub(r"\s+", " ", want)
        want = re.sub(r"([bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ])\1{2,}", r"\1", want)
        assert repaired == want
        assert "".join(parts) == text


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([("A  b-C 12  x?",), ("...",)], "t string")
    once = df.select(tx.clean(F.col("t")).alias("t"))
    assert once.collect() == once.select(tx.clean(F.col("t"))).collect()


def test_history_pairs_and_append(spark):
    talk = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"),
         (2, 0, "user", "q3"), (2, 1, "user", "q4"), (2, 2, "assistant", "a4")],
        "conv_id long, turn long, role string, text string",
    )
    pairs = co.history_pairs(talk).select("conv_id", "turn", "question", "answer")
    assert rows(pairs, "conv_id") == [(1, 1, "q1", "a1"), (2, 1, "q4", "a4")]
    gaps = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 2, "assistant", "a"), (None, 1, "user", "n"), (None, 5, "assistant", "m")], talk.schema
    )
    assert {(r.question, r.answer) for r in co.history_pairs(gaps).collect()} >= {("q", "a")}
    new = spark.createDataFrame(
        [(1, 7, "x", "X"), (1, 8, "y", "Y"), (3, 9, "z", "Z")],
        "conv_id long, query_id long, question string, response string",
    )
    added = co.append_history(talk, new).where("(conv_id = 1 and turn > 3) or conv_id = 3")
    assert rows(added, "conv_id", "turn") == [
        (1, 4, "user", "x"), (1, 5, "assistant", "X"), (1, 6, "user", "y"), (1, 7, "assistant", "Y"),
        (3, 0, "user", "z"), (3, 1, "assistant", "Z"),
    ]


def test_dense_positions_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(13)
    got = ordering.dense_positions(df, [F.desc("v")]).collect()
    assert sorted((r.position, r.v) for r in got) == [(n, 999 - n) for n in range(1000)]


def test_running_sum_with_one_huge_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(F.lit(99)).alias("g"), "id"
    ).repartition(9)
    got = ordering.running_before(df, ["g"], ["id"], "id").collect()
    sums = {}
    for r in sorted(got, key=lambda r: r.id):
        assert r.before == sums.get(r.g, 0)
        sums[r.g] = sums.get(r.g, 0) + r.id


def test_eval_summary(spark):
    df = spark.createDataFrame(
        [("Please ask a more specific question.", 1.0), ("No relevant answer found from FAQs.", 3.0), ("", 2.0), (None, 2.0)],
        "response string, seconds double",
    )
    assert tuple(stats.eval_summary(df).first()) == (4, 1, 25.0, 2000.0)
    assert tuple(stats.eval_summary(df.where("false")).first()) == (0, 0, None, None)


def test_usage_stats_without_requests(spark):
    entries = spark.createDataFrame([], "size_bytes long, access_count long")
    hits = spark.createDataFrame([], "hit boolean")
    assert tuple(stats.usage_stats(entries, hits).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_snapshot_reuse(spark, tmp_path):
    corpus = spark.range(80).select(F.col("id").alias("faq_id"))
    tables.write_snapshot(corpus, str(tmp_path / "s"), "chat", 100, F.current_timestamp())
    assert tables.load_snapshot(spark, str(tmp_path / "s")).count() == 80
    assert tables.load_snapshot(spark, str(tmp_path / "s"), 100) is not None  # 0.8 * 80 rows expected
    tables.write_snapshot(corpus.where("false"), str(tmp_path / "e"), "chat", None, F.current_timestamp())
    assert tables.load_snapshot(spark, str(tmp_path / "e")) is None


def test_items_from_json(spark, tmp_path):
    (tmp_path / "i.json").write_text(
        '{"item_id": 1, "url": "u", "faq_pairs": [{"question": "what is it", "answer": "a long answer"}]}\n{"item_id": 2}\n'
    )
    corpus = co.build_corpus(tables.read_items(spark, str(tmp_path / "i.json"), "json"))
    assert [tuple(r) for r in corpus.collect()] == [(0, "what is it", "a long answer", "u", "what is it")]
