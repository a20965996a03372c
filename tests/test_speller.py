"""The deletion-neighbourhood spell checker against the edit distance of all pairs."""

import random

import pytest

from quaestor.operators import speller
from quaestor.operators import spelling as sp


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(seed, n, low, high, letters="abc"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(n)]


def changed(seed, given):
    rng = random.Random(seed)
    out = []
    for word in given:
        letters = list(word)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(letters) + 1)
            kind = rng.randrange(3)
            letters[at : at + (kind > 0)] = [] if kind == 1 else [rng.choice("abcz")]
        out.append("".join(letters))
    return out


@pytest.mark.parametrize("distance", [1, 2])
def test_equals_all_pairs(spark, distance):
    known = sorted({*words(1, 150, 1, 7), *words(2, 80, 12, 40), "", "é", "\U0001f600x", "a" * 60})
    asked = sorted({*changed(3, known), *known[:20], "", "ab" * 200})
    frame = lambda w: spark.createDataFrame([(x,) for x in w], "word string")
    got = speller.within(frame(asked + asked[:5]), speller.index(frame(known), distance), distance).collect()
    want = {(a, k, e) for a in asked for k in known if abs(len(a) - len(k)) <= distance and (e := edits(a, k)) <= distance}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(len(a) > speller.LONG + 2 and e for a, _, e in want)


def test_check_feeds_suggestions(spark):
    vocabulary = spark.createDataFrame([("hello", 5), ("help", 9), ("hells", 5), ("world", 3), ("x", 1)], "word string, freq long")
    asked = spark.createDataFrame([("helo",), ("wrld",), ("zzzzzzz",), (None,)], "word string")
    found = speller.check(asked, vocabulary)
    rows = {(r.word, r.position): (r.suggestion, r.edits, r.freq) for r in found.collect()}
    # fewest edits, then the more frequent, then the alphabet
    assert rows == {
        ("helo", 1): ("help", 1, 9), ("helo", 2): ("hello", 1, 5), ("helo", 3): ("hells", 2, 5), ("wrld", 1): ("world", 1, 3),
    }
    best = sp.suggest(asked.where("word IS NOT NULL"), vocabulary, checker=found)
    assert {r.suggestion for r in best.where("word = 'helo'").collect()} == {"hello", "help", "hells"}


def test_no_pairing_of_all(spark):
    frame = spark.createDataFrame([("abc",)], "word string")
    plan = speller.within(frame, speller.index(frame))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("Join Inner") == 2


def test_empty(spark):
    none = spark.createDataFrame([], "word string, freq long")
    some = spark.createDataFrame([("abc", 1)], "word string, freq long")
    assert speller.check(none, some).collect() == [] and speller.check(some, none).collect() == []
