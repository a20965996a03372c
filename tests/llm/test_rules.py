import re
from collections import Counter

from quaestor.llm import rules

from .common import ODD, docs


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )


def test_measures_and_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [*ODD, (20, clean), (21, clean.replace(" ", " | ")), (22, "a b c d a b c x"), (23, "x\nx\n\n x\nx y\nx y"), (24, "a a a a")]
    table = docs(spark, rows, extra=True)
    out = rules.judge(table).collect()
    want = sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, *(r[m] for m in rules.MEASURES)) for r in out), key=str) == want
    by_id = {r.doc_id: r for r in out}
    assert by_id[20].kept and not by_id[20].base_failed
    assert not by_id[21].kept and not by_id[21].base_failed and by_id[21].failed == 16
    assert by_id[1].base_failed and not by_id[1].kept


def test_ablations_equal_recounting(spark):
    table = docs(spark, [(i, " ".join(["w"] * (i % 7) + [f"x{k}" for k in range(i)] + ["#"] * (i % 5) * 6)) for i in range(90)])
    rows = rules.ledger(table).cache()
    found = {r.rule: r for r in rules.ablations(rows).collect()}
    masks = [r.failed for r in rows.collect()]
    for name in rules.POLICIES[rules.CURRENT]:
        bit = rules.mask((name,))
        assert found[name].n_failed == sum(bool(m & bit) for m in masks)
        assert found[name].n_kept_without == sum(not m & ~bit for m in masks)


def test_every_policy_has_its_ablations(spark):
    table = docs(spark, [(i, " ".join(["w"] * (i % 7) + [f"x{k}" for k in range(i)] + ["#"] * (i % 5) * 6)) for i in range(90)])
    rows = rules.ledger(table).cache()
    masks = [r.failed for r in rows.collect()]
    found = {(r.policy, r.rule): r for r in rules.all_ablations(rows).collect()}
    assert set(found) == {(p, name) for p, names in rules.POLICIES.items() for name in names}
    for (policy, name), r in found.items():
        bits, bit = rules.mask(rules.POLICIES[policy]), rules.mask((name,))
        assert r.n_kept == sum(not m & bits for m in masks)
        assert r.n_failed_alone == sum(m & bits == bit for m in masks) == r.n_kept_without - r.n_kept


def test_empty(spark):
    assert rules.judge(docs(spark, [])).collect() == []
    assert rules.ablations(rules.ledger(docs(spark, []))).collect() == []
