"""Quality rules as a ledger: every rule is evaluated once, its outcome is one bit.

`ledger` scans each whole text once and stores the measurements with a bitmask of failed
rules. Policies are versioned sets of rules; applying one, or asking what a policy would keep
without one of its rules, is bit arithmetic on the ledger and never reads a text again.

Defined cases: a null text measures zero everywhere and fails `few_words`; a text of white
space likewise; copies are measured alike; an empty table gives an empty ledger.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.arrays import map_slices

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Fails where `fails` holds; the bit is its place in RULES and never changes."""

    name: str
    bit: int
    fails: Column | str


# integer comparisons only: the same outcome on every engine
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", 2, "word_chars < 2 * n_words"),
    Rule("long_words", 3, "word_chars > 15 * n_words"),
    Rule("symbols", 4, "100 * n_symbols > 20 * n_words"),
    Rule("repeated_lines", 5, "n_dup_lines >= 5 AND 50 * n_dup_lines > n_words"),
)
BASE = ("few_words", "repeated_words")
POLICIES = {
    1: BASE,
    2: (*BASE, "short_words", "long_words"),
    3: (*BASE, "short_words", "long_words", "symbols", "repeated_lines"),
}
CURRENT = 3


def _repeated(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    _, pair = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def _measure(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes: exactly the six ASCII white spaces
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words)


def _measures(part: pa.RecordBatch) -> dict:
    rows = [_measure(t) for t in part.column("text").to_pylist()]
    table = np.array(rows, np.int64).reshape(-1, len(MEASURES))
    return {"doc_id": part.column("doc_id")} | {m: pa.array(table[:, i].copy()) for i, m in enumerate(MEASURES)}


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: its id and the measurements of its whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(
        docs.select("doc_id", "text"), _measures, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and `failed`, the bitmask of the rules that the text fails."""
    failed = F.lit(0).cast("long")
    for rule in rules:
        fails = F.expr(rule.fails) if isinstance(rule.fails, str) else rule.fails
        failed = failed.bitwiseOR(F.when(fails, F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failed", failed)


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of the named rules."""
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in names)


def passes(policy: int) -> Column:
    """Whether a ledger row passes every rule of a policy version."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame, policy: int = CURRENT) -> DataFrame:
    """Per rule of a policy: documents it fails, documents it alone fails, and what the policy
    keeps with and without it. One pass; one row per distinct bitmask leaves each task."""
    all_bits = mask(POLICIES[policy])
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(all_bits)).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).cast("long").alias("bit")) for n in POLICIES[policy]])
    )
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    kept = F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0))
    return (
        patterns.select("bits", "n", rule.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"),
            kept.alias("n_kept"),
            (kept + F.sum(F.when(alone, F.col("n")).otherwise(0))).alias("n_kept_without"),
        )
    )


def all_ablations(rows: DataFrame) -> DataFrame:
    """`ablations` of every policy version, with `policy`, over a ledger that is best stored."""
    parts = [ablations(rows, p).select(F.lit(p).alias("policy"), "*") for p in POLICIES]
    return functools.reduce(DataFrame.unionByName, parts)


def judge(docs: DataFrame, policy: int = CURRENT) -> DataFrame:
    """The ledger with `base_failed` and the policy's verdict `kept`."""
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    return ledger(docs).withColumns({"base_failed": base, "kept": ~base & passes(policy)})
