"""Vocabulary learning, unknown words, suggestions and text correction.

Every step works on the table of distinct words; texts are touched twice, once to take their
words and once to put corrections back.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions import text as tx
from quaestor.functions.strings import LetterBags, LetterCodes, char_masks, indel_score, lcs_length
from quaestor.operators.blocks import best_per, block_join
from quaestor.session import cut

# Fixed values.
DOMAIN_MIN_COUNT = 3
DOMAIN_LONGER_THAN = 4
SHORT_WORD = 2
SUGGEST_LONGER_THAN = 3
CLOSE_CUTOFF = 0.7
CLOSE_MATCHES = 3
HIGH_BAG = 0.85  # bags that are tried first
WORD_ROWS = 2_048
VOCABULARY_ROWS = 262_144
CELLS = 8_000_000  # common bags counted at a time
MAX_SUGGESTIONS = 5
RULE_CONFIDENCE = 0.9
WORD_THRESHOLD = 0.8
TEXT_THRESHOLD = 0.7

CORRECTIONS_TYPE = (
    "array<struct<original:string,corrected:string,confidence:double,position:int,method:string>>"
)
_PAIR_SCHEMA = "word string, suggestion string, ratio double"


# --- vocabulary ---------------------------------------------------------------------------


def learn_vocabulary(texts: DataFrame, column: str, first: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Word counts (word, freq). `first` learns only from the first rows under `order`."""
    if first:
        texts = texts.orderBy(*order).limit(first)
    return (
        texts.select(F.explode(tx.words(F.col(column))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("freq"))
    )


def domain_terms(vocabulary: DataFrame) -> DataFrame:
    """Frequent longer words: accepted without any dictionary."""
    return vocabulary.where(
        (F.col("freq") >= DOMAIN_MIN_COUNT) & (F.length("word") > DOMAIN_LONGER_THAN)
    ).select("word")


def merge_dictionary(dictionary: DataFrame, added: DataFrame) -> DataFrame:
    """Accepted words plus user words in lower case."""
    return (
        dictionary.select("word").unionByName(added.select(F.lower("word").alias("word"))).distinct()
    )


def export_vocabulary(vocabulary: DataFrame, n: int | None = None) -> DataFrame:
    """All words, or the n most frequent ones, ties in word order."""
    return vocabulary if n is None else vocabulary.orderBy(F.desc("freq"), F.asc("word")).limit(n)


def vocabulary_stats(vocabulary: DataFrame, dictionary: DataFrame) -> DataFrame:
    sides = vocabulary.agg(F.count("*").alias("learned_vocabulary_size")).unionByName(
        dictionary.agg(F.count_distinct("word").alias("custom_dictionary_size")),
        allowMissingColumns=True,
    )
    return sides.agg(
        F.sum("custom_dictionary_size").alias("custom_dictionary_size"),
        F.sum("learned_vocabulary_size").alias("learned_vocabulary_size"),
    ).withColumn("automatic_patterns", F.lit(len(tx.REPAIR_RULES)).cast("long"))


# --- unknown words ------------------------------------------------------------------------


def _needs_dictionary(word: Column) -> Column:
    return (F.length(word) > SHORT_WORD) & ~word.rlike(r"^\p{Nd}+$")


def unknown_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Distinct words (lower-cased, stripped) that no rule and no dictionary accepts."""
    word = tx.strip(F.lower("word"))
    distinct = words.select(word.alias("word")).where(_needs_dictionary(F.col("word"))).distinct()
    return distinct.join(dictionary.select("word").distinct(), "word", "left_anti")


def repaired_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Unknown words that one repair rule alone turns into an accepted word.

    The first rule that does so wins: (word, corrected, rule).
    """
    tries = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("rule"),
                F.regexp_replace("word", pattern, replacement).alias("corrected"),
            )
            for i, (pattern, replacement) in enumerate(tx.REPAIR_RULES, 1)
        ]
    )
    tried = words.select("word", F.inline(tries)).where(
        (F.col("corrected") != F.col("word")) & (F.length("corrected") > 1)
    )
    checked = tried.withColumn("_check", tx.strip(F.lower("corrected")))
    accepted = dictionary.select(F.col("word").alias("_check")).distinct()
    return (
        checked.join(accepted.withColumn("_listed", F.lit(True)), "_check", "left")
        .where(F.col("_listed") | ~_needs_dictionary(F.col("_check")))
        .groupBy("word")
        .agg(F.min(F.struct("rule", "corrected")).alias("_best"))
        .select("word", F.col("_best.corrected").alias("corrected"), F.col("_best.rule").alias("rule"))
    )


# --- suggestions --------------------------------------------------------------------------


def close_matches(
    words: DataFrame,
    vocabulary: DataFrame,
    n: int = CLOSE_MATCHES,
    cutoff: float = CLOSE_CUTOFF,
) -> DataFrame:
    """Best n vocabulary words per word by sequence ratio: (word, suggestion, ratio).

    Exact over the whole vocabulary. Blocks of words meet in one task each; inside a block
    first the common letter bag, then the common subsequence bound the ratio from above;
    candidates are tried from the highest bound down, and a word stops once its n-th ratio
    beats the next bound. Candidates of a high bag go first, and others only where their bag
    reaches the n-th ratio those gave.
    """
    pairs = block_join(
        words.select("word"),
        vocabulary.where(F.length("word") > SUGGEST_LONGER_THAN).select(
            F.col("word").alias("suggestion")
        ),
        "word",
        "suggestion",
        _close_blocks(n, cutoff),
        _PAIR_SCHEMA,
        left_rows=WORD_ROWS,
        right_rows=VOCABULARY_ROWS,
    )
    return best_per(pairs, "word", [F.desc("ratio"), F.desc("suggestion")], n).drop("rank")


def _close_blocks(n: int, cutoff: float):
    def run(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        if lhs.empty or rhs.empty:
            return _pairs([])
        words = sorted(lhs["word"], key=len)
        vocab = sorted(rhs["suggestion"], key=len)
        bags = LetterBags(vocab)
        table = bags.rows(vocab).T.copy()
        sizes = np.array([len(v) for v in vocab], dtype=np.float32)
        # words below 64 letters meet none that are longer
        codes = LetterCodes(vocab[: np.searchsorted(sizes, 64 * (2 - cutoff) / cutoff + 1, side="right")])
        out = []
        at = 0
        while at < len(words):
            size = len(words[at])
            # ratio <= 2 * shorter / sum, so only this span of lengths can reach the cutoff
            low = np.searchsorted(sizes, size * cutoff / (2 - cutoff) - 1e-6)
            high = np.searchsorted(sizes, size * (2 - cutoff) / cutoff + 1e-6, side="right")
            end, most = at, max(1, CELLS // max(1, high - low))
            while end < len(words) and len(words[end]) == size and end - at < most:
                end += 1
            group = words[at:end]
            at = end
            if low >= high:
                continue
            bag = bags.rows(group) @ table[:, low:high]
            hits = np.flatnonzero(bag >= (sizes[low:high] + size) * np.float32((cutoff - 1e-5) / 2))
            if not len(hits):
                continue
            rows, cols = np.divmod(hits, high - low)
            cols += low
            bound = 2.0 * bag.reshape(-1)[hits] / (size + sizes[cols].astype(np.float64))

            def tight(some: np.ndarray) -> np.ndarray:
                if size < 64:
                    common = codes.common(group, rows[some], cols[some], int(sizes[high - 1]))
                else:
                    masks = {r: char_masks(group[r]) for r in np.unique(rows[some])}
                    common = [lcs_length(masks[r], size, vocab[c]) for r, c in zip(rows[some], cols[some])]
                return 2.0 * np.asarray(common, np.int64) / (size + sizes[cols[some]].astype(np.float64))

            best: list[list[tuple[float, str]]] = [[] for _ in group]
            matchers = [SequenceMatcher(None, "", word) for word in group]

            def try_all(some: np.ndarray) -> None:
                reach = tight(some)
                some, reach = some[reach >= cutoff], reach[reach >= cutoff]
                starts = np.searchsorted(rows[some], np.arange(len(group) + 1))
                for i in np.unique(rows[some]).tolist():
                    mine = slice(starts[i], starts[i + 1])
                    tries = sorted(zip(reach[mine].tolist(), (vocab[c] for c in cols[some[mine]])), reverse=True)
                    _best_close(matchers[i], tries, best[i], n, cutoff)

            high_bag = bound >= HIGH_BAG
            try_all(np.flatnonzero(high_bag))
            floor = np.array([b[-1][0] if len(b) == n else cutoff for b in best])
            try_all(np.flatnonzero(~high_bag & (bound >= floor[rows])))
            out.extend((word, candidate, ratio) for word, found in zip(group, best) for ratio, candidate in found)
        return _pairs(out)

    return run


def _best_close(matcher, tries, best: list[tuple[float, str]], n: int, cutoff: float) -> None:
    """Puts the n best of `best` and `tries` into `best`; `tries` are (bound, candidate), highest
    bound first."""
    for bound, candidate in tries:
        if len(best) == n and bound < best[-1][0]:
            break
        matcher.set_seq1(candidate)
        ratio = matcher.ratio()
        if ratio >= cutoff:
            best.append((ratio, candidate))
            best.sort(reverse=True)
            del best[n:]


def _pairs(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["word", "suggestion", "ratio"]).astype(
        {"word": "object", "suggestion": "object", "ratio": "float64"}
    )


def suggest(
    words: DataFrame,
    vocabulary: DataFrame,
    checker: DataFrame | None = None,
    max_suggestions: int = MAX_SUGGESTIONS,
) -> DataFrame:
    """Ranked suggestions of unknown words: (word, rank, suggestion, freq, ratio).

    `checker` is an optional table (word, suggestion, position) of another spell checker,
    of which the first three per word count. Order: frequency, ratio, then word.
    """
    found = close_matches(words, vocabulary)
    if checker is not None:
        extra = (
            best_per(checker.join(words.select("word"), "word", "left_semi"), "word", [F.asc("position")], CLOSE_MATCHES)
            .select("word", "suggestion", F.lit(0.0).alias("ratio"))
        )
        found = found.unionByName(extra).groupBy("word", "suggestion").agg(F.max("ratio").alias("ratio"))
    counts = vocabulary.select(F.col("word").alias("_seen"), "freq")
    ranked = found.withColumn("_seen", F.lower("suggestion")).join(counts, "_seen", "left")
    ranked = ranked.withColumn("freq", F.coalesce("freq", F.lit(0)).cast("long"))
    return best_per(
        ranked, "word", [F.desc("freq"), F.desc("ratio"), F.asc("suggestion")], max_suggestions
    ).select("word", "rank", "suggestion", "freq", "ratio")


def confidence(
    pairs: DataFrame, original: str = "word", suggestion: str = "suggestion", method: str = "edit"
) -> DataFrame:
    """Confidence of a table of pairs: `edit` distance, or the `ratio` of the common subsequence
    to both lengths, in whole percent."""
    if method == "edit":
        return pairs.withColumn("confidence", tx.edit_confidence(F.col(original), F.col(suggestion)))
    if method != "ratio":
        raise ValueError(f"unknown confidence {method!r}")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([indel_score(x, y) / 100.0 for x, y in zip(a, b)], dtype="float64")

    return pairs.withColumn("confidence", ratio(F.col(original), F.col(suggestion)))


def correct_unknown(
    unknown: DataFrame,
    dictionary: DataFrame,
    vocabulary: DataFrame,
    threshold: float = WORD_THRESHOLD,
    checker: DataFrame | None = None,
) -> DataFrame:
    """Outcome for unknown words: (word, corrected, confidence, method)."""
    unknown = cut(unknown)  # distinct words; read four times below
    ruled = repaired_words(unknown, dictionary).select(
        "word", F.col("corrected").alias("_ruled")
    )
    rest = unknown.join(ruled, "word", "left_anti")
    best = (
        confidence(suggest(rest, vocabulary, checker, 1))
        .select("word", F.col("suggestion").alias("_best"), F.col("confidence").alias("_conf"))
    )
    return (
        unknown.join(ruled, "word", "left")
        .join(best, "word", "left")
        .select(
            "word",
            F.when(F.col("_ruled").isNotNull(), F.col("_ruled"))
            .when(F.col("_conf") >= threshold, F.col("_best"))
            .otherwise(F.col("word"))
            .alias("corrected"),
            F.when(F.col("_ruled").isNotNull(), F.lit(RULE_CONFIDENCE))
            .otherwise(F.coalesce("_conf", F.lit(0.0)))
            .alias("confidence"),
            F.when(F.col("_ruled").isNotNull(), "rule")
            .when(F.col("_best").isNotNull(), "suggestion")
            .otherwise("none")
            .alias("method"),
        )
    )


def correct_words(
    words: DataFrame,
    dictionary: DataFrame,
    vocabulary: DataFrame,
    threshold: float = WORD_THRESHOLD,
    checker: DataFrame | None = None,
) -> DataFrame:
    """Outcome for every distinct word; accepted words stay with confidence 1."""
    distinct = words.select(tx.strip(F.lower("word")).alias("word")).distinct()
    fixed = correct_unknown(
        unknown_words(distinct, dictionary), dictionary, vocabulary, threshold, checker
    )
    return distinct.join(fixed, "word", "left").select(
        "word",
        F.coalesce("corrected", "word").alias("corrected"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("method", F.lit("known")).alias("method"),
    )


# --- texts --------------------------------------------------------------------------------


def _marked(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    repaired = texts.select(
        F.col(text_id).alias("text_id"),
        F.coalesce(text, F.lit("")).alias("original_text"),
        tx.repair(F.coalesce(text, F.lit(""))).alias("_repaired"),
    )
    return repaired.withColumn("_parts", tx.segments(F.col("_repaired")))


def _text_words(marked: DataFrame) -> DataFrame:
    """(text_id, at, original, word): the words longer than two letters and their part number."""
    return (
        marked.select("text_id", F.posexplode("_parts").alias("at", "original"))
        .where(F.col("original").rlike("^[a-zA-Z]+$") & (F.length("original") > SHORT_WORD))
        .withColumn("word", F.lower("original"))
    )


def correct_text(
    texts: DataFrame,
    dictionary: DataFrame,
    vocabulary: DataFrame,
    text_id: str = "text_id",
    text: str = "text",
    threshold: float = TEXT_THRESHOLD,
    checker: DataFrame | None = None,
) -> DataFrame:
    """Repair, correct and rebuild texts."""
    outcomes = word_outcomes(texts, dictionary, vocabulary, text_id, text, threshold, checker)
    return apply_corrections(texts, accepted_corrections(outcomes, threshold), text_id, text)


def word_outcomes(
    texts: DataFrame,
    dictionary: DataFrame,
    vocabulary: DataFrame,
    text_id: str = "text_id",
    text: str = "text",
    threshold: float = TEXT_THRESHOLD,
    checker: DataFrame | None = None,
    decided: DataFrame | None = None,
) -> DataFrame:
    """Outcomes for the unknown words of texts; words in `decided` are taken from there."""
    words = _text_words(_marked(texts, text_id, text)).select("word")
    unknown = unknown_words(words, dictionary)
    if decided is None:
        return correct_unknown(unknown, dictionary, vocabulary, threshold, checker)
    fresh = unknown.join(decided, "word", "left_anti")
    return decided.unionByName(
        correct_unknown(fresh, dictionary, vocabulary, threshold, checker)
    )


def accepted_corrections(outcomes: DataFrame, threshold: float = TEXT_THRESHOLD) -> DataFrame:
    return outcomes.where(
        (F.col("corrected") != F.col("word")) & (F.col("confidence") >= threshold)
    )


def apply_corrections(
    texts: DataFrame, corrections: DataFrame, text_id: str = "text_id", text: str = "text"
) -> DataFrame:
    """Rebuild repaired texts with a table of word corrections (word, corrected, confidence).

    Only corrected words travel; they are gathered per text, whose size they cannot exceed,
    and replace the parts of the text they came from.
    """
    marked = _marked(texts, text_id, text)
    hits = _text_words(marked).join(
        corrections.select("word", "corrected", "confidence"), "word"
    )
    per_text = hits.groupBy("text_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "at",
                    "original",
                    tx.restore_case(F.col("original"), F.col("corrected")).alias("corrected"),
                    "confidence",
                )
            )
        ).alias("_hits")
    )
    joined = marked.join(per_text, "text_id", "left")

    def between(start, end):
        """Parts number start to end - 1 as one string."""
        return F.array_join(F.slice("_parts", start + 1, end - start), "")

    # each piece is the text since the last correction and the corrected word
    def piece(hit, n):
        after = F.when(n == 0, F.lit(0)).otherwise(F.get("_hits", n - 1)["at"] + 1)
        return F.concat(between(after, hit["at"]), hit["corrected"])

    rebuilt = F.concat(
        F.array_join(F.transform("_hits", piece), ""),
        between(F.element_at("_hits", -1)["at"] + 1, F.size("_parts")),
    )

    # one pass over the hits: (next part, its position, corrections so far)
    def place(done, hit):
        position = done["position"] + F.length(between(done["next"], hit["at"]))
        entry = F.struct(
            hit["original"].alias("original"),
            hit["corrected"].alias("corrected"),
            hit["confidence"].alias("confidence"),
            position.alias("position"),
            F.lit("automatic").alias("method"),
        )
        return F.struct(
            (hit["at"] + 1).alias("next"),
            (position + F.length(hit["original"])).alias("position"),
            F.concat(done["found"], F.array(entry)).alias("found"),
        )

    none = F.array().cast(CORRECTIONS_TYPE)
    start = F.struct(F.lit(0).alias("next"), F.lit(0).alias("position"), none.alias("found"))
    listed = F.aggregate("_hits", start, place, lambda done: done["found"])
    corrected = F.col("_hits").isNotNull()
    return joined.select(
        "text_id",
        "original_text",
        F.when(corrected, rebuilt).otherwise(F.col("_repaired")).alias("corrected_text"),
        F.when(corrected, listed).otherwise(none).alias("corrections"),
        corrected.alias("has_corrections"),
        F.when(corrected, F.size("_hits")).otherwise(F.lit(0)).cast("long").alias("correction_count"),
    )
