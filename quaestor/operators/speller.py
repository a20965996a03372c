"""A spell checker of the corpus's own: deletion-neighbourhood index over a vocabulary.

Two words within DISTANCE edits (insertion, deletion, replacement) become equal when up to
DISTANCE letters are deleted from each. So the index holds every vocabulary word under each form
that it has with so many letters deleted, a word is looked up by its own such forms, and an
equality join yields the candidates: vocabulary and words are never paired otherwise. Each
candidate is then verified by its edit distance.

A word of n letters has about n ** 2 / 2 forms. Above LONG letters, where that grows, the index holds
DISTANCE + 1 pieces of the word instead: of so many pieces one stays whole, at most DISTANCE letters
away from its place. Exact at every length, with keys in proportion to DISTANCE ** 2 there.

How many words share a form depends on the alphabet, not on the table: of n letters at most
(n + 2) ** 2 / 2 * alphabet ** 2. Spark splits such a key in the join if it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.operators.blocks import best_per
from quaestor.session import cut

DISTANCE = 2
LONG = 16  # letters of a vocabulary word, up to which its deletions are indexed
SUGGESTIONS = 3


def _one_less(word: Column) -> Column:
    """All forms of a word with one letter deleted."""
    places = F.sequence(F.lit(1), F.length(word))
    less = F.transform(places, lambda k: F.concat(F.substring(word, 1, k - 1), F.substring(word, k + 1, F.length(word))))
    return F.when(F.length(word) > 0, less).otherwise(F.array().cast("array<string>"))


def forms(word: Column, distance: int = DISTANCE) -> Column:
    """The word with up to `distance` letters deleted."""
    out = level = F.array(word)
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, _one_less)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def _piece_start(size: Column, piece: Column, distance: int) -> Column:
    return F.floor(piece * size / (distance + 1)).cast("int")


def pieces(word: Column, distance: int = DISTANCE) -> Column:
    """(size, piece, text) of a vocabulary word cut into distance + 1 pieces."""
    size = F.length(word)

    def piece(k: Column) -> Column:
        start, end = _piece_start(size, k, distance), _piece_start(size, k + 1, distance)
        return F.struct(size.alias("size"), k.alias("piece"), F.substring(word, start + 1, end - start).alias("text"))

    return F.transform(F.sequence(F.lit(0), F.lit(distance)), piece)


def _places(word: Column, distance: int) -> Column:
    """What `pieces` may hold for a word within `distance`: every size, piece and shift."""
    sizes = F.sequence(F.length(word) - distance, F.length(word) + distance)
    shifts = F.sequence(F.lit(-distance), F.lit(distance))

    def at(size: Column, k: Column, shift: Column) -> Column:
        start, end = _piece_start(size, k, distance), _piece_start(size, k + 1, distance)
        # a place before the first letter holds no piece
        text = F.when(start + shift >= 0, F.substring(word, start + shift + 1, end - start))
        return F.struct(size.alias("size"), k.alias("piece"), text.alias("text"))

    pieces_ = F.sequence(F.lit(0), F.lit(distance))
    of_size = lambda size: F.flatten(F.transform(pieces_, lambda k: F.transform(shifts, lambda d: at(size, k, d))))
    found = F.filter(F.flatten(F.transform(sizes, of_size)), lambda p: (p["size"] > LONG) & p["text"].isNotNull())
    return F.array_distinct(found)


def index(vocabulary: DataFrame, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """The index of a vocabulary (`word`), to be written and used again: (form, known) of its
    ordinary words, (size, piece, text, known) of its long ones."""
    words = vocabulary.select("word").distinct()
    short = words.where(F.length("word") <= LONG).select(F.explode(forms(F.col("word"), distance)).alias("form"), F.col("word").alias("known"))
    long = words.where(F.length("word") > LONG).select(F.inline(pieces(F.col("word"), distance)), F.col("word").alias("known"))
    return short, long


def within(words: DataFrame, indexed: tuple[DataFrame, DataFrame], distance: int = DISTANCE) -> DataFrame:
    """All (word, known, edits) of at most `distance` edits; a word is looked up once."""
    short, long = indexed
    words = words.select("word").distinct()
    near_short = words.where(F.length("word") <= LONG + distance).select("word", F.explode(forms(F.col("word"), distance)).alias("form"))
    near_long = words.where(F.length("word") > LONG - distance).select("word", F.inline(_places(F.col("word"), distance)))
    met = near_short.join(short, "form").select("word", "known").unionByName(
        near_long.join(long, ["size", "piece", "text"]).select("word", "known")
    )
    # most candidates meet under several forms: verified first, distinct after
    edits = F.levenshtein("word", "known", distance)
    return met.withColumn("edits", edits).where("edits >= 0").distinct()


def check(
    words: DataFrame,
    vocabulary: DataFrame,
    distance: int = DISTANCE,
    k: int = SUGGESTIONS,
    indexed: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Best k known words per word: (word, suggestion, position, edits, freq), fewest edits first,
    then the more frequent, then by the alphabet. `vocabulary` is (word, freq). The columns word,
    suggestion, position are what `suggest(checker=...)` takes."""
    found = within(words, indexed or index(vocabulary, distance), distance)
    counted = found.join(vocabulary.select(F.col("word").alias("known"), "freq"), "known")
    order = [F.asc("edits"), F.desc("freq"), F.asc("known")]
    ranked = best_per(counted, "word", order, k, "position")
    return ranked.select("word", F.col("known").alias("suggestion"), F.col("position").cast("long").alias("position"), F.col("edits").cast("long").alias("edits"), "freq")


def stored_check(words: DataFrame, vocabulary: DataFrame, **options) -> DataFrame:
    """`check`, computed once: for jobs that read the suggestions several times."""
    return cut(check(words, vocabulary, **options))
