"""From nested items or chat history to a clean question/answer corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import text as tx
from quaestor.operators.ordering import dense_positions, running_before


def extract_pairs(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """One row per nested pair, in item order then pair order. Missing parts become ''."""
    return items.select(
        F.col(item_id).alias("item_id"),
        F.coalesce("url", F.lit("")).alias("source_url"),
        F.posexplode("faq_pairs").alias("pair_pos", "pair"),
    ).select(
        "item_id",
        "pair_pos",
        tx.strip(F.col("pair.question")).alias("question"),
        tx.strip(F.col("pair.answer")).alias("answer"),
        "source_url",
    )


def quality_filter(pairs: DataFrame) -> DataFrame:
    """Keep pairs with a real question (6 to 999 characters, no link) and answer (> 10)."""
    q, a = F.col("question"), F.col("answer")
    return pairs.where(
        (F.length(q) > 5) & (F.length(a) > 10) & ~q.startswith("http") & (F.length(q) < 1000)
    )


def limit_pairs(pairs: DataFrame, max_faqs: int | None, order: list[str]) -> DataFrame:
    """The first `max_faqs` pairs in source order; None or 0 keeps all."""
    return pairs.orderBy(*order).limit(max_faqs) if max_faqs else pairs


def assign_ids(pairs: DataFrame, order: list[str], out: str = "faq_id") -> DataFrame:
    """Dense 0-based row identity in source order."""
    return dense_positions(pairs, order, out)


def clean_questions(
    corpus: DataFrame,
    lowercase: bool = True,
    remove_punctuation: bool = True,
    remove_digits: bool = True,
    source: str = "question",
    out: str = "question_clean",
) -> DataFrame:
    return corpus.withColumn(
        out, tx.clean(F.col(source), lowercase, remove_punctuation, remove_digits)
    )


def build_corpus(
    items: DataFrame, max_faqs: int | None = None, item_id: str = "item_id"
) -> DataFrame:
    """extract, filter, limit, number and clean."""
    order = ["item_id", "pair_pos"]
    pairs = limit_pairs(quality_filter(extract_pairs(items, item_id)), max_faqs, order)
    numbered = assign_ids(pairs, order)
    return clean_questions(
        numbered.select("faq_id", "question", "answer", "source_url")
    )


def history_pairs(
    history: DataFrame, user_role: str = "user", reply_role: str = "assistant"
) -> DataFrame:
    """Pair each user turn with the reply in the next row of the same conversation.

    Turn numbers may have gaps: rows are numbered first, by sorted partitions, so that "next" is
    an equality and a conversation of any length spreads over all tasks.
    """
    placed = running_before(history.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"], out="_at")
    asked = placed.where(F.col("role") == user_role).select(
        "conv_id", "turn", F.col("text").alias("question"), (F.col("_at") + 1).alias("_next")
    )
    replies = placed.where(F.col("role") == reply_role).select(
        "conv_id", F.col("_at").alias("_next"), F.col("text").alias("answer")
    )
    return asked.join(replies, ["conv_id", "_next"]).drop("_next")


def append_history(
    history: DataFrame,
    exchanges: DataFrame,
    user_role: str = "user",
    reply_role: str = "assistant",
) -> DataFrame:
    """Append question and response of each exchange (conv_id, query_id, question, response)."""
    added = new_turns(history, exchanges, user_role, reply_role)
    return history.select("conv_id", "turn", "role", "text").unionByName(added)


def new_turns(
    history: DataFrame,
    exchanges: DataFrame,
    user_role: str = "user",
    reply_role: str = "assistant",
) -> DataFrame:
    """The turns that the exchanges add after those of `history`."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    placed = running_before(exchanges, ["conv_id"], ["query_id"], out="_nth")
    placed = placed.join(last, "conv_id", "left").withColumn(
        "_base", F.coalesce("_last", F.lit(-1)) + 1 + 2 * F.col("_nth")
    )
    return placed.select(
        "conv_id",
        F.inline(
            F.array(
                F.struct(
                    F.col("_base").alias("turn"),
                    F.lit(user_role).alias("role"),
                    F.col("question").alias("text"),
                ),
                F.struct(
                    (F.col("_base") + 1).alias("turn"),
                    F.lit(reply_role).alias("role"),
                    F.col("response").alias("text"),
                ),
            )
        ),
    )
