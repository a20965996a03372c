"""Spelling and streaming queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quaestor import schemas
from quaestor.functions import text as tx
from quaestor.operators import embed as em
from quaestor.operators import retention as rt
from quaestor.operators import speller
from quaestor.operators import spelling as sp
from quaestor.operators import vectors as ve
from quaestor.session import cut, scratch_path
from quaestor.plans.cascade import Knowledge, answer
from quaestor.streaming import conversation, jobs
from registry import inputs as i
from registry.corpus_queries import _HITS_SQL, r6
from registry.search_queries import _TEXT_SEARCH

SLICE_ROWS = 1_000_000

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


_WORDS = f"""vocab AS (SELECT word, count(*) AS freq FROM (
  SELECT unnest({i.words_sql('text')}) AS word FROM documents) GROUP BY 1),
terms AS (SELECT word FROM vocab WHERE freq >= 3 AND length(word) > 4),
chat AS (SELECT DISTINCT word FROM (SELECT unnest({i.words_sql('text')}) AS word FROM conversations))"""


@query(f"WITH {_WORDS} SELECT word FROM chat WHERE length(word) > 2 AND word NOT IN (SELECT word FROM terms)")
def unknown_words(spark, sf):
    return sp.unknown_words(i.chat_words(spark, sf), sp.domain_terms(i.vocabulary(spark, sf)))


@query(f"WITH {i.repair_sql('documents', 'doc_id', 'text')} SELECT id AS doc_id, md5(txt) AS repaired_md5 FROM repaired")
def pattern_repair(spark, sf):
    return i.table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.repair(F.col("text"))).alias("repaired_md5")
    )


def _run_sql(keep: str) -> str:
    return f"""(SELECT word, string_agg(repeat(ch, CAST({keep} AS INTEGER)), '' ORDER BY i) AS w
  FROM (SELECT word, ch, min(i) AS i, count(*) AS n FROM (
    SELECT word, ch, i, i - row_number() OVER (PARTITION BY word, ch ORDER BY i) AS g FROM letters)
    GROUP BY word, ch, g) GROUP BY word)"""


# every vocabulary word with its third letter stretched: what the rules are there to undo
@query(
    f"""WITH {_WORDS},
bad AS (SELECT substr(word, 1, 3) || repeat(substr(word, 3, 1), 2 + length(word) % 3) || substr(word, 4) AS word
        FROM vocab WHERE length(word) > 4),
unknown AS (SELECT DISTINCT word FROM bad WHERE word NOT IN (SELECT word FROM terms)),
letters AS (SELECT word, unnest(string_split(word, '')) AS ch, unnest(range(length(word))) AS i FROM unknown),
tries AS (SELECT word, w, 1 AS rule FROM {_run_sql('CASE WHEN n >= 4 THEN 2 ELSE n END')}
  UNION ALL SELECT word, w, 3 FROM {_run_sql("CASE WHEN n >= 3 AND contains('bcdfghjklmnpqrstvwxyz', ch) THEN 1 ELSE n END")})
SELECT word, arg_min(w, rule) AS corrected, min(rule)::BIGINT AS rule FROM tries
WHERE w <> word AND length(w) > 1 AND (length(w) <= 2 OR w IN (SELECT word FROM terms)) GROUP BY word"""
)
def word_repair(spark, sf):
    vocabulary = cut(i.vocabulary(spark, sf))
    terms = sp.domain_terms(vocabulary)
    stretched = vocabulary.where(F.length("word") > 4).select(
        F.expr(
            "concat(substring(word, 1, 3), repeat(substring(word, 3, 1), 2 + length(word) % 3), substring(word, 4))"
        ).alias("word")
    )
    return sp.repaired_words(sp.unknown_words(stretched, terms), terms)


@query(
    f"""WITH {_WORDS}, pairs AS (
  SELECT word, lag(word) OVER (PARTITION BY length(word) ORDER BY word) AS suggestion FROM vocab)
SELECT word, suggestion, round(greatest(0.0, 1 - levenshtein(word, suggestion)::DOUBLE
  / greatest(length(word), length(suggestion))), 6) AS confidence FROM pairs WHERE suggestion IS NOT NULL"""
)
def correction_confidence(spark, sf):
    """Neighbours in the ordered vocabulary of each length."""
    from quaestor.operators.ordering import dense_positions

    # neighbours by position instead of a window over all words of one length
    placed = cut(dense_positions(
        i.vocabulary(spark, sf).select(F.length("word").alias("n"), "word"), ["n", "word"], "at"
    ))
    before = placed.select((F.col("at") + 1).alias("at"), "n", F.col("word").alias("suggestion"))
    pairs = placed.join(before, ["at", "n"]).select("word", "suggestion")
    return sp.confidence(pairs).select("word", "suggestion", r6("confidence"))


def _spell_side(spark, sf):
    vocabulary = cut(i.corpus_vocabulary(spark, sf))
    return sp.domain_terms(vocabulary), vocabulary


@query()
def suggest_words(spark, sf):
    terms, vocabulary = _spell_side(spark, sf)
    unknown = cut(sp.unknown_words(i.chat_words(spark, sf), terms))
    return sp.suggest(unknown, vocabulary).select(
        "word", F.col("rank").cast("long").alias("rank"), "suggestion", "freq", r6("ratio")
    )


@query(
    f"""WITH {_WORDS}, known AS (SELECT v.word, v.freq FROM vocab v JOIN terms t ON t.word = v.word),
asked AS (SELECT word FROM chat WHERE length(word) > 2 AND word NOT IN (SELECT word FROM terms)),
met AS (SELECT a.word, v.word AS suggestion, levenshtein(a.word, v.word) AS edits, v.freq
        FROM asked a JOIN known v ON abs(length(a.word) - length(v.word)) <= 2 AND levenshtein(a.word, v.word) <= 2)
SELECT word, suggestion, position, edits, freq FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY edits, freq DESC, suggestion) AS position FROM met)
WHERE position <= 3"""
)
def spell_checker(spark, sf):
    """Every unknown word of the conversations against the accepted words of the documents."""
    vocabulary = cut(i.vocabulary(spark, sf))
    terms = sp.domain_terms(vocabulary)
    unknown = sp.unknown_words(i.chat_words(spark, sf), terms)
    return speller.check(unknown, vocabulary.join(terms, "word", "left_semi"))


@query()
def correct_words(spark, sf):
    terms, vocabulary = _spell_side(spark, sf)
    words = cut(i.chat_words(spark, sf).distinct())
    return sp.correct_words(words, terms, vocabulary).select(
        "word", "corrected", r6("confidence"), "method"
    )


@query()
def correct_text(spark, sf):
    terms, vocabulary = _spell_side(spark, sf)
    texts = i.user_turns(spark, sf).unionByName(
        i.table(spark, sf, "benchmark").select(
            (-F.col("item_id") - 1).alias("query_id"), F.col("text").alias("query")
        )
    )
    return sp.correct_text(texts, terms, vocabulary, "query_id", "query").select(
        F.col("text_id").alias("query_id"), "corrected_text", "has_corrections", "correction_count"
    )


# corrections taken from the vocabulary by rule: every word longer than two letters, reversed
@query(
    rf"""WITH {_WORDS}, fix AS (SELECT word, reverse(word) AS corrected FROM vocab
  WHERE length(word) > 2 AND reverse(word) <> word),
turns AS (SELECT conv_id * 100000 + turn AS tid, text FROM conversations),
{i.repair_sql('turns', 'tid', 'text')},
parts AS (
  SELECT id, unnest(p) AS part, unnest(range(len(p))) AS nth FROM (
    SELECT id, regexp_extract_all(txt, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS p FROM repaired)),
placed AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY id ORDER BY nth
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM parts),
fixed AS (SELECT p.*, CASE WHEN regexp_matches(part, '^[A-Z]+$') THEN upper(f.corrected)
            WHEN regexp_matches(part, '^[A-Z][a-z]*$')
            THEN upper(substr(f.corrected, 1, 1)) || lower(substr(f.corrected, 2))
            ELSE f.corrected END AS new
          FROM placed p LEFT JOIN fix f ON f.word = lower(p.part) AND regexp_matches(p.part, '^[a-zA-Z]+$'))
SELECT id AS text_id, string_agg(coalesce(new, part), '' ORDER BY nth) AS corrected_text,
  count(new) > 0 AS has_corrections, count(new) AS correction_count,
  coalesce(sum(CASE WHEN new IS NOT NULL THEN pos END), 0)::BIGINT AS position_sum
FROM fixed GROUP BY id"""
)
def apply_corrections(spark, sf):
    fix = (
        i.vocabulary(spark, sf)
        .where(F.length("word") > 2)
        .select("word", F.reverse("word").alias("corrected"), F.lit(1.0).alias("confidence"))
        .where(F.col("word") != F.col("corrected"))
    )
    turns = i.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("tid"), "text"
    )
    return sp.apply_corrections(turns, fix, "tid", "text").select(
        "text_id",
        "corrected_text",
        "has_corrections",
        "correction_count",
        F.aggregate("corrections", F.lit(0).cast("long"), lambda s, c: s + c["position"]).alias(
            "position_sum"
        ),
    )


# --- streaming ----------------------------------------------------------------------------


def _drain(stream) -> None:
    stream.awaitTermination()


def _as_files(df, order: str, files: int = 4) -> str:
    """The table as several files in order, so that a file stream has several batches.

    One range sort cuts the table into slices of at most about SLICE_ROWS rows, rows without an
    order first. A slice is one file, as a stream takes whole files in the order of their
    writing, and is read from its own folder: every row is read twice, however many slices.
    """
    spark = df.sparkSession
    cuts, path = scratch_path(spark, "slices"), scratch_path(spark, "stream")
    files = max(files, math.ceil(df.count() / SLICE_ROWS))
    ranged = df.repartitionByRange(files, order).withColumn("_slice", F.spark_partition_id())
    ranged.write.partitionBy("_slice").parquet(cuts)
    for row in spark.read.parquet(cuts).select("_slice").distinct().orderBy("_slice").collect():  # one per slice
        spark.read.schema(df.schema).parquet(f"{cuts}/_slice={row[0]}").coalesce(1).write.mode("append").parquet(path)
    return path


@query(
    f"""WITH {i.PAIRS}, x AS (
SELECT conv_id AS item_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pair_pos,
       {i.strip_sql('question')} AS question, {i.strip_sql('answer')} AS answer, source_url FROM pairs)
SELECT *, {i.clean_sql('question')} AS question_clean FROM x
WHERE length(question) > 5 AND length(answer) > 10 AND length(question) < 1000 AND NOT starts_with(question, 'http')"""
)
def stream_ingest(spark, sf):
    source = _as_files(i.items(spark, sf), "item_id")
    out = scratch_path(spark, "ingested")
    _drain(jobs.ingest_files(spark, source, out, scratch_path(spark, "state")))
    return spark.read.parquet(out).withColumn("pair_pos", F.col("pair_pos").cast("long"))


@query(
    f"""SELECT t.query_id, CASE WHEN t.s >= 0.78 THEN k.answer END AS answer, round(t.s, 6) AS similarity
FROM (WITH {_TEXT_SEARCH}
SELECT query_id, faq_id, s FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, faq_id) AS rank FROM (
    SELECT q.id AS query_id, c.id AS faq_id, round({i.COSINE}, 12) AS s FROM q CROSS JOIN c))
WHERE rank = 1) t JOIN (WITH {i.CORPUS} SELECT * FROM corpus) k ON k.faq_id = t.faq_id"""
)
def stream_answer(spark, sf):
    corpus = cut(i.embedded_corpus(spark, sf))
    source = _as_files(i.user_turns(spark, sf), "query_id", 3)
    out = scratch_path(spark, "answers")

    def answer(batch):
        return ve.best_match(em.embed_queries(batch, i.ENCODER), corpus)

    _drain(
        jobs.answer_stream(
            jobs.read_files(spark, source, schemas.QUERY), answer, out, scratch_path(spark, "state")
        )
    )
    return spark.read.parquet(out).select("query_id", "answer", r6("similarity"))


@query(
    """WITH asked AS (SELECT conv_id, turn AS said, text FROM conversations
  WHERE role = 'user' AND regexp_matches(text, '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]')),
placed AS (SELECT *, 2 * (row_number() OVER (PARTITION BY conv_id ORDER BY said) - 1) AS turn FROM asked)
SELECT conv_id, turn, 'user' AS role, text FROM placed
UNION ALL SELECT conv_id, turn + 1, 'assistant', NULL FROM placed"""
)
def stream_conversations(spark, sf):
    """Every user turn answered by the whole cascade as it arrives, by conversation; answers are
    compared as present, since the cascade has a query of its own."""
    corpus = cut(i.embedded_corpus(spark, sf))
    vocabulary = cut(sp.learn_vocabulary(corpus, "question"))
    known = Knowledge(corpus, sp.domain_terms(vocabulary), vocabulary, i.ENCODER)
    turns = i.table(spark, sf, "conversations").where("role = 'user'")
    asked = turns.select(
        "conv_id", (F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"),
        F.timestamp_seconds(F.col("turn") * 60 + 1_700_000_000).alias("asked_at"),
    ).where(F.length(tx.strip(F.col("query"))) > 0)
    source = _as_files(asked, "asked_at", 2)
    history = scratch_path(spark, "history")
    stream = jobs.read_files(spark, source, asked.schema)
    _drain(
        conversation.converse(
            stream, lambda batch: answer(batch, known), scratch_path(spark, "answers"), history, scratch_path(spark, "state")
        )
    )
    told = spark.read.parquet(history)
    return told.select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.col("text")).alias("text"))


@query(f"SELECT event_id, key FROM ({_HITS_SQL}) WHERE NOT hit")
def stream_repeat_suppress(spark, sf):
    events = i.accesses(spark, sf).withColumn("at", F.unix_micros("ts").cast("double"))
    source = _as_files(events, "at")
    out = scratch_path(spark, "accepted")
    stream = jobs.read_files(spark, source, schemas.ACCESS)
    _drain(jobs.suppress_repeats(stream, out, scratch_path(spark, "state")))
    return spark.read.parquet(out).select("event_id", "key")


@query(
    f"""SELECT hits, misses, round_even(hits * 100.0::DOUBLE / (hits + misses), 2) AS hit_rate_percent
FROM (SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM ({_HITS_SQL}))"""
)
def stream_usage_stats(spark, sf):
    labelled = cut(rt.label_accesses(i.accesses(spark, sf)).select("event_id", "hit"))
    source = _as_files(labelled, "event_id", 3)
    out = scratch_path(spark, "usage")
    stream = jobs.read_files(spark, source, labelled.schema)
    _drain(jobs.usage_stream(stream, out, scratch_path(spark, "state")))
    versions = spark.read.parquet(out)
    return versions.join(versions.agg(F.max("version").alias("version")), "version", "left_semi").drop("version")
