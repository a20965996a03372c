"""Ingest, history, statistics, vocabulary and retention."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from quaestor.functions import text as tx
from quaestor.functions.labels import GUARD_MESSAGE, NO_ANSWER_MESSAGE, confidence_label
from quaestor.operators import corpus as co
from quaestor.operators import retention as rt
from quaestor.operators import spelling as sp
from quaestor.operators import stats as st
from quaestor.plans.cascade import distinct_queries, guard
from quaestor.session import scratch_path
from quaestor.sources import tables as tb
from registry import inputs as i

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def r6(name: str, column=None):
    return F.round(F.col(name) if column is None else column, 6).alias(name)


# --- ingest -------------------------------------------------------------------------------


@query(f"WITH {i.PAIRS} SELECT conv_id, turn, question, answer FROM pairs")
def history_pairs(spark, sf):
    return co.history_pairs(i.table(spark, sf, "conversations")).select(
        "conv_id", "turn", "question", "answer"
    )


@query(
    f"""WITH {i.PAIRS}
SELECT conv_id AS item_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pair_pos,
       {i.strip_sql('question')} AS question, {i.strip_sql('answer')} AS answer, source_url
FROM pairs"""
)
def corpus_extract(spark, sf):
    return co.extract_pairs(i.items(spark, sf)).withColumn("pair_pos", F.col("pair_pos").cast("long"))


@query(
    f"""SELECT doc_id, length({i.strip_sql('text')}) AS question_length FROM documents
WHERE length({i.strip_sql('text')}) > 5 AND length({i.strip_sql('text')}) < 1000
  AND NOT starts_with({i.strip_sql('text')}, 'http')
  AND length({i.strip_sql("source || ' ' || lang || ' ' || n_chars")}) > 10"""
)
def corpus_quality_filter(spark, sf):
    pairs = i.table(spark, sf, "documents").select(
        "doc_id",
        tx.strip(F.col("text")).alias("question"),
        tx.strip(F.concat_ws(" ", "source", "lang", F.col("n_chars").cast("string"))).alias("answer"),
    )
    return co.quality_filter(pairs).select(
        "doc_id", F.length("question").cast("long").alias("question_length")
    )


@query(
    f"""WITH {i.PAIRS} SELECT conv_id, turn, question, answer, source_url
FROM pairs ORDER BY conv_id, turn LIMIT 100"""
)
def corpus_limit(spark, sf):
    return co.limit_pairs(i.source_pairs(spark, sf), 100, ["conv_id", "turn"])


@query(
    """SELECT doc_id, row_number() OVER (ORDER BY source, lang, doc_id) - 1 AS position FROM documents"""
)
def corpus_ids(spark, sf):
    docs = i.table(spark, sf, "documents").select("source", "lang", "doc_id")
    return co.assign_ids(docs, ["source", "lang", "doc_id"], "position").select("doc_id", "position")


_FLAGS = list(product([True, False], repeat=3))


def _flag_name(flags):
    return "clean_" + "".join(str(int(f)) for f in flags)


@query(
    "SELECT doc_id, "
    + ", ".join(f"md5({i.clean_sql('text', *f)}) AS {_flag_name(f)}" for f in _FLAGS)
    + " FROM documents"
)
def corpus_clean(spark, sf):
    docs = i.table(spark, sf, "documents")
    return docs.select(
        "doc_id", *[F.md5(tx.clean(F.col("text"), *f)).alias(_flag_name(f)) for f in _FLAGS]
    )


@query(
    f"""WITH {i.CORPUS}
SELECT count(*) AS expected_count, 'chat' AS dataset_name, 150::BIGINT AS max_faqs, count(*) AS row_count,
       count(*) > 0 AND count(*) >= least(150, 0.8 * count(*)) AS reusable FROM corpus"""
)
def corpus_snapshot(spark, sf):
    path = scratch_path(spark, "snapshot")
    tb.write_snapshot(i.corpus(spark, sf), path, "chat", 150, F.current_timestamp())
    return tb.snapshot_status(spark, path, 150).select(
        "expected_count", "dataset_name", "max_faqs", "row_count", "reusable"
    )


@query(
    """WITH added AS (
  SELECT d.doc_id % 150 AS conv_id, d.text, d.source,
         coalesce(h.last, -1) + 1 + 2 * (row_number() OVER (PARTITION BY d.doc_id % 150 ORDER BY d.doc_id) - 1) AS turn
  FROM documents d LEFT JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) h
    ON h.conv_id = d.doc_id % 150)
SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT conv_id, turn, 'user', text FROM added
  UNION ALL SELECT conv_id, turn + 1, 'assistant', source FROM added)"""
)
def history_append(spark, sf):
    exchanges = i.table(spark, sf, "documents").select(
        (F.col("doc_id") % 150).alias("conv_id"),
        F.col("doc_id").alias("query_id"),
        F.col("text").alias("question"),
        F.col("source").alias("response"),
    )
    return co.append_history(i.table(spark, sf, "conversations"), exchanges).select(
        "conv_id", "turn", "role", F.md5("text").alias("text_md5")
    )


# --- statistics ---------------------------------------------------------------------------

_STATS_SQL = """count(*) AS total_faqs, round(avg(length(question)), 6) AS avg_question_length,
  round(avg(length(answer)), 6) AS avg_answer_length, count(DISTINCT source_url) AS unique_sources"""


@query(f"WITH {i.CORPUS} SELECT {_STATS_SQL} FROM corpus")
def corpus_stats(spark, sf):
    return st.corpus_stats(i.corpus(spark, sf)).select(
        "total_faqs", r6("avg_question_length"), r6("avg_answer_length"), "unique_sources"
    )


@query(
    f"""WITH {i.CORPUS} SELECT {_STATS_SQL}, count(question) AS original_questions,
  count(question_clean) AS cleaned_questions, count(question) = count(question_clean) AS cleaning_done FROM corpus"""
)
def corpus_info(spark, sf):
    return st.corpus_info(i.corpus(spark, sf)).select(
        "total_faqs",
        r6("avg_question_length"),
        r6("avg_answer_length"),
        "unique_sources",
        "original_questions",
        "cleaned_questions",
        "cleaning_done",
    )


@query(
    """SELECT round((sum(strlen(text)) + sum(strlen(lang)) + sum(strlen(source))) / 1048576.0, 6) AS size_mb
FROM documents"""
)
def source_bytes(spark, sf):
    return st.source_bytes(i.table(spark, sf, "documents"), ["text", "lang", "source"]).select(
        r6("size_mb")
    )


@query(
    """SELECT length(text) // 50 AS len_bucket, count(*) AS members, min(doc_id) AS first_id,
  max(doc_id) AS last_id FROM documents GROUP BY 1"""
)
def length_buckets(spark, sf):
    return st.length_buckets(
        i.table(spark, sf, "documents").select(
            F.col("doc_id").alias("faq_id"), F.col("text").alias("question")
        )
    )


@query(
    f"""WITH {i.CORPUS} SELECT count(*) AS total_items, 64::BIGINT AS embedding_dimension,
  CASE WHEN count(*) > 50000 THEN count(DISTINCT length(question) // 50) ELSE 0 END AS length_buckets,
  CASE WHEN count(*) < 5000 THEN 'brute_force' WHEN count(*) < 10000 THEN 'flat_l2'
       WHEN count(*) < 100000 THEN 'graph' ELSE 'cells' END AS index_type,
  count(*) AS index_vectors FROM corpus"""
)
def index_profile(spark, sf):
    return st.index_profile(i.embedded_corpus(spark, sf)).select(
        "total_items",
        "embedding_dimension",
        F.col("length_buckets").cast("long").alias("length_buckets"),
        "index_type",
        "index_vectors",
    )


@query(
    f"""WITH turns AS (
  SELECT text, role, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS reply
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT CASE WHEN length({i.strip_sql('text')}) < 3 THEN '{GUARD_MESSAGE}'
             ELSE coalesce(reply, '{NO_ANSWER_MESSAGE}') END AS response,
             length(text) / 1000.0 AS seconds
      FROM turns WHERE role = 'user')
SELECT count(*) AS queries, sum(ok)::BIGINT AS successes,
  round(sum(ok) * 100.0 / count(*), 6) AS success_rate, round(avg(seconds) * 1000, 6) AS avg_ms
FROM (SELECT *, CASE WHEN length(response) > 0 AND NOT contains(response, 'No relevant answer found')
                     THEN 1 ELSE 0 END AS ok FROM r)"""
)
def eval_summary(spark, sf):
    talk = i.table(spark, sf, "conversations")
    replies = co.history_pairs(talk).select("conv_id", "turn", F.col("answer").alias("_reply"))
    asked = talk.where(F.col("role") == "user").withColumnRenamed("text", "query")
    responses = (
        guard(asked.join(replies, ["conv_id", "turn"], "left").withColumn("seconds", F.length("query") / 1000))
        .withColumn("response", F.coalesce("response", "_reply", F.lit(NO_ANSWER_MESSAGE)))
    )
    return st.eval_summary(responses).select("queries", "successes", r6("success_rate"), r6("avg_ms"))


@query(
    """SELECT event_type AS namespace, user_id::VARCHAR AS key, epoch_us(min(ts)) AS created_us,
  epoch_us(max(ts)) AS accessed_us, count(*) AS access_count, sum(strlen(props))::BIGINT AS size_bytes
FROM events GROUP BY 1, 2"""
)
def access_rollup(spark, sf):
    events = i.table(spark, sf, "events").select(
        F.col("event_type").alias("namespace"),
        F.col("user_id").cast("string").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        "props",
    )
    return st.access_rollup(events, ["namespace", "key"], F.octet_length("props")).select(
        "namespace",
        "key",
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("accessed_at").alias("accessed_us"),
        "access_count",
        "size_bytes",
    )


@query(
    f"""WITH RECURSIVE {i.ACCESSES}, {i.MISSES}, {i.ENTRIES},
e AS (SELECT count(*) AS entries, sum(size_bytes) AS b, avg(access_count) AS m FROM entries),
m AS (SELECT count(*) AS misses FROM misses),
h AS (SELECT (SELECT count(*) FROM accesses) - misses AS hits, misses FROM m)
SELECT entries, hits, misses, round_even(hits * 100.0::DOUBLE / (hits + misses), 2) AS hit_rate_percent,
  round_even(b / 1048576.0::DOUBLE, 2) AS total_size_mb, round_even(m, 1) AS avg_access_count,
  round_even(b / 10000000.0::DOUBLE * 100, 1) AS usage_percent FROM e, h"""
)
def cache_usage_stats(spark, sf):
    labelled = rt.label_accesses(i.accesses(spark, sf))
    return st.usage_stats(i.entries(spark, sf), labelled, 10_000_000)


# --- vocabulary ---------------------------------------------------------------------------

_VOCAB = f"""vocab AS (SELECT word, count(*) AS freq FROM (
  SELECT unnest({i.words_sql('text')}) AS word FROM documents) GROUP BY 1)"""


@query(f"WITH {_VOCAB} SELECT word, freq FROM vocab")
def vocab_learn(spark, sf):
    return i.vocabulary(spark, sf)


@query(f"WITH {_VOCAB} SELECT word FROM vocab WHERE freq >= 3 AND length(word) > 4")
def domain_terms(spark, sf):
    return sp.domain_terms(i.vocabulary(spark, sf))


@query(
    f"""WITH {_VOCAB} SELECT word FROM vocab WHERE freq >= 3 AND length(word) > 4
UNION SELECT lower(unnest(string_split(p_name, ' '))) FROM part UNION SELECT lower(p_brand) FROM part"""
)
def dictionary_merge(spark, sf):
    part = i.table(spark, sf, "part")
    user_words = part.select(F.explode(F.split("p_name", " ")).alias("word")).unionByName(
        part.select(F.col("p_brand").alias("word"))
    )
    return sp.merge_dictionary(sp.domain_terms(i.vocabulary(spark, sf)), user_words)


@query(
    f"""WITH {_VOCAB} SELECT 'accepted' AS kind, word, NULL::BIGINT AS freq FROM vocab
WHERE freq >= 3 AND length(word) > 4
UNION ALL SELECT 'vocabulary', word, freq FROM vocab"""
)
def dictionary_export(spark, sf):
    path = scratch_path(spark, "dictionary")
    words = i.vocabulary(spark, sf)
    tb.write_dictionary(sp.domain_terms(words), words, path, "json")
    accepted, vocab = tb.read_dictionary(spark, path, "json")
    return accepted.select(
        F.lit("accepted").alias("kind"), "word", F.lit(None).cast("long").alias("freq")
    ).unionByName(vocab.select(F.lit("vocabulary").alias("kind"), "word", "freq"))


@query(
    f"""WITH {_VOCAB} SELECT count(*) FILTER (freq >= 3 AND length(word) > 4) AS custom_dictionary_size,
  count(*) AS learned_vocabulary_size, 3::BIGINT AS automatic_patterns FROM vocab"""
)
def vocab_stats(spark, sf):
    words = i.vocabulary(spark, sf)
    return sp.vocabulary_stats(words, sp.domain_terms(words))


# --- queries and labels -------------------------------------------------------------------


@query(
    f"""SELECT doc_id AS query_id, CASE WHEN length(q) < 3 THEN '{GUARD_MESSAGE}' END AS response
FROM (SELECT doc_id, {i.strip_sql('text')} AS q FROM documents
      UNION ALL SELECT -1 - n_nationkey, ' ' || substr(n_name, 1, n_nationkey % 5) || ' ' FROM nation)
t(doc_id, q0), LATERAL (SELECT {i.strip_sql('q0')} AS q) WHERE length(q) > 0"""
)
def query_guard(spark, sf):
    docs = i.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    short = i.table(spark, sf, "nation").select(
        (F.lit(-1) - F.col("n_nationkey")).cast("long").alias("query_id"),
        F.expr("concat(' ', substring(n_name, 1, cast(n_nationkey % 5 as int)), ' ')").alias("query"),
    )
    return guard(docs.unionByName(short)).select("query_id", "response")


@query(
    """SELECT doc_id, md5(text) AS key, count(*) OVER (PARTITION BY text) AS asked FROM documents"""
)
def query_memo(spark, sf):
    docs = i.table(spark, sf, "documents")
    memo = distinct_queries(docs, "text")
    return docs.select("doc_id", F.md5("text").alias("key")).join(
        memo.select("key", "asked"), "key"
    ).select("doc_id", "key", "asked")


@query(
    """SELECT event_id, CASE WHEN s > 0.85 THEN 'High' ELSE 'Good' END AS match_label,
  CASE WHEN s > 0.85 THEN 'High' WHEN s > 0.7 THEN 'Medium' ELSE 'Low' END AS ranked_label,
  CASE WHEN s > 0.8 THEN 'High' WHEN s > 0.7 THEN 'Medium' ELSE 'Good' END AS response_label
FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS s FROM events)"""
)
def confidence_labels(spark, sf):
    s = (F.col("event_id") % 101) / F.lit(100.0)
    return i.table(spark, sf, "events").select(
        "event_id",
        confidence_label(s, "match").alias("match_label"),
        confidence_label(s, "ranked").alias("ranked_label"),
        confidence_label(s, "response").alias("response_label"),
    )


# --- retention ----------------------------------------------------------------------------


@query(
    f"""WITH {i.ENTRIES} SELECT namespace, key, epoch_us(created_at) AS created_us FROM entries
WHERE epoch_us(TIMESTAMP '2024-01-02 12:00:00') - epoch_us(created_at) > {i.DAY_US}"""
)
def ttl_expire(spark, sf):
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    return rt.expired(i.entries(spark, sf), now).select(
        "namespace", "key", F.unix_micros("created_at").alias("created_us")
    )


_HITS_SQL = f"""WITH RECURSIVE {i.ACCESSES}, {i.MISSES},
first_at AS (SELECT a.key, a.t, min(event_id) AS event_id FROM accesses a JOIN misses m
             ON m.key = a.key AND m.t = a.t GROUP BY 1, 2)
SELECT a.event_id, a.key, f.event_id IS NULL AS hit FROM accesses a
LEFT JOIN first_at f ON f.event_id = a.event_id"""


@query(_HITS_SQL)
def ttl_hit_miss(spark, sf):
    return rt.label_accesses(i.accesses(spark, sf)).select("event_id", "key", "hit")


@query(_HITS_SQL)
def ttl_hit_miss_hot_keys(spark, sf):
    """The path of hot keys, forced for every key with more than 20 access times."""
    return rt.label_accesses(i.accesses(spark, sf), hot_key_times=20).select("event_id", "key", "hit")


@query(
    f"""WITH {i.ENTRIES}, s AS (
  SELECT *, sum(size_bytes) OVER (PARTITION BY namespace) AS total,
    coalesce(sum(size_bytes) OVER (PARTITION BY namespace ORDER BY accessed_at, access_count, key
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS removed FROM entries),
l AS (SELECT avg(t) AS lim FROM (SELECT sum(size_bytes) AS t FROM entries GROUP BY namespace))
SELECT namespace, key, size_bytes FROM s, l
WHERE total > floor(lim) AND total - removed > 0.8::DOUBLE * floor(lim)"""
)
def retention_evict(spark, sf):
    e = i.entries(spark, sf)
    limit = e.groupBy("namespace").agg(F.sum("size_bytes").alias("t")).agg(F.floor(F.avg("t"))).first()[0]
    return rt.evict(e, int(limit)).select("namespace", "key", "size_bytes")
