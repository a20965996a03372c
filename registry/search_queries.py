"""Embedding, nearest-neighbour, fuzzy and cascade queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.functions import text as tx
from quaestor.operators import embed as em
from quaestor.operators import fuzzy as fz
from quaestor.operators import graphs as gr
from quaestor.operators import spelling as sp
from quaestor.operators import vectors as ve
from quaestor.plans.cascade import Knowledge, answer
from quaestor.session import cut, scratch_path
from quaestor.sources import cellstore
from quaestor.sources import tables as tb
from registry import inputs as i
from registry.corpus_queries import r6

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- embedding ----------------------------------------------------------------------------


def _components(df, *kept):
    return df.select(
        *kept, F.posexplode("embedding").alias("slot", "value")
    ).select(
        *kept, F.col("slot").cast("long").alias("slot"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


@query(
    f"""WITH {i.CORPUS}, {i.embed_sql('e', 'corpus', 'faq_id', 'question_clean')}
SELECT id AS faq_id, unnest(range(64)) AS slot, round(unnest(v), 6) AS value FROM e"""
)
def embed_corpus(spark, sf):
    return _components(i.embedded_corpus(spark, sf), "faq_id")


@query(
    f"""WITH {i.embed_sql('e', 'benchmark', 'item_id', 'text')}
SELECT id AS query_id, unnest(range(64)) AS slot, round(unnest(v), 6) AS value FROM e"""
)
def embed_query(spark, sf):
    asked = i.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return _components(em.embed_queries(asked, i.ENCODER), "query_id")


_KEY = "md5(text || '_hashing-64_True')"


@query(
    f"""WITH k AS (SELECT min(doc_id) AS id, {_KEY} AS key, min(text) AS text, count(*) AS copies
           FROM documents GROUP BY 2),
{i.embed_sql('e', 'k', 'id', 'text')}
SELECT k.key, k.copies, unnest(range(64)) AS slot, round(unnest(e.v), 6) AS value FROM k JOIN e ON e.id = k.id"""
)
def embed_dedup(spark, sf):
    """All components of every distinct text's vector."""
    docs = i.table(spark, sf, "documents")
    distinct = em.distinct_texts(docs, "text", i.ENCODER.name)
    return _components(em.embed(distinct, "text", i.ENCODER), "key", "copies")


def _stored(spark, sf):
    """Vectors of the labelled documents: what an earlier run would have left."""
    docs = i.table(spark, sf, "documents").join(
        i.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"
    )
    return em.embed_distinct(docs, "text", i.ENCODER, i.ENCODER.name)


_STORED = f"""stored AS (SELECT DISTINCT {_KEY} AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
d AS (SELECT {_KEY} AS key FROM documents)"""


@query(
    f"""WITH {_STORED}, k AS (SELECT min(doc_id) AS id, {_KEY} AS key, min(text) AS text FROM documents GROUP BY 2),
{i.embed_sql('e', 'k', 'id', 'text')}
SELECT k.key, k.key IN (SELECT key FROM stored) AS reused, unnest(range(64)) AS slot, round(unnest(e.v), 6) AS value
FROM k JOIN e ON e.id = k.id"""
)
def embed_incremental(spark, sf):
    """All components of every vector, stored or new."""
    made = em.embed_incremental(
        i.table(spark, sf, "documents"), _stored(spark, sf), "text", i.ENCODER, i.ENCODER.name
    )
    return _components(made, "key", "reused")


@query(
    f"""WITH {_STORED} SELECT count(*) AS texts, sum(hit)::BIGINT AS reused_texts,
  round(sum(hit) * 100.0 / count(*), 6) AS reuse_rate
FROM (SELECT CASE WHEN key IN (SELECT key FROM stored) THEN 1 ELSE 0 END AS hit FROM d)"""
)
def embed_reuse_rate(spark, sf):
    return em.reuse_report(
        i.table(spark, sf, "documents"), _stored(spark, sf), "text", i.ENCODER.name
    ).select("texts", "reused_texts", r6("reuse_rate"))


@query(
    """SELECT count(*) AS row_count, 0::BIGINT AS null_vectors, min(len(embedding)) AS min_dim,
  max(len(embedding)) AS max_dim, round(min(n), 4) AS min_norm, round(max(n), 4) AS max_norm, 'ok' AS status
FROM (SELECT embedding, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)"""
)
def embed_validate(spark, sf):
    v = i.vectors(spark, sf)
    return em.validate(v, v.count(), 64, "m", "m", "chat", "chat").select(
        "row_count",
        "null_vectors",
        "min_dim",
        "max_dim",
        F.round("min_norm", 4).alias("min_norm"),
        F.round("max_norm", 4).alias("max_norm"),
        "status",
    )


@query(
    f"""WITH k AS (SELECT DISTINCT {_KEY} AS key FROM documents)
SELECT count(*) AS num_texts, 64::BIGINT AS embedding_dim,
  md5('hashing-64_documents_' || sum(('0x' || substr(key, 1, 8))::BIGINT)::VARCHAR) AS content_key,
  'hashing-64' AS model_name, 'documents' AS dataset_name, '2.0' AS version FROM k"""
)
def embed_manifest(spark, sf):
    path = scratch_path(spark, "vectors")
    store = em.embed_distinct(i.table(spark, sf, "documents"), "text", i.ENCODER, i.ENCODER.name)
    tb.write_vectors(store, path, i.ENCODER.name, "documents", None, F.current_timestamp())
    return tb.read_vectors(spark, path)[1].drop("created_at", "max_faqs")


# --- nearest neighbours -------------------------------------------------------------------

_L2 = "list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _knn_sql(ctes: str, k: int, l2: bool = False) -> str:
    if l2:
        score, sim = f"-{_L2}", "greatest(0, least(1, 1 + s / 2))"
    else:
        score, sim = i.COSINE, "s"
    return f"""WITH {ctes}
SELECT query_id, rank, faq_id, round({sim}, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, faq_id) AS rank FROM (
    SELECT q.id AS query_id, c.id AS faq_id, round({score}, 12) AS s FROM q CROSS JOIN c))
WHERE rank <= {k}"""


def _matches(df):
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "faq_id", r6("similarity"))


@query(_knn_sql(i.VECTORS, 5))
def knn_exact(spark, sf):
    return _matches(ve.knn_exact(i.mixed_vectors(spark, sf), i.vectors(spark, sf), 5))


@query(_knn_sql(i.VECTORS, 5))
def knn_exact_blocks(spark, sf):
    """The path of large query batches."""
    return _matches(
        ve.knn_exact(i.mixed_vectors(spark, sf), i.vectors(spark, sf), 5, broadcast_bytes=0)
    )


@query(_knn_sql(i.VECTORS, 5, l2=True))
def knn_l2(spark, sf):
    return _matches(ve.knn_l2(i.mixed_vectors(spark, sf), i.vectors(spark, sf), 5))


@query(_knn_sql(i.VECTORS, 5, l2=True))
def knn_ivf(spark, sf):
    """All cells probed: the exact result."""
    index = ve.build_cells(i.vectors(spark, sf))
    return _matches(ve.knn_cells(i.mixed_vectors(spark, sf), index, 5, probes=index.cells))


@query()
def knn_ivf_probes(spark, sf):
    """The default number of probes: approximate."""
    index = ve.build_cells(i.vectors(spark, sf))
    return _matches(ve.knn_cells(i.mixed_vectors(spark, sf), index, 5))


@query(_knn_sql(i.VECTORS, 5, l2=True))
def knn_stored_cells(spark, sf):
    """An index written, appended to and loaded again; all cells probed, so the result is exact."""
    path = scratch_path(spark, "cells")
    first = F.col("faq_id") % 2 == 0  # the other half is appended: the index holds every vector
    cellstore.create(ve.build_cells(i.vectors(spark, sf).where(first)), path)
    cellstore.append(i.vectors(spark, sf).where(~first), path)
    return _matches(cellstore.search(i.mixed_vectors(spark, sf), cellstore.load(spark, path), 5))


@query()
def knn_graph(spark, sf):
    """Graph search, its beam measured for a recall of 0.9: approximate."""
    return _matches(gr.knn_graph(i.mixed_vectors(spark, sf), gr.build_graph(i.vectors(spark, sf)), 5))


@query()
def knn_lsh(spark, sf):
    return _matches(ve.knn_lsh(i.mixed_vectors(spark, sf), i.vectors(spark, sf), 5))


@query(_knn_sql(i.VECTORS, 3))
def search_auto(spark, sf):
    """The default strategy: exact at every size."""
    return _matches(ve.search(i.mixed_vectors(spark, sf), i.vectors(spark, sf), 3))


_TURNS = "turns AS (SELECT conv_id * 100000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user')"
_TEXT_SEARCH = f"""{i.CORPUS}, {_TURNS},
{i.embed_sql('c', 'corpus', 'faq_id', 'question_clean')}, {i.embed_sql('q', 'turns', 'query_id', 'query')}"""


@query(
    f"""SELECT t.query_id, t.rank, t.faq_id, k.question, k.answer, t.similarity,
  CASE WHEN raw > 0.85 THEN 'High' WHEN raw > 0.7 THEN 'Medium' ELSE 'Low' END AS confidence
FROM (WITH {_TEXT_SEARCH}
SELECT query_id, rank, faq_id, s AS raw, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, faq_id) AS rank FROM (
    SELECT q.id AS query_id, c.id AS faq_id, round({i.COSINE}, 12) AS s FROM q CROSS JOIN c))
WHERE rank <= 3) t JOIN (WITH {i.CORPUS} SELECT * FROM corpus) k ON k.faq_id = t.faq_id"""
)
def top_matches(spark, sf):
    """For every user turn the three nearest questions."""
    asked = em.embed_queries(i.user_turns(spark, sf), i.ENCODER)
    found = ve.top_matches(asked, i.embedded_corpus(spark, sf), 3)
    return found.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "faq_id",
        "question",
        "answer",
        r6("similarity"),
        "confidence",
    )


@query(
    f"""WITH {i.VECTORS}, s AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, faq_id) AS rank FROM (
    SELECT q.id AS query_id, c.id AS faq_id, round({i.COSINE}, 12) AS s FROM q CROSS JOIN c))
SELECT query_id, CASE WHEN s >= 0.9 THEN 'answer ' || faq_id END AS answer, round(s, 6) AS similarity
FROM s WHERE rank = 1"""
)
def best_match(spark, sf):
    """Threshold 0.9 lies among the similarities of the mixed vectors, so both outcomes occur."""
    corpus = i.vectors(spark, sf).withColumn("answer", F.concat(F.lit("answer "), F.col("faq_id")))
    return ve.best_match(i.mixed_vectors(spark, sf), corpus, 0.9).select(
        "query_id", "answer", r6("similarity")
    )


_BUCKETED = f"""{_TURNS}, {i.embed_sql('c', 'documents', 'doc_id', 'text')}, {i.embed_sql('q', 'turns', 'query_id', 'query')},
doc AS (SELECT doc_id AS faq_id, length(text) // 50 AS b FROM documents),
tol AS (SELECT query_id, length(query) AS n, greatest(50, length(query) // 3) AS tol FROM turns),
span AS (SELECT query_id, greatest(0, floor((n - tol) / 50.0))::BIGINT AS lo, floor((n + tol) / 50.0)::BIGINT AS hi FROM tol),
inside AS (SELECT s.query_id, d.faq_id FROM span s JOIN doc d ON d.b BETWEEN s.lo AND s.hi),
cand AS (SELECT * FROM inside UNION ALL
  SELECT s.query_id, d.faq_id FROM span s CROSS JOIN doc d WHERE s.query_id NOT IN (SELECT query_id FROM inside)),
scored AS (SELECT query_id, faq_id, round({i.COSINE}, 12) AS s
           FROM cand JOIN q ON q.id = cand.query_id JOIN c ON c.id = cand.faq_id)"""


@query(
    f"""WITH {_BUCKETED}
SELECT query_id, rank, faq_id, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, faq_id) AS rank FROM scored) WHERE rank <= 10"""
)
def length_bucket_search(spark, sf):
    """For every user turn the ten nearest documents of similar length."""
    docs = i.table(spark, sf, "documents").select(F.col("doc_id").alias("faq_id"), F.col("text").alias("question"))
    corpus = em.embed(docs, "question", i.ENCODER)
    asked = em.embed_queries(i.user_turns(spark, sf), i.ENCODER)
    return _matches(ve.length_bucket_search(asked, corpus, 10))


# --- fuzzy --------------------------------------------------------------------------------


_NAMES = """
p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS faq_id, p_partkey, p_name AS question FROM part),
asked AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 2 = 0
            THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
            ELSE substr(p_name, 1, 3) || substr(p_name, 5) END AS query FROM part),
texts AS (SELECT DISTINCT query FROM asked)
"""


def _sorted_sql(x):
    return (
        f"array_to_string(list_sort(list_filter(string_split(lower(regexp_replace({x}, '[^A-Za-z0-9_]', ' ', 'g')), ' '), "
        "lambda t: t <> '')), ' ')"
    )


# rows of the recurrence one letter of b at a time; the row is kept as a list
_LCS = """
pair AS (SELECT DISTINCT a, b FROM scored_text),
lcs AS (
  SELECT a, b, 0 AS i, list_transform(range(length(a) + 1), lambda x: 0) AS prev FROM pair
  UNION ALL
  SELECT a, b, i + 1, list_reduce(range(1, length(a) + 1),
    lambda acc, j: list_append(acc, CASE WHEN substr(a, j, 1) = substr(b, i + 1, 1) THEN prev[j] + 1
                                     ELSE greatest(acc[len(acc)], prev[j + 1]) END), [0])
  FROM lcs WHERE i < length(b)),
ratio AS (SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0
            ELSE round_even(100.0::DOUBLE * (2.0::DOUBLE * prev[len(prev)] / (length(a) + length(b))), 0)::BIGINT END AS score
          FROM lcs WHERE i = length(b))
"""


_FUZZY_SQL = f"""WITH RECURSIVE {_NAMES},
cand AS (SELECT t.query, p.faq_id, p.question FROM texts t JOIN p
         ON abs(length(p.question) - length(t.query)) <= greatest(30, length(t.query) // 2)),
scored_text AS (SELECT DISTINCT {_sorted_sql('query')} AS a, {_sorted_sql('question')} AS b FROM cand), {_LCS},
best AS (SELECT c.query, c.faq_id, r.score FROM cand c JOIN ratio r
         ON r.a = {_sorted_sql('c.query')} AND r.b = {_sorted_sql('c.question')} WHERE r.score >= 70
         QUALIFY row_number() OVER (PARTITION BY c.query ORDER BY r.score DESC, c.faq_id) <= 5)
SELECT query_id, rank, faq_id, score FROM (
  SELECT a.query_id, row_number() OVER (PARTITION BY a.query_id ORDER BY b.score DESC, b.faq_id) AS rank,
         b.faq_id, b.score FROM asked a JOIN best b ON b.query = a.query)"""


@query(_FUZZY_SQL)
def fuzzy_match(spark, sf):
    """All candidates of similar length, at every size."""
    corpus, asked = i.short_names(spark, sf)
    return fz.fuzzy_match(asked, corpus).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "faq_id", "score"
    )


@query(_FUZZY_SQL)
def fuzzy_match_whole_corpus(spark, sf):
    """The same under the name it had beside a capped query."""
    return fuzzy_match(spark, sf)


@query(
    f"""WITH RECURSIVE {_NAMES},
scored_text AS (SELECT DISTINCT a.query AS a, p.question AS b FROM asked a JOIN p ON p.p_partkey = a.query_id), {_LCS}
SELECT a AS word, b AS suggestion, round(score / 100.0::DOUBLE, 6) AS confidence FROM ratio"""
)
def correction_confidence_ratio(spark, sf):
    """The ratio form of the correction confidence, on part names and their misspellings."""
    _, asked = i.short_names(spark, sf)
    numbered = i.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("suggestion"))
    pairs = asked.select(F.col("query_id").alias("p_partkey"), F.col("query").alias("word")).join(numbered, "p_partkey")
    return sp.confidence(pairs.select("word", "suggestion").distinct(), method="ratio").select(
        "word", "suggestion", r6("confidence")
    )


# --- the cascade --------------------------------------------------------------------------


def cascade_queries(spark, sf):
    """Questions as asked, misspelt and with changed letters, plus unrelated texts."""
    corpus = cut(i.corpus(spark, sf).select("faq_id", "question"))
    asked = i.user_turns(spark, sf).select((F.col("query_id") * 10).alias("query_id"), "query")
    parts = tx.segments(F.col("question"))

    def long_word(p):
        return (F.length(p) > 4) & p.rlike("^[a-zA-Z]+$")

    dropped = F.transform(
        parts,
        lambda p, at: F.when(
            long_word(p) & (at % 4 == 0),
            F.concat(F.substring(p, 1, 2), F.substring(p, 4, 1 << 30)),
        ).otherwise(p),
    )
    changed = F.transform(
        parts,
        lambda p: F.when(
            long_word(p), F.concat(F.substring(p, 1, 2), F.lit("q"), F.substring(p, 4, 1 << 30))
        ).otherwise(p),
    )
    misspelt = corpus.select(
        (F.col("faq_id") * 10 + 1).alias("query_id"), F.array_join(dropped, "").alias("query")
    )
    altered = corpus.select(
        (F.col("faq_id") * 10 + 2).alias("query_id"), F.array_join(changed, "").alias("query")
    )
    unrelated = i.table(spark, sf, "benchmark").select(
        (F.col("item_id") * 10 + 3).alias("query_id"), F.col("text").alias("query")
    )
    return asked.unionByName(misspelt).unionByName(altered).unionByName(unrelated)


@query()
def answer_cascade(spark, sf):
    corpus = cut(i.embedded_corpus(spark, sf))
    vocabulary = cut(sp.learn_vocabulary(corpus, "question"))
    known = Knowledge(corpus, sp.domain_terms(vocabulary), vocabulary, i.ENCODER)
    return answer(cascade_queries(spark, sf), known).select(
        "query_id", "answer", r6("similarity"), "stage", "confidence", "response"
    )
