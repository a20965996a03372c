"""Operator inputs derived from the given tables, and the same inputs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text as tx
from quaestor.operators.corpus import assign_ids, clean_questions, history_pairs
from quaestor.operators.embed import HashingEncoder, embed
from quaestor.operators.spelling import learn_vocabulary
from quaestor.session import spread

ENCODER = HashingEncoder(64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # each table is one file with one row group here; long texts need all cores
    return spread(df) if name == "documents" else df


def source_pairs(spark, sf_dir) -> DataFrame:
    """conv_id, turn, question, answer, source_url"""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("conv_id"), "url")
    return (
        history_pairs(table(spark, sf_dir, "conversations"))
        .join(pages, "conv_id", "left")
        .select("conv_id", "turn", "question", "answer", F.coalesce("url", F.lit("")).alias("source_url"))
    )


def corpus(spark, sf_dir) -> DataFrame:
    numbered = assign_ids(source_pairs(spark, sf_dir), ["conv_id", "turn"])
    return clean_questions(numbered.select("faq_id", "question", "answer", "source_url"))


def embedded_corpus(spark, sf_dir) -> DataFrame:
    return embed(corpus(spark, sf_dir), "question_clean", ENCODER)


def items(spark, sf_dir) -> DataFrame:
    """The nested form the source data has: one row per conversation."""
    return (
        source_pairs(spark, sf_dir)
        .groupBy(F.col("conv_id").alias("item_id"), F.col("source_url").alias("url"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("_p"))
        .select(
            "item_id",
            "url",
            F.transform(
                "_p", lambda p: F.struct(p["question"].alias("question"), p["answer"].alias("answer"))
            ).alias("faq_pairs"),
        )
    )


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("faq_id"), "embedding")


def mixed_vectors(spark, sf_dir) -> DataFrame:
    """0.9 v(i) + 0.436 v(i+1): near one known neighbour, not equal to it."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_next"))
    return v.join(after, "vec_id").select(
        F.col("vec_id").alias("query_id"),
        F.zip_with(
            "embedding",
            "_next",
            lambda a, b: a.cast("double") * 0.9 + b.cast("double") * 0.436,
        ).alias("embedding"),
    )


def user_turns(spark, sf_dir) -> DataFrame:
    """query_id, query: everything users asked"""
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") == "user")
        .select((F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    )


def texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")


def vocabulary(spark, sf_dir) -> DataFrame:
    return learn_vocabulary(texts(spark, sf_dir), "text")


def corpus_vocabulary(spark, sf_dir) -> DataFrame:
    return learn_vocabulary(source_pairs(spark, sf_dir), "question")


def chat_words(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.explode(tx.words(F.col("text"))).alias("word")
    )


def accesses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def entries(spark, sf_dir) -> DataFrame:
    """Cache entries: namespace, key, created_at, accessed_at, access_count, size_bytes"""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("key")
        )
        .agg(
            F.min(F.col("ts").cast("timestamp")).alias("created_at"),
            F.max(F.col("ts").cast("timestamp")).alias("accessed_at"),
            F.count("*").alias("access_count"),
            F.round(F.sum("value") * 100).cast("long").alias("size_bytes"),
        )
    )


def short_names(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts by name as corpus; the names with words swapped, or one letter short, as queries."""
    part = table(spark, sf_dir, "part")
    ids = assign_ids(part.select("p_partkey", "p_name"), ["p_partkey"])
    swapped = F.concat_ws(" ", F.reverse(F.split("p_name", " ")))
    shortened = F.concat(F.expr("substring(p_name, 1, 3)"), F.expr("substring(p_name, 5)"))
    queries = part.select(
        F.col("p_partkey").alias("query_id"),
        F.when(F.col("p_partkey") % 2 == 0, swapped).otherwise(shortened).alias("query"),
    )
    return ids.select("faq_id", F.col("p_name").alias("question")), queries


# --- the same in SQL ----------------------------------------------------------------------

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def clean_sql(x: str, lower=True, punctuation=True, digits=True) -> str:
    if lower:
        x = f"lower({x})"
    if punctuation:
        x = f"regexp_replace({x}, '[[:punct:]]', ' ', 'g')"
    if digits:
        x = rf"regexp_replace({x}, '\p{{Nd}}+', '', 'g')"
    return strip_sql(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def words_sql(x: str) -> str:
    return (
        rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}_]+'), "
        r"lambda t: regexp_matches(t, '^[a-z]+$'))"
    )


PAIRS = """
pairs AS (
  SELECT p.conv_id, p.turn, p.question, p.answer, coalesce(g.url, '') AS source_url
  FROM (SELECT conv_id, turn, role, text AS question,
               lead(role) OVER w AS next_role, lead(text) OVER w AS answer
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) p
  LEFT JOIN pages g ON g.page_id = p.conv_id
  WHERE p.role = 'user' AND p.next_role = 'assistant')
"""

CORPUS = (
    PAIRS
    + f""", corpus AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS faq_id, question, answer, source_url,
         {clean_sql('question')} AS question_clean
  FROM pairs)
"""
)


def embed_sql(name: str, source: str, id_col: str, text: str, dim: int = 64) -> str:
    """CTEs that give `name` (id, v DOUBLE[]): the hashing encoder in SQL."""
    return rf"""
{name}_tok AS (
  SELECT id, md5(t) AS h FROM (
    SELECT {id_col} AS id, unnest(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}_]+')) AS t
    FROM {source}) WHERE t <> ''),
{name}_slot AS (
  SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % {dim} AS slot,
         sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s
  FROM {name}_tok GROUP BY 1, 2),
{name}_norm AS (SELECT id, sqrt(sum(s * s)) AS n FROM {name}_slot GROUP BY 1),
{name} AS (
  SELECT a.id, list(coalesce(CASE WHEN n.n > 0 THEN (s.s / n.n)::FLOAT END, 0)::DOUBLE ORDER BY d.slot) AS v
  FROM (SELECT {id_col} AS id FROM {source}) a
  CROSS JOIN (SELECT unnest(range({dim})) AS slot) d
  LEFT JOIN {name}_slot s ON s.id = a.id AND s.slot = d.slot
  LEFT JOIN {name}_norm n ON n.id = a.id
  GROUP BY a.id)
"""


COSINE = """CASE WHEN list_sum(list_transform(q.v, lambda x: x * x)) = 0
                  OR list_sum(list_transform(c.v, lambda x: x * x)) = 0 THEN 0.0
             ELSE list_cosine_similarity(q.v, c.v) END"""

VECTORS = """
c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
q AS (
  SELECT a.vec_id AS id,
         list_transform(range(1, len(a.embedding) + 1),
           lambda i: a.embedding[i]::DOUBLE * 0.9::DOUBLE + b.embedding[i]::DOUBLE * 0.436::DOUBLE) AS v
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
"""


def repair_sql(source: str, id_col: str, text: str, out: str = "repaired") -> str:
    """CTEs for the repair rules by run lengths (no back-references needed)."""

    def runs(name, src, keep):
        return f"""
{name}_c AS (SELECT id, unnest(regexp_extract_all(txt, '(?s).')) AS ch,
                    unnest(range(len(regexp_extract_all(txt, '(?s).')))) AS i FROM {src}),
{name}_r AS (SELECT id, ch, min(i) AS i, count(*) AS n
             FROM (SELECT *, i - row_number() OVER (PARTITION BY id, ch ORDER BY i) AS g FROM {name}_c)
             GROUP BY id, ch, g),
{name} AS (SELECT s.id, coalesce(r.txt, '') AS txt FROM {src} s LEFT JOIN (
             SELECT id, string_agg(repeat(ch, CAST({keep} AS INTEGER)), '' ORDER BY i) AS txt
             FROM {name}_r GROUP BY id) r ON r.id = s.id)"""

    return f"""
{out}_0 AS (SELECT {id_col} AS id, {text} AS txt FROM {source}),
{runs(out + "_1", out + "_0", "CASE WHEN n >= 4 AND ch <> chr(10) THEN 2 ELSE n END")},
{out}_2 AS (SELECT id, regexp_replace(txt, '{SPACE}+', ' ', 'g') AS txt FROM {out}_1),
{runs(out, out + "_2", "CASE WHEN n >= 3 AND regexp_matches(ch, '^[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]$') THEN 1 ELSE n END")}
"""


ENTRIES = """
entries AS (
  SELECT event_type AS namespace, user_id::VARCHAR AS key, min(ts) AS created_at,
         max(ts) AS accessed_at, count(*) AS access_count,
         round(sum(value) * 100)::BIGINT AS size_bytes
  FROM events GROUP BY 1, 2)
"""

ACCESSES = """
accesses AS (
  SELECT event_id, user_id::VARCHAR || '/' || event_type AS key, epoch_us(ts) AS t FROM events)
"""

DAY_US = 24 * 3600 * 1_000_000

# creation times by a walk: the next is the first access more than a day later
MISSES = f"""
misses AS (
  SELECT key, min(t) AS t FROM accesses GROUP BY key
  UNION ALL
  SELECT m.key, (SELECT min(a.t) FROM accesses a WHERE a.key = m.key AND a.t > m.t + {DAY_US}) AS t
  FROM misses m
  WHERE EXISTS (SELECT 1 FROM accesses a WHERE a.key = m.key AND a.t > m.t + {DAY_US}))
"""
