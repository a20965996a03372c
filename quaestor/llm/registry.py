"""The operators as queries over the whole given tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quaestor.llm import (
    chat, decontaminate, fim, html, langid, linededup, merkle, mixture, neardup, quality, rules, simhash, warc,
)
from quaestor.llm.graph import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; no SQL, accuracy is tested on the held-out rows."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    judged = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return judged.drop("_text")


OP2_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM item WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM wins
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), docwins AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc.*, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, lengths WHERE len(w) >= n)
), found AS (
  SELECT DISTINCT doc_id, i, d.n, item_id FROM docwins d JOIN wins USING (n, win)
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the corpus' tokens, mixed to the recipe's weights."""
    return mixture.mix(_table(spark, sf_dir, "documents"))


def mixture_sql(documents: str, columns: str = "doc_id, domain, lang, source, epoch, n_tokens, take_tokens") -> str:
    """The mixture of RECIPE over a table, in SQL."""
    return rf"""
WITH t AS (
  SELECT doc_id, {mixture.RECIPE.domain_of} AS domain, coalesce(lang, 'unknown') AS lang,
         coalesce(source, 'unknown') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM {documents}
), leaf AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS available, CAST(2 * sum(n_tokens) AS BIGINT) AS cap,
         CASE domain WHEN 'web' THEN 3 WHEN 'news' THEN 4 WHEN 'books' THEN 2 ELSE 1 END AS w_domain,
         CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS w_lang
  FROM t WHERE n_tokens > 0 GROUP BY domain, lang, source
), l AS (
  SELECT domain, lang, w_domain, w_lang, CAST(sum(cap) AS BIGINT) AS cap FROM leaf GROUP BY ALL
), d AS (
  SELECT domain, w_domain, CAST(sum(cap) AS BIGINT) AS cap,
         (SELECT CAST(floor(coalesce(sum(available), 0) * 1 / 2) AS BIGINT) FROM leaf) AS budget
  FROM l GROUP BY ALL
), d1 AS (
  SELECT *, cap / w_domain AS ratio,
         (budget - coalesce(sum(cap) OVER (ORDER BY cap / w_domain, domain
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w_domain) OVER (ORDER BY cap / w_domain, domain
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM d
), d2 AS (
  SELECT domain, CAST(CASE WHEN ratio <= top THEN cap ELSE least(cap, floor(top * w_domain)) END AS BIGINT) AS quota
  FROM (SELECT *, max(level) OVER () AS top FROM d1)
), l1 AS (
  SELECT l.*, cap / w_lang AS ratio,
         (quota - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w_lang, lang
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w_lang) OVER (PARTITION BY domain ORDER BY cap / w_lang, lang
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM l JOIN d2 USING (domain)
), l2 AS (
  SELECT domain, lang, CAST(CASE WHEN ratio <= top THEN cap ELSE least(cap, floor(top * w_lang)) END AS BIGINT) AS quota
  FROM (SELECT *, max(level) OVER (PARTITION BY domain) AS top FROM l1)
), s1 AS (
  SELECT leaf.*, cap / 1 AS ratio,
         (quota - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / 1, source
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / count(*) OVER (PARTITION BY domain, lang ORDER BY cap / 1, source
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM leaf JOIN l2 USING (domain, lang)
), s2 AS (
  SELECT domain, lang, source, available,
         CAST(CASE WHEN ratio <= top THEN cap ELSE least(cap, floor(top * 1)) END AS BIGINT) AS quota
  FROM (SELECT *, max(level) OVER (PARTITION BY domain, lang) AS top FROM s1)
), q AS (
  SELECT domain, lang, source, CAST(quota // available AS INTEGER) AS whole, quota % available AS rest
  FROM s2 WHERE quota > 0
), placed AS (
  SELECT t.*, whole, rest FROM t JOIN q USING (domain, lang, source) WHERE n_tokens > 0
), ordered AS (
  SELECT *, coalesce(sum(n_tokens) OVER (
      PARTITION BY domain, lang, source
      ORDER BY md5('17:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed WHERE rest > 0
), chosen AS (
  SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, n_tokens, n_tokens AS take_tokens
  FROM (SELECT *, unnest(range(whole)) AS e FROM placed)
  UNION ALL
  SELECT doc_id, domain, lang, source, whole, n_tokens, CAST(least(n_tokens, rest - before) AS BIGINT)
  FROM ordered WHERE before < rest
)
SELECT {columns} FROM chosen
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document."""
    return rules.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", *rules.MEASURES, "base_failed", "kept", "failed"
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), bits AS (
  SELECT *, CAST(
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_dup_lines >= 5 AND 50 * n_dup_lines > n_words THEN 32 ELSE 0 END AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed % 4 > 0 AS base_failed, failed = 0 AS kept, failed
FROM bits
"""


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every policy version and rule, what the policy keeps with and without it: the ledger is
    stored once, and all answers come from its bits."""
    bits = rules.ledger(_table(spark, sf_dir, "documents")).select("doc_id", "failed")
    return rules.all_ablations(stored(bits, "ledger"))


_RULE_ROWS = ", ".join(
    f"({p}, '{name}', {rules.mask((name,))}, {rules.mask(names)})" for p, names in rules.POLICIES.items() for name in names
)
ABLATIONS_SQL = f"""
WITH patterns AS (
  SELECT failed, count(*) AS n FROM ({OP4_SQL}) GROUP BY failed
), r(policy, rule, bit, bits) AS (VALUES {_RULE_ROWS})
SELECT policy, rule,
       CAST(sum(CASE WHEN failed & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS n_failed,
       CAST(sum(CASE WHEN failed & bits = bit THEN n ELSE 0 END) AS BIGINT) AS n_failed_alone,
       CAST(sum(CASE WHEN failed & bits = 0 THEN n ELSE 0 END) AS BIGINT) AS n_kept,
       CAST(sum(CASE WHEN failed & bits IN (0, bit) THEN n ELSE 0 END) AS BIGINT) AS n_kept_without
FROM patterns, r GROUP BY policy, rule
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; no SQL, accuracy is tested on the held-out rows."""
    return langid.identify(_table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents; tested against brute force."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; no SQL, tested against plain extraction on known markup."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    back = warc.archive(_table(spark, sf_dir, "pages"))
    return back.select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), last AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM last
"""


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation as read back from the formatted pieces."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], rows.schema)
    records = chat.as_records(rows.unionByName(extra))
    pieces = chat.format_turns(chat.canonical_turns(records, ("conv_id", "chunk")))
    back = chat.read_back(pieces.select("conv_id", "chunk", "part", "piece", "loss_from", "loss_len"))
    return chat.digest(back, "conv_id", ["chunk", "part"])


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
    chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), '|>', '|' || chr(92) || '>'),
    '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>'), '[INST]', '[' || chr(92) || 'INST]'),
    '[/INST]', '[' || chr(92) || '/INST]'), '<<SYS>>', '<' || chr(92) || '<SYS>>'),
    '<</SYS>>', '<' || chr(92) || '</SYS>>')) AS n_escaped
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), ''))
         AS loss_sha256,
       CAST(sum(length(role) + n_escaped + 24) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that another one keeps; tested against brute force."""
    rows = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and recomputed root in the manifest's tree."""
    return merkle.audit(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE given AS (
  SELECT doc_id, source, text, concat(
      coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'),
      coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'),
      coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS fields,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents
), leaf AS (
  SELECT doc_id, source, sha256(fields || coalesce(concat(strlen(text), ':', text), '-')) AS h,
    CASE WHEN (4294967295 - crc) % 5 = 0 THEN sha256(fields || coalesce(concat(strlen(text), ':',
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '-')) END AS changed
  FROM given
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp
  FROM leaf
), low AS (
  SELECT 0 AS level, grp, pos, n, h FROM placed
  UNION ALL
  SELECT any_value(level) + 1, grp, pos // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY grp, pos // 16
), tops AS (
  SELECT 0 AS level, grp AS pos, count(*) OVER () AS n, h FROM low WHERE n = 1
  UNION ALL
  SELECT any_value(level) + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY pos))
  FROM tops WHERE n > 1 GROUP BY pos // 16
), nodes AS (
  SELECT 0 AS tree, level, grp, pos, n, h FROM low UNION ALL SELECT 1, level, -1, pos, n, h FROM tops
), paths AS (
  -- a leaf's place on every level of its source's tree, then of the top one
  SELECT doc_id, p.grp, p.pos AS leaf_pos, tree, x.level,
    CASE tree WHEN 0 THEN p.pos ELSE p.grp END // CAST(16 ** x.level AS BIGINT) AS own, x.n
  FROM placed p, (SELECT DISTINCT tree, level, grp, n FROM nodes WHERE n > 1) x
  WHERE x.grp = CASE tree WHEN 0 THEN p.grp ELSE -1 END
), sides AS (
  SELECT t.grp, t.leaf_pos, t.tree, t.level, row_number() OVER (PARTITION BY t.grp, t.leaf_pos ORDER BY t.tree, t.level) AS step,
    coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < t.own), '') AS left_,
    coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > t.own), '') AS right_
  FROM paths t JOIN nodes o ON o.tree = t.tree AND o.level = t.level
    AND o.grp = CASE t.tree WHEN 0 THEN t.grp ELSE -1 END AND o.pos // 16 = t.own // 16
  GROUP BY t.grp, t.leaf_pos, t.tree, t.level
), folded AS (
  SELECT grp, pos AS leaf_pos, 1 AS step, coalesce(changed, h) AS h FROM placed
  UNION ALL
  SELECT f.grp, f.leaf_pos, f.step + 1, sha256(left_ || f.h || right_)
  FROM folded f JOIN sides s ON s.grp = f.grp AND s.leaf_pos = f.leaf_pos AND s.step = f.step
), ends AS (
  SELECT grp, leaf_pos, arg_max(h, step) AS h FROM folded GROUP BY grp, leaf_pos
), proofs AS (
  SELECT grp, leaf_pos, sha256(string_agg(left_ || right_, '' ORDER BY step)) AS proof FROM sides GROUP BY grp, leaf_pos
)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256,
  e.h AS folded_root, e.h = r.h AS verified
FROM placed p JOIN ends e ON e.grp = p.grp AND e.leaf_pos = p.pos
JOIN (SELECT grp, h FROM low WHERE n = 1) s ON s.grp = p.grp
CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
LEFT JOIN proofs q ON q.grp = p.grp AND q.leaf_pos = p.pos
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and reordered, and the text rebuilt from that."""
    made = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents
), drawn AS (
  SELECT doc_id, t, tokens, len(tokens) AS n,
    ('0x' || h[1:8])::UBIGINT::BIGINT AS h1, ('0x' || h[9:16])::UBIGINT::BIGINT AS h2,
    ('0x' || h[17:24])::UBIGINT::BIGINT AS h3, ('0x' || h[25:32])::UBIGINT::BIGINT AS h4
  FROM given
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m,
    array_to_string(tokens[b + 1:], '') AS s
  FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components by fingerprint distance; tested against brute force."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_mixture": op3_mixture,
    "op4_quality_rules": op4_quality_rules,
    "quality_rule_ablations": quality_rule_ablations,
    "op5_language_id": op5_language_id,
    "op6_minhash": op6_minhash,
    "op7_html_extraction": op7_html_extraction,
    "op8_warc": op8_warc,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle": op11_merkle,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_simhash": op13_simhash,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op2_decontamination": OP2_SQL,
    "op3_mixture": mixture_sql("documents"),
    "op4_quality_rules": OP4_SQL,
    "quality_rule_ablations": ABLATIONS_SQL,
    "op8_warc": OP8_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op11_merkle": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
