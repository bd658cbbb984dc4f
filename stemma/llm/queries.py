"""The numbered queries of the training-data operators, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import decontaminate, html_text, minhash_dedup, quality_gam, quality_rules, secret_scan, sentencepiece_codec, suffix_dedup, token_counts, token_output
from stemma.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.measured(docs).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


#: The document end that op5 appends.
END_ID = 2


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_words", "n_tokens")


#: Words of a shingle in op3; the pipeline takes the operator's own, five.
OP3_WORDS = 4


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), words=OP3_WORDS)


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = quality_gam.train(docs, read(spark, sf_dir, "labels").where(fold != 0))
    return quality_gam.score(docs.withColumn("held_out", fold == 0), model).select("doc_id", "held_out", "score", "predicted")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), END_ID)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_pieces(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_pieces", "ids_crc32", "round_trip", "parity")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_minhash_dedup, op4_quality_gam, op5_token_output, op6_suffix_dedup, op7_secret_scan, op8_decontaminate, op9_html_text, op10_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op3_minhash_dedup": OP3_SQL, "op6_suffix_dedup": OP6_SQL, "op8_decontaminate": OP8_SQL}


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, i, words[i] || chr(31) || words[i + 1] || chr(31) || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT doc_id, t, words, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT 100 * n_symbols > 20 * n_words
  AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words)
  AND NOT 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 50 * word_chars
  AND NOT 100 * n_dup_lines > 50 * len(string_split(t, chr(10)))
  AND NOT coalesce(list_bool_or(list_transform(words, lambda x: length(x) > 1000)), false) AS kept
FROM b
"""


#: All pairs of sets with a shingle in common; from each document without a smaller neighbour, all that is reachable.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS least, doc_id FROM documents WHERE doc_id NOT IN (SELECT b FROM links)
  UNION SELECT least, b FROM reached JOIN edges ON a = reached.doc_id
), found AS (
  SELECT doc_id, min(least) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN found USING (doc_id)
"""


#: Every window of 50 bytes as hexadecimal digits, cut out of stretches of 1,000 bytes.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, n, k, substr(h, 2000 * k + 1, 2098) AS h FROM (SELECT *, unnest(range(0, (n + 999) // 1000)) AS k FROM d)
), p AS (
  SELECT doc_id, 1000 * k + j AS i, substr(h, 2 * j + 1, 2) AS byte, CASE WHEN 1000 * k + j + 50 <= n THEN md5_number(substr(h, 2 * j + 1, 100)) END AS w
  FROM (SELECT *, unnest(range(0, least(1000, n - 1000 * k))) AS j FROM c)
), f AS (
  SELECT w, min(doc_id) AS least FROM p WHERE w IS NOT NULL GROUP BY w
), m AS (
  SELECT doc_id, i, byte, coalesce(least < doc_id, false) AS hit FROM p LEFT JOIN f USING (w)
), g AS (
  SELECT doc_id, i, byte, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m
), t AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM g
), r AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM t GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


#: Without the check of slots, which in these tables no two windows need.
OP8_SQL = r"""
WITH src AS (
  SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark
), w AS (
  SELECT DISTINCT kind, id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM src
), x AS (
  SELECT kind, id, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS b FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM w)
), c AS (
  SELECT *, regexp_replace(lower(w), '[^\pL\pN]+', '', 'g') AS core,
    coalesce(regexp_matches(b, '^[^\pL\pN]*\pN+([.,:/\-]\pN+)*[^\pL\pN]*$'), false) AS after_number FROM x
), t AS (
  SELECT kind, id, i, CASE
    WHEN regexp_matches(w, '\pN') THEN CASE
      WHEN regexp_matches(w, '^[^\pL\pN]*\pN+([.,:/\-]\pN+)*[^\pL\pN]*$') THEN '<num>'
      WHEN regexp_matches(lower(w), '^[^\pL\pN]*\pN+([.,]\pN+)*(UNITS)[^\pL\pN]*$') THEN '<num><unit>'
      ELSE core END
    WHEN regexp_full_match(core, 'UNITS') AND after_number THEN '<unit>'
    WHEN i > 1 AND regexp_matches(w, '^[^\pL\pN]*\p{Lu}\p{Ll}') AND NOT regexp_matches(b, '[.!?:;]["'')\]]*$') THEN '<name>'
    ELSE core END AS tok FROM c
), l AS (
  SELECT kind, id, list(tok ORDER BY i) AS toks FROM t GROUP BY kind, id
), bw AS (
  SELECT id AS item_id, size, i AS ipos, array_to_string(toks[i:i + size - 1], chr(31)) AS win, len(toks) - size + 1 AS n_windows
  FROM (SELECT *, unnest(range(1, len(toks) - size + 2)) AS i FROM (SELECT *, least(len(toks), 8) AS size FROM l WHERE kind = 'b' AND len(toks) >= 4))
), dw AS (
  SELECT id AS doc_id, size, array_to_string(toks[i:i + size - 1], chr(31)) AS win
  FROM (SELECT *, unnest(range(1, len(toks) - size + 2)) AS i FROM l CROSS JOIN (SELECT DISTINCT size FROM bw) WHERE kind = 'd' AND len(toks) >= size)
), leaked AS (
  SELECT doc_id, item_id, count(DISTINCT ipos)::DOUBLE / n_windows AS coverage FROM dw JOIN bw USING (size, win)
  GROUP BY doc_id, item_id, n_windows HAVING 100 * count(DISTINCT ipos) >= 50 * n_windows
), best AS (
  SELECT doc_id, count(*) AS n_items, max(coverage) AS coverage FROM leaked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_items, 0)::BIGINT AS n_items,
  (SELECT min(item_id) FROM leaked k WHERE k.doc_id = best.doc_id AND k.coverage = best.coverage) AS item_id,
  coverage, n_items IS NOT NULL AS contaminated, n_items IS NULL AS kept
FROM documents d LEFT JOIN best USING (doc_id)
""".replace("UNITS", "|".join(decontaminate.UNITS))
