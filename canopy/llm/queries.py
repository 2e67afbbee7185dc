"""Queries over the document tables, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.line_dedup import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (
  SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.*, coalesce(k.doc_id <> s.last_id, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.decontaminate import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("clean_text")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
k AS (
  SELECT item, size, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM k),
o AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, z WHERE len(w) >= size)),
m AS (SELECT o.doc_id, o.p, o.size, k.item FROM o JOIN k USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, raw, n, unnest(range(0, n)) AS i FROM d),
w AS (
  SELECT doc_id, i, raw[i + 1 : i + 1] AS byte,
         CASE WHEN i + 400 <= n THEN hash(raw[i + 1 : i + 400]) END AS h400,
         CASE WHEN i + 256 <= n THEN hash(raw[i + 1 : i + 256]) END AS h256
  FROM p),
f AS (
  SELECT doc_id, i, byte,
         CASE WHEN h400 IS NOT NULL AND count(*) OVER (PARTITION BY h400) > 1 THEN i END AS s400,
         CASE WHEN h256 IS NOT NULL AND count(*) OVER (PARTITION BY h256) > 1 THEN i END AS s256
  FROM w),
g AS (
  SELECT doc_id, i, byte,
         max(s400) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone,
         max(s256) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 255 PRECEDING AND CURRENT ROW) IS NOT NULL AS seen,
         hex(byte) IN ('20', '09', '0A', '0B', '0C', '0D') AS blank
  FROM f),
e AS (
  SELECT *, lag(gone, 1, FALSE) OVER x AS gone_before, lag(seen, 1, FALSE) OVER x AS seen_before, lag(blank, 1, TRUE) OVER x AS blank_before
  FROM g WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, count(*) FILTER (seen AND NOT seen_before) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM e),
q AS (SELECT doc_id, count(*) AS n_passages FROM (
  SELECT doc_id, run FROM r WHERE seen GROUP BY doc_id, run HAVING count(*) FILTER (NOT blank AND (blank_before OR NOT seen_before)) > 50) GROUP BY doc_id),
k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT gone_before) AS n_spans,
         string_agg(hex(byte), '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256, coalesce(n_passages, 0) AS n_passages
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN q USING (doc_id)
"""


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.near_dedup import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> bytes:
    """A public tokenizer's file, read by the driver; executors get its bytes."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.token_files import read_tokens, write_tokens

    return read_tokens(write_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))).drop("ids")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.language_id import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.personal_data import personal_data

    return personal_data(_table(spark, sf_dir, "documents")).drop("scored")


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.sentence_pieces import encode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, _vocabulary("piece_bpe_32k.model"), whole=True).drop("text", "ids", "nbest_ids")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_language_id": op2_language_id,
        "op3_personal_data": op3_personal_data,
        "op4_sentence_pieces": op4_sentence_pieces,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_decontaminate": op6_decontaminate,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_near_dedup": op8_near_dedup,
        "op9_token_files": op9_token_files,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op6_decontaminate": OP6_SQL, "op7_suffix_dedup": OP7_SQL}
