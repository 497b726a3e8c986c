"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, langid, lines, matroska, neardup, packing, spans, tokencount, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80).drop("version")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_report(_table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(matroska.mux_table(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_additive_quantisation": op9_additive_quantisation,
    "op10_matroska": op10_matroska,
}

_LINES = r"""
SELECT doc_id, i AS pos, parts[i] AS line,
       translate(trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
"""

#: Each document's set: its distinct shingles of two words, which hold no blanks.
_SETS = r"""
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w
                          ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w)
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": f"""
WITH l AS ({_LINES}),
h AS (SELECT k, min(doc_id) AS head FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.doc_id, l.pos, l.line, h.head IS NOT NULL AND h.head < l.doc_id AS gone FROM l LEFT JOIN h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op2_near_duplicates": f"""
WITH RECURSIVE {_SETS},
sets AS (SELECT doc_id, s, len(s) AS n, sha256(array_to_string(list_sort(s), chr(10))) AS c FROM s),
classes AS (SELECT c, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS d FROM sets WHERE n > 0 AND doc_id IS NOT NULL GROUP BY c),
g AS (SELECT c, n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b FROM g a JOIN g b ON a.g = b.g AND a.c < b.c AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
            GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
own AS (SELECT DISTINCT doc_id, c FROM sets WHERE n > 0 AND doc_id IS NOT NULL),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION
          SELECT x.c, y.c FROM own x JOIN own y ON x.doc_id = y.doc_id AND x.c <> y.c),
reached AS (SELECT c, d FROM classes UNION SELECT edges.b, reached.d FROM reached JOIN edges ON reached.c = edges.a),
least AS (SELECT c, min(d) AS component_id FROM reached GROUP BY c)
SELECT doc_id, n AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(component_id, doc_id) END AS component_id,
       coalesce(doc_id = component_id, true) AS kept
FROM sets LEFT JOIN least USING (c)""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS address,
             list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), lambda a, b: a || b) AS payload_digest
      FROM p),
h AS (SELECT *, min(page_id) OVER (PARTITION BY address) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM h""",
}
