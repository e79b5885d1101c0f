"""Registered queries of the operators, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwise.llm import (
    collocations, decontam, infill, langid, licences, line_dedup, packing, quality, simhash, site_tree, token_counts, token_store, warc,
)
from packwise.llm.common import col, scratch

WORD_BPE, WORD_END = "word_bpe_49k.json", 1
BYTE_BPE, BYTE_END = "byte_bpe_50k.json", 0
PIECE_BPE, TOKEN_LIMIT = "piece_bpe_32k.model", 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), WORD_END)
    return token_store.digest_store(token_store.open_store(spark, path))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(_table(spark, sf_dir, "pages")))
    return records.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that a language model may learn from."""
    return docs.where(F.crc32(col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn(learnable(docs))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.build_index(_table(spark, sf_dir, "documents"))
    found = decontam.contamination(index, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = site_tree.extract(pages).select("page_id", "url", "text")
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels")
    rows = quality.labelled_rows(docs, quality.marks_of(labels))
    counts = quality.counts_with(docs, rows)
    cut = quality.held_out_cut(quality.scores_without_self(rows, counts))
    return quality.judge(docs.drop("lang"), quality.weights_of(counts), cut).drop("text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs, public_tokenizers.path(PIECE_BPE), TOKEN_LIMIT).drop("text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), BYTE_END)
    return pieces.drop("ids")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.rearrange(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"), "score", F.size("spans").alias("n_spans"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_store, op2_line_dedup, op3_warc_derivatives, op4_simhash, op5_language, op6_decontamination,
        op7_site_tree, op8_quality, op9_token_counts, op10_packing, op11_infill, op12_licences,
        op13_collocations)
}

_STRIP = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$'"

ORACLES: dict[str, str] = {
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(regexp_replace(ls[i], {_STRIP}, '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       range(1, len(ls) + 1) t(i)
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, coalesce(l.doc_id < r.keeper, false) AS gone FROM lines l LEFT JOIN repeated r USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_infill": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1,
         CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
         CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM cut
), shaped AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parted AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
         array_to_string(u[b + 1:n], '') AS s FROM shaped
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parted
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counts AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS c
  FROM worded, range(1, 4) s(m), range(1, len(w) - m + 2) t(i) GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND c >= 10),
cuts AS (
  SELECT p.lang, p.phrase, p.a, k, x.c AS l, y.c AS r,
         (1000000::HUGEINT * p.a * p.a) // (x.c::HUGEINT * y.c) AS score
  FROM (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
        FROM candidates, range(1, 3) t(k) WHERE k < m) p
  JOIN counts x ON x.lang = p.lang AND x.phrase = p.head AND x.m = p.k
  JOIN counts y ON y.lang = p.lang AND y.phrase = p.rest AND y.m = p.m - p.k
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN candidates b
  ON s.lang = b.lang AND s.m = 2 AND b.m = 3
     AND (s.phrase = array_to_string(b.w[1:2], ' ') OR s.phrase = array_to_string(b.w[2:3], ' '))
  WHERE 100 * b.a >= 50 * s.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
         phrase, a, l, r, CAST(score AS BIGINT) AS score
  FROM lowest ANTI JOIN inside USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    "op6_decontamination": r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win
  FROM item_words, range(1, greatest(len(w) - 9, 1) + 1) t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), found AS (
  SELECT doc_id, item_id, p, n FROM (
    SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS win
    FROM doc_words, sizes, range(1, len(w) - n + 2) t(p) WHERE len(w) >= n
  ) JOIN windows USING (win)
), hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, range(p, p + n) t(q) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
