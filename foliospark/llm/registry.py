"""The queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import alignment, chat, decontaminate, exact_dedup, jaccard_join, language_id, license_scan, mixing, quality, spelling, suffix_dedup, token_counts, token_files
from foliospark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=80)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.format_segments(chat.text_messages(turns)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", F.col("shard"), F.col("segment"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_no"))
    return exact_dedup.exact_dedup(placed, locator=[F.col("file"), F.col("row_no")])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), repetition_limit=2.0)
    return mixed.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_block_mark", "mix_mark")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), least_length=7, least_count=2, ratio=10)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least=0.3)


OP7_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op9_sql() -> str:
    quoted = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)
    least, most = (f(map(len, license_scan.SENTENCES)) for f in (min, max))
    line = license_scan.SPDX_LINE
    return rf"""
WITH known(sentence, id) AS (VALUES {quoted(license_scan.SENTENCES.items())}),
spdx(name) AS (VALUES {quoted((x,) for x in license_scan.SPDX)}),
rules(name, pattern) AS (VALUES {quoted((name, license_scan._pattern(ids)) for name, ids in license_scan.RULES)}),
cut AS (
  SELECT doc_id, string_split(lower(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t\r\n\f]+', '\1' || chr(10), 'g'), '[^A-Za-z0-9\n]+', ' ', 'g')), chr(10)) AS s
  FROM documents
),
parts AS (SELECT doc_id, list_filter(list_transform(s, lambda x: trim(x)), lambda x: x <> '') AS s FROM cut),
numbered AS (SELECT doc_id, s, unnest(s) AS piece, generate_subscripts(s, 1) AS k FROM parts),
placed AS (SELECT *, sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM numbered),
ends AS (SELECT doc_id, upto - 1 AS at FROM placed),
opened AS (SELECT p.doc_id, p.k, p.upto - length(p.piece) AS at, substring(array_to_string(p.s[p.k:p.k + {most}], ' '), 1, {most}) AS ahead FROM placed p),
spans AS (
  SELECT o.doc_id, o.k, arg_max(n.id, length(n.sentence)) AS id
  FROM opened o JOIN known n ON left(o.ahead, {least}) = left(n.sentence, {least}) AND starts_with(o.ahead, n.sentence)
  JOIN ends e ON e.doc_id = o.doc_id AND e.at = o.at + length(n.sentence) - 1
  GROUP BY ALL
),
lines AS (
  SELECT doc_id, k, CASE WHEN piece = '{line}' THEN s[k + 1] WHEN starts_with(piece, '{line} ') THEN substring(piece, {len(line) + 2}) END AS said FROM numbered
),
named AS (SELECT doc_id, k, regexp_split_to_array(replace(said, ' or later', ' orlater'), ' (?:or|and) ') AS l FROM lines WHERE said IS NOT NULL),
each AS (SELECT doc_id, k, generate_subscripts(l, 1) AS j, replace(regexp_replace(unnest(l), ' with .*$', ''), ' orlater', ' or later') AS name FROM named),
spoken AS (
  SELECT doc_id, k, string_agg('spdx.' || replace(e.name, ' ', '_'), ' ' ORDER BY j) AS id FROM each e LEFT JOIN spdx USING (name)
  GROUP BY ALL HAVING count(*) = count(spdx.name)
),
hits AS (SELECT doc_id, string_agg(id, ' ' ORDER BY k) AS ids FROM (SELECT * FROM spans UNION ALL SELECT * FROM spoken) u GROUP BY 1),
met AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM hits JOIN rules ON regexp_matches(' ' || ids || ' ', pattern) GROUP BY 1)
SELECT p.doc_id, CAST(len(p.s) AS BIGINT) AS n_sentences, coalesce(h.ids, '') AS sentence_ids, coalesce(m.licenses, '') AS licenses
FROM parts p LEFT JOIN hits h USING (doc_id) LEFT JOIN met m USING (doc_id)
"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and not name.endswith("_sql")}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op9_license_scan": op9_sql()}
