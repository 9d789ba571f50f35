"""Queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, mixing, pii, quality_model, quality_rules, simhash, substrings, token_counts
from .sampling import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.spans(table(spark, sf_dir, "documents"))
    counts = [pii.counted(F.col("base"), k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scanned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality_model.scored(docs, quality_model.learned(docs, table(spark, sf_dir, "labels")))
    held_out = fold(F.col("doc_id"), quality_model.FOLDS) == quality_model.HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_model.CUTOFF).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return found.select("row.doc_id", "size", "source_size", "target", "taken", "row.source")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.counted(table(spark, sf_dir, "documents"))
    sections = F.size("section_tokens").cast("long").alias("n_sections")
    return found.select("doc_id", "n_tokens", sections, "n_crossing", F.array_join(F.col("section_tokens").cast("array<string>"), ",").alias("section_tokens"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identified(docs, language_id.learned(docs), keep=["doc_id"])
    held_out = fold(F.col("row.doc_id"), language_id.FOLDS) == language_id.HELD_OUT
    return found.select("row.doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.cleaned(table(spark, sf_dir, "documents"), ["doc_id"], with_text=False)
    return found.select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_pii, op2_decontamination, op3_quality_classifier, op4_substring_dedup, op5_source_mixing, op6_token_counts, op7_quality_rules, op8_language_id, op9_line_dedup, op10_simhash_near_dedup)}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL for the queries that SQL can express; the others depend on hash functions, encodings or fitted models that it lacks.
ORACLES: dict[str, str] = {
    "op2_decontamination": rf"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS key FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT k, i, p.n, item FROM (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM places) p JOIN windows USING (n, key)),
covered AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT k, i, n FROM hits)) GROUP BY k),
found AS (SELECT k, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (k) LEFT JOIN found USING (k)""",
    "op4_substring_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT k, id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT k, id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
first AS (SELECT h, min(id) AS least FROM windows GROUP BY h),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 50)) AS place FROM windows JOIN first USING (h) WHERE id > least),
words AS (SELECT k, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word FROM docs),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (k, place) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (k)""",
}
