"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weir.llm import decontamination, fingerprints, licenses, line_dedup, ngram_join, piece_sampling, pii, token_counts, token_files, toxicity
from weir.llm.shared import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id"))
    out = toxicity.score(docs, toxicity.train(docs, labels))
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, a hash of their ids, and whether decoding gave the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = vocabulary("piece_bpe_32k.model")
    out = piece_sampling.encode(docs, model, decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_decontamination": op2_decontamination,
    "op3_licenses": op3_licenses,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_files": op6_token_files,
    "op7_pii": op7_pii,
    "op8_ngram_join": op8_ngram_join,
    "op9_token_counts": op9_token_counts,
    "op10_piece_sampling": op10_piece_sampling,
}

ORACLE_SQL = {
    "op5_line_dedup": f"""
WITH lines AS (
  SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
seen AS (
  SELECT source, line, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY source, line),
often AS (
  SELECT s.source, list(s.line) AS drops FROM seen s JOIN total t ON s.source IS NOT DISTINCT FROM t.source
  WHERE s.n >= {line_dedup.MIN_PAGES} AND s.n > {line_dedup.RATIO} * t.pages GROUP BY s.source),
cut AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS old,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(o.drops, []), x)) AS new
  FROM documents d LEFT JOIN often o ON d.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, source, len(old)::BIGINT AS n_lines, (len(old) - len(new))::BIGINT AS n_dropped,
  array_to_string(new, chr(10)) AS text FROM cut
""",
}
