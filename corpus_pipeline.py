"""A corpus pipeline: toxic documents go, boilerplate lines go, one of each near-duplicate group stays
without the passages that several of those left share, documents with benchmark passages go, and what is left is encoded by sampled pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows of its docs; labels and benchmark come
from sf_dir. All but the last return the columns of documents; n_chars is counted anew where texts change. Null ids, null and empty
texts, repeated rows, long texts, empty tables and further columns pass every stage, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weir.llm import decontamination, line_dedup, ngram_join, piece_sampling, toxicity
from weir.llm.queries import vocabulary
from weir.llm.shared import scratch_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic. Null texts are kept, as empty ones are; rows go by their own text, whatever their doc_id."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of each source; a null source is one of its own. All rows stay, even if no line is left."""
    return line_dedup.drop_boilerplate(docs, length="n_chars").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, repeated rows and texts without words included; then long passages that those left share go."""
    return line_dedup.drop_passages(ngram_join.one_of_each(docs), length="n_chars").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, row by row."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with ids, n_pieces and lossless (decoding the ids gave the text back), which replace any columns of these names."""
    model = vocabulary("piece_bpe_32k.model")
    out = piece_sampling.encode(docs, model, decoded=True)
    lossless = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.withColumns({"n_pieces": F.size("ids").cast("bigint"), "lossless": lossless}).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding and decoding", encode),
]

#: A trained classifier, near-duplicate groups, edit matching and sampling are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
