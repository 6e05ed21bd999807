"""Retrieval: chunking, BM25, exact vector search, rank fusion, reranking.

Queries are a stated, small set; their side is what is broadcast, after its size is checked by the planner.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weir.functions import similarity as S, text as T

K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_text(text: str, size: int = 300, overlap: int = 50, separators: tuple = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at the coarsest separator that serves, neighbours sharing up to `overlap`."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    if sep:
        parts = text.split(sep)
        parts = [p for p in [parts[0], *(sep + p for p in parts[1:])] if p]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        joined = "".join(held).strip()
        if joined:
            out.append(joined)

    small: list[str] = []

    def pack() -> None:
        nonlocal held
        total = 0
        for p in small:
            if held and total + len(p) > size:
                flush()
                while held and (total > overlap or total + len(p) > size):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        if held:
            flush()
        held = []
        small.clear()

    for p in parts:
        if len(p) < size:
            small.append(p)
        else:
            pack()
            out.extend(split_text(p, size, overlap, finer) if finer else [p])
    pack()
    return out


def chunk(docs: DataFrame, key: str, text: str = "text", size: int = 300, overlap: int = 50) -> DataFrame:
    """(key, chunk_id, text): chunks of each text in order."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: split_text(x, size, overlap) if x else [])

    return docs.select(key, F.posexplode(cut(F.col(text))).alias("chunk_id", "text"))


def postings(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(doc, length, term, tf)."""
    words = docs.select(F.col(key).alias("doc"), T.word_list(F.col(text)).alias("w"))
    terms = words.select("doc", F.size("w").alias("length"), F.explode("w").alias("term"))
    return terms.groupBy("doc", "term").agg(F.first("length").alias("length"), F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(query, doc, score) for documents that share a term with a query (query, text); repeated query terms count each time.

    One pass over the texts gives document counts of all terms with the corpus's size and length, under the empty term; another the
    postings of the queries' terms alone, before anything is shuffled.
    A term in more than half of the documents has epsilon times the mean inverse frequency of all terms.
    """
    words = docs.select(F.col(key).alias("doc"), T.word_list(F.col(text)).alias("w"))
    each = F.concat(F.array(F.struct(F.lit("").alias("term"), F.size("w").alias("k"))), F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("k"))))
    counts = words.select(F.explode(each).alias("e")).groupBy("e.term").agg(F.count("*").alias("df"), F.sum("e.k").alias("k"))
    stats = counts.where("term = ''").select(F.col("df").alias("n"), (F.col("k") / F.col("df")).alias("avgdl"))
    df = counts.where("term <> ''")
    idf = df.crossJoin(F.broadcast(stats)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg(F.avg("raw").alias("mean"))
    asked = queries.select("query", F.explode(T.word_list(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qf"))
    weights = asked.join(idf, "term").crossJoin(F.broadcast(mean)).select(
        "query", "term", "qf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")
    )
    held = words.select("doc", F.size("w").alias("length"), F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = held.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    joined = tf.join(weights, "term").crossJoin(F.broadcast(stats))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    return joined.groupBy("query", "doc").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int, score: str = "score", doc: str = "doc") -> DataFrame:
    """scored with rank (from 0) of the best k per query. Scores are compared to nine decimals, ties by doc.

    Best k of each query and part come first, so no task sorts all rows of a query.
    """
    order = [F.round(score, 9).desc(), F.col(doc).asc()]
    dealt = scored.withColumn("_part", F.pmod(F.xxhash64(doc), F.lit(64)))
    near = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("query", "_part").orderBy(*order))).where(F.col("_r") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)) - 1)
    return last.where(F.col("rank") < k).drop("_part", "_r")


def with_zeros(ranked: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """ranked lists (query, doc, rank, score) filled up to k with the least documents that share no term with the query, at score 0."""
    least = docs.select("doc").orderBy("doc").limit(k)  # a list lacks as many as it holds of these at most
    free = queries.select("query").crossJoin(least).join(ranked.select("query", "doc"), ["query", "doc"], "left_anti")
    held = ranked.groupBy("query").agg(F.count("*").alias("held"))
    placed = free.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("doc"))).join(held, "query", "left")
    rank = F.coalesce("held", F.lit(0)) + F.col("_n") - 1
    more = placed.withColumn("rank", rank).where(F.col("rank") < k).select("query", "doc", F.col("rank").cast("int").alias("rank"), F.lit(0.0).alias("score"))
    return ranked.select("query", "doc", F.col("rank").cast("int").alias("rank"), "score").unionByName(more)


def dense(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc, score): cosine of every vector (doc, vector) to each query (query, vector).

    Every vector is normalised once, then meets the queries; the planner broadcasts them if their size lets it, else it works block by block.
    """
    asked = queries.select("query", S.normalized(F.col("vector")).alias("_q"))
    both = vectors.select("doc", S.normalized(F.col("vector")).alias("_v")).crossJoin(asked)
    return both.select("query", "doc", S.dot(F.col("_v"), F.col("_q")).alias("score"))


def fuse(dense_top: DataFrame, sparse_top: DataFrame) -> DataFrame:
    """(query, doc, score): reciprocal rank fusion of ranked lists (query, doc, rank)."""
    both = dense_top.select("query", "doc", "rank").unionByName(sparse_top.select("query", "doc", "rank"))
    return both.groupBy("query", "doc").agg(F.sum(1.0 / (RRF + F.col("rank") + 1)).alias("score"))


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """The best n candidates of each query by cosine."""
    own = candidates.select("query", "doc").join(vectors, "doc").join(queries.select("query", F.col("vector").alias("_q")), "query")
    return top(own.select("query", "doc", S.cosine(F.col("vector"), F.col("_q")).alias("score")), n)


def prompt(chunks: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), F.array_join(chunks, "\n\n---\n\n"), F.lit("\n\nQuestion: "), question)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is not 0."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m > 0, v)), lambda v: v.isNotNull())
    total = F.aggregate(F.slice(kept, F.lit(2), F.greatest(F.size(kept), F.lit(1))), F.try_element_at(kept, F.lit(1)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(kept))
