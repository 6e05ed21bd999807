"""Retrieval and answers: an index of a corpus, the chunks that fit a question, and direct against guarded answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weir.functions import similarity as S
from weir.operators import models as M, retrieval as V
from weir.plans import pipeline

TOP, BEST = 15, 5
SYSTEM = "Answer the question from the given context alone. If the context does not hold the answer, say that you don't know."


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def build_index(corpus: DataFrame, path: str, embedder: Callable[[], M.Embedder], key: str = "path", name: str = "index") -> None:
    """Write the chunks of corpus (key, text), distinct by content, with their unit vectors: doc, key, chunk_id, text, vector."""
    chunks = V.chunk(corpus, key).withColumnRenamed(key, "key")
    once = chunks.groupBy(F.xxhash64("text").alias("doc"), "text").agg(F.min(F.struct("key", "chunk_id")).alias("first"))
    rows = once.select("doc", "first.key", "first.chunk_id", "text", M.embed(F.col("text"), embedder, name).alias("vector"))
    rows.withColumn("vector", S.normalized(F.col("vector"))).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def index(spark: SparkSession, corpus: DataFrame, path: str, embedder: Callable[[], M.Embedder], key: str = "path", name: str = "index") -> DataFrame:
    """The index at path, built first if it isn't there."""
    if not _exists(spark, path):
        build_index(corpus, path, embedder, key, name)
    return load_index(spark, path)


def documents(chunks: DataFrame) -> DataFrame:
    """All chunks of an index, in the corpus's order."""
    return chunks.select("key", "chunk_id", "text").orderBy("key", "chunk_id")


def retrieve(chunks: DataFrame, questions: DataFrame, embedder: Callable[[], M.Embedder], top: int = TOP, best: int = BEST, name: str = "index") -> DataFrame:
    """(query, rank, doc, text, score): the best chunks for each question (query, text): dense and sparse lists, fused, then by cosine."""
    asked = questions.select("query", "text", M.embed(F.col("text"), embedder, name).alias("vector"))
    dense = V.top(V.dense(chunks.select("doc", "vector"), asked), top)
    sparse = V.with_zeros(V.top(V.bm25(chunks, questions, "doc"), top), chunks, questions, top)
    fused = V.top(V.fuse(dense, sparse), 2 * top)
    ranked = V.rerank(fused, chunks.select("doc", "vector"), asked, best)
    return ranked.join(chunks.select("doc", "text"), "doc").select("query", "rank", "doc", "text", "score")


def contexts(found: DataFrame, questions: DataFrame) -> DataFrame:
    """(query, text, retrieved_context): each question with its chunks, best first; none as an empty list."""
    lists = found.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda c: c["text"]).alias("chunks"))
    own = questions.select("query", F.col("text").alias("question")).join(lists, "query", "left")
    return own.select("query", F.col("question").alias("text"), F.coalesce("chunks", F.array().cast("array<string>")).alias("retrieved_context"))


def _messages(question: Column) -> Column:
    none, calls = F.lit(None).cast("string"), F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")

    def said(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"), none.alias("tool_call_id"), calls.alias("calls"))

    return F.array(said("system", F.lit(SYSTEM)), said("user", question))


def requests(asked: DataFrame, app_id: str = "default", model: str = "mock") -> DataFrame:
    """contexts() as requests: the chunks stand in the prompt, and beside it for the guards."""
    null = F.lit(None)
    kinds = {"completion_text": "string", "tool_calls": "array<struct<id:string,name:string,arguments:string>>", "reasoning_text": "string", "reasoning_content": "string",
             "logprobs": "array<struct<token:string,logprob:double,top_logprobs:array<double>>>", "ts": "timestamp"}
    return asked.select(
        F.col("query").cast("string").alias("trace_id"), F.lit(app_id).alias("app_id"), F.lit(model).alias("model"), F.lit(False).alias("stream"),
        _messages(V.prompt(F.col("retrieved_context"), F.col("text"))).alias("messages"), "retrieved_context", *(null.cast(v).alias(k) for k, v in kinds.items()),
    )


def answers(
    asked: DataFrame, policies: DataFrame, tool_rules: DataFrame, app_id: str = "default",
    model: Callable[[DataFrame], DataFrame] = pipeline.mock_upstream, models: M.Models = M.Models(),
) -> DataFrame:
    """(query, direct, guarded, action, reason, http_status, grounding): what the model says alone, and what the guards make of it."""
    own = requests(asked, app_id)
    direct = model(own.withColumn("skip", F.lit(False))).select(F.col("trace_id").alias("query"), F.col("completion_text").alias("direct"))
    d = F.col("decision")
    guarded = pipeline.evaluate(own, policies, tool_rules, model=model, models=models).select(
        F.col("trace_id").alias("query"), F.when(d["action"] != "BLOCK", F.col("response")).alias("guarded"), d["action"].alias("action"), d["reason"].alias("reason"),
        F.coalesce(d["http_status"], F.col("upstream_status")).alias("http_status"), F.try_element_at(d["scores"], F.lit("rag_hallucination_engine")).alias("grounding"),
    )
    return direct.join(guarded, "query")
