"""The request's context: capping, cache keys, stuffing, last messages, the stand-in model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weir.functions import patterns as P, text as T
from weir.operators.decision import result

# The mark of a cut context and the wording around a stuffed one.
MARKER = "\n\n[System: Context truncated due to token optimization limits.]"
STUFFING = (
    "Use ONLY the following context to answer the question. If the answer is not in the context, say you don't have "
    "that information.\n\nCONTEXT:\n"
)
QUESTION = "\n\nQUESTION: "


def last_user(messages: Column) -> Column:
    """The content of the last user message; "" without one."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"], F.lit(""))


def cap(chunks: Column, most: Column) -> Column:
    """Chunks within a budget of characters; the one that passes it is cut, later ones go, and the last one left is marked."""
    def step(a: Column, c: Column) -> Column:
        left = most - a["used"]
        whole = F.length(c) <= left
        cut = c.substr(F.lit(1), left.cast("int"))
        more = F.when(whole, F.array(c)).when(left > 0, F.array(cut)).otherwise(F.array().cast("array<string>"))
        return F.when(a["full"], a).otherwise(
            F.struct(F.concat(a["out"], more).alias("out"), (a["used"] + F.least(F.length(c), left)).cast("int").alias("used"), (~whole).alias("full"))
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))
    def end(a: Column) -> Column:
        marked = F.when(F.size(a["out"]) == 0, F.array(F.lit(MARKER))).otherwise(
            F.transform(a["out"], lambda c, i: F.when(i == F.size(a["out"]) - 1, F.concat(c, F.lit(MARKER))).otherwise(c))
        )
        return F.when(a["full"], marked).otherwise(a["out"])

    return F.aggregate(chunks, start, step, end)


def context_length(chunks: Column) -> Column:
    return F.coalesce(F.aggregate(F.transform(chunks, F.length), F.lit(0), lambda a, n: a + n), F.lit(0))


def capper(chunks: Column, most: Column) -> Column:
    over = context_length(chunks) > most
    return result("context_capper", "PRE", F.lit(True), None, F.when(F.coalesce(over, F.lit(False)), "TRANSFORM").otherwise("ALLOW"))


def cache_key(messages: Column, chunks: Column, app_id: Column | None = None, model: Column | None = None) -> Column:
    """MD5 over roles, contents, tool calls with sorted keys, and context; app and model too where given."""
    def called(m: Column) -> Column:
        own = F.transform(m["calls"], lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
        return F.when(F.size(F.coalesce(m["calls"], F.array())) > 0, F.to_json(own)).otherwise("")

    said = F.transform(messages, lambda m: F.concat(F.lit("["), F.coalesce(m["role"], F.lit("")), F.lit("]:"), F.coalesce(m["content"], F.lit("")), called(m)))
    given = F.transform(F.coalesce(chunks, F.array().cast("array<string>")), lambda c: F.concat(F.lit("[ctx]:"), c))
    more = [F.concat(F.lit("[app]:"), F.coalesce(x, F.lit(""))) for x in (app_id, model) if x is not None]
    return F.md5(F.concat(F.array_join(said, ""), F.array_join(given, ""), *more))


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests with cached: the latest response of the cache (key, response, at) for their key, null for none or a null key."""
    latest = cache.groupBy("key").agg(F.max_by("response", "at").alias("cached"))
    return requests.join(latest, "key", "left")


def cache_rows(evaluated: DataFrame) -> DataFrame:
    """(key, response, at): what the policy lets the cache keep of evaluated requests, answers that were allowed and not cached ones."""
    fit = F.col("key").isNotNull() & F.col("cached").isNull() & F.col("decision.action").isin("ALLOW", "TRANSFORM")
    return evaluated.where(fit).select("key", "response", F.current_timestamp().alias("at"))


def cache_write(evaluated: DataFrame, path: str) -> None:
    """Add to the cache's table; cached() takes the latest row of a key."""
    cache_rows(evaluated).write.mode("append").parquet(path)


def stuff(messages: Column, chunks: Column) -> Column:
    """Messages with the context written before the last user message's question."""
    lines = F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("- "), c)), "\n")
    at = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)))
    some = F.size(F.coalesce(chunks, F.array().cast("array<string>"))) > 0

    def one(m: Column, i: Column) -> Column:
        text = F.concat(F.lit(STUFFING), lines, F.lit(QUESTION), F.coalesce(m["content"], F.lit("")))
        return F.when(some & (i == at), m.withField("content", text)).otherwise(m)

    return F.transform(messages, one)


def mock_reply(question: Column) -> Column:
    """struct<content, tool_name, arguments, finish_reason> of the stand-in model."""
    low = F.lower(question)
    call = question.contains("[simulate_tool_call]") | low.contains("execute command")
    echoes = F.regexp_extract_all(question, F.lit(r"<[A-Z_]+_\d+>"), F.lit(0))
    text = (
        F.when(question.contains("[simulate_hallucination]"), P.MOCK_HALLUCINATION)
        .when(low.contains("story") & low.contains("doctor"), P.MOCK_BIASED)
        .when(F.size(echoes) > 0, F.concat(F.lit(P.MOCK_ECHO), F.array_join(echoes, " and "), F.lit(".")))
        .otherwise(P.MOCK_SAFE)
    )
    return F.struct(
        F.when(~call, text).alias("content"),
        F.when(call, P.MOCK_TOOL).alias("tool_name"),
        F.when(call, F.when(low.contains("out_of_bounds"), P.MOCK_BAD_ARGS).otherwise(P.MOCK_ARGS)).alias("arguments"),
        F.when(call, "tool_calls").otherwise("stop").alias("finish_reason"),
    )


def usage(prompt: Column, completion: Column) -> Column:
    a, b = T.word_count(prompt), T.word_count(completion)
    return F.struct(a.alias("prompt_tokens"), b.alias("completion_tokens"), (a + b).alias("total_tokens"))
