"""Detection results and the policy decision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weir.functions import patterns as P, text as T

RESULT = (
    "struct<detector:string,stage:string,passed:boolean,score:double,action:string,code:string,reason:string,"
    "fallback:string,entities:array<string>>"
)


def result(
    detector: str, stage: str, passed: Column, score: Column | None, action: Column, code: Column | None = None,
    reason: Column | None = None, fallback: Column | None = None, entities: Column | None = None,
) -> Column:
    """One detector's result; action, code, reason and fallback count only where it fails, but TRANSFORM always."""
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(detector).alias("detector"), F.lit(stage).alias("stage"), passed.alias("passed"),
        (F.lit(None) if score is None else score).cast("double").alias("score"), action.alias("action"),
        (null if code is None else code).alias("code"), (null if reason is None else reason).alias("reason"),
        (null if fallback is None else fallback).alias("fallback"),
        (F.array() if entities is None else entities).cast("array<string>").alias("entities"),
    )


def decide(results: Column, policy_fallback: Column | None = None) -> Column:
    """struct<action, code, reason, http_status, fallback, scores, entities>: BLOCK over REWRITE over TRANSFORM over ALLOW.

    Within an action the first result in order counts. TRANSFORM counts whether or not its result passed.
    """
    def first(test) -> Column:
        return F.try_element_at(F.filter(results, test), F.lit(1))

    block = first(lambda r: ~r["passed"] & (r["action"] == "BLOCK"))
    rewrite = first(lambda r: ~r["passed"] & (r["action"] == "REWRITE"))
    change = first(lambda r: r["action"] == "TRANSFORM")
    text = F.coalesce(rewrite["fallback"], *([] if policy_fallback is None else [policy_fallback]), F.lit(P.FALLBACK))
    action = (
        F.when(block.isNotNull(), "BLOCK").when(rewrite.isNotNull(), "REWRITE").when(change.isNotNull(), "TRANSFORM").otherwise("ALLOW")
    )
    scored = F.filter(results, lambda r: r["score"].isNotNull())
    names = F.array_distinct(F.transform(scored, lambda r: r["detector"]))
    last = F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(scored, lambda r: r["detector"] == n), -1)["score"]))
    return F.struct(
        action.alias("action"),
        F.when(block.isNotNull(), block["code"]).when(rewrite.isNotNull(), rewrite["code"]).alias("code"),
        F.when(block.isNotNull(), block["reason"]).when(rewrite.isNotNull(), rewrite["reason"]).alias("reason"),
        F.when(block.isNotNull(), 422).otherwise(200).alias("http_status"),
        F.when(block.isNull() & rewrite.isNotNull(), text).alias("fallback"),
        F.map_from_entries(last).alias("scores"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(results, lambda r: r["entities"])))).alias("entities"),
    )


def error_body(decision: Column, trace_id: Column, version: Column) -> Column:
    """The body of a blocked request as JSON."""
    return F.to_json(
        F.struct(
            F.struct(
                F.lit("policy_violation").alias("type"), decision["code"].alias("code"), F.coalesce(decision["reason"], F.lit("Policy violation.")).alias("message"),
                trace_id.alias("trace_id"), version.alias("policy_version"), decision["action"].alias("pdp_action"),
            ).alias("error")
        )
    )


def headers(decision: Column, trace_id: Column) -> Column:
    """map<string,string>: what a reply's headers say; scores with three decimals, the reason in ASCII."""
    named = {"x-score-injection": "prompt_injection", "x-score-bias": "bias_subspace_detector", "x-score-grounding": "rag_hallucination_engine"}
    parts = [("x-trace-id", trace_id), ("x-policy-action", decision["action"])]
    parts += [(k, F.format_number(F.try_element_at(decision["scores"], F.lit(v)), 3)) for k, v in named.items()]
    parts.append(("x-violation-reason", T.ascii_only(decision["reason"])))
    given = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in parts)), lambda e: e["value"].isNotNull())
    return F.map_from_entries(given)


def completion_body(text: Column, trace_id: Column, model: Column, rewritten: Column) -> Column:
    """A reply's body as JSON in the shape of chat completions."""
    n = F.greatest(F.lit(1), T.word_count(text))
    return F.to_json(
        F.struct(
            F.concat(F.lit("chatcmpl-"), trace_id).alias("id"), F.lit("chat.completion").alias("object"), F.unix_timestamp().alias("created"), model.alias("model"),
            F.array(F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"),
            F.struct(F.lit(0).alias("prompt_tokens"), n.alias("completion_tokens"), n.alias("total_tokens")).alias("usage"), rewritten.alias("rewritten"),
        )
    )


def failed(detector: str, stage: str, error: Column, fail_mode: Column) -> Column:
    """The result of a detector that failed: it blocks unless the policy fails open."""
    closed = F.coalesce(fail_mode, F.lit("fail_closed")) != "fail_open"
    return result(
        detector, stage, ~closed, None, F.when(closed, "BLOCK").otherwise("ALLOW"), F.when(closed, "INTERNAL_DETECTOR_EXCEPTION"),
        F.when(closed, F.concat(F.lit(f"{detector} failed: "), error)),
    )
