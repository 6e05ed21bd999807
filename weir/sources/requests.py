"""Requests, responses and policies as DataFrames."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = f"struct<role:string,content:string,tool_call_id:string,calls:array<{CALL}>>"
LOGPROBS = "array<struct<token:string,logprob:double,top_logprobs:array<double>>>"
REQUEST = (
    f"trace_id string, app_id string, ts timestamp, model string, stream boolean, messages array<{MESSAGE}>, "
    f"retrieved_context array<string>, completion_text string, tool_calls array<{CALL}>, reasoning_text string, "
    f"reasoning_content string, logprobs {LOGPROBS}"
)
#: Defaults of a policy.
DEFAULTS = {
    "version": "1.0.0", "mode": "chatbot", "fail_mode": "fail_closed", "streaming_mode": "buffered",
    "block_prompt_injection": True, "injection_threshold": 0.60, "pii_action": "mask",
    "masked_entities": ["EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "SSN"], "max_context_chars": None, "cache": False,
    "toxicity_threshold": 0.70, "bias_threshold": 0.65, "action_on_violation": "rewrite",
    "fallback_message": "I am unable to answer this query due to safety policy constraints.", "grounding": False,
    "min_grounding_score": 0.70, "early_exit_threshold": 0.20, "action_on_low_grounding": "rewrite",
    "grounding_fallback": "The requested details could not be verified against source documents.", "citations": False,
    "citation_fail_threshold": 0.35, "citation_avg_threshold": 0.50, "confidence": False, "avg_logprob_threshold": -2.0,
    "min_logprob_threshold": -4.0, "per_token_threshold": -2.5, "max_low_conf_pct": 0.30, "reasoning": False,
    "similarity_fail_threshold": 0.15, "dedup": False, "max_duplicate_calls": 1, "nli_backend": "auto",
    "context_reranking": False, "context_relevance_threshold": 0.30, "context_reranker_top_k": None,
    "citation_similarity_method": "auto", "similarity_method": "auto", "chat_judge": False, "chat_action": "rewrite",
    "bias_projection": False, "counterfactual": False,
}
POLICY = (
    "app_id string, policy_hash string, version string, mode string, fail_mode string, streaming_mode string, "
    "block_prompt_injection boolean, injection_threshold double, pii_action string, masked_entities array<string>, "
    "max_context_chars int, cache boolean, toxicity_threshold double, bias_threshold double, action_on_violation string, "
    "fallback_message string, grounding boolean, min_grounding_score double, early_exit_threshold double, "
    "action_on_low_grounding string, grounding_fallback string, citations boolean, citation_fail_threshold double, "
    "citation_avg_threshold double, confidence boolean, avg_logprob_threshold double, min_logprob_threshold double, "
    "per_token_threshold double, max_low_conf_pct double, reasoning boolean, similarity_fail_threshold double, dedup boolean, "
    "max_duplicate_calls int, nli_backend string, context_reranking boolean, context_relevance_threshold double, "
    "context_reranker_top_k int, citation_similarity_method string, similarity_method string, chat_judge boolean, "
    "chat_action string, bias_projection boolean, counterfactual boolean"
)
RULE = "app_id string, tool string, field string, type string, min_value double, max_value double, allowed array<string>, place int"
RESPONSE = (
    "choices array<struct<message:struct<content:string,reasoning_content:string,"
    "tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>,"
    "logprobs:struct<content:array<struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>>,"
    "tokens:array<string>,token_logprobs:array<double>>>>, "
    "usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"
)


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines of chat requests; unknown keys stay in `raw`. A missing app_id is `default`, a missing trace_id a new one for each row.

    New ids are drawn: write the requests before reading them twice, if both readings must agree.
    """
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path)
    parsed = lines.select(F.from_json("value", REQUEST).alias("r"), F.try_parse_json("value").alias("raw")).select("r.*", "raw")
    made = F.concat(F.lit("trace_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))
    return parsed.withColumns({"app_id": F.coalesce("app_id", F.lit("default")), "trace_id": F.coalesce("trace_id", made)})


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash): the first 16 hex digits of SHA-256."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("hash"))


def write_requests(requests: DataFrame, path: str) -> None:
    """JSON lines, null fields left out."""
    requests.drop("raw").write.mode("append").option("ignoreNullFields", True).json(path)


def payload(model: Column, messages: Column) -> Column:
    """The JSON that an upstream model is sent: model and messages, without null fields, the context or anything of ours."""
    def call(c: Column) -> Column:
        return F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function"))

    said = F.transform(
        messages,
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["tool_call_id"].alias("tool_call_id"), F.transform(m["calls"], call).alias("tool_calls")),
    )
    return F.to_json(F.struct(model.alias("model"), said.alias("messages")))


def response(body: Column) -> Column:
    """struct<content, reasoning_content, tool_calls, logprobs, prompt_tokens, completion_tokens> of a chat reply's JSON.

    Log-probabilities come from `content`, or else from the older lists of tokens and values, nulls left out; alternatives
    without a value count as -20.
    """
    parsed = F.from_json(body, RESPONSE)
    choice = F.try_element_at(parsed["choices"], F.lit(1))
    lists = choice["logprobs"]
    named = F.transform(
        lists["content"],
        lambda t: F.struct(t["token"].alias("token"), t["logprob"].alias("logprob"), F.transform(t["top_logprobs"], lambda a: F.coalesce(a["logprob"], F.lit(-20.0))).alias("top_logprobs")),
    )
    n = F.least(F.size(lists["tokens"]), F.size(lists["token_logprobs"]))
    older = F.filter(
        F.zip_with(F.slice(lists["tokens"], 1, n), F.slice(lists["token_logprobs"], 1, n), lambda t, x: F.struct(t.alias("token"), x.alias("logprob"), F.lit(None).cast("array<double>").alias("top_logprobs"))),
        lambda t: t["logprob"].isNotNull(),
    )
    calls = F.transform(choice["message"]["tool_calls"], lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments")))
    return F.struct(
        choice["message"]["content"].alias("content"), choice["message"]["reasoning_content"].alias("reasoning_content"), calls.alias("tool_calls"),
        F.when(F.size(lists["content"]) > 0, named).when(n > 0, older).alias("logprobs"),
        parsed["usage"]["prompt_tokens"].alias("prompt_tokens"), parsed["usage"]["completion_tokens"].alias("completion_tokens"),
    )


def policy_rows(spec: dict, digest: str = "unknown") -> tuple[list[tuple], list[tuple]]:
    """Policies and tool rules of a parsed policy file as rows of POLICY and RULE."""
    names = [c.split()[0] for c in re.split(r",(?![^<]*>) ?", POLICY)]
    policies, rules = [], []
    for app, p in (spec.get("policies") or {}).items():
        pre, post, agent = p.get("pre_execution") or {}, p.get("post_execution") or {}, p.get("agent_config")
        own = DEFAULTS | {"app_id": app, "policy_hash": digest} | {k: v for part in (p, pre) for k, v in part.items() if k in DEFAULTS}
        places = {
            "toxicity_threshold": "toxicity_threshold", "bias_threshold": "bias_subspace_threshold", "action_on_violation": "action_on_violation",
            "fallback_message": "fallback_message", "bias_projection": "bias_projection_enabled", "counterfactual": "counterfactual_check_enabled",
        }
        own |= {a: post[b] for a, b in places.items() if b in post}
        cap = pre.get("context_capping") or {}
        own["max_context_chars"] = cap.get("max_context_length_chars", 4000) if cap.get("enabled") else None
        own["cache"] = bool((pre.get("semantic_cache") or {}).get("enabled"))
        if (ground := post.get("hallucination_engine")) is not None:
            own |= {k: v for k, v in ground.items() if k in DEFAULTS and k != "fallback_message"}
            own["grounding"] = ground.get("enabled", True)
            own["citations"] = own["grounding"] and ground.get("citation_check_enabled", False)
            own["context_reranking"] = ground.get("context_reranking_enabled", False)
            own["grounding_fallback"] = ground.get("fallback_message", DEFAULTS["grounding_fallback"])
        if judge := post.get("chatbot_hallucination"):
            own |= {"chat_judge": bool(judge.get("enabled")), "chat_action": judge.get("action_on_violation", "rewrite")}
        if agent is not None:
            for key, part in (("confidence", "confidence_mismatch"), ("reasoning", "reasoning_similarity"), ("dedup", "tool_deduplication")):
                got = agent.get(part, None if key == "dedup" else {})
                own[key] = got is not None and got.get("enabled", key != "dedup")
                own |= {k: v for k, v in (got or {}).items() if k in DEFAULTS}
        real = ("min_grounding_score", "max_low_conf_pct")
        policies.append(tuple(float(own[k]) if ("threshold" in k or k in real) and own[k] is not None else own[k] for k in names))
        place = 0
        for tool, guard in (p.get("tool_guards") or {}).items():
            for r in guard.get("parameter_rules") or []:
                least, most, allowed = r.get("min_value"), r.get("max_value"), r.get("allowed_values")
                rules.append((app, tool, r["field"], r["type"], None if least is None else float(least), None if most is None else float(most), None if allowed is None else [str(x) for x in allowed], place))
                place += 1
    return policies, rules


class PolicyRegistry:
    """Policies of a YAML file; a reload that fails keeps what was there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.rows, self.rules = spark, path, [], []
        self.reload()

    def reload(self) -> bool:
        import yaml

        try:
            raw = Path(self.path).read_bytes()
            self.rows, self.rules = policy_rows(yaml.safe_load(raw) or {}, hashlib.sha256(raw).hexdigest()[:16])
            good = True
        except (OSError, yaml.YAMLError, KeyError, TypeError, ValueError, AttributeError):
            good = False
        if not any(r[0] == "default" for r in self.rows):
            self.rows += policy_rows({"policies": {"default": {"version": "default-1.0.0"}}})[0]
        return good

    def count(self) -> int:
        return len(self.rows)

    def policies(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, POLICY)

    def tool_rules(self) -> DataFrame:
        return self.spark.createDataFrame(self.rules, RULE)


def with_policy(requests: DataFrame, policies: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """requests with `policy`, and with rules `tool_rules` in their file's order; unknown apps get the default's row.

    Policies and rules come from one file, so their side is small.
    """
    named = policies.select("app_id", F.struct(*policies.columns).alias("policy"))
    if rules is not None:
        parts = F.struct("place", "tool", "field", "type", "min_value", "max_value", "allowed")
        kept = F.transform(F.array_sort(F.collect_list(parts)), lambda r: F.struct(*(r[k].alias(k) for k in ("tool", "field", "type", "min_value", "max_value", "allowed"))))
        named = named.join(rules.groupBy("app_id").agg(kept.alias("tool_rules")), "app_id", "left")
    more = ["policy"] + ["tool_rules"] * (rules is not None)
    own = named.select(F.col("app_id").alias("_app"), F.struct(*more).alias("_own"))
    default = named.where("app_id = 'default'").select(F.struct(*more).alias("_default"))
    joined = requests.join(F.broadcast(own), F.col("app_id") == F.col("_app"), "left").join(F.broadcast(default), F.lit(True), "left")
    found = joined.withColumn("_own", F.coalesce("_own", "_default"))
    return found.withColumns({k: F.col(f"_own.{k}") for k in more}).drop("_app", "_own", "_default")
