"""The whole course of a request: policy, cache, guards before, the model, guards after, decision, audit row.

Everything a request needs is in its row, so but for the policies, which are broadcast, and the cache, which is joined by key, nothing is
joined or shuffled, and requests that share a trace id stay apart. Requests that the cache answers or that are blocked early keep
their row; the model is not asked for them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weir.functions import patterns as P, similarity as S, text as T
from weir.operators import context as C, grounding as G, models as M, pii, rules as R, tools
from weir.operators.decision import RESULT, completion_body, decide, error_body, failed, headers, result
from weir.sources import requests as Q

#: The guards that a streamed reply passes, in order.
STREAMED = ["agent_tool_guard", "rag_hallucination_engine", "toxicity_classifier", "bias_subspace_detector", "pii_detokenizer"]
STRINGS = "array<string>"


def _cols(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that what comes above doesn't write out again: these plans are long, and would grow beyond the driver's memory."""
    return df.withColumns({k: T.once(v) for k, v in columns.items()})


def _col(df: DataFrame, name: str, value: Column) -> DataFrame:
    return _cols(df, {name: value})


def _strings() -> Column:
    return F.array().cast(STRINGS)


def _kept(results: list[Column]) -> Column:
    return F.filter(F.array(*results).cast(f"array<{RESULT}>"), lambda r: r.isNotNull())


def pre_guards(requests: DataFrame) -> DataFrame:
    """requests (with policy) with pre array<result>, vault, masked messages and capped context; entities outside the policy stay."""
    policy = F.col("policy")
    found = F.transform("messages", lambda m: F.when(policy["pii_action"] != "none", pii.spans(F.coalesce(m["content"], F.lit("")), policy["masked_entities"])).otherwise(F.array().cast(pii.SPANS)))
    requests = requests.transform(_cols, {"_spans": found, "_hits": R.message_hits(F.col("messages"))})
    met = F.filter("_spans", lambda s: F.size(s) > 0)
    blocks = (policy["pii_action"] == "block") & (F.size(met) > 0)
    some = (policy["pii_action"] == "mask") & (F.size(met) > 0)
    # A block stops at the first message with personal data, so only its kinds are known.
    kinds = F.array_sort(F.array_distinct(F.transform(F.when(blocks, F.try_element_at(met, F.lit(1))).otherwise(F.flatten(met)), lambda s: s["entity"])))
    scan = result(
        "pii_scanner", "PRE", ~blocks, None, F.when(blocks, "BLOCK").when(some, "TRANSFORM").otherwise("ALLOW"),
        F.when(blocks, "PII_POLICY_VIOLATION"), F.when(blocks, F.concat(F.lit("Personal data in the request: "), F.array_join(kinds, ", "))),
        None, F.when(some | blocks, kinds).otherwise(_strings()),
    )
    most = policy["max_context_chars"]
    capped = F.when(most.isNull() | (C.context_length(F.col("retrieved_context")) <= most), F.col("retrieved_context")).otherwise(C.cap(F.col("retrieved_context"), most))
    results = [
        F.when(policy["block_prompt_injection"], R.injection(F.col("_hits"), policy["injection_threshold"])),
        F.when(most.isNotNull(), C.capper(F.col("retrieved_context"), most)),
        F.when(policy["pii_action"] != "none", scan),
    ]
    vault = F.when(policy["pii_action"] == "mask", pii.vault_of(F.col("_spans"))).otherwise(F.array().cast(pii.VAULT))
    requests = requests.transform(_cols, {"pre": _kept(results), "retrieved_context": capped, "vault": vault})
    masked = F.zip_with("messages", "_spans", lambda m, s: m.withField("content", pii.substitute(m["content"], s, F.col("vault"))))
    return requests.transform(_col, "messages", F.when(F.size("vault") > 0, masked).otherwise(F.col("messages"))).drop("_spans", "_hits")


def mock_upstream(requests: DataFrame) -> DataFrame:
    """The stand-in model: completion_text and tool_calls where the request brings none and isn't to be skipped."""
    made = requests.transform(_col, "_r", F.when(~F.col("skip"), C.mock_reply(C.last_user(F.col("messages")))))
    call = F.array(F.struct(F.lit("call_mock_12345").alias("id"), F.col("_r.tool_name").alias("name"), F.col("_r.arguments").alias("arguments")))
    given = F.size(F.coalesce("tool_calls", F.array())) > 0
    return made.transform(_cols, 
        {
            "completion_text": F.when(given | F.col("completion_text").isNotNull(), F.col("completion_text")).otherwise(F.col("_r.content")),
            "tool_calls": F.when(given, F.col("tool_calls")).when(F.col("completion_text").isNull() & F.col("_r.tool_name").isNotNull(), call),
        }
    ).drop("_r")


def upstream(factory: Callable[[], M.Client], name: str = "upstream", **limits) -> Callable[[DataFrame], DataFrame]:
    """A model behind a client; adds upstream_status, upstream_body and upstream_latency_ms. limits: of models.send."""

    def ask(requests: DataFrame) -> DataFrame:
        wanted = F.when(~F.col("skip") & F.col("completion_text").isNull(), Q.payload(F.col("model"), F.col("messages")))
        sent = requests.withColumn("_u", M.send(wanted, factory, name, **limits))
        read = sent.transform(_col, "_r", F.when(F.col("_u.status").between(200, 299), Q.response(F.col("_u.body"))))
        return read.transform(_cols, 
            {
                **{k: F.coalesce(k, f"_r.{v}") for k, v in (("completion_text", "content"), ("tool_calls", "tool_calls"), ("reasoning_content", "reasoning_content"), ("logprobs", "logprobs"))},
                "upstream_status": F.col("_u.status"), "upstream_body": F.col("_u.body"), "upstream_latency_ms": F.col("_u.latency_ms"),
                "prompt_tokens": F.col("_r.prompt_tokens"), "completion_tokens": F.col("_r.completion_tokens"),
            }
        ).drop("_u", "_r")

    return ask


def _context(requests: DataFrame, models: M.Models) -> DataFrame:
    """requests with _chunks, the context that claims are compared with, and _rerank_error: reranked where the policy says so and a model is there."""
    chunks = F.coalesce("retrieved_context", _strings())
    question = C.last_user(F.col("messages"))
    if models.reranker is None:
        return requests.transform(_cols, {"_chunks": chunks, "_rerank_error": F.lit(None).cast("string")})
    wanted = F.col("policy.grounding") & F.col("policy.context_reranking") & (question != "") & ~F.col("skip")
    asked = requests.withColumn("_rel", M.relevance(question, F.when(wanted, chunks), models.reranker, f"{models.name}/reranker"))
    good = wanted & F.col("_rel.error").isNull() & (F.size(chunks) > 0)
    best = G.rerank_context(chunks, F.col("_rel.scores"), F.col("policy.context_relevance_threshold"), F.col("policy.context_reranker_top_k"))
    return asked.transform(_cols, {"_chunks": F.when(good, best).otherwise(chunks), "_rerank_error": F.when(wanted, F.col("_rel.error"))}).drop("_rel")


def _grounding(requests: DataFrame, models: M.Models) -> DataFrame:
    """requests with _ground, a grounding summary, and _ground_error."""
    wanted = F.col("policy.grounding") & (F.col("_said") != "") & (F.size("_chunks") > 0) & ~F.col("skip")
    own = requests.transform(_col, "_claims", F.when(wanted, G.aligned(F.col("_said"), F.col("_chunks"))))
    scores = F.transform("_claims", lambda c: F.when(c["overlap"] >= G.LEXICAL_GATE, 1.0).otherwise(S.grounding(G.lexical(c))))
    error = F.col("_rerank_error")
    if models.nli is not None:
        asked = F.when(F.col("policy.nli_backend") != "heuristic", G.model_pairs(F.col("_claims")))
        own = own.withColumn("_nli", M.score_lists(asked, models.nli, f"{models.name}/nli"))
        scores = F.when(asked.isNotNull(), G.model_grounding(F.col("_claims"), F.col("_nli.scores"))).otherwise(scores)
        error = F.coalesce(error, F.when(asked.isNotNull(), F.col("_nli.error")))
    p = F.col("policy")
    own = own.transform(_cols, {"_ground": F.when(wanted, G.grounding_summary(scores, p["early_exit_threshold"], p["min_grounding_score"])), "_ground_error": F.when(wanted, error)})
    return own.drop("_claims", "_nli", "_rerank_error")


def _citations(requests: DataFrame, models: M.Models) -> DataFrame:
    """requests with _cited, a citation summary; by embeddings where the policy lets it and a model is there."""
    chunks, said, p = F.coalesce("retrieved_context", _strings()), F.col("_said"), F.col("policy")
    wanted = p["citations"] & (said != "") & (F.size(chunks) > 0) & ~F.col("skip")
    found = F.when(wanted, G.cited(said, chunks))
    if models.embedder is not None:
        claims = F.transform(T.citations(said), lambda c: c["claim"])
        by_model = p["citation_similarity_method"] != "ngram"
        requests = requests.withColumn("_cosines", M.cosines(F.when(wanted & by_model, claims), F.when(wanted & by_model, chunks), models.embedder, f"{models.name}/embedder"))
        found = F.when(wanted & by_model, G.cited_by_model(said, lambda _: F.col("_cosines"))).otherwise(found)
    out = requests.transform(_col, "_found", found)
    return out.transform(_col, "_cited", F.when(wanted, G.citation_summary(F.col("_found"), p["citation_fail_threshold"], p["citation_avg_threshold"]))).drop("_found", "_cosines")


def _bias(requests: DataFrame, models: M.Models) -> DataFrame:
    """requests with _bias array<struct<score, reason>>: what the patterns, the projection and the swapped text find, in that order."""
    said, p = F.col("_said"), F.col("policy")
    tiers = [T.rule_hits(said, P.BIAS)]
    on = (said != "") & p["bias_threshold"].isNotNull() & ~F.col("skip")
    if models.embedder is not None:
        requests = requests.withColumn("_v", M.embed(F.when(on & p["bias_projection"], said).otherwise(""), models.embedder, f"{models.name}/embedder"))
        requests = requests.transform(_col, "_skew", M.projection(F.col("_v"), M.bias_axes(models.embedder())))
        hit = F.struct(F.col("_skew.score").alias("score"), F.concat(F.lit("Projection on the axis "), F.col("_skew.axis")).alias("reason"))
        tiers.append(F.filter(F.array(F.when(p["bias_projection"], hit)), lambda h: h.isNotNull()))
    if models.judge is not None:
        requests = requests.withColumn("_swap", M.replies(F.when(on & p["counterfactual"], M.swap_prompt(said)), models.judge, f"{models.name}/judge", M.SWAP_SECONDS))
        verdict = M.verdict(F.col("_swap"), "is_biased")
        hit = T.let(verdict, lambda v: F.when(v["bad"], F.struct(F.lit(1.0).alias("score"), F.concat(F.lit("Swapped identities: "), v["reason"]).alias("reason"))))
        tiers.append(F.filter(F.array(hit), lambda h: h.isNotNull()))
    kind = "array<struct<score:double,reason:string>>"
    # The first tier that reaches the threshold counts alone.
    reached = [F.filter(t.cast(kind), lambda h: h["score"] >= p["bias_threshold"]) for t in tiers]
    found = reduce(lambda a, b: F.when(F.size(a) > 0, a).otherwise(b), reached)
    return requests.transform(_col, "_bias", F.when(on, found).otherwise(F.array().cast(kind))).drop("_v", "_skew", "_swap")


def post_guards(requests: DataFrame, models: M.Models = M.Models()) -> DataFrame:
    """requests with post array<result>, in the order that counts, and answer, the completion with its personal data restored."""
    p, said, skip = F.col("policy"), F.col("_said"), F.col("skip")
    own = requests.transform(_col, "_said", F.coalesce("completion_text", F.lit("")))
    own = _bias(_citations(_grounding(_context(own, models), models), models), models).transform(_col, "_tox", T.rule_hits(said, P.TOXICITY))
    has_text, calls = (said != "") & ~skip, F.coalesce("tool_calls", F.array().cast(f"array<{Q.CALL}>"))
    has_calls = (F.size(calls) > 0) & ~skip
    reasoning = T.reasoning_text(F.col("reasoning_text"), F.col("reasoning_content"), F.col("completion_text"))
    if models.embedder is not None:
        by_model = has_calls & p["reasoning"] & (p["similarity_method"] != "ngram")
        both = (F.when(by_model, F.array(reasoning.substr(1, 512))), F.when(by_model, F.array(tools.argument_text(calls).substr(1, 256))))
        own = own.withColumn("_cosine", F.try_element_at(F.try_element_at(M.cosines(*both, models.embedder, f"{models.name}/embedder"), F.lit(1)), F.lit(1)))
        agreed = F.when(by_model, tools.reasoning_guard(reasoning, calls, p["similarity_fail_threshold"], F.col("_cosine"))).otherwise(tools.reasoning_guard(reasoning, calls, p["similarity_fail_threshold"]))
    else:
        agreed = tools.reasoning_guard(reasoning, calls, p["similarity_fail_threshold"])
    if models.judge is not None:
        asked = F.when(has_text & p["chat_judge"], M.judge_prompt(F.col("messages"), said))
        own = own.withColumn("_reply", M.replies(asked, models.judge, f"{models.name}/judge")).transform(_col, "_verdict", M.verdict(F.col("_reply"), "is_hallucination"))
        judged = F.when(asked.isNotNull(), M.judged("chatbot_hallucination_guard", F.col("_verdict"), p["chat_action"]))
    else:
        judged = F.lit(None).cast(RESULT)
    own = own.transform(_cols, 
        {
            "_again": F.when(p["dedup"] & has_calls, tools.answered_before(F.col("messages"), calls, p["max_duplicate_calls"])),
            "_broken": F.when(has_calls, tools.first_broken(calls, F.coalesce("tool_rules", F.array().cast(f"array<{tools.RULE}>")))),
            "answer": pii.restored(F.col("completion_text"), F.col("vault")),
        }
    )
    grounded = F.when(F.col("_ground_error").isNotNull(), failed("rag_hallucination_engine", "POST", F.col("_ground_error"), p["fail_mode"])).when(
        F.col("_ground").isNotNull(), G.grounding_guard(F.col("_ground"), p["action_on_low_grounding"], p["grounding_fallback"])
    )
    changed = F.coalesce(F.col("answer") != F.col("completion_text"), F.lit(False))
    logprobs = F.col("logprobs")
    results = [
        F.when(p["dedup"] & has_calls, tools.repeat_guard(F.col("_again"), F.col("completion_text"))),
        F.when(has_calls & (F.size(F.coalesce("tool_rules", F.array())) > 0), tools.tool_guard(F.col("_broken"))),
        F.when(
            p["confidence"] & has_calls & (F.size(F.coalesce(logprobs, F.array().cast(Q.LOGPROBS))) > 0),
            tools.confidence_guard(logprobs, p["avg_logprob_threshold"], p["min_logprob_threshold"], p["per_token_threshold"], p["max_low_conf_pct"]),
        ),
        F.when(p["reasoning"] & has_calls, agreed),
        grounded,
        F.when(F.col("_cited.n") > 0, G.citation_guard(F.col("_cited"), p["action_on_low_grounding"])),
        judged,
        F.when(has_text & p["toxicity_threshold"].isNotNull(), R.output_rules("toxicity_classifier", "TOXIC_CONTENT_DETECTED", F.col("_tox"), p["toxicity_threshold"], p["action_on_violation"], p["fallback_message"])),
        F.when(has_text & p["bias_threshold"].isNotNull(), R.output_rules("bias_subspace_detector", "BIAS_SUBSPACE_DRIFT", F.col("_bias"), p["bias_threshold"], p["action_on_violation"], p["fallback_message"])),
        F.when(has_text, result("pii_detokenizer", "POST", F.lit(True), None, F.when(changed, "TRANSFORM").otherwise("ALLOW"))),
    ]
    return own.transform(_col, "post", _kept(results)).drop("_said", "_chunks", "_ground", "_ground_error", "_cited", "_bias", "_tox", "_again", "_broken", "_cosine", "_reply", "_verdict")


def evaluate(
    requests: DataFrame, policies: DataFrame, tool_rules: DataFrame, cache: DataFrame | None = None,
    model: Callable[[DataFrame], DataFrame] = mock_upstream, models: M.Models = M.Models(),
) -> DataFrame:
    """requests with policy, key, cached, skip, vault, pre, post, decision, response, body and headers.

    cache (key, response, at) answers, before any guard runs, what it holds for policies that let it. Streamed requests pass the guards
    of STREAMED only, and only those decide. An upstream model's error is passed on as it is: decision null, its status and body given.
    """
    bound = Q.with_policy(requests, policies, tool_rules)
    key = C.cache_key(F.col("messages"), F.col("retrieved_context"), F.col("app_id"), F.col("model"))
    bound = bound.transform(_col, "key", F.when(F.col("policy.cache"), key))
    bound = C.cached(bound, cache) if cache is not None else bound.transform(_col, "cached", F.lit(None).cast("string"))
    masked = pre_guards(bound.transform(_col, "_given", F.col("messages"))).transform(_col, "_early", decide(F.col("pre")))
    masked = masked.transform(_col, "skip", F.col("cached").isNotNull() | (F.col("_early.action") == "BLOCK"))
    stuffed = masked.transform(_cols, {"_masked": F.col("messages"), "messages": C.stuff(F.col("messages"), F.col("retrieved_context"))})
    said = model(stuffed).transform(_col, "messages", F.col("_masked")).drop("_masked")
    for name, kind in (("upstream_status", "int"), ("upstream_body", "string"), ("upstream_latency_ms", "double"), ("prompt_tokens", "int"), ("completion_tokens", "int")):
        if name not in said.columns:
            said = said.transform(_col, name, F.lit(None).cast(kind))
    done = post_guards(said, models)
    streamed = F.coalesce(F.col("stream"), F.lit(False)) if "stream" in requests.columns else F.lit(False)
    counted = F.when(streamed, F.filter("post", lambda r: r["detector"].isin(STREAMED))).otherwise(F.concat("pre", "post"))
    error = F.coalesce(~F.col("upstream_status").between(200, 299), F.lit(False))
    final = decide(F.col("results"), F.col("policy.fallback_message"))
    none = F.array().cast(f"array<{RESULT}>")
    early = F.col("_early.action") == "BLOCK"
    out = done.transform(_col, "results", F.when(F.col("cached").isNotNull(), none).when(early, F.col("pre")).otherwise(counted))
    out = out.transform(_col, "decision", F.when(error, F.lit(None)).otherwise(final))
    d = F.col("decision")
    body = F.when(error, F.col("upstream_body")).when(d["action"] == "BLOCK", error_body(d, F.col("trace_id"), F.col("policy.version")))
    text = F.when(F.col("cached").isNotNull(), F.col("cached")).when(d["action"] == "REWRITE", d["fallback"]).otherwise(F.coalesce("answer", F.lit("")))
    out = out.transform(_col, "response", F.coalesce(body, text))
    out = out.transform(_col, "body", F.coalesce(body, completion_body(F.col("response"), F.col("trace_id"), F.col("model"), d["action"] == "REWRITE")))
    return out.transform(_cols, {"headers": F.when(~error, headers(d, F.col("trace_id"))), "messages": F.col("_given")}).drop("_given", "_early", "results")


def run(
    requests: DataFrame, policies: DataFrame, tool_rules: DataFrame, cache: DataFrame | None = None,
    model: Callable[[DataFrame], DataFrame] = mock_upstream, models: M.Models = M.Models(),
) -> DataFrame:
    """(trace_id, app_id, action, code, reason, http_status, response, scores, entities, cached) of each request, a row for each."""
    return outcome(evaluate(requests, policies, tool_rules, cache, model, models))


def outcome(evaluated: DataFrame) -> DataFrame:
    """What run() gives, of evaluated requests."""
    d = F.col("decision")
    return evaluated.select(
        "trace_id", "app_id", d["action"].alias("action"), d["code"].alias("code"), d["reason"].alias("reason"), F.coalesce(d["http_status"], F.col("upstream_status")).alias("http_status"),
        "response", d["scores"].alias("scores"), d["entities"].alias("entities"), F.col("cached").isNotNull().alias("cached"),
    )


def audit_rows(evaluated: DataFrame) -> DataFrame:
    """Rows of the audit table for evaluated requests, but for those that the upstream model answered with an error.

    Latency is what was measured: the upstream model's where it was asked, and in all the time since the request's own timestamp, null
    where it has none. Guards run as columns of one plan, so their share isn't measured and is null.
    """
    d, ts = F.col("decision"), F.col("ts")
    whole = F.when(ts.isNotNull(), (F.unix_micros(F.current_timestamp()) - F.unix_micros(ts)) / 1000)
    null = F.lit(None).cast("double")
    score = {a: F.try_element_at(d["scores"], F.lit(b)) for a, b in (("injection_score", "prompt_injection"), ("grounding_score", "rag_hallucination_engine"), ("bias_score", "bias_subspace_detector"))}
    given = F.struct("model", F.col("messages"), "retrieved_context")
    return evaluated.where(d.isNotNull()).select(
        "trace_id", F.coalesce("ts", F.current_timestamp()).alias("timestamp"), "app_id", F.col("policy.version").alias("policy_version"),
        F.col("policy.policy_hash").alias("policy_hash"), F.col("policy.mode").alias("use_case_mode"),
        F.coalesce("prompt_tokens", T.word_count(C.last_user(F.col("messages")))).cast("int").alias("input_tokens"),
        F.coalesce("completion_tokens", T.word_count(F.col("response"))).cast("int").alias("output_tokens"),
        whole.alias("latency_ms"), null.alias("pre_execution_latency_ms"), F.col("upstream_latency_ms"), null.alias("post_execution_latency_ms"),
        d["entities"].alias("pii_entities_found"), *(c.alias(k) for k, c in score.items()), d["action"].alias("pdp_action"),
        F.when(d["action"] != "ALLOW", d["reason"]).alias("violation_reason"), F.to_json(given).alias("raw_request_payload"), F.col("body").alias("final_response_payload"),
    )
