import pytest
from helpers import until
from pyspark.sql import functions as F

from weir.functions import similarity as S, text as T
from weir.operators import context as C, grounding as G, pii, retrieval as V, telemetry as M, tools
from weir.operators.decision import decide, result
from weir.sources import requests as Q
from weir.streaming import reassembly

CALLS = "trace_id string, seq int, name string, arguments string"


def one(spark, column, **values):
    base = spark.range(1).withColumns({k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) if v else F.array().cast("array<string>") for k, v in values.items()})
    return base.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "context, claim, want",
    [
        ("Refunds are issued within 5 to 7 business days.", "Refunds are processed within 5 to 7 business days.", 1.0),
        ("The service is available 24/7.", "The service is never available on weekends.", 0.7143),
        ("Refunds are issued within 5 to 7 business days.", "All customers receive 200% airline vouchers valid for 100 years.", 0.0),
    ],
)
def test_lexical_grounding(spark, context, claim, want):
    got = one(spark, S.grounding(S.lexical_nli(F.col("c"), F.col("s"))), c=context, s=claim)
    assert got == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("I should probably query the database for users.", "command=rm -rf /", 0.0),
        ("I will delete the user.", "delete_user: user_id=123", 0.2195),
        ("I need to update the order status.", "update_order: status=shipped", 0.3679),
    ],
)
def test_reasoning_score(spark, a, b, want):
    got = one(spark, S.reasoning_score(F.col("a"), F.col("b")), a=a, b=b)
    assert got < 0.15 if want == 0.0 else got == pytest.approx(want, abs=1e-4)


def test_claims(spark):
    assert one(spark, T.claims(F.col("t")), t="OK. Fine. Refunds are issued within 7 business days.") == ["Refunds are issued within 7 business days."]
    got = one(spark, T.claims(F.col("t")), t="## Summary\n- Refunds take 7 days.\n* Support is available 24/7.")
    assert got == ["Refunds take 7 days.", "Support is available 24/7."]
    assert one(spark, T.claims(F.col("t")), t="  ") == []


def test_identical_texts_cite_fully(spark):
    assert one(spark, S.citation_score(F.col("t"), F.col("t")), t="refunds take seven days") == pytest.approx(1.0)


def test_best_chunk_without_context(spark):
    got = one(spark, G.best_chunk(F.col("t"), F.col("c")), t="some claim here", c=[])
    assert (got.overlap, got.chunk) == (0.0, "")


CITED = {
    "Refunds take seven days [1]. They are paid in full [Source: Guide]. [2]": [("numeric", "1"), ("source", "Guide"), ("numeric", "2")],
    "[1] is first": [], "": [], None: [], "No marker here (at all).": [],
    "As Smith found (Smith et al., 2023) it holds [1, 2].": [("author_year", "Smith et al., 2023"), ("numeric", "1, 2")],
    "The handbook says so [HR-001], twice [doc: A b].": [("named", "HR-001"), ("source", "A b")],
    "Ünïcode text before it [Ref: Käse] and after": [("source", "Käse")],
}


def test_citations(spark):
    rows = spark.createDataFrame([(t,) for t in CITED], "t string").select("t", T.citations(F.col("t")).alias("c"), T.has_citations(F.col("t")).alias("has"), F.transform(T.citations(F.col("t")), T.is_multi_reference).alias("many"))
    for r in rows.collect():
        assert [(c.kind, c.value) for c in r.c or []] == CITED[r.t]
        assert all(r.t[c.position :].startswith(c.marker) for c in r.c or [])
        assert [*(r.many or [])] == ["," in v and k == "numeric" for k, v in CITED[r.t]]
        assert r.has == bool(r.t and "[" in r.t or CITED[r.t])
    claims = one(spark, T.citations(F.col("t")), t="First point is long. Second one is short [1]. Ok. Yes [2]" + " x" * 400 + " [3]")
    assert [c.claim for c in claims] == ["Second one is short", "Second one is short [1].", ("Second one is short [1]. Ok. Yes [2]" + " x" * 400)[-300:]] or [c.claim for c in claims][:2] == ["Second one is short", "Second one is short [1]."]


def test_citation_summary(spark):
    def summary(text, chunks):
        found = G.cited(F.col("t"), F.col("c"))
        return one(spark, G.citation_summary(found, F.lit(0.35), F.lit(0.5)), t=text, c=chunks)

    good, bad = "Refunds take seven days [1].", "Nothing like that at all is there [1]. Refunds take seven days [2]."
    assert (lambda s: (s.passed, s.n))(summary(good, ["Refunds take seven days"])) == (True, 1)
    got = summary(bad, ["Refunds take seven days"])
    assert not got.passed and got.score < 0.35 and got.n == 2
    none = summary("No citation.", ["x"])
    assert none.passed and none.score is None and none.n == 0
    assert not summary(good, []).passed


def test_bigrams_and_words(spark):
    text = "Ab é日🙂 ab"
    low = text.lower()
    assert sorted(one(spark, T.bigrams(F.col("t")), t=text)) == sorted({low[i : i + 2] for i in range(len(low) - 1)})
    assert one(spark, T.bigrams(F.col("t")), t="a") == [] and one(spark, T.word_list(F.col("t")), t="A b-c, a_1 ") == ["a", "b", "c", "a_1"]


def test_softmax_and_norm(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(S.softmax(F.col("v")).alias("s"), S.normalized(F.col("v")).alias("n")).first()
    assert rows.s == pytest.approx([0.0900306, 0.2447285, 0.6652410], abs=1e-6) and sum(x * x for x in rows.n) == pytest.approx(1)


def test_swaps(spark):
    assert one(spark, T.swap_identities(F.col("t")), t="She is a woman.") == "he is a man."
    assert one(spark, T.swap_identities(F.col("t")), t="he lost his key") is None
    assert one(spark, T.swap_identities(F.col("t")), t="give it to him") == "give it to her"


def test_mask_numbers_from_the_right_and_restores(spark):
    rows = spark.createDataFrame([("t", 0, "a@x.com then b@y.com"), ("t", 1, "again a@x.com, card 4111-2222-3333-4444"), ("u", 0, None)], "trace_id string, seq int, text string")
    masked, kept = pii.mask(rows)
    got = {(r.trace_id, r.seq): r.text for r in masked.collect()}
    assert got["t", 0] == "<EMAIL_ADDRESS_2> then <EMAIL_ADDRESS_1>"
    assert got["t", 1] == "again <EMAIL_ADDRESS_2>, card <CREDIT_CARD_1>"
    back = {(r.trace_id, r.seq): r.text for r in pii.restore(masked, kept).collect()}
    assert back["t", 0] == "a@x.com then b@y.com" and back["u", 0] is None


def test_phone_span_starts_after_the_bracket(spark):
    got = one(spark, pii.mask_plain(F.col("t")), t="call (555) 492-1092 now")
    assert got == "call (<PHONE_NUMBER> now"


def test_tool_rules(spark):
    rules = spark.createDataFrame(
        [("x", "command_type", "string", None, None, ["READ", "QUERY"]), ("x", "timeout_seconds", "int", 1.0, 60.0, None)],
        "tool string, field string, type string, min_value double, max_value double, allowed array<string>",
    ).withColumn("place", F.when(F.col("field") == "command_type", 0).otherwise(1))
    cases = {
        "ok": '{"command_type":"QUERY","timeout_seconds":30}', "far": '{"timeout_seconds":9999}', "no": '{"command_type":"DROP_DATABASE"}',
        "bad": "{not json", "type": '{"timeout_seconds":"30"}', "bool": '{"timeout_seconds":true}', "frac": '{"timeout_seconds":30.0}',
    }
    calls = spark.createDataFrame([(k, 0, "x", v) for k, v in cases.items()], CALLS)
    got = {r.trace_id: r.code for r in tools.first_violation(tools.validate(calls, rules)).collect()}
    kept = rules.agg(F.collect_list(F.struct("tool", "field", "type", "min_value", "max_value", "allowed")).alias("rules"))
    in_row = calls.crossJoin(kept).select("trace_id", tools.first_broken(F.array(F.struct(F.lit("i").alias("id"), "name", "arguments")), F.col("rules")).alias("b"))
    assert {r.trace_id: r.b.code for r in in_row.collect() if r.b} == got
    assert got == {
        "far": "TOOL_PARAMETER_OUT_OF_BOUNDS", "no": "TOOL_PARAMETER_VALUE_DISALLOWED", "bad": "TOOL_PARAMETER_TYPE_MISMATCH",
        "type": "TOOL_PARAMETER_TYPE_MISMATCH", "frac": "TOOL_PARAMETER_TYPE_MISMATCH",
    }


def test_repeated_call(spark):
    call = "array<struct<id:string,name:string,arguments:string>>"
    history = spark.createDataFrame(
        [("t", 0, "assistant", None, None, [("c1", "get_weather", '{"a":1, "b":2}')]), ("t", 1, "tool", "Sunny and 75F", "c1", None)],
        f"trace_id string, turn int, role string, content string, tool_call_id string, calls {call}",
    )
    now = spark.createDataFrame([("t", 0, "get_weather", '{"b":2,"a":1}')], CALLS)
    found = tools.call_history(history)
    assert [tuple(r) for r in tools.repeated_calls(now, found, 1).collect()] == [("t", 0, "Sunny and 75F")]
    assert tools.repeated_calls(now, found, 2).collect() == []
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "tool_call_id", "calls"))), lambda m: m)
    asked = F.array(F.struct(F.lit("x").alias("id"), F.lit("get_weather").alias("name"), F.lit('{"b":2,"a":1}').alias("arguments")))
    rows = history.groupBy("trace_id").agg(messages.alias("messages"))
    once = rows.select(tools.answered_before(F.col("messages"), asked, F.lit(1)).alias("a"), tools.answered_before(F.col("messages"), asked, F.lit(2)).alias("b")).first()
    assert tuple(once.a) == (0, "get_weather", 1, "Sunny and 75F") and once.b is None
    guard = rows.select(tools.repeat_guard(tools.answered_before(F.col("messages"), asked, F.lit(1)), F.lit("<thinking>hm</thinking>")).alias("g")).first().g
    assert guard.action == "REWRITE" and guard.fallback.startswith("<thinking>hm</thinking>") and guard.fallback.endswith("Sunny and 75F")


def test_confidence(spark):
    kind = "array<struct<token:string,logprob:double,top_logprobs:array<double>>>"
    rows = spark.createDataFrame([([("a", -0.1, None), ("b", -0.1, None), ("c", -2.6, None), ("d", -2.6, None)],), ([],)], f"l {kind}")
    m, none = (r.m for r in rows.select(tools.confidence(F.col("l")).alias("m")).collect())
    assert (round(m["mean"], 9), m["least"], m["low"], m["n"]) == (-1.35, -2.6, 0.5, 4) and none is None
    guard = rows.select(tools.confidence_guard(F.col("l")).alias("g")).first().g
    assert (guard.passed, guard.action) == (False, "BLOCK") and guard.score == pytest.approx(0.2592, abs=1e-4)


def test_cap(spark):
    got = one(spark, C.cap(F.col("c"), F.lit(4000)), c=["A" * 2500, "B" * 2500, "C"])
    assert got == ["A" * 2500, "B" * 1500 + C.MARKER]


def test_decision_order(spark):
    def r(name, passed, action, fallback=None):
        return result(name, "POST", F.lit(passed), None, F.lit(action), F.lit(name), F.lit(name), F.lit(fallback).cast("string"))

    def action(*results):
        d = spark.range(1).select(decide(F.array(*results)).alias("d")).first().d
        return d.action, d.http_status, d.fallback, d.code

    assert action(r("a", False, "REWRITE"), r("b", False, "BLOCK"), r("c", False, "BLOCK")) == ("BLOCK", 422, None, "b")
    assert action(r("a", False, "REWRITE", "Fallback message."))[:3] == ("REWRITE", 200, "Fallback message.")
    assert action(r("a", True, "TRANSFORM"), r("b", True, "ALLOW"))[0] == "TRANSFORM"
    assert action(r("a", True, "ALLOW"))[:2] == ("ALLOW", 200)


def test_split_text():
    text = "word " * 200
    parts = V.split_text(text, 50, 10)
    assert all(len(p) <= 50 for p in parts) and len(parts) > 20
    assert V.split_text("") == [] and V.split_text("a" * 700, 300, 50)[0] == "a" * 300


def test_policies(spark, tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("policies:\n  a:\n    version: '2'\n    pre_execution: {injection_threshold: 0.75}\n")
    registry = Q.PolicyRegistry(spark, str(path))
    requests = spark.createDataFrame([("a",), ("zzz",)], "app_id string")
    got = {r.app_id: r.policy for r in Q.with_policy(requests, registry.policies()).collect()}
    assert got["a"].version == "2" and got["a"].injection_threshold == 0.75 and got["zzz"].version.startswith("default")
    path.write_text(": [not yaml")
    assert not registry.reload() and {r[0] for r in registry.rows} == {"a", "default"}


def test_metrics_and_latest(spark):
    rows = spark.createDataFrame([("t", 1, "BLOCK", 2.0), ("t", 2, "ALLOW", 4.0), ("u", 1, "BLOCK", 8.0)], "trace_id string, timestamp int, pdp_action string, latency_ms double")
    got = M.metrics(M.latest(rows)).first()
    assert (got.total_requests, got.blocked, got.allowed, got.avg_latency_ms) == (2, 1, 1, 6.0)
    empty = M.metrics(rows.where("false")).first()
    assert (empty.total_requests, empty.blocked, empty.avg_latency_ms) == (0, 0, 0.0)


def stream_of(spark, folder, parts, fields):
    """A stream that reads the parts one batch each."""
    for part in parts:
        spark.createDataFrame(part, fields).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).json(str(folder))


def drained(rows, folder, name, n):
    query = rows.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).start()
    table = rows.sparkSession.table(name)
    until(query, lambda: table.count() >= n)
    return table.collect()


def test_stream_over_several_batches(spark, tmp_path):
    lines = ['data: {"choices":[{"delta":{"content":"Hello "}}]}', "noise", 'data: {"choices":[{"delta":{"content":"world"}}]}', "data: [DONE]"]
    parts = [[("s", n * 2 + i, x) for i, x in enumerate(part)] for n, part in enumerate((lines[:2], lines[2:]))]
    stream = stream_of(spark, tmp_path / "in", parts, "stream_id string, seq long, line string")
    got = drained(reassembly.reassemble(reassembly.parse_events(stream)), tmp_path / "c", "whole", 1)
    assert [(r.stream_id, r.text, r.complete) for r in got] == [("s", "Hello world", True)]


def test_vault_of_a_stream(spark, tmp_path):
    rows = [("t", 0, "a@x.com then b@y.com"), ("t", 1, "again a@x.com, card 4111-2222-3333-4444"), ("u", 0, "c@z.org")]
    stream = stream_of(spark, tmp_path / "in", [rows[:1], rows[1:]], "trace_id string, seq int, text string")
    got = drained(reassembly.session_vault(stream), tmp_path / "c", "vaults", 4)
    want = pii.vault(spark.createDataFrame(rows, "trace_id string, seq int, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 4


def test_emit(spark):
    assert [tuple(x) for x in one(spark, reassembly.emit(F.col("t")), t="a b")] == [("a ", None), ("b", "stop")]
