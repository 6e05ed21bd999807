"""Tool calls: parameter rules, repeats, confidence, agreement with reasoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weir.functions import similarity as S, text as T
from weir.operators.decision import result

#: What schema_of_variant says of values that a rule type admits; a boolean counts as a number.
KINDS = {
    "string": "STRING", "str": "STRING", "int": "BIGINT|BOOLEAN", "integer": "BIGINT|BOOLEAN",
    "float": "BIGINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL.*", "number": "BIGINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL.*",
    "bool": "BOOLEAN", "boolean": "BOOLEAN", "list": "ARRAY.*", "array": "ARRAY.*", "dict": "OBJECT.*", "object": "OBJECT.*",
}
NUMBERS = ("int", "integer", "float", "number")
RULES = "tool string, field string, type string, min_value double, max_value double, allowed array<string>, place int"
RULE = "struct<tool:string,field:string,type:string,min_value:double,max_value:double,allowed:array<string>>"


def call_hash(name: Column, arguments: Column) -> Column:
    """MD5 of the name and the arguments with sorted keys; arguments that are no JSON as they are."""
    return F.md5(F.concat(name, F.lit("::"), F.coalesce(F.to_json(F.try_parse_json(arguments)), arguments, F.lit(""))))


def _code(value: Column, rule) -> Column:
    """The code of a rule (its parts by name) that a value, a variant, breaks; null if it keeps it."""
    kind, type_ = F.schema_of_variant(value), F.lower(rule("type"))
    wanted = F.lit(None).cast("string")
    for name, pattern in KINDS.items():
        wanted = F.when(type_ == name, pattern).otherwise(wanted)
    number = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).otherwise(F.try_variant_get(value, "$", "double"))
    out_of_range = type_.isin(*NUMBERS) & ((number < rule("min_value")) | (number > rule("max_value")))
    allowed = F.coalesce(rule("allowed"), F.array().cast("array<string>"))
    listed_out = (F.size(allowed) > 0) & ~F.array_contains(allowed, F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("")))
    mismatch = wanted.isNotNull() & ~F.coalesce(F.rlike(kind, F.concat(F.lit("^(?:"), wanted, F.lit(")$"))), F.lit(False))
    return (
        F.when(mismatch, "TOOL_PARAMETER_TYPE_MISMATCH")
        .when(F.coalesce(listed_out, F.lit(False)), "TOOL_PARAMETER_VALUE_DISALLOWED")
        .when(F.coalesce(out_of_range, F.lit(False)), "TOOL_PARAMETER_OUT_OF_BOUNDS")
    )


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def validate(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """calls (trace_id, seq, name, arguments) against rules: a row for each broken rule, code and reason.

    Only calls of listed tools are judged; arguments that are no JSON object break the rules as a whole. place is a rule's
    place in its file.
    """
    listed = calls.join(F.broadcast(rules.select(F.col("tool").alias("name")).distinct()), "name", "left_semi")
    parsed = listed.withColumn("v", F.try_parse_json(F.coalesce("arguments", F.lit("{}"))))
    parsed = parsed.withColumn("is_object", _is_object(F.col("v")))
    broken = parsed.where("not is_object").select(
        "trace_id", "seq", "name", F.lit(-1).alias("place"), F.lit(None).cast("string").alias("field"), F.lit("TOOL_PARAMETER_TYPE_MISMATCH").alias("code")
    )
    joined = parsed.where("is_object").join(F.broadcast(rules), F.col("name") == F.col("tool"))
    found = joined.withColumn("fields", F.try_variant_get("v", "$", "map<string,variant>"))
    found = found.where(F.expr("map_contains_key(fields, field)")).withColumn("value", F.col("fields")[F.col("field")])
    return broken.unionByName(found.select("trace_id", "seq", "name", "place", "field", _code(F.col("value"), F.col).alias("code")).where("code is not null"))


def first_broken(calls: Column, rules: Column) -> Column:
    """struct<seq, name, field, code>: the first broken rule by call, then by the rule's place in array<RULE>; null for none."""
    def of(c: Column, i: Column) -> Column:
        def judged(v: Column) -> Column:
            def against(fields: Column) -> Column:
                given = F.filter(rules, lambda r: (r["tool"] == c["name"]) & F.coalesce(F.array_contains(F.map_keys(fields), r["field"]), F.lit(False)))
                found = F.transform(
                    given, lambda r: F.struct(i.alias("seq"), c["name"].alias("name"), r["field"].alias("field"), _code(fields[r["field"]], lambda k: r[k]).alias("code"))
                )
                return F.filter(found, lambda x: x["code"].isNotNull())

            none = F.lit(None).cast("string")
            whole = F.array(F.struct(i.alias("seq"), c["name"].alias("name"), none.alias("field"), F.lit("TOOL_PARAMETER_TYPE_MISMATCH").alias("code")))
            return F.when(~_is_object(v), whole).otherwise(T.let(F.try_variant_get(v, "$", "map<string,variant>"), against))

        empty = F.array().cast("array<struct<seq:int,name:string,field:string,code:string>>")
        listed = F.exists(rules, lambda r: r["tool"] == c["name"])
        return F.when(listed, T.let(F.try_parse_json(F.coalesce(c["arguments"], F.lit("{}"))), judged)).otherwise(empty)

    return F.try_element_at(F.flatten(F.transform(calls, of)), F.lit(1))


def first_violation(violations: DataFrame) -> DataFrame:
    """(trace_id, field, code): the first by call, then by rule."""
    return violations.groupBy("trace_id").agg(F.min(F.struct("seq", "place", "field", "code")).alias("f")).select("trace_id", "f.field", "f.code")


def call_history(messages: DataFrame) -> DataFrame:
    """(trace_id, hash, n, output) from messages (trace_id, turn, role, content, tool_call_id, calls): each response joined to the
    latest call of its id before it; output is the latest."""
    calls = messages.where("role = 'assistant'").select("trace_id", F.col("turn").alias("call_turn"), F.explode("calls").alias("c")).select(
        "trace_id", "call_turn", F.col("c.id").alias("tool_call_id"), call_hash(F.col("c.name"), F.col("c.arguments")).alias("hash")
    )
    replies = messages.where("role = 'tool'").select("trace_id", "turn", "tool_call_id", "content")
    joined = replies.join(calls, ["trace_id", "tool_call_id"]).where("call_turn < turn")
    latest = joined.groupBy("trace_id", "turn", "tool_call_id").agg(F.max(F.struct("call_turn", "hash", "content")).alias("m"))
    return latest.groupBy("trace_id", F.col("m.hash").alias("hash")).agg(
        F.count("*").alias("n"), F.max(F.struct("turn", F.col("m.content").alias("content")))["content"].alias("output")
    )


def repeated_calls(calls: DataFrame, history: DataFrame, most: int = 1) -> DataFrame:
    """(trace_id, seq, output): the first call of each trace already answered `most` times or more."""
    hashed = calls.select("trace_id", "seq", call_hash(F.col("name"), F.col("arguments")).alias("hash"))
    hit = hashed.join(history.where(F.col("n") >= most), ["trace_id", "hash"])
    return hit.groupBy("trace_id").agg(F.min(F.struct("seq", "output")).alias("f")).select("trace_id", "f.seq", "f.output")


CALLED = "array<struct<turn:int,id:string,hash:string>>"


def answered_before(messages: Column, calls: Column, most: Column) -> Column:
    """struct<seq, name, n, output>: the first call that the messages hold with the same arguments, answered `most` times or more.

    An answer belongs to the latest call of its id before it; output is the latest answer.
    """
    def made(m: Column, i: Column) -> Column:
        own = F.transform(F.coalesce(m["calls"], F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: F.struct(i.alias("turn"), c["id"].alias("id"), call_hash(c["name"], c["arguments"]).alias("hash")))
        return F.when(m["role"] == "assistant", own).otherwise(F.array().cast(CALLED))

    def with_calls(made_calls: Column) -> Column:
        def answer(m: Column, i: Column) -> Column:
            own = F.filter(made_calls, lambda c: (c["id"] == m["tool_call_id"]) & (c["turn"] < i))
            return F.struct(F.when(m["role"] == "tool", F.try_element_at(own, F.lit(-1))["hash"]).alias("hash"), m["content"].alias("content"))

        return F.filter(F.transform(messages, answer), lambda a: a["hash"].isNotNull())

    def repeated(answered: Column) -> Column:
        def asked(c: Column, i: Column) -> Column:
            def of(h: Column) -> Column:
                return F.struct(i.alias("seq"), c["name"].alias("name"), F.filter(answered, lambda a: a["hash"] == h).alias("found"))

            return T.let(call_hash(c["name"], c["arguments"]), of)

        first = F.try_element_at(F.filter(F.transform(calls, asked), lambda x: (F.size(x["found"]) > 0) & (F.size(x["found"]) >= most)), F.lit(1))
        return T.let(
            first,
            lambda x: F.when(
                x.isNotNull(),
                F.struct(x["seq"].alias("seq"), x["name"].alias("name"), F.size(x["found"]).alias("n"), F.try_element_at(x["found"], F.lit(-1))["content"].alias("output")),
            ),
        )

    return T.let(T.let(F.flatten(F.transform(messages, made)), with_calls), repeated)


def repeat_guard(again: Column, completion: Column) -> Column:
    """From a column of answered_before: what the model said, then the answer it has already."""
    bad = again.isNotNull()
    text = F.concat(F.lit("The tool "), again["name"], F.lit(" was called with these arguments before. Its latest answer:\n"), F.coalesce(again["output"], F.lit("")))
    said = F.when(F.coalesce(completion, F.lit("")) != "", F.concat(completion, F.lit("\n\n"), text)).otherwise(text)
    return result(
        "tool_deduplicator", "POST", ~bad, None, F.when(bad, "REWRITE").otherwise("ALLOW"), F.when(bad, "DUPLICATE_TOOL_CALL"),
        F.when(bad, F.concat(again["name"], F.lit(" called with the same arguments "), (again["n"] + 1).cast("string"), F.lit(" times"))), F.when(bad, said),
    )


def tool_guard(broken: Column) -> Column:
    """From a column of first_broken."""
    bad = broken.isNotNull()
    return result(
        "agent_tool_guard", "TOOL", ~bad, None, F.when(bad, "BLOCK").otherwise("ALLOW"), broken["code"],
        F.when(bad, F.concat(F.lit("Tool "), broken["name"], F.lit(", parameter "), F.coalesce(broken["field"], F.lit("arguments")))),
    )


def confidence(logprobs: Column, per_token: float | Column = -2.5) -> Column:
    """struct<mean, least, low, n, entropy> of array<struct<token, logprob, top_logprobs>>; null without values."""
    entropy = F.aggregate(F.transform(logprobs, lambda t: S.token_entropy(t["top_logprobs"])), F.lit(0.0), lambda a, x: a + x)

    def of(real: Column) -> Column:
        n = F.size(real)
        return F.when(
            n > 0,
            F.struct(
                (F.aggregate(real, F.lit(0.0), lambda a, x: a + x) / n).alias("mean"), F.array_min(real).alias("least"),
                (F.size(F.filter(real, lambda x: x < per_token)).cast("double") / n).alias("low"), n.alias("n"),
                (entropy / F.size(logprobs)).alias("entropy"),
            ),
        )

    return T.let(F.filter(F.transform(logprobs, lambda t: t["logprob"]), lambda x: x.isNotNull()), of)


def confidence_guard(
    logprobs: Column, mean: float | Column = -2.0, least: float | Column = -4.0, per_token: float | Column = -2.5, low: float | Column = 0.3
) -> Column:
    def of(m: Column) -> Column:
        bad = F.coalesce((m["mean"] < mean) | (m["least"] < least) | (m["low"] > low), F.lit(False))
        return result(
            "confidence_mismatch_guard", "TOOL", ~bad, F.exp(m["mean"]), F.when(bad, "BLOCK").otherwise("ALLOW"),
            F.when(bad, "AGENT_CONFIDENCE_MISMATCH"), F.when(bad, "Low confidence in tool call tokens"),
        )

    return T.let(confidence(logprobs, per_token), of)


def argument_text(calls: Column) -> Column:
    """name: key=value ... of each call, joined by " | "; arguments that are no JSON object as they are.

    Values are written as JSON text without quotes, which differs from Python's spelling of booleans and null.
    """
    def one(c: Column) -> Column:
        parsed = F.from_json(c["arguments"], "map<string,string>")
        pairs = F.array_join(F.transform(F.map_entries(parsed), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), " ")
        return F.concat(F.coalesce(c["name"], F.lit("unknown_tool")), F.lit(": "), F.coalesce(pairs, c["arguments"], F.lit("")))

    return F.array_join(F.transform(calls, one), " | ")


def reasoning_guard(reasoning: Column, calls: Column, least: float | Column = 0.15, score: Column | None = None) -> Column:
    """score: a model's, in place of the comparison of characters and words."""
    if score is None:
        score = S.reasoning_score(reasoning.substr(1, 512), argument_text(calls).substr(1, 512))
    asked = (F.coalesce(reasoning, F.lit("")) != "") & (F.size(F.coalesce(calls, F.array())) > 0)

    def of(s: Column) -> Column:
        bad = F.coalesce(s < least, F.lit(False))
        return result(
            "reasoning_output_similarity_guard", "TOOL", ~bad, s, F.when(bad, "BLOCK").otherwise("ALLOW"),
            F.when(bad, "AGENT_REASONING_OUTPUT_MISMATCH"), F.when(bad, "Reasoning does not match the tool arguments"),
        )

    return T.let(F.when(asked, score), of)
