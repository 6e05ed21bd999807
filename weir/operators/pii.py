"""Reversible masking of personal data.

Tokens are numbered per trace and entity type in the order of first encounter: messages ascending, matches
within a message from right to left. A value keeps its first token, whatever type matches it later.
Overlapping matches: the earliest start wins, then the longest, then scan order. Requests, whose messages are in one row, are
masked in the row (vault_of, substitute, restored); tables of messages by joins (vault, mask, restore).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weir.functions import patterns as P

PATTERN = dict(P.PII)


def entity_matches(text: Column, entity: str) -> Column:
    """All matches of one entity's pattern, from left to right."""
    return F.regexp_extract_all(text, F.lit(f"(?U){PATTERN[entity]}"), F.lit(0))


def entity_counts(text: Column) -> dict[str, Column]:
    return {f"n_{e.lower()}": F.size(entity_matches(text, e)).cast("bigint") for e, _ in P.PII}


def mask_plain(text: Column) -> Column:
    """Every match replaced by its type in angle brackets; not reversible."""
    for entity, pattern in P.PII:
        text = F.regexp_replace(text, f"(?U){pattern}", f"<{entity}>")
    return text


def _placer(values: Column, gaps: Column, rank: int, entity: str):
    def place(value: Column, i: Column) -> Column:
        before = F.length(F.array_join(F.slice(gaps, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(values, F.lit(1), i), ""))
        return F.struct(
            before.alias("start"), (before + F.length(value)).alias("stop"), F.lit(rank).alias("rank"),
            F.lit(entity).alias("entity"), value.alias("value"),
        )

    return place


SPANS = "array<struct<start:int,stop:int,rank:int,entity:string,value:string>>"
VAULT = "array<struct<entity:string,value:string,token:string>>"


def spans(text: Column, entities: list[str] | Column | None = None) -> Column:
    """array<struct<start, stop, rank, entity, value>> without overlaps, by start; built from splits, no Python.

    entities: those to look for, as a list or a column of a list, "ALL" among them for all.
    The text between matches of a pattern gives their places: the n-th match starts after the first n gaps and n - 1 matches.
    """
    found, none = [], F.array().cast(SPANS)
    for rank, (entity, pattern) in enumerate(P.PII):
        if isinstance(entities, list) and entity not in entities and "ALL" not in entities:
            continue
        values = entity_matches(text, entity)
        own = F.transform(values, _placer(values, F.split(text, f"(?U){pattern}", -1), rank, entity))
        if isinstance(entities, Column):
            own = F.when(F.array_contains(entities, entity) | F.array_contains(entities, "ALL"), own).otherwise(none)
        found.append(own)
    if not found:
        return none
    every = F.transform(F.flatten(F.array(*found)), lambda s: F.struct(s["start"], (-s["stop"]).alias("last"), s["rank"], s["entity"], s["value"]))

    def keep(kept: Column, s: Column) -> Column:
        end = F.coalesce(F.try_element_at(kept, F.lit(-1))["stop"], F.lit(0))
        own = F.struct(s["start"].alias("start"), (-s["last"]).alias("stop"), s["rank"].alias("rank"), s["entity"].alias("entity"), s["value"].alias("value"))
        return F.when(s["start"] >= end, F.concat(kept, F.array(own))).otherwise(kept)

    return F.aggregate(F.array_sort(every), none, keep)


def vault_of(found: Column) -> Column:
    """The vault of one trace as a column: found is array<spans>, a list a message; tokens in the order that this module states."""
    def add(kept: Column, s: Column) -> Column:
        n = F.size(F.filter(kept, lambda e: e["entity"] == s["entity"])) + 1
        new = F.struct(s["entity"].alias("entity"), s["value"].alias("value"), F.format_string("<%s_%d>", s["entity"], n).alias("token"))
        return F.when(F.exists(kept, lambda e: e["value"] == s["value"]), kept).otherwise(F.concat(kept, F.array(new)))

    return F.aggregate(F.flatten(F.transform(found, lambda m: F.reverse(m))), F.array().cast(VAULT), add)


def substitute(text: Column, found: Column, kept: Column) -> Column:
    """The text with each of its spans replaced by the value's token in the vault column."""
    def step(a: Column, s: Column) -> Column:
        token = F.try_element_at(F.filter(kept, lambda e: e["value"] == s["value"]), F.lit(1))["token"]
        return F.struct(F.concat(a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]), token).alias("out"), s["stop"].alias("at"))

    def end(a: Column) -> Column:
        return F.concat(a["out"], text.substr(a["at"] + 1, F.length(text)))

    return F.when(F.size(found) > 0, F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, end)).otherwise(text)


def restored(text: Column, kept: Column) -> Column:
    """The text with each token of the vault column replaced by its value."""
    return F.aggregate(F.coalesce(kept, F.array().cast(VAULT)), text, lambda t, e: F.replace(t, e["token"], e["value"]))


def vault(messages: DataFrame, entities: list[str] | None = None) -> DataFrame:
    """(trace_id, entity, value, token) from messages (trace_id, seq, text)."""
    hits = messages.select("trace_id", "seq", F.explode(spans(F.col("text"), entities)).alias("s")).select(
        "trace_id", "s.entity", "s.value", F.struct("seq", (-F.col("s.start")).alias("back"), F.col("s.rank").alias("rank")).alias("met")
    )
    first = hits.groupBy("trace_id", "value").agg(F.min(F.struct("met", "entity")).alias("f"))
    n = F.row_number().over(Window.partitionBy("trace_id", "entity").orderBy("met", "value"))
    out = first.select("trace_id", "value", "f.met", "f.entity").withColumn("n", n)
    return out.select("trace_id", "entity", "value", F.format_string("<%s_%d>", "entity", "n").alias("token"))


def _by_trace(kept: DataFrame) -> DataFrame:
    return kept.groupBy("trace_id").agg(F.collect_list(F.struct("entity", "value", "token")).alias("_vault"))


def mask(messages: DataFrame, entities: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages with text masked by tokens, vault) of messages (trace_id, seq, text) in rows of their own."""
    kept = vault(messages, entities)
    found = messages.withColumn("_spans", spans(F.col("text"), entities)).join(_by_trace(kept), "trace_id", "left")
    return found.withColumn("text", substitute(F.col("text"), F.col("_spans"), F.col("_vault"))).drop("_spans", "_vault"), kept


def restore(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """texts (trace_id, text) with each token replaced by its value."""
    return texts.join(_by_trace(kept), "trace_id", "left").withColumn("text", restored(F.col("text"), F.col("_vault"))).drop("_vault")
