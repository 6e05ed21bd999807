"""Buffered streams: deltas of a stream gathered until it ends, then judged as a whole; vaults, caches and audit rows of streams.

State is kept by transformWithState, which needs the RocksDB state store (`use_state_store`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weir.operators import context as C, pii
from weir.plans import pipeline

DONE = "[DONE]"
ABANDONED_MS, VAULT_MS = 600_000, 3_600_000


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def parse_events(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, delta, done) of event lines (stream_id, seq, line); lines that aren't data or no JSON are left out."""
    body = F.expr("substr(line, 7)")
    kept = lines.where(F.col("line").startswith("data: ")).withColumn("_body", F.trim(body))
    done = F.col("_body") == DONE
    value = F.try_parse_json("_body")
    delta = F.try_variant_get(value, "$.choices[0].delta.content", "string")
    return kept.where(done | value.isNotNull()).select("stream_id", "seq", F.coalesce(delta, F.lit("")).alias("delta"), done.alias("done"))


def to_events(texts: DataFrame, key: str = "stream_id", text: str = "text") -> DataFrame:
    """(stream_id, seq, delta, done): a text's words as a stream, the last one marked."""
    words = F.split(text, " ")
    rows = texts.select(F.col(key).alias("stream_id"), F.posexplode(words).alias("seq", "word"), F.size(words).alias("_n"))
    last = F.col("seq") == F.col("_n") - 1
    return rows.select("stream_id", "seq", F.when(last, F.col("word")).otherwise(F.concat("word", F.lit(" "))).alias("delta"), last.alias("done"))


def emit(text: Column) -> Column:
    """array<struct<delta, finish_reason>>: a text as words for the client; the last stops the stream."""
    words = F.split(text, " ")
    return F.transform(
        words,
        lambda w, i: F.struct(
            F.when(i < F.size(words) - 1, F.concat(w, F.lit(" "))).otherwise(w).alias("delta"),
            F.when(i == F.size(words) - 1, "stop").alias("finish_reason"),
        ),
    )


def event_lines(evaluated: DataFrame) -> DataFrame:
    """(trace_id, seq, line): what clients of evaluated streams get: the error or the words, then the end."""
    blocked = F.col("decision.action") == "BLOCK"
    chunk = F.transform(
        emit("response"),
        lambda c: F.concat(
            F.lit("data: "),
            F.to_json(
                F.struct(
                    F.concat(F.lit("chatcmpl-stream-"), F.col("trace_id")).alias("id"), F.lit("chat.completion.chunk").alias("object"), F.col("model"),
                    F.array(F.struct(F.lit(0).alias("index"), F.struct(c["delta"].alias("content")).alias("delta"), c["finish_reason"].alias("finish_reason"))).alias("choices"),
                )
            ),
        ),
    )
    error = F.array(F.concat(F.lit("data: "), F.col("response")))
    return evaluated.select("trace_id", F.posexplode(F.concat(F.when(blocked, error).otherwise(chunk), F.array(F.lit(f"data: {DONE}")))).alias("seq", "line"))


def gather(events: DataFrame) -> DataFrame:
    """Batch: (stream_id, text) of whole streams."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return events.groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda p: p["delta"]), "").alias("text"))


class Reassembler(StatefulProcessor):
    """Appends a stream's deltas to a list until its end is there, or it is abandoned."""

    def __init__(self, abandoned_ms: int = ABANDONED_MS):
        self.abandoned_ms = abandoned_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "seq bigint, delta string")
        self.last = handle.getValueState("last", "n bigint")

    def _whole(self, key, complete: bool) -> pd.DataFrame:
        held = sorted((s, d or "") for s, d in self.parts.get())
        self.parts.clear()
        self.last.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        return pd.DataFrame({"stream_id": [key[0]], "text": ["".join(d for _, d in held)], "complete": [complete]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.last.get()[0] if self.last.exists() else 0
        end = None
        for frame in rows:
            new = [(int(s), d) for s, d in zip(frame["seq"], frame["delta"])]
            self.parts.appendList(new)
            n += len(new)
            ends = frame.loc[frame["done"], "seq"]
            end = int(ends.max()) if len(ends) else end
        if end is not None:
            yield self._whole(key, True)
            return
        self.last.update((n,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.abandoned_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.parts.exists():
            yield self._whole(key, False)


def reassemble(events: DataFrame, abandoned_ms: int = ABANDONED_MS) -> DataFrame:
    """Streaming: (stream_id, text, complete), a row once a stream is done, or nothing came for abandoned_ms."""
    use_state_store(events.sparkSession)
    return events.groupBy("stream_id").transformWithStateInPandas(Reassembler(abandoned_ms), "stream_id string, text string, complete boolean", "append", "processingTime")


def judged(finished: DataFrame, requests: DataFrame, policies: DataFrame, tool_rules: DataFrame, **options) -> DataFrame:
    """Finished streams as evaluated requests (see pipeline.evaluate): their text is the completion of the request whose trace_id is the stream's id.

    requests is a table, not a stream; of an abandoned stream what there is is judged.
    """
    texts = finished.select("stream_id", F.col("text").alias("_text"))
    own = requests.drop("completion_text", "stream").join(texts, F.col("trace_id") == F.col("stream_id"), "inner").drop("stream_id")
    return pipeline.evaluate(own.withColumnRenamed("_text", "completion_text").withColumn("stream", F.lit(True)), policies, tool_rules, **options)


class Vault(StatefulProcessor):
    """Keeps the tokens of a trace's values; a value that isn't met again in time is forgotten."""

    def __init__(self, keep_ms: int = VAULT_MS):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getMapState("tokens", "value string", "entity string, token string", self.keep_ms)
        self.counts = handle.getMapState("counts", "entity string", "n int", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        met = sorted((int(seq), -int(start), int(rank), entity, value) for frame in rows for seq, start, rank, entity, value in frame[["seq", "start", "rank", "entity", "value"]].itertuples(index=False))
        out = []
        for _, _, _, entity, value in met:
            if self.tokens.containsKey((value,)):
                held = self.tokens.getValue((value,))
                self.tokens.updateValue((value,), held)  # its time starts again
                continue
            n = (self.counts.getValue((entity,))[0] if self.counts.containsKey((entity,)) else 0) + 1
            self.counts.updateValue((entity,), (n,))
            self.tokens.updateValue((value,), (entity, f"<{entity}_{n}>"))
            out.append((key[0], entity, value, f"<{entity}_{n}>"))
        yield pd.DataFrame(out, columns=["trace_id", "entity", "value", "token"])


def session_vault(messages: DataFrame, entities: list[str] | None = None, keep_ms: int = VAULT_MS) -> DataFrame:
    """Streaming: (trace_id, entity, value, token), a row for each new value of messages (trace_id, seq, text), numbered as in pii.vault."""
    use_state_store(messages.sparkSession)
    hits = messages.select("trace_id", F.col("seq").cast("int").alias("seq"), F.explode(pii.spans(F.col("text"), entities)).alias("s"))
    flat = hits.select("trace_id", "seq", "s.start", "s.rank", "s.entity", "s.value")
    return flat.groupBy("trace_id").transformWithStateInPandas(Vault(keep_ms), "trace_id string, entity string, value string, token string", "append", "processingTime")


def _by_epoch(rows: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda x: x):
    def write(batch: DataFrame, epoch: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def append_audit(rows: DataFrame, path: str, checkpoint: str):
    """Write finished rows to the audit table; a batch that is run again replaces its own rows."""
    return _by_epoch(rows, path, checkpoint)


def keep_answers(evaluated: DataFrame, path: str, checkpoint: str):
    """Write what the policies let the cache keep of a stream of evaluated requests; context.cached reads it."""
    return _by_epoch(evaluated, path, checkpoint, C.cache_rows)


def windowed_metrics(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: count and mean by window and key, late rows admitted up to the watermark."""
    watched = events.withWatermark(ts, late) if events.isStreaming else events
    return watched.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(
        F.col("w.start").alias("start"), key, "n", "mean"
    )


def refresh_metrics(rows: DataFrame, name: str, every: str = "3 seconds"):
    """Metrics of a stream of audit rows, brought up to date again and again in the table called name."""
    from weir.operators.telemetry import metrics

    return metrics(rows).writeStream.outputMode("complete").format("memory").queryName(name).trigger(processingTime=every)
