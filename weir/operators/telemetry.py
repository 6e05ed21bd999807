"""The audit table: rows, latest row per trace, recent traces, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

AUDIT = (
    "trace_id string, timestamp timestamp, app_id string, policy_version string, policy_hash string, use_case_mode string, "
    "input_tokens int, output_tokens int, latency_ms double, pre_execution_latency_ms double, upstream_latency_ms double, "
    "post_execution_latency_ms double, pii_entities_found array<string>, injection_score double, grounding_score double, "
    "bias_score double, pdp_action string, violation_reason string, raw_request_payload string, final_response_payload string"
)


def append(rows: DataFrame, path: str) -> None:
    """Add audit rows, by day."""
    rows.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def latest(rows: DataFrame, version: str = "timestamp") -> DataFrame:
    """One row per trace_id: the last written."""
    w = Window.partitionBy("trace_id").orderBy(F.col(version).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def recent(rows: DataFrame, limit: int = 50, app_id: str | None = None) -> DataFrame:
    """The newest traces, ties by trace_id."""
    own = rows if app_id is None else rows.where(F.col("app_id") == app_id)
    return own.orderBy(F.col("timestamp").desc(), F.col("trace_id").asc()).limit(limit)


def metrics(rows: DataFrame, action: str = "pdp_action", latency: str = "latency_ms", by: list[str] | None = None) -> DataFrame:
    """Counts by action and the mean latency to two decimals; zeros for an empty table. by: an extension, one row a group."""
    def of(name: str):
        return F.count_if(F.col(action) == name).cast("bigint")

    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("total_requests"), of("BLOCK").alias("blocked"), of("REWRITE").alias("rewritten"),
        of("TRANSFORM").alias("transformed"), of("ALLOW").alias("allowed"),
        F.coalesce(F.round(F.avg(latency), 2), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.percentile_approx(latency, 0.95), F.lit(0.0)).alias("p95_latency_ms"),
    )


def entities_json(rows: DataFrame) -> DataFrame:
    """For export: entities as JSON text."""
    return rows.withColumn("pii_entities_found", F.to_json("pii_entities_found"))


def entities_array(rows: DataFrame) -> DataFrame:
    """From export: JSON text back to an array; what can't be read is empty."""
    return rows.withColumn("pii_entities_found", F.coalesce(F.from_json("pii_entities_found", "array<string>"), F.array().cast("array<string>")))


def pass_rate(results: DataFrame) -> DataFrame:
    """passed, total and the rate in percent of scenario results (passed boolean)."""
    return results.agg(
        F.count_if("passed").alias("passed"), F.count("*").alias("total"),
        F.round(100 * F.count_if("passed") / F.greatest(F.count("*"), F.lit(1)), 1).alias("pass_rate"),
    )


def report(results: DataFrame, path: str) -> None:
    """Scenario results (trace_id, action, passed) as JSON lines in path/json and a Markdown table in path/markdown, its lines sorted over files."""
    results.write.mode("overwrite").json(f"{path}/json")
    mark = F.when(F.col("passed"), "PASSED").otherwise("FAILED")
    rows = results.select(F.lit(1).alias("part"), "trace_id", F.concat(F.lit("| `"), "trace_id", F.lit("` | "), "action", F.lit(" | "), mark, F.lit(" |")).alias("value"))
    head = results.sparkSession.createDataFrame([(0, "0", "| ID | Action | Result |"), (0, "1", "| :--- | :--- | :--- |")], "part int, trace_id string, value string")
    head.unionByName(rows).orderBy("part", "trace_id").select("value").write.mode("overwrite").text(f"{path}/markdown")
