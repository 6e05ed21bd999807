"""Rule detectors: prompt injection, toxicity, bias."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weir.functions import patterns as P, similarity as S, text as T
from weir.operators.decision import result


def scan(text: Column, rules: list[tuple[str, float, str]]) -> tuple[Column, Column]:
    """(highest score, reasons) of one text."""
    hits = T.rule_hits(text, rules)
    return T.max_score(hits), T.reasons(hits)


def message_hits(messages: Column) -> Column:
    """The injection rules that any message of any role matches."""
    return F.flatten(F.transform(messages, lambda m: T.rule_hits(F.coalesce(m["content"], F.lit("")), P.INJECTION)))


def injection(hits: Column, threshold: Column) -> Column:
    """A score at the threshold fails and blocks. hits should be a column that is there, since it is used several times."""
    score = T.max_score(hits)
    bad = score >= threshold
    return result(
        "prompt_injection", "PRE", ~bad, score, F.when(bad, "BLOCK").otherwise("ALLOW"),
        F.when(bad, "PROMPT_INJECTION_DETECTED"), F.when(bad, F.array_join(T.reasons(hits), ", ")),
    )


def output_rules(detector: str, code: str, hits: Column, threshold: Column, action: Column, fallback: Column) -> Column:
    """A rule detector from its rules' hits on the completion; bias reports no score when it passes."""
    score = T.max_score(hits)
    bad = F.coalesce(score >= threshold, F.lit(False))
    shown = F.when(bad, score) if detector == "bias_subspace_detector" else score
    return result(
        detector, "POST", ~bad, shown, F.when(bad, F.upper(action)).otherwise("ALLOW"), F.when(bad, F.lit(code)),
        F.when(bad, F.array_join(T.reasons(hits), ", ")), F.when(bad, fallback),
    )


def bias_axis(a: Column, b: Column) -> Column:
    """The unit vector from the mean of group b to the mean of group a."""
    return S.normalized(F.zip_with(a, b, lambda x, y: x - y))


def bias_skew(vector: Column, axes: list[Column]) -> Column:
    """The largest absolute projection on the axes."""
    parts = [F.abs(S.dot(vector, axis)) for axis in axes]
    return parts[0] if len(parts) == 1 else F.greatest(*parts)
