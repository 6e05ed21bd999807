import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.operators import models, retrieval, telemetry


def test_pairs_are_scored_in_order(spark):
    rows = spark.createDataFrame([(i, f"c{i}", f"q{i}") for i in range(20)], "i int, a string, b string")
    scored = rows.select("i", models.score_pairs(F.col("a"), F.col("b"), lambda: lambda ps: [(float(a[1:]), 0.0, float(b[1:])) for a, b in ps], "t").alias("s"))
    assert all(r.s.entailment == r.i == r.s.neutral for r in scored.collect())


def test_embedding_is_of_unit_length(spark):
    rows = spark.createDataFrame([("a b c",), ("a b c",), ("x",)], "t string")
    v = [r.v for r in rows.select(models.embed(F.col("t"), models.hashing_embedder, "h").alias("v")).collect()]
    assert v[0] == v[1] != v[2] and sum(x * x for x in v[0]) == pytest.approx(1.0, abs=1e-5)


def test_judge_fails_open(spark):
    def judge(prompt):
        if "boom" in prompt:
            raise ValueError
        return '```json\n{"is_hallucination": true, "reason": "made up"}\n```' if "bad" in prompt else "no json"

    rows = spark.createDataFrame([("t1", "bad"), ("t2", "boom"), ("t3", "fine")], "trace_id string, prompt string")
    found = models.ask(rows, lambda: judge, "j").select("trace_id", models.verdict(F.col("reply"), "is_hallucination").alias("v"))
    found = found.select("trace_id", models.judged("chatbot_hallucination_guard", F.col("v"), F.lit("rewrite"), F.lit("sorry")).alias("r"))
    got = {r.trace_id: (r.r.passed, r.r.action, r.r.fallback) for r in found.collect()}
    assert got == {"t1": (False, "REWRITE", "sorry"), "t2": (True, "ALLOW", None), "t3": (True, "ALLOW", None)}


def test_calls_that_take_too_long_are_left(spark):
    began = time.monotonic()
    got = models.in_time(lambda x: time.sleep(x) or x, [0.0, None, 20.0, 0.01], 0.3)
    assert got == [0.0, None, None, 0.01] and time.monotonic() - began < 10


def test_upstream_calls_are_made_again(spark):
    def factory():
        tried = {}

        def client(payload):
            tried[payload] = tried.get(payload, 0) + 1
            if payload == "down":
                raise OSError
            return (500 if tried[payload] == 1 and payload == "late" else 429 if payload == "busy" else 200), payload.upper()

        return client

    rows = spark.createDataFrame([("ok",), ("late",), ("busy",), ("down",), (None,)], "p string").coalesce(1)
    got = {r.p: (r.u.status, r.u.body) for r in rows.select("p", models.send(F.col("p"), factory, "again", 5.0).alias("u")).collect()}
    assert got == {"ok": (200, "OK"), "late": (200, "LATE"), "busy": (429, "BUSY"), "down": (0, None), None: (None, None)}


def test_label_places():
    assert models.label_places("x", {0: "Entailment", 1: "neutral", 2: "CONTRADICTION"}) == (0, 2, 1)
    assert models.label_places("nli-roberta-base") == (2, 0, 1) and models.label_places("other") == models.label_places("nli-deberta-v3") == (1, 0, 2)


def test_onnx_scorer_with_a_session():
    import public_tokenizers

    class Session:
        def get_modelmeta(self):
            return type("M", (), {"custom_metadata_map": {"id2label": '{"0": "entailment", "1": "neutral", "2": "contradiction"}'}})

        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def run(self, _, given):
            assert set(given) == {"input_ids", "attention_mask"} and len(given["input_ids"]) <= models.SUB_BATCH
            n = given["attention_mask"].sum(axis=1)
            return [np.stack([n, 0 * n, 0 * n], axis=1).astype(float)]

    score = models.onnx_pair_scorer("none", public_tokenizers.path("byte_bpe_50k.json"), session=Session())
    got = score([("a", "b")] * 40 + [("a b c d e f", "g h")])
    assert len(got) == 41 and got[-1][0] > got[0][0] > got[0][1] == got[0][2] and sum(got[0]) == pytest.approx(1)
    assert score([]) == [] and models.pair_scorer("heuristic") is None
    with pytest.raises(ValueError):
        models.pair_scorer("onnx")


def test_bias_axes_and_projection(spark):
    places = {w: ([1.0, 0.0, 0.0] if w in models.ANCHORS["Gender"][0] else [0.0, 1.0, 0.0] if w in models.ANCHORS["Gender"][1] else [0.0, 0.0, 1.0]) for g in models.ANCHORS.values() for ws in g for w in ws}
    def embedder(texts):
        return [places.get(t, [0.9, 0.1, 0.0] if t else [0.0] * 3) for t in texts]

    axes = models.bias_axes(embedder)
    assert list(axes) == ["Gender"]
    rows = spark.createDataFrame([("she",), ("asian",), ("some text",), ("",)], "t string").withColumn("v", models.embed(F.col("t"), lambda: embedder, "axes"))
    got = rows.select("t", models.projection(F.col("v"), axes).alias("p")).collect()
    assert {r.t: round(r.p.score, 4) for r in got} == {"she": 0.7071, "asian": 0.0, "some text": 0.6247, "": 0.0}


def test_cosines_by_embeddings(spark):
    rows = spark.createDataFrame([(["a b", "c"], ["a b", "x"]), ([], ["y"]), (None, None)], "a array<string>, b array<string>")
    got = [r.c for r in rows.select(models.cosines(F.col("a"), F.col("b"), models.hashing_embedder, "cos").alias("c")).collect()]
    assert got[0][0][0] == pytest.approx(1.0) and len(got[0]) == 2 and len(got[0][1]) == 2 and got[1] == [] == got[2]


def test_mean_pool(spark):
    got = spark.sql("SELECT array(array(1D, 2D), array(3D, 4D), array(9D, 9D)) AS v, array(1, 1, 0) AS m").select(retrieval.mean_pool(F.col("v"), F.col("m")).alias("p"))
    assert got.first().p == [2.0, 3.0]


def test_report(spark, tmp_path):
    telemetry.report(spark.createDataFrame([("A", "ALLOW", True), ("B", "BLOCK", False)], "trace_id string, action string, passed boolean"), str(tmp_path))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "markdown")).collect())
    assert "| `A` | ALLOW | PASSED |" in text and "| `B` | BLOCK | FAILED |" in text
