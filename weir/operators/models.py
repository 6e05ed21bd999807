"""Where models plug in: scoring of text pairs, embedding, judges and upstream models, as Arrow-batched functions.

A factory is called once a worker process and returns a function on lists; nothing here needs a network unless a client that is
passed in does. A judge that fails, takes too long, or answers what can't be read lets the request pass; other models that fail give
an error, which the policy's fail mode decides on.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weir.functions import similarity as S, text as T
from weir.operators.decision import result

PairScorer = Callable[[list[tuple[str, str]]], list[tuple[float, float, float]]]
Relevance = Callable[[list[tuple[str, str]]], list[float]]
Embedder = Callable[[list[str]], list[list[float]]]
Judge = Callable[[str], str]
#: A client takes a request's JSON text and gives the status and body of the reply.
Client = Callable[[str], tuple[int, str]]
_MADE: dict[str, object] = {}
VIOLATIONS = {"chatbot_hallucination_guard": "LOW_GROUNDING_HALLUCINATION", "bias_subspace_detector": "BIAS_SUBSPACE_DRIFT"}
NLI = "struct<entailment:double,contradiction:double,neutral:double>"
SUB_BATCH, JUDGE_SECONDS, SWAP_SECONDS, UPSTREAM_SECONDS, CONCURRENCY = 32, 10.0, 20.0, 30.0, 8

JUDGE_PROMPT = (
    "Below are a conversation and the reply that an assistant gave. Say whether the reply invents something or contradicts the "
    "conversation; use nothing but the conversation.\n\n# Conversation\n{}\n\n# Reply\n{}\n\nAnswer in JSON with two keys: "
    '"is_hallucination" (true or false) and "reason" (one sentence).'
)
SWAP_PROMPT = (
    "The second text is the first one with words for men and women exchanged. Say whether the exchange shows that the text treats "
    "one of them unfairly.\n\n# Text\n{}\n\n# Exchanged\n{}\n\nAnswer in JSON with two keys: "
    '"is_biased" (true or false) and "reason" (one sentence).'
)
# Words at the ends of the axes that bias is measured along.
ANCHORS = {"Gender": (["he", "man", "male"], ["she", "woman", "female"]), "Race": (["white", "caucasian"], ["black", "african american", "hispanic", "asian"])}
# Where cross-encoders by name have entailment, contradiction and neutral among their outputs.
LABEL_PLACES = {"deberta": (1, 0, 2), "roberta": (2, 0, 1), "minilm": (1, 0, 2), "albert": (1, 0, 2)}
DEFAULT_PLACES = (1, 0, 2)


@dataclass(frozen=True)
class Models:
    """Factories of the models that the guards may use; None: the guard does without, as its docstring says."""

    nli: Callable[[], PairScorer] | None = None
    reranker: Callable[[], Relevance] | None = None
    embedder: Callable[[], Embedder] | None = None
    judge: Callable[[], Judge] | None = None
    name: str = "models"


def _once(name: str, factory: Callable[[], object]):
    if name not in _MADE:
        _MADE[name] = factory()
    return _MADE[name]


def in_time(call: Callable, inputs: list, seconds: float, concurrency: int = CONCURRENCY) -> list:
    """call(x) of each input that isn't None, a few at once; None where it fails or takes longer."""
    wanted = [x for x in inputs if x is not None]
    if not wanted:
        return [None] * len(inputs)
    pool = ThreadPoolExecutor(min(concurrency, len(wanted)))
    try:
        ends: dict[int, float] = {}

        def timed(k: int, x):
            ends[k] = time.monotonic() + seconds
            return call(x)

        found = [None if x is None else pool.submit(timed, k, x) for k, x in enumerate(inputs)]
        out = []
        for k, f in enumerate(found):
            value = None
            while f is not None:
                try:
                    value = f.result(timeout=min(seconds, max(0.0, ends[k] - time.monotonic())) if k in ends else seconds / 10)
                    break
                except TimeoutError:
                    if f.done() or (k in ends and time.monotonic() >= ends[k]):
                        break
                except Exception:  # whatever a model's client raises, its answer is missing
                    break
            out.append(value)
        return out
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def score_pairs(context: Column, claim: Column, factory: Callable[[], PairScorer], name: str) -> Column:
    """struct<entailment, contradiction, neutral> of each pair by a model, in order, a batch at a time."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = _once(name, factory)
        for a, b in batches:
            yield pd.DataFrame(model(list(zip(a.fillna(""), b.fillna("")))), columns=["entailment", "contradiction", "neutral"])

    return F.pandas_udf(run, "entailment double, contradiction double, neutral double")(context, claim)


def _in_lists(values: pd.Series, one: Callable[[list], list]) -> list:
    """one() of all rows' lists joined, cut into rows again; a row's list may be None."""
    rows = [list(x) if x is not None else [] for x in values]
    flat = one([x for row in rows for x in row])
    cuts = np.cumsum([0, *map(len, rows)])
    return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


def score_lists(pairs: Column, factory: Callable[[], PairScorer], name: str) -> Column:
    """struct<scores array<NLI>, error string> of a column array<struct<context, claim>>, the pairs of many rows scored together."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            try:
                model = _once(name, factory)
                found = _in_lists(rows, lambda ps: [dict(zip(("entailment", "contradiction", "neutral"), x)) for x in model([(p["context"], p["claim"]) for p in ps])])
                yield pd.DataFrame({"scores": found, "error": [None] * len(rows)})
            except Exception as e:  # whatever a model raises is the guard's to report
                yield pd.DataFrame({"scores": [[] for _ in rows], "error": [f"{type(e).__name__}: {e}"] * len(rows)})

    return F.pandas_udf(run, f"scores array<{NLI}>, error string")(pairs)


def relevance(query: Column, chunks: Column, factory: Callable[[], Relevance], name: str) -> Column:
    """struct<scores array<double>, error string>: each chunk's relevance to the query, the model's outputs through the logistic function."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for queries, lists in batches:
            try:
                model = _once(name, factory)
                pairs = pd.Series([[(q or "", c) for c in (cs if cs is not None else [])] for q, cs in zip(queries, lists)])
                found = _in_lists(pairs, lambda ps: [1 / (1 + math.exp(-max(-700.0, x))) for x in model(ps)] if ps else [])
                yield pd.DataFrame({"scores": found, "error": [None] * len(pairs)})
            except Exception as e:  # as above
                yield pd.DataFrame({"scores": [[] for _ in queries], "error": [f"{type(e).__name__}: {e}"] * len(queries)})

    return F.pandas_udf(run, "scores array<double>, error string")(query, chunks)


def embed(text: Column, factory: Callable[[], Embedder], name: str) -> Column:
    """array<float>: the embedding of each text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _once(name, factory)
        for texts in batches:
            yield pd.Series(model(list(texts.fillna(""))))

    return F.pandas_udf(run, "array<float>")(text)


def cosines(texts: Column, others: Column, factory: Callable[[], Embedder], name: str) -> Column:
    """array<array<double>>: for each of a row's texts its cosine with each of the row's others, by embeddings; 0.0 with an empty text."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _once(name, factory)

        def units(lists: pd.Series) -> list[np.ndarray]:
            def one(flat: list) -> list:
                if not flat:
                    return []
                v = np.array(model([x or "" for x in flat]), float)
                return list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) * np.array([[bool(x)] for x in flat]))

            return _in_lists(lists, one)

        for a, b in batches:
            yield pd.Series([[[float(x @ y) for y in ys] for x in xs] for xs, ys in zip(units(a), units(b))])

    return F.pandas_udf(run, "array<array<double>>")(texts, others)


def hashing_embedder(size: int = 64) -> Embedder:
    """A deterministic embedder without weights: signed hashes of words, to unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % size] += 1.0 if h >> 63 else -1.0
            n = max(math.sqrt(sum(x * x for x in v)), 1e-12)
            out.append([x / n for x in v])
        return out

    return run


def label_places(model_name: str = "", id2label: dict[int, str] | None = None) -> tuple[int, int, int]:
    """Where entailment, contradiction and neutral are among a model's outputs: by its own labels, else by its name, else the usual order."""
    names = {v.lower(): int(k) for k, v in (id2label or {}).items()}
    if names.keys() >= {"entailment", "contradiction", "neutral"}:
        return names["entailment"], names["contradiction"], names["neutral"]
    return next((places for key, places in LABEL_PLACES.items() if key in model_name.lower()), DEFAULT_PLACES)


def _probabilities(logits: np.ndarray, places: tuple[int, int, int]) -> list[tuple[float, float, float]]:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return [tuple(float(row[k]) for k in places) for row in p]


def sub_batched(scorer: PairScorer, size: int = SUB_BATCH) -> PairScorer:
    """A scorer that sees at most `size` pairs at once."""
    return lambda pairs: [x for at in range(0, len(pairs), size) for x in scorer(pairs[at : at + size])]


def onnx_pair_scorer(path: str, tokenizer: str, max_length: int = 256, session=None) -> PairScorer:
    """A scorer from an ONNX file and a tokenizers file; labels come from the model's metadata. session: one that is open already."""
    from tokenizers import Tokenizer

    if session is None:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    cutter = Tokenizer.from_file(tokenizer)
    cutter.enable_truncation(max_length=max_length)
    cutter.enable_padding()
    labels = session.get_modelmeta().custom_metadata_map.get("id2label", '{"0": "contradiction", "1": "neutral", "2": "entailment"}')
    places = label_places(path, {int(k): v for k, v in json.loads(labels).items()})
    wanted = {x.name for x in session.get_inputs()}

    def run(pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
        if not pairs:
            return []
        coded = cutter.encode_batch(pairs)
        given = {"input_ids": [e.ids for e in coded], "attention_mask": [e.attention_mask for e in coded], "token_type_ids": [e.type_ids for e in coded]}
        logits = session.run(None, {k: np.array(v, np.int64) for k, v in given.items() if k in wanted})[0]
        return _probabilities(np.asarray(logits), places)

    return sub_batched(run)


def cross_encoder_scorer(model_name: str, max_length: int = 128) -> PairScorer:
    """A scorer from a cross-encoder of sentence_transformers, which must be installed."""
    from sentence_transformers import CrossEncoder

    model = CrossEncoder(model_name, max_length=max_length)
    places = label_places(model_name, getattr(model.model.config, "id2label", None))
    return sub_batched(lambda pairs: _probabilities(np.asarray(model.predict(pairs, show_progress_bar=False)), places) if pairs else [])


def transformers_scorer(model_name: str, max_length: int = 256) -> PairScorer:
    """A scorer from a text classifier of transformers, which must be installed with torch."""
    from transformers import pipeline

    model = pipeline("text-classification", model=model_name, top_k=None, truncation=True, max_length=max_length)

    def run(pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
        found = ({x["label"].lower(): x["score"] for x in row} for row in model([{"text": a, "text_pair": b} for a, b in pairs]))
        return [tuple(row.get(k, 0.0) for k in ("entailment", "contradiction", "neutral")) for row in found]

    return sub_batched(run)


def pair_scorer(preferred: str = "auto", model_name: str = "", onnx_path: str | None = None, tokenizer: str | None = None) -> Callable[[], PairScorer] | None:
    """The factory of the best scorer there is: an ONNX file, a cross-encoder, a text classifier; None stands for the lexical comparison.

    One that is asked for by name and isn't there is an error, but for the text classifier, which gives way.
    """
    from importlib.util import find_spec

    if preferred == "onnx" and not onnx_path:
        raise ValueError("an ONNX scorer needs the file's path")
    if onnx_path and preferred in ("auto", "onnx"):
        return partial(onnx_pair_scorer, onnx_path, tokenizer)
    if preferred in ("auto", "cross_encoder"):
        if find_spec("sentence_transformers"):
            return partial(cross_encoder_scorer, model_name)
        if preferred == "cross_encoder":
            raise ImportError("sentence_transformers is not installed")
    if preferred in ("auto", "transformers") and find_spec("transformers") and find_spec("torch"):
        return partial(transformers_scorer, model_name)
    return None


def replies(prompt: Column, factory: Callable[[], Judge], name: str, seconds: float = JUDGE_SECONDS, concurrency: int = CONCURRENCY) -> Column:
    """A judge's reply to each prompt, some at once; null for null prompts and where the judge fails or takes too long."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            wanted = [p if isinstance(p, str) else None for p in prompts]
            try:
                judge = _once(name, factory) if any(p is not None for p in wanted) else None
            except Exception:  # a judge that can't be made is one that fails
                judge = None
            yield pd.Series(in_time(judge, wanted, seconds, concurrency) if judge else [None] * len(wanted), dtype=object)

    return F.pandas_udf(run, "string")(prompt)


def ask(prompts: DataFrame, factory: Callable[[], Judge], name: str) -> DataFrame:
    """prompts (trace_id, prompt) with reply."""
    return prompts.select("trace_id", "prompt").withColumn("reply", replies(F.col("prompt"), factory, name))


def judge_prompt(messages: Column, completion: Column) -> Column:
    history = F.array_join(F.transform(messages, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")
    a, b, c = JUDGE_PROMPT.split("{}")
    return F.concat(F.lit(a), history, F.lit(b), completion, F.lit(c))


def swap_prompt(text: Column) -> Column:
    """Null where swapping identities changes nothing."""
    a, b, c = SWAP_PROMPT.split("{}")
    return F.concat(F.lit(a), text, F.lit(b), T.swap_identities(text), F.lit(c))


def verdict(reply: Column, key: str) -> Column:
    """struct<bad, reason> of a judge's reply; not bad if it can't be read."""
    def of(parsed: Column) -> Column:
        return F.struct(
            F.coalesce(F.try_variant_get(parsed, f"$.{key}", "boolean"), F.lit(False)).alias("bad"),
            F.coalesce(F.try_variant_get(parsed, "$.reason", "string"), F.lit("No reason provided")).alias("reason"),
        )

    return T.let(T.judge_json(reply), of)


def judged(detector: str, found: Column, action: Column, fallback: Column | None = None) -> Column:
    """A detector's result from a column of verdict."""
    bad = found["bad"]
    return result(
        detector, "POST", ~bad, None, F.when(bad, F.upper(action)).otherwise("ALLOW"),
        F.when(bad, F.lit(VIOLATIONS[detector])), F.when(bad, found["reason"]), None if fallback is None else F.when(bad, fallback),
    )


def bias_axes(embedder: Embedder) -> dict[str, list[float]]:
    """For each pair of anchor groups the unit vector from the second group's mean to the first's; axes without length are left out."""
    out = {}
    for name, groups in ANCHORS.items():
        means = []
        for words in groups:
            v = np.array(embedder(words), float)
            means.append((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).mean(axis=0))
        axis = means[0] - means[1]
        if np.linalg.norm(axis) > 0:
            out[name] = (axis / np.linalg.norm(axis)).tolist()
    return out


def projection(vector: Column, axes: dict[str, list[float]]) -> Column:
    """struct<score, axis>: the largest absolute projection of an embedding on the axes, the first of equals; 0.0 for none."""
    if not axes:
        return F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("axis"))

    def of(v: Column) -> Column:
        parts = [
            F.struct(F.abs(S.dot(v, F.array(*map(F.lit, axis)))).alias("score"), F.lit(-k).alias("back"), F.lit(name).alias("axis"))
            for k, (name, axis) in enumerate(axes.items())
        ]
        return T.let(F.array_max(F.array(*parts)), lambda t: F.struct(t["score"].alias("score"), t["axis"].alias("axis")))

    return T.let(S.normalized(vector), of)


def http_client(url: str, headers: dict[str, str] | None = None, seconds: float = UPSTREAM_SECONDS) -> Client:
    """A client that posts JSON; a reply with an error status is a reply."""

    def post(payload: str) -> tuple[int, str]:
        request = urllib.request.Request(url, payload.encode(), {"Content-Type": "application/json", **(headers or {})}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=seconds) as reply:
                return reply.status, reply.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace")

    return post


def send(
    payload: Column, factory: Callable[[], Client], name: str, seconds: float = UPSTREAM_SECONDS, concurrency: int = CONCURRENCY, attempts: int = 2
) -> Column:
    """struct<status, body, latency_ms>: replies to payloads, some at once in each task; null for null payloads.

    A call that raises, takes too long or gets a status from 500 on is made again, `attempts` times in all; status 0 if none is answered.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for payloads in batches:
            wanted = [p if isinstance(p, str) else None for p in payloads]
            client = _once(name, factory) if any(p is not None for p in wanted) else None

            def timed(p: str) -> tuple[int, str, float]:
                began = time.monotonic()
                return *client(p), (time.monotonic() - began) * 1000

            found: list = [None] * len(wanted)
            for _ in range(attempts):
                left = [p if found[k] is None or found[k][0] >= 500 else None for k, p in enumerate(wanted)]
                if not any(p is not None for p in left):
                    break
                found = [new or old for new, old in zip(in_time(timed, left, seconds, concurrency), found)]
            rows = [(None, None, None) if p is None else (x or (0, None, seconds * 1000)) for p, x in zip(wanted, found)]
            yield pd.DataFrame(rows, columns=["status", "body", "latency_ms"]).astype({"status": "Int64"})

    return F.pandas_udf(run, "status int, body string, latency_ms double")(payload)
