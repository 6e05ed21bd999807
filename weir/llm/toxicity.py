"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams (N_FROM to N_TO, boundaries marked, and the whole word) of
the distinct lower-cased words of a text; a feature's value is the number of distinct words that
hold it, divided by the square root of all of them. From the labelled sample come the log-count
ratios r = log(p / |p|) - log(q / |q|), p and q the smoothed counts among toxic and other texts;
features in fewer than MIN_TEXTS texts get 0. A logistic regression on the features scaled by r is
fitted by coordinate-wise adaptive gradient steps with an L2 penalty, each class weighted by its
share of all labels. A text's score is the logistic of its weighted sum. A word's part of the sum
depends on the word alone, so it is kept in a table of bounded size.

Sample: at most SAMPLE[c] labelled rows of class c, those least by a hash of doc_id, and at most
SAMPLE_CHARS[c] characters: texts up to a tenth of that in order of the hash, then longer ones, shortest first, as
far as they fit whole, so a long text never keeps a shorter one out. If not even the first fits, its first
SAMPLE_CHARS[c] characters are taken. Only their feature numbers come to the driver. Every document is scored in full.

Nulls: a null or empty text has no features and scores by the intercept alone. Rows of labels
with null doc_id or label, or without a document, teach nothing; where labels conflict, a document
is toxic if any says so. Without both classes the score is 0.0; it is an error if a class has more labels than are
sampled, and none of those sampled has a document. An empty table gives an empty
result; a text of any length is scored whole; other columns pass through; score() replaces score and predicted, without_toxic()
leaves all columns as they are.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weir.llm.shared import bounded_batches, settle, small
from weir.session import ship

N_FROM, N_TO, BITS, MIN_TEXTS = 3, 5, 18, 5
SAMPLE, SAMPLE_CHARS = (4000, 2000), (4_000_000, 2_000_000)
THRESHOLD, SCALE = 0.3, 30.0
_WORD = re.compile(r"\w+")
_FEATURES: dict[str, np.ndarray] = {}


def word_features(word: str) -> np.ndarray:
    """Feature numbers of a word."""
    import xxhash

    s = f"\x02{word}\x03"
    grams = {s[i : i + n] for n in range(N_FROM, min(N_TO, len(s)) + 1) for i in range(len(s) - n + 1)} | {s}
    return np.array([xxhash.xxh32_intdigest(g) >> (32 - BITS) for g in sorted(grams)], np.int32)


def text_features(text: str) -> np.ndarray:
    """Feature numbers of a text's distinct words, repeats kept."""
    kept, parts = _FEATURES, []
    for w in {*_WORD.findall(text.lower())}:
        got = kept.get(w)
        if got is None:
            got = word_features(w)
            if len(w) <= 32:
                if len(kept) >= 50_000:
                    kept.clear()
                kept[w] = got
        parts.append(got)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


class Model:
    """weights float32[2 ** BITS] and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept
        self.words: dict[str, tuple[float, int]] = {}

    @classmethod
    def fit(
        cls, rows: list[np.ndarray], labels: np.ndarray, share: float | None = None, epochs: int = 60, l2: float = 1e-3, rate: float = 0.02
    ) -> "Model":
        """Fit to texts' feature numbers and 0/1 labels; share is the share of label 1 to assume."""
        size = 1 << BITS
        y = np.asarray(labels, np.float32)
        if not len(rows) or y.min() == y.max():
            return cls(np.zeros(size, np.float32), -np.inf)
        share = float(y.mean()) if share is None else share
        counts = np.array([len(r) for r in rows])
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), counts)
        texts = np.zeros(size, np.int32)
        for r in rows:
            texts[np.unique(r)] += 1
        p, q = (np.bincount(np.concatenate([x for x, c in zip(rows, y) if c == k]), minlength=size) + 1.0 for k in (1, 0))
        r = np.log(p / p.sum()) - np.log(q / q.sum())
        r[texts < MIN_TEXTS] = 0
        value = r.astype(np.float32)[flat]
        value *= (SCALE / np.sqrt(np.maximum(counts, 1))).astype(np.float32)[owner]
        weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum())
        ends = np.cumsum(counts)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], 1_000_000), side="left").tolist() + [len(rows)])
        slices = [(a, b, slice(ends[a] - counts[a], ends[b - 1])) for a, b in zip(cuts[:-1], cuts[1:])]  # some texts at a time
        w, b = np.zeros(size), float(np.log(share / (1 - share)))
        g2, gb2 = np.full(size, 1e-8), 1e-8
        for _ in range(epochs):
            g, gb = l2 * w, 0.0
            for start, end, at in slices:
                z = np.bincount(owner[at] - start, value[at] * w[flat[at]], minlength=end - start) + b
                err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[start:end]) * weight[start:end]
                g += np.bincount(flat[at], value[at] * err[owner[at] - start], minlength=size)
                gb += err.sum()
            g2 += g * g
            gb2 += gb * gb
            w -= rate * g / np.sqrt(g2)
            b -= rate * gb / np.sqrt(gb2)
        return cls((w * r).astype(np.float32), float(b))

    def word(self, word: str) -> tuple[float, int]:
        f = word_features(word)
        return float(self.weights[f].sum(dtype=np.float64)), len(f)

    def score(self, text: str) -> float:
        if self.intercept == -np.inf:
            return 0.0
        words, total, n = self.words, [], 0
        for w in {*_WORD.findall(text.lower())}:
            got = words.get(w)
            if got is None:
                got = self.word(w)
                if len(w) <= 32:
                    if len(words) >= 200_000:
                        words.clear()
                    words[w] = got
            total.append(got[0])
            n += got[1]
        z = SCALE * math.fsum(total) / math.sqrt(max(n, 1)) + self.intercept
        return 1 / (1 + math.exp(-min(35.0, max(-35.0, z))))


def train(docs: DataFrame, labels: DataFrame, sample: tuple = SAMPLE, chars: tuple = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of docs (doc_id, text) joined with labels (doc_id, toxic)."""
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    drawn = F.xxhash64("doc_id")
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    share = n.get(1, 0) / max(1, sum(n.values()))
    # The sample is chosen among labels before any text moves: the least hashes of each class.
    few = marks.where("toxic in (0, 1)").select("doc_id", "toxic", drawn.alias("h"))
    of = [few.where(f"toxic = {c}").orderBy("h", "doc_id").limit(sample[c]) for c in (0, 1)]
    joined = own.join(F.broadcast(of[0].unionAll(of[1])), "doc_id")
    most, n_chars = F.when(F.col("toxic") == 1, chars[1]).otherwise(chars[0]), F.length("text")
    order = Window.partitionBy("toxic").orderBy(F.greatest(n_chars, most / 10), "h", "doc_id", "text")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    sized = joined.withColumns({"size": F.sum(n_chars).over(running), "place": F.row_number().over(order)})
    within = sized.where((F.col("size") <= most) | (F.col("place") == 1)).withColumn("text", F.substring("text", F.lit(1), most))

    def features(batches):
        settle("toxicity features", _FEATURES.clear)
        for batch in small(batches, 1):
            rows = [text_features(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "features"])

    found = within.select(F.col("toxic").cast("int"), "text").mapInArrow(features, "toxic int, features array<int>")
    got = found.toArrow()
    rows = [np.asarray(x.values, np.int32) for x in got.column("features")]
    for c in {0, 1} - {*got.column("toxic").to_pylist()}:
        if n.get(c, 0) > sample[c] > 0:
            raise ValueError(f"{n[c]} labels of class {c}, but none of the {sample[c]} sampled has a document")
    return Model.fit(rows, got.column("toxic").to_numpy(), share)


_LOADED: dict[str, Model] = {}


def loaded(name: str, sent) -> Model:
    """The broadcast model, one for each worker process, so that its words outlive a task."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Model(*sent.value)
    return _LOADED[name]


def _scorer(spark, model: Model, text: str):
    """A function for tasks: batches of rows with the score of each row."""
    ship(spark)
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.weights, model.intercept))  # 2 ** BITS floats, whatever the corpus
    name = uuid.uuid4().hex

    def scores(batches):
        settle("toxicity", _LOADED.clear)
        own = loaded(name, sent)
        for batch in small(batches, text):
            yield batch, np.array([own.score(x or "") for x in batch.column(batch.schema.names.index(text)).to_pylist()], np.float64)

    return scores


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with score double and predicted int."""
    docs, scores = docs.drop("score", "predicted"), _scorer(docs.sparkSession, model, text)

    def run(batches):
        for batch, found in scores(batches):
            more = [pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold."""
    scores = _scorer(docs.sparkSession, model, text)

    def run(batches):
        for batch, found in scores(batches):
            yield batch.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> "F.Column":
    """Rows whose labels are kept for measuring."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
