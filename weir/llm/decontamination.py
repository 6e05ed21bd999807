"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: lower case, runs of white space as one space. An item of m
characters may differ from a passage by k = floor(m * ERRORS) edits (insertions, deletions,
substitutions). It is split into k + 1 pieces; a passage within k edits holds at least one piece
unchanged and at most k places from where the item has it. All pieces are found in one scan of the text by an
automaton. Around each hit the stretch that the item may cover, k characters wider each way, is
verified by Myers' bit-parallel edit distance, free at both ends of the stretch. Stretches of one
item that meet are verified together.

The items are taken in blocks of at most BLOCK_CHARS characters, each block one pass over the
texts, so what is sent to the tasks is bounded whatever the benchmark's size. Items below MIN_CHARS normalised
characters are matched within the same budget, but only where the passage begins and ends at the edge of a word; in
scripts that are written without spaces every place is an edge. An empty item has no matches.

Result: a row for each document and item found: doc_id, item_id, distance (the least edits), and
match_end (where in the normalised text the first best match ends, exclusive).

Nulls: a null text or item counts as empty and has no matches; rows with null doc_id or item_id are
reported with nulls. Repeated rows give repeated results; so do items with equal texts. Empty tables
give an empty result. A text of any length is searched whole, as one row. Other columns are ignored; without_leaks judges
each row by its own text, whatever its doc_id, and passes all columns on.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weir.llm.shared import bounded_batches, settle, small
from weir.session import ship

ERRORS, MIN_CHARS, BLOCK_CHARS = 0.05, 40, 4_000_000

#: Letters of words that spaces set apart: not those of Thai, Lao, Burmese, Khmer, kana and Han.
_SPACED = re.compile(r"[^\W\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: float) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of nearly equal length."""
    n = int(len(item) * errors) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def letters(item: str) -> dict[str, int]:
    """For each character, the bits of the places where the item has it."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(bits: dict[str, int], m: int, stretch: str) -> tuple[int, int]:
    """Least edits between the item and any part of the stretch, and the first place where such a part ends."""
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = every, 0, m, m, 0
    for j, c in enumerate(stretch):
        eq = bits.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        more = down | (every & ~(xh | up))
        less = up & xh
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more = (more << 1) & every
        less = (less << 1) & every
        up = less | (every & ~(xv | more))
        down = more & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def is_edge(text: str, at: int) -> bool:
    """Whether no word goes on across this place."""
    return not (0 < at < len(text) and _SPACED.match(text[at - 1]) and _SPACED.match(text[at]))


def edits(a: str, b: str) -> int:
    """Least edits between two short texts."""
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[str], errors: float = ERRORS, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items = [normal(x) for x in items]
        self.budget = [int(len(x) * errors) for x in self.items]
        self.whole = [len(x) < min_chars for x in self.items]
        self.bits: list[dict[str, int] | None] = [None] * len(items)
        held: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            if item:
                for at, piece in pieces(item, errors):
                    held.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in held.items():
            self.automaton.add_word(piece, (len(piece), places))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, distance, end) of each item that the text holds within its budget; text is normalised."""
        if self.empty or not text:
            return
        spans: dict[int, list[list[int]]] = {}
        exact: dict[int, tuple[int, int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            start = last - size + 1
            for k, at in places:
                b = self.budget[k]
                if self.whole[k] and not b:  # the piece is the item
                    if k not in exact and is_edge(text, start) and is_edge(text, last + 1):
                        exact[k] = (0, last + 1)
                    continue
                a, e = max(0, start - at - b), min(len(text), start - at + len(self.items[k]) + b)
                own = spans.setdefault(k, [])
                if own and a <= own[-1][1]:
                    own[-1][0] = min(own[-1][0], a)
                    own[-1][1] = max(own[-1][1], e)
                else:
                    own.append([a, e])
        for k, own in sorted(spans.items()):
            item, found = self.items[k], None
            for a, e in own:
                if self.whole[k]:
                    got = self.at_edges(k, text, a, e)
                    if got and (found is None or got < found):
                        found = got
                    continue
                stretch = text[a:e]
                at = stretch.find(item)
                if at >= 0:
                    got = (0, a + at + len(item))
                else:
                    if self.bits[k] is None:
                        self.bits[k] = letters(item)
                    d, end = least_distance(self.bits[k], len(item), stretch)
                    got = (d, a + end)
                if got[0] <= self.budget[k] and (found is None or got < found):
                    found = got
            if found:
                exact[k] = found
        for k in sorted(exact):
            yield k, *exact[k]

    def at_edges(self, k: int, text: str, a: int, e: int) -> tuple[int, int] | None:
        """The best (distance, end) within the item's budget of a part of text[a:e] that begins and ends at an edge."""
        item, b = self.items[k], self.budget[k]
        found = None
        for i in range(a, e):
            if is_edge(text, i):
                for j in range(max(i + 1, i + len(item) - b), min(e, i + len(item) + b) + 1):
                    if is_edge(text, j):
                        got = (edits(item, text[i:j]), j)
                        if got[0] <= b and (found is None or got < found):
                            found = got
        return found


_MATCHERS: dict[str, Matcher] = {}


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The items, some at a time; only one block is on the driver at once."""
    held, size = [], 0
    for r in benchmark.toLocalIterator():
        held.append((r[0], r[1] or ""))
        size += len(r[1] or "")
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _finder(spark, block: list[tuple], errors: float, min_chars: int):
    """A function for tasks that gives the matcher of a block of items and their ids."""
    sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def matcher() -> tuple[Matcher, list]:
        settle("benchmark", _MATCHERS.clear)
        if name not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[name] = Matcher([t for _, t in sent.value], errors, min_chars)
        return _MATCHERS[name], [i for i, _ in sent.value]

    return matcher


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))


def matches(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs (doc_id, text) against benchmark (item_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    bounded_batches(spark)
    own = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, match_end long"
    out = None
    for block in _blocks(_items(benchmark), block_chars):

        def run(batches, finder=_finder(spark, block, errors, min_chars)):
            matcher, ids = finder()
            for batch in small(batches, 1):
                rows = [
                    (doc, ids[k], d, end)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    if text
                    for k, d, end in matcher.find(normal(text))
                ]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance", "match_end"])

        found = own.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of docs whose text holds no item, whatever their doc_id; each block of items passes on what it leaves."""
    spark = docs.sparkSession
    ship(spark)
    bounded_batches(spark)
    schema = docs.schema
    for block in _blocks(_items(benchmark), block_chars):

        def run(batches, finder=_finder(spark, block, errors, min_chars)):
            matcher, _ = finder()
            for batch in small(batches, "text"):
                texts = batch.column("text").to_pylist()
                clean = [not x or next(matcher.find(normal(x)), None) is None for x in texts]
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
