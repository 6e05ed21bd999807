"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

The vocabulary file gives the merges in rank order and the added special strings; the pattern is that of
byte-level pre-tokenizers, and files with another pre-tokenizer, a normalizer, or special strings that look at
their surroundings are refused. A text is cut at the special strings (one token each), then by the pattern.
A piece starts as one symbol a byte, in a doubly linked list; the lowest-ranked adjacent pair
(leftmost of equals) is popped again and again from a heap and merged. The piece's count is its
bytes less the merges done. Each distinct part of a text is counted once a segment, and counts of parts
are kept in a dictionary of bounded size.

Nulls: a null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; an
empty table gives an empty result. A text of any length is worked on in segments of bounded size. Other columns pass
through; columns called n_bytes, n_tokens or over_limit are replaced.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weir.llm.chunks import Memo, check_vocabulary, segments
from weir.llm.shared import bounded_batches, settle
from weir.session import ship

#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts whose counts are kept.
KEPT = 600_000
_COUNTERS: dict[str, "Counter"] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Counter:
    """Counts the tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        import regex

        self.strings = check_vocabulary(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols: dict[str, int] = {c: b for b, c in enumerate(byte_letters())}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            made = symbols.setdefault(a + b, len(symbols))
            self.rank.setdefault((symbols[a], symbols[b]), (k, made))
        special = sorted(self.strings, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.parts = Memo(lambda part: self.whole(part.decode()), KEPT)

    def piece(self, piece: str) -> int:
        """Tokens of one pre-token: its bytes less the merges."""
        sym = [*piece.encode("utf-8", "surrogatepass")]
        n, rank = len(sym), self.rank
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(*got, i, i + 1) for i in range(n - 1) if (got := rank.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, made, i, j = heapq.heappop(heap)
            if after[i] != j or j >= n or sym[j] < 0 or sym[i] < 0:
                continue
            got = rank.get((sym[i], sym[j]))
            if got is None or got[1] != made:
                continue
            sym[i], sym[j], k = made, -1, after[j]
            after[i] = k
            merges += 1
            if k < n:
                before[k] = i
                if got := rank.get((made, sym[k])):
                    heapq.heappush(heap, (*got, i, k))
            if (h := before[i]) >= 0 and (got := rank.get((sym[h], made))):
                heapq.heappush(heap, (*got, h, i))
        return n - merges

    def plain(self, text: str) -> int:
        return sum(map(self.piece, self.pattern.findall(text)))

    def whole(self, text: str) -> int:
        """Tokens of a text, without cutting it into parts first."""
        if self.special is None or not any(x in text for x in self.strings):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(column), np.int64)
        for part in segments(column, self.strings):
            own = np.fromiter(map(self.parts.__getitem__, part.words), np.int64, len(part.words))
            out += np.bincount(part.text, own[part.place], len(out)).astype(np.int64)
        return out


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)

    def count(batches):
        settle("token counts", _COUNTERS.clear)
        own = counter(tokenizer)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text))
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            tokens = own.counts(texts)
            kept = [(f, c) for f, c in zip(batch.schema, batch.columns) if f.name != text]
            yield pa.RecordBatch.from_arrays(
                [*(c for _, c in kept), sizes, pa.array(tokens), pa.array(tokens > limit)],
                [*(f.name for f, _ in kept), "n_bytes", "n_tokens", "over_limit"],
            )

    rest = docs.drop("n_bytes", "n_tokens", "over_limit")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != text)
    return rest.mapInArrow(count, f"{schema}{', ' if schema else ''}n_bytes long, n_tokens long, over_limit boolean")
