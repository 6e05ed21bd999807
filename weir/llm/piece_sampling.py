"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A text becomes a leading space plus the text, spaces written as the space mark. All ways to
spell it with vocabulary pieces form a lattice; a segmentation has probability proportional
to the product of its pieces' weights (1 / (2 + rank)) ** ALPHA, the rank being the
vocabulary's merge score. Forward filtering sums the weights of all ways to reach each
position; backward sampling then draws pieces from the end by those sums. The draws come from
a counter-based generator seeded by the row's key, so a key and text always give the same
pieces on any partitioning. Characters without a piece, and the space mark itself, are spelt
as byte pieces; decoding turns pieces back into bytes and drops the leading space, so it
returns exactly the text.

No piece holds a space mark after another character, and few or none hold a letter beside a
punctuation mark, so the lattice falls apart between two characters that no piece holds side by
side: the chunks between such places are drawn independently, which is the same distribution,
and their filtered lattices are kept in a table of bounded size. A chunk's draws come from the seed and the chunk's number in its text.

Nulls: a null text counts as empty and has no pieces; a null key seeds as the empty string.
Repeated rows get equal pieces. An empty table gives an empty result. A text of any length is worked on in segments of
bounded size. Other columns pass through; columns called ids or decoded are replaced.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weir.llm.chunks import segments
from weir.llm.shared import bounded_batches, settle, small
from weir.session import ship

ALPHA = 1.0
#: Bytes handled at once, of chunks whose lattices are built at once, chunks whose lattices are kept, and the longest one kept.
SEGMENT, BUILD_BYTES, KEPT, LONGEST = 500_000, 60_000, 120_000, 48
MARK = "▁"
_VOCABULARIES: dict[str, "Vocabulary"] = {}
_LATTICES: dict[tuple[str, float], "Lattices"] = {}


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = [0] * 256
        self.bytes_of: list[bytes] = [b""] * n
        self.weight: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                self.weight[piece] = (i, -math.log(2 - sp.get_score(i)))
        if any(MARK in p.lstrip(MARK) for p in self.weight):
            raise ValueError("a piece holds a space mark after another character")
        self.spelt = pa.array(self.bytes_of, pa.binary())
        self.between = self._between()

    def _between(self) -> np.ndarray:
        """bool[last byte, first byte]: whether a text may be cut between characters with these bytes.

        It may between characters that no piece holds side by side, if the second is a space or either is ASCII and no letter or digit.
        """
        out, plain = np.zeros((256, 256), bool), [c for c in range(128) if not chr(c).isalnum()]
        out[plain, :] = True
        out[:, plain] = True
        for p in self.weight:
            spelt = [c.encode() if c != MARK else b" " for c in p]
            for x, y in zip(spelt, spelt[1:]):
                out[x[-1], y[0]] = False
        out[:, 0x80:0xC0] = False  # within a character
        out[:, 32] = True  # no piece holds a mark after another character
        out[32, 32] = False
        return out

    def cut(self, x: np.ndarray, opens: np.ndarray, spaces: None = None) -> np.ndarray:
        return np.append(False, self.between[x[:-1], x[1:]])

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts whose ids lie between the offsets."""
        spelt = self.spelt.take(pa.array(ids))
        at = np.frombuffer(spelt.buffers()[1], np.int32)[: len(ids) + 1][offsets].tolist()
        data = (spelt.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        return pa.array([data[a + 1 : b].decode("utf-8", "replace") for a, b in zip(at, at[1:])], pa.string())


class Trie:
    """Pieces by exact steps from state to state, looked up for many places at once."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        letters = sorted({c for p in pieces for c in p})
        self.letter = np.full(0x110000, -1, np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.width, child, self.found = len(letters) + 1, {}, [-1]
        for p, (i, _) in pieces.items():
            at = 0
            for c in p:
                step = at * self.width + int(self.letter[ord(c)])
                if step not in child:
                    child[step] = len(self.found)
                    self.found.append(-1)
                at = child[step]
            self.found[at] = i
        self.found = np.array(self.found, np.int32)
        self.steps = np.array(sorted(child), np.int64)
        self.target = np.array([child[k] for k in self.steps.tolist()], np.int64)

    def arcs(self, letters: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, last, piece) of every piece in the letters that does not pass the end of its chunk."""
        start, state, out = np.arange(len(letters)), np.zeros(len(letters), np.int64), []
        at = start
        while len(start):
            step = np.where(letters[at] >= 0, state * self.width + letters[at], -1)
            k = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            on = self.steps[k] == step
            start, at, state = start[on], at[on], self.target[k[on]]
            hit = self.found[state] >= 0
            out.append((start[hit], at[hit], self.found[state[hit]]))
            more = at + 1 < end[start]
            start, at, state = start[more], at[more] + 1, state[more]
        return tuple(np.concatenate(x) for x in zip(*out))


class Lattices:
    """Filtered lattices of chunks: nodes, and for each node its arcs with cumulative probabilities."""

    def __init__(self, path: str, alpha: float):
        self.vocabulary = Vocabulary(path)
        self.trie = Trie(self.vocabulary.weight)
        self.weight = np.zeros(len(self.vocabulary.bytes_of))
        for i, w in self.vocabulary.weight.values():
            self.weight[i] = alpha * w
        self.weight[self.vocabulary.byte] = -20.0
        self.byte = np.array(self.vocabulary.byte, np.int32)
        self.clear()

    def clear(self) -> None:
        self.end: dict[bytes, int] = {}
        self.key, self.piece, self.source = array("f"), array("i"), array("i")
        self.node_arc, self.nodes = array("i", [0, 0]), 1  # node 0 is every chunk's start

    def build(self, chunks: list[bytes]) -> np.ndarray:
        """Filter the lattices of chunks, all at once; the end node of each."""
        # A mark in the text has no piece of its own. So it is spelt in bytes, as other characters without one.
        joined = b"".join(chunks)
        points = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4").astype(np.int64)
        letters = self.trie.letter[points]
        letters[points == ord(MARK)] = -1
        letters[points == 32] = self.trie.letter[ord(MARK)]
        alone = np.zeros(len(points), bool)
        # Bytes of a character without a piece become letters of their own, each with one arc.
        known = (letters >= 0) & (self.trie.found[self._first(letters)] >= 0)
        begun = np.append(0, np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80))  # characters begun before each byte
        sizes = np.diff(begun[np.cumsum([0, *map(len, chunks)])])
        owner = np.repeat(np.arange(len(chunks)), sizes)
        if not known.all():
            raw = [chr(p).encode() if not k else b"?" for p, k in zip(points.tolist(), known.tolist())]
            times = np.array([len(r) for r in raw])
            alone = np.repeat(~known, times)
            byte = np.frombuffer(b"".join(raw), np.uint8)
            letters, owner = np.repeat(letters, times), np.repeat(owner, times)
            sizes = np.bincount(owner, minlength=len(chunks))
            letters[alone] = -1
        ends = np.cumsum(sizes)
        start, last, piece = self.trie.arcs(letters, ends[owner])
        if alone.any():
            own = np.flatnonzero(alone)
            start, last = np.concatenate([start, own]), np.concatenate([last, own])
            piece = np.concatenate([piece, self.byte[byte[own]]])
        first = (ends - sizes)[owner]
        place = np.arange(len(owner)) - first
        order = np.lexsort((start, last, place[last]))
        start, last, piece = start[order], last[order], piece[order]
        opens = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])  # the first arc of each node, in order of place
        node_of = np.empty(len(owner), np.int64)
        node_of[last[opens]] = self.nodes + np.arange(len(opens))
        begins = start == first[start]
        total, weight, chance = np.empty(len(owner)), self.weight[piece], np.empty(len(start))
        levels = np.searchsorted(place[last], np.arange(int(sizes.max()) + 1))
        for a, b in zip(levels[:-1], levels[1:]):
            lo, hi = np.searchsorted(opens, (a, b))
            cuts = opens[lo:hi] - a
            v = np.where(begins[a:b], 0.0, total[start[a:b] - 1]) + weight[a:b]
            many = np.diff(np.r_[cuts, b - a])
            top = np.maximum.reduceat(v, cuts)
            whole = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many)), cuts))
            total[last[a + cuts]] = whole
            chance[a:b] = np.exp(v - np.repeat(whole, many))
        many = np.diff(np.r_[opens, len(start)])
        run = np.cumsum(chance)
        run -= np.repeat(run[opens] - chance[opens], many)
        close = opens + many - 1
        run[close] = 2.0  # beyond any draw
        self.key.frombytes(run.astype(np.float32).tobytes())
        self.piece.frombytes(piece.astype(np.int32).tobytes())
        self.source.frombytes(np.where(begins, 0, node_of[start - 1]).astype(np.int32).tobytes())
        self.node_arc.frombytes((self.node_arc[-1] + np.cumsum(many)).astype(np.int32).tobytes())
        self.nodes += len(opens)
        return node_of[ends - 1]

    def _first(self, letters: np.ndarray) -> np.ndarray:
        """The trie's state after one letter, 0 where there is none."""
        k = np.minimum(np.searchsorted(self.trie.steps, letters), len(self.trie.steps) - 1)
        return np.where(self.trie.steps[k] == letters, self.trie.target[k], 0)

    def ends(self, chunks: list[bytes]) -> np.ndarray:
        """The end node of each chunk; chunks are distinct."""
        if len(self.end) + len(chunks) > KEPT or len(self.key) > 20 * KEPT:
            self.clear()
        out = [self.end.get(c) for c in chunks]
        missing = [k for k, x in enumerate(out) if x is None]
        held, size = [], 0
        for n, k in enumerate(missing, 1):
            held.append(k)
            size += len(chunks[k])
            if size > BUILD_BYTES or n == len(missing):
                for at, end in zip(held, self.build([chunks[k] for k in held]).tolist()):
                    out[at] = end
                    if len(chunks[at]) <= LONGEST:
                        self.end[chunks[at]] = end
                held, size = [], 0
        return np.array(out, np.int32)

    def sample(self, column: pa.Array, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the sampled ids of all texts, and where those of each text start, with the end."""
        totals, found, last, gone = np.zeros(len(column), np.int64), [], -1, 0
        for words, place, text, _ in segments(column, size=SEGMENT, cut=self.vocabulary.cut):
            if not len(text):
                continue
            opens = np.flatnonzero(np.append(text[0] != last, text[1:] != text[:-1]))  # the parts that start a text
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            number = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
            if text[0] == last:
                number[text == last] += gone
            gone, last = int(number[-1]) + 1, int(text[-1])
            spaced, back = np.unique(place[opens], return_inverse=True)  # a text's first part has the leading space
            place = place.copy()
            place[opens] = len(words) + back
            at = self.ends([*words, *(b" " + words[k] for k in spaced.tolist())])[place]
            ids, counts = self.draw(at, mix(seeds[text] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            found.append(ids)
            totals += np.bincount(text, counts, len(totals)).astype(np.int64)
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.append(0, np.cumsum(totals))

    def draw(self, at: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of chunks whose lattices end at these nodes, each drawn from its own stream."""
        key, piece, source, arc = (
            np.frombuffer(x, t)
            for x, t in ((self.key, np.float32), (self.piece, np.int32), (self.source, np.int32), (self.node_arc, np.int32))
        )
        live, nodes, drawn, step = np.arange(len(at)), at, [], 0
        counts = np.zeros(len(at), np.int64)
        while len(live):
            u = (mix(stream[live] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            k, past = arc[nodes], np.arange(len(nodes))
            while len(past):  # the first arcs, of the longest pieces, take most draws
                past = past[key[k[past]] <= u[past]]
                k[past] += 1
            drawn.append((live, piece[k]))
            counts[live] += 1
            nodes = source[k]
            on = nodes > 0
            live, nodes, step = live[on], nodes[on], step + 1
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for s, (where, got) in enumerate(drawn):
            ids[ends[where] - 1 - s] = got
        return ids, counts


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattices(path, alpha)
    return _LATTICES[path, alpha]


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", seed: int = 0, alpha: float = ALPHA, decoded: bool = False) -> DataFrame:
    """docs with ids array<int>, a sampled segmentation of each text, and where asked for decoded, the text that they spell."""
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    docs = docs.drop("ids", *(["decoded"] if decoded else []))

    def run(batches):
        import xxhash

        settle("pieces", _LATTICES.clear)
        own = lattices(model, alpha)
        for batch in small(batches, text):
            names = batch.schema.names
            keys = batch.column(names.index(key)).to_pylist()
            seeds = np.array([xxhash.xxh64_intdigest("" if k is None else str(k), seed) for k in keys], np.uint64)
            ids, offsets = own.sample(batch.column(names.index(text)), seeds)
            made = [pa.ListArray.from_arrays(offsets.astype(np.int32), ids), *([own.vocabulary.texts(ids, offsets)] if decoded else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, "ids", "decoded"][: len(names) + len(made)])

    return docs.mapInArrow(run, f"{_fields(docs)}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded: the text that the ids spell, empty where they are null."""
    ship(encoded.sparkSession)
    bounded_batches(encoded.sparkSession)
    encoded = encoded.drop("decoded")

    def run(batches):
        own = vocabulary(model)
        for batch in batches:
            names = batch.schema.names
            lists = batch.column(names.index(ids))
            lists = pc.if_else(lists.is_valid(), lists, pa.scalar([], lists.type)) if lists.null_count else lists
            offsets = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
            texts = own.texts(lists.flatten().to_numpy(), offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*names, "decoded"])

    return encoded.mapInArrow(run, f"{_fields(encoded)}, decoded string")
