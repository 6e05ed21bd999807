"""Exact cutting of UTF-8 text into parts that recur, for tokenizers whose tokens never reach across some places.

For byte-level BPE with the " ?letters" pre-tokenizer these places are: before a space or line end that follows a character
other than white space, between a letter and punctuation, and after a single line end. A column of texts may be cut there, and the
tokens of a text are those of its parts in order. Each distinct part of a segment is worked on once. Letters are the
ASCII ones and U+00C0 to U+00FF; beside other characters fewer places are cut, which only makes parts longer.
Texts that hold a special string are cut before spaces alone, so special strings must not hold white space.

Cutting works on the bytes of an Arrow column, SEGMENT bytes at a time, whatever the length of a text. Where a text is cut
depends on the text alone, not on the texts or segments around it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are cut at once, and bytes before them that are looked at.
SEGMENT, LOOK_BACK = 2_000_000, 4
PRINT, LETTER, MARK, HARD = 1, 2, 4, 8  # printable ASCII but the space; ASCII letters; ASCII punctuation; the same but '


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for c in range(0x21, 0x7F):
        x = chr(c)
        out[c] = PRINT | (LETTER if x.isalpha() else 0 if x.isdigit() else MARK | (HARD if x != "'" else 0))
    return out


_KIND = _kinds()


def _solid(x: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a character that is surely no white space ends at each byte."""
    out = (kind & PRINT) > 0
    far = np.flatnonzero(x >= 0x80)
    if len(far):
        back = [np.where(far >= k, x[np.maximum(far - k, 0)], 0) for k in (1, 2, 3)]
        two = (back[0] >= 0xC3) & (back[0] <= 0xDF)
        odd = ((back[1] == 0xE1) & (back[0] == 0x9A)) | ((back[1] == 0xE2) & (back[0] <= 0x81)) | ((back[1] == 0xE3) & (back[0] == 0x80))
        three = (back[1] >= 0xE0) & (back[1] <= 0xEF) & ~odd
        out[far] = two | three | (back[2] >= 0xF0)
    return out


def cut_places(x: np.ndarray, opens: np.ndarray, spaces: np.ndarray | None = None) -> np.ndarray:
    """Whether the bytes may be cut before each of them, opens marking where texts start; where spaces is set, only before spaces."""
    kind, out = _KIND[x], np.zeros(len(x), bool)
    solid = _solid(x, kind)
    out[1:] = solid[:-1] & (x[1:] == 32)
    latin = np.zeros(len(x), bool)  # both bytes of a letter between U+00C0 and U+00FF
    latin[:-1] = (x[:-1] == 0xC3) & (x[1:] != 0x97) & (x[1:] != 0xB7)
    first, last = (kind & LETTER) > 0, (kind & LETTER) > 0
    first |= latin
    last[1:] |= latin[:-1]
    more = (solid[:-1] & (x[1:] == 10)) | (last[:-1] & ((kind[1:] & MARK) > 0)) | (((kind[:-1] & HARD) > 0) & first[1:])
    more[1:] |= solid[:-2] & (x[1:-1] == 10) & ~opens[1:-1] & (first[2:] | ((kind[2:] & PRINT) > 0))
    if spaces is not None:
        more &= ~spaces[1:]
    out[1:] |= more
    return out


class Segment(NamedTuple):
    """Parts of a stretch of a column: the place of each in `words`, the text it is from, and the texts that are over by its end."""

    words: list[bytes]
    place: np.ndarray
    text: np.ndarray
    over: int


def segments(column: pa.Array, special: list[str] = (), size: int | None = None, cut: Callable[..., np.ndarray] = cut_places) -> Iterator[Segment]:
    """The column's parts (nulls as empty texts), some distinct ones at a time, in order.

    cut(bytes, starts of texts, where only spaces count) says where to cut; it may look LOOK_BACK bytes back within a text, and one ahead.
    """
    size = size or SEGMENT
    column = pc.fill_null(column.cast(pa.string()), "")
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    starts, stop = ends[:-1], int(ends[-1])
    whole = np.zeros(n, bool)
    for s in special:
        whole |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
    at, reach = int(ends[0]), size
    while at < stop:
        back, to = max(int(ends[0]), at - LOOK_BACK), min(stop, at + reach)
        lo, hi = np.searchsorted(ends, (back, to), side="right")  # texts lo - 1 to hi - 1 have bytes from `back` to `to`
        opens, spaces = np.zeros(to - back, bool), None
        own = starts[lo - 1 : hi] - back
        opens[own[(own >= 0) & (own < to - back)]] = True
        if whole[lo - 1 : hi].any():
            spaces = np.zeros(to - back, bool)
            for k in np.flatnonzero(whole[lo - 1 : hi]) + lo - 1:
                spaces[max(0, int(ends[k]) - back) : max(0, int(ends[k + 1]) - back)] = True
        found = cut(data[back:to], opens, spaces) | opens
        places = np.flatnonzero(found[at - back :])
        if not len(places) or places[0]:
            places = np.append(0, places)
        if to < stop:  # the last part may go on
            if len(places) == 1:
                reach *= 2
                continue
            to, places = at + int(places[-1]), places[:-1]
        offsets = np.append(places, to - at).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(data[at:to])])
        coded = held.dictionary_encode()
        text = np.searchsorted(ends[:-1], places + at, side="right") - 1
        yield Segment(coded.dictionary.to_pylist(), coded.indices.to_numpy(), text, int(np.searchsorted(ends[1:], to, side="right")))
        at, reach = to, size
    if stop == ends[0]:
        none = np.zeros(0, np.int64)
        yield Segment([], none.astype(np.int32), none, n)


def check_vocabulary(path: str) -> list[str]:
    """The special strings of a vocabulary file; an error if its tokens might reach across the places where texts are cut."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    given = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or any(given.get(k) != v for k, v in plain.items()) or spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        raise ValueError(f"{path}: not a byte-level BPE vocabulary with the plain pre-tokenizer")
    special = []
    for t in spec["added_tokens"]:
        if any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(c.isspace() for c in t["content"]):
            raise ValueError(f"{path}: special string {t['content']!r} takes white space or words into account")
        special.append(t["content"])
    return special


class Memo(dict):
    """Values by part, computed when missing; long parts aren't kept, and a full memo is emptied."""

    def __init__(self, compute, most: int = 200_000, longest: int = 48):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, part):
        value = self.compute(part)
        if len(part) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[part] = value
        return value
