"""Encoding of many texts by way of their distinct segments.

A segment ends before a space, and before each of the tokenizer's ``breaks`` (a line feed, say). A
tokenizer is *separable* there if none of its tokens goes over such a place; then the ids of a text are the
ids of its segments one after the other, and each distinct segment is encoded by the library once.
Texts for which that can't be told are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct segments that one worker keeps; beyond that it drops those met once, which costs time only.
KEPT_SEGMENTS = 400_000
#: Characters of segments that go to the library as one string.
JOINED_CHARS = 1 << 14


#: Bytes of texts that are encoded together, about.
TEXT_BYTES = 1 << 20
#: The same for a SegmentEncoder, which indexes what it keeps anew for each stretch.
ENCODED_BYTES = 1 << 22


def slices(texts: pa.Array | pa.ChunkedArray, size: int = TEXT_BYTES) -> list[tuple[int, int]]:
    """(from, number) of stretches of rows with about ``size`` bytes of text, one row at least."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // size
    cuts = [*np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])[: len(block)]).tolist(), len(block)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def code_points(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the code points of all keys, where each key ends)."""
    return np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), "<u4"), np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))


def utf8_ends(keys: list[str]) -> np.ndarray:
    """Where each key ends in the UTF-8 of all."""
    points, ends = code_points(keys)
    sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate([[0], np.cumsum(sizes)])[ends]


class SegmentEncoder:
    """Encodes texts; the ids are those of ``whole`` on each text.

    whole: encodes texts. joined: encodes strings of many segments, the first with its space. alone:
    encodes segments that can't stand in such a string. token_bytes: by id, the bytes a
    token covers; space_bytes: the same for a space. breaks: characters that begin a segment of
    their own, without a space. codes: of segments, numbers below 16, below 8 for those that can
    stand in a joined string. bad: 16 x 16, true if no segment may end between such two; a text that
    has such a place is encoded whole. first: true if a text's first segment has no space before it
    (it is kept with one). differ: gets new segments, their ids and where those end, and tells for
    each whether another encoder has other ids; differ_whole: the same for texts and their ids.
    """

    def __init__(self, whole: Callable[[list[str]], list], joined: Callable[[list[str]], list[list[int]]], alone: Callable[[list[str]], list[list[int]]], token_bytes: np.ndarray, space_bytes: int, codes: Callable[[list[str]], np.ndarray], bad: np.ndarray, first: bool, breaks: str = "\n", differ: Callable | None = None, differ_whole: Callable | None = None):
        self.differ, self.differ_whole = differ, differ_whole
        self.whole, self.joined, self.alone, self.codes_of, self.bad, self.first, self.breaks = whole, joined, alone, codes, bad, first, breaks
        self.token_bytes, self.space_bytes = token_bytes, space_bytes
        self.forget()

    #: The code of a segment whose text can't be split.
    WHOLE = 15

    def forget(self) -> None:
        self.keys = pa.array([], pa.large_binary())  # the segments as they stand in texts
        self.flat = np.zeros(1 << 16, np.uint32)
        self.edges = np.zeros(1 << 14, np.int64)  # of segment i: from edges[i] to edges[i + 1]
        self.seen = np.zeros(1 << 14, np.int64)
        self.codes = np.zeros(1 << 14, np.int8)
        self.other = np.zeros(1 << 14, np.int8)  # 1: without parity

    def _thin(self) -> None:
        """Keep what was met again since the last time, unless that alone is most of it."""
        n = len(self.keys)
        old, edges, again = self.keys, self.edges, np.flatnonzero(self.seen[:n] > 1)
        flat, codes, other = self.flat, self.codes, self.other
        self.forget()
        if 0 < len(again) < KEPT_SEGMENTS // 2:
            sizes = edges[again + 1] - edges[again]
            ends = np.cumsum(sizes)
            self._keep(0, codes[again], flat[np.repeat(edges[again] - ends + sizes, sizes) + np.arange(ends[-1])], ends, other[again])
            self.keys = old.take(pa.array(again))

    def _keep(self, n: int, codes: np.ndarray, ids: np.ndarray, ends: np.ndarray, other: np.ndarray | int = 0) -> None:
        """n: segments kept before; ids: of the new ones, of the i-th up to ends[i]."""
        used = int(self.edges[n])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        to = n + len(codes)
        while to >= len(self.edges):
            self.edges, self.seen, self.codes, self.other = (np.concatenate([x, np.zeros_like(x)]) for x in (self.edges, self.seen, self.codes, self.other))
        self.flat[used : used + len(ids)] = ids
        self.edges[n + 1 : to + 1] = used + ends
        self.codes[n:to] = codes
        self.other[n:to] = other

    def _spelled(self, found: pa.Array) -> list[str]:
        """Segments without the space before them; breaks as they are, a text's first segment with a space if it is to be told apart."""
        first = " " if self.first else ""
        return [k[1:] if k[:1] == " " else k if k and k[0] in self.breaks else first + k for k in found.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()]

    def _learn(self, found: pa.Array) -> np.ndarray:
        """Encodes new segments; where each is kept."""
        keys, n = self._spelled(found), len(self.keys)
        codes = self.codes_of(keys)
        apart = codes >= 8
        if apart.any():
            single = [keys[i] for i in np.flatnonzero(apart)]
            ids = [np.asarray(x, np.uint32) for x in self.alone(single)]
            self._keep(n, codes[apart], np.concatenate(ids), np.cumsum([*map(len, ids)]))
            keys, codes = [keys[i] for i in np.flatnonzero(~apart)], codes[~apart]
        order = np.concatenate([np.flatnonzero(apart), np.flatnonzero(~apart)])
        self.keys = pa.concat_arrays([self.keys, found.take(pa.array(order))])
        at = np.empty(len(order), np.int64)
        at[order] = n + np.arange(len(order))
        if keys:
            self._join(n + int(apart.sum()), keys, codes)
        return at

    def _join(self, n: int, keys: list[str], codes: np.ndarray) -> None:
        """Encodes segments that can stand in joined strings."""
        texts = [k if k[0] in self.breaks else " " + k for k in keys]
        block = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // JOINED_CHARS
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(keys)]
        found = self.joined(["".join(texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        ends = utf8_ends(texts)
        if self.space_bytes > 1:
            ends = ends + np.cumsum(np.fromiter((t[0] == " " for t in texts), np.int64, len(texts))) * (self.space_bytes - 1)
        at = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends, "left") + 1
        self._keep(n, codes, ids, at, self.differ(keys, ids, at) if self.differ else 0)

    def _segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct segments as they stand in the texts, which of them each segment is, the number of segments by text); empty texts have none, others that begin with a space or break an empty one first."""
        if not pc.sum(pc.binary_length(texts)).as_py():
            return self.keys[:0], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        base = int(edges[0])
        cut = np.isin(np.arange(256), [ord(c) for c in " " + self.breaks])[np.frombuffer(data, np.uint8)[base : edges[-1]]]
        starts = (edges[:-1] - base)[np.diff(edges) > 0]
        led = starts[cut[starts]]
        cut[starts] = True
        at = np.flatnonzero(cut)
        if len(led):
            at = np.sort(np.concatenate([at, led]), kind="stable")
        counts = np.diff(np.searchsorted(at, edges - base))
        offsets = np.append(at, edges[-1] - base) + base
        found = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), data]).dictionary_encode()
        return found.dictionary, found.indices.to_numpy(zero_copy_only=False), counts

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text, by text whether another encoder has other ids for a segment of it); a null is an empty text."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        if len(self.keys) > KEPT_SEGMENTS:
            self._thin()
        keys, local, counts = self._segments(texts)
        known = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = self._learn(keys.take(pa.array(new)))
        np.add.at(self.seen, known, np.bincount(local, minlength=len(keys)))
        rows = known[local]
        starts = self.edges[rows]
        lengths = self.edges[rows + 1] - starts
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(starts - before[:-1], lengths) + np.arange(before[-1])]
        edges = np.concatenate([[0], np.cumsum(counts)])
        sizes = before[edges[1:]] - before[edges[:-1]]
        others = np.concatenate([[0], np.cumsum(self.other[rows], dtype=np.int64)])
        differ = others[edges[1:]] > others[edges[:-1]]
        codes = self.codes[rows]
        wrong = np.flatnonzero(self.bad[codes[:-1], codes[1:]]) + 1
        at = np.searchsorted(edges, wrong, "right") - 1  # the text in which the later segment stands
        odd = np.unique(np.concatenate([at[edges[at] < wrong], np.searchsorted(edges, np.flatnonzero(codes == self.WHOLE), "right") - 1]))
        if len(odd):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            odd_texts = texts.take(pa.array(odd)).to_pylist()
            found = self.whole(odd_texts)
            for i, x in zip(odd, found, strict=True):
                parts[i] = np.asarray(x, np.uint32)
                sizes[i] = len(x)
            ids = np.concatenate(parts)
            if self.differ_whole:
                differ[odd] = self.differ_whole(odd_texts, found)
        return ids, sizes, differ
