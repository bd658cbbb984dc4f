"""SentencePiece models run by the tokenizers library: encoding, decoding and a check of parity.

The model's protobuf is read field by field; from it come the normaliser (identity, or the compiled
character map), the metaspace marker with its dummy prefix, the pieces with their scores, as a
unigram or BPE model, and byte fallback. New segments are encoded in batches by the library's
threads, and held against the sentencepiece library: where the two differ, the ids are still the
tokenizers library's, and ``parity`` of the text is false. Decoding joins the bytes of pieces.

Nulls: a null text is encoded as an empty one, without ids. Very long texts: whole. Repeated rows:
a row each. Empty tables: empty result. Other columns pass through; names given here replace columns
of the same name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stemma.llm.common import with_columns
from stemma.llm.segments import ENCODED_BYTES, SegmentEncoder, slices

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _varint(raw: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[i] & 127) << shift
        shift += 7
        i += 1
        if raw[i - 1] < 128:
            return value, i


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    i = 0
    while i < len(raw):
        key, i = _varint(raw, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(raw, i)
        else:
            n, i = _varint(raw, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = raw[i : i + n], i + n
        yield key >> 3, value


@dataclass
class Model:
    """What a model file says; field numbers are those of sentencepiece_model.proto."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True

    @classmethod
    def load(cls, path: str) -> Model:
        m = cls()
        with open(path, "rb") as file:
            raw = file.read()
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                m.pieces.append(piece[1].decode())
                m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                m.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                m.kind, m.byte_fallback, m.unknown = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0)
            elif number == 3:
                norm = dict(_fields(value))
                m.charsmap, m.dummy_prefix, m.remove_extra_whitespaces = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1))
        return m

    @property
    def separable(self) -> bool:
        """No piece goes over the start of a marker or over a line feed, and texts aren't changed before."""
        return not (self.charsmap or self.remove_extra_whitespaces) and self.dummy_prefix and not any("\n" in p or MARK in p.lstrip(MARK) for p in self.pieces)


def build_tokenizer(m: Model, dummy_prefix: bool, split: bool):
    """A tokenizer of the tokenizers library with the model's normaliser, marker, scores and byte fallback."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind == UNIGRAM:
        model = models.Unigram(list(zip(m.pieces, m.scores, strict=True)), unk_id=m.unknown, byte_fallback=m.byte_fallback)
    elif m.kind == BPE:
        ids = {p: i for i, p in enumerate(m.pieces)}
        joins = []
        for piece, i in ids.items():
            if m.kinds[i] in (NORMAL, USER):
                joins += [(-m.scores[i], ids[piece[:k]], ids[piece[k:]], piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        model = models.BPE(ids, [(a, b) for *_, a, b in sorted(joins)], unk_token=m.pieces[m.unknown], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.kind} has no counterpart")
    tok = Tokenizer(model)
    norms = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        norms += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if split:  # each marker begins a new piece; the texts have theirs
        tok.pre_tokenizer = pre_tokenizers.Metaspace(MARK, "never", True)
    else:  # the prefix is added to texts that begin with a space, too
        norms += [*([normalizers.Prepend(MARK)] if dummy_prefix else []), normalizers.Replace(" ", MARK)]
    if norms:
        tok.normalizer = normalizers.Sequence(norms)
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if dummy_prefix else [])])
    return tok


class Codec:
    """Encodes and decodes texts by a model file.

    All ids are the tokenizers library's; new segments, and texts that go to it whole, are held
    against the sentencepiece library's if ``verify``.
    """

    def __init__(self, path: str, verify: bool = True):
        self.model = m = Model.load(path)
        self.tok = build_tokenizer(m, m.dummy_prefix, split=False)
        self.pieces = build_tokenizer(m, False, split=True)
        self.bytes = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
        if verify:
            import sentencepiece

            self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        token_bytes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(m.pieces, m.kinds, strict=True)], np.int64)
        marker = m.pieces.index(MARK) if MARK in m.pieces else m.unknown
        # an empty segment is a marker alone: two of them join; one before a line feed doesn't
        separable = m.separable
        code = lambda key: SegmentEncoder.WHOLE if MARK in key or not separable else 8 if not key else key[0] == "\n"
        bad = np.zeros((16, 16), bool)
        bad[8, [0, 8]] = True
        self.encoder = SegmentEncoder(
            whole=lambda texts: self._ids(self.tok, texts),
            joined=lambda texts: self._ids(self.pieces, texts),
            alone=lambda keys: [[marker] for _ in keys],  # of others than empty ones the text goes whole
            token_bytes=token_bytes,
            space_bytes=len(MARK.encode()),
            codes=lambda keys: np.fromiter(map(code, keys), np.int8, len(keys)),
            bad=bad,
            first=False,
            differ=self._differ if verify else None,
            differ_whole=self._differ_whole if verify else None,
        )

    @staticmethod
    def _ids(tok, texts: list[str]) -> list[list[int]]:
        """By the library's threads."""
        return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _differ_whole(self, texts: list[str], ids: list[list[int]]) -> np.ndarray:
        return np.array([list(a) != b for a, b in zip(ids, self.peer.encode(texts, num_threads=1), strict=True)], bool)

    def _differ(self, keys: list[str], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        peers = self.peer.encode(keys, num_threads=1)
        peers = [p[1:] if k[0] == "\n" else p for p, k in zip(peers, keys, strict=True)]
        flat = np.fromiter(chain.from_iterable(peers), np.uint32)
        at = np.cumsum(np.fromiter(map(len, peers), np.int64, len(peers)))
        if np.array_equal(flat, ids) and np.array_equal(at, ends):
            return np.zeros(len(keys), bool)
        return np.array([a.tolist() != b for a, b in zip(np.split(ids, ends[:-1]), peers, strict=True)], bool)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids by text, whether the text has a segment without parity)."""
        return self.encoder.encode(texts)

    def decode(self, ids: list) -> list[str]:
        """The bytes of the pieces, with spaces for markers and without the dummy prefix; bytes that aren't UTF-8 become U+FFFD."""
        texts = [b"".join(map(self.bytes.__getitem__, np.asarray(x, np.int64).tolist())).decode("utf-8", "replace") for x in ids]
        return [t.removeprefix(" ") for t in texts] if self.model.dummy_prefix else texts


@lru_cache(maxsize=4)
def codec(path: str, verify: bool = True) -> Codec:
    return Codec(path, verify)


def encode_pieces(df: DataFrame, model_path: str, text_col: str = "text", verify: bool = True) -> DataFrame:
    """``df`` with ids (array<int>), n_pieces, ids_crc32 (as little-endian unsigned 32-bit integers), round_trip (decoded, it is the text) and parity (the sentencepiece library has the same ids; null unless ``verify``)."""

    def run(texts: pa.Array) -> Iterator[dict[str, pa.Array]]:
        c = codec(model_path, verify)
        for at, rows in slices(texts, ENCODED_BYTES):
            part = texts.slice(at, rows)
            ids, sizes, differ = c.encode(part)
            ids, ends = ids.astype(np.int32), np.cumsum(sizes)
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            lists = [ids[b - n : b] for n, b in zip(sizes, ends, strict=True)]
            yield {
                "ids": pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids)),
                "n_pieces": pa.array(sizes),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * (b - n) : 4 * b]) for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.int64()),
                "round_trip": pa.array([a == (b or "") for a, b in zip(c.decode(lists), part.to_pylist(), strict=True)], pa.bool_()),
                "parity": pa.array(~differ if verify else [None] * rows, pa.bool_()),
            }

    return with_columns(df, text_col, run, "ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean, parity boolean")


def decode_pieces(df: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``text``, decoded from its ids; null for null ids."""

    def run(ids: pa.Array) -> Iterator[dict[str, pa.Array]]:
        rows = ids.to_pylist()
        texts = codec(model_path, False).decode([x or () for x in rows])
        yield {"text": pa.array([None if x is None else t for x, t in zip(rows, texts, strict=True)], pa.string())}

    return with_columns(df, ids_col, run, "text string")
