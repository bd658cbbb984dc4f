"""Passages that a document shares with an earlier one, by suffix arrays of shards.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller doc_id. To bring equal strings together, each window of LENGTH bytes is dealt by its
minimizer, the least hash of its grams of ``GRAM`` bytes: it depends on the window's bytes alone.
Neighbouring windows with one minimizer form a piece of text. The steps:

1. Documents are dealt into groups of about ``GROUP_BYTES``; each group sends its distinct
   minimizers, in blocks by hash, and gets a bit for each: whether another document has it too.
2. Pieces under those minimizers go to shards by minimizer, each distinct piece once a group with
   the smallest doc_id that has it.
3. A shard joins its distinct pieces minimizer by minimizer, builds their suffix arrays by induced
   sorting and the permuted common prefixes, and has for each window the smallest doc_id over all
   equal windows.
4. The groups get these for their pieces and mark, cut and hash their documents.

Groups, blocks and shards grow in number with the input, not in size, up to ``GROUPS`` (8 TB of
text); beyond that groups grow, as a passage that a third of all documents share reaches its shard
once a group. Tasks grow in number, too, whatever the session's shuffle partitions. Windows without a minimizer that another document
has can't be shared, so nothing is left out. Pieces are told apart by 64-bit hashes.

Nulls: a null text is empty; documents with null doc_ids come after all others and don't take
anything from each other. Texts under LENGTH bytes lose nothing. Very long texts: whole, one group; long runs and periods take linear time.
Repeated rows: rows of equal doc_id take nothing from each other. Empty tables: empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import partitions
from stemma.llm.shingles import mix, range_hashes
from stemma.llm.suffix_array import common_prefix_reaches, suffix_array

LENGTH, GRAM = 50, 20
#: Bytes of text of a group, about; so many groups share a block of minimizers.
GROUP_BYTES, GROUPS_A_BLOCK = 4 << 20, 8
#: Groups at most: of more text than GROUPS * GROUP_BYTES each group has more, so that a passage that all have stays some 200 MB at its shard.
GROUPS = 1 << 21
#: Groups, blocks or shards that one task does one after the other, about, where the session's shuffle partitions are fewer.
GROUPS_A_TASK = 8
#: Bytes of a suffix array, and how often what one minimizer has beyond that is cut anew.
ARRAY_BYTES, SALTS = 1 << 20, 4
#: Bytes of a string that goes into an array, at most; of longer ones slices do that overlap by a window less a byte.
SLICE = 1 << 16
LAST = np.iinfo(np.int64).max
_CHUNK = 1 << 15


def window_minima(raw: np.ndarray, salt: int = 0) -> np.ndarray:
    """For each window of LENGTH bytes, the least hash of its grams; another order of hashes for each salt."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    out = np.empty(n, np.uint64)
    span = LENGTH - GRAM + 1
    for at in range(0, n, _CHUNK):
        stop = min(n, at + _CHUNK)
        grams = stop - at + span - 1
        h = words[at : at + grams] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += words[at + 8 : at + 8 + grams]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h += words[at + GRAM - 8 : at + GRAM - 8 + grams] >> np.uint64(8 * (16 - (GRAM - 8)))
        h = mix(h + np.uint64(salt))
        width = 1
        while 2 * width <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
        out[at:stop] = h
    return out


def pieces(raw: np.ndarray, edges: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, minimizer, document) of each stretch of windows with one minimizer; document i goes from edges[i] to edges[i + 1]."""
    least = window_minima(raw, salt)
    if not len(least):
        none = np.zeros(0, np.int64)
        return none, none, least, none
    inside = np.ones(len(least), bool)
    for e in edges[1:-1]:
        inside[max(0, e - LENGTH + 1) : e] = False
    change = least[1:] != least[:-1]
    first = np.flatnonzero(inside & np.concatenate([[True], change | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([change | ~inside[1:], [True]]))
    # least hashes are small numbers: mixed anew, they spread over blocks and shards
    return first, last + LENGTH, mix(least[first]), np.searchsorted(edges, first, "right") - 1


def _bytes_of(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of a column of bytes, how many of each row)."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype), np.array([len(r) // np.dtype(dtype).itemsize for r in rows], np.int64)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids in order, their bytes, edges)."""
    ids = table.column("doc_id").fill_null(LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    rows = table.column("raw").take(pa.array(order)).to_pylist()
    edges = np.concatenate([[0], np.cumsum([*map(len, rows)], dtype=np.int64)]).astype(np.int64)
    return ids[order], np.frombuffer(b"".join(rows), np.uint8), edges


def _part(h: np.ndarray, n: int) -> np.ndarray:
    """Of 64-bit hashes: to which of n parts they belong, in ascending order."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _rest(h: np.ndarray) -> np.ndarray:
    """32 bits of a hash apart from those that tell its part: the more parts, the more bits in all."""
    return h.astype(np.uint32)


def _blocks(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(part, from, to) for sorted hashes."""
    if not len(keys):
        return []
    part = _part(keys, n)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return [*zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=True)]


def _group(table: pa.Table) -> int | None:
    return table.column("grp")[0].as_py() if table.num_rows else None


MINIMIZERS = "block long, grp long, h binary, several binary"


def send_minimizers(n_blocks: int) -> Callable[[pa.Table], pa.Table]:
    """Of each block, in order, what tells its hashes apart (``_rest``), and a bit for each that two documents have."""

    def send(table: pa.Table) -> pa.Table:
        ids, raw, edges = _texts(table)
        _, _, keys, docs = pieces(raw, edges)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], ids[docs[order]]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first) if len(first) else np.zeros(0, bool)
        keys, grp = keys[first], _group(table)
        rows = [(b, grp, _bytes_of(_rest(keys[i:j])), _bytes_of(np.packbits(several[i:j]))) for b, i, j in _blocks(keys, n_blocks)]
        return pa.table([*map(list, zip(*rows, strict=True))] or [[], [], [], []], schema=pa.schema([("block", pa.int64()), ("grp", pa.int64()), ("h", pa.binary()), ("several", pa.binary())]))

    return send


SHARED = "grp long, block long, shared binary"


def shared_minimizers(table: pa.Table) -> pa.Table:
    """For each group, a bit for each of its hashes: whether another document has it too. Two hashes that look alike pass as one, which costs time only."""
    keys, sizes = _joined(table.column("h"), np.uint32)
    several = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r, np.uint8), count=n).astype(bool) for r, n in zip(table.column("several").to_pylist(), sizes, strict=True))])
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else order
    counts = np.diff(np.append(first, len(found)))
    more = (counts > 1) | np.logical_or.reduceat(several[order], first) if len(first) else np.zeros(0, bool)
    yes = np.empty(len(keys), bool)
    yes[order] = np.repeat(more, counts)
    bits = [_bytes_of(np.packbits(y)) for y in np.split(yes, np.cumsum(sizes)[:-1])]
    return pa.table([table.column("grp"), table.column("block"), pa.array(bits, pa.binary())], schema=pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("shared", pa.binary())]))


def asked_minimizers(keys: np.ndarray, shared: pa.Table, n_blocks: int) -> np.ndarray:
    """Of a group's minimizers, those that another document has, in order."""
    keys = np.unique(keys)
    bits = dict(zip(shared.column("block").to_pylist(), shared.column("shared").to_pylist(), strict=True))
    parts = [keys[i:j][np.unpackbits(np.frombuffer(bits[b], np.uint8), count=j - i).astype(bool)] for b, i, j in _blocks(keys, n_blocks)]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


PIECES = "shard long, grp long, h binary, first binary, last binary, size binary, raw binary"
_PIECES = pa.schema([("shard", pa.int64()), ("grp", pa.int64()), *((c, pa.binary()) for c in ("h", "first", "last", "size", "raw"))])


def send_pieces(n_blocks: int, n_shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def send(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows or not shared.num_rows:
            return _PIECES.empty_table()
        ids, raw, edges = _texts(table)
        start, end, keys, docs = pieces(raw, edges)
        asked = asked_minimizers(keys, shared, n_blocks)
        if not len(asked):
            return _PIECES.empty_table()
        use = asked[np.minimum(np.searchsorted(asked, keys), len(asked) - 1)] == keys
        start, end, keys, owner = start[use], end[use], keys[use], ids[docs[use]]
        h = range_hashes(raw, start, end)
        order = np.lexsort((owner, h, keys))  # by minimizer, hence by shard; then by piece
        start, end, keys, owner, h = (x[order] for x in (start, end, keys, owner, h))
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        last = owner[np.append(first[1:], len(h)) - 1]
        start, end, keys, owner, h = (x[first] for x in (start, end, keys, owner, h))
        grp, rows = _group(table), []
        for shard, i, j in _blocks(keys, n_shards):
            text = raw[_spread(start[i:j], end[i:j] - start[i:j])]
            rows.append((shard, grp, *map(_bytes_of, (h[i:j], owner[i:j], last[i:j], (end - start)[i:j], text))))
        return pa.table([*map(list, zip(*rows, strict=True))], schema=_PIECES) if rows else _PIECES.empty_table()

    return send


REPEATS = "grp long, h binary, begin binary, stop binary, first binary"
_REPEATS = pa.schema([("grp", pa.int64()), *((c, pa.binary()) for c in ("h", "begin", "stop", "first"))])


def window_owners(texts: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owners, whole): for each byte of strings that lie one after the other with a separator behind each, the smallest owner of a string that holds the LENGTH bytes from there, where they are whole."""
    place = np.cumsum(sizes + 1) - (sizes + 1)
    n = int((sizes + 1).sum())
    letters = np.ones(n + 1, np.int64)  # 1: a separator, 0: the end
    letters[n] = 0
    at = _spread(place, sizes)
    letters[at] = texts.astype(np.int64) + 2
    raw = np.zeros(n, np.uint8)
    raw[at] = texts
    whole = np.zeros(n, bool)
    whole[_spread(place, np.maximum(sizes - LENGTH + 1, 0))] = True
    sa = suffix_array(letters)[1:]
    reach = common_prefix_reaches(raw, sa, LENGTH, whole)[sa]
    first = np.flatnonzero(~reach)
    least = np.minimum.reduceat(np.repeat(owner, sizes + 1)[sa], first)
    owners = np.empty(n, np.int64)
    owners[sa] = np.repeat(least, np.diff(np.append(first, n)))
    return owners, whole


def least_owners(raw: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, h: np.ndarray, salt: int = 0) -> np.ndarray:
    """For each place in ``raw`` where a window of one of the strings raw[start : start + size] begins, the least owner of a string that holds that window.

    Strings with different minimizers (of the given salt) have no window in common, so they go to
    suffix arrays of ARRAY_BYTES at most, minimizer by minimizer. What one minimizer has beyond that
    is cut into the pieces of another salt first. Long strings go in slices, and a minimizer's only
    string has nothing to meet. ``h``: hashes that tell the strings apart.
    """
    out = np.full(len(raw), LAST, np.int64)
    if not len(start):
        return out
    if size.max() > SLICE:
        step = SLICE - LENGTH + 1
        n = -(-(size - LENGTH + 1) // step)
        off = step * _spread(np.zeros(len(n), np.int64), n)
        start, size, owner = np.repeat(start, n) + off, np.minimum(np.repeat(size, n) - off, SLICE), np.repeat(owner, n)
        h = range_hashes(raw, start, start + size)
    order = np.lexsort((owner, h))
    head = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    one, copies = order[head], np.diff(np.append(head, len(order)))  # each distinct string, with its least owner
    place = np.cumsum(size[one]) - size[one]
    text = raw[_spread(start[one], size[one])]
    keys = np.concatenate([window_minima(text[_spread(place[i : i + _CHUNK], np.full(len(place[i : i + _CHUNK]), LENGTH))], salt)[::LENGTH] for i in range(0, len(place), _CHUNK)])
    by_key = np.argsort(keys, kind="stable")
    edges = np.append(np.flatnonzero(np.concatenate([[True], keys[by_key][1:] != keys[by_key][:-1]])), len(by_key))
    sums = np.concatenate([[0], np.cumsum(size[one][by_key])])
    least = np.empty(len(text), np.int64)
    k = 0
    while k < len(edges) - 1:
        stop = max(k + 1, int(np.searchsorted(sums[edges], sums[edges[k]] + ARRAY_BYTES, "right")) - 1)
        batch = by_key[edges[k] : edges[stop]]
        k = stop
        sizes, whose = size[one][batch], owner[one][batch]
        at = _spread(place[batch], sizes)
        if len(batch) == 1:
            least[at] = whose[0]
        elif len(at) > ARRAY_BYTES and salt < SALTS:
            own = text[at]
            a, b, _, of = pieces(own, np.concatenate([[0], np.cumsum(sizes)]), salt + 1)
            least[at] = least_owners(own, a, b - a, whose[of], range_hashes(own, a, b), salt + 1)
        else:
            found, _ = window_owners(text[at], sizes, whose)
            least[at] = found[_spread(np.cumsum(sizes + 1) - (sizes + 1), sizes)]
    # back to every copy's windows
    n = np.repeat(size[one] - LENGTH + 1, copies)
    out[_spread(start[order], n)] = least[_spread(np.repeat(place, copies), n)]
    return out


def find_repeats(table: pa.Table) -> pa.Table:
    h, rows = _joined(table.column("h"), np.uint64)
    first, _ = _joined(table.column("first"), np.int64)
    last, _ = _joined(table.column("last"), np.int64)
    size, _ = _joined(table.column("size"), np.int64)
    texts, _ = _joined(table.column("raw"), np.uint8)
    place = np.cumsum(size) - size
    order = np.lexsort((first, h))
    head = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    piece = np.empty(len(h), np.int64)  # of each piece sent: which distinct one it is
    piece[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
    one = order[head]
    owners = least_owners(texts, place[one], size[one], first[one], h[one])
    # stretches of windows of a distinct piece with one owner
    windows = size[one] - LENGTH + 1
    at = _spread(place[one], windows)
    of = np.repeat(np.arange(len(one)), windows)
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (owners[at[1:]] != owners[at[:-1]])]))
    stop = np.append(new[1:], len(at)) - 1
    least, of, begin, stop = owners[at[new]], of[new], at[new] - place[one][of[new]], at[stop] - place[one][of[new]] + 1
    runs = np.searchsorted(of, np.arange(len(one) + 1))
    grps, ends, out = table.column("grp").to_pylist(), np.cumsum(rows), []
    for grp, a, b in zip(grps, ends - rows, ends, strict=True):
        p = piece[a:b]
        n = runs[p + 1] - runs[p]
        r, sent = _spread(runs[p], n), np.repeat(np.arange(a, b), n)
        use = least[r] < last[sent]
        if use.any():
            r, sent = r[use], sent[use]
            out.append((grp, *map(_bytes_of, (h[sent], begin[r], stop[r], least[r]))))
    return pa.table([*map(list, zip(*out, strict=True))], schema=_REPEATS) if out else _REPEATS.empty_table()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut(table: pa.Table, repeats: pa.Table) -> pa.Table:
    if not table.num_rows:
        return pa.table([[]] * 6, schema=_RESULT)
    ids, raw, edges = _texts(table)
    marks = np.zeros(len(raw) + 1, np.int64)
    if repeats.num_rows:
        start, end, _, docs = pieces(raw, edges)
        asked, begin, stop, least = (_joined(repeats.column(c), t)[0] for c, t in (("h", np.uint64), ("begin", np.int64), ("stop", np.int64), ("first", np.int64)))
        order = np.argsort(asked, kind="stable")
        asked, begin, stop, least = (x[order] for x in (asked, begin, stop, least))
        h = range_hashes(raw, start, end)
        low = np.searchsorted(asked, h, "left")
        n = np.searchsorted(asked, h, "right") - low
        r, at = _spread(low, n), np.repeat(np.arange(len(h)), n)
        use = least[r] < ids[docs[at]]
        r, at = r[use], at[use]
        np.add.at(marks, start[at] + begin[r], 1)
        np.add.at(marks, start[at] + stop[r] - 1 + LENGTH, -1)
    gone = np.cumsum(marks[:-1]) > 0
    out = []
    for i, doc_id in enumerate(ids.tolist()):
        text, off = raw[edges[i] : edges[i + 1]], gone[edges[i] : edges[i + 1]]
        kept = text[~off].tobytes()
        spans = int(off[:1].sum() + (off[1:] & ~off[:-1]).sum())
        out.append((None if doc_id == LAST else doc_id, len(text), int(off.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return pa.table([*map(list, zip(*out, strict=True))], schema=_RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes that stay)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    total = texts.agg(F.sum(F.octet_length("raw")).alias("n")).first()["n"] or 0
    groups = max(partitions(spark), min(GROUPS, -(-total // GROUP_BYTES)))
    blocks = max(partitions(spark), groups // GROUPS_A_BLOCK)
    tasks = groups // GROUPS_A_TASK

    def by(df: DataFrame, key: str):
        return (df.repartition(tasks, key) if tasks > partitions(spark) else df).groupBy(key)

    dealt = texts.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    sent = by(dealt, "grp").applyInArrow(send_minimizers(blocks), MINIMIZERS)
    shared = by(sent, "block").applyInArrow(shared_minimizers, SHARED)
    parts = by(dealt, "grp").cogroup(by(shared, "grp")).applyInArrow(send_pieces(blocks, groups), PIECES)
    repeats = by(parts, "shard").applyInArrow(find_repeats, REPEATS)

    def last(table: pa.Table, found: pa.Table) -> pa.Table:
        out = cut(table, found)
        return out if with_text else out.drop_columns("kept")

    return by(dealt, "grp").cogroup(by(repeats, "grp")).applyInArrow(last, RESULT if with_text else RESULT.removesuffix(", kept binary"))
