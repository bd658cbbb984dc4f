"""Suffix arrays by induced sorting, on whole arrays at a time.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; those that are S
after an L are leftmost-smaller. Their substrings are sorted by inducing from any order, named, and
the string of names is sorted recursively; the order of the leftmost-smaller suffixes then induces
that of all. Inducing goes over the array bucket by bucket: what a bucket induces into itself are
the runs of its letter, whose order is known in closed form (the k-th letters from the ends of all
runs, in the order of those ends, before the letters k + 1 from them); what it induces into others is
one array operation. Small buckets without longer runs go together, in blocks that end before the
first place into which the block itself induces. So the time is linear on repetitive texts, too:
periods become runs of one name a level deeper. Where most names are distinct, those that aren't are
told apart by doubling, which ends the recursion.
"""

from __future__ import annotations

import numpy as np

#: Buckets of so many suffixes, or with so many equal letters one after the other, are induced on their own.
BUCKET, RUN = 512, 4


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _place(keys: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, places, letters, first): where suffixes with these letters go, in the order of their letters; ``first`` of a letter in that order."""
    order = keys.argsort(kind="stable")
    ordered = keys[order]
    change = np.empty(len(ordered), bool)
    change[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=change[1:])
    first = change.nonzero()[0]
    letters = ordered[first]
    counts = np.diff(np.append(first, len(ordered)))
    # the k-th of a letter goes k places behind its bucket's head
    return order, np.repeat(head[letters] - first, counts) + np.arange(len(ordered)), letters, first


def _induce_bucket(sa: np.ndarray, t: np.ndarray, c: int, edges: np.ndarray, head: np.ndarray, run: np.ndarray) -> None:
    lo, hi = edges[c], edges[c + 1]
    ends = sa[lo : head[c]]  # put there from other buckets: each the end of a run
    if len(ends):
        more = run[ends]
        if more.any():
            sizes = more + 1
            back = _spread(np.zeros(len(ends), np.int64), sizes)
            order = back.astype(np.uint16 if back.max() < 1 << 16 else np.int64).argsort(kind="stable")
            sa[lo : lo + len(back)] = (np.repeat(ends, sizes) - back)[order]
    before = sa[lo:hi]
    before = before[before > 0] - 1
    keys = t[before]
    use = (keys != c) & (keys < len(edges) - 1)
    before, keys = before[use], keys[use]
    if len(before):
        order, place, letters, first = _place(keys, head)
        sa[place] = before[order]
        head[letters] += np.diff(np.append(first, len(keys)))


def _induce_stretch(sa: np.ndarray, t: np.ndarray, lo: int, stop: int, n_letters: int, head: np.ndarray) -> None:
    """The places from ``lo`` to ``stop``, in blocks."""
    size = 1024
    while lo < stop:
        hi = min(stop, lo + size)
        before = sa[lo:hi] - 1
        keys = t[before]
        source = ((before >= 0) & (keys < n_letters)).nonzero()[0]
        if not len(source):
            lo, size = hi, size * 2
            continue
        order, place, letters, first = _place(keys[source], head)
        found = before[source][order]
        end = int(place.min())
        if end < hi:  # what the block puts at ``end`` must be read before what follows
            kept = source[order] < end - lo
            head[letters] += np.add.reduceat(kept, first, dtype=np.int64)
            sa[place[kept]] = found[kept]
            size, hi = max(256, 2 * (end - lo)), end
        else:
            head[letters] += np.diff(np.append(first, len(place)))
            sa[place] = found
            size *= 2
        lo = hi


def _induce(sa: np.ndarray, t: np.ndarray, want: np.ndarray, edges: np.ndarray, run: np.ndarray) -> None:
    """From left to right, for each suffix i in ``sa`` put i - 1, if wanted, at the head of its bucket (-1: empty place). ``run``: the equal letters directly before each place."""
    n_letters = len(edges) - 1
    apart = np.diff(edges) >= BUCKET
    apart[t[run >= RUN - 1]] = True
    wanted = np.where(want, t, n_letters).astype(np.uint16 if n_letters < 1 << 16 else np.int32)
    head, c = edges[:-1].copy(), 0
    for big in [*np.flatnonzero(apart).tolist(), n_letters]:
        if c < big:
            _induce_stretch(sa, wanted, int(edges[c]), int(edges[big]), n_letters, head)
        if big < n_letters:
            _induce_bucket(sa, wanted, big, edges, head, run)
        c = big + 1


def _induce_all(lms: np.ndarray, t: np.ndarray, is_s: np.ndarray, edges: np.ndarray, run: np.ndarray) -> np.ndarray:
    """All suffixes, from leftmost-smaller ones in order within their buckets."""
    n, top = len(t), len(edges) - 2
    sa = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    keys = t[lms]
    ends = np.cumsum(np.bincount(keys, minlength=top + 1))
    place = edges[1:][keys] - (ends[keys] - np.arange(len(lms)))
    sa[place] = lms
    _induce(sa, t, ~is_s, edges, run)
    sa[place] = -1
    sa[0] = n - 1
    # the same from right to left: places and letters turned round
    _induce(sa[::-1], top - t, is_s, n - edges[::-1], run)
    sa[0] = n - 1
    return sa


def _doubled(t: np.ndarray) -> np.ndarray:
    """The suffix array of a string whose letters are mostly distinct: equal ranks are split by the ranks 1, 2, 4, ... places on."""
    n = len(t)
    rank, tied, ordered, k = np.zeros(n, np.int64), np.arange(n), t, 0
    while len(tied):
        order = ordered.argsort(kind="stable")
        tied, ordered, before = tied[order], ordered[order], rank[tied[order]]
        places = np.arange(len(tied))
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        old = np.concatenate([[True], before[1:] != before[:-1]])
        first = np.maximum.accumulate(np.where(new, places, 0))
        rank[tied] = before + first - np.maximum.accumulate(np.where(old, places, 0))
        tied = tied[~new | ~np.append(new[1:], True)]
        k = 2 * k or 1
        ordered = rank[tied] * n + rank[np.minimum(tied + k, n - 1)]
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of ``t``, integers of which the last is 0 and all others greater."""
    n = len(t)
    if n < 3:
        return np.arange(n - 1, -1, -1)
    t = t.astype(np.int32)
    steps = np.sign(np.diff(t))
    places = np.arange(n)
    following = np.minimum.accumulate(np.where(steps != 0, places[:-1], n)[::-1])[::-1]
    is_s = np.append(steps[np.minimum(following, n - 2)] > 0, True)
    run = places - np.maximum.accumulate(np.where(np.concatenate([[True], steps != 0]), places, 0))
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    edges = np.concatenate([[0], np.cumsum(np.bincount(t))])
    sa = _induce_all(lms[np.argsort(t[lms], kind="stable")], t, is_s, edges, run)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    # names: equal neighbours in this order have the same length and letters
    length = np.zeros(n, np.int64)
    length[lms] = np.append(np.diff(lms), 0)
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    equal = np.flatnonzero(same & (t[a] == t[b]))
    same[:] = False
    if len(equal):
        sizes = length[a[equal]] + 1
        differ = t[_spread(a[equal], sizes)] != t[_spread(b[equal], sizes)]
        same[equal] = ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 < len(lms):
        by_place = np.zeros(n, np.int64)
        by_place[ordered] = names
        ordered = lms[(_doubled if 2 * names[-1] > len(lms) else suffix_array)(by_place[lms])]
    return _induce_all(ordered, t, is_s, edges, run)


def common_prefix_reaches(t: np.ndarray, sa: np.ndarray, length: int, whole: np.ndarray) -> np.ndarray:
    """By place in ``t``: whether the suffix shares ``length`` letters (bytes, 8 at least) with the one before it in ``sa``; ``whole``: whether those letters are one string's.

    The common prefixes are permuted to text order by way of each suffix's predecessor, so that one
    side of every comparison is read in sequence, eight letters at a time.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = sa[0]
    alone = sa[0]
    raw = np.concatenate([t, np.zeros(length + 8, np.uint8)])
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()
    left = np.flatnonzero(whole & whole[before])
    left = left[left != alone]
    for k in [*range(0, length - 7, 8), length - 8]:
        left = left[words[left + k] == words[before[left] + k]]
    out = np.zeros(n, bool)
    out[left] = True
    return out
