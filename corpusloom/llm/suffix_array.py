"""Suffix arrays by induced sorting and permuted common prefixes, vectorised over buckets.

Inducing is sequential only within a bucket's own growth: all suffixes that stand in a bucket can
induce their predecessors at once, and predecessors that fall in the same bucket form its next
round. A bucket thus takes as many rounds as the longest run of its character. Reduced strings have
as many characters as there are names, and buckets of a few suffixes each; there the same scan goes
suffix by suffix. Either way each level is linear in its length, and the levels shrink at least by half.
"""

from __future__ import annotations

import numpy as np

from corpusloom.llm import kernels as K

#: With more characters than this the scan goes suffix by suffix instead of bucket by bucket.
MAX_BUCKETS = 2048


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end of the text is smaller than all."""
    n = len(text)
    smaller = np.zeros(n, bool)
    if n > 1:
        turn = np.where(text[:-1] != text[1:], np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
        turn = np.minimum.accumulate(turn[::-1])[::-1]  # where the run of equal characters ends
        rises = np.append(text[:-1] < text[1:], False)
        smaller[:-1] = rises[turn]
    return smaller


def _deal(bins: list[list[np.ndarray]], pos: np.ndarray, chars: np.ndarray) -> None:
    """Appends pos to the bins of chars, in order."""
    if not len(pos):
        return
    order = np.argsort(chars, kind="stable")
    pos, chars = pos[order], chars[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for c, part in zip(chars[np.append(0, cuts)].tolist(), np.split(pos, cuts)):
        bins[c].append(part)


def _grown(bins: list[list[np.ndarray]], c: int, text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """All of bucket c in the order of the scan; predecessors of the wanted type are dealt out."""
    done, now = [], np.concatenate(bins[c]) if bins[c] else None
    while now is not None and len(now):
        done.append(now)
        before = now[now > 0] - 1
        before = before[wanted[before]]
        chars = text[before]
        own = chars == c
        _deal(bins, before[~own], chars[~own])
        now = before[own]
    return np.concatenate(done) if done else np.empty(0, np.int32)


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> list[np.ndarray]:
    """Buckets of all suffixes, induced from the given order of leftmost-smaller ones."""
    large = ~small
    seeds: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    _deal(seeds, lms, text[lms])
    bins: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    last = len(text) - 1
    bins[text[last]].append(np.array([last], np.int32))  # induced by the end of the text
    left = []
    for c in range(sigma):
        left.append(_grown(bins, c, text, large))
        for part in seeds[c]:
            before = part - 1
            _deal(bins, before, text[before])
    bins = [[] for _ in range(sigma)]
    out: list[np.ndarray] = [left[0]] * sigma
    for c in range(sigma - 1, -1, -1):
        right = _grown(bins, c, text, small)
        back = left[c][::-1]
        before = back[back > 0] - 1
        before = before[small[before]]
        _deal(bins, before, text[before])
        out[c] = np.concatenate([left[c], right[::-1]])
    return out


def _induce_one_by_one(text: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """As _induce(), in one array: buckets grow from their heads in a scan upwards, then from their tails in one downwards."""
    n = len(text)
    counts = np.bincount(text, minlength=sigma)
    tails = np.cumsum(counts)
    # What a suffix induces: the character before it, if that position has the wanted type; index n (and so -1) is no suffix.
    before = np.full(n + 1, -1, np.int64)
    before[1:n] = text[:-1]
    up, down = before.copy(), before
    up[1:n][small[:-1]] = -1
    down[1:n][~small[:-1]] = -1
    up, down = up.tolist(), down.tolist()
    rows = np.full(n, -1, np.int64)
    chars = text[lms]
    order = np.argsort(chars, kind="stable")
    dealt = chars[order]
    last = np.cumsum(np.bincount(dealt, minlength=sigma))
    rows[tails[dealt] - last[dealt] + np.arange(len(lms))] = lms[order]  # at the tails, in order
    rows = rows.tolist()
    head = (tails - counts).tolist()
    end = int(text[-1])
    rows[head[end]] = n - 1
    head[end] += 1
    for p in rows:
        c = up[p]
        if c >= 0:
            rows[head[c]] = p - 1
            head[c] += 1
    tail = (tails - 1).tolist()
    for p in reversed(rows):
        c = down[p]
        if c >= 0:
            rows[tail[c]] = p - 1
            tail[c] -= 1
    return np.array(rows, np.int32)


def _induced(text: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    if sigma > MAX_BUCKETS:
        return _induce_one_by_one(text, small, lms, sigma)
    return np.concatenate(_induce(text, small, lms, sigma))


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Positions of the suffixes of text (values below sigma) in ascending order."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = suffix_types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        # Induce once from any order to sort the leftmost-smaller substrings, and name them.
        found = _induced(text, small, lms, sigma)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        found = found[is_lms[found]]
        ends = np.full(n, n, np.int32)
        ends[lms[:-1]] = lms[1:] + 1
        label = K.span_hash(K.prefix_hash_of(text), found, ends[found])
        label[found == lms[-1]] = 0  # alone: it runs into the end
        names = np.cumsum(np.append(0, label[1:] != label[:-1])).astype(np.int32)
        if names[-1] + 1 == len(lms):
            lms = found
        else:
            name_at = np.empty(n, np.int32)
            name_at[found] = names
            lms = lms[suffix_array(name_at[lms], int(names[-1]) + 1)]
    return _induced(text, small, lms, sigma)


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position, in text order: its common prefix with the suffix before it in order, and that suffix.

    Only values of at least `least` are exact, smaller ones may come out smaller. A value whose
    left neighbours agree is one less than the value to its left, so only the others are looked up.
    """
    n = len(text)
    phi = np.full(n, -1, np.int32)
    phi[order[1:]] = order[:-1]
    prefix = K.prefix_hash_of(text)
    apart = np.ones(n, bool)
    apart[1:] = (phi[1:] < 1) | (text[:-1] != text[np.maximum(phi[1:], 1) - 1])
    heads = np.flatnonzero(apart)
    value = np.zeros(len(heads), np.int64)
    other = phi[heads].astype(np.int64)
    room = n - np.maximum(heads, other)
    could = np.flatnonzero((other >= 0) & (room >= least))
    a, b = heads[could], other[could]
    same = K.span_hash(prefix, a, a + least) == K.span_hash(prefix, b, b + least)
    could, a, b = could[same], a[same], b[same]
    low, high = np.full(len(a), least, np.int64), room[could]
    while len(a) and (low < high).any():  # all of one length, so every step halves every range
        mid = (low + high + 1) // 2
        same = K.span_hash(prefix, a, a + mid) == K.span_hash(prefix, b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    value[could] = low
    which = np.cumsum(apart) - 1
    return (value + heads)[which] - np.arange(n), phi
