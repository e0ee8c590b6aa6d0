"""Suffix arrays by two-stage sorting, for texts of many short strings.

Only suffixes smaller than their successor are sorted directly; every other suffix is put in place by scanning
the buckets of first symbols from the smallest up. The order is exact to ``DEPTH`` symbols.
"""

from __future__ import annotations

import numpy as np

#: symbols compared by the direct sort, a multiple of 8
DEPTH = 56


def join(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, start of each string): bytes plus one, a zero after each string. Byte 255 never occurs in UTF-8."""
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    text = np.frombuffer(b"\xff".join(strings) + b"\xff" * (DEPTH + 8), np.uint8) + np.uint8(1)
    return text, np.cumsum(sizes) - sizes


def _words(text: np.ndarray) -> np.ndarray:
    """Eight symbols from every place on, as one big-endian number; a view."""
    return np.ndarray(len(text) - 7, ">u8", text.data, strides=(1,))


def direct_sort(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in the order of their next ``DEPTH`` symbols; ties keep their order."""
    words = _words(text)
    key = words[at].astype(np.uint64)
    first = np.argsort(key, kind="stable")
    order, key = at[first], key[first]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if len(at) else np.empty(0, np.int64)
    where = np.arange(len(at))
    for w in range(8, DEPTH, 8):
        same = group[1:] == group[:-1]
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(group) else same
        where, group = where[tied], group[tied]
        if not len(where):
            break
        sub = order[where]
        key = words[sub + w].astype(np.uint64)
        by = np.lexsort((key, group))
        order[where], key = sub[by], key[by]
        group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]))
    return order


def two_stage(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Wanted suffixes in order. ``text`` ends in ``DEPTH + 8`` zeros; ``wanted`` marks places before them.

    Suffixes on the way from a wanted one to the next directly sorted one are carried along and dropped."""
    n = len(wanted)
    t, nxt = text[:n], text[1:n + 1]
    # smaller than its successor: by the first symbol that differs; in the closing zeros none is smaller
    differs = np.where(t != nxt, np.arange(n), n)
    ahead = np.minimum.accumulate(differs[::-1])[::-1]
    small = np.zeros(n, bool)
    inside = ahead < n
    small[inside] = t[ahead[inside]] < nxt[ahead[inside]]
    # a larger suffix needs its successor: carry along the stretch up to the next small one
    last_small = np.maximum.accumulate(np.where(small, np.arange(n), -1))
    before = np.concatenate([[-1], last_small[:-1]]) + 1
    total = np.concatenate([[0], np.cumsum(wanted)])
    used = wanted | (total[np.arange(n)] > total[before])
    large = used & ~small
    direct = direct_sort(text, np.flatnonzero(used & small))
    sizes_l, sizes_s = np.bincount(t[large], minlength=257), np.bincount(t[direct], minlength=257)
    begin = np.cumsum(sizes_l + sizes_s) - sizes_l - sizes_s
    out = np.empty(int((sizes_l + sizes_s).sum()), np.int64)
    head = begin.copy()
    from_s = np.cumsum(sizes_s) - sizes_s
    # the suffix of the closing zeros follows the last place and comes first of all
    if n and large[n - 1]:
        out[head[t[n - 1]]] = n - 1
        head[t[n - 1]] += 1

    def induce(batch: np.ndarray, above: int, same: bool) -> np.ndarray:
        p = batch - 1
        p = p[p >= 0]
        p = p[large[p]]
        return p[t[p] == above] if same else p[t[p] > above]

    for c in np.flatnonzero(sizes_l + sizes_s):
        batch = out[begin[c]:head[c]]
        while len(batch):
            batch = induce(batch, c, True)
            out[head[c]:head[c] + len(batch)] = batch
            head[c] += len(batch)
        s = direct[from_s[c]:from_s[c] + sizes_s[c]]
        out[begin[c] + sizes_l[c]:begin[c] + sizes_l[c] + sizes_s[c]] = s
        p = induce(out[begin[c]:begin[c] + sizes_l[c] + sizes_s[c]], c, False)
        if len(p):
            to = t[p].astype(np.int64)
            by = np.argsort(to, kind="stable")
            to, p = to[by], p[by]
            count = np.bincount(to, minlength=257)
            out[head[to] + np.arange(len(p)) - (np.cumsum(count) - count)[to]] = p
            head += count
    return out[wanted[out]]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common symbols of each suffix with the one before it in ``order`` (0 for the first), counted up to ``most``."""
    lcp = np.zeros(len(order), np.int64)
    words, alive = _words(text), np.arange(1, len(order))
    for w in range(0, most, 8):
        diff = words[order[alive] + w].astype(np.uint64) ^ words[order[alive - 1] + w].astype(np.uint64)
        # leading equal bytes of the word
        equal = np.full(len(diff), 8)
        for k in range(8):
            equal = np.where((equal == 8) & ((diff >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0), k, equal) if len(diff) else equal
        lcp[alive] += equal
        alive = alive[equal == 8]
        if not len(alive):
            break
    return np.minimum(lcp, most)
