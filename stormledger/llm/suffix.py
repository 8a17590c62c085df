"""Suffix-array dedup: repeated byte strings, by suffix arrays built from Lyndon groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import run_hashes, without_repeats


def grouped(text: list[int]) -> tuple[list[int], list[bool]]:
    """The places of a text by symbol, and which of them begin a new symbol: a radix sort, 16 bits at a time, so linear."""
    symbols = np.array(text, "u4")
    order = np.argsort((symbols & 0xFFFF).astype("u2"), kind="stable")
    if len(symbols) and symbols.max() > 0xFFFF:
        order = order[np.argsort((symbols >> 16).astype("u2")[order], kind="stable")]
    ranked = symbols[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    return order.tolist(), first.tolist()


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of ints whose last one is smaller than all others.

    Linear grouping, without recursion or renaming. First suffixes are grouped by their first symbol, and
    groups are taken in descending order. For each member of a group the pointer to the
    previous suffix in a smaller group is found; the suffixes pointed at have a Lyndon prefix that goes
    on with this group's, so they move to the upper end of their own group, those pointed at
    more often above the others. In the end a group holds the suffixes with one Lyndon prefix. Then,
    from the smallest suffix up, each suffix places the one before it, and along the pointers those
    before that, next in their groups.
    """
    n = len(text)
    order, first = grouped(text)
    place, group, end = [0] * n, [0] * n, [0] * n  # end: the last place of the group that starts there
    start = 0
    for i, s in enumerate(order):
        if first[i]:
            start = i
        place[s], group[s], end[start] = i, start, i
    prev = [-2] * n  # -2: not known yet
    last = n - 1
    while last >= 0:
        start = group[order[last]]
        if start == last:  # a group of one, as most are
            s = order[last]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[s] = p
            if p >= 0 and (stop := end[g := group[p]]) != g:
                q, i = order[stop], place[p]
                order[i], place[q] = q, i
                order[stop], place[p], group[p] = p, stop, stop
                end[g], end[stop] = stop - 1, stop
            last -= 1
            continue
        counts: dict[int, int] = {}
        for s in order[start : last + 1]:
            if prev[s] == -2:  # pointers within the group come first: each is followed once
                chain = [(s, s - 1)]
                while chain:
                    q, p = chain.pop()
                    while p >= 0 and group[p] >= start:
                        if (up := prev[p]) == -2:
                            chain += [(q, p), (p, p - 1)]
                            break
                        p = up
                    else:
                        prev[q] = p
            if (p := prev[s]) >= 0:
                counts[p] = counts.get(p, 0) + 1
        levels: dict[int, list[int]] = {}
        for p, k in counts.items():
            levels.setdefault(k, []).append(p)
        for k in sorted(levels, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in levels[k]:
                moved.setdefault(group[p], []).append(p)
            for g, those in moved.items():
                stop = end[g]
                fresh = stop - len(those) + 1
                if fresh == g:  # the whole group moves, and so stays
                    continue
                at = stop
                for p in those:  # swapped with the last of what is left of the group
                    q, i = order[at], place[p]
                    order[i], place[q] = q, i
                    order[at], place[p], group[p] = p, at, fresh
                    at -= 1
                end[g], end[fresh] = fresh - 1, stop
        last = start - 1
    free = list(range(n))
    out = [-1] * n
    out[0], done = n - 1, [False] * n
    done[n - 1] = True
    free[group[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]], done[j] = j, True
            free[g] += 1
            j = prev[j]
    return out


class ByteUnits:
    """Bytes as units; super-k-mers are resolved by the suffix array of their concatenation."""

    def __init__(self, width: int = 100, gram: int = 32):
        self.width, self.gram = width, min(gram, width)

    def cut(self, text: bytes, most: int) -> Iterator[tuple[int, bytes]]:
        for at in range(0, max(1, len(text) - self.width + 1), most):
            yield at, text[at : at + most + self.width - 1]

    def units(self, data: np.ndarray, edges: np.ndarray):
        n = len(data)
        starts = np.arange(n)
        grams = run_hashes(data, starts, np.minimum(starts + self.gram, n)) if n else np.zeros(0, "u8")
        return grams, starts, starts + 1, edges

    def resolve(self, contents: list[bytes], owners: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        # Only strings whose hash occurs twice can repeat: contents are cut to the span of those.
        data = np.frombuffer(b"".join(contents) + b"\0" * self.width, "u1")
        sizes = np.array([len(c) for c in contents])
        base = np.cumsum(sizes) - sizes
        count = sizes - self.width + 1
        owner = np.repeat(np.arange(len(contents)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = base[owner] + inner
        _, which, times = np.unique(run_hashes(data, starts, starts + self.width), return_inverse=True, return_counts=True)
        again = times[which] > 1
        owner, inner = owner[again], inner[again]
        if not len(owner):
            return
        kept, at = np.unique(owner, return_index=True)
        low, high = inner[at], inner[np.append(at[1:], len(owner)) - 1]
        pieces = [contents[i][a : b + self.width] for i, a, b in zip(kept.tolist(), low.tolist(), high.tolist(), strict=True)]
        k = len(pieces)
        text: list[int] = []
        first = []
        for i, c in enumerate(pieces):  # each ends with a symbol of its own, smaller than any byte
            first.append(len(text))
            text += [b + k + 1 for b in c]
            text.append(k - i)
        text.append(0)
        data = np.frombuffer(b"\0".join(pieces) + b"\0" * (self.width + 2), "u1")
        first = np.array(first)
        sizes = np.array([len(c) for c in pieces])
        sa = np.array(suffix_array(text))
        which = np.searchsorted(first, sa, "right") - 1
        inside = sa - first[which]
        whole = inside + self.width <= sizes[which]
        sa, which, inside = sa[whole], which[whole], inside[whole]
        if not len(sa):
            return
        same = np.zeros(len(sa), bool)
        view = np.lib.stride_tricks.sliding_window_view(data, self.width)
        for a in range(1, len(sa), 20_000):
            b = min(len(sa), a + 20_000)
            same[a:b] = (view[sa[a:b]] == view[sa[a - 1 : b - 1]]).all(1)
        string = np.cumsum(~same)
        doc = np.array([d for d, _ in owners], "i8")[kept[which]]
        inside = inside + low[which]
        place = np.array([p for _, p in owners], "i8")[kept[which]] + inside
        which = kept[which]
        by = np.lexsort((place, doc, string))
        head = np.ones(len(by), bool)
        head[1:] = string[by[1:]] != string[by[:-1]]
        lead = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
        later = by[~((doc[by] == doc[lead]) & (place[by] == place[lead]))]
        pairs = np.unique(np.stack((which[later], inside[later]), 1), axis=0)
        if len(pairs):
            cut = np.flatnonzero((np.diff(pairs[:, 0]) != 0) | (np.diff(pairs[:, 1]) != 1)) + 1
            for run in np.split(pairs, cut):
                yield int(run[0, 0]), int(run[0, 1]), int(run[-1, 1])


def drop_repeated_bytes(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): each byte covered by a string of ``width`` bytes that
    also starts earlier is removed; matches never cross documents.

    Texts count as UTF-8. ``spans`` are the removed runs as {start, end}, in bytes; what is kept may
    cut a character. A null text is empty. See ``repeats`` for how rows that share an id count.
    """

    def report(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        kept, at = hashlib.sha256(), 0
        spans = [(a, min(b, len(text))) for a, b in spans if a < len(text)]
        for a, b in spans:
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        return len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return without_repeats(docs, ByteUnits(width), report, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>", ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"], [pa.int64()] * 3 + [pa.string(), kind])
