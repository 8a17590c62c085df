"""Substring dedup: word windows by super-k-mer partitioning, counted by sorting."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import mixed, run_hashes, without_repeats

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


class WordUnits:
    """Words as units; super-k-mers are words joined by single blanks as they stand in the text."""

    def __init__(self, width: int = 20, gram: int = 8):
        self.width, self.gram = width, min(gram, width)

    def cut(self, text: bytes, most: int) -> Iterator[tuple[int, bytes]]:
        blank = _BLANK[np.frombuffer(text, "u1")]
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        first = 0
        while first < len(starts):
            last = max(int(np.searchsorted(starts, starts[first] + most)), first + self.width)
            stop = last + self.width - 1
            yield first, text[starts[first] : starts[stop] if stop < len(starts) else len(text)]
            if stop >= len(starts):
                return
            first = last

    def units(self, data: np.ndarray, edges: np.ndarray):
        blank = _BLANK[data]
        before = np.concatenate(([True], blank[:-1]))
        inner = edges[1:-1]
        before[inner[inner < len(data)]] = True
        starts = np.flatnonzero(~blank & before)
        after = np.concatenate((blank[1:], [True]))
        after[inner[inner > 0] - 1] = True
        ends = np.flatnonzero(~blank & after) + 1
        words = run_hashes(data, starts, ends) if len(data) else np.zeros(0, "u8")
        n = len(words)
        grams = np.zeros(n, "u8")
        for k in range(self.gram):
            grams[: n - k] = grams[: n - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:] if n > k else 0
        return mixed(grams), starts, ends, np.searchsorted(starts, edges)

    def resolve(self, contents: list[bytes], owners: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        windows = []
        for i, c in enumerate(contents):
            w = _WORDS(c)
            windows += [(b" ".join(w[k : k + self.width]), owners[i][0], owners[i][1] + k, i, k) for k in range(len(w) - self.width + 1)]
        windows.sort()
        out: dict[int, list[int]] = {}
        head = None
        for x in windows:
            if head is None or x[0] != head[0]:
                head = x
            elif x[1:3] != head[1:3]:
                out.setdefault(x[3], []).append(x[4])
        for i, places in out.items():
            for k in places:
                yield i, k, k


def drop_repeated_windows(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): words covered by a window of ``width`` words whose words
    also start earlier are removed; the rest is joined by single blanks.

    Words are runs of other characters than blanks, unchanged. A null text has no words. See
    ``repeats`` for how rows that share an id count.
    """

    def report(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        w = _WORDS(text)
        kept, at = [], 0
        for a, b in spans:
            kept += w[at:a]
            at = b
        kept += w[at:]
        joined = b" ".join(kept)
        return len(w), len(w) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace")

    return without_repeats(docs, WordUnits(width), report, "n_words long, n_removed long, kept_sha256 string, kept string", ["n_words", "n_removed", "kept_sha256", "kept"], [pa.int64(), pa.int64(), pa.string(), pa.string()])
