"""Periodic runs of words by heavy/light lag counting, and their collapse.

How often words ``q`` places apart agree is counted for every lag q at once: exactly, by one FFT
autocorrelation of the indicator vectors of frequent words, and by the differences of the places of rare ones. A run of
period q has at least max(q, 12 - q) such places in a row, so only lags with that many matches get an island scan. What
runs of a divisor of q account for is taken off first, so multiples of a period are never scanned for it.

Each document is worked on by itself, in the task that reads it: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Lags above this are first probed at this many grid points for each lag's length.
PROBES = 32
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), "i4", len(words))


def lag_counts(x: np.ndarray, heavy: int | None = None) -> np.ndarray:
    """How many i have x[i] == x[i + q], for each lag q from 0 to n // 2.

    Words that occur more than ``heavy`` times are counted by FFT (their power spectra are summed, so there is one inverse transform, and
    the sums, at most n, are rounded to the exact integers); all pairs of the others lie among the next ``heavy`` places of the same word.
    """
    n = len(x)
    most = n // 2
    counts = np.zeros(most + 1, "i8")
    counts[0] = n
    if most < 1:
        return counts
    if heavy is None:
        heavy = max(16, int(n**0.5) // 2)
    times = np.bincount(x)
    frequent = np.flatnonzero(times > heavy)
    if len(frequent):
        size = 1 << int(n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for w in frequent:
            s = np.fft.rfft(x == w, size)
            power += s.real**2 + s.imag**2
        counts[1:] += np.rint(np.fft.irfft(power, size)[1 : most + 1]).astype("i8")
    places = np.flatnonzero((times[x] > 1) & (times[x] <= heavy))
    places = places[np.argsort(x[places], kind="stable")]
    word = x[places]
    k = 1
    at = np.arange(len(places) - 1)
    while len(at):
        at = at[at + k < len(places)]
        at = at[word[at] == word[at + k]]
        lag = places[at + k] - places[at]
        near = lag <= most
        counts += np.bincount(lag[near], minlength=most + 1)
        at = at[near]
        k += 1
    return counts


def _streaks(flags: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view("i1"), [0]))))
    long = edges[1::2] - edges[::2] >= least
    return zip(edges[::2][long].tolist(), edges[1::2][long].tolist(), strict=True)


def islands(x: np.ndarray, q: int, least: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the maximal stretches of i with x[i] == x[i + q] of at least ``least``.

    Long stretches cover many points of a grid in a row, so only the surroundings of such points are read: a scan of lag q
    costs about PROBES * n / q, and all lags together n log n.
    """
    n = len(x) - q
    step = least // PROBES
    if step < 2:
        yield from _streaks(x[:n] == x[q:], least)
        return
    grid = x[:n:step] == x[q::step]
    done = 0
    for a, b in _streaks(grid, least // step - 1):
        lo, hi = max(done, (a - 1) * step + 1, 0), min(n, b * step)
        for c, d in _streaks(x[lo:hi] == x[lo + q : hi + q], least):
            yield lo + c, lo + d
        done = hi


def runs_of(x: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start, then period.

    A run is a stretch with smallest period q and length of at least max(least, 2 q) that no neighbour extends. A stretch of period q whose
    smallest period is another has one that divides q (Fine and Wilf), and equals that run; it has been found before, as lags rise.
    """
    counts = lag_counts(x)
    lags = np.arange(len(counts))
    need = np.maximum(lags, least - lags)
    found: set[tuple[int, int]] = set()
    out = []
    # Found runs only take matches off, so lags without enough of them to begin with never need a look.
    for q in (np.flatnonzero(counts[1:] >= need[1:]) + 1).tolist():
        if counts[q] < need[q]:
            continue
        for a, b in islands(x, q, int(need[q])):
            if (a, b - a + q) in found:
                continue
            length = b - a + q
            found.add((a, length))
            out.append((a, length, q))
            multiples = lags[2 * q : length : q]
            counts[multiples] -= length - multiples
    return sorted(out, key=lambda r: (r[0], r[2]))


def unrolled(x: np.ndarray, h: int | None) -> np.ndarray:
    """Places of the words after the contract's edit: from word a on, the words repeat with period p. None: unchanged."""
    n = len(x)
    place = np.arange(n)
    if h is None or h % 10 or not n:
        return place
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place[a:] = a + np.arange(n - a) % p
    return place


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, "i8")
    for s, length, q in runs:
        change[s + q] += 1
        change[s + length] -= 1
    return np.cumsum(change[:n]) == 0


def find_runs(docs: DataFrame, seed: Column | None = None, text: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed) for each row of ``docs``.

    The fields from start to exponent_milli are those of the longest run (ties: smallest start, then period), or null without one. ``runs`` has
    all runs as {start, length, period}, ``collapsed`` the words that stay, joined by single blanks. ``seed``, if given, is
    a whole number that decides an edit of the words before runs are sought (see ``unrolled``); where it is null the words stay.
    Null and blank texts have no words and no runs. Rows that repeat an id are documents of their own, a null id stays null, and other columns of
    ``docs``, whatever their names, are not read. An empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]

    def report(data: bytes | None, h: int | None) -> tuple:
        words = _WORDS(data or b"")
        x = numbered(words)
        place = unrolled(x, h)
        x = x[place]
        runs = runs_of(x)
        stay = place[collapsed(len(x), runs)] if runs else place
        joined = b" ".join([words[i] for i in stay.tolist()])
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return len(runs), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(joined).hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], joined.decode("utf-8", "replace")

    def work(batches):
        kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), kind, pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, 256):  # so that a batch of results stays small beside its texts
                part = b.slice(at, 256)
                rows = [report(t.as_py(), h) for t, h in zip(part.column(1).cast(pa.binary()), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    rows = docs.select("doc_id", F.col(text).cast("string").alias("__text"), (F.lit(None) if seed is None else seed).cast("long").alias("__seed"))
    return rows.mapInArrow(work, schema)
