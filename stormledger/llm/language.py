"""Language identification by segmentation-marginalised unigrams.

A word is a blank and a run of letters, lower-cased, in UTF-8. Each language has a probability for each piece of a fixed public
vocabulary of byte strings, which has all single bytes, so every word has segmentations. The likelihood of a word
is the sum over all its segmentations, found by the forward algorithm; a text's is the product over its words. The
piece probabilities are trained here, by expectation maximisation with the forward-backward algorithm over counted words.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: About so many training rows of each language lend their words to the fit (those with the smallest hashes of id and text);
#: class sizes are counted over all rows.
MOST_TRAINING_ROWS = 4_000
ROUNDS = 3
#: Weight of the pieces' distribution over all languages in each language's, in pieces; and of the uniform one in that.
PRIOR, FLAT = 300.0, 2_000.0
#: Words of at most so many bytes are worked on side by side.
SHORT = 40
#: Words whose likelihoods a task keeps; then it starts over.
KEPT_WORDS = 400_000
UNKNOWN = "und"
_FIXED = 1 << 16
#: More bytes than any piece has.
_SPAN = 1 << 12
_RUNS = re.compile(r"[^\W\d_]+").findall


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a public byte-level vocabulary that can stand in a word: of no more than a few megabytes, read by the driver.

    Each line has a piece in base64 and its rank. Pieces with other ASCII than lower-case letters after one optional blank are left out, single bytes stay.
    """
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    fit = re.compile(rb"\x20?[a-z\x80-\xff]+").fullmatch
    return sorted({p for p in pieces if fit(p)} | {bytes([b]) for b in range(256)})


def words_in(text: str | None) -> Counter:
    """How often each run of letters occurs in a whole text, lower-cased and composed (NFC).

    Runs of characters that count as letters or numerals are taken; those without any letter are left out.
    """
    if not text:
        return Counter()
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    found = Counter(_RUNS(text.lower()))
    if not text.isascii():
        for w in [w for w in found if not any(map(str.isalpha, w))]:
            del found[w]
    return found


class Lattice:
    """All segmentations of some words: arcs (word, begin, end, piece) in order of their ends."""

    def __init__(self, finder, words: list[str]):
        raw = [b" " + w.encode("utf-8", "replace") for w in words]
        self.size = np.array([len(r) for r in raw], "i8")
        # A character that no piece has parts the words.
        line = "Ā".join(r.decode("latin-1") for r in raw)
        first = np.concatenate(([0], np.cumsum(self.size + 1)))[:-1]
        end, found = np.fromiter(chain.from_iterable(finder.iter(line)), "i8").reshape(-1, 2).T
        piece, size = found // _SPAN, found % _SPAN
        self.word = np.searchsorted(first, end, "right") - 1
        self.end = end + 1 - first[self.word]
        self.begin = self.end - size
        self.piece = piece
        order = np.lexsort((self.word, self.end))
        self.word, self.begin, self.end, self.piece = self.word[order], self.begin[order], self.end[order], self.piece[order]

    def forward(self, log_weight: np.ndarray) -> np.ndarray:
        """Logarithm of the summed weights of all segmentations of each word; ``log_weight`` has a row for each arc and any number of columns.

        Sums stay logarithms throughout, so that words of any length neither vanish nor overflow.
        """
        return self._ahead(log_weight)[self.size, np.arange(len(self.size))]

    def _ahead(self, log_weight: np.ndarray) -> np.ndarray:
        """Logarithm of the summed weights of the ways to each place of each word."""
        most = int(self.size.max(initial=0))
        ahead = np.zeros((most + 1, len(self.size), log_weight.shape[1]))
        edges = np.searchsorted(self.end, np.arange(most + 2))
        for e in range(1, most + 1):
            s = slice(edges[e], edges[e + 1])
            w = self.word[s]
            heads, total = _log_sums(w, ahead[self.begin[s], w] + log_weight[s])
            ahead[e, w[heads]] = total
        return ahead

    def expected(self, log_weight: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each arc is taken, on average over the segmentations by weight, times how often each word occurs."""
        most, every = int(self.size.max(initial=0)), np.arange(len(self.size))
        ahead = self._ahead(log_weight[:, None])[:, :, 0]
        after = np.zeros((most + 1, len(self.size)))  # the ways from each place to the word's end
        by = np.lexsort((self.word, self.begin))
        edges = np.searchsorted(self.begin[by], np.arange(most + 2))
        for b in range(most - 1, -1, -1):
            arcs = by[edges[b] : edges[b + 1]]
            w = self.word[arcs]
            heads, total = _log_sums(w, (after[self.end[arcs], w] + log_weight[arcs])[:, None])
            after[b, w[heads]] = total[:, 0]
        share = ahead[self.begin, self.word] + log_weight + after[self.end, self.word] - ahead[self.size, every][self.word]
        return np.exp(share) * times[self.word]


def _log_sums(word: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, logarithms of the sums) of the runs of equal words, of values given as logarithms."""
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    if not len(heads):
        return heads, x[:0]
    top = np.maximum.reduceat(x, heads, axis=0)
    spans = np.diff(np.append(heads, len(word)))
    return heads, top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, spans, axis=0)), heads, axis=0))


@lru_cache(maxsize=2)
def _finder(pieces: tuple[bytes, ...]):
    found = ahocorasick.Automaton()
    for i, p in enumerate(pieces):
        found.add_word(p.decode("latin-1"), i * _SPAN + len(p))
    found.make_automaton()
    return found


def by_size(words: list[str]) -> list[np.ndarray]:
    """Places of the words in sets of similar size: many short ones together, long ones by themselves."""
    size = np.array([len(w.encode("utf-8", "replace")) for w in words], "i8")
    order = np.argsort(size, kind="stable")
    short = order[size[order] <= SHORT]
    sets = [short[i : i + 4096] for i in range(0, len(short), 4096)]
    return sets + [np.array([i]) for i in order[len(short) :]]


@dataclass
class Languages:
    """What was learned: names in order, log priors, and a probability of each piece for each language."""

    pieces: tuple[bytes, ...]
    names: list[str]
    prior: np.ndarray
    log_share: np.ndarray  # (pieces, languages)
    seen: dict[str, int] = field(default_factory=dict)  # rows of ``known``
    known: list[np.ndarray] = field(default_factory=list)

    def word_likelihoods(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word under each language."""
        out = np.zeros((len(words), len(self.names)))
        for places in by_size(words):
            lattice = Lattice(_finder(self.pieces), [words[i] for i in places])
            out[places] = lattice.forward(self.log_share[lattice.piece])
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text; ``und`` and 0 for texts without letters, or if no language was learned."""
        counted = [words_in(t) if self.names else Counter() for t in texts]
        if len(self.seen) > KEPT_WORDS:
            self.seen.clear()
            self.known.clear()
        new = list({w for c in counted for w in c if w not in self.seen})
        if new:
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new)), strict=True))
            self.known = [np.concatenate([*self.known, self.word_likelihoods(new)])]
        out = []
        for c in counted:
            if not c:
                out.append((UNKNOWN, 0.0))
                continue
            rows = np.fromiter(map(self.seen.__getitem__, c), "i8", len(c))
            log = self.prior + np.fromiter(c.values(), "f8", len(c)) @ self.known[0][rows]
            odds = np.exp(log - log.max())
            best = int(log.argmax())
            out.append((self.names[best], float(odds[best] / odds.sum())))
        return out


def fit(docs: DataFrame, train, vocabulary: str = VOCABULARY, most_rows: int = MOST_TRAINING_ROWS, rounds: int = ROUNDS) -> Languages:
    """Piece probabilities of each language from the training rows that have a language.

    The words of about ``most_rows`` rows of each language are counted, and each round sums the expected uses of each piece over all
    segmentations. The sums are whole numbers (in 65536ths), so they don't depend on the order of tasks. What comes to
    the driver is a row for each language and piece.
    """
    pieces = tuple(read_vocabulary(vocabulary))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(train & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Languages(pieces, [], np.zeros(0), np.zeros((len(pieces), 0)))
    total = sum(sizes.values())
    prior = np.log([(sizes[k] + 1) / (total + len(names)) for k in names])
    number = {k: i for i, k in enumerate(names)}
    taken = F.lit(False)
    for k, n in sizes.items():
        if n > most_rows:
            taken = taken | ((F.col("lang") == k) & (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) < int(most_rows / n * (1 << 53))))
    whole = [k for k, n in sizes.items() if n <= most_rows]
    sample = rows.where(taken | F.col("lang").isin(whole) if whole else taken)

    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in words_in(t).items():
                    held[number[k], w] += n
                if len(held) > KEPT_WORDS:
                    yield from packed(held)
                    held = Counter()
        yield from packed(held)

    def packed(held):
        keys = list(held)
        for i in range(0, len(keys), 20_000):
            part = keys[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], "int32"), pa.array([w for _, w in part]), pa.array([held[x] for x in part], "int64")], ["k", "word", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "k int, word string, n long").groupBy("k", "word").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "words")
    log_share = np.full((len(pieces), len(names)), -np.log(len(pieces)))
    for _ in range(rounds):
        model = docs.sparkSession.sparkContext.broadcast((pieces, log_share))

        def expect(batches, model=model):
            pieces, log_share = model.value
            sums = np.zeros(log_share.shape)
            for b in batches:
                k, words, n = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
                for places in by_size(words):
                    lattice = Lattice(_finder(pieces), [words[i] for i in places])
                    mine = k[places][lattice.word]
                    uses = lattice.expected(log_share[lattice.piece, mine], n[places].astype("f8"))
                    # Rounded for each word, so that how words fall into batches doesn't matter.
                    np.add.at(sums, (lattice.piece, mine), np.rint(uses * _FIXED))
            p, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k, "int32"), pa.array(p, "int32"), pa.array(sums[p, k].astype("i8"))], ["k", "p", "n"])

        found = counted.mapInArrow(expect, "k int, p int, n long").groupBy("k", "p").agg(F.sum("n").alias("n")).toArrow()
        model.unpersist()
        uses = np.zeros(log_share.shape)
        uses[found["p"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy() / _FIXED
        pooled = uses.sum(1, keepdims=True) + FLAT / len(pieces)
        log_share = np.log((uses + PRIOR * pooled / pooled.sum()) / (uses.sum(0) + PRIOR))
    return Languages(pieces, names, prior, log_share)


def identify(docs: DataFrame, fold: tuple[int, int] = (4, 2), vocabulary: str = VOCABULARY, most_rows: int = MOST_TRAINING_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``.

    Rows whose id falls in the held-out fold (a null id counts as empty text) and rows without a language teach nothing. The score is the
    probability of the predicted language, given the whole text; ties go to the language first by name. A null text, or one without a letter, is
    ``und`` with score 0, and so is every text if no language was learned, as from an empty table. Rows that repeat an id are
    judged each; columns of other names are not read. A language takes 8 bytes for each piece, about 300 kB, in the model that is broadcast.
    """
    held = bucket_of(F.col("doc_id"), fold[0]) == fold[1]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, ~held, vocabulary, most_rows, rounds))

    def judge(batches):
        m = model.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = m.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([k for k, _ in got], "string"), pa.array([s for _, s in got], "float64")], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
