"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum over all ways to cut it into pieces, found by a
forward pass over its bytes; a text's is the product over its words. A text's
language is the one that makes it most probable, and the score is that language's
share of all languages' probabilities.

Learning: expectation maximisation, with a backward pass for the expected number
of times each piece is used in each language's words. It reads a sample of about
``per_language`` labelled documents of each language, chosen by a hash of the id;
the sample's words are counted in Spark and their counts, bounded by the sample,
come to the driver.

Words are runs of letters, lower-cased. Distinct words are scored once in each
worker's memory, many at a time: an Aho-Corasick automaton lists all pieces found
in them and the forward pass goes over end positions; a very long word is cut into
runs that are solved side by side and put together, so its cost grows with its length.

Defined results: a null text, or one without letters, is ``und`` with score 0; so
is every text if no labelled text was given. A null id counts as the empty text
when documents are dealt to folds. Of equally probable languages the smallest
name wins. Repeated rows are judged each. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import append_columns, give_back, slices, tidy

WORDS = regex.compile(r"\p{L}+")
#: Labelled documents of each language that learning reads, about: the bound of its sample.
PER_LANGUAGE = 500
ROUNDS = 4
#: Words a worker remembers before it starts anew.
MEMORY = 200_000
CHUNK = 8_000
#: Words of so many bytes are scored one by one, in runs of RUN bytes of at most about SLAB bytes (for one language) at a time.
LONG, RUN, SLAB = 2048, 256, 1 << 17
#: Up to this longest piece the runs of a long word are solved side by side, for each value they may start from; beyond it one
#: after the other, as side by side costs the square of the length.
WIDE = 32
#: Words of more bytes don't teach: a bound of the sample, for hardly a word of a language is so long.
TEACH = 128
#: What smoothing adds: so many uses, spread as the pieces are used in all languages.
SMOOTHING = 200.0


def read_pieces(path: str) -> list[bytes]:
    """All pieces of a published vocabulary, and all single bytes."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted((pieces - {b""}) | {bytes([b]) for b in range(256)})


class Lattice:
    """All pieces in a list of words: which word, from where to where, which piece."""

    def __init__(self, automaton, sizes_of: np.ndarray, words: list[bytes]):
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.longest = int(self.sizes.max(initial=0))
        first = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]  # a separator follows each word
        joined = b"\x00".join(words).decode("latin-1")
        hits = np.fromiter(chain.from_iterable(automaton.iter(joined)), np.int64).reshape(-1, 2)
        word = np.searchsorted(first, hits[:, 0], side="right") - 1
        end = hits[:, 0] - first[word] + 1
        start = end - sizes_of[hits[:, 1]]
        ok = (start >= 0) & (end <= self.sizes[word])  # a piece with a separator lies outside
        self.word, self.start, self.end, self.piece = (a[ok].astype(np.int32) for a in (word, start, end, hits[:, 1]))

    def run(self, p: np.ndarray, backward: bool = False) -> np.ndarray:
        """log[word, position, language] of all segmentations up to a position, or from its end."""
        frm, to = (self.sizes[self.word] - self.end, self.sizes[self.word] - self.start) if backward else (self.start, self.end)
        order = np.lexsort((self.word, to))
        word, frm, piece = self.word[order], frm[order], self.piece[order]
        bounds = np.searchsorted(to[order], np.arange(self.longest + 2))
        log = np.zeros((len(self.sizes), self.longest + 1, p.shape[1]))
        for e in range(1, self.longest + 1):
            a, b = bounds[e], bounds[e + 1]
            if a == b:
                continue
            w = word[a:b]
            heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            before = log[w[heads], e - 1]
            gap = log[w, frm[a:b]] - np.repeat(before, np.diff(np.r_[heads, b - a]), axis=0)
            total = np.add.reduceat(p[piece[a:b]] * np.exp(np.clip(gap, -600, 600)), heads, axis=0)
            log[w[heads], e] = before + np.log(np.maximum(total, 1e-300))
        return log

    def log_probability(self, p: np.ndarray) -> np.ndarray:
        return self.run(p)[np.arange(len(self.sizes)), self.sizes]

    def expect(self, p: np.ndarray, counts: np.ndarray, used: np.ndarray) -> None:
        """Add the expected uses of each piece in the words, met ``counts`` times, to ``used``."""
        ahead, behind = self.run(p), self.run(p, backward=True)
        whole = ahead[np.arange(len(self.sizes)), self.sizes]
        share = np.exp(ahead[self.word, self.start] + behind[self.word, self.sizes[self.word] - self.end] - whole[self.word])
        share *= p[self.piece] * counts[self.word]
        for k in range(p.shape[1]):
            used[:, k] += np.bincount(self.piece, share[:, k], minlength=len(used))


def _solutions(a: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run the recursion f[e] = sum over l of a[e, l] f[e - l] for many runs at once.

    ``a``: run, step, language, length; ``state``: run, start, language, the values before, as many as the longest piece
    has bytes, the nearest first.
    Gives the last state, scaled, and the logarithms of the scales (run, language).
    """
    scale = np.zeros((a.shape[0], a.shape[2]))
    for t in range(a.shape[1]):
        new = np.einsum("cgl,cbgl->cbg", a[:, t], state)
        state = np.concatenate([new[..., None], state[..., :-1]], axis=3)
        if t % 8 == 7 or t == a.shape[1] - 1:
            most = np.maximum(state.max(axis=(1, 3)), 1e-300)
            state /= most[:, None, :, None]
            scale += np.log(most)
    return state, scale


def long_log_probability(automaton, sizes_of: np.ndarray, p: np.ndarray, word: bytes) -> np.ndarray:
    """log probability of one long word for each language: the forward pass over runs of ``RUN`` bytes side by side.

    A run is solved for each of the values it may start from, as many as the longest piece found in the word has bytes
    (over ``WIDE``: from the values it does start from), and the runs are put together one after the other.
    Memory is bounded by ``SLAB`` bytes of the word, whatever its length.
    """
    langs = p.shape[1]
    longest = _longest(automaton, sizes_of, word)
    state, total = np.zeros((langs, longest)), np.zeros(langs)
    state[:, 0] = 1.0
    slab = max(RUN, SLAB * 16 // max(langs * longest, 16) // RUN * RUN)
    for at in range(0, len(word), slab):
        n = min(slab, len(word) - at)
        runs = -(-n // RUN)
        a = np.zeros((runs * RUN, langs, longest))
        before = max(0, at - longest + 1)
        hits = _hits(automaton, word[before : at + n])
        end, size = hits[:, 0] + before, sizes_of[hits[:, 1]]
        ok = (end >= at) & (end + 1 - size >= 0)
        a[end[ok] - at, :, size[ok] - 1] = p[hits[ok, 1]]
        if longest > WIDE:
            solved, scale = _solutions(a[None, :n], state[None, None])
            state, total = solved[0, 0], total + scale[0]
            continue
        a = a.reshape(runs, RUN, langs, longest)
        last = n - (runs - 1) * RUN  # the last run may be shorter
        parts = [_solutions(a[: runs - 1], np.broadcast_to(np.eye(longest)[None, :, None, :], (runs - 1, longest, langs, longest)).copy())] if runs > 1 else []
        parts.append(_solutions(a[runs - 1 :, :last], np.eye(longest)[None, :, None, :].repeat(langs, axis=2)))
        for solved, scale in parts:
            for c in range(len(solved)):
                state = np.einsum("gb,bgl->gl", state, solved[c])
                most = np.maximum(state.max(axis=1), 1e-300)
                state /= most[:, None]
                total += np.log(most) + scale[c]
    return total + np.log(np.maximum(state[:, 0], 1e-300))


def _hits(automaton, part: bytes) -> np.ndarray:
    """(last byte, piece) of every piece in a part of a word."""
    return np.fromiter(chain.from_iterable(automaton.iter(part.decode("latin-1"))), np.int64).reshape(-1, 2)


def _longest(automaton, sizes_of: np.ndarray, word: bytes) -> int:
    """Bytes of the longest piece in a word, which is read in slabs that overlap by the longest piece of all."""
    overlap = int(sizes_of.max(initial=1)) - 1
    return max(int(sizes_of[_hits(automaton, word[max(0, at - overlap) : at + SLAB])[:, 1]].max(initial=1)) for at in range(0, len(word), SLAB))


class Model:
    def __init__(self, pieces: list[bytes], languages: list[str], p: np.ndarray | None = None):
        self.pieces, self.languages, self.p = pieces, languages, p
        self.automaton = ahocorasick.Automaton()
        for i, x in enumerate(pieces):
            self.automaton.add_word(x.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.sizes = np.array([len(x) for x in pieces], np.int64)
        self.index: dict[str, int] = {}
        self.log = np.zeros((0, len(languages)))

    def learn(self, words: list[bytes], counts: np.ndarray, rounds: int) -> None:
        """counts[word, language]: expectation maximisation from pieces in proportion to their letters' use."""
        n, langs = len(self.pieces), len(self.languages)
        lattices = [Lattice(self.automaton, self.sizes, words[i : i + CHUNK]) for i in range(0, len(words), CHUNK)]
        p = np.full((n, langs), 1.0 / n)
        for _ in range(rounds):
            used = np.zeros((n, langs))
            for k, lattice in enumerate(lattices):
                lattice.expect(p, counts[k * CHUNK : (k + 1) * CHUNK], used)
            everywhere = used.sum(axis=1, keepdims=True) + 0.01
            used += SMOOTHING * everywhere / everywhere.sum()
            p = used / used.sum(axis=0)
        self.p = p

    def known(self, words: set[str]) -> None:
        """Make sure that these words' log probabilities are at hand."""
        new = sorted(w for w in words if w not in self.index)
        if len(self.index) + len(new) > MEMORY and self.index:
            self.index, self.log = {}, np.zeros((0, len(self.languages)))
            new = sorted(words)
        by_size = sorted((w for w in new if len(w.encode()) < LONG), key=len)
        rows = [self.log]
        i = 0
        while i < len(by_size):
            size = min(CHUNK, max(1, 400_000 // (len(by_size[min(i + CHUNK, len(by_size)) - 1].encode()) + 2)))
            part = by_size[i : i + size]
            rows.append(Lattice(self.automaton, self.sizes, [b" " + w.encode() for w in part]).log_probability(self.p))
            for w in part:
                self.index[w] = len(self.index)
            i += size
        for w in new:
            if len(w.encode()) >= LONG:
                rows.append(long_log_probability(self.automaton, self.sizes, self.p, b" " + w.encode())[None, :])
                self.index[w] = len(self.index)
        self.log = np.vstack(rows)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [WORDS.findall(x.lower()) if x else [] for x in texts]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        self.known(set().union(*words))
        names, scores = [], []
        for w in words:
            if not w:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.log[np.fromiter(map(self.index.__getitem__, w), np.int64, len(w))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


_loaded: dict[str, Model] = {}


def _model(value) -> Model:
    key, pieces, languages, p = value
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(pieces, languages, p)
    return _loaded[key]


def _word_counts(batches):
    for whole in batches:
        counts: Counter = Counter()
        for text, lang in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True):
            counts.update((lang, w) for w in WORDS.findall((text or "").lower()) if len(w) <= TEACH)
        if counts:
            langs, words = zip(*counts, strict=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs), "word": pa.array(words), "n": pa.array(list(counts.values()), pa.int64())})


def fit(labelled: DataFrame, vocabulary: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """A model learned from ``labelled`` (doc_id, text, lang); null labels and texts don't count."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    pieces, languages = read_pieces(vocabulary), sorted(sizes)
    model = Model(pieces, languages, np.full((len(pieces), len(languages)), 1 / len(pieces)))
    if not languages:
        return model
    million = F.pmod(F.xxhash64(F.lit(6), F.col("doc_id").cast("string")), F.lit(1_000_000))
    limit = F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, F.lit(1_000_000 * per_language // n + 1)).otherwise(limit)
    sample = labelled.where(million < limit).select("text", "lang")
    rows = sample.mapInArrow(tidy(_word_counts), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    words = sorted(set(rows["word"]), key=lambda w: (len(w.encode()), w))
    at, col = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(words), len(languages)))
    counts[rows["word"].map(at).to_numpy(int), rows["lang"].map(col).to_numpy(int)] = rows["n"].to_numpy(float)
    model.learn([b" " + w.encode() for w in words], counts, rounds)
    del rows, words, at, counts
    give_back()  # else the driver keeps what learning took, beside all that follows
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred string and score double; a column of either name is replaced."""
    key = hashlib.sha256(repr(model.languages).encode() + model.p.tobytes()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((key, model.pieces, model.languages, model.p))
    out = append_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    kept = [f.name for f in out.fields[:-2]]

    def run(batches):
        m = _model(shared.value)
        for whole in batches:
            for batch in slices(whole, text, 2 << 20):
                names, scores = m.score(batch.column(batch.schema.get_field_index(text)).to_pylist())
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in out.fields])

    return docs.mapInArrow(tidy(run, "language", _loaded.clear), out)
