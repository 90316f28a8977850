"""A gated recurrent language model in numpy, and the scoring of documents with it.

Model. A GRU reads a document token by token; its output is factored by classes:
P(token) = P(class | state) * P(token | class, state). The most frequent words (the
shortlist) have classes of about equal square-root mass, with a softmax over the
class's words from the state. All other words have the class of their last two
bytes, or one rest class; within it a word has its share of the class's counts over
the whole corpus, after a part for words never met, as large as the class's share of
words met once (Good and Turing). So every word has a probability, and only the
shortlist, the class totals and the weights (all of fixed size) go to the workers.

Learning. Counts cover every training document, and so does learning: the weights are
learned by truncated backpropagation through windows of ``WINDOW`` tokens, with the state
carried from one window to the next within a document. A hash deals the documents to
rounds and replicas, each document to one and once, whatever the corpus's size; after each
round the replicas' weights are averaged in a tree of fixed fan-in. The number of replicas
is the square root of that of spans of ``PER_REPLICA`` tokens, so both it and the gradient
steps in sequence grow with the corpus.

Scoring. Documents run side by side in lanes, the state carried through windows to the
document's end, so a score is the whole document's log-likelihood. Words beyond the
``HEAD`` most frequent are looked up by a join with the table of counts.

Defined results: a null text is the empty text: one token, its end; unknown words count as
the base formula says; repeated rows are scored each; an empty table gives no rows; without
training documents all counts are zero. Only doc_id and text are read; other columns pass.
"""

from __future__ import annotations

import copy
import hashlib
import heapq
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import slices, tidy, without
from weftgraph.session import cut_table, ship

#: Words whose counts the workers hold; words in the shortlist; classes of the shortlist and of the rest.
HEAD, SHORT, SHORT_CLASSES, SUFFIX_CLASSES = 1 << 18, 2048, 32, 96
HIDDEN, WINDOW, LANES, SCORE_WINDOW, SCORE_LANES = 32, 24, 64, 16, 256
PER_REPLICA, ROUNDS, RATE = 500_000, 4, 0.01
#: Sets of weights that one task, or the driver, adds up at a time.
FAN_IN = 8
#: Tokens that a worker scores together, and words that it counts before it passes the counts on.
TOGETHER, COUNTED = 4_000_000, 400_000
LOG10 = np.log(10.0)
#: Rows of logits that are worked on at a time: they stay in a core's cache.
ROWS = 1024
#: Weights that a step moves at a time, and rows of input weights: with their moments and gradients they stay in a core's cache too.
BLOCK, IN_ROWS = 4096, 48
#: Of an input met at least so often in a window the gradients are summed apart.
OFTEN = 6
#: Bytes of text whose words are looked up at once.
TEXT = 4 << 20


class Codes:
    """What the workers know of the vocabulary, all of bounded size.

    Input codes: 0 is a document's begin, 1 its end, then the shortlist, then the classes
    of other words. Targets: the class, and the place in the shortlist or -1.
    """

    def __init__(self, head: dict[bytes, int], ends: int, suffixes: list[tuple[bytes, int, int, int]]):
        """``suffixes``: last two bytes, tokens, words met once and words, of all words."""
        ranked = sorted(head, key=lambda w: (-head[w], w))
        words = ranked[:SHORT]
        counts = np.array([ends, *[head[w] for w in words]], np.float64)
        mass = np.sqrt(np.maximum(counts[1:], 1))
        share = np.cumsum(mass) / max(mass.sum(), 1) if len(words) else np.empty(0)
        cls = np.minimum((share * SHORT_CLASSES).astype(int), SHORT_CLASSES - 1)
        _, cls = np.unique(cls, return_inverse=True) if len(words) else (0, cls)
        self.class_of = np.concatenate([[0], cls + 1]).astype(np.int64)  # the end is a class of its own
        n = int(self.class_of.max()) + 1
        # words of the shortlist count in their own class, not in their suffix's
        total, once = Counter(), Counter()
        for s, tokens, single, _ in suffixes:
            total[s], once[s] = tokens, single
        for w in words:
            total[w[-2:]] -= head[w]
            once[w[-2:]] -= head[w] == 1
        kept = [s for s, c in sorted(total.items(), key=lambda x: (-x[1], x[0])) if c > 0][:SUFFIX_CLASSES]
        self.suffix = {s: n + i for i, s in enumerate(kept)}
        self.rest = n + len(kept)
        # the same by the last two bytes as a number; words of one byte have numbers of their own
        self.by_tail = np.full((1 << 16) + 256, self.rest, np.int32)
        for x, c in self.suffix.items():
            self.by_tail[int.from_bytes(x, "big") + (len(x) == 1 and 1 << 16)] = c
        self.n_classes = self.rest + 1
        self.class_total, class_once = np.zeros(self.n_classes), np.zeros(self.n_classes)
        for s, c in total.items():
            self.class_total[self.suffix.get(s, self.rest)] += c
            class_once[self.suffix.get(s, self.rest)] += once[s]
        self.class_count = self.class_total.copy()
        np.add.at(self.class_count, self.class_of, counts)
        unseen = np.clip((class_once + 0.5) / (self.class_total + 1.0), 1e-6, 0.9)
        # log10 of what a word's share of its class is made of: for a word never met, and per count
        self.log_unseen = np.log10(unseen)
        self.log_per_count = np.log10((1 - unseen) / np.maximum(self.class_total, 1))
        self.counts = counts
        self.n_in = 2 + len(words) + (self.n_classes - n)
        self.n_short_classes = n
        edges = np.searchsorted(self.class_of, np.arange(n + 1)).tolist()  # classes follow the shortlist's order
        self.members = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

        # of each word of the head: its code, log10 of its count plus one, and log10 of its share of its class
        self.words = pa.array(ranked, pa.binary()).cast(pa.string())
        count = np.array([head[w] for w in ranked], np.float64)
        self.code = np.array([i + 1 if i < SHORT else -self.word_class(w) for i, w in enumerate(ranked)], np.int32)
        self.base = np.log10(count + 1)
        self.static = np.where(self.code > 0, 0, np.log10(np.maximum(count, 1)) + self.log_per_count[np.maximum(-self.code, 0)])

    def small(self) -> Codes:
        """What learning and scoring need of it, without the words."""
        out = copy.copy(self)
        for name in ("words", "code", "base", "static", "suffix", "by_tail"):
            delattr(out, name)
        return out

    def word_class(self, w: bytes) -> int:
        return self.suffix.get(w[-2:], self.rest)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words: places in the shortlist, or minus the class; and the words' places in the head, or -1."""
        place = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        codes = self.code[place] if len(self.code) else np.zeros(len(words), np.int32)
        beyond = np.flatnonzero(place < 0)
        if len(beyond):
            _, offsets, data = words.take(pa.array(beyond)).buffers()
            ends = np.frombuffer(offsets, np.int32)[: len(beyond) + 1]
            letters = np.frombuffer(data, np.uint8)
            last, size = ends[1:], np.diff(ends)
            tail = letters[last - 1].astype(np.int32) + np.where(size > 1, letters[np.maximum(last - 2, 0)].astype(np.int32) << 8, 1 << 16)
            codes[beyond] = -self.by_tail[tail]
        return codes, place


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, and where each text's words begin; the last bound is their number."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    real = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end leaves an empty piece
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), before[bounds - bounds[0]]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between the bounds."""
    out = np.add.reduceat(np.append(values, 0.0), bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    out[bounds[1:] == bounds[:-1]] = 0
    return out


def initial(codes: Codes, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    return {
        "x": rng.normal(0, 0.1, (codes.n_in, 3 * h)).astype(np.float32),
        "u": (rng.normal(0, 1, (h, 3 * h)) / np.sqrt(h)).astype(np.float32),
        "b": np.zeros(h, np.float32),
        "wc": np.zeros((h, codes.n_classes), np.float32),
        "bc": np.log(codes.class_count + 1).astype(np.float32),
        "wo": np.zeros((len(codes.counts), h), np.float32),
        "bo": np.log(codes.counts + 1).astype(np.float32),
    }


class Lanes:
    """Documents side by side: each lane is a row of documents, the longest lanes first."""

    def __init__(self, docs: list[np.ndarray], lanes: int, codes: Codes):
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        lanes = max(1, min(lanes, len(docs)))
        heap = [(0, i) for i in range(lanes)]
        rows: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-sizes, kind="stable"):
            load, i = heapq.heappop(heap)
            rows[i].append(int(d))
            heapq.heappush(heap, (load + int(sizes[d]), i))
        loads = [sum(int(sizes[d]) for d in r) for r in rows]
        order = sorted(range(lanes), key=lambda i: -loads[i])
        #: Steps of each lane, and where it begins in ``told``.
        self.sizes = np.array([loads[i] for i in order])
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: The documents in the order of their lanes, and where each begins.
        self.placed = np.array([d for i in order for d in rows[i]], np.int64)
        self.begins = np.cumsum(sizes[self.placed]) - sizes[self.placed]
        end = np.zeros(1, np.int16)
        #: All that is to be told, lane after lane, as codes: each document's words and then 0, its end.
        self.told = np.concatenate([part for d in self.placed for part in (docs[d], end)]) if len(docs) else end[:0]
        self.codes = codes

    def windows(self, window: int, named: bool = True):
        """(inputs, targets, doc) of each window, for the lanes that go on through some of it; with whether a step is one.
        Without ``named`` doc is None.

        Only a window is laid out: a document much longer than the others takes no place in their lanes.
        """
        n_short = len(self.codes.counts)
        for a in range(0, int(self.sizes.max(initial=0)), window):
            lanes = int((self.sizes > a).sum())
            step = np.arange(a, min(a + window, int(self.sizes[0])))[:, None]
            real = step < self.sizes[None, :lanes]
            at = self.starts[None, :lanes] + np.minimum(step, self.sizes[None, :lanes] - 1)
            target = np.where(real, self.told[at], 0).astype(np.int32)
            before = np.where(at > 0, self.told[at - 1], 0).astype(np.int32)
            read = np.where(before > 0, before + 1, n_short + 1 - before - self.codes.n_short_classes)
            inputs = np.where(real & (before != 0), read, 0).astype(np.int32)  # after an end a document begins
            yield inputs, target, self.placed[np.searchsorted(self.begins, at, "right") - 1] if named else None, real


def states(p: dict, inputs: np.ndarray, h: np.ndarray, keep: bool = False):
    """The states before each target, and the last; with ``keep``, what backpropagation needs: of each step the state
    before, the gates beside the candidate's recurrent part, and the candidate."""
    n = HIDDEN
    # both gates and the candidate's part lie one after the other, each in one piece
    x = p["x"].reshape(-1, 3, n).transpose(1, 0, 2)[:, inputs]
    u = np.ascontiguousarray(p["u"].reshape(n, 3, n).transpose(1, 0, 2))
    np.negative(x[:2], out=x[:2])  # a gate is 1 / (1 + exp(-a)): both terms of a with their sign turned
    np.negative(u[:2], out=u[:2])
    steps, lanes = inputs.shape
    out = np.empty((steps, lanes, n), x.dtype)
    before, parts, cs = np.empty((steps if keep else 0, lanes, n), x.dtype), np.empty((steps if keep else 1, 3, lanes, n), x.dtype), np.empty((steps if keep else 1, lanes, n), x.dtype)
    begins = inputs == 0
    any_begin = begins.any(axis=1)
    h = h.astype(x.dtype, copy=False)
    for t in range(steps):
        if any_begin[t]:
            h = np.where(begins[t][:, None], x.dtype.type(0), h)
        at = t if keep else 0
        part, c, new = parts[at], cs[at], out[t]
        np.matmul(h, u, out=part)
        gates, un = part[:2], part[2]
        gates += x[:2, t]
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        un += p["b"]
        np.multiply(gates[1], un, out=c)
        c += x[2, t]
        np.tanh(c, out=c)
        if keep:
            before[t] = h
        np.subtract(h, c, out=new)
        new *= gates[0]
        new += c
        h = new
    return out, h, (before, parts, cs)


def _shifted(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """Biases less their largest, and whether logits so made need no other shift: states lie within -1 and 1,
    so a logit is within the sum of its weights' sizes from its bias, and the largest bias is 0."""
    return b - b.max(), float(np.abs(w).sum(axis=0).max()) < 40


def _shifted_words(p: dict, codes: Codes) -> tuple[np.ndarray, bool]:
    """The same for the words of all classes of the shortlist, each less its class's largest."""
    most = np.maximum.reduceat(p["bo"], [m.start for m in codes.members])
    return p["bo"] - most[codes.class_of], float(np.abs(p["wo"]).sum(axis=1).max()) < 40


def _softmax(logits: np.ndarray, told: np.ndarray, safe: bool, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The log probability of the columns ``told``; with ``whole`` also the gradient, all probabilities less 1 at ``told``,
    made in place of ``logits``."""
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    flat, at = logits.reshape(-1), np.arange(0, logits.size, logits.shape[1]) + told
    log = flat[at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    if whole:
        logits *= (1 / total)[:, None]
        flat[at] -= 1
    return logits, log - np.log(total)


def _summed_rows(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``of``, and for each the sum of its rows of ``x``."""
    order = np.argsort(of.astype(np.int16), kind="stable")
    ordered, rows = of[order], x.take(order, axis=0)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[starts, len(ordered)])
    out = rows.take(starts, axis=0)
    some = np.flatnonzero(sizes > 1)
    for i in some[sizes[some] >= OFTEN].tolist():
        np.add.reduce(rows[starts[i] : starts[i] + sizes[i]], axis=0, out=out[i])
    some = some[sizes[some] < OFTEN]
    for k in range(1, OFTEN - 1):
        some = some[sizes[some] > k]
        out[some] += rows.take(starts[some] + k, axis=0)
    return ordered[starts], out


def _step(p: np.ndarray, m: np.ndarray, v: np.ndarray, x: np.ndarray, scale: float, step: float) -> None:
    """Adam's step of the weights ``p``, with their moments, by ``scale`` times the gradient ``x``; in place, ``x`` too."""
    x *= scale
    change = x - m
    change *= 0.1
    m += change
    x *= x
    x -= v
    x *= 0.001
    v += x
    np.sqrt(v, out=x)
    x += 1e-6
    np.divide(m, x, out=x)
    x *= step
    p -= x


def _class_of(codes: Codes, target: np.ndarray) -> np.ndarray:
    return np.where(target >= 0, codes.class_of[np.maximum(target, 0)], -target)


def _by_class(codes: Codes, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
    """An order of the targets by class; and, for each class of two words or more that is met, its words and its place in that order."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(codes.n_short_classes + 1)).tolist()
    return order, [(m, slice(a, b)) for m, a, b in zip(codes.members, bounds, bounds[1:], strict=False) if b > a and m.stop - m.start > 1]


def token_logs(p: dict, codes: Codes, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of P(class) for words beyond the shortlist, of P(word) for the shortlist."""
    cls = _class_of(codes, target)
    bias, safe = _shifted(p["wc"], p["bc"])
    out = np.empty(len(cls), h.dtype)
    for i in range(0, len(cls), ROWS):
        logits = h[i : i + ROWS] @ p["wc"]
        logits += bias
        out[i : i + ROWS] = _softmax(logits, cls[i : i + ROWS], safe)[1]
    order, met = _by_class(codes, cls)
    if met:
        bias, safe = _shifted_words(p, codes)
        order = order[: met[-1][1].stop]
        sorted_h, told, logs = h[order], target[order], np.zeros(len(order), out.dtype)
        for words, rows in met:
            inner = sorted_h[rows] @ p["wo"][words].T
            inner += bias[words]
            logs[rows] = _softmax(inner, told[rows] - words.start, safe)[1]
        out[order] += logs
    return out


class Learner:
    """Truncated backpropagation with Adam steps."""

    def __init__(self, p: dict, codes: Codes, moments=None):
        self.codes = codes
        # all but the inputs' weights move in every step: they, their moments and gradients lie in one piece each
        self.dense = [k for k in p if k != "x"]
        self.p, self.flat_p = self._laid_out(p)
        zeros = {k: np.zeros_like(x) for k, x in p.items()}
        m, v, self.steps = moments or (zeros, zeros, 0)
        (self.m, self.flat_m), (self.v, self.flat_v), (self.g, self.flat_g) = self._laid_out(m), self._laid_out(v), self._laid_out(zeros)

    def _laid_out(self, parts: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        flat = np.concatenate([parts[k].reshape(-1) for k in self.dense])
        ends = np.cumsum([parts[k].size for k in self.dense]).tolist()
        return {"x": parts["x"].copy()} | {k: flat[b - parts[k].size : b].reshape(parts[k].shape) for k, b in zip(self.dense, ends, strict=True)}, flat

    def learn(self, docs: list[np.ndarray], rate: float) -> float:
        lanes = Lanes(docs, LANES, self.codes)
        h = np.zeros((len(lanes.sizes), HIDDEN), np.float32)
        lost, seen = 0.0, 0
        for inputs, targets, _, real in lanes.windows(WINDOW, named=False):
            h = h[: inputs.shape[1]]
            h, loss = self.window(inputs, targets, real, h, rate)
            lost, seen = lost + loss, seen + int(real.sum())
        return lost / max(seen, 1)

    def window(self, inputs, targets, real, h, rate):
        p, codes, n = self.p, self.codes, HIDDEN
        out, last, saved = states(p, inputs, h, keep=True)
        flat, target = out.reshape(-1, n), targets.reshape(-1)
        some = None if real.all() else np.flatnonzero(real.reshape(-1))  # at the lanes' ends
        if some is not None:
            flat, target = flat[some], target[some]
        count = max(len(target), 1)
        cls = _class_of(codes, target)
        bias, safe = _shifted(p["wc"], p["bc"])
        ones, loss = np.ones(len(cls), out.dtype), 0.0
        g = self.g
        self.flat_g.fill(0)
        dh, back_wc = np.empty_like(flat), np.ascontiguousarray(p["wc"].T)
        for i in range(0, len(cls), ROWS):
            rows, own = flat[i : i + ROWS], cls[i : i + ROWS]
            logits = rows @ p["wc"]
            logits += bias
            d, log = _softmax(logits, own, safe, True)
            loss -= float(log.sum())
            g["wc"] += rows.T @ d
            g["bc"] += ones[: len(own)] @ d
            np.matmul(d, back_wc, out=dh[i : i + ROWS])
        order, met = _by_class(codes, cls)
        if met:
            bias, safe = _shifted_words(p, codes)
            order = order[: met[-1][1].stop]
            sorted_h, told, inner_dh, logs = flat[order], target[order], np.zeros((len(order), n), out.dtype), np.zeros(len(order), out.dtype)
            for words, rows in met:
                some_h, w = sorted_h[rows], p["wo"][words]
                inner = some_h @ w.T
                inner += bias[words]
                e, logs[rows] = _softmax(inner, told[rows] - words.start, safe, True)
                np.matmul(e.T, some_h, out=g["wo"][words])
                np.matmul(ones[: len(e)], e, out=g["bo"][words])
                np.matmul(e, w, out=inner_dh[rows])
            loss -= float(logs.sum())
            dh[order] += inner_dh
        if some is not None:
            whole = np.zeros((real.size, n), out.dtype)
            whole[some] = dh
            dh = whole
        dh = dh.reshape(out.shape)
        # what of each step's gradient doesn't hang on the steps after it, for all steps at once
        before, parts, c = saved
        z, r, un = parts[:, 0], parts[:, 1], parts[:, 2]
        of_c = (1 - z) * (1 - c * c)
        of_z = (before - c) * z * (1 - z)
        of_r = un * r * (1 - r)
        dx, dhu, ut = np.empty((*inputs.shape, 3 * n), out.dtype), np.empty((*inputs.shape, 3 * n), out.dtype), np.ascontiguousarray(p["u"].T)
        begins = (inputs == 0)[..., None]
        any_begin = begins.any(axis=(1, 2))
        back = np.zeros(dh.shape[1:], out.dtype)
        for t in range(len(inputs) - 1, -1, -1):
            back += dh[t]
            dc = np.multiply(back, of_c[t], out=dx[t, :, 2 * n :])
            np.multiply(back, of_z[t], out=dhu[t, :, :n])
            np.multiply(dc, of_r[t], out=dhu[t, :, n : 2 * n])
            np.multiply(dc, r[t], out=dhu[t, :, 2 * n :])
            back *= z[t]
            back += dhu[t] @ ut
            if any_begin[t]:
                back *= ~begins[t]
        dx[..., : 2 * n] = dhu[..., : 2 * n]
        np.matmul(before.reshape(-1, n).T, dhu.reshape(-1, 3 * n), out=g["u"])
        g["b"][:] = dhu[..., 2 * n :].sum(axis=(0, 1))
        rows, gx = _summed_rows(dx.reshape(-1, 3 * n), inputs.reshape(-1))
        self.steps += 1
        norm = float(np.sqrt(float(np.vdot(self.flat_g, self.flat_g)) + float(np.vdot(gx, gx)))) / count
        scale = min(1.0, 1.0 / max(norm, 1e-9)) / count
        step = rate * float(np.sqrt(1 - 0.999**self.steps)) / (1 - 0.9**self.steps)
        for i in range(0, len(self.flat_g), BLOCK):
            at = slice(i, i + BLOCK)
            _step(self.flat_p[at], self.flat_m[at], self.flat_v[at], self.flat_g[at], scale, step)
        for i in range(0, len(rows), IN_ROWS):
            at = rows[i : i + IN_ROWS]
            moved = [a["x"].take(at, axis=0) for a in (p, self.m, self.v)]
            _step(*moved, gx[i : i + IN_ROWS], scale, step)
            p["x"][at], self.m["x"][at], self.v["x"][at] = moved
        return last, loss


def _count_words(batches):
    parts, n = [], 0

    def summed():
        return pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"]).combine_chunks()

    def out(table):
        return pa.RecordBatch.from_arrays([table["word"].combine_chunks().cast(pa.binary()), table["c"].combine_chunks()], names=["word", "c"])

    for whole in batches:
        for batch in slices(whole, whole.schema.names[0], TEXT):
            counts = pc.value_counts(split_words(batch.column(0))[0])
            parts.append(pa.table({"word": counts.field("values"), "c": counts.field("counts")}))
            n += len(counts)
            if n >= 2 * COUNTED:
                parts = [summed()]
                n = len(parts[0])
                if n >= COUNTED:
                    yield out(parts[0])
                    parts, n = [], 0
    if parts and n:
        yield out(summed())


def count(training: DataFrame, text: str = "text") -> DataFrame:
    """word (UTF-8 bytes), c: how often each word is found in all texts. Summed in each task, then by word."""
    return training.select(text).mapInArrow(tidy(_count_words), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def codes_of(counts: DataFrame, ends: int) -> tuple[Codes, int, int]:
    """The vocabulary as the workers know it, and the numbers of words (tokens) and of distinct words."""
    fine = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(16 * F.log2("c")))
    bins = counts.groupBy(fine.alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.sum("c").alias("tokens")).collect()  # some 5000 rows at most
    least, room = 1 << 62, HEAD
    for r in sorted(bins, key=lambda r: -r["bin"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["least"]
    head = {bytes(r["word"]): r["c"] for r in counts.where(F.col("c") >= least).collect()}  # HEAD rows at most
    suffix = F.expr("substring(word, greatest(1, length(word) - 1), 2)")
    tails = counts.groupBy(suffix.alias("s")).agg(F.sum("c").alias("tokens"), F.sum((F.col("c") == 1).cast("long")).alias("once"), F.count("*").alias("n")).collect()  # 65,792 rows at most
    codes = Codes(head, ends, [(bytes(r["s"]), r["tokens"], r["once"], r["n"]) for r in tails])
    return codes, sum(r["tokens"] for r in bins), sum(r["n"] for r in bins)


CODED = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("head_known", T.LongType()),
    T.StructField("head_base", T.DoubleType()),
    T.StructField("head_score", T.DoubleType()),
    T.StructField("tail", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("unseen", T.FloatType())]))),
    T.StructField("codes", T.BinaryType()),
]
_TAIL = pa.list_(pa.struct([("word", pa.binary()), ("unseen", pa.float32())]))


def encoded(docs: DataFrame, codes: Codes, ends: int = 0, per_token: float = 0.0) -> DataFrame:
    """``docs``, whose last column is the text, with ``CODED`` in its place: the words as 16-bit codes, made
    once for learning and scoring, and what the workers' table says of the words it holds and of the others."""
    packed = docs.sparkSession.sparkContext.broadcast(_packed_model(codes))
    ship(docs.sparkSession)
    text, out = docs.columns[-1], T.StructType([*docs.schema.fields[:-1], *CODED])

    def run(batches):
        (c,) = _held(*packed.value)
        for whole in batches:
            for batch in slices(whole, text, TEXT):
                words, bounds = split_words(batch.column(batch.num_columns - 1))
                told, place = c.encode(words)
                known, size = place >= 0, np.diff(bounds)
                beyond = np.flatnonzero(~known)
                static, base = np.zeros(len(told)), np.zeros(len(told))
                static[known], base[known] = c.static[place[known]], c.base[place[known]]
                static[beyond] = c.log_per_count[-told[beyond]]
                apart = (c.log_unseen - c.log_per_count)[-told[beyond]].astype(np.float32)
                tail = pa.StructArray.from_arrays([words.take(pa.array(beyond)).cast(pa.binary()), pa.array(apart)], names=["word", "unseen"])
                data = told.astype("<i2")
                arrays = [
                    pa.array(size + 1), pa.array(_sums(known.astype(float), bounds).astype(np.int64) + (ends > 0)),
                    pa.array(np.log10(ends + 1.0) - (size + 1) * per_token + _sums(base, bounds)), pa.array(_sums(static, bounds)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(beyond, bounds).astype(np.int32)), tail).cast(_TAIL),
                    pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(data)]),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=out.fieldNames())

    return docs.mapInArrow(tidy(run, "lm codes", _loaded.clear), out)


def learn(coded: DataFrame, codes: Codes, tokens: int) -> dict[str, np.ndarray]:
    """The weights, learned in rounds by replicas whose weights are averaged after each. ``coded``: codes, place (64 mixed bits of a document)."""
    spark = coded.sparkSession
    replicas = max(1, round((tokens / PER_REPLICA) ** 0.5))
    dealt = coded.select("codes", "place", F.pmod(F.shiftright(F.col("place"), 44), F.lit(ROUNDS)).cast("int").alias("round"))
    p = initial(codes)
    shared = spark.sparkContext.broadcast(pickle.dumps(codes.small(), 5))
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast(pickle.dumps(p, 5))

        def train(batches, rate=RATE * 0.6**r, sent=sent):
            docs, learner, used = [], None, 0

            def go():
                nonlocal learner, docs, used
                learner = learner or Learner(pickle.loads(sent.value), pickle.loads(shared.value))
                learner.learn(docs, rate)
                docs, used = [], 0

            for batch in batches:
                for x in batch.column(0):
                    docs.append(np.frombuffer(x.as_buffer(), "<i2"))
                    used += len(docs[-1]) + 1
                    if used > TOGETHER:
                        go()
            if docs:
                go()
            if learner:
                yield _packed(learner.p, 1)

        learned = dealt.where(F.col("round") == r).select("codes", "place").repartition(replicas, "place").coalesce(replicas).mapInArrow(tidy(train), "n int, body binary")
        # as many tasks as replicas, however many partitions a shuffle is told to have: each returns a set of weights
        sets = replicas
        while sets > FAN_IN:  # averaged in a tree of fixed fan-in, so no task and not the driver holds more
            sets = -(-sets // FAN_IN)
            learned = learned.repartition(sets).mapInArrow(_summed, "n int, body binary")
        sums = [(x["n"], pickle.loads(x["body"])) for x in learned.collect()]
        if sums:
            total = sum(n for n, _ in sums)
            p = {k: (sum(s[k] for _, s in sums) / total).astype(np.float32) for k in p}
    return p


def _packed(p: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([pickle.dumps(p, 5)], pa.binary())], names=["n", "body"])


def _summed(batches):
    n, total = 0, None
    for batch in batches:
        for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p = pickle.loads(body)
            n, total = n + k, p if total is None else {name: total[name] + p[name] for name in p}
    if total is not None:
        yield _packed(total, n)


_loaded: dict = {}


def _packed_model(*parts) -> tuple:
    """A name by content and the pickled parts."""
    raw = [pickle.dumps(x, 5) for x in parts]
    return hashlib.sha256(b"".join(raw)).hexdigest(), *raw


def _held(key: str, *raw: bytes) -> tuple:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = tuple(map(pickle.loads, raw))
    return _loaded[key]


def log_likelihoods(p: dict, codes: Codes, docs: list[np.ndarray]) -> np.ndarray:
    """Of each document, the sum of log10 P(class) and, for the shortlist and the end, log10 P(word | class)."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    lanes = Lanes(docs, SCORE_LANES, codes)
    h = np.zeros((len(lanes.sizes), HIDDEN), np.float32)
    for inputs, targets, doc, real in lanes.windows(SCORE_WINDOW):
        seen, h, _ = states(p, inputs, h[: inputs.shape[1]])
        logs = token_logs(p, codes, seen.reshape(-1, HIDDEN), targets.reshape(-1))
        ok = real.reshape(-1)
        np.add.at(out, doc.reshape(-1)[ok], logs[ok].astype(np.float64))
    return out / LOG10


def score(docs: DataFrame, training: Column, text: str = "text") -> DataFrame:
    """``docs`` without its text, with held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``training`` tells which documents to learn from.
    """
    spark = docs.sparkSession
    ship(spark)
    ours = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = without(docs, *ours, text).columns
    lessons = docs.where(training)
    ends = lessons.count()
    counts = cut_table(count(lessons, text))
    codes, words, distinct = codes_of(counts, ends)
    n_all, n_kinds = words + ends, distinct + (ends > 0)
    place = F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col("doc_id").cast("string"), F.col(text)), 1)
    user = F.struct(*[F.col(f"`{c}`") for c in kept])
    source = docs.select(user.alias("user"), (~F.coalesce(training, F.lit(False))).alias("held_out"), place.alias("place"), text)
    coded = cut_table(encoded(source, codes, ends, float(np.log10(n_all + n_kinds + 1))).withColumn("row", F.monotonically_increasing_id()))
    weights = learn(coded.where(~F.col("held_out")), codes, n_all)
    packed = spark.sparkContext.broadcast(_packed_model(codes.small(), weights))

    def run(batches):
        c, p = _held(*packed.value)
        held, docs_, tokens = [], [], 0

        def emit():
            logs, at = log_likelihoods(p, c, docs_), 0
            for batch in held:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(logs[at : at + n])], names=[*batch.schema.names[1:], "modelled"])
                at += n

        for batch in batches:
            docs_ += [np.frombuffer(x.as_buffer(), "<i2") for x in batch.column(0)]
            held.append(batch)
            tokens += sum(map(len, docs_[-batch.num_rows :])) if batch.num_rows else 0
            if tokens >= TOGETHER:
                yield from emit()
                held, docs_, tokens = [], [], 0
        if held:
            yield from emit()

    told = coded.select("codes", *[c for c in coded.columns if c not in ("codes", "tail", "place")])
    scored = T.StructType([*told.schema.fields[1:], T.StructField("modelled", T.DoubleType())])
    modelled = told.mapInArrow(tidy(run, "lm", _loaded.clear), scored)
    words_left = coded.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.unseen")
    met = words_left.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), 1).otherwise(0)).alias("tail_known"),
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("tail_base"),
        F.sum(F.when(F.col("c").isNotNull(), F.log10(F.col("c").cast("double"))).otherwise(F.col("unseen").cast("double"))).alias("tail_score"),
    )
    whole = modelled.join(met, "row", "left")
    return whole.select(
        *[F.col(f"user.`{c}`") for c in kept],
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("head_score") + F.col("modelled") + F.coalesce("tail_score", F.lit(0.0))).alias("score"),
    )
