"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily.

Vectors are dealt by a hash of their id to blocks of about ``block`` vectors; a
block is one row that holds its vectors and their neighbour lists. All work is
rounds of messages between blocks: each round is one Spark shuffle of packed
messages by block, joined with the blocks' rows, so a task holds one block and what
was sent to it, and a lost task is run again from the last checkpoint.

Building. Lists start with the nearest of two random groups. In each iteration a
vector's neighbours and as many of those that list it (at random, as NN-descent
does) are compared with each other, where at least one of two is fresh (not compared
before), and each is offered its nearest: the join of neighbours of neighbours. A list
that holds nothing fresh asks for no vectors. It goes on until few lists change.

Searching. A query starts from its own list (or, for a vector that isn't in the
graph, from the ids given as entries), and again and again expands the nearest
candidates not yet expanded, along the lists both ways, until the nearest ``beam``
are all expanded. Distances so far come from half-precision vectors; at the end the
nearest candidates are scored anew on the original vectors in double precision.

Nearness is the inner product. The result is approximate: recall is measured in
the tests and in the README.

Defined results: null vectors, empty ones, zero ones and those holding null or
non-finite components take no part, nor do rows with a null id; ids may repeat: each
row is a candidate for all rows but itself, and each row that is a query is answered;
vectors are compared with those of their own length, whatever lengths there are; of
equal scores the smaller id comes first; a query with fewer than k candidates returns
them all if they can be reached; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import tidy
from weftgraph.llm.vectors import matrix, nonzero, usable
from weftgraph.session import cut, settle

BLOCK = 4096
NEIGHBOURS, BEAM, WIDTH = 32, 288, 96
#: An iteration of building offers each vector at most so many new neighbours from a block's comparisons, the nearest.
OFFERS = 6
#: Building ends when so small a share of all places in the lists changes.
SETTLED = 0.03
#: Candidates of each query that are scored exactly.
RESCORED = 64
GROUP = 256
ROWS = "p int, kind int, body binary"
STATE, MESSAGE, OUT = 0, 1, 2


def mixed(ids: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mix of ids, as published for the SplitMix generator."""
    z = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Spans:
    """Which blocks hold the vectors of which length: a run of blocks for each length."""

    def __init__(self, sizes: list[tuple[int, int]], block: int):
        """``sizes``: each length and its number of vectors."""
        self.dims = [d for d, _ in sizes]
        self.counts = np.array([max(1, -(-n // block)) for _, n in sizes] or [1], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.blocks = int(self.counts.sum())

    def owner(self, at: int, ids: np.ndarray, salt: int = 0) -> np.ndarray:
        """The blocks of vectors (by their rows) that have the length of those of block ``at``."""
        i = int(np.searchsorted(self.starts, at, side="right")) - 1
        return self.starts[i] + (mixed(ids, salt) % np.uint64(self.counts[i])).astype(np.int64)

    def of_length(self, dim: int, ids: np.ndarray) -> np.ndarray:
        return self.owner(int(self.starts[self.dims.index(dim)]), ids)


def _split(to: np.ndarray, *arrays: np.ndarray):
    """(block, arrays) for each block that something goes to."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to = to[order]
    edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    for a, b in zip(edges, [*edges[1:], len(to)], strict=True):
        yield int(to[a]), [x[order[a:b]] for x in arrays]


def _best(row, cand, score, k):
    """Of (row, candidate, score) the k best of each row, repeats once: sorted by row, best first, and the place."""
    order = np.lexsort((cand, row))
    row, cand, score = row[order], cand[order], score[order]
    if len(row):
        new = np.r_[True, (row[1:] != row[:-1]) | (cand[1:] != cand[:-1])]
        row, cand, score = row[new], cand[new], score[new]
    order = np.lexsort((cand, -score, row))
    row, cand, score = row[order], cand[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], cand[keep], score[keep], place[keep]


def _rounds(rows: DataFrame, blocks: int, step: Callable) -> DataFrame:
    """One round: ``step(p, state, messages)`` yields (block, kind, body) for each block's row and what was sent to it."""

    def run(batches):
        p, state, messages = None, None, []

        def finish():
            out = [(q, kind, pickle.dumps(body, 5)) for q, kind, body in step(p, state, messages)]
            for i in range(0, len(out), 64):
                q, kind, body = zip(*out[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], names=["p", "kind", "body"])

        for batch in batches:
            for i in range(batch.num_rows):
                q, kind, body = (batch.column(c)[i].as_py() for c in range(3))
                if q != p:
                    if p is not None:
                        yield from finish()
                    p, state, messages = q, None, []
                if kind == STATE:
                    state = pickle.loads(body)
                else:
                    messages.append(pickle.loads(body))
        if p is not None:
            yield from finish()

    # the block's number is the partition's: a task for each block, none empty
    return rows.repartitionById(blocks, F.col("p")).sortWithinPartitions("p", "kind").mapInArrow(tidy(run), ROWS)


class Builder:
    """The steps of building; a block's state: ids (rows, sorted), vec (their vec_id), h (half precision), and per
    vector nbr, score and fresh (not yet compared)."""

    def __init__(self, spans: Spans, k: int):
        self.spans, self.k = spans, k

    def load(self, p, state, messages):
        """Vectors arrive: make the block's state, and deal its vectors to random blocks for a group of strangers."""
        ids, vec, v = (np.concatenate([m[i] for m in messages]) for i in range(3))
        order = np.argsort(ids)
        ids, vec, v = ids[order], vec[order], v[order]
        scale = np.abs(v).max() or 1.0  # half precision has a small range; ranking doesn't need the scale of a block alone
        h = v.astype(np.float16) if scale < 1e4 and scale > 1e-3 else v.astype(np.float32)
        n = len(ids)
        yield p, STATE, {"ids": ids, "vec": vec, "h": h, "nbr": np.full((n, self.k), -1, np.int64), "score": np.full((n, self.k), -np.inf, np.float32), "fresh": np.zeros((n, self.k), bool)}
        yield from ((q, MESSAGE, ("group", *part)) for q, part in _split(self.spans.owner(p, ids, 7), ids, h))

    def start(self, p, state, messages):
        """The nearest within random groups: of the block's own vectors, and of those dealt here."""
        if state is not None:
            yield p, STATE, state
        dealt = [np.concatenate([m[i] for m in messages]) for i in (1, 2)] if messages else None
        for salt, group in ((11, (state["ids"], state["h"]) if state is not None else None), (13, dealt)):
            if group is None:
                continue
            ids, h = group
            order = np.argsort(mixed(ids, salt))
            for i in range(0, len(ids), GROUP):
                at = order[i : i + GROUP]
                if len(at) < 2:
                    continue
                x = h[at].astype(np.float32)
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                m = min(self.k // 2, len(at) - 1)
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                row = np.repeat(ids[at], m)
                yield from self.offers(p, row, ids[at][top].ravel(), np.take_along_axis(s, top, 1).ravel())

    def offers(self, p, row, cand, score):
        for q, part in _split(self.spans.owner(p, row), row, cand, score.astype(np.float32)):
            yield q, MESSAGE, ("offer", *part)

    def merge(self, p, state, messages):
        """Take the offers into the lists, then tell each listed vector who lists it. The state counts what changed."""
        if state is None:
            return
        offers = [m for m in messages if m[0] == "offer"]
        ids, nbr, score, fresh = state["ids"], state["nbr"], state["score"], state["fresh"]
        own = np.flatnonzero(nbr.ravel() >= 0)
        rows = [np.repeat(np.arange(len(ids)), self.k)[own], *[np.searchsorted(ids, m[1]) for m in offers]]
        row, cand, s, place = _best(np.concatenate(rows), np.concatenate([nbr.ravel()[own], *[m[2] for m in offers]]), np.concatenate([score.ravel()[own], *[m[3] for m in offers]]), self.k)
        # what was listed before and compared is not fresh; everything else is
        pairs = _pair(rows[0], nbr.ravel()[own])
        old = np.sort(pairs[~fresh.ravel()[own]])
        before = nbr
        nbr, score, fresh = np.full_like(nbr, -1), np.full_like(score, -np.inf), np.zeros_like(fresh)
        nbr[row, place], score[row, place] = cand, s
        mine = _pair(row, cand)
        at = np.minimum(np.searchsorted(old, mine), max(len(old) - 1, 0))
        is_fresh = (old[at] != mine) if len(old) else np.ones(len(mine), bool)
        fresh[row, place] = is_fresh
        changed = int((np.sort(nbr, axis=1) != np.sort(before, axis=1)).sum())
        yield p, STATE, state | {"nbr": nbr, "score": score, "fresh": fresh, "changed": changed}
        yield from self.backlinks(p, ids[row], cand, is_fresh)

    def backlinks(self, p, lister, listed, fresh):
        for q, part in _split(self.spans.owner(p, listed), listed, lister, fresh):
            yield q, MESSAGE, ("back", *part)

    def both_ways(self, state, messages, salt):
        """Each vector's lists both ways, k at random of those that list it, and which of all these are fresh."""
        ids = state["ids"]
        back = [m for m in messages if m[0] == "back"]
        listed, lister = (np.concatenate([m[i] for m in back] or [np.empty(0, np.int64)]) for i in (1, 2))
        is_fresh = np.concatenate([m[3] for m in back] or [np.empty(0, bool)])
        row = np.searchsorted(ids, listed)
        order = np.lexsort((mixed(lister, salt), row))
        row, lister, is_fresh = row[order], lister[order], is_fresh[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        out, fresh = np.full((len(ids), self.k), -1, np.int64), np.zeros((len(ids), self.k), bool)
        out[row[keep], place[keep]], fresh[row[keep], place[keep]] = lister[keep], is_fresh[keep]
        return out, np.concatenate([state["fresh"], fresh], axis=1)

    def members(self, p, state, messages, salt):
        """Lists both ways, and a request for the vectors met in those that hold anything fresh."""
        if state is None:
            return
        back, fresh = self.both_ways(state, messages, salt)
        active = np.flatnonzero(fresh.any(axis=1))
        both = np.concatenate([state["nbr"], back], axis=1)[active]
        yield p, STATE, state | {"both": both, "new": fresh[active], "fresh": np.zeros_like(state["fresh"])}
        wanted = np.unique(both)
        wanted = wanted[wanted >= 0]
        for q, (part,) in _split(self.spans.owner(p, wanted), wanted):
            yield q, MESSAGE, ("want", p, part)

    def reply(self, p, state, messages):
        yield p, STATE, state
        worst = state["score"].min(axis=1)
        for m in messages:
            at = np.searchsorted(state["ids"], m[2])
            yield m[1], MESSAGE, ("have", m[2], state["h"][at], worst[at])

    def compare(self, p, state, messages):
        """Compare the members of each vector's lists with each other, the fresh ones with all; offer each its nearest."""
        kept = {k: v for k, v in state.items() if k not in ("both", "new")}
        yield p, STATE, kept
        ids = np.concatenate([m[1] for m in messages] or [np.empty(0, np.int64)])
        if not len(ids):
            return
        order = np.argsort(ids)
        ids = ids[order]
        h = np.concatenate([m[2] for m in messages])[order].astype(np.float32)
        worst = np.concatenate([m[3] for m in messages])[order]
        both, new = state["both"], state["new"]
        here = np.where(both >= 0, np.searchsorted(ids, np.maximum(both, ids[0])), -1)
        # what the block's own vectors list already needs no offer
        mine = np.isin(ids, state["ids"])
        at = np.searchsorted(state["ids"], ids[mine])
        listed = np.sort(_pair(np.repeat(np.flatnonzero(mine), self.k), state["nbr"][at].ravel()))
        found: list = []
        for i in range(0, len(here), 128):
            m, f = here[i : i + 128], new[i : i + 128]
            x = h[m]
            s = x @ x.transpose(0, 2, 1)
            s[(m[:, :, None] == m[:, None, :]) | (m < 0)[:, :, None] | (m < 0)[:, None, :] | ~(f[:, :, None] | f[:, None, :])] = -np.inf
            s[s <= worst[m][:, :, None]] = -np.inf
            t = min(OFFERS, s.shape[2] - 1)
            top = np.argpartition(-s, t - 1, axis=2)[:, :, :t]
            val = np.take_along_axis(s, top, 2)
            ok = val > -np.inf
            row, cand = np.broadcast_to(m[:, :, None], ok.shape)[ok], m[np.arange(len(m))[:, None, None], top][ok]
            known = np.zeros(len(row), bool)
            local = mine[row]
            if local.any():
                pairs = _pair(row[local], ids[cand[local]])
                known[local] = listed[np.minimum(np.searchsorted(listed, pairs), len(listed) - 1)] == pairs
            found.append((row[~known], cand[~known], val[ok][~known]))
            if len(found) == 8:
                found = [_best(*[np.concatenate(z) for z in zip(*found, strict=True)], OFFERS)[:3]]
        if not found:
            return
        row, cand, s, _ = _best(*[np.concatenate(z) for z in zip(*found, strict=True)], OFFERS)
        yield from self.offers(p, ids[row], ids[cand], s)


def _pair(q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A query's row and 32 mixed bits of a candidate's id: two candidates that share them, one in 2^32, pass for one."""
    return (q.astype(np.uint64) << np.uint64(32)) | (mixed(ids, 5) >> np.uint64(32))


class Searcher:
    """The steps of searching. A block keeps its queries' nearest candidates: q (row of the query in the
    block), id, s (score), done (expanded)."""

    def __init__(self, spans: Spans, k: int, beam: int, width: int, is_query: Callable):
        self.spans, self.k, self.beam, self.width, self.is_query = spans, k, beam, width, is_query

    def begin(self, p, state, messages):
        """Lists both ways; each query starts from its own."""
        if state is None:
            return
        at = np.flatnonzero(self.is_query(state["vec"]))
        nbr = state["nbr"][at]
        ok = nbr >= 0
        q = np.repeat(np.arange(len(at), dtype=np.int32), nbr.shape[1])[ok.ravel()]
        back, _ = Builder(self.spans, self.k).both_ways(state, messages, 99)
        graph = {k: state[k] for k in ("ids", "h", "nbr")} | {"back": back, "at": at}
        yield p, STATE, graph | {"q": q, "id": nbr[ok], "s": state["score"][at][ok], "done": np.zeros(len(q), bool)}

    def expand(self, p, state, messages):
        """Take in the scores of the candidates met last; ask for the lists of the nearest not yet expanded."""
        if messages:
            q, cand = state["new_q"], state["new_id"]
            ids = np.concatenate([m[1] for m in messages])
            order = np.argsort(ids)
            h = np.concatenate([m[2] for m in messages])[order]
            score = np.empty(len(q), np.float32)
            where = np.searchsorted(ids[order], cand)
            for i in range(0, len(q), 1 << 14):
                z = slice(i, i + (1 << 14))
                score[z] = np.einsum("ij,ij->i", state["h"][state["at"][q[z]]].astype(np.float32), h[where[z]].astype(np.float32))
            add = {"q": q, "id": cand, "s": score, "done": np.zeros(len(q), bool)}
            state = state | {k: np.concatenate([state[k], add[k]]) for k in add}
        order = np.lexsort((state["id"], -state["s"], state["q"]))
        q = state["q"][order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < self.beam]  # what lies beyond is met, and no longer a candidate
        state = {k: v[order] if k in ("q", "id", "s", "done") else v for k, v in state.items() if k not in ("new_q", "new_id")}
        open_ = np.flatnonzero(~state["done"])
        q = state["q"][open_]
        chosen = open_[np.arange(len(q)) - np.searchsorted(q, q) < self.width]
        state["done"][chosen] = True
        yield p, STATE, state | {"ask_q": state["q"][chosen], "ask": state["id"][chosen], "changed": len(chosen)}
        wanted = np.unique(state["id"][chosen])
        for b, (part,) in _split(self.spans.owner(p, wanted), wanted):
            yield b, MESSAGE, ("lists", p, part)

    def lists(self, p, state, messages):
        yield p, STATE, state
        for m in messages:
            at = np.searchsorted(state["ids"], m[2])
            yield m[1], MESSAGE, ("lists", m[2], np.concatenate([state["nbr"][at], state["back"][at]], axis=1))

    def meet(self, p, state, messages):
        """What these lists hold besides the query's candidates; ask for the vectors. One that was met before
        and fell out of the beam is looked at again, and falls out again: so a query's state has a bound."""
        q, cand = np.empty(0, np.int32), np.empty(0, np.int64)
        if messages:
            ids = np.concatenate([m[1] for m in messages])
            order = np.argsort(ids)
            found = np.concatenate([m[2] for m in messages])[order][np.searchsorted(ids[order], state["ask"])]
            q = np.repeat(state["ask_q"], found.shape[1])[found.ravel() >= 0]
            cand = found[found >= 0]
            pairs, first = np.unique(_pair(q, cand), return_index=True)
            held = np.concatenate([_pair(state["q"], state["id"]), _pair(np.arange(len(state["at"])), state["ids"][state["at"]])])
            first = first[~np.isin(pairs, held)]
            q, cand = q[first], cand[first]
        yield p, STATE, {k: v for k, v in state.items() if k not in ("ask_q", "ask")} | {"new_q": q, "new_id": cand}
        wanted = np.unique(cand)
        for b, (part,) in _split(self.spans.owner(p, wanted), wanted):
            yield b, MESSAGE, ("want", p, part)

    def vectors(self, p, state, messages):
        yield p, STATE, state
        for m in messages:
            yield m[1], MESSAGE, ("have", m[2], state["h"][np.searchsorted(state["ids"], m[2])])

    def last(self, p, state, messages):
        """The nearest candidates of each query, and a request for their original vectors."""
        q, cand, _, _ = _best(state["q"], state["id"], state["s"], RESCORED)
        yield p, STATE, {"asked": state["ids"][state["at"]], "q": q, "id": cand}
        wanted = np.unique(cand)
        for b, (part,) in _split(self.spans.owner(p, wanted), wanted):
            yield b, MESSAGE, ("want", p, part)

    def originals(self, p, state, messages):
        """The original vectors arrive anew; those of the candidates go to the queries' blocks, with their ids."""
        raw = [m for m in messages if not isinstance(m[0], str)]
        ids, vec, v = (np.concatenate([m[i] for m in raw]) for i in range(3))
        order = np.argsort(ids)
        ids, vec, v = ids[order], vec[order], v[order]
        asked = np.searchsorted(ids, state["asked"])
        yield p, STATE, state | {"v": v[asked], "vec": vec[asked]}
        for m in messages:
            if isinstance(m[0], str):
                at = np.searchsorted(ids, m[2])
                yield m[1], MESSAGE, ("have", m[2], vec[at], v[at])

    def results(self, p, state, messages, top):
        if not messages:
            return
        ids, vec, v = (np.concatenate([m[i] for m in messages]) for i in (1, 2, 3))
        order = np.argsort(ids)
        q = state["q"]
        at = order[np.searchsorted(ids[order], state["id"])]
        score = np.einsum("ij,ij->i", state["v"][q], v[at])
        order = np.lexsort((vec[at], -score, q))  # candidates are distinct rows; their ids may repeat
        q, found, score = q[order], vec[at][order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < top
        yield p, OUT, (state["vec"][q[keep]], place[keep] + 1, found[keep], score[keep])


def _load(vectors: DataFrame, spans: Spans) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows, vec = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            out = []
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                v = matrix(batch.column(2).take(pa.array(at)), int(dim))
                out += [(p, MESSAGE, pickle.dumps(part, 5)) for p, part in _split(spans.of_length(int(dim), rows[at]), rows[at], vec[at], v)]
            if out:
                p, kind, body = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], names=["p", "kind", "body"])

    return vectors.mapInArrow(run, ROWS)


def _changed(rows: DataFrame) -> int:
    def run(batches):
        for batch in batches:
            n = sum(pickle.loads(b.as_py())["changed"] for b, k in zip(batch.column(2), batch.column(1), strict=True) if k.as_py() == STATE)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.where(F.col("kind") == STATE).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def build(vectors: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> tuple[DataFrame, Spans]:
    """The graph as blocks' rows with backlinks under way, and where the blocks are. ``vectors``: row, vec_id, v."""
    sizes = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()  # a row for each length
    spans, n = Spans([(r["dim"], r["n"]) for r in sizes], block), sum(r["n"] for r in sizes)
    make, blocks = Builder(spans, k), spans.blocks
    rows = _rounds(_load(vectors, spans), blocks, make.load)
    rows = cut(_rounds(_rounds(rows, blocks, make.start), blocks, make.merge))
    for i in range(iterations(n)):
        rows = _rounds(rows, blocks, lambda p, s, m, i=i: make.members(p, s, m, i))
        rows = _rounds(_rounds(rows, blocks, make.reply), blocks, make.compare)
        rows = settle(_rounds(rows, blocks, make.merge))
        if _changed(rows) <= SETTLED * n * k:
            return rows, spans
    raise RuntimeError("the neighbour graph did not settle")


def iterations(n: int) -> int:
    """Rounds in which lists settle at the latest: news travels the graph's width, the logarithm of its size, a few times."""
    return 12 + 4 * max(1, n).bit_length()


def search(vectors: DataFrame, is_query: Callable, top: int, k: int = NEIGHBOURS, beam: int = BEAM, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` nearest found of each query.

    ``vectors`` has vec_id and embedding; ``is_query`` tells from an array of ids which are queries.
    """
    ready = cut(usable(vectors).where(nonzero(F.col("v"))))
    rows, spans = build(ready, k, block)
    blocks, go = spans.blocks, Searcher(spans, k, beam, width, is_query)
    rows = cut(_rounds(_rounds(rows, blocks, go.begin), blocks, go.expand))
    while _changed(rows):
        rows = _rounds(_rounds(rows, blocks, go.lists), blocks, go.meet)
        rows = settle(_rounds(_rounds(rows, blocks, go.vectors), blocks, go.expand))
    rows = _rounds(rows.where(F.col("kind") == STATE), blocks, go.last).unionByName(_load(ready, spans))
    rows = _rounds(rows, blocks, go.originals)
    rows = _rounds(rows, blocks, lambda p, s, m: go.results(p, s, m, top))

    def unpack(batches):
        for batch in batches:
            for body in batch.column(2):
                q, rank, cand, score = pickle.loads(body.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank.astype(np.int32)), pa.array(cand), pa.array(score)], names=["query_id", "rank", "vec_id", "score"])

    return rows.where(F.col("kind") == OUT).mapInArrow(unpack, "query_id long, rank int, vec_id long, score double")
