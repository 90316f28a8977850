"""Ranked lexical search by windowed bucket scoring.

1. Items. The distinct terms of each item are numbered. Items go in blocks with at most
   ``PAIRS`` (item, term) pairs (counted; an item with more goes alone), so what a task
   knows of the queries is bounded; each block searches all documents.
2. Postings. Each document's whole text becomes one row with its number of terms and, for
   the block's terms, how often each occurs. These rows, which hold no text, are numbered
   by doc_id, so that a partition holds a run of documents. Documents with terms, all their
   terms and each term's documents are counted over the whole table.
3. Windows. ``WINDOW`` documents in a row are a window. Its postings are sorted by term, and
   what each adds to a score is worked out once. An item's terms are traversed in turn:
   their postings are added at the documents' places in an array that stays in cache, and a
   set of bits marks the groups of ``GROUP`` documents that were touched. Only these are
   harvested, by what beats the least of the item's heap, and set back to zero.
4. Heaps hold the best of all windows of a task; the best of the tasks' heaps are the result.

Scores are whole numbers (64 bits). Ties go to the smaller doc_id, a null one last.

Defined results: a null text has no terms; an item without known terms has no rows; each row
of either table stands for itself, so repeated ids are searched and found repeatedly; empty
tables give no rows. Other columns don't matter.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import slices, tidy
from weftgraph.session import cut, numbered, ship

#: (item, term) pairs of a block of items.
PAIRS = 1 << 20
#: Documents of a window: its scores take 64 KB. One whose postings take more than HELD bytes is searched in parts.
WINDOW = 1 << 13
HELD = 16 << 20
#: Documents that share an occupancy bit.
GROUP = 64

#: Bytes of UTF-8 that belong to terms, A-Z as a-z; others become spaces.
TERM_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split(b" ") if text else []


def _item_terms(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            found = [sorted({*terms_of(t)} - {b""}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])


def _postings(vocabulary: dict[bytes, int]):
    """Rows (doc_id, text) to (doc_id, n, terms, tf): the last two as packed 32-bit numbers, by term."""

    def run(batches):
        known = vocabulary.get
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, terms, tf = [], [], []
                for text in batch.column(1).to_pylist():
                    counts = Counter(terms_of(text))
                    counts.pop(b"", None)
                    sizes.append(counts.total())
                    mine = sorted((k, n) for k, n in ((known(t), n) for t, n in counts.items()) if k is not None)
                    pairs = np.array(mine, np.uint32).reshape(-1, 2)
                    terms.append(pairs[:, 0].tobytes())
                    tf.append(pairs[:, 1].tobytes())
                parts = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())]
                yield pa.RecordBatch.from_arrays(parts, names=["doc_id", "n", "terms", "tf"])

    return run


def _document_counts(n_terms: int):
    """Totals of a task: of its documents with terms, of their terms, and of the documents of each term of the block."""

    def run(batches):
        df, docs, length = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False)
            docs, length = docs + int((n > 0).sum()), length + int(n.sum())
            df += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32), minlength=n_terms)
        at = np.flatnonzero(df)
        terms, counts = np.r_[[-2, -1], at].astype(np.int32), np.r_[docs, length, df[at]].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], names=["term", "df"])

    return run


class _Search:
    """One task's search of its documents, window by window. ``items``: (number, terms); ``weights`` by term."""

    def __init__(self, items: list[tuple[int, np.ndarray]], weights: np.ndarray, docs: int, length: int, k: int):
        self.items, self.weights, self.docs, self.length, self.k = items, weights, docs, length, k
        self.heaps: dict[int, list] = {}
        self.scores = np.zeros(WINDOW, np.int64)
        self.touched = np.zeros(WINDOW // GROUP, bool)

    def window(self, ids: list, rows: np.ndarray, sizes: np.ndarray, term: np.ndarray, place: np.ndarray, tf: np.ndarray) -> None:
        """Search a window: of each document its id, its row's number and its number of terms; of each posting term, place and tf."""
        order = np.argsort(term, kind="stable")  # by term, then by place
        term, place, tf = term[order], place[order], tf[order].astype(np.int64)
        m = 100 - 90 + (90 * sizes * self.docs) // max(self.length, 1)
        adds = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[place]))
        groups = place // GROUP
        starts = np.searchsorted(term, np.arange(len(self.weights) + 1)).tolist()
        scores, touched, by_group = self.scores, self.touched, self.scores.reshape(-1, GROUP)
        for item, terms in self.items:
            runs = [(starts[t], starts[t + 1]) for t in terms if starts[t] < starts[t + 1]]
            if not runs:
                continue
            for a, b in runs:
                scores[place[a:b]] += adds[a:b]  # a document is in a term's run once
                touched[groups[a:b]] = True
            heap = self.heaps.setdefault(item, [])
            full = np.flatnonzero(touched)
            g, i = np.nonzero(by_group[full] >= (heap[0][0] if len(heap) == self.k else 1))
            at = full[g] * GROUP + i
            if len(at) > self.k:
                at = at[np.lexsort((rows[at], -scores[at]))[: self.k]]
            for p in at.tolist():
                found = (int(scores[p]), -int(rows[p]), ids[p])
                if len(heap) < self.k:
                    heapq.heappush(heap, found)
                elif found[:2] > heap[0][:2]:
                    heapq.heapreplace(heap, found)
            by_group[full] = 0
            touched[full] = False

    def run(self, batches):
        """Rows (row, doc_id, n, terms, tf) to (item, row, doc_id, score)."""
        held, of, size = [], None, 0
        for batch in batches:
            window = batch.column(0).to_numpy(zero_copy_only=False) // WINDOW
            lengths = batch.column(3).nbytes // max(1, batch.num_rows) + 1
            step = max(1, HELD // lengths // 4)
            cuts = np.union1d(np.flatnonzero(np.diff(window)) + 1, np.arange(0, len(window), step))
            for a, b in zip(cuts, np.r_[cuts[1:], len(window)], strict=True):
                if held and (window[a] != of or size > HELD):
                    self.close(held)
                    held, size = [], 0
                of = window[a]
                held.append(batch.slice(a, b - a))
                size += int(lengths * (b - a))
        if held:
            self.close(held)
        found = [(item, -row, doc_id, score) for item, heap in self.heaps.items() for score, row, doc_id in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["item", "row", "doc_id", "score"])

    def close(self, held: list[pa.RecordBatch]) -> None:
        row, n = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 2))
        ids, *packed = [[x for b in held for x in b.column(i).to_pylist()] for i in (1, 3, 4)]
        term, tf = (np.frombuffer(b"".join(p), np.uint32) for p in packed)
        place = np.repeat(np.arange(len(row)), [len(x) // 4 for x in packed[0]])
        self.window(ids, row, n, term, place, tf)


def _searching(items, weights, docs, length, k):
    def run(batches):
        yield from _Search(items, weights, docs, length, k).run(batches)

    return run


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """item, row, doc_id, score: some candidates for each of a block's ``items`` (item, terms), its k best among them."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    rows = docs.mapInArrow(tidy(_postings(vocabulary)), "doc_id long, n long, terms binary, tf binary").withColumn("no_id", F.col("doc_id").isNull())
    rows = numbered(rows, "row", "no_id", "doc_id")
    # a row per term of the block and two more; each task has summed its own
    counted = rows.select("n", "terms").mapInArrow(tidy(_document_counts(len(vocabulary))), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = {r["term"]: r["df"] for r in counted.collect()}
    n, length = df.get(-2, 0), df.get(-1, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    asked = [(item, [vocabulary[t] for t in terms]) for item, terms in items]
    found = rows.select("row", "doc_id", "n", "terms", "tf").mapInArrow(tidy(_searching(asked, weights, n, length, k)), "item long, row long, doc_id long, score long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "row")))
    return cut(best.where(F.col("rank") <= k).select("item", "rank", "doc_id", "score"))


def _blocks(terms: DataFrame):
    """Borders of the blocks of items: read row by row, two numbers each; the driver holds one block's terms at a time."""
    first, held, last = None, 0, None
    for r in terms.select("item", F.size("terms").alias("n")).orderBy("item").toLocalIterator():
        if first is not None and held + r["n"] > PAIRS:
            yield first, last
            first, held = None, 0
        first = r["item"] if first is None else first
        last, held = r["item"], held + r["n"]
    if first is not None:
        yield first, last


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` (item_id, text) the k documents (doc_id, text) that score highest, if above 0."""
    spark = docs.sparkSession
    ship(spark)
    asked = cut(numbered(items.select("item_id", "text"), "item", "item_id", "text"))
    terms = cut(asked.select("item", "text").mapInArrow(tidy(_item_terms), "item long, terms array<binary>").where(F.size("terms") > 0))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    for first, last in _blocks(terms):
        block = [(r["item"], [bytes(t) for t in r["terms"]]) for r in terms.where(F.col("item").between(first, last)).collect()]
        out = out.unionByName(_block(docs, block, k))
    return out.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
