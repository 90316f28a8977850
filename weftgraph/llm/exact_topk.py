"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments, at a coarse and at a fine resolution, and each
segment is summed up by its mean and deviation. With segments of length L, the
squared distance of two vectors is at least the sum of L((m-m')^2 + (s-s')^2),
and since a vector's own statistics keep its norm, their inner product is at most
the inner product of the statistics. A block of vectors goes through the coarse
bound, then the fine one; exact products are computed for what could still be
among a query's best k.

Queries are packed into blocks and so are the vectors. A block of queries is sent to
some tasks, and each block of vectors to one of them, for each block of queries of its
dimension; a task runs the vectors' blocks past its block of queries and keeps k
candidates for each query, so its memory has a bound, and it returns k rows for each
query. A vectors' block whose largest possible product with any query of the block
lies under what each query already has from its first task's sample is not sent.

Defined results: null vectors, empty ones and those holding null or non-finite
components take no part, nor do rows with a null id; ids may repeat: each row is a
candidate for all rows but itself, and each row that is a query is answered; vectors of
different lengths aren't compared; of equal scores the smaller id comes first; a query
with fewer than k candidates returns them all; an empty table gives no rows. Scores are
exact whole numbers; one beyond 64 bits is given as the largest or smallest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm.common import tidy
from weftgraph.llm.vectors import BLOCK, PACKED, pack, unpack, usable
from weftgraph.session import cut

#: Segments of the coarse and of the fine statistics.
COARSE, FINE = 4, 16
QUERIES = 2048
STEP = 512
EXACT = float(1 << 53)
#: Vectors of each of the ``LENGTHS`` commonest lengths, those of the largest norms, that all queries meet first: bounds what is broadcast.
SAMPLE, LENGTHS = 512, 8


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of a vector's segments, each times the root of the segment's length."""
    n, dim = x.shape
    edges = np.linspace(0, dim, min(segments, dim) + 1).astype(int)
    size = np.diff(edges).astype(np.float64)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, deviation]) * np.sqrt(np.hstack([size, size]))


class Best:
    """The best k candidates so far of each query of a block."""

    def __init__(self, own: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int):
        """``own``: the queries' rows."""
        self.own, self.ids, self.q, self.k = own, ids, q, k
        self.largest = float(np.abs(q).max(initial=0))
        self.coarse, self.fine = statistics(q, COARSE), statistics(q, FINE)
        self.norm = np.linalg.norm(q, axis=1)
        self.rows = np.empty(0, np.int64)
        self.found = np.empty(0, np.int64)
        self.scores = np.empty(0, np.int64)
        self.least = np.full(len(ids), -np.inf)

    def take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids = np.concatenate([self.rows, rows]), np.concatenate([self.found, ids])
        scores = np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -1 - scores, rows))  # -1 - s reverses the order without overflow
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.rows, self.found, self.scores = rows[keep], ids[keep], scores[keep]
        last = place == self.k - 1
        self.least[rows[last]] = scores[last].astype(np.float64)

    def add(self, own: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        for i in range(0, len(ids), STEP):
            self.add_step(own[i : i + STEP], ids[i : i + STEP], x[i : i + STEP])

    def add_step(self, own: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        slack = 1e-9 * np.outer(self.norm, np.linalg.norm(x, axis=1)) + 1e-6
        need = self.least[:, None] - slack
        alive = self.coarse @ statistics(x, COARSE).T >= need
        columns = np.flatnonzero(alive.any(axis=0))
        if not len(columns):
            return
        own, ids, x = own[columns], ids[columns], x[columns]
        alive = alive[:, columns] & (self.fine @ statistics(x, FINE).T >= need[:, columns])
        alive &= self.own[:, None] != own[None, :]
        rows, cols = np.nonzero(alive)
        if not len(rows):
            return
        if self.largest * float(np.abs(x).max(initial=0)) * x.shape[1] < EXACT:
            if len(rows) * 8 < alive.size:
                scores = np.einsum("ij,ij->i", self.q[rows], x[cols])
            else:
                scores = (self.q @ x.T)[rows, cols]
            good = scores >= self.least[rows]
            self.take(rows[good], ids[cols[good]], scores[good].astype(np.int64))
        else:  # whole numbers of any size
            big = [max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(self.q[r], x[c], strict=True)))) for r, c in zip(rows, cols, strict=True)]
            self.take(rows, ids[cols], np.array(big, np.int64))


def envelope(x: np.ndarray) -> np.ndarray:
    """Of a block's coarse statistics and norms the least and the largest, as one row."""
    s = np.hstack([statistics(x, COARSE), np.linalg.norm(x, axis=1)[:, None]])
    return np.concatenate([s.min(axis=0), s.max(axis=0)])


def largest(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """No product of vectors within the envelopes ``q`` (rows) and ``x`` (one) is larger."""
    q_lo, q_hi = np.split(q, 2, axis=1)
    x_lo, x_hi = np.split(x, 2)
    ends = np.max([q_lo * x_lo, q_lo * x_hi, q_hi * x_lo, q_hi * x_hi], axis=0)
    return np.minimum(ends[:, :-1].sum(axis=1), q_hi[:, -1] * x_hi[-1])


def _sample(whole: DataFrame) -> dict[int, tuple]:
    """Of each of the commonest lengths the rows that come first."""
    lengths = whole.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    out = {}
    for r in lengths:
        rows = whole.where(F.size("v") == r["dim"]).orderBy("row").limit(SAMPLE).collect()  # SAMPLE rows
        out[r["dim"]] = tuple(np.array([x[c] for x in rows]) for c in ("row", "vec_id", "v"))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(scale * x)."""
    spark = vectors.sparkSession
    # floor() gives longs; beyond their range a double is whole anyway
    def scaled(x):
        return F.when(F.abs(x * scale) < 4e18, F.floor(x * scale).cast("double")).otherwise(x * scale)

    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    whole = cut(usable(vectors, first=-norm).withColumn("v", F.transform("v", scaled)))  # long vectors first, blocks of like lengths
    asked = whole.where(is_query)
    n_blocks = max(1, -(-asked.count() // QUERIES))
    queries = asked.repartition(n_blocks, F.pmod(F.xxhash64("row"), F.lit(n_blocks))).mapInArrow(lambda b: pack(b, QUERIES), PACKED)
    queries = cut(queries.withColumn("q", F.monotonically_increasing_id()))
    sample = spark.sparkContext.broadcast(_sample(whole))

    def met_first(batches):
        """Of each block of queries: its length, its envelope, and what its queries reach at least among the sample."""
        for batch in batches:
            for row in batch.to_pylist():
                best = Best(*unpack(row["dim"], row["rows"], row["ids"], row["data"]), k)
                if row["dim"] in sample.value:
                    best.add(*sample.value[row["dim"]])
                body = np.concatenate([[best.least.min()], envelope(best.q)])
                yield pa.RecordBatch.from_pydict({"q": [row["q"]], "dim": pa.array([row["dim"]], pa.int32()), "body": [body.tobytes()]})

    known: dict[int, list] = {}
    for r in queries.mapInArrow(tidy(met_first), "q long, dim int, body binary").collect():  # a row of some 200 bytes for each block of queries
        known.setdefault(r["dim"], []).append((r["q"], np.frombuffer(r["body"])))
    bounds = spark.sparkContext.broadcast({d: (np.array([q for q, _ in x], np.int64), np.stack([b for _, b in x])) for d, x in known.items()})
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = max(1, -(-2 * n_tasks // n_blocks))

    def send(batches):
        """Each block of vectors, to the blocks of queries that may find a neighbour in it."""
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] not in bounds.value:
                    continue
                q, known = bounds.value[row["dim"]]
                x = envelope(unpack(row["dim"], row["rows"], row["ids"], row["data"])[2])
                most = largest(known[:, 1:], x)
                q = q[most + 1e-9 * np.abs(most) + 1e-6 >= known[:, 0]]
                if not len(q):
                    continue
                split = int(np.frombuffer(row["rows"], np.int64)[0] // BLOCK % splits)
                for i in range(0, len(q), 16):
                    n = len(q[i : i + 16])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q[i : i + n]), pa.array([split] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array([row["dim"]] * n, pa.int32()), *[pa.array([row[c]] * n, pa.binary()) for c in ("rows", "ids", "data")]],
                        names=["q", "s", "kind", "dim", "rows", "ids", "data"],
                    )

    sent = whole.mapInArrow(tidy(lambda b: pack(b, BLOCK)), PACKED).mapInArrow(tidy(send), "q long, s int, kind int, " + PACKED)
    copies = queries.select("q", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("s"), F.lit(0).alias("kind"), "dim", "rows", "ids", "data")
    dealt = copies.unionByName(sent).repartition(n_tasks, "q", "s").sortWithinPartitions("q", "s", "kind")

    def search(batches):
        best = None

        def result():
            return pa.RecordBatch.from_arrays(
                [pa.array(best.own[best.rows]), pa.array(best.ids[best.rows]), pa.array(best.found), pa.array(best.scores)], names=["asked", "query_id", "vec_id", "score"]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                part = unpack(row["dim"], row["rows"], row["ids"], row["data"])
                if row["kind"] == 0:
                    if best is not None:
                        yield result()
                    best = Best(*part, k)
                else:
                    best.add(*part)
        if best is not None:
            yield result()

    found = dealt.mapInArrow(tidy(search), "asked long, query_id long, vec_id long, score long")
    order = W.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
