"""Near-duplicate embeddings by cross-polytope hashing.

1. Classes. Rows with equal vector and label are one class, found by a 128-bit hash of
   both, and numbered by their least id. Only classes are hashed and compared; their
   sizes count as links.
2. Hashing. A hash turns a vector, padded to a power of two, by three rounds of random
   signs and a fast Hadamard transform, and takes its largest coordinate with its sign:
   the nearest corner of the cross-polytope. A table joins ``k`` hashes; k is the least
   at which a table has as many cells as the largest label has classes. A class lies in
   the bucket of its corners and probes, for each hash, the bucket with the second
   nearest corner. How often two vectors at the threshold so meet in a table is measured
   on random pairs, and there are as many tables as bring a miss below ``MISS``.
3. Comparison. Buckets with two or more classes, one of them at home, get the vectors by
   equality joins. One with over ``BLOCK`` classes is divided into blocks, and each pair
   of blocks is a group of its own, so that no task holds a large bucket. Cosines are
   worked out in double precision from the vectors as they are. A pair counts in the
   first table in which it meets, in one bucket of it, so sums need no list of pairs: a
   group returns, for each class, how many rows it is linked with, and a star for each
   of its connected parts.
4. Components come from the stars.

Defined results: a row whose label is null, or whose vector is null, empty, zero or holds
a null or non-finite component, has no links and is its own component, as has any vector
without a link. Vectors of different lengths aren't compared. Repeated rows link with each
other. A null id comes after all others and names a component only if all its ids are
null; such rows are kept. Labels may be of any type that can be grouped. An empty table
gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import tidy
from weftgraph.operators.closure import components
from weftgraph.session import cut, cut_table, numbered, ship

#: Share of pairs at the threshold that may meet in no table.
MISS = 0.001
#: Classes of a bucket that are compared as one group, and as many pairs at once.
BLOCK = 1024
PAIRS = 1 << 15
#: Groups of at most so many classes are compared together with others.
FEW = 24
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The rows of x (their length a power of two) after a fast Hadamard transform, lengths kept."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        h *= 2
    return x.reshape(n, d) / math.sqrt(d)


def corners(x: np.ndarray, number: int) -> np.ndarray:
    """The nearest and second nearest corner of hash ``number`` for each row of x: twice the coordinate, and one more if negative."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    turned = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([number, d]).choice([-1.0, 1.0], (ROUNDS, d))
    for s in signs:
        turned = hadamard(turned * s)
    size = np.abs(turned)
    rows = np.arange(len(x))
    first = size.argmax(axis=1)
    size[rows, first] = -1
    both = np.stack([first, size.argmax(axis=1)], axis=1)
    return both * 2 + (np.take_along_axis(turned, both, 1) < 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(x: np.ndarray, spaces: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Keys of the buckets of each row: [row, table, 0] at home, [row, table, 1 + i] with the second corner of hash i."""
    out = np.empty((len(x), tables, 1 + k), np.uint64)
    for t in range(tables):
        near = np.stack([corners(x, t * k + i) for i in range(k)], axis=1).astype(np.uint64)  # row, hash, nearness
        for probe in range(1 + k):
            key = _mixed(spaces.view(np.uint64) + np.uint64(t * 2 + 1))
            for i in range(k):
                key = _mixed(key * np.uint64(3) + near[:, i, int(probe == 1 + i)])
            out[:, t, probe] = key
    return out.view(np.int64)


def tables_for(dim: int, k: int, least: float) -> int:
    """How many tables bring the chance that two vectors of cosine ``least`` meet in none below MISS."""
    rng, n = np.random.default_rng(dim), 2000
    x, other = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    across = other - (other * x).sum(axis=1, keepdims=True) * x
    across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-300)
    a, b = corners(x, 0), corners(least * x + math.sqrt(max(0.0, 1 - least * least)) * across, 0)
    same = float((a[:, 0] == b[:, 0]).mean())
    probed = float(((a[:, 0] == b[:, 1]) | (a[:, 1] == b[:, 0])).mean())
    met = min(0.999, max(0.02, same**k + k * same ** (k - 1) * probed))
    return max(1, math.ceil(math.log(MISS) / math.log(1 - met)))


def _hashed(plan: dict[int, tuple[int, int]]):
    """Rows (row, space, copies, v) to the same with v and keys as bytes."""

    def run(batches):
        for batch in batches:
            row, space, copies, v = batch.columns
            sizes = np.diff(v.offsets.to_numpy())
            for dim in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == dim))
                x = v.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                own = space.take(at)
                keys = codes(x, own.to_numpy(zero_copy_only=False), *plan[int(dim)])
                parts = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, keys.reshape(len(x), -1))]
                widths = pa.array(np.full(len(x), keys.shape[2], np.int32))
                yield pa.RecordBatch.from_arrays([row.take(at), own, copies.take(at), widths, *parts], names=["row", "space", "copies", "width", "v", "keys"])

    return run


def _entries(batches):
    """Rows (row, width, keys) to one for each key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row, width = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        keys = [np.frombuffer(b, np.int64) for b in batch.column(2).to_pylist()]
        sizes = np.array([len(k) for k in keys])
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        parts = [np.concatenate(keys), np.repeat(row, sizes), place % np.repeat(width, sizes) == 0]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts], names=["key", "row", "home"])


def _groups(batches):
    """Record batches sorted by key, i and j, cut so that each holds whole groups, with where these start."""
    rest = None
    for batch in batches:
        whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not whole.num_rows:
            continue
        key = np.stack([whole.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        if len(starts) > 1:
            yield whole.slice(0, starts[-1]), starts[:-1]
        rest = whole.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(1, np.int64)


class _Rows:
    """The rows of a batch: what a comparison of two of them needs."""

    def __init__(self, batch: pa.RecordBatch):
        of = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        plain = ("key", "row", "space", "copies", "side", "width")
        self.key, self.row, self.space, self.copies, self.side, width = (of[n].to_numpy(zero_copy_only=False) for n in plain)
        self.alone = of["i"].to_numpy(zero_copy_only=False) == of["j"].to_numpy(zero_copy_only=False)  # a block with itself
        self.v = [np.frombuffer(b, np.float64) for b in of["v"].to_pylist()]
        self.codes = [np.frombuffer(b, np.int64).reshape(-1, w) for b, w in zip(of["keys"].to_pylist(), width, strict=True)]


class _Alike:
    """Rows (places ``at``) with vectors of one length, and the links among them that count in their bucket."""

    def __init__(self, rows: _Rows, at: np.ndarray, least: float):
        self.rows, self.at, self.least = rows, at, least
        self.x, self.keys = np.stack([rows.v[i] for i in at]), np.stack([rows.codes[i] for i in at])
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))

    def linked(self, a: np.ndarray, b: np.ndarray):
        """Of the pairs (a, b) those near enough that meet here first, as places."""
        rows, at, keys = self.rows, self.at, self.keys
        for i in range(0, len(a), PAIRS):
            p, q = a[i : i + PAIRS], b[i : i + PAIRS]
            near = np.einsum("ij,ij->i", self.x[p], self.x[q]) / (self.norm[p] * self.norm[q]) >= self.least
            p, q = p[near], q[near]
            swap = rows.row[at[p]] > rows.row[at[q]]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            to, back = (keys[p][:, :, :1] == keys[q]).any(axis=2), (keys[q][:, :, :1] == keys[p]).any(axis=2)
            met = to | back
            t, n = met.argmax(axis=1), np.arange(len(p))
            first = np.where(to[n, t], keys[p, t, 0], keys[q, t, 0])
            own = met.any(axis=1) & (first == rows.key[at[p]])
            yield at[p[own]], at[q[own]]

    def neighbours(self, end: np.ndarray):
        """Links within groups, each of which ends where ``end`` says, all groups at once."""
        rows, at = self.rows, self.at
        for step in range(1, FEW):
            p = np.flatnonzero(end[:-step] == end[step:])
            if not len(p):
                return
            a, b = at[p], at[p + step]
            ok = (rows.space[a] == rows.space[b]) & (rows.alone[a] | (rows.side[a] != rows.side[b]))
            yield from self.linked(p[ok], p[ok] + step)

    def crossed(self):
        """Links of one large group: within a block, or from one block to the other."""
        side, alone = self.rows.side[self.at], self.rows.alone[self.at[0]]
        unit = self.x / self.norm[:, None]
        ones, others = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if alone else 1))
        for i in range(0, len(ones), 256):  # a little under the threshold: the links are worked out exactly
            p, q = np.nonzero(unit[ones[i : i + 256]] @ unit[others].T >= self.least - 1e-9)
            p, q = ones[p + i], others[q]
            yield from self.linked(*((p[p < q], q[p < q]) if alone else (p, q)))


def _compared(least: float):
    """Groups to rows (row, links, root): what each class is linked with, and a member of its part of the group."""

    def answer(rows: _Rows, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        n = len(rows.row)
        links = np.bincount(a, rows.copies[b].astype(np.float64), n) + np.bincount(b, rows.copies[a].astype(np.float64), n)
        root = np.arange(n)
        while True:  # the least place of each part; pairs never leave their group
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        told = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(rows.row[told]), pa.array(links[told].astype(np.int64)), pa.array(rows.row[root[told]])], names=["row", "links", "root"])

    def run(batches):
        for batch, starts in _groups(batches):
            sizes = np.diff(np.r_[starts, batch.num_rows])
            rows = _Rows(batch)
            found = []
            few = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
            end = np.repeat(starts + sizes, sizes)[few]
            lengths = np.array([len(rows.v[i]) for i in few])
            for dim in np.unique(lengths):
                own = lengths == dim
                found += _Alike(rows, few[own], least).neighbours(end[own])
            for start, size in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
                part = np.arange(start, start + size)
                for space in np.unique(rows.space[part]):
                    found += _Alike(rows, part[rows.space[part] == space], least).crossed()
            if sum(len(a) for a, _ in found):
                yield answer(rows, *(np.concatenate(c) for c in zip(*found, strict=True)))

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``, linked with those of its label at a cosine of ``least`` or more."""
    spark = vectors.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    use = F.coalesce(F.col("label").isNotNull() & v.isNotNull() & (F.size("v") > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", *[F.when(use, F.xxhash64(F.lit(s), "label", "v")).alias(f"h{s}") for s in (1, 2)], F.when(use, F.xxhash64(F.lit(3), "label", F.size("v"))).alias("space"), F.when(use, v).alias("v"))
    same = ["h1", "h2"]
    classes = rows.where("h1 is not null").groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("space").alias("space"), F.first("v").alias("v"))
    classes = numbered(classes.withColumn("no_id", F.col("least").isNull()), "row", "no_id", "least", *same)
    # one row for each length of vector
    lengths = classes.groupBy("space").agg(F.count("*").alias("n"), F.first(F.size("v")).alias("dim")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    plan = {}
    for dim, most in lengths:
        k = max(1, math.ceil(math.log(max(2, most)) / math.log(2 << max(1, (dim - 1).bit_length()))))
        plan[dim] = k, tables_for(dim, k, least)
    hashed = cut_table(classes.select("row", "space", "copies", "v").mapInArrow(tidy(_hashed(plan)), "row long, space long, copies long, width int, v binary, keys binary"))
    entries = hashed.select("row", "width", "keys").mapInArrow(tidy(_entries), "key long, row long, home boolean")
    met = entries.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("at_home")).where("n > 1 and at_home").select("key", "n")
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int")
    block = F.pmod(F.xxhash64("row"), blocks).cast("int")
    dealt = entries.join(met, "key").select("key", "row", block.alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    dealt = dealt.select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"), "row")
    group = ["key", "i", "j"]
    full = dealt.join(hashed, "row").select(*group, "side", "row", "space", "copies", "width", "v", "keys")
    found = cut_table(full.repartition(n, *group).sortWithinPartitions(*group, "side", "row").mapInArrow(tidy(_compared(least)), "row long, links long, root long"))
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(found.where("row <> root").select(F.col("row").alias("u"), F.col("root").alias("v")))
    named = classes.select("row", *same, "copies", F.col("least").alias("own")).join(links, "row", "left").join(roots.withColumnRenamed("node", "row"), "row", "left")
    named = named.withColumn("root", F.coalesce("root", "row"))
    heads = classes.select(F.col("row").alias("root"), F.col("least").alias("component_id"))  # rows are numbered by id, so the least has the least id
    named = named.join(heads, "root").select(*[F.col(h).alias(f"of_{h}") for h in same], (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", *same).join(named, (F.col("h1") == F.col("of_h1")) & (F.col("h2") == F.col("of_h2")), "left")
    component = F.when(F.col("of_h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
