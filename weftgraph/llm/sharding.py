"""Sharding by a k-d tree over metadata, with DataFrame operations only.

The root holds all documents and all shards. A node that stands for several
shards is split along its widest dimension (its extent over the root's) at the
weighted median, so that each child's bytes match its number of shards; leaves
are the shards and hold the target bytes.

The median is found without sorting a node: bytes are summed per bin of the
node's range, the bin that holds the median is cut into bins again until it has
few rows, and only these are ordered. All nodes of a level are split by the same
jobs; the driver sees one row per node and round. Documents with equal
coordinates are ordered by their text's checksum, a hash of their id and a number
of their own, so copies of a text lie side by side and even equal rows can be told
apart. A cut moves to the edge of a group of copies where that costs less than
``slack`` of a shard's bytes; a larger group is divided, for no group may unbalance
the shards.

Defined results: a null text has 8 bytes and checksum 0, like the empty one; an
empty table gives no rows; repeated rows are separate rows, each with a slot, and
may go to different shards; with fewer documents than shards some shards are empty.
Only doc_id and text are read, so other columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.session import cut, numbered

BINS = 1024
#: A bin with at most so many rows is ordered exactly.
FEW = 10_000
#: What orders rows of equal coordinates; ``row`` differs for all.
TIES = ("text_crc32", "tie", "row")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


class _Node:
    """A node being split: which digit of its order is looked at, in which range, and what lies below it."""

    def __init__(self, first: int, shards: int, left: int, row, dim: str):
        self.first, self.shards, self.left = first, shards, left
        self.goal = row["bytes"] * left / shards
        self.digits = [dim, *TIES]
        self.at, self.fixed, self.below = 0, [], 0
        self.lo, self.hi = row[f"min_{dim}"], row[f"max_{dim}"]
        self.rows, self.group = row["n"], row["bytes"]

    @property
    def digit(self) -> str:
        return self.digits[self.at]

    @property
    def width(self) -> int:
        return (self.hi - self.lo) // BINS + 1

    def inside(self) -> Column:
        """Rows of the range looked at."""
        ok = F.col("node") == self.first
        for name, value in zip(self.digits, self.fixed, strict=False):
            ok &= F.col(name) == value
        return ok & F.col(self.digit).between(self.lo, self.hi)

    def under(self) -> Column:
        """Rows of the node that come before that range."""
        out, equal = F.lit(False), F.col("node") == self.first
        for name, value in zip(self.digits, self.fixed, strict=False):
            out |= equal & (F.col(name) < value)
            equal &= F.col(name) == value
        return out | (equal & (F.col(self.digit) < self.lo))


def _cases(nodes: list[_Node], value) -> Column:
    out = F.lit(None)
    for x in nodes:
        out = F.when(F.col("node") == x.first, value(x)).otherwise(out)
    return out


def _narrow(placed: DataFrame, nodes: list[_Node], slack: float) -> None:
    """Narrow each node's range to the part that holds its median, until that has few rows."""
    while open_ := [x for x in nodes if x.rows > FEW]:
        sums = (
            placed.where(_any([x.inside() for x in open_]))
            .select("node", "size", _cases(open_, lambda x: F.expr(f"({x.digit} - {x.lo}L) div {x.width}L")).alias("bin"), _cases(open_, lambda x: F.col(x.digit)).alias("v"))
            .groupBy("node", "bin")
            .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        by = W.partitionBy("node").orderBy("bin")
        total = F.sum("bytes").over(by)
        goal = _cases(open_, lambda x: F.lit(float(x.goal - x.below)))
        picked = (
            sums.withColumn("before", total - F.col("bytes"))
            .where(F.col("before") <= goal)
            .groupBy("node")
            .agg(F.max_by(F.struct("bytes", "n", "lo", "hi", "before"), "bin").alias("b"))
            .select("node", "b.*")
        )
        found = {r["node"]: r for r in picked.collect()}  # one row for each node
        for x in open_:
            r = found[x.first]
            x.below += r["before"]
            x.lo, x.hi, x.rows, x.group = r["lo"], r["hi"], r["n"], r["bytes"]
            if x.lo < x.hi:
                continue
            if x.at == len(TIES) or (x.at == 1 and x.group <= slack):
                x.rows = 0  # one row or one group, to go to the nearer side as a whole
            else:
                x.fixed.append(x.lo)
                x.at += 1
                x.lo, x.hi = 0, (1 << 32) - 1 if x.at == 1 else (1 << 63) - 1


def _cut_points(placed: DataFrame, nodes: list[_Node], slack: float) -> Column:
    """The rows that go to a left child."""
    _narrow(placed, nodes, slack)
    by_order = [x for x in nodes if x.rows]
    whole = [x for x in nodes if not x.rows]
    left = [x.under() for x in nodes] + [x.inside() for x in whole if x.below + x.group / 2 <= x.goal]
    if by_order:
        coords = F.struct(_cases(by_order, lambda x: F.col(x.digits[0])).alias("c"), *TIES)
        rows = placed.where(_any([x.inside() for x in by_order])).select("node", "size", coords.alias("o"))
        ordered = W.partitionBy("node").orderBy("o").rowsBetween(W.unboundedPreceding, 0)
        group = W.partitionBy("node", "o.c", "o.text_crc32")
        goal = _cases(by_order, lambda x: F.lit(float(x.goal - x.below)))
        ends = (
            rows.withColumn("before", F.sum("size").over(ordered) - F.col("size"))
            .withColumns({"group": F.sum("size").over(group), "start": F.min("before").over(group)})
            .where(F.when(F.col("group") <= slack, F.col("start") + F.col("group") / 2).otherwise(F.col("before") + F.col("size") / 2) <= goal)
            .groupBy("node")
            .agg(F.max("o").alias("o"))
            .select("node", "o.*")
        )
        last = {r["node"]: r for r in ends.collect()}  # one row for each node at most
        for x in by_order:
            if r := last.get(x.first):
                here = F.struct(F.col(x.digits[0]).alias("c"), *TIES)
                left.append(x.inside() & (here <= F.struct(*[F.lit(r[k]).cast("long").alias(k) for k in ("c", *TIES)])))
    return _any(left)


def kd_shards(docs: DataFrame, shards: int = 24, dims: dict[str, Column] | None = None, slack_share: float = 0.005) -> DataFrame:
    """doc_id, size, text_crc32 and shard of each document.

    ``dims`` names the dimensions, as columns of non-negative whole numbers; by
    default the size and the checksum of the text, so that copies share a point.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    dims = dims or {"size": size, "text_crc32": crc}
    placed = cut(
        docs.select(
            "doc_id",
            size.alias("size"),
            crc.alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 1).alias("tie"),
            F.monotonically_increasing_id().alias("row"),  # tells equal rows apart, and nothing else
            *[c.cast("long").alias(n) for n, c in dims.items() if n not in ("size", "text_crc32")],
        )
    ).withColumn("node", F.lit(0))
    tree, extent, slack = {0: shards}, {}, 0.0
    while any(n > 1 for n in tree.values()):
        stats = placed.groupBy("node").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("n"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))]
        )
        nodes = []
        for r in stats.collect():  # one row for each node
            if not extent:
                extent = {d: max(1, r[f"max_{d}"] - r[f"min_{d}"]) for d in dims}
                slack = slack_share * r["bytes"] / shards
            n = tree[r["node"]]
            if n > 1:
                widest = max(dims, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / extent[d])
                nodes.append(_Node(r["node"], n, n // 2, r, widest))
        if not nodes:
            break
        goes_left = _cut_points(placed, nodes, slack)
        moved = _cases(nodes, lambda x: F.lit(x.first + x.left))
        # cut here: the next level reads a node's number many times
        placed = cut(placed.withColumn("node", F.when(goes_left | ~F.col("node").isin([x.first for x in nodes]), F.col("node")).otherwise(moved)))
        for first, n in list(tree.items()):
            if n > 1:
                tree[first], tree[first + n // 2] = n // 2, n - n // 2
    return placed.select("doc_id", "size", "text_crc32", "tie", F.col("node").cast("int").alias("shard"))


def with_slots(sharded: DataFrame) -> DataFrame:
    """``sharded`` with a gapless place from 0 in each shard, in the order of ``tie``: a number over all shards less the shard's first."""
    rows = numbered(sharded, "slot", "shard", "tie", "text_crc32", "size")
    first = rows.groupBy(F.col("shard").alias("of")).agg(F.min("slot").alias("first"))  # a row for each shard
    return rows.join(F.broadcast(first), F.col("shard") == F.col("of")).withColumn("slot", F.col("slot") - F.col("first")).drop("of", "first")
