"""Closures over edges: reachability and representatives."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import cut, nothing, ship


def prepared(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) as several closures over them can share: distinct, and computed once."""
    return cut(edges.select(F.col("a").alias("_from"), F.col("b").alias("_to")).distinct())


def jumps(pointers: DataFrame, rounds: int = 64) -> tuple[list[DataFrame], DataFrame]:
    """Of ``pointers`` (_from, _to; at most one from each node): for each power of two, where as many steps lead; and the
    nodes from which steps never end, as they lead into a cycle.

    Each table is the one before joined with itself, and holds only nodes that far from their end, so the number
    of rounds is the logarithm of the longest chain. Beyond as many steps as there are nodes only cycles are left.
    """
    nodes = pointers.count()
    tables = []
    now = pointers
    for k in range(rounds):
        if now.isEmpty():
            return tables, now.select(F.col("_from").alias("a"))
        if 1 << k > nodes:
            return tables, cut(now.select(F.col("_from").alias("a")))
        tables.append(now)
        onward = now.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        now = cut(now.join(onward, "_to").select("_from", F.col("_next").alias("_to")))
    raise RuntimeError("chains of over 2^64 steps")


def walks(pointers: DataFrame, seeds: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(a, b, step): the nodes that a chain leads through from each seed a, and after how many steps; no seed may lead into a cycle.

    Doubling: a round takes all that is reached 2^k steps further, so a list of n cells takes log n rounds, and
    what is joined in all of them together is twice the result at most.
    """
    found = cut(seeds.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(0).cast("long").alias("step")))
    for k, table in enumerate(tables):
        further = found.join(table, found["b"] == table["_from"]).select("a", F.col("_to").alias("b"), (F.col("step") + (1 << k)).alias("step"))
        found = cut(found.unionByName(further))
    return found


def circling(pointers: DataFrame, seeds: DataFrame, tables: list[DataFrame], reflexive: bool) -> DataFrame:
    """(a, b): the nodes that a chain leads through from each seed a which leads into a cycle, each once.

    Doubling as in ``walks``; the tables of ``jumps`` cover at least as many steps as there are nodes, so the cycle is closed.
    """
    start = seeds.select("a").distinct()
    if reflexive:
        found = cut(start.select("a", F.col("a").alias("b")))
    else:
        found = cut(start.join(pointers, start["a"] == pointers["_from"]).select("a", F.col("_to").alias("b")))
    for table in tables:
        further = found.join(table, found["b"] == table["_from"]).select("a", F.col("_to").alias("b"))
        found = cut(found.unionByName(further).distinct())
    return found


def closure(edges: DataFrame, seeds: DataFrame, reflexive: bool = True, rounds: int = 10_000) -> DataFrame:
    """Distinct pairs (a, b): b is reachable from the seed a over ``edges`` (a, b).

    Where no node has two edges (lists, redirects) chains are followed by doubling, in a logarithmic number of rounds,
    cycles too; else ``over_hubs``. ``seeds`` has a column a; ``edges`` may be ``prepared``.
    """
    edges = edges if "_from" in edges.columns else prepared(edges)
    if edges.isEmpty():
        return seeds.select("a").distinct().select("a", F.col("a").alias("b")).where(F.lit(reflexive))
    if not edges.groupBy("_from").count().where("count > 1").isEmpty():
        return over_hubs(edges, seeds, reflexive, rounds)
    tables, endless = jumps(edges)
    cyclic = not endless.isEmpty()
    straight = seeds.join(endless, "a", "left_anti") if cyclic else seeds
    pairs = walks(edges, straight, tables).where(F.col("step") > (-1 if reflexive else 0)).select("a", "b")
    return pairs.unionByName(circling(edges, seeds.join(endless, "a", "left_semi"), tables, reflexive)) if cyclic else pairs


#: From more starts than these a closure goes over the condensed graph; fewer reach less than condensing reads.
MANY_STARTS = 64


def over_hubs(edges: DataFrame, seeds: DataFrame, reflexive: bool, rounds: int = 10_000, many: int = MANY_STARTS) -> DataFrame:
    """Closure over any ``prepared`` edges, in as many rounds as there are hubs one after the other.

    A node with one edge in and one out lies inside a chain, any other is a hub. Chains between hubs become one edge each, by
    doubling. Of many starts, hubs that reach each other count as one (``strong_components``), so a pair is found once for
    a component and not for each of its nodes and edges. Then each hub's chains are put back: as a node lies inside one
    chain at most, what is joined there is the result and repeats only hubs.
    """
    degrees = edges.select(F.explode(F.array(F.struct(F.col("_from").alias("n"), F.lit(1).alias("out")), F.struct(F.col("_to").alias("n"), F.lit(0).alias("out")))).alias("e"))
    inner = cut(degrees.groupBy("e.n").agg(F.sum("e.out").alias("out"), F.count("*").alias("all")).where("out = 1 AND all = 2").select("n"))
    marked = edges.join(inner.select(F.col("n").alias("_from"), F.lit(True).alias("from_in")), "_from", "left")
    marked = cut(marked.join(inner.select(F.col("n").alias("_to"), F.lit(True).alias("to_in")), "_to", "left").select("_from", "_to", F.coalesce("from_in", F.lit(False)).alias("from_in"), F.coalesce("to_in", F.lit(False)).alias("to_in")))
    pointers = marked.where("from_in AND to_in").select("_from", "_to")
    tables, endless = jumps(pointers)  # a cycle without a hub is met from its own nodes alone
    leaving = marked.where("from_in AND NOT to_in").select(F.col("_from").alias("last"), F.col("_to").alias("exit"))
    lasts = representatives(pointers.select(F.col("_from").alias("a"), F.col("_to").alias("b")).join(endless, "a", "left_anti"))
    exits = cut(leaving.select(F.col("last").alias("cell"), "exit").unionByName(lasts.join(leaving, lasts["root"] == leaving["last"]).select(F.col("a").alias("cell"), "exit")))
    entering = marked.where("NOT from_in AND to_in").select(F.col("_from").alias("hub"), F.col("_to").alias("a"))
    far = entering.join(exits, entering["a"] == exits["cell"]).select(F.col("hub").alias("_from"), F.col("exit").alias("_to"))
    links = cut(marked.where("NOT from_in AND NOT to_in").select("_from", "_to").unionByName(far).distinct())
    chained = entering.join(walks(pointers, entering.select("a"), tables), "a").select("hub", F.col("b").alias("node"))
    below = cut(links.select(F.col("_from").alias("hub"), F.col("_to").alias("node")).unionByName(chained))

    start = cut(seeds.select("a").distinct())
    inside = start.join(inner, start["a"] == inner["n"], "left_semi")
    # of a seed inside a chain: its own cells after it, the hub they lead to, and what that reaches
    ends = inside.join(exits, inside["a"] == exits["cell"]).select("a", F.col("exit").alias("hub"))
    starts = cut(start.join(inner, start["a"] == inner["n"], "left_anti").select("a", F.col("a").alias("hub")).unionByName(ends))
    hubs = starts.select(F.col("hub").alias("a")).distinct()
    if hubs.limit(many + 1).count() > many:
        strong = strong_components(links)
        named = lambda c, to: F.coalesce(to, F.col(c)).alias(c)
        by = lambda frame, c: frame.join(strong.select(F.col("node").alias(c), F.col("root").alias("_root")), c, "left").select(*[named(c, F.col("_root")) if x == c else x for x in frame.columns])
        starts, below = by(starts, "hub"), cut(by(below, "hub").distinct())
        links = cut(by(by(links, "_from"), "_to").where("_from <> _to").distinct())
        hubs = starts.select(F.col("hub").alias("a")).distinct()
    reached = frontiers(links, hubs, True, rounds).select(F.col("a").alias("hub"), F.col("b").alias("_at"))
    found = starts.join(reached, "hub").join(below.select(F.col("hub").alias("_at"), F.col("node").alias("b")), "_at").select("a", "b")
    own = walks(pointers, inside.join(endless, "a", "left_anti"), tables).where("step > 0").select("a", "b")
    found = found.unionByName(own).unionByName(ends.select("a", F.col("hub").alias("b")))
    found = found.unionByName(circling(pointers, inside.join(endless, "a", "left_semi"), tables, reflexive))
    if reflexive:
        found = found.unionByName(start.select("a", F.col("a").alias("b")))
    return found.distinct()


def _spread(edges: DataFrame, marks: DataFrame, rounds: int) -> DataFrame:
    """(node, mark): the least of ``marks`` (node, mark) that leads to each node over ``edges`` (_from, _to); a round takes
    only nodes whose mark has just changed."""
    known = front = marks
    for _ in range(rounds):
        offered = front.join(edges, front["node"] == edges["_from"]).groupBy(F.col("_to").alias("node")).agg(F.min("mark").alias("offer"))
        step = cut(known.join(offered, "node", "left").select("node", F.least("mark", "offer").alias("mark"), F.coalesce(F.col("offer") < F.col("mark"), F.lit(False)).alias("moved")))
        known, front = step.select("node", "mark"), step.where("moved").select("node", "mark")
        if front.isEmpty():
            return known
    raise RuntimeError("marks did not settle")


def strong_components(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, root) for every node of ``edges`` (_from, _to) that lies on a cycle of two or more nodes: nodes that reach each other
    share a root, one of them.

    Forward-backward colouring: nodes that nothing leads to, or that lead nowhere, are trimmed until none is left; each node
    takes the least mark that reaches it; where a mark's own node is reached back inside its colour, that is a component.
    Marks are in the order of a hash, so a colour that holds several components is halved by a round, about, however they are named.
    """
    left = cut(edges.select("_from", "_to").where("_from <> _to").distinct())
    done = left.select(F.col("_from").alias("node"), F.col("_to").alias("root")).where(F.lit(False))
    for _ in range(rounds):
        before = left.count()
        while before:
            kept = left.join(left.select(F.col("_to").alias("_from")).distinct(), "_from", "left_semi")
            left = cut(kept.join(left.select(F.col("_from").alias("_to")).distinct(), "_to", "left_semi").select("_from", "_to"))
            before, last = left.count(), before
            if before == last:
                break
        if not before:
            return done
        mark = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))
        nodes = left.select(F.col("_from").alias("node")).distinct()  # trimmed: each node has an edge out
        colours = _spread(left, cut(nodes.select("node", mark.alias("mark"))), rounds)
        ends = left.join(colours.select(F.col("node").alias("_from"), F.col("mark").alias("one")), "_from").join(colours.select(F.col("node").alias("_to"), F.col("mark").alias("two")), "_to")
        left = cut(ends.where("one = two").select("_from", "_to"))
        back = left.select(F.col("_to").alias("_from"), F.col("_from").alias("_to"))
        met = frontiers(back, colours.where("mark.n = node").select(F.col("node").alias("a")), True, rounds).select(F.col("b").alias("node"), F.col("a").alias("root"))
        whole = met.groupBy("root").count().where("count > 1").select("root")
        done = cut(done.unionByName(met.join(whole, "root", "left_semi").select("node", "root")))
        over = met.select("node")
        left = left.join(over.select(F.col("node").alias("_from")), "_from", "left_anti").join(over.select(F.col("node").alias("_to")), "_to", "left_anti")
        left = cut(left.select("_from", "_to"))
    raise RuntimeError("components did not settle")


def frontiers(edges: DataFrame, seeds: DataFrame, reflexive: bool, rounds: int) -> DataFrame:
    """Semi-naive closure over any ``prepared`` edges: each round joins only what the last one found, and drops pairs already
    known, so cycles end."""
    start = seeds.select("a").distinct().select("a", F.col("a").alias("b"))
    known = cut(start if reflexive else start.join(edges, start["b"] == edges["_from"]).select("a", F.col("_to").alias("b")).distinct())
    front = known
    for _ in range(rounds):
        front = front.join(edges, front["b"] == edges["_from"]).select("a", F.col("_to").alias("b")).distinct()
        front = cut(front.join(known, ["a", "b"], "left_anti"))
        if front.isEmpty():
            return known
        known = known.unionByName(front)
    raise RuntimeError("closure did not end")


def list_members(rest: DataFrame, heads: DataFrame, firsts: DataFrame) -> DataFrame:
    """``heads`` (head, ...) with the members of the lists they begin, from ``firsts`` (cell, ...), and ``position`` from 0.

    ``rest`` (a, b) leads from a cell to the next. A malformed list, whose cells have two followers or come round again,
    has each of its cells once, without a position.
    """
    rest = rest if "_from" in rest.columns else prepared(rest)
    seeds = heads.select(F.col("head").alias("a")).distinct()
    none = F.lit(None).cast("long")
    if rest.isEmpty():
        cells = seeds.select("a", F.col("a").alias("b"), F.lit(0).cast("long").alias("step"))
    elif not rest.groupBy("_from").count().where("count > 1").isEmpty():
        cells = closure(rest, seeds).withColumn("step", none)
    else:
        tables, endless = jumps(rest)
        cyclic = not endless.isEmpty()
        cells = walks(rest, seeds.join(endless, "a", "left_anti") if cyclic else seeds, tables)
        if cyclic:
            cells = cells.unionByName(circling(rest, seeds.join(endless, "a", "left_semi"), tables, True).withColumn("step", none))
    placed = cells.select(F.col("a").alias("head"), F.col("b").alias("cell"), F.col("step").alias("position"))
    return heads.join(placed, "head").join(firsts, "cell").drop("cell")


def signed_components(edges: DataFrame) -> DataFrame:
    """node, root, opposite, torn for every node of ``edges`` (u, v, opposite): the least node of its component, whether it is
    the opposite of that, and whether the component contradicts itself, as a node would be its own opposite.

    Each node is taken twice, as it is and reversed; an edge between opposites ties one's node to the other's reverse.
    So components keep the sign, an inverse of an inverse is the node itself, and star contraction stays as it is.
    """
    plain, back = F.lit("+"), F.lit("-")
    sign = lambda s, c: F.concat(s, F.col(c).cast("string"))
    first = F.struct(sign(plain, "u").alias("u"), F.when(F.col("opposite"), sign(back, "v")).otherwise(sign(plain, "v")).alias("v"))
    second = F.struct(sign(back, "u").alias("u"), F.when(F.col("opposite"), sign(plain, "v")).otherwise(sign(back, "v")).alias("v"))
    roots = components(edges.select(F.explode(F.array(first, second)).alias("e")).select("e.*"))
    both = roots.groupBy(F.substring("node", 2, 1 << 30).alias("node")).agg(
        F.max(F.when(F.substring("node", 1, 1) == "+", F.col("root"))).alias("up"), F.max(F.when(F.substring("node", 1, 1) == "-", F.col("root"))).alias("down")
    )
    # the two copies of a component have the same nodes, each once: the least of them is the root, in one of the copies as it is
    named = both.withColumn("home", F.least(F.substring("up", 2, 1 << 30), F.substring("down", 2, 1 << 30)))
    return named.select("node", F.col("home").alias("root"), (F.col("up") != F.concat(plain, "home")).alias("opposite"), (F.col("up") == F.col("down")).alias("torn"))


#: Pointers to one node that make it hot: so many, and this share of all pointers, so there are at most as many hot nodes as the share has parts.
HOT, HOT_SHARE = 100_000, 10_000


def _led_on(rows: DataFrame, known: DataFrame, many: int) -> DataFrame:
    """``rows`` (a, root) with their root replaced by that which ``known`` (a, root, done) has for it, and whether it is the last.

    The few nodes that very many rows point at are looked up apart and sent to every task, so their rows don't meet in one.
    """
    to = known.select(F.col("a").alias("_a"), F.col("root").alias("_next"), F.col("done").alias("_done"))
    shown = ["a", F.coalesce("_next", "root").alias("root"), F.coalesce("_done", F.lit(True)).alias("done")]
    counts = rows.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > many).select("root")
    hot = cut(counts.join(to, counts["root"] == to["_a"], "left").select(F.col("root").alias("_hot"), "_next", "_done"))
    if hot.isEmpty():
        return rows.join(to, rows["root"] == to["_a"], "left").select(*shown)
    spread = rows.join(F.broadcast(hot), rows["root"] == hot["_hot"]).select(*shown)
    rest = rows.join(F.broadcast(hot.select("_hot")), rows["root"] == hot["_hot"], "left_anti")
    return spread.unionByName(rest.join(to, rest["root"] == to["_a"], "left").select(*shown))


def representatives(pointers: DataFrame, rounds: int = 64, hot: int = HOT) -> DataFrame:
    """(a, root) for every a of a forest of pointers (a, b): pointer doubling, so a chain of n takes log n rounds.

    Rows that have come to a root leave the rounds: else all rows of a tree would be joined by its root, in one task.
    """
    known = cut(pointers.select("a", F.col("b").alias("root"), F.lit(False).alias("done")))
    many = max(hot, known.count() // HOT_SHARE)
    for _ in range(rounds):
        step = _led_on(known.where("NOT done").select("a", "root"), known, many)
        known = cut(step.unionByName(known.where("done")))
        if known.where("NOT done").isEmpty():
            return known.select("a", "root")
    raise RuntimeError("the pointers have a cycle")


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and its neighbours. The minimum is summed up before
    the shuffle, and a hot node's edges are split by the join."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u")


#: So many edges of plain values, counted first, are tied together by one task; it holds some tens of MB.
FEW_EDGES = 200_000


def _tied(batches):
    """Rows (u, v) of all edges: each node with the least node it is tied to."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, b = sorted((find(u), find(v)))
            root[b] = a
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (u, v): the root is the least node of its component.

    Large-star and small-star steps in turn: each links the neighbours of a node to the
    least of them, until every component is a star; the number of rounds grows with the
    logarithm of the components' size. A few edges (``FEW_EDGES``) go to one task.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if nothing(now):
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    kind = now.schema["u"].dataType.simpleString()
    if kind in ("bigint", "int") and now.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        ship(now.sparkSession)
        return cut(now.coalesce(1).mapInArrow(_tied, f"node {kind}, root {kind}"))
    now = cut(now.distinct())
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = _with_least(down)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen["n"], seen["h"]):
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def least_members(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node connected with each node of the undirected ``pairs`` (a, b)."""
    return components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
