"""Mixing sources to target weights, with DataFrame operations only.

1. Targets. Sources in code point order (null last) weigh by the cycle of
   ``weights``; they share ``share`` of all words by weight, a target stops at
   ``max_repeats`` times its source's size and the excess goes to the others by
   weight. In closed form: sorted by size over weight, the first sources stop,
   and the rest share what is left.
2. Quotas. A source's documents are permuted by a hash of their content; a block is
   a range of the permutation that holds about ``block_rows`` documents. A quota is
   a number of block draws: whole passes over the source, and a run of blocks from
   the start of one more pass, of which the last is cut at the quota, to the word.
3. Splitting tree. The root holds every source's quota and all output shards. A node
   gives its left half of the shards as many draws as these are to have, and how many
   of them come from each source is drawn from the multivariate hypergeometric
   distribution: source by source, each count given those before it, by inversion of
   the distribution with a uniform number hashed from seed, node and source.
4. Draws. A source's draws are permuted once more; the leaves take disjoint runs of
   that order, as long as the counts that came down to them. What the mix takes of a
   document is summed up from its block's draws in the leaves.
5. Order. Each draw of a document gets a place by a hash of shard, document and repeat;
   ``mixed_documents`` sorts each shard's documents so.

Defined results: a null text has size 0; a null source is a source of its own, the
last; documents of size 0 take 0 words; an empty table gives no rows; repeated rows
are separate documents, and where the cut falls among them any of them may be cut, as
nothing tells them apart; columns other than the three named don't matter and may have
any name. Every figure follows from the rows alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm.common import if_small, n_words
from weftgraph.session import cut, numbered

BY = ["skey", "no_source"]
#: Deviations from the mean over which a count is inverted; beyond them lies less than a double can tell from nothing.
REACH = 12.0


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """One row per source with its weight, target and quota. ``sizes`` has a row per source."""
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = W.orderBy(F.col("no_source"), F.col("skey"))
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    stops = weighed.withColumn("stop", F.col("source_size") * F.lit(float(max_repeats)))
    order = W.orderBy(F.col("stop") / F.col("weight"), "no_source", "skey")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    stepped = stops.withColumn("level", level).withColumn("open", F.col("stop") > F.col("level") * F.col("weight"))
    # the first source in this order that does not stop sets the level of the rest; of equal ratios, the first by name
    first = F.min(F.when(F.col("open"), F.struct(F.col("stop") / F.col("weight"), *BY[::-1], F.col("level")))).over(everything)["level"]
    target = F.when(first.isNull(), F.col("stop")).otherwise(F.least(F.col("stop"), first * F.col("weight")))
    quota = F.least(F.round("target").cast("long"), F.col("source_size") * max_repeats)
    return (
        stepped.withColumn("target", target)
        .withColumn("quota", quota)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
        .select(*BY, "n_docs", "source_size", "target", "passes", "rest")
    )


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, worked out once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, marked: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``marked`` of ``total`` are among as many draws without return, by inversion at ``uniform`` in [0, 1)."""

    def invert(b: Column) -> Column:
        n, k, d = b["n"], b["k"], b["d"]

        def further(acc: Column, x: Column) -> Column:  # the next value's weight from this one's
            return acc["w"] * (k - x) * (d - x) / ((x + 1) * F.greatest(n - k - d + x + 1, F.lit(1.0)))

        values = F.sequence(b["lo"].cast("long"), b["hi"].cast("long"))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        whole = F.aggregate(values, start, lambda acc, x: F.struct(further(acc, x).alias("w"), (acc["sum"] + acc["w"]).alias("sum")))["sum"]

        def find(goal: Column) -> Column:
            begun = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), b["lo"].cast("long").alias("at"))
            step = lambda acc, x: F.struct(
                further(acc, x).alias("w"), (acc["sum"] + acc["w"]).alias("sum"), F.when(acc["sum"] + acc["w"] <= goal, x + 1).otherwise(acc["at"]).alias("at")
            )
            return F.least(F.aggregate(values, begun, step)["at"], b["hi"].cast("long"))

        return _let(whole * uniform, find)

    n, k, d = (F.greatest(c, F.lit(0)).cast("double") for c in (total, marked, draws))
    mean = d * k / F.greatest(n, F.lit(1.0))
    spread = F.sqrt(mean * (n - k) / F.greatest(n, F.lit(1.0)) * (n - d) / F.greatest(n - 1, F.lit(1.0))) * REACH + 2
    lo = F.greatest(F.lit(0.0), d + k - n, F.floor(mean - spread).cast("double"))
    hi = F.least(k, d, F.ceil(mean + spread).cast("double"))
    return _let(F.struct(n.alias("n"), k.alias("k"), d.alias("d"), lo.alias("lo"), hi.alias("hi")), invert)


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """skey, no_source, shard, n: the draws of each source (``quotas``: skey, no_source, draws) that each output shard is to have.

    A node is one row that holds a count for each source; sources are few, documents and blocks don't matter here.
    """
    ordered = F.array_sort(F.collect_list(F.struct("no_source", "skey", F.col("draws").cast("long").alias("draws"))))
    node = cut(quotas.agg(ordered.alias("q"))).select(
        F.transform("q", lambda x: F.struct(x["no_source"].alias("no_source"), x["skey"].alias("skey"))).alias("sources"),
        F.transform("q", lambda x: x["draws"]).alias("counts"),
        F.lit(0).alias("lo"),
        F.lit(shards).alias("width"),
    )
    whole = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, x: acc + x)
    for _ in range(max(0, shards - 1).bit_length()):
        begun = F.struct(F.floor(F.col("m") * F.expr("width div 2") / F.col("width")).cast("long").alias("draws"), F.col("m").alias("left"), F.lit(0).alias("i"), F.array().cast("array<long>").alias("out"))

        def deal(acc: Column, count: Column) -> Column:
            drawn = hypergeometric(acc["left"], count, acc["draws"], _uniform(F.lit(seed), F.col("lo"), F.col("width"), acc["i"]))
            return _let(drawn, lambda x: F.struct((acc["draws"] - x).alias("draws"), (acc["left"] - count).alias("left"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(x)).alias("out")))

        drawn = node.withColumn("m", whole).withColumn("l", F.aggregate("counts", begun, deal)["out"])
        left = F.struct("lo", F.expr("width div 2").alias("width"), F.col("l").alias("counts"))
        right = F.struct((F.col("lo") + F.expr("width div 2")).alias("lo"), (F.col("width") - F.expr("width div 2")).alias("width"), F.zip_with("counts", "l", lambda a, b: a - b).alias("counts"))
        same = F.struct("lo", "width", "counts")
        node = cut(drawn.select("sources", F.explode(F.when(F.col("width") > 1, F.array(left, right)).otherwise(F.array(same))).alias("c")).select("sources", "c.*"))
    leaves = node.select("sources", F.col("lo").alias("shard"), F.posexplode("counts").alias("i", "n"))
    return leaves.select(F.element_at("sources", F.col("i") + 1).alias("s"), "shard", "n").select("s.skey", "s.no_source", "shard", "n")


def _drawn(docs: DataFrame, weights, share, max_repeats, shards, seed, block_rows) -> DataFrame:
    """``docs`` (row, doc_id, source, text_hash, size) with source_size, target, taken and, of each draw, its shard."""
    placed = docs.select(
        "*",
        F.coalesce("source", F.lit("")).alias("skey"),
        F.col("source").isNull().alias("no_source"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("source"), F.col("text_hash")).alias("draw"),
    )
    sizes = placed.groupBy(*BY).agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    sources = cut(_targets(sizes, weights, share, max_repeats))
    # a block's number: as many leading bits of the permutation as the source's documents need
    bits = F.least(F.lit(30), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / F.lit(float(block_rows)))).cast("int")))
    placed = placed.join(if_small(sources.withColumn("bits", bits)), BY).withColumn(
        "block", F.expr("CASE WHEN bits = 0 THEN 0L ELSE shiftrightunsigned(draw, 64 - bits) END")
    )
    summed = placed.groupBy(*BY, "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    in_source = W.partitionBy(*BY).orderBy("block")
    blocks = cut(
        summed.withColumn("before", F.sum("words").over(in_source) - F.col("words"))
        .withColumn("in_rest", F.col("before") < F.col("rest"))
        .withColumn("is_cut", F.col("in_rest") & (F.col("before") + F.col("words") > F.col("rest")))
    )
    # every draw of the quotas once, in an order of its own for each source
    times = (F.col("passes") + F.col("in_rest").cast("int")).cast("int")
    draws = blocks.where(times > 0).select(*BY, "block", F.explode(F.sequence(F.lit(1), times)).alias("pass"), "passes")
    by_chance = W.partitionBy(*BY).orderBy(F.xxhash64(F.lit(seed + 1), *BY, "block", "pass"), "block", "pass")
    draws = draws.withColumn("place", F.row_number().over(by_chance))
    quotas = draws.groupBy(*BY).agg(F.count("*").alias("draws"))
    # the leaves' runs of that order
    upto = W.partitionBy(*BY).orderBy("shard")
    runs = split(quotas, shards, seed).withColumn("last", F.sum("n").over(upto)).where("n > 0")
    runs = runs.select(F.col("skey").alias("of"), F.col("no_source").alias("of_none"), "shard", (F.col("last") - F.col("n")).alias("after"), "last")
    mine = (F.col("skey") == F.col("of")) & (F.col("no_source") == F.col("of_none")) & (F.col("place") > F.col("after")) & (F.col("place") <= F.col("last"))
    dealt = draws.join(if_small(cut(runs)), mine).groupBy(*BY, "block").agg(
        F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("in"),
        F.sum((F.col("pass") <= F.col("passes")).cast("int")).alias("whole"),
        F.sum((F.col("pass") > F.col("passes")).cast("int")).alias("more"),
    )
    chosen = blocks.join(dealt, [*BY, "block"], "left").select(
        *BY, "block", "before", "is_cut", F.col("in").alias("draws"), F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("more", F.lit(0)).alias("more")
    )
    rows = placed.join(if_small(cut(chosen)), [*BY, "block"])
    full = rows.where(~F.col("is_cut")).withColumn("extra", F.col("size") * F.col("more"))
    # in the cut blocks, the words up to the quota: summed within parts of their order and over the parts
    ordered = numbered(rows.where("is_cut"), "nth", *BY, "draw", "doc_id", "text_hash", "size").withColumn("part", F.spark_partition_id())
    ordered = cut(ordered)
    parts = ordered.groupBy(*BY, "part").agg(F.sum("size").alias("in_part"))
    parts = parts.select(*BY, "part", (F.sum("in_part").over(W.partitionBy(*BY).orderBy("part")) - F.col("in_part")).alias("ahead"))
    inside = W.partitionBy(*BY, "part").orderBy("nth")
    cut_rows = ordered.withColumn("at", F.sum("size").over(inside) - F.col("size")).join(if_small(cut(parts)), [*BY, "part"])
    left = F.col("rest") - F.col("before") - F.col("ahead") - F.col("at")
    cut_rows = cut_rows.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)) * F.col("more")).select(*rows.columns, "extra")
    repeats = F.col("whole") + (F.col("extra") > 0).cast("int")
    both = full.unionByName(cut_rows).withColumn("taken", (F.col("size") * F.col("whole") + F.col("extra")).cast("long"))
    kept = F.slice(F.coalesce(F.transform("draws", lambda x: x["shard"]), F.array().cast("array<int>")), F.lit(1), repeats.cast("int"))
    return both.withColumn("shards", kept)


def _keyed(docs: DataFrame, **more) -> DataFrame:
    return docs.select(
        "doc_id", "source", F.xxhash64("text").alias("text_hash"), n_words(F.col("text")).alias("size"), *[c.alias(k) for k, c in more.items()]
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    max_repeats: int = 3,
    shards: int = 8,
    seed: int = 1,
    block_rows: int = 2048,
) -> DataFrame:
    """What the mix takes of each document: doc_id, source, text_hash, size,
    source_size, target, taken, and ``shards``, the output shard of each repeat, with
    ``places``, what the repeat is sorted by in its shard.

    The table of sources has a row per source and that of blocks a row per
    ``block_rows`` documents; both are counted, and broadcast only if they have few
    rows, so that a source with very many documents doesn't meet in one task.
    """
    drawn = _drawn(cut(_keyed(docs)), weights, share, max_repeats, shards, seed, block_rows)
    place = F.transform("shards", lambda s, i: F.xxhash64(F.lit(seed + 2), s, "doc_id", "text_hash", i))
    return drawn.select("doc_id", "source", "text_hash", "size", "source_size", "target", "taken", "shards", place.alias("places"))


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    max_repeats: int = 3,
    shards: int = 8,
    seed: int = 1,
    block_rows: int = 2048,
) -> DataFrame:
    """The documents of the mix as rows, each as often as it is taken, whole, and shuffled
    within their shard: a document that the cut at the quota divides stays if at least half
    of it is taken. Columns as in ``docs``, in the order of shards and places; a document of
    size 0 stays once if its source is taken."""
    rows = _keyed(docs, whole_row=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    drawn = _drawn(rows, weights, share, max_repeats, shards, seed, block_rows)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise((F.size("draws") > 0).cast("int")).cast("int")
    kept = F.slice(F.transform("draws", lambda x: x["shard"]), F.lit(1), F.coalesce(times, F.lit(0)))
    content = F.xxhash64(*[f"whole_row.`{f.name}`" for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))])
    taken = drawn.select("whole_row", content.alias("content"), F.posexplode(kept).alias("repeat", "shard"))
    # rows that are alike in all of this are equal, and told apart only so that they don't meet in one task
    by = ["shard", F.xxhash64(F.lit(seed + 2), "shard", "content", "repeat").alias("place"), F.monotonically_increasing_id().alias("tie")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = taken.select(*by, "whole_row").repartitionByRange(n, "shard", "place", "tie").sortWithinPartitions("shard", "place", "tie")
    return ordered.select("whole_row.*")
