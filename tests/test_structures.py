"""Stored quads, lists, chains, signed components and the properties they make the same."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.assemble import assemble
from weftgraph.operators.closure import closure, list_members, over_hubs, prepared, representatives, signed_components, strong_components
from weftgraph.sources.store import Store, rows_frame
from weftgraph.sources.turtle import read_turtle

HEAD = "@prefix : <http://x.org/o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . <http://x.org/o> a owl:Ontology .\n"


def quad(g, s, p, o):
    return g, "I", s, p, "I", o, None, None


# ---- the store
def test_insertion_reads_and_writes_its_own_graph(spark, tmp_path):
    store = Store(spark, path=str(tmp_path / "s"))
    store.add(rows_frame(spark, [quad("urn:a/b c%", f"s{i}", f"p{i % 3}", "o") for i in range(30)]))
    store.add(rows_frame(spark, [quad("urn:g2", f"s{i}", "p", "o") for i in range(5)]))
    store.add(rows_frame(spark, [quad("urn:g2", f"s{i}", "p", "o") for i in range(3, 8)] * 2))
    wrote = spark.read.parquet(store.commits[-1])
    assert sorted(r["s"] for r in wrote.collect()) == ["s5", "s6", "s7"] and {r["g"] for r in wrote.select("g").collect()} == {"urn:g2"}
    assert store.graph("urn:g2").count() == 8 and store.graph("urn:a/b c%").count() == 30 and store.quads.count() == 38
    plan = store.graph("urn:g2").where("p = 'p'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(g" in plan and "PushedFilters: [IsNotNull(p), EqualTo(p,p)]" in plan
    read = store.graph("urn:g2").select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) == 2 and not any("commit=0" in r["f"] for r in read)
    assert store.query("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s <p> ?o } } GROUP BY ?g").collect() == [("urn:g2", 8)]


def test_a_store_is_opened_again_and_compacted(spark, tmp_path):
    store = Store(spark, path=str(tmp_path / "s"))
    assert store.quads.count() == 0 and store.quads.columns == ["g", "s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang"]
    for i in range(4):
        store.add(rows_frame(spark, [("g", "I", "s", "p", "L", str(i // 2), "dt", None), ("g", "I", "s", "p", "L", "x", "dt", "en")]))
    assert store.quads.count() == 3 and len(store.commits) == 4
    (tmp_path / "s" / "commit=4").mkdir()  # a commit that was not done
    again = Store(spark, path=str(tmp_path / "s"))
    assert sorted(map(tuple, again.quads.collect()), key=str) == sorted(map(tuple, store.quads.collect()), key=str) and len(again.commits) == 4
    again.add(rows_frame(spark, [quad("h", "s", "p", "o")]))
    whole = again.compact(str(tmp_path / "t"))
    assert len(whole.commits) == 1 and sorted(map(tuple, whole.quads.collect()), key=str) == sorted(map(tuple, again.quads.collect()), key=str)


def test_imports_are_one_commit(spark, tmp_path):
    """A tree of files, two of them with the same content, one missing, one in a circle: each is read once."""
    n = 40
    for i in range(n):
        links = " , ".join(f"<f{j}.ttl>" for j in (2 * i + 1, 2 * i + 2, 0) if j < n)
        (tmp_path / f"f{i}.ttl").write_text(HEAD + f"<http://x.org/o> owl:imports {links} . :C{min(i, n - 2)} a owl:Class ." + (" <http://x.org/o> owl:imports <lost.ttl> ." if i == 5 else ""))
    store = Store(spark, resolve_imports=True)
    g = store.insert_file(str(tmp_path / "f0.ttl"))
    assert len(store.commits) == 1
    assert store.graph(g).where("o = 'http://www.w3.org/2002/07/owl#Class'").count() == n - 1
    assert [x["error_type"] for x in store.notes] == ["Import"] and "lost.ttl" in store.notes[0]["message"]


# ---- lists and chains
def test_lists_of_any_shape(spark):
    rest = [(f"a{i}", f"a{i + 1}") for i in range(300)] + [("t", "a290"), ("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("into", "c1")]
    firsts = [(c, f"m{c}") for c in {x for e in rest for x in e} | {"single"}] + [("a3", "second")]
    heads = [("a0", 1), ("t", 2), ("a299", 3), ("c0", 4), ("into", 5), ("single", 6), ("nowhere", 7), ("a0", 8)]
    frames = [spark.createDataFrame(x, y) for x, y in ((rest, "a string, b string"), (heads, "head string, who int"), (firsts, "cell string, m string"))]
    got = sorted(((r["who"], r["m"], r["position"]) for r in list_members(frames[0], frames[1], frames[2]).collect()), key=str)
    chain = lambda who, cells: [(who, f"m{c}", i) for i, c in enumerate(cells)]
    want = [x for who in (1, 8) for x in chain(who, [f"a{i}" for i in range(301)]) + [(who, "second", 3)]]
    want += chain(2, ["t", *[f"a{i}" for i in range(290, 301)]]) + chain(3, ["a299", "a300"]) + chain(6, ["single"])
    want += [(4, f"mc{i}", None) for i in range(3)] + [(5, m, None) for m in ("minto", "mc0", "mc1", "mc2")]
    assert got == sorted(want, key=str)
    forked = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b")], "a string, b string")
    got = list_members(forked, spark.createDataFrame([("a",)], "head string"), spark.createDataFrame([(x, x) for x in "abc"], "cell string, m string"))
    assert sorted((r["m"], r["position"]) for r in got.collect()) == [("a", None), ("b", None), ("c", None)]


@pytest.mark.parametrize("reflexive", [True, False])
def test_closures_of_chains_and_of_others(spark, reflexive):
    rng = random.Random(4)
    for most in (1, 3):
        edges = {(a, rng.randrange(40)) for a in range(40) for _ in range(rng.randint(0, most))}
        edges = edges if most > 1 else set({a: (a, b) for a, b in edges}.values())
        seeds = rng.sample(range(40), 12) + [99]
        want = set()
        for s in seeds:
            front = {s} if reflexive else {b for a, b in edges if a == s}
            seen = set()
            while front:
                seen |= front
                front = {b for a, b in edges if a in front} - seen
            want |= {(s, x) for x in seen}
        got = closure(spark.createDataFrame(list(edges), "a long, b long"), spark.createDataFrame([(s,) for s in seeds], "a long"), reflexive).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def reach(edges, seeds, reflexive):
    """Pairs by plain search."""
    onward: dict = {}
    for a, b in edges:
        onward.setdefault(a, []).append(b)
    out = set()
    for s in seeds:
        seen, front = ({s} if reflexive else set()), [s]
        while front:
            new = [b for a in front for b in onward.get(a, ())]
            front = [b for b in dict.fromkeys(new) if b not in seen]
            seen.update(front)
        out |= {(s, x) for x in seen}
    return out


def test_a_cycle_of_ten_thousand_nodes(spark):
    """One closed by pointers alone, and one that branches: both in a few rounds, not one for each node."""
    n = 10_000
    ring = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b"))
    seeds = spark.createDataFrame([(0,), (77,)], "a long")
    assert sorted(map(tuple, closure(ring, seeds, False, rounds=40).groupBy("a").count().collect())) == [(0, n), (77, n)]
    # chords, a tail of 5,000 that leads in, one that leads out, and a ring of 3,000 of its own
    more = [(0, 5000), (2500, 7500), (7500, 0)] + [(20_000 + i, 20_001 + i) for i in range(5000)] + [(25_000, 100), (9000, 40_000)]
    more += [(40_000 + i, 40_001 + i) for i in range(3000)] + [(60_000 + i, 60_000 + (i + 1) % 3000) for i in range(3000)]
    edges = [(i, (i + 1) % n) for i in range(n)] + more
    starts = [20_010, 3, 41_000, 60_005, 43_000, 0]
    got = closure(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(s,) for s in starts], "a long"), False, rounds=40)
    count, mark = got.count(), got.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0]
    want = spark.createDataFrame(sorted(reach(edges, starts, False)), "a long, b long")
    assert (count, mark) == (want.count(), want.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0])


def test_closures_by_hubs_and_components(spark):
    """A random graph with chains, self loops and separate rings, over the condensed graph and over the plain one."""
    rng = random.Random(1)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(32)} | {(5, 5), (50, 51), (51, 50), (60, 60), (70, 71)}
    edges |= {(100 + i, 101 + i) for i in range(9)} | {(3, 100), (109, 3), (109, 50)}
    seeds = sorted({x for e in edges for x in e}) + [999]
    frame, starts = prepared(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "a string, b string")), spark.createDataFrame([(f"n{s}",) for s in seeds], "a string")
    for reflexive, many in ((True, 0), (False, 10_000)):
        want = sorted((f"n{a}", f"n{b}") for a, b in reach(edges, seeds, reflexive))
        assert sorted(map(tuple, over_hubs(frame, starts, reflexive, many=many).collect())) == want
    pairs = reach(edges, seeds, True)
    roots = {r["node"]: r["root"] for r in strong_components(frame).collect()}
    for a in seeds:
        both = {f"n{b}" for b in seeds if (a, b) in pairs and (b, a) in pairs}
        assert (roots.get(f"n{a}") in both) if len(both) > 1 else f"n{a}" not in roots
        assert len({roots.get(x) for x in both}) == 1


# ---- signs
def test_signed_components(spark):
    edges = [("p", "q", True), ("q", "r", True), ("r", "s", False), ("z", "y", True), ("y", "x", True), ("x", "z", True), ("b", "p", True), ("k", "l", False), ("e", "e", True)]
    got = {r["node"]: (r["root"], r["opposite"], r["torn"]) for r in signed_components(spark.createDataFrame(edges, "u string, v string, opposite boolean")).collect()}
    assert got == {
        "b": ("b", False, False), "p": ("b", True, False), "q": ("b", False, False), "r": ("b", True, False), "s": ("b", True, False),
        "x": ("x", False, True), "y": ("x", False, True), "z": ("x", False, True), "k": ("k", False, False), "l": ("k", False, False), "e": ("e", False, True),
    }


def drawn(spark, text):
    display = assemble(rows_frame(spark, read_turtle(HEAD + text, "g", "urn:o", "f")))
    short = lambda x: None if x is None else x.replace("http://x.org/o#", ":")
    return display, sorted((short(e["domain"]), e["edge_type"], short(e["property"]), short(e["range"]), e["label"]) for e in display.edges.collect())


CLASSES = ":A a owl:Class . :B a owl:Class . "


def test_a_chain_of_inverses_is_one_pair(spark):
    text = CLASSES + ":p a owl:ObjectProperty ; rdfs:domain :A . :q a owl:ObjectProperty ; owl:inverseOf :p . :r owl:inverseOf :q ; a owl:ObjectProperty ; rdfs:range :B ; a owl:TransitiveProperty ."
    display, edges = drawn(spark, text)
    assert edges == [(":A", "owl:InverseOf", ":p", ":B", "p\nq\nr"), (":B", "owl:InverseOf", ":q", ":A", "p\nq\nr")]
    assert all(e["characteristics"] == ["TransitiveProperty"] for e in display.edges.collect())


def test_blank_names_of_a_property(spark):
    text = CLASSES + ":p a owl:ObjectProperty ; rdfs:domain :A . _:b owl:inverseOf :p ; rdfs:domain :B . _:c owl:inverseOf _:b . :A rdfs:subClassOf [ a owl:Restriction ; owl:onProperty _:c ; owl:someValuesFrom :B ] ."
    _, edges = drawn(spark, text)
    assert edges == [(":A", "owl:ObjectProperty", ":p", ":B", "p"), (":A", "owl:ValuesFrom", ":p", ":B", "p")]


def test_contradicting_inverses_are_reported(spark):
    text = CLASSES + "".join(f":{x} a owl:ObjectProperty ; rdfs:domain :A ; rdfs:range :B ; owl:inverseOf :{y} . " for x, y in ("pq", "qr", "rp"))
    display, edges = drawn(spark, text)
    assert [e[1:3] for e in edges] == [("owl:ObjectProperty", x) for x in (":p", ":q", ":r")]
    assert display.diagnostics.where("message LIKE '%contradict%'").count() == 3


def test_ends_by_rank(spark):
    """A plain class before an operator's, a stated end before a made one."""
    text = CLASSES + ":U a owl:Class ; owl:unionOf ( :A :B ) . :p a owl:ObjectProperty ; rdfs:domain :U , :B ; rdfs:range :U . :q a owl:ObjectProperty ; owl:inverseOf :p ."
    _, edges = drawn(spark, text)
    assert [e for e in edges if e[1] == "owl:InverseOf"] == [(":B", "owl:InverseOf", ":p", ":U", "p\nq"), (":U", "owl:InverseOf", ":q", ":B", "p\nq")]


# ---- representatives
def most_records_of_a_task(spark, run):
    """What ``run`` returns, and the most shuffled records that one of its tasks reads."""
    sc = spark.sparkContext._jsc.sc()
    first = sc.dagScheduler().nextStageId()
    out = run()
    sc.listenerBus().waitUntilEmpty(30_000)
    most = 0
    for stage in range(first, sc.dagScheduler().nextStageId()):
        tasks = sc.statusStore().taskList(stage, 0, 1000)
        for i in range(tasks.size()):
            metrics = tasks.apply(i).taskMetrics()
            most = max(most, metrics.get().shuffleReadMetrics().recordsRead() if metrics.isDefined() else 0)
    return out, most


@pytest.fixture
def unmerged(spark):
    """Partitions as they are dealt: none put together, none split, nothing broadcast unasked."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_the_rows_of_a_tree_do_not_meet_in_one_task(spark, unmerged):
    n = 16_000
    halves = spark.range(1, n).selectExpr("id AS a", "id div 2 AS b")
    got, most = most_records_of_a_task(spark, lambda: representatives(halves).collect())
    assert sorted(map(tuple, got)) == [(a, 0) for a in range(1, n)]
    assert most < n * 3 // 5


def test_rows_that_point_at_one_node_do_not_meet_in_one_task(spark, unmerged):
    n = 16_000
    star = spark.range(10, n).selectExpr("id AS a", "CASE WHEN id % 100 = 0 THEN id - 1 ELSE 3L END AS b")
    pointers = star.unionByName(spark.createDataFrame([(3, 2), (2, 1), (1, -1)], "a long, b long"))
    got, most = most_records_of_a_task(spark, lambda: representatives(pointers, hot=1_000).collect())
    assert sorted(map(tuple, got)) == [(a, -1) for a in (1, 2, 3, *range(10, n))]
    assert most < n * 3 // 5
    with pytest.raises(RuntimeError, match="cycle"):
        representatives(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"), rounds=4)
