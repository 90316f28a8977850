from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.plans import algebra as A
from weftgraph.plans import compile as C
from weftgraph.plans.sparql import SparqlError, parse
from weftgraph.sources.store import rows_frame
from weftgraph.sources.turtle import read_turtle

DOC = """@prefix : <urn:x:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :p :b ; :n 1 ; rdfs:label "A"@en , "Ah"@de . :b :p :c ; :n 2.5 . :c :p :a ; :n "x" . :d :list ( :a "two" :c ) ; :flag true . [] :p :z ."""


@pytest.fixture(scope="module")
def graph(spark):
    return C.QuadGraph(rows_frame(spark, read_turtle(DOC, "g", "urn:x:", "doc")).cache())


def ask(graph, text):
    df = C.solutions(C.select(parse(text, {"": "urn:x:"}), graph))
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_paths_end_in_cycles(graph):
    assert ask(graph, "SELECT ?x { :a :p+ ?x }") == [("urn:x:a",), ("urn:x:b",), ("urn:x:c",)]
    assert ask(graph, "SELECT ?x { :a :p* ?x }") == [("urn:x:a",), ("urn:x:b",), ("urn:x:c",)]
    assert ask(graph, "SELECT ?x { :a :p? ?x }") == [("urn:x:a",), ("urn:x:b",)]
    assert ask(graph, "SELECT ?x { :c ^:p ?x }") == [("urn:x:b",)]
    assert ask(graph, "SELECT ?m { :d :list/rdf:rest*/rdf:first ?m }") == [("two",), ("urn:x:a",), ("urn:x:c",)]
    assert ask(graph, "SELECT ?x { :d (:p|:list)/rdf:first ?x }") == [("urn:x:a",)]


def test_errors_are_unbound(graph):
    assert ask(graph, "SELECT ?s ?v { ?s :n ?n BIND(IF(?n > 1, 'big', 'small') AS ?v) }") == [("urn:x:a", "small"), ("urn:x:b", "big"), ("urn:x:c", None)]
    assert ask(graph, "SELECT ?v { :a :n ?n BIND(COALESCE(?n / 0, ?none, 'left') AS ?v) }") == [("left",)]
    assert ask(graph, "SELECT ?s ?w { ?s :p :b OPTIONAL { ?s :none ?t } BIND(IF(?t = :b, 1, 2) AS ?w) }") == [("urn:x:a", None)]


def test_filters(graph):
    assert ask(graph, "SELECT ?s { ?s :n ?n FILTER(?n = 1) }") == [("urn:x:a",)]
    assert ask(graph, "SELECT ?s { ?s :flag true }") == [("urn:x:d",)]
    assert ask(graph, "SELECT ?l { :a rdfs:label ?l FILTER(lang(?l) = 'de') }") == [("Ah",)]
    assert ask(graph, "SELECT ?o { ?s :p ?o FILTER(isBlank(?s)) }") == [("urn:x:z",)]
    assert len(ask(graph, "SELECT ?s { ?s :p ?o FILTER NOT EXISTS { ?o :p ?q } }")) == 1
    assert ask(graph, "SELECT ?s { ?s :p ?o MINUS { ?s :n ?n } FILTER(isIRI(?s)) }") == []


def test_shared_variables_that_may_be_unbound(graph):
    rows = ask(graph, "SELECT ?s ?n { { ?s :n ?n FILTER(?n = 1) } UNION { ?s :flag ?f } OPTIONAL { ?s :n ?n } }")
    assert rows == [("urn:x:a", "1"), ("urn:x:d", None)]


def test_aggregates(graph):
    assert ask(graph, "SELECT (COUNT(*) AS ?n) (GROUP_CONCAT(?l; SEPARATOR='|') AS ?all) { :a rdfs:label ?l }") == [(2, "A|Ah")]
    assert ask(graph, "SELECT (COUNT(?x) AS ?n) { ?x :missing ?y }") == [(0,)]
    assert ask(graph, "SELECT ?s (SUM(?n) AS ?t) { ?s :n ?n } GROUP BY ?s HAVING(SUM(?n) > 1)") == [("urn:x:b", 2.5)]


def test_variable_graph(spark):
    rows = read_turtle(DOC, "urn:g1", "urn:x:", "doc") + read_turtle(DOC, "urn:g2", "urn:x:", "two")
    both = C.QuadGraph(rows_frame(spark, rows))
    assert ask(both, "SELECT ?g ?c { GRAPH ?g { :a :p ?b . ?b :p ?c } }") == [("urn:g1", "urn:x:c"), ("urn:g2", "urn:x:c")]
    assert ask(both, "SELECT ?b { GRAPH <urn:g2> { :a :p ?b } }") == [("urn:x:b",)]


def test_only_select():
    for text in ("ASK { ?s ?p ?o }", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "SELECT ?x { ?x nope:y ?z }", "SELECT ?x { ?x :p }"):
        with pytest.raises(SparqlError):
            parse(text)


def test_parse_tree():
    q = parse("SELECT DISTINCT ?a { ?a <urn:p> [ <urn:q> 'x' ] ; a <urn:T> } ORDER BY DESC(?a) LIMIT 3 OFFSET 1")
    assert q.distinct and q.limit == 3 and q.offset == 1 and not q.order[0][1]
    assert [t.p.iri for t in q.pattern.triples] == ["urn:q", "urn:p", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"]
    assert isinstance(q.pattern, A.Bgp)


def test_parts_of_compatible_solutions_are_dealt_out_evenly(spark):
    """Few values and unbound ones give many pairs from small files: the pairs are made by as many tasks as there are partitions, none has many more than its share."""
    one = spark.range(900).coalesce(1).selectExpr("id AS a", "CASE WHEN id % 3 > 0 THEN id % 2 END AS n")
    two = spark.range(300).coalesce(1).selectExpr("id AS b", "CASE WHEN id % 4 > 0 THEN id % 2 END AS n")
    whole, n = C.Bound(datatype=C.INTEGER), C.Bound(datatype=C.INTEGER, maybe=True)
    got = C.join(C.Relation(one, {"a": whole, "n": n}), C.Relation(two, {"b": whole, "n": n})).df
    rows = got.select("a", "b", "n", F.spark_partition_id().alias("task")).collect()
    x, y = one.collect(), two.collect()
    want = sorted((i["a"], j["b"], i["n"] if i["n"] is not None else j["n"]) for i in x for j in y if i["n"] is None or j["n"] is None or i["n"] == j["n"])
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2])
    assert sorted((tuple(r)[:3] for r in rows), key=key) == sorted(want, key=key)
    most = Counter(r["task"] for r in rows).most_common(1)[0][1]
    assert most < len(rows) / 8


@pytest.mark.parametrize("terms", [False, True])
def test_few_values_of_two_large_sides_are_joined_in_cells(spark, monkeypatch, terms):
    """Where neither side is small, a value's rows still don't meet in one task, and no task has many more pairs than its share."""
    monkeypatch.setattr(C, "SMALL_PART", 50)
    monkeypatch.setattr(C, "CELL", (16, 16), raising=False)
    one = spark.range(900).coalesce(1).selectExpr("id AS a", "CASE WHEN id % 9 > 0 THEN id % 2 END AS n")
    two = spark.range(300).coalesce(1).selectExpr("id AS b", "CASE WHEN id % 10 > 0 THEN id % 2 END AS n")
    whole, n = C.Bound(datatype=C.INTEGER), C.Bound(datatype=C.INTEGER, maybe=True)
    left, right = C.Relation(one, {"a": whole, "n": n}), C.Relation(two, {"b": whole, "n": n})
    if terms:
        left, right = C.as_term(left, "n"), C.as_term(right, "n")
    rows = C.join(left, right).df.select("a", "b", "n", F.spark_partition_id().alias("task")).collect()
    x, y = one.collect(), two.collect()
    want = sorted((i["a"], j["b"], i["n"] if i["n"] is not None else j["n"]) for i in x for j in y if i["n"] is None or j["n"] is None or i["n"] == j["n"])
    key = lambda r: (r[0], r[1], -1 if r[2] is None else int(r[2]))
    assert sorted(((r[0], r[1], r[2] if r[2] is None else int(r[2])) for r in rows), key=key) == sorted(want, key=key)
    most = Counter(r["task"] for r in rows if r["n"] is not None).most_common(1)[0][1]
    assert most < len(rows) / 8
