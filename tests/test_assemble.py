"""Display graphs of small ontologies, by term and label."""

import re

import pytest

from weftgraph.functions import vocabulary as V
from weftgraph.operators import assemble as assemble_module
from weftgraph.operators import closure, facets
from weftgraph.operators.assemble import assemble, elements, to_json
from weftgraph.plans import snippets, table_queries
from weftgraph.session import cut_some
from weftgraph.sources.store import rows_frame
from weftgraph.sources.turtle import read_turtle

HEAD = """@prefix : <urn:o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix dc: <http://purl.org/dc/elements/1.1/> .
<urn:o> a owl:Ontology ; dc:title "Titel"@de , "Title"@en ; owl:versionInfo "2" . """

CASES = {
    "classes": (":A a owl:Class ; rdfs:label 'Some'@en . :B a owl:Class ; rdfs:subClassOf :A . <urn:x#E> a owl:Class .",
                {("A", "owl:Class", "Some"), ("B", "owl:Class", "B"), ("E", "owl:ExternalClass", "E")}, {("B", "A", "rdfs:subClassOf", None, None, None)}),
    "equivalent": (":A a owl:Class ; owl:equivalentClass :B . :B a owl:Class . :C a owl:Class ; rdfs:subClassOf :B .",
                   {("A", "owl:EquivalentClass", "A\nB"), ("C", "owl:Class", "C")}, {("C", "A", "rdfs:subClassOf", None, None, None)}),
    "disjoint": (":A a owl:Class ; owl:disjointWith :B . :B a owl:Class ; owl:disjointWith :A .",
                 {("A", "owl:Class", "A"), ("B", "owl:Class", "B")}, {("A", "B", "owl:disjointWith", None, None, None)}),
    "union": (":A a owl:Class ; owl:disjointUnionOf ( :B :C ) . :B a owl:Class . :C a owl:Class .",
              {("A", "owl:DisjointUnion", "A"), ("B", "owl:Class", "B"), ("C", "owl:Class", "C")}, {("A", "B", "NoDraw", None, None, None), ("A", "C", "NoDraw", None, None, None)}),
    "property": (":A a owl:Class . :B a owl:Class . :p a owl:ObjectProperty , owl:FunctionalProperty ; rdfs:domain :A ; rdfs:range :B .",
                 {("A", "owl:Class", "A"), ("B", "owl:Class", "B")}, {("A", "B", "owl:ObjectProperty", "p", None, None)}),
    "property_without_range": (":A a owl:Class . :p a owl:ObjectProperty ; rdfs:domain :A . :d a owl:DatatypeProperty ; rdfs:domain :A .",
                               {("A", "owl:Class", "A"), ("A_thing", "owl:Thing", "Thing"), ("d_literal", "rdfs:Literal", "Literal")},
                               {("A", "A_thing", "owl:ObjectProperty", "p", None, None), ("A", "d_literal", "owl:DatatypeProperty", "d", None, None)}),
    "datatype_range": (":A a owl:Class . :d a owl:DatatypeProperty ; rdfs:domain :A ; rdfs:range xsd:int .",
                       {("A", "owl:Class", "A"), ("int", "rdfs:Datatype", "int")}, {("A", "int", "owl:DatatypeProperty", "d", None, None)}),
    "restriction": (":A a owl:Class ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :p ; owl:someValuesFrom :B ] . :B a owl:Class . :p a owl:ObjectProperty .",
                    {("A", "owl:Class", "A"), ("B", "owl:Class", "B")}, {("A", "B", "owl:ValuesFrom", "p", "∃", None)}),
    "cardinality": (":A a owl:Class ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :p ; owl:minCardinality 2 ] , [ a owl:Restriction ; owl:onProperty :p ; owl:onClass :B ; owl:maxQualifiedCardinality 3 ] . :B a owl:Class . :p a owl:ObjectProperty .",
                    {("A", "owl:Class", "A"), ("B", "owl:Class", "B"), ("A_thing", "owl:Thing", "Thing")}, {("A", "A_thing", "owl:ObjectProperty", "p", "2", "*"), ("A", "B", "owl:ObjectProperty", "p", "", "3")}),
    "values": (":A a owl:Class ; owl:equivalentClass [ a owl:Restriction ; owl:onProperty :p ; owl:hasValue :i ] ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :p ; owl:hasSelf true ] . :p a owl:ObjectProperty .",
               {("A", "owl:Class", "A"), ("i", "rdfs:Resource", "i")}, {("A", "i", "owl:ObjectProperty", "p", "value", None), ("A", "A", "owl:ObjectProperty", "p", "self", None)}),
    "nested": (":X a owl:Class ; owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( [ a owl:Restriction ; owl:onProperty :p ; owl:someValuesFrom :Y ] :Z ) ] . :Y a owl:Class . :Z a owl:Class . :p a owl:ObjectProperty .",
               {("X", "owl:IntersectionOf", "X"), ("Y", "owl:Class", "Y"), ("Z", "owl:Class", "Z")}, {("X", "Y", "owl:ValuesFrom", "p", "∃", None), ("X", "Z", "NoDraw", None, None, None)}),
    "inverse": (":A a owl:Class . :B a owl:Class . :p a owl:ObjectProperty ; rdfs:domain :A ; rdfs:range :B ; owl:inverseOf :q . :q a owl:ObjectProperty .",
                {("A", "owl:Class", "A"), ("B", "owl:Class", "B")}, {("A", "B", "owl:InverseOf", "p", None, None), ("B", "A", "owl:InverseOf", "q", None, None)}),
    "deprecated": (":A a owl:Class ; owl:deprecated true . :B a owl:DeprecatedClass . :p a owl:ObjectProperty , owl:DeprecatedProperty ; rdfs:domain :A ; rdfs:range :B .",
                   {("A", "owl:DeprecatedClass", "A"), ("B", "owl:DeprecatedClass", "B")}, {("A", "B", "owl:DeprecatedProperty", "p", None, None)}),
}


def show(iri):
    return iri and iri.rsplit("#", 1)[-1]


def graph(spark, text):
    return rows_frame(spark, list(dict.fromkeys(read_turtle(HEAD + text, "g", "urn:o", "f"))))


@pytest.mark.parametrize("case", CASES)
def test_display(spark, case):
    text, nodes, edges = CASES[case]
    d = assemble(graph(spark, text))
    assert {(show(r["term"]), r["element_type"], r["label"]) for r in d.nodes.collect()} == nodes
    assert {(show(r["domain"]), show(r["range"]), r["edge_type"], show(r["property"]), r["card_min"], r["card_max"]) for r in d.edges.collect()} == edges


def test_counts_traits_metadata_header(spark):
    text = """:A a owl:Class ; rdfs:comment "about A"@en . :i a :A , owl:NamedIndividual . :j a :A . :E a owl:Class ; owl:equivalentClass [ a owl:Class ; owl:oneOf ( :i :j ) ] .
    :B a owl:Class . :p a owl:ObjectProperty , owl:TransitiveProperty , owl:FunctionalProperty ; rdfs:domain :A ; rdfs:range :B .
    [] a owl:Axiom ; owl:annotatedSource :A ; owl:annotatedProperty rdfs:comment ; owl:annotatedTarget "about A" ; rdfs:comment "why" ."""
    d = assemble(graph(spark, text))
    nodes = {show(r["term"]): r for r in d.nodes.collect()}
    assert nodes["A"]["individuals"] == 2 and nodes["E"]["individuals"] == 2
    assert [r["characteristics"] for r in d.edges.where("property = 'urn:o#p'").collect()] == [["FunctionalProperty", "TransitiveProperty"]]
    assert ("urn:o#A", "en", "about A") in {(r["term"], r["lang"], r["value"]) for r in d.metadata.collect()}
    h = d.header.first()
    assert h["document_base"] == "urn:o" and h["title"] == {"de": ["Titel"], "en": ["Title"]} and h["version"] == "2"
    a = d.annotations.first()
    assert a["source"] == "urn:o#A" and list(a["annotations"].values()) == ["why"]
    assert '"triples"' in to_json(d).first()["graph"]
    assert {r["element_type"]: r["n"] for r in facets.counts(d.nodes, d.edges).collect()}["owl:ObjectProperty"] == 1
    total = facets.summary(d.nodes, d.edges).first()
    assert total["nodes"] == d.nodes.count() and total["edges"] == d.edges.count() and total["with_characteristics"] == 1
    kept, left = facets.hide(d.nodes, d.edges, {"rdfs:Resource": False})
    assert kept.where("element_type = 'rdfs:Resource'").count() == 0 and left.where("edge_type = 'NoDraw'").count() == 0
    assert facets.metadata_in(d.metadata, "fr").where("term = 'urn:o#A'").first()["values"] == ["about A"]
    assert facets.search(d.nodes, "a").first()["labels"] == ["A"]


def test_mismatched_inverse_stays_with_a_warning(spark):
    text = ":A a owl:Class . :B a owl:Class . :C a owl:Class . :p a owl:ObjectProperty ; rdfs:domain :A ; rdfs:range :B ; owl:inverseOf :q . :q a owl:ObjectProperty ; rdfs:domain :C ; rdfs:range :A ."
    d = assemble(graph(spark, text))
    assert {r["edge_type"] for r in d.edges.collect()} == {"owl:ObjectProperty"}
    notes = d.diagnostics.collect()
    assert {r["severity"] for r in notes} == {"Warning"} and sum("inverse" in r["message"] for r in notes) == 1


def test_empty_graph(spark):
    d = assemble(rows_frame(spark, []))
    assert d.nodes.count() == 0 and d.edges.count() == 0 and d.diagnostics.count() == 1


PIECES = """
:N rdfs:subClassOf [ a owl:Class ; owl:unionOf (:A :B) ] . :M rdfs:subClassOf [ owl:complementOf :A ] . :D owl:disjointUnionOf (:A :B :A) .
[] a owl:Class ; owl:intersectionOf (:A [ a owl:Restriction ; owl:onProperty :p ; owl:someValuesFrom :B ]) . :A rdfs:subClassOf :D, :B .
:E owl:equivalentClass [ a owl:Class ; owl:oneOf (:i :j) ] . :F owl:oneOf (:i "lit"@en) . :p rdfs:range [ owl:oneOf (:k) ] .
:G owl:deprecated true . :H owl:deprecated "TRUE" . :I owl:deprecated "1"^^xsd:boolean . :J owl:deprecated false .
:q a owl:DatatypeProperty ; rdfs:domain :A, :B . :r a owl:ObjectProperty, owl:SymmetricProperty ; rdfs:range :A . :s a rdf:Property . :t a owl:DatatypeProperty ; rdfs:range xsd:int .
:R a rdfs:Class . :S a rdfs:Class, owl:Class . :A rdfs:label "a"@de, "b" . :A rdf:ID "c" . :i a :A, owl:NamedIndividual . """


def test_solutions_of_each_kind(spark):
    rows = snippets.solutions(graph(spark, PIECES)).collect()
    local = lambda x: None if x is None else re.sub(".*[#/]", "", x)
    of = lambda kind: sorted((local(r["id"]) if r["id_kind"] == "I" else "_", local(r["target"]) if r["target_kind"] != "B" else "_") for r in rows if local(r["nodetype"]) == kind)
    assert of("unionOf") == [("N", "A"), ("N", "B")]  # the anonymous class's operands go to the class below it
    assert of("complementOf") == [("M", "A")]
    assert of("disjointUnionOf") == [("D", "A"), ("D", "A"), ("D", "B")]  # a list may hold a member twice
    assert of("intersectionOf") == [("_", "A"), ("_", "_")]
    assert of("subClassOf") == [("A", "B")]  # what has a set operator is no super class
    assert of("blanknode") == [("_", None)] * 3  # intersection, restriction, enumeration; not the union below which :N is
    # an anonymous enumeration's members come once more for each statement that points at it
    assert of("oneOf") == [("F", "i"), ("F", "lit")] + [("_", x) for x in "iijjkk"]
    assert of("deprecated") == [("G", "true"), ("H", "TRUE"), ("I", "1")]
    assert of("q") == [("A", "Literal"), ("B", "Literal")] and of("t") == [("Literal", "int")]
    assert of("r") == [("Thing", "A")] * 2 and of("s") == [("Thing", "Thing")]  # once for each type
    assert of("Class") == [("R", None), ("S", None)] and of("NamedIndividual").count(("A", "i")) == 1 and ("NamedIndividual", "i") not in of("NamedIndividual")
    labels = sorted((r["label"], r["label_lang"] or "") for r in rows if r["nodetype"] is None)
    assert labels == [("a", "de"), ("b", "")]
    weights = {(local(r["nodetype"]), r["weight"]) for r in rows}
    assert {("Class", 1), ("subClassOf", 2), ("blanknode", None), (None, None), ("ObjectProperty", None)} <= weights


def test_solutions_without_labels(spark):
    lone = [r for r in snippets.solutions(graph(spark, ":A a owl:Class .")).collect() if r["nodetype"] is None]
    assert [(r["id"], r["label"]) for r in lone] == [(None, "")]
    other = [r for r in snippets.solutions(graph(spark, ':A rdf:ID "x", "y" .')).collect() if r["nodetype"] is None]
    assert sorted(r["label"] for r in other) == ["x", "y"]


def test_filtered_solutions(spark):
    q = graph(spark, PIECES + ':A dc:title "t" . :v a xsd:int .')
    assert snippets.solutions(q, {"x": False}).count() == 0
    some = {r["nodetype"] for r in snippets.solutions(q, {V.OWL + "Class": True, V.XSD + "int": True, "unionOf": True, "subclass": False}).collect()}
    assert {V.OWL + "Class", V.XSD + "int", V.OWL + "unionOf", V.OWL + "oneOf"} <= some and not some & {V.DC + "title", V.RDFS + "subClassOf", V.OWL + "complementOf"}


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(closure, "FEW_EDGES", few)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (5, 9), (9, 5), (9, 2), (300, 140), (1000, 2000)]
    got = {r["node"]: r["root"] for r in closure.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in (*range(100, 141), 300)} | {5: 2, 9: 2, 2: 2, 1000: 1000, 2000: 1000}
    assert closure.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_what_cannot_be_drawn_is_reported(spark):
    text = ":A a owl:Class ; rdfs:subClassOf :Unknown , :B . :B a owl:Class . rdfs:label a owl:ObjectProperty . [] a owl:DatatypeProperty . :p a owl:ObjectProperty ; rdfs:comment 'c' ; rdfs:domain :A ; rdfs:range :B ."
    d = assemble(graph(spark, text))
    assert {r["term"] for r in d.nodes.collect()} == {"urn:o#A", "urn:o#B"}
    assert {(r["domain"], r["range"], r["edge_type"]) for r in d.edges.collect()} == {("urn:o#A", "urn:o#B", "rdfs:subClassOf"), ("urn:o#A", "urn:o#B", "owl:ObjectProperty")}
    notes = sorted((r["severity"], r["message"]) for r in d.diagnostics.collect())
    critical = [m for s, m in notes if s == "Critical"]
    assert len(critical) == 3 and any("Triple{ <urn:o#A> - rdfs:subClassOf - <urn:o#Unknown> }: unresolved reference: <urn:o#Unknown>" in m for m in critical)
    assert any(m.startswith("Triple{ _:") and "blank node" in m for m in critical) and any("rdf-schema#label>" in m and "property" in m for m in critical)
    dropped = {m.split(" is dropped")[0] for s, m in notes if s == "Warning"}
    assert f"<{V.RDFS}comment> of <urn:o#p>" in dropped and f"<{V.DC}title> of <urn:o>" in dropped


def test_elements_are_numbered(spark):
    d = assemble(graph(spark, CASES["inverse"][0]))
    drawn, triples = (x.collect() for x in elements(d))
    n = d.nodes.count()
    assert sorted(r["id"] for r in drawn) == list(range(len(drawn))) and {r["id"] for r in drawn if r["individuals"] is not None} == set(range(n))
    assert len(triples) == d.edges.count() and len({r["element"] for r in triples}) == len(drawn) - n < len(triples)  # an inverse's two directions are one element
    term = {r["id"]: r["term"] for r in drawn}
    assert {(term[r["domain"]], term[r["range"]]) for r in triples} == {(r["domain"], r["range"]) for r in d.edges.collect()}
    assert [r["name"] for r in facets.entries(facets.counts(d.nodes, d.edges)).collect()] == sorted(r["name"] for r in facets.entries(facets.counts(d.nodes, d.edges)).collect())


def test_edges_are_told_apart_without_sorting(spark, monkeypatch):
    """Whole rows are told apart by hashing, and where every end is known no edge is dealt out to look for it."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_some(df)

    monkeypatch.setattr(assemble_module, "cut_some", seen)
    lines = spark.createDataFrame([(o, s) for o in range(20) for s in range(o % 5)], "l_orderkey long, l_suppkey long")
    monkeypatch.setattr(table_queries, "table", lambda *a: lines)
    got = table_queries.symmetric_edge_dedup(spark, "")
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(4) for b in range(a + 1, 4)]
    assert not [p for p in plans if "SortAggregate" in p and "edge_type" in p]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = table_queries.disjoint_suppliers(spark, "")._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" in pairs and pairs.count("Exchange hashpartitioning(l_orderkey") + pairs.count("Exchange hashpartitioning(l_suppkey") <= 3
