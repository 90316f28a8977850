import hashlib
import http.server
import random
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from test_assemble import CASES, HEAD, PIECES
from weftgraph.functions.vocabulary import PREFIXES, RDF, XSD
from weftgraph.sources import formats
from weftgraph.sources.store import CATALOG, READERS, WRITERS, Store, StoreError, graph_name, parse_any, parse_lines, read_documents, read_lines, rejected_lines, write_lines
from weftgraph.sources.turtle import ParseError, read_nquads, read_turtle, write_nquads

ONTOLOGY = {
    "ttl": """@prefix : <http://o.test/a#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
<http://o.test/a> a owl:Ontology . :A a owl:Class ; rdfs:label "first"@en ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :r ; owl:someValuesFrom :B ] .
:B a owl:Class . :r a owl:ObjectProperty .""",
    "ofn": """Prefix(:=<http://o.test/a#>)
Ontology(<http://o.test/a> Declaration(Class(:A)) Declaration(Class(:B)) Declaration(ObjectProperty(:r))
  AnnotationAssertion(rdfs:label :A "first"@en) SubClassOf(:A ObjectSomeValuesFrom(:r :B)))""",
    "owx": """<?xml version="1.0"?><Ontology xmlns="http://www.w3.org/2002/07/owl#" ontologyIRI="http://o.test/a">
<Prefix name="rdfs" IRI="http://www.w3.org/2000/01/rdf-schema#"/>
<Declaration><Class IRI="#A"/></Declaration><Declaration><Class IRI="#B"/></Declaration><Declaration><ObjectProperty IRI="#r"/></Declaration>
<AnnotationAssertion><AnnotationProperty abbreviatedIRI="rdfs:label"/><IRI>#A</IRI><Literal xml:lang="en">first</Literal></AnnotationAssertion>
<SubClassOf><Class IRI="#A"/><ObjectSomeValuesFrom><ObjectProperty IRI="#r"/><Class IRI="#B"/></ObjectSomeValuesFrom></SubClassOf></Ontology>""",
    "rdf": """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xml:base="http://o.test/a">
<owl:Ontology rdf:about=""/><owl:Class rdf:about="#A"><rdfs:label xml:lang="en">first</rdfs:label><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#r"/><owl:someValuesFrom rdf:resource="#B"/></owl:Restriction></rdfs:subClassOf></owl:Class>
<owl:Class rdf:ID="B"/><owl:ObjectProperty rdf:about="#r"/></rdf:RDF>""",
    "jsonld": """{"@context": {"owl": "http://www.w3.org/2002/07/owl#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "o": "http://o.test/a#"}, "@graph": [
{"@id": "http://o.test/a", "@type": "owl:Ontology"}, {"@id": "o:B", "@type": "owl:Class"}, {"@id": "o:r", "@type": "owl:ObjectProperty"},
{"@id": "o:A", "@type": "owl:Class", "rdfs:label": {"@value": "first", "@language": "en"}, "rdfs:subClassOf": {"@type": "owl:Restriction", "owl:onProperty": {"@id": "o:r"}, "owl:someValuesFrom": {"@id": "o:B"}}}]}""",
}


def canon(rows):
    """Rows with blank nodes left without a name: enough to tell these small graphs apart."""
    return sorted((r[1], r[2] if r[1] == "I" else "", r[3], r[4], r[5] if r[4] != "B" else "", r[6] or "", r[7] or "") for r in set(rows))


def shape(rows):
    """Rows with each blank node named by what it holds and what holds it, round by round: alike for graphs that are the same but for names."""
    rows = {tuple(r)[1:] for r in rows}
    colour = {x: "" for r in rows for k, x in ((r[0], r[1]), (r[3], r[4])) if k == "B"}
    for _ in range(8):
        seen = {b: ([], []) for b in colour}
        for sk, s, p, ok, o, *rest in rows:
            if sk == "B":
                seen[s][0].append((p, ok, colour.get(o, o) if ok == "B" else o, str(rest)))
            if ok == "B":
                seen[o][1].append((sk, colour[s] if sk == "B" else s, p))
        colour = {b: hashlib.md5(repr([sorted(x) for x in v]).encode()).hexdigest() for b, v in seen.items()}
    return sorted((sk, colour[s] if sk == "B" else s, p, ok, colour[o] if ok == "B" else o, str(rest)) for sk, s, p, ok, o, *rest in rows)


@pytest.mark.parametrize("name", [*CASES, "pieces"])
def test_constructs_survive_every_syntax(name):
    rows = read_turtle(HEAD + (PIECES if name == "pieces" else CASES[name][0]), "g", "urn:o", "f")
    for kind in WRITERS:
        if kind in ("ofn", "owx") and name in ("pieces", "cardinality"):
            continue  # not all of it is an ontology's, or a number's type is put right
        assert shape(READERS[kind](WRITERS[kind](rows), "g", "urn:o", "f")) == shape(rows), kind


@pytest.mark.parametrize("kind", ONTOLOGY)
def test_syntaxes_agree(kind):
    want = canon(READERS["ttl"](ONTOLOGY["ttl"], "g", "http://b/", "f"))
    assert canon(READERS[kind](ONTOLOGY[kind], "g", "http://b/", "f")) == want


@pytest.mark.parametrize("kind", sorted(WRITERS))
def test_round_trip(kind):
    rows = READERS["ttl"](ONTOLOGY["ttl"], "g", "http://b/", "f")
    assert canon(READERS[kind](WRITERS[kind](rows, PREFIXES), "g", "http://b/", "f")) == canon(rows)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",), exclude_characters="\x00"), max_size=40))
def test_any_literal_survives(text):
    rows = [("g", "I", "urn:s", "urn:p", "L", text, XSD + "string", None)]
    assert read_nquads(write_nquads(rows), "g", "", "f") == rows
    assert read_turtle(WRITERS["ttl"](rows), "g", "urn:b", "f") == rows


def test_turtle_details():
    rows = read_turtle('@base <http://b/x/> . <y> <p> 1, 1.5, 1e3, true, "a\\nb", """x"y""", <../z>, "l"@EN-us .', "g", "http://b/", "f")
    assert [r[5] for r in rows] == ["1", "1.5", "1e3", "true", "a\nb", 'x"y', "http://b/z", "l"]
    assert rows[-1][6:] == (RDF + "langString", "en-us") and rows[0][2] == "http://b/x/y"
    with pytest.raises(ParseError):
        read_turtle("nope:x a nope:y .", "g", "", "f")


def test_fallback_finds_the_type():
    rows, kind = parse_any(ONTOLOGY["ofn"], "ttl", "g", "http://b/", "f")
    assert kind == "ofn" and rows
    with pytest.raises(StoreError):
        parse_any("no such language", None, "g", "", "f")


def test_types():
    assert formats.type_of("A.TTL") == "ttl" and formats.strict_type_of("a.TTL") is None
    assert formats.type_of("x.json") == "sparql_json" and formats.type_of("x") == "unknown"
    assert formats.mime_type("owx") == "application/owl+xml" and "sparql_json" not in formats.EXPORTS
    assert graph_name("a b(1).ttl", "u1") == "urn:weftgraph:user:u1:graph:a_b1.ttl"


def test_store(spark, tmp_path):
    (tmp_path / "b.ttl").write_text("@prefix : <urn:b:> . :x :y :z .")
    (tmp_path / "a.ttl").write_text(f"<http://o.test/i> <http://www.w3.org/2002/07/owl#imports> <b.ttl>, <gone.ttl>, <file://{tmp_path}/a.ttl> .")
    store = Store(spark, user="u", resolve_imports=True)
    g = store.insert_file(str(tmp_path / "a.ttl"))
    assert store.graph(g).count() == 4  # three imports and what b holds
    assert store.diagnostics().count() == 1
    before = store.quads.count()
    store.insert_file(str(tmp_path / "a.ttl"))
    assert store.quads.count() == before  # a graph is a set
    key = store.start_upload("up.ttl")
    for part in (b"@prefix : <urn:u:> . ", b":a :b :c ."):
        store.upload_chunk(key, part)
    up = store.complete_upload(key)
    assert "urn:u:b" in store.export(up, "ntriples") and store.graph(up).count() == 1
    assert [r["o"] for r in store.query("SELECT ?o { ?s <urn:u:b> ?o }", up).collect()] == ["urn:u:c"]
    with pytest.raises(ValueError):
        store.query("ASK { ?s ?p ?o }")
    with pytest.raises(StoreError):
        store.insert_file(str(tmp_path / "a.unknown"))
    (tmp_path / CATALOG["OntoViBe"][0]).write_text(ONTOLOGY["ttl"])
    assert store.graph(store.insert_stored("OntoViBe", str(tmp_path))).count() > 0
    with pytest.raises(StoreError):
        store.insert_stored("another", str(tmp_path))
    with pytest.raises(StoreError):
        Store(spark, limit=5).insert_text("@prefix : <urn:u:> .", "x.ttl")
    with pytest.raises(StoreError):
        store.export(up, "sparql_json")


def test_documents_in_parallel_with_diagnostics(spark, tmp_path):
    for kind, text in ONTOLOGY.items():
        (tmp_path / f"x.{formats.TYPES[kind][0]}").write_text(text)
    (tmp_path / "bad.ttl").write_text("this is nothing")
    (tmp_path / "wrong.ttl").write_text(ONTOLOGY["ofn"])
    quads, notes = read_documents(spark, str(tmp_path))
    assert quads.groupBy("g").count().count() == len(ONTOLOGY) + 1
    assert sorted(r["severity"] for r in notes.collect()) == ["Critical", "Warning"]


def test_lines(spark, tmp_path):
    rows = [("g2", "I", "urn:s", "urn:p", "L", 'q"\\n\n\t', XSD + "string", None), ("g2", "B", "f#x", "urn:p", "I", "urn:o", None, None), ("g2", "I", "urn:s", "urn:p", "L", "1", XSD + "int", None), ("g2", "I", "urn:s", "urn:p", "L", "", RDF + "langString", "de")]
    (tmp_path / "f").write_text(write_nquads(rows) + "# comment\nnot a statement\n" + write_nquads(rows))
    got = read_lines(spark, str(tmp_path / "f"), "g")
    assert canon([tuple(r) for r in got.collect()]) == canon(rows) and got.count() == 4
    write_lines(got, str(tmp_path / "out"))
    assert canon([tuple(r) for r in read_lines(spark, str(tmp_path / "out"), "g").collect()]) == canon(rows)


def escaped(rng, text, iri=False):
    """The text with its characters written in one of the ways the syntax has, at random."""
    out = []
    for c in text:
        ways = [] if c in '"\\\n\r' or (iri and c in "<> \\") else [c]
        if not iri and c in SHORT:
            ways.append("\\" + SHORT[c])
        ways.append("\\U%08X" % ord(c) if ord(c) > 0xFFFF else rng.choice(["\\u%04X", "\\u%04x", "\\U%08X"]) % ord(c))
        out.append(rng.choice(ways))
    return "".join(out)


SHORT = {"\t": "t", "\b": "b", "\n": "n", "\r": "r", "\f": "f", '"': '"', "'": "'", "\\": "\\"}


def test_lines_are_read_like_documents(spark, tmp_path):
    rng = random.Random(11)
    letters = "ab u U t\\\\\\\"'\t\b\n\r\f\u00e9\u4e2d\U0001f600\ud7ff\ue000\U0010ffff#.<>@^_:"
    text = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    lines, want = [], []
    for i in range(400):
        value, name = text(12), "urn:x" + "".join(rng.choice("ab\u00e9\U0001f600>") for _ in range(4))
        obj, lang = f'"{escaped(rng, value)}"', rng.choice([None, "de-AT"])
        tail, kind = rng.choice([("", None), ("^^<urn:d\\u00e9>", "urn:d\u00e9"), (f"@{lang}", "@")]) if lang else ("", None)
        graph, g = rng.choice([("", "g"), (" <urn:g\\u00E9>", "urn:g\u00e9"), (" _:own", "f#own")])
        lines.append(f"<{escaped(rng, name, True)}> <urn:p{i}> {obj}{tail}{graph} .")
        want.append((g, "I", name, f"urn:p{i}", "L", value, RDF + "langString" if kind == "@" else kind or XSD + "string", "de-at" if kind == "@" else None))
    bad = ['<urn:a> <urn:p> "\\x" .', '<urn:a> <urn:p> "\\uD800" .', '<urn:a> <urn:p> "\\U00110000" .', "<urn:a> <urn:p> .", "<urn:a b> <urn:p> <urn:c> .", "<> <urn:p> <urn:c> .", 'plain text']
    for line in bad:
        with pytest.raises(ParseError):
            read_nquads(line, "g", "", "f")
    (tmp_path / "f").write_text("\n".join([*lines, *bad, "", "  # comment"]), newline="")
    got = [tuple(r) for r in read_lines(spark, str(tmp_path / "f"), "g").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) == sorted(read_nquads("\n".join(lines), "g", "", "f"), key=str)
    notes = rejected_lines(spark.read.text(str(tmp_path / "f"))).collect()
    assert len(notes) == len(bad) and {r["severity"] for r in notes} == {"Critical"}
    store = Store(spark)
    (tmp_path / "f.nq").write_text("\n".join(bad[:2] + lines[:3]), newline="")
    store.insert_file(str(tmp_path / "f.nq"))
    assert store.quads.count() == 3 and store.diagnostics().count() == 2


def test_very_long_literals_in_lines(spark, tmp_path):
    """Neither the length nor the number of escapes of a literal or an IRI needs a stack; and a text's own line end is kept."""
    texts = ["x" * 300_000, "a\\n\\\\\\u00e9" * 40_000, "\\t" * 100_000]
    lines = [f'<urn:{"y" * 50_000}{i}> <urn:p\\u00e9> "{x}"@en <urn:g> . # "' for i, x in enumerate(texts)]
    (tmp_path / "f").write_text("\n".join(lines))
    want = sorted(read_nquads("\n".join(lines), "g", "", "f"))
    assert sorted(map(tuple, read_lines(spark, str(tmp_path / "f"), "g").collect())) == want and len(want) == 3
    got = parse_lines(spark.createDataFrame([('<urn:a> <urn:b> "one\ntwo" .',), ("\n" * 10,)], "value string"), "g").collect()
    assert [(r["s"], r["o"], r["o_kind"]) for r in got] == [("urn:a", "one\ntwo", "L")]



def test_streaming_intake(spark, tmp_path):
    from weftgraph.streaming.ingest import counts_by_graph, quads_of, start

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nq").write_text("<urn:a> <urn:p> <urn:b> <urn:g1> .\n<urn:a> <urn:p> <urn:c> .\n")
    for name in ("", "b.nq"):
        if name:
            (tmp_path / "in" / name).write_text("<urn:a> <urn:p> <urn:b> <urn:g1> .\n<urn:z> <urn:p> 'x' .\n<urn:z> <urn:p> \"x\" <urn:g1> .\n")
        start(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), "urn:g", once=True).awaitTermination()
    assert {r["g"]: r["n"] for r in counts_by_graph(quads_of(str(tmp_path / "t"), spark)).collect()} == {"urn:g1": 2, "urn:g": 1}


def test_urls_and_query_services(spark):
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def answer(self):
            body = ONTOLOGY["ttl"].encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            self.answer()

        def do_POST(self):  # noqa: N802
            asked.append((self.headers["Accept"], self.rfile.read(int(self.headers["Content-Length"])).decode()))
            self.answer()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        where = f"http://127.0.0.1:{server.server_port}"
        store = Store(spark)
        first = store.insert_url(f"{where}/a/onto.ttl")
        second = store.insert_query(f"{where}/sparql", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }")
        assert store.graph(first).count() == store.graph(second).count() > 0 and first != second
        assert asked[0] == "/a/onto.ttl" and "turtle" in asked[1][0] and asked[1][1].startswith("CONSTRUCT")
        with pytest.raises(StoreError):
            store.insert_url("ftp://127.0.0.1/x.ttl")
    finally:
        server.shutdown()
