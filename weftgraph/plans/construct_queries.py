"""Display graphs of ontologies made from the tables, a query for each family of constructs, each with its SQL.

A query gives the whole display graph as one table: nodes (``a`` the term, ``label`` its label) and edges
(``a`` and ``b`` the ends, ``label`` the property).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.vocabulary import DC, DCTERMS, FIRST, NIL, OWL, RDF, RDFS, REST, TYPE, XSD
from weftgraph.operators.assemble import assemble
from weftgraph.plans import snippets
from weftgraph.plans.table_queries import _iri, _quads, _together
from weftgraph.session import cut, table

CLASS = OWL + "Class"


def drawn(quads: DataFrame) -> DataFrame:
    shown = assemble(quads)
    none = F.lit(None).cast("string")
    nodes = shown.nodes.select(F.lit("node").alias("what"), F.col("term").alias("a"), none.alias("b"), F.col("element_type").alias("type"), "label", none.alias("card_min"), none.alias("card_max"), F.col("individuals").alias("n"))
    edges = shown.edges.select(F.lit("edge").alias("what"), F.col("domain").alias("a"), F.col("range").alias("b"), F.col("edge_type").alias("type"), F.concat_ws(" ", "property", F.replace("label", F.lit("\n"), F.lit("|")), F.array_join("characteristics", ",")).alias("label"), "card_min", "card_max", F.lit(None).cast("long").alias("n"))
    return nodes.withColumn("label", F.replace("label", F.lit("\n"), F.lit("|"))).unionByName(edges)


def lists(df: DataFrame, owner, predicate: str, name, order: str, member, owner_kind: str = "I", member_kind: str = "I") -> DataFrame:
    """Quads of lists: the rows of ``df`` with one ``name`` are the members of one list, in the order of a column."""
    rows = df.select(owner.alias("owner"), name.alias("name"), F.col(order).alias("at"), member.alias("member")).distinct()
    made = rows.groupBy("owner", "name").agg(F.array_sort(F.collect_list(F.struct("at", "member"))).alias("m"))
    cells = made.select("owner", "name", F.size("m").alias("size"), F.posexplode("m").alias("i", "x"))
    cell = lambda i: F.concat_ws("_", F.col("name"), i)
    rest = F.when(F.col("i") + 1 < F.col("size"), cell(F.col("i") + 1)).otherwise(NIL)
    last = F.col("i") + 1 == F.col("size")
    return _together(
        _quads(made, F.col("owner"), predicate, cell(F.lit(0)), owner_kind, "B"),
        _quads(cells, cell(F.col("i")), FIRST, F.col("x.member"), "B", member_kind),
        _quads(cells.where(~last), cell(F.col("i")), REST, rest, "B", "B"),
        _quads(cells.where(last), cell(F.col("i")), REST, rest, "B", "I"),
    )


def ontology(spark) -> DataFrame:
    return _quads(spark.range(1), "urn:o", TYPE, OWL + "Ontology")


def sets_graph(spark, sf_dir) -> DataFrame:
    """Per region a union, a disjoint union and a class below an anonymous union of its nations; per nation an intersection and a complement."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n, r, rn = _iri("n", "n_nationkey"), _iri("r", "r_regionkey"), _iri("r", "n_regionkey")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    both = nation.select("n_nationkey", F.explode(F.array(F.struct(F.lit(0).alias("at"), n.alias("m")), F.struct(F.lit(1).alias("at"), rn.alias("m")))).alias("x")).select("n_nationkey", "x.*")
    return _together(
        ontology(spark), _quads(nation, n, TYPE, CLASS), _quads(nation, n, RDFS + "label", F.col("n_name"), o_kind="L", dt=XSD + "string"), _quads(region, r, TYPE, CLASS),
        *[_quads(region, _iri(k, "r_regionkey"), TYPE, CLASS) for k in "udx"], *[_quads(nation, _iri(k, "n_nationkey"), TYPE, CLASS) for k in "ic"],
        lists(nation, _iri("u", "n_regionkey"), OWL + "unionOf", name("u", "n_regionkey"), "n_nationkey", n),
        lists(nation, _iri("d", "n_regionkey"), OWL + "disjointUnionOf", name("d", "n_regionkey"), "n_nationkey", n),
        _quads(region, _iri("x", "r_regionkey"), RDFS + "subClassOf", name("x", "r_regionkey"), o_kind="B"), _quads(region, name("x", "r_regionkey"), TYPE, CLASS, "B"),
        lists(nation, name("x", "n_regionkey"), OWL + "unionOf", name("y", "n_regionkey"), "n_nationkey", n, "B"),
        lists(both, _iri("i", "n_nationkey"), OWL + "intersectionOf", name("i", "n_nationkey"), "at", F.col("m")),
        _quads(nation, _iri("c", "n_nationkey"), OWL + "complementOf", n),
    )


def restrictions_graph(spark, sf_dir) -> DataFrame:
    """Per part one restriction of one of eleven kinds, stated by subclass or by equivalence."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.regexp_replace("p_brand", "#", "_").alias("brand"), (F.col("p_partkey") % 11).alias("k"))
    p, r, b = _iri("p", "p_partkey"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")), _iri("b", "brand")
    of = lambda *k: part.where(F.col("k").isin(*k))
    size = F.col("p_size").cast("string")
    number = lambda k, name: _quads(of(k), r, OWL + name, size, "B", "L", XSD + "nonNegativeInteger")
    one = spark.range(1)
    return _together(
        ontology(spark), _quads(one, "urn:o#made", TYPE, OWL + "ObjectProperty"), _quads(one, "urn:o#told", TYPE, OWL + "DatatypeProperty"),
        _quads(part, p, TYPE, CLASS), _quads(part.select("brand").distinct(), b, TYPE, CLASS), _quads(part, r, TYPE, OWL + "Restriction", "B"),
        _quads(part.where("p_partkey % 2 = 0"), p, RDFS + "subClassOf", r, o_kind="B"), _quads(part.where("p_partkey % 2 = 1"), p, OWL + "equivalentClass", r, o_kind="B"),
        _quads(of(*range(9)), r, OWL + "onProperty", "urn:o#made", "B"), _quads(of(9, 10), r, OWL + "onProperty", "urn:o#told", "B"),
        _quads(of(0), r, OWL + "someValuesFrom", b, "B"), _quads(of(1), r, OWL + "allValuesFrom", b, "B"), _quads(of(2), r, OWL + "hasValue", _iri("v", "p_size"), "B"),
        _quads(of(3), r, OWL + "hasSelf", "true", "B", "L", XSD + "boolean"), number(4, "cardinality"), number(5, "minCardinality"), number(6, "maxCardinality"),
        number(7, "qualifiedCardinality"), number(8, "minQualifiedCardinality"), number(9, "maxQualifiedCardinality"), _quads(of(7, 8), r, OWL + "onClass", b, "B"),
        _quads(of(9), r, OWL + "onDataRange", XSD + "int", "B"), _quads(of(10), r, OWL + "hasValue", size, "B", "L", XSD + "int"),
    )


def properties_graph(spark, sf_dir) -> DataFrame:
    """Per nation properties with both ends, one, or none; inverses that fit and, for odd regions, that don't; traits, deprecated and external ones."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n, r = _iri("n", "n_nationkey"), _iri("r", "r_regionkey")
    prop = lambda kind: _iri(kind, "n_nationkey")
    f, g = _iri("f", "r_regionkey"), _iri("g", "r_regionkey")
    wrong = F.when(F.col("r_regionkey") % 2 == 1, _iri("n", "r_regionkey")).otherwise(r)
    far = F.concat(F.lit("http://far.example/p"), F.col("r_regionkey").cast("string"))
    return _together(
        ontology(spark), _quads(nation, n, TYPE, CLASS), _quads(region, r, TYPE, CLASS),
        *[_quads(nation, prop(k), TYPE, OWL + "ObjectProperty") for k in ("whole", "only")], *[_quads(nation, prop(k), TYPE, OWL + "DatatypeProperty") for k in ("said", "read", "alone")],
        _quads(nation, prop("whole"), RDFS + "domain", n), _quads(nation, prop("whole"), RDFS + "range", _iri("r", "n_regionkey")), _quads(nation, prop("whole"), TYPE, OWL + "TransitiveProperty"),
        _quads(nation, prop("only"), RDFS + "range", n), _quads(nation, prop("said"), RDFS + "domain", n), _quads(nation, prop("read"), RDFS + "domain", n), _quads(nation, prop("read"), RDFS + "range", XSD + "int"),
        _quads(nation.where("n_nationkey % 5 = 0"), prop("whole"), OWL + "deprecated", "true", o_kind="L", dt=XSD + "boolean"),
        _quads(region, f, TYPE, OWL + "ObjectProperty"), _quads(region, g, TYPE, OWL + "ObjectProperty"), _quads(region, f, OWL + "inverseOf", g), _quads(region, f, TYPE, OWL + "FunctionalProperty"),
        _quads(region, f, RDFS + "domain", r), _quads(region, f, RDFS + "range", _iri("n", "r_regionkey")), _quads(region, g, RDFS + "domain", _iri("n", "r_regionkey")), _quads(region, g, RDFS + "range", wrong),
        _quads(region, far, TYPE, OWL + "ObjectProperty"), _quads(region, far, RDFS + "domain", r), _quads(region, far, RDFS + "range", r),
    )


def classes_graph(spark, sf_dir) -> DataFrame:
    """Enumerations of a nation's suppliers, typed individuals, classes made equivalent, disjoint, deprecated, external or of another kind."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    n, one, e = _iri("n", "n_nationkey"), _iri("s", "s_suppkey"), _iri("e", "s_nationkey")
    far = F.concat(F.lit("http://far.example/c"), F.col("r_regionkey").cast("string"))
    return _together(
        ontology(spark), _quads(nation, n, TYPE, CLASS), _quads(supplier.select("s_nationkey").distinct(), e, TYPE, CLASS),
        lists(supplier, e, OWL + "oneOf", F.concat(F.lit("e"), F.col("s_nationkey").cast("string")), "s_suppkey", one),
        _quads(supplier, one, TYPE, _iri("n", "s_nationkey")), _quads(supplier, one, TYPE, OWL + "NamedIndividual"),
        _quads(nation, _iri("q", "n_nationkey"), TYPE, CLASS), _quads(nation, _iri("q", "n_nationkey"), OWL + "equivalentClass", n), _quads(nation, _iri("q", "n_nationkey"), RDFS + "label", F.concat(F.lit("like "), F.col("n_name")), o_kind="L", dt=XSD + "string"),
        _quads(region, _iri("n", "r_regionkey"), OWL + "disjointWith", _iri("k", "r_regionkey")), _quads(region, _iri("k", "r_regionkey"), OWL + "disjointWith", _iri("n", "r_regionkey")),
        _quads(region, _iri("k", "r_regionkey"), TYPE, RDFS + "Class"), _quads(region, _iri("old", "r_regionkey"), TYPE, CLASS), _quads(region, _iri("old", "r_regionkey"), OWL + "deprecated", "true", o_kind="L", dt=XSD + "boolean"),
        _quads(region, _iri("older", "r_regionkey"), TYPE, OWL + "DeprecatedClass"), _quads(region, far, TYPE, CLASS), _quads(region, far, RDFS + "subClassOf", _iri("old", "r_regionkey")),
    )


def notes_graph(spark, sf_dir) -> DataFrame:
    """Comments in languages, a header, annotated axioms, and what is to be reported."""
    nation, docs = table(spark, sf_dir, "nation"), table(spark, sf_dir, "documents")
    n, ax = _iri("n", "n_nationkey"), F.concat(F.lit("ax"), F.col("n_nationkey").cast("string"))
    said = docs.where("lang IS NOT NULL").select((F.col("doc_id") % 25).alias("n_nationkey"), F.col("doc_id").cast("string").alias("v"), "lang")
    one = spark.range(1)
    text = {"o_kind": "L", "dt": RDF + "langString"}
    return _together(
        ontology(spark), _quads(one, "urn:p", TYPE, OWL + "Ontology"), _quads(nation, n, TYPE, CLASS),
        _quads(said, _iri("n", "n_nationkey"), RDFS + "comment", F.col("v"), lang=F.col("lang"), **text), _quads(docs.where("doc_id % 9 = 0"), "urn:o", DC + "title", F.col("doc_id").cast("string"), lang=F.lit("en"), **text),
        _quads(docs.where("doc_id % 10 = 0"), "urn:o", DCTERMS + "creator", F.col("doc_id").cast("string"), lang=F.lit("de"), **text), _quads(one, "urn:o", OWL + "versionInfo", "3", o_kind="L", dt=XSD + "string"),
        _quads(nation, ax, TYPE, OWL + "Axiom", "B"), _quads(nation, ax, OWL + "annotatedSource", n, "B"), _quads(nation, ax, OWL + "annotatedProperty", RDFS + "subClassOf", "B"), _quads(nation, ax, OWL + "annotatedTarget", _iri("r", "n_regionkey"), "B"),
        _quads(nation, ax, RDFS + "comment", F.col("n_name"), "B", "L", XSD + "string"), _quads(nation, n, RDFS + "subClassOf", _iri("r", "n_regionkey")),
        _quads(nation, F.concat(F.lit("lone"), F.col("n_nationkey").cast("string")), OWL + "onProperty", "urn:o#p", "B"), _quads(nation, F.concat(F.lit("lone"), F.col("n_nationkey").cast("string")), TYPE, OWL + "Restriction", "B"),
    )


def metadata(spark, sf_dir):
    return assemble(notes_graph(spark, sf_dir)).metadata


def header(spark, sf_dir):
    row = assemble(notes_graph(spark, sf_dir)).header
    values = lambda c, lang: F.array_join(F.element_at(c, lang), ",")
    return row.select("document_base", values("title", "en").alias("title"), values("creator", "de").alias("creator"), "version")


def annotations(spark, sf_dir):
    return assemble(notes_graph(spark, sf_dir)).annotations.select("source", "property", "target", F.element_at("annotations", RDFS + "comment").alias("comment"))


def diagnostics(spark, sf_dir):
    return assemble(notes_graph(spark, sf_dir)).diagnostics.select("severity", "error_type", "message")


def solutions_of_kinds(spark, sf_dir):
    """How many rows of each kind the default query gives over all these ontologies at once."""
    graphs = _together(*[g(spark, sf_dir) for g in (sets_graph, restrictions_graph, classes_graph, notes_graph)])
    rows = snippets.solutions(cut(graphs.distinct()))
    return rows.where("nodetype IS NOT NULL").groupBy("nodetype", "weight").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def _draw(graph):
    return lambda spark, sf_dir: drawn(graph(spark, sf_dir))




# ---- the same in SQL
_T = lambda kind, c: f"concat('urn:o#{kind}_', {c})"


def _node(term: str, kind: str, label: str, source: str, n: str = "0") -> str:
    return f"SELECT 'node' AS what, {term} AS a, NULL::VARCHAR AS b, {kind} AS type, {label} AS label, NULL::VARCHAR AS card_min, NULL::VARCHAR AS card_max, ({n})::BIGINT AS n FROM {source}"


def _edge(a: str, b: str, kind: str, label: str, source: str, low: str = "NULL::VARCHAR", high: str = "NULL::VARCHAR") -> str:
    return f"SELECT 'edge' AS what, {a} AS a, {b} AS b, {kind} AS type, {label} AS label, {low} AS card_min, {high} AS card_max, NULL::BIGINT AS n FROM {source}"


def _plain(kind: str, c: str, source: str, node: str = "owl:Class", n: str = "0") -> str:
    return _node(_T(kind, c), f"'{node}'", f"concat('{kind}_', {c})", source, n)


_SETS = " UNION ALL ".join([
    _node(_T("n", "n_nationkey"), "'owl:Class'", "n_name", "nation"), _plain("r", "r_regionkey", "region"),
    _plain("u", "r_regionkey", "region", "owl:UnionOf"), _plain("d", "r_regionkey", "region", "owl:DisjointUnion"), _plain("x", "r_regionkey", "region", "owl:UnionOf"),
    _plain("i", "n_nationkey", "nation", "owl:IntersectionOf"), _plain("c", "n_nationkey", "nation", "owl:Complement"),
    *[_edge(_T(k, "n_regionkey"), _T("n", "n_nationkey"), "'NoDraw'", "''", "nation") for k in "udx"],
    *[_edge(_T(k, "n_nationkey"), _T("n", "n_nationkey"), "'NoDraw'", "''", "nation") for k in "ic"], _edge(_T("i", "n_nationkey"), _T("r", "n_regionkey"), "'NoDraw'", "''", "nation"),
])

_P = "(SELECT p_partkey AS p, p_size::VARCHAR AS size, replace(p_brand, '#', '_') AS brand, p_partkey % 11 AS k FROM part)"
_OWNED = "CASE WHEN k <= 1 OR k IN (7, 8) THEN concat('urn:o#b_', brand) WHEN k = 2 THEN concat('urn:o#v_', size) WHEN k = 3 THEN concat('urn:o#p_', p) WHEN k <= 6 THEN concat('urn:o#p_', p, '_thing') WHEN k = 9 THEN '" + XSD + "int' ELSE concat('r', p, '_value') END"
_RESTRICTIONS = " UNION ALL ".join([
    _plain("p", "p_partkey", "part"), _plain("b", "brand", f"(SELECT DISTINCT brand FROM {_P})"),
    _node("concat('urn:o#p_', p, '_thing')", "'owl:Thing'", "'Thing'", f"{_P} WHERE k IN (4, 5, 6)"), _node(_T("v", "size"), "'rdfs:Resource'", "concat('v_', size)", f"(SELECT DISTINCT size FROM {_P} WHERE k = 2)"),
    _node("concat('r', p, '_value')", "'rdfs:Literal'", "size", f"{_P} WHERE k = 10"), _node(f"'{XSD}int'", "'rdfs:Datatype'", "'int'", f"(SELECT 1 FROM {_P} WHERE k = 9 LIMIT 1)"),
    _edge(_T("p", "p"), _OWNED, "CASE WHEN k <= 1 THEN 'owl:ValuesFrom' WHEN k <= 8 THEN 'owl:ObjectProperty' ELSE 'owl:DatatypeProperty' END", "CASE WHEN k <= 8 THEN 'urn:o#made made ' ELSE 'urn:o#told told ' END", _P,
          "CASE k WHEN 0 THEN '∃' WHEN 1 THEN '∀' WHEN 2 THEN 'value' WHEN 3 THEN 'self' WHEN 6 THEN '' WHEN 9 THEN '' WHEN 10 THEN 'value' ELSE size END", "CASE WHEN k IN (5, 8) THEN '*' WHEN k IN (6, 7, 9) THEN size END"),
])

_NAMED = lambda kind, c, traits="": f"concat('urn:o#{kind}_', {c}, ' {kind}_', {c}, ' {traits}')"
_PROPERTIES = " UNION ALL ".join([
    _plain("n", "n_nationkey", "nation"), _plain("r", "r_regionkey", "region"), _node(f"'{XSD}int'", "'rdfs:Datatype'", "'int'", "(SELECT 1)"),
    _node("concat('urn:o#n_', n_nationkey, '_thing')", "'owl:Thing'", "'Thing'", "nation"), _node("concat('urn:o#said_', n_nationkey, '_literal')", "'rdfs:Literal'", "'Literal'", "nation"),
    _node("concat('urn:o#alone_', n_nationkey, '_localthing')", "'owl:Thing'", "'Thing'", "nation"), _node("concat('urn:o#alone_', n_nationkey, '_localliteral')", "'rdfs:Literal'", "'Literal'", "nation"),
    _edge(_T("n", "n_nationkey"), _T("r", "n_regionkey"), "CASE WHEN n_nationkey % 5 = 0 THEN 'owl:DeprecatedProperty' ELSE 'owl:ObjectProperty' END", _NAMED("whole", "n_nationkey", "TransitiveProperty"), "nation"),
    _edge("concat('urn:o#n_', n_nationkey, '_thing')", _T("n", "n_nationkey"), "'owl:ObjectProperty'", _NAMED("only", "n_nationkey"), "nation"),
    _edge(_T("n", "n_nationkey"), "concat('urn:o#said_', n_nationkey, '_literal')", "'owl:DatatypeProperty'", _NAMED("said", "n_nationkey"), "nation"),
    _edge(_T("n", "n_nationkey"), f"'{XSD}int'", "'owl:DatatypeProperty'", _NAMED("read", "n_nationkey"), "nation"),
    _edge("concat('urn:o#alone_', n_nationkey, '_localthing')", "concat('urn:o#alone_', n_nationkey, '_localliteral')", "'owl:DatatypeProperty'", _NAMED("alone", "n_nationkey"), "nation"),
    _edge(_T("r", "r_regionkey"), _T("n", "r_regionkey"), "'owl:InverseOf'", "concat('urn:o#f_', r_regionkey, ' f_', r_regionkey, '|g_', r_regionkey, ' FunctionalProperty')", "region WHERE r_regionkey % 2 = 0"),
    _edge(_T("n", "r_regionkey"), _T("r", "r_regionkey"), "'owl:InverseOf'", "concat('urn:o#g_', r_regionkey, ' f_', r_regionkey, '|g_', r_regionkey, ' FunctionalProperty')", "region WHERE r_regionkey % 2 = 0"),
    _edge(_T("r", "r_regionkey"), _T("n", "r_regionkey"), "'owl:ObjectProperty'", _NAMED("f", "r_regionkey", "FunctionalProperty"), "region WHERE r_regionkey % 2 = 1"),
    _edge(_T("n", "r_regionkey"), _T("n", "r_regionkey"), "'owl:ObjectProperty'", _NAMED("g", "r_regionkey"), "region WHERE r_regionkey % 2 = 1"),
    _edge(_T("r", "r_regionkey"), _T("r", "r_regionkey"), "'owl:ExternalProperty'", "concat('http://far.example/p', r_regionkey, ' p', r_regionkey, ' ')", "region"),
])

_HELD = "(SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)"
_CLASSES = " UNION ALL ".join([
    _node(_T("q", "n_nationkey"), "'owl:EquivalentClass'", "concat('like ', n_name, '|n_', n_nationkey)", f"nation LEFT JOIN {_HELD} ON k = n_nationkey", "coalesce(n, 0)"),
    _plain("e", "k", _HELD, n="n"), _node(_T("s", "s_suppkey"), "'rdfs:Resource'", "concat('s_', s_suppkey)", "supplier"), _edge(_T("e", "s_nationkey"), _T("s", "s_suppkey"), "'NoDraw'", "''", "supplier"),
    _plain("k", "r_regionkey", "region", "rdfs:Class"), _plain("old", "r_regionkey", "region", "owl:DeprecatedClass"), _plain("older", "r_regionkey", "region", "owl:DeprecatedClass"),
    _node("concat('http://far.example/c', r_regionkey)", "'owl:ExternalClass'", "concat('c', r_regionkey)", "region"),
    _edge(_T("k", "r_regionkey"), _T("q", "r_regionkey"), "'owl:disjointWith'", "''", "region"), _edge("concat('http://far.example/c', r_regionkey)", _T("old", "r_regionkey"), "'rdfs:subClassOf'", "''", "region"),
])

_METADATA = f"SELECT DISTINCT concat('urn:o#n_', doc_id % 25) AS term, '{RDFS}comment' AS prop, lang, doc_id::VARCHAR AS value FROM documents WHERE lang IS NOT NULL AND doc_id % 25 IN (SELECT n_nationkey FROM nation)"
_HEADER = """SELECT 'urn:o' AS document_base, (SELECT string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) FROM documents WHERE doc_id % 9 = 0) AS title,
  (SELECT string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) FROM documents WHERE doc_id % 10 = 0) AS creator, '3' AS version"""
_ANNOTATIONS = f"SELECT {_T('n', 'n_nationkey')} AS source, '{RDFS}subClassOf' AS property, {_T('r', 'n_regionkey')} AS target, n_name AS comment FROM nation"

def _kind(iri: str, weight: int | None, n: str, ids: str | None = None) -> str:
    return f"SELECT '{iri}' AS nodetype, {'NULL' if weight is None else weight}::INTEGER AS weight, ({n})::BIGINT AS n, ({ids or n})::BIGINT AS ids FROM c"


_KINDS = f"""WITH c AS (SELECT (SELECT count(*) FROM region) AS r, (SELECT count(*) FROM nation) AS nn, (SELECT count(*) FROM supplier) AS s, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS e,
  (SELECT count(*) FROM part) AS p, (SELECT count(DISTINCT p_brand) FROM part) AS b, (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) AS even, (SELECT list(n ORDER BY k) FROM (SELECT i AS k, count(p_partkey) AS n FROM range(11) t(i) LEFT JOIN part ON p_partkey % 11 = i GROUP BY i)) AS k,
  (SELECT count(*) FROM documents WHERE lang IS NOT NULL) AS said, (SELECT count(DISTINCT doc_id % 25) FROM documents WHERE lang IS NOT NULL) AS told, (SELECT count(*) FROM documents WHERE doc_id % 9 = 0) AS title, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS creator),
  x AS ({" UNION ALL ".join([
    _kind(OWL + "Ontology", 0, "2"), _kind(CLASS, 1, "4 * nn + 6 * r + p + b + e"), _kind("blanknode", None, "p + nn"), _kind(RDFS + "Class", None, "r"),
    _kind(OWL + "unionOf", 2, "2 * nn", "2 * r"), _kind(OWL + "disjointUnionOf", 2, "nn", "r"), _kind(OWL + "intersectionOf", 2, "2 * nn", "nn"), _kind(OWL + "complementOf", 2, "nn"),
    _kind(RDFS + "subClassOf", 2, "even + r + nn"), _kind(OWL + "equivalentClass", 2, "p - even + nn"), _kind(OWL + "disjointWith", 2, "2 * r"), _kind(OWL + "oneOf", 2, "s", "e"),
    _kind(OWL + "NamedIndividual", 2, "2 + 4 * nn + 6 * r + p + b + e + 2 + 2 * r + s", "6 + e"), _kind(OWL + "deprecated", 2, "r"), _kind(OWL + "DeprecatedClass", None, "r"),
    _kind(OWL + "ObjectProperty", None, "1"), _kind(OWL + "DatatypeProperty", None, "1"), _kind("urn:o#made", 2, "1"), _kind("urn:o#told", 2, "1"),
    _kind(OWL + "onProperty", 2, "p + nn"), _kind(OWL + "someValuesFrom", 2, "k[1]"), _kind(OWL + "allValuesFrom", 2, "k[2]"), _kind(OWL + "hasValue", 2, "k[3] + k[11]"), _kind(OWL + "hasSelf", 2, "k[4]"),
    _kind(OWL + "cardinality", 2, "k[5]"), _kind(OWL + "minCardinality", 2, "k[6]"), _kind(OWL + "maxCardinality", 2, "k[7]"), _kind(OWL + "qualifiedCardinality", 2, "k[8]"),
    _kind(OWL + "minQualifiedCardinality", 2, "k[9]"), _kind(OWL + "maxQualifiedCardinality", 2, "k[10]"), _kind(OWL + "onClass", 2, "k[8] + k[9]"), _kind(OWL + "onDataRange", 2, "k[10]"),
    _kind(RDFS + "comment", 2, "said + nn", "told + nn"), _kind(DC + "title", 2, "title", "least(title, 1)"), _kind(DCTERMS + "creator", 2, "creator", "least(creator, 1)"), _kind(OWL + "versionInfo", 2, "1"),
    _kind(OWL + "Axiom", None, "nn"), _kind(OWL + "annotatedSource", 2, "nn"), _kind(OWL + "annotatedProperty", 2, "nn"), _kind(OWL + "annotatedTarget", 2, "nn"),
  ])}) SELECT * FROM x WHERE n > 0"""

_NOTE = lambda severity, message, source: f"SELECT '{severity}' AS severity, 'Assembly' AS error_type, {message} AS message FROM {source}"
_DROPPED = lambda prop, term, source: _NOTE("Warning", f"concat('<{prop}> of <', {term}, '> is dropped: no node is drawn for it')", source)
_DIAGNOSTICS = " UNION ALL ".join([
    _NOTE("Critical", "concat('restriction lone', n_nationkey, ' has no owner or says nothing')", "nation"),
    _NOTE("Critical", "concat('Triple{ <urn:o#n_', n_nationkey, '> - rdfs:subClassOf - <urn:o#r_', n_regionkey, '> }: unresolved reference: <urn:o#r_', n_regionkey, '>')", "nation"),
    _DROPPED(RDFS + "comment", "concat('ax', n_nationkey)", "nation"), _DROPPED(DC + "title", "'urn:o'", "(SELECT 1 FROM documents WHERE doc_id % 9 = 0 LIMIT 1)"),
    _DROPPED(DCTERMS + "creator", "'urn:o'", "(SELECT 1 FROM documents WHERE doc_id % 10 = 0 LIMIT 1)"), _DROPPED(OWL + "versionInfo", "'urn:o'", "(SELECT 1)"),
    _NOTE("Warning", "'a further ontology is ignored: urn:p'", "(SELECT 1)"),
])
QUERIES = {
    "graph_kinds": (solutions_of_kinds, _KINDS),
    "graph_sets": (_draw(sets_graph), _SETS),
    "graph_restrictions": (_draw(restrictions_graph), _RESTRICTIONS),
    "graph_properties": (_draw(properties_graph), _PROPERTIES),
    "graph_classes": (_draw(classes_graph), _CLASSES),
    "graph_metadata": (metadata, _METADATA),
    "graph_header": (header, _HEADER),
    "graph_annotations": (annotations, _ANNOTATIONS),
    "graph_diagnostics": (diagnostics, _DIAGNOSTICS),
}


def queries() -> dict:
    return {n: f for n, (f, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {n: s for n, (_, s) in QUERIES.items() if s}
