"""Queries over the tables as virtual triples, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import terms
from weftgraph.functions.vocabulary import FIRST, OWL, RDFS, REST, TYPE, XSD
from weftgraph.operators import facets
from weftgraph.operators.assemble import Assembler, assemble
from weftgraph.operators.closure import least_members, representatives
from weftgraph.plans import compile as C
from weftgraph.plans.sparql import parse
from weftgraph.session import cut, table
from weftgraph.sources.mapping import PREFIXES, TableGraph
from weftgraph.sources.store import Store


def sparql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A SELECT over the tables' virtual triples."""
    return C.solutions(C.select(parse(text, PREFIXES), TableGraph(spark, sf_dir)))


#: Query, and the same in SQL.
SPARQL = {
    "scan_type": ("SELECT ?id { ?id a t:nation }", "SELECT concat('urn:t:nation:',n_nationkey) AS id FROM nation"),
    "scan_predicate": ("SELECT ?id ?target { ?id customer:c_name ?target }", "SELECT concat('urn:t:customer:',c_custkey) AS id, c_name AS target FROM customer"),
    "scan_var_predicate": (
        "SELECT ?id ?p ?target { ?id ?p ?target FILTER(?p IN (region:r_name, nation:n_name)) }",
        "SELECT concat('urn:t:region:',r_regionkey) AS id, 'urn:t:region#r_name' AS p, r_name AS target FROM region UNION ALL SELECT concat('urn:t:nation:',n_nationkey), 'urn:t:nation#n_name', n_name FROM nation",
    ),
    "bgp_star": (
        "SELECT ?c_custkey ?c_name ?c_mktsegment { ?c customer:c_custkey ?c_custkey ; customer:c_name ?c_name ; customer:c_mktsegment ?c_mktsegment FILTER(?c_mktsegment = 'BUILDING') }",
        "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment='BUILDING'",
    ),
    "bgp_chain3": (
        "SELECT ?c_custkey ?n_name ?r_name { ?c customer:c_custkey ?c_custkey ; customer:c_nationkey ?n . ?n nation:n_name ?n_name ; nation:n_regionkey ?r . ?r region:r_name ?r_name }",
        "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey",
    ),
    "bgp_any_order": (
        "SELECT ?rn ?cn { ?r region:r_name ?rn . ?c customer:c_name ?cn ; customer:c_nationkey ?n . ?n nation:n_regionkey ?r }",
        "SELECT r_name AS rn, c_name AS cn FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey",
    ),
    "compatible_mappings": (
        "SELECT ?c ?s ?n { { ?x customer:c_custkey ?c ; customer:c_acctbal ?b OPTIONAL { ?x customer:c_nationkey ?n FILTER(?b < 9900) } } { ?y supplier:s_suppkey ?s ; supplier:s_acctbal ?d ; supplier:s_nationkey ?m OPTIONAL { ?m nation:n_name ?name BIND(?m AS ?n) FILTER(?d < 9000) } } }",
        """WITH l AS (SELECT c_custkey AS c, CASE WHEN c_acctbal < 9900 THEN concat('urn:t:nation:',c_nationkey) END AS n FROM customer), r AS (SELECT s_suppkey AS s, CASE WHEN s_acctbal < 9000 THEN concat('urn:t:nation:',s_nationkey) END AS n FROM supplier)
          SELECT c, s, l.n FROM l JOIN r ON l.n=r.n UNION ALL SELECT c, s, l.n FROM l JOIN r ON l.n IS NOT NULL AND r.n IS NULL UNION ALL SELECT c, s, r.n FROM l JOIN r ON l.n IS NULL""",
    ),
    "filter_typed_boolean": (
        "SELECT ?doc_id { ?l labels:doc_id ?d ; labels:toxic ?t . ?d documents:doc_id ?doc_id BIND(?t = 1 AS ?flag) FILTER(?flag = true) }",
        "SELECT doc_id FROM documents JOIN labels USING(doc_id) WHERE toxic=1",
    ),
    "bgp_chain_fact": (
        "SELECT ?o_orderkey ?l_linenumber ?c_name { ?l lineitem:l_orderkey ?o ; lineitem:l_linenumber ?l_linenumber ; lineitem:l_quantity ?q FILTER(?q > 49) ?o orders:o_orderkey ?o_orderkey ; orders:o_custkey ?c . ?c customer:c_name ?c_name }",
        "SELECT o_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey WHERE l_quantity>49",
    ),
    "filter_is_iri": (
        "SELECT ?id ?target { { ?id nation:n_regionkey ?target } UNION { ?id nation:n_name ?target } FILTER(isIRI(?target)) }",
        "SELECT concat('urn:t:nation:',n_nationkey) AS id, concat('urn:t:region:',n_regionkey) AS target FROM nation",
    ),
    "filter_is_blank": ("SELECT ?n { { ?l lineitem:l_linenumber ?n } UNION { ?l nation:n_nationkey ?n } FILTER(isBlank(?l)) }", "SELECT l_linenumber AS n FROM lineitem"),
    "bind_variable": ("SELECT ?a ?b { ?x nation:n_name ?a ; nation:n_regionkey ?r BIND(?r AS ?b) }", "SELECT n_name AS a, concat('urn:t:region:', n_regionkey) AS b FROM nation"),
    "filter_in": ("SELECT ?o_orderkey { ?o orders:o_orderkey ?o_orderkey ; orders:o_orderstatus ?s FILTER(?s IN ('F','P')) }", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F','P')"),
    "filter_not_in": ("SELECT ?event_id { ?e events:event_id ?event_id ; events:event_type ?t FILTER(?t NOT IN ('error','view')) }", "SELECT event_id FROM events WHERE event_type NOT IN ('error','view')"),
    "filter_not_equal_term": (
        "SELECT ?n_nationkey { ?n nation:n_nationkey ?n_nationkey ; nation:n_regionkey ?r FILTER(?r != <urn:t:region:1>) }",
        "SELECT n_nationkey FROM nation WHERE n_regionkey <> 1",
    ),
    "filter_typed_eq_or_lcase": (
        "SELECT ?c_custkey { ?c customer:c_custkey ?c_custkey ; customer:c_mktsegment ?m ; customer:c_nationkey ?n FILTER(lcase(str(?m)) = 'machinery' || ?n = <urn:t:nation:1>) }",
        "SELECT c_custkey FROM customer WHERE lower(c_mktsegment)='machinery' OR c_nationkey=1",
    ),
    "filter_false": ("SELECT ?n_nationkey { ?n nation:n_nationkey ?n_nationkey FILTER(false) }", "SELECT n_nationkey FROM nation WHERE false"),
    "bind_const": ("SELECT ?id ?k { ?r region:r_name ?id BIND('region' AS ?k) }", "SELECT r_name AS id, 'region' AS k FROM region"),
    "bind_if": (
        "SELECT ?doc_id ?k { ?d documents:doc_id ?doc_id OPTIONAL { ?l labels:doc_id ?d ; labels:toxic ?t } BIND(IF(?t = 1, 'toxic', 'clean') AS ?k) }",
        "SELECT d.doc_id, CASE WHEN l.toxic=1 THEN 'toxic' WHEN l.toxic<>1 THEN 'clean' END AS k FROM documents d LEFT JOIN labels l USING(doc_id)",
    ),
    "bind_coalesce": (
        "SELECT ?doc_id ?q { ?d documents:doc_id ?doc_id OPTIONAL { ?l labels:doc_id ?d ; labels:quality ?v } BIND(COALESCE(?v, 1/0, -1) AS ?q) }",
        "SELECT d.doc_id, coalesce(l.quality,-1)::DOUBLE AS q FROM documents d LEFT JOIN labels l USING(doc_id)",
    ),
    "bind_bound": (
        "SELECT ?doc_id ?b { ?d documents:doc_id ?doc_id OPTIONAL { ?l labels:doc_id ?d ; labels:quality ?v } BIND(BOUND(?v) AS ?b) }",
        "SELECT d.doc_id, (l.doc_id IS NOT NULL) AS b FROM documents d LEFT JOIN labels l USING(doc_id)",
    ),
    "optional_left": (
        "SELECT ?o_orderkey ?l_linenumber { ?o orders:o_orderkey ?o_orderkey OPTIONAL { ?l lineitem:l_orderkey ?o ; lineitem:l_linenumber ?l_linenumber ; lineitem:l_quantity ?q FILTER(?q > 45) } }",
        "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey AND l_quantity>45",
    ),
    "optional_chain3": (
        "SELECT ?doc_id ?label { ?d documents:doc_id ?doc_id ; documents:lang ?g OPTIONAL { ?b benchmark:item_id ?doc_id ; benchmark:text ?x } OPTIONAL { ?c conversations:conv_id ?doc_id ; conversations:turn ?t ; conversations:text ?y FILTER(?t = 0) } BIND(COALESCE(?x, ?y, ?g, '') AS ?label) }",
        "SELECT d.doc_id, coalesce(b.text, c.text, d.lang, '') AS label FROM documents d LEFT JOIN benchmark b ON b.item_id=d.doc_id LEFT JOIN conversations c ON c.conv_id=d.doc_id AND c.turn=0",
    ),
    "not_exists": (
        "SELECT ?o_orderkey { ?o orders:o_orderkey ?o_orderkey FILTER NOT EXISTS { ?l lineitem:l_orderkey ?o } }",
        "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey)",
    ),
    "not_exists_filtered": (
        "SELECT ?o_orderkey { ?o orders:o_orderkey ?o_orderkey ; orders:o_orderstatus ?s FILTER NOT EXISTS { ?l lineitem:l_orderkey ?o ; lineitem:l_returnflag ?f FILTER(?f = 'R') FILTER(?s = 'F') } }",
        "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='R' AND o_orderstatus='F')",
    ),
    "not_exists_union": (
        "SELECT ?c_custkey { ?c customer:c_custkey ?c_custkey FILTER NOT EXISTS { { ?o orders:o_custkey ?c ; orders:o_orderstatus 'P' } UNION { ?e events:user_id ?c ; events:event_type 'error' } } }",
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P') AND NOT EXISTS (SELECT 1 FROM events WHERE user_id=c_custkey AND event_type='error')",
    ),
    "exists": (
        "SELECT ?c_custkey { ?c customer:c_custkey ?c_custkey FILTER EXISTS { ?o orders:o_custkey ?c ; orders:o_orderstatus 'P' } }",
        "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P')",
    ),
    "minus": (
        "SELECT ?doc_id { ?d documents:doc_id ?doc_id MINUS { ?l labels:doc_id ?d } }",
        "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "values_join": (
        "SELECT ?p_partkey ?t { VALUES ?t { 'PROMO' 'SMALL' 'PROMO' } ?p part:p_partkey ?p_partkey ; part:p_type ?t }",
        "SELECT p_partkey, v.t FROM part JOIN (VALUES ('PROMO'),('SMALL'),('PROMO')) v(t) ON p_type=v.t",
    ),
    "domain_range_4way": (
        """SELECT ?doc_id ?shape { ?d documents:doc_id ?doc_id
          { ?l labels:doc_id ?d . ?b benchmark:item_id ?doc_id BIND('both' AS ?shape) }
          UNION { ?d documents:lang ?g . ?l labels:doc_id ?d FILTER NOT EXISTS { ?d documents:doc_id ?i . ?b benchmark:item_id ?i } BIND('range' AS ?shape) }
          UNION { ?d documents:doc_id ?i . ?b benchmark:item_id ?i FILTER NOT EXISTS { ?l labels:doc_id ?d } BIND('domain' AS ?shape) }
          UNION { ?d documents:doc_id ?i FILTER NOT EXISTS { ?l labels:doc_id ?d } FILTER NOT EXISTS { ?b benchmark:item_id ?i } BIND('none' AS ?shape) } }""",
        "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND b.item_id IS NOT NULL THEN 'both' WHEN l.doc_id IS NOT NULL THEN 'range' WHEN b.item_id IS NOT NULL THEN 'domain' ELSE 'none' END AS shape FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id LEFT JOIN benchmark b ON b.item_id=d.doc_id",
    ),
    "union_bag": (
        "SELECT ?k ?n { { ?c customer:c_nationkey ?k ; customer:c_name ?n } UNION { ?s supplier:s_nationkey ?k } }",
        "SELECT concat('urn:t:nation:',c_nationkey) AS k, c_name AS n FROM customer UNION ALL SELECT concat('urn:t:nation:',s_nationkey), NULL FROM supplier",
    ),
    "select_distinct": ("SELECT DISTINCT ?f ?s { ?l lineitem:l_returnflag ?f ; lineitem:l_linestatus ?s }", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem"),
    "order_nulls_first": (
        "SELECT ?doc_id ?quality { ?d documents:doc_id ?doc_id OPTIONAL { ?l labels:doc_id ?d ; labels:quality ?quality } } ORDER BY ?quality ?doc_id LIMIT 100",
        "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING(doc_id) ORDER BY l.quality NULLS FIRST, d.doc_id LIMIT 100",
    ),
    "order_offset": ("SELECT ?n_name { ?n nation:n_name ?n_name } ORDER BY DESC(?n_name) OFFSET 5 LIMIT 7", "SELECT n_name FROM nation ORDER BY n_name DESC LIMIT 7 OFFSET 5"),
    "count_by_type": ("SELECT ?event_type (COUNT(*) AS ?n) { ?e events:event_type ?event_type } GROUP BY ?event_type", "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "count_individuals": (
        "SELECT ?event_type (COUNT(DISTINCT ?u) AS ?n) { ?e events:event_type ?event_type ; events:user_id ?u } GROUP BY ?event_type",
        "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1",
    ),
    "collect_set_sorted": (
        "SELECT ?c (GROUP_CONCAT(DISTINCT ?x; SEPARATOR=',') AS ?s) { ?o orders:o_custkey ?c ; orders:o_orderstatus ?x } GROUP BY ?c",
        "SELECT concat('urn:t:customer:',o_custkey) AS c, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS s FROM orders GROUP BY 1",
    ),
    "having_avg": (
        "SELECT ?m (MAX(?k) AS ?top) (MIN(?k) AS ?least) (COUNT(?k) AS ?n) { ?c customer:c_mktsegment ?m ; customer:c_custkey ?k } GROUP BY ?m HAVING (COUNT(?k) > 10)",
        "SELECT c_mktsegment AS m, max(c_custkey) AS top, min(c_custkey) AS least, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 10",
    ),
    "metadata_by_lang": ("SELECT ?lang (COUNT(DISTINCT ?s) AS ?n) { ?d documents:lang ?lang ; documents:source ?s } GROUP BY ?lang", "SELECT lang, count(DISTINCT source) AS n FROM documents GROUP BY 1"),
    "graph_header_scope": (
        "SELECT ?doc_id { { SELECT (MIN(?x) AS ?s) { ?a documents:source ?x } } ?d documents:source ?s ; documents:doc_id ?doc_id }",
        "SELECT doc_id FROM documents WHERE source=(SELECT min(source) FROM documents)",
    ),
    "string_functions": (
        "SELECT ?id ?u ?n ?s ?r { ?x nation:n_nationkey ?id ; nation:n_name ?v BIND(lcase(?v) AS ?u) BIND(strlen(?v) AS ?n) BIND(substr(?v, 2, 3) AS ?s) BIND(replace(?v, '[AEIOU]', '_') AS ?r) FILTER(regex(?v, '[0-3]$') || contains(?v, '7') || strends(?v, '9')) }",
        "SELECT n_nationkey AS id, lower(n_name) AS u, length(n_name)::INTEGER AS n, substr(n_name,2,3) AS s, regexp_replace(n_name,'[AEIOU]','_','g') AS r FROM nation WHERE regexp_matches(n_name,'[0-3]$') OR contains(n_name,'7') OR suffix(n_name,'9')",
    ),
    "date_functions": (
        "SELECT ?y ?m (COUNT(*) AS ?n) { ?o orders:o_orderdate ?d BIND(year(?d) AS ?y) BIND(month(?d) AS ?m) } GROUP BY ?y ?m",
        "SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, count(*) AS n FROM orders GROUP BY 1,2",
    ),
    "path_sequence_inverse": (
        "SELECT ?r_name ?c_custkey { ?r region:r_name ?r_name ; ^nation:n_regionkey/^customer:c_nationkey ?c . ?c customer:c_custkey ?c_custkey }",
        "SELECT r_name, c_custkey FROM region JOIN nation ON n_regionkey=r_regionkey JOIN customer ON c_nationkey=n_nationkey",
    ),
    "path_plus_hierarchy": (
        "SELECT ?a ?b { ?a a t:customer ; (customer:c_nationkey|nation:n_regionkey)+ ?b }",
        "SELECT concat('urn:t:customer:',c_custkey) AS a, concat('urn:t:nation:',c_nationkey) AS b FROM customer UNION SELECT concat('urn:t:customer:',c_custkey), concat('urn:t:region:',n_regionkey) FROM customer JOIN nation ON c_nationkey=n_nationkey",
    ),
    "path_optional": (
        "SELECT ?n ?x { ?n a t:nation . ?n nation:n_regionkey? ?x }",
        "SELECT concat('urn:t:nation:',n_nationkey) AS n, concat('urn:t:nation:',n_nationkey) AS x FROM nation UNION ALL SELECT concat('urn:t:nation:',n_nationkey), concat('urn:t:region:',n_regionkey) FROM nation",
    ),
}


# ---- operators of the engine on the tables
def _quads(df: DataFrame, s, p: str, o, s_kind: str = "I", o_kind: str = "I", dt: str | None = None, lang=None) -> DataFrame:
    """Rows of a table as quads of one predicate."""
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return df.select(F.lit("urn:g").alias("g"), F.lit(s_kind).alias("s_kind"), text(s).alias("s"), F.lit(p).alias("p"), F.lit(o_kind).alias("o_kind"), text(o).alias("o"), text(dt).alias("o_dt"), text(lang).alias("o_lang"))


def _iri(kind: str, column: str):
    return F.concat(F.lit(f"urn:o#{kind}_"), F.col(column).cast("string"))


def _together(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_set_semantics(spark, sf_dir):
    """A store's graph is a set: what comes in again, in one batch or a later one, stays once."""
    lines = table(spark, sf_dir, "lineitem")
    quads = _quads(lines, F.col("l_orderkey").cast("string"), "urn:line", F.col("l_linenumber").cast("string"), o_kind="L", dt=XSD + "int")
    store = Store(spark)
    store.add(quads)
    store.add(quads.where("o <> '1'"))
    return store.quads.select(F.col("s").cast("long").alias("l_orderkey"), F.col("o").cast("int").alias("l_linenumber"))


def path_star_list(spark, sf_dir):
    """Lists are flattened along the path rdf:rest*/rdf:first: a conversation's turns are its cells, those that follow on."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    cell = lambda t: F.concat_ws("_", F.lit("urn:c"), F.col("conv_id"), t)
    heads = turns.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    quads = _together(
        _quads(heads, F.concat(F.lit("urn:conv:"), F.col("conv_id")), "urn:list", cell(F.col("turn"))),
        _quads(turns, cell(F.col("turn")), FIRST, F.col("turn").cast("string"), o_kind="L", dt=XSD + "long"),
        _quads(turns, cell(F.col("turn")), REST, cell(F.col("turn") + 1)),
    )
    found = C.solutions(C.select(parse("SELECT ?conv ?turn { ?conv <urn:list>/rdf:rest*/rdf:first ?turn }"), C.QuadGraph(cut(quads))))
    return found.select(F.regexp_replace("conv", "^urn:conv:", "").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"))


def redirect_closure(spark, sf_dir):
    """Representatives of a forest of pointers: every order's key points at its half."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"))
    pointers = keys.where("a > 0").select("a", F.expr("a div 2").alias("b"))
    return representatives(pointers)


def equivalence_components(spark, sf_dir):
    """Components of an undirected graph: suppliers that are linked by nation, named by the least."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    hub = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("b"))
    pairs = s.join(hub, "s_nationkey").select(F.col("s_suppkey").alias("a"), "b")
    roots = least_members(pairs)
    return s.join(roots, s["s_suppkey"] == roots["node"], "left").select("s_suppkey", F.coalesce("root", "s_suppkey").alias("root"))


def label_choice(spark, sf_dir):
    """Of a term's labels the assembler takes the least, with its language."""
    events = table(spark, sf_dir, "events").withColumn("lang", F.when(F.col("event_id") % 3 == 0, "en").otherwise("de"))
    found = Assembler(_quads(events, F.concat(F.lit("urn:o#u"), F.col("user_id")), RDFS + "label", F.col("event_type"), o_kind="L", dt=XSD + "string", lang=F.col("lang")))
    found.labels()
    return found.explicit.select("term", "label", "lang")


def type_priority(spark, sf_dir):
    """Of a term's types the assembler takes the most telling: customers typed by the status of their orders."""
    orders = table(spark, sf_dir, "orders")
    typ = F.when(F.col("o_orderstatus") == "P", OWL + "DeprecatedClass").when(F.col("o_orderstatus") == "F", RDFS + "Class").otherwise(OWL + "Class")
    found = Assembler(_quads(orders, _iri("c", "o_custkey"), TYPE, typ))
    found.same_properties()
    found.types()
    return found.nodes.select("term", "element_type")


def restriction_pivot(spark, sf_dir):
    """The statements of a restriction become one row, owned by the class above it: a part's size is how often it has what it is made from."""
    part = table(spark, sf_dir, "part")
    r = F.concat(F.lit("r"), F.col("p_partkey").cast("string"))
    brand = F.concat(F.lit("urn:o#b_"), F.regexp_replace("p_brand", "#", "_"))
    card = F.when(F.col("p_size") % 3 == 0, OWL + "minQualifiedCardinality").when(F.col("p_size") % 3 == 1, OWL + "maxQualifiedCardinality").otherwise(OWL + "qualifiedCardinality")
    count = _quads(part, r, "", F.col("p_size").cast("string"), "B", "L", XSD + "nonNegativeInteger").drop("p")
    count = part.select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("s"), card.alias("p")).join(count, "s").select("g", "s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang")
    one = spark.range(1)
    quads = _together(
        _quads(one, "urn:o", TYPE, OWL + "Ontology"), _quads(one, "urn:o#made", TYPE, OWL + "ObjectProperty"), _quads(part, _iri("p", "p_partkey"), TYPE, OWL + "Class"),
        _quads(part.select("p_brand").distinct(), brand, TYPE, OWL + "Class"), _quads(part, _iri("p", "p_partkey"), RDFS + "subClassOf", r, o_kind="B"), _quads(part, r, TYPE, OWL + "Restriction", "B"),
        _quads(part, r, OWL + "onProperty", "urn:o#made", "B"), _quads(part, r, OWL + "onClass", brand, "B"), count,
    )
    return assemble(quads).edges.select("domain", "range", "edge_type", "property", "card_min", "card_max")


def visible_counts(spark, sf_dir):
    """How many elements of each group are shown: an event is an element of one of some types."""
    types = F.array(*[F.lit(t) for t in ("owl:Class", "rdfs:Literal", "owl:UnionOf", "rdfs:subClassOf", "urn:else")])
    events = table(spark, sf_dir, "events").groupBy(F.element_at(types, (F.col("user_id") % 5 + 1).cast("int")).alias("element_type")).agg(F.count("*").alias("n"))
    return facets.visible(events, {"rdfs:Literal": False, "urn:else": False})


def disjoint_suppliers(spark, sf_dir) -> DataFrame:
    """(l_suppkey, other), both ways: suppliers of one order. Lines are dealt by order once, which serves the distinct rows and both
    sides of the join; each pair is found one way and then stated both ways."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct()
    pairs = items.join(items.withColumnRenamed("l_suppkey", "other"), "l_orderkey").where("l_suppkey < other").select("l_suppkey", "other").distinct()
    both = F.array(F.struct("l_suppkey", "other"), F.struct(F.col("other").alias("l_suppkey"), F.col("l_suppkey").alias("other")))
    return pairs.select(F.explode(both).alias("x")).select("x.*")


def symmetric_edge_dedup(spark, sf_dir):
    """Disjointness stated both ways is one edge: suppliers of one order are disjoint."""
    pairs = disjoint_suppliers(spark, sf_dir)
    suppliers = table(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    quads = _together(_quads(suppliers, _iri("s", "l_suppkey"), TYPE, OWL + "Class"), _quads(pairs, _iri("s", "l_suppkey"), OWL + "disjointWith", _iri("s", "other")))
    edges = assemble(quads).edges.where("edge_type = 'owl:disjointWith'")
    key = lambda c: F.regexp_replace(c, "^urn:o#s_", "").cast("long")
    return edges.select(F.least(key("domain"), key("range")).alias("x"), F.greatest(key("domain"), key("range")).alias("y"))


def equivalence_merge(spark, sf_dir):
    """Equivalent classes become one, and edges move to it: each odd nation is equivalent to the one before it."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    customer = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    odd = nation.where("n_nationkey % 2 = 1").withColumn("even", F.col("n_nationkey") - 1)
    quads = _together(
        _quads(nation, _iri("n", "n_nationkey"), TYPE, OWL + "Class"), _quads(customer.select("c_mktsegment").distinct(), _iri("m", "c_mktsegment"), TYPE, OWL + "Class"),
        _quads(odd, _iri("n", "even"), OWL + "equivalentClass", _iri("n", "n_nationkey")), _quads(customer, _iri("n", "c_nationkey"), RDFS + "subClassOf", _iri("m", "c_mktsegment")),
    )
    return assemble(quads).edges.where("edge_type = 'rdfs:subClassOf'").select("domain", "range")


def label_fallback(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", terms.iri_label(F.regexp_replace("url", r"\?[^#]*", "")).alias("label"))


OPERATORS = {
    "graph_set_semantics": (graph_set_semantics, "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem"),
    "path_star_list": (
        path_star_list,
        "WITH RECURSIVE p(conv_id,turn) AS (SELECT conv_id, min(turn) FROM conversations GROUP BY 1 UNION SELECT c.conv_id,c.turn FROM p JOIN conversations c ON c.conv_id=p.conv_id AND c.turn=p.turn+1) SELECT conv_id, turn FROM p",
    ),
    "redirect_closure": (
        redirect_closure,
        "WITH RECURSIVE m(a,b) AS (SELECT o_orderkey, o_orderkey//2 FROM orders WHERE o_orderkey > 0), p(a,b,d) AS (SELECT a,b,1 FROM m UNION ALL SELECT p.a,m.b,d+1 FROM p JOIN m ON p.b=m.a) SELECT a, arg_max(b,d) AS root FROM p GROUP BY a",
    ),
    "label_choice": (
        label_choice,
        "SELECT concat('urn:o#u', user_id) AS term, min(event_type) AS label, min(CASE WHEN event_id % 3 = 0 THEN 'en' ELSE 'de' END) FILTER (WHERE event_type = least_type) AS lang FROM (SELECT *, min(event_type) OVER (PARTITION BY user_id) AS least_type FROM events) GROUP BY user_id",
    ),
    "type_priority": (
        type_priority,
        "SELECT concat('urn:o#c_', o_custkey) AS term, CASE WHEN max(o_orderstatus NOT IN ('P','F')) THEN 'owl:Class' WHEN max(o_orderstatus='F') THEN 'rdfs:Class' ELSE 'owl:DeprecatedClass' END AS element_type FROM orders GROUP BY o_custkey",
    ),
    "restriction_pivot": (
        restriction_pivot,
        "SELECT concat('urn:o#p_', p_partkey) AS domain, concat('urn:o#b_', replace(p_brand, '#', '_')) AS range, 'owl:ObjectProperty' AS edge_type, 'urn:o#made' AS property, CASE p_size % 3 WHEN 1 THEN '' ELSE p_size::VARCHAR END AS card_min, CASE p_size % 3 WHEN 0 THEN '*' ELSE p_size::VARCHAR END AS card_max FROM part",
    ),
    "visible_counts": (
        visible_counts,
        "SELECT g AS filter_group, sum(CASE WHEN s THEN n ELSE 0 END)::BIGINT AS shown, sum(n)::BIGINT AS total FROM (SELECT user_id % 5 AS k, count(*) AS n FROM events GROUP BY 1) JOIN (VALUES (0,'classes',true),(1,'rdf',false),(2,'set_operators',true),(3,'properties',true),(4,'other',false)) t(i,g,s) ON i=k GROUP BY g",
    ),
    "symmetric_edge_dedup": (
        symmetric_edge_dedup,
        "SELECT DISTINCT least(a.l_suppkey,b.l_suppkey) AS x, greatest(a.l_suppkey,b.l_suppkey) AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND a.l_suppkey<>b.l_suppkey",
    ),
    "equivalence_merge": (equivalence_merge, "SELECT DISTINCT concat('urn:o#n_', (c_nationkey//2)*2) AS domain, concat('urn:o#m_', c_mktsegment) AS range FROM customer"),
    "equivalence_components": (equivalence_components, "SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS root FROM supplier"),
    "label_fallback": (
        label_fallback,
        r"SELECT page_id, coalesce(nullif(regexp_extract(url,'#(.*)$',1),''), nullif(regexp_extract(regexp_replace(url,'[?#].*$',''),'/([^/]*)$',1),'')) AS label FROM pages",
    ),
}


def queries() -> dict:
    asked = {n: (lambda spark, sf_dir, q=q: sparql(spark, sf_dir, q)) for n, (q, _) in SPARQL.items()}
    return asked | {n: f for n, (f, _) in OPERATORS.items()}


def oracle_sql() -> dict:
    return {n: s for n, (_, s) in (SPARQL | OPERATORS).items()}
