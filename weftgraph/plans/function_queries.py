"""Queries that apply the scalar functions on terms to columns of the tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftgraph.functions import terms
from weftgraph.functions import vocabulary as V
from weftgraph.functions.vocabulary import OWL, XSD
from weftgraph.operators import facets, label_index
from weftgraph.session import ensure_checkpoint_dir, table


def fn_graph_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", terms.graph_name(F.concat(F.lit("a file ("), F.col("c_name"), F.lit(")[1].ttl")), F.col("c_mktsegment")).alias("g"))


def fn_synthetic(spark, sf_dir):
    made = terms.synthetic(F.concat(F.lit("urn:"), F.col("p_type")), "_thing")
    both = F.when(F.col("p_partkey") % 2 == 0, made).otherwise(F.concat(F.lit("urn:"), F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", both.alias("term"), terms.is_synthetic(both).alias("made"))


def fn_trim_circumfix(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", terms.trim_circumfix(F.concat(F.lit("<<"), F.col("n_name"), F.lit(">"))).alias("t"))


def fn_cardinality(spark, sf_dir):
    low = F.when(F.col("o_orderkey") % 3 == 0, F.lit("*")).otherwise((F.col("o_orderkey") % 7).cast("string"))
    high = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.lit("12"))
    return table(spark, sf_dir, "orders").select("o_orderkey", terms.numeric_cardinality(low, high).alias("numeric"))


#: Names of the languages that aren't reserved, beside one of no language.
COMMON = (OWL + "inverseOf", OWL + "Class", OWL + "Nothing", V.RDF + "List", V.RDF + "langString", V.RDFS + "label", V.RDFS + "Class", XSD + "anySimpleType", XSD + "QName", "urn:x")


def fn_reserved(spark, sf_dir):
    """Every reserved name, and some that aren't, dealt over the parts."""
    names = (*V.RESERVED, *COMMON)
    t = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("term"), terms.is_reserved(t).alias("reserved"), terms.reserved_type(t).alias("node"))


def fn_external(spark, sf_dir):
    kind = F.when(F.col("page_id") % 10 == 0, "B").otherwise("I")
    return table(spark, sf_dir, "pages").select("page_id", terms.is_external(kind, F.col("url"), F.lit("http://ththre.example.com/")).alias("ext"))


def fn_language_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("term"), F.lit(V.DC + "title").alias("prop"), "lang", F.col("doc_id").cast("string").alias("value"))
    return facets.metadata_in(docs, "es").select("term", F.array_join("values", ",").alias("v"))


def fn_language_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", terms.language_name(F.nullif("lang", F.lit("en"))).alias("tag"))


def fn_typed_values(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("x")).otherwise((F.col("event_id") - 50).cast("string"))
    v = lambda d: terms.typed_value(text, XSD + d)
    return table(spark, sf_dir, "events").select("event_id", v("int").alias("i"), v("nonNegativeInteger").cast("long").alias("n"), v("unsignedByte").cast("int").alias("b"), v("double").alias("d"), v("boolean").alias("t"))


def fn_term_of(spark, sf_dir):
    t = terms.term_of(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("b"), F.col("page_id").cast("string"))))
    return table(spark, sf_dir, "pages").select("page_id", t["kind"].alias("kind"))


def fn_type_groups(spark, sf_dir):
    """The filter group of an element's type: events take the types in turn, with one that no group has."""
    types = [t for g in facets.GROUPS.values() for t in g] + ["NoDraw"]
    kind = F.element_at(F.array(*[F.lit(t) for t in types]), (F.col("event_id") % len(types) + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(facets.group_of(kind).alias("filter_group")).agg(F.count("*").alias("n"))


def fn_prefix_search(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("element_type"), F.col("p_name").alias("label"))
    return facets.search(parts, "SM").select("element_type", F.size("labels").cast("long").alias("n"))


def fn_label_index(spark, sf_dir):
    """The same kind of search in an index of labels, of which only files that can hold the prefix are read."""
    ensure_checkpoint_dir(spark)
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("element_type"), F.col("p_name").alias("label"))
    index = label_index.build(parts, f"{spark.sparkContext.getCheckpointDir()}/labels-{uuid.uuid4().hex}")
    return index.find("SM")


QUERIES = {
    "fn_graph_name": (fn_graph_name, "SELECT c_custkey, concat('urn:weftgraph:user:', c_mktsegment, ':graph:a_file_', replace(translate(c_name, '()[]', ''), ' ', '_'), '1.ttl') AS g FROM customer"),
    "fn_synthetic": (fn_synthetic, "SELECT p_partkey, concat('urn:', p_type, CASE WHEN p_partkey % 2 = 0 THEN '_thing' ELSE '' END) AS term, p_partkey % 2 = 0 AS made FROM part"),
    "fn_trim_circumfix": (fn_trim_circumfix, "SELECT n_nationkey, n_name AS t FROM nation"),
    "fn_cardinality": (fn_cardinality, "SELECT o_orderkey, o_orderkey % 3 <> 0 AS numeric FROM orders"),
    "fn_reserved": (
        fn_reserved,
        f"""SELECT p_partkey, term, reserved, node FROM part JOIN (VALUES {", ".join(f"({i}, '{t}', {i < len(V.RESERVED)}, {chr(39) + 'owl:Thing' + chr(39) if t == OWL + 'Thing' else chr(39) + 'rdfs:Datatype' + chr(39) if t in V.DATATYPES else 'NULL::VARCHAR'})" for i, t in enumerate((*V.RESERVED, *COMMON)))}) t(i, term, reserved, node) ON i = p_partkey % {len(V.RESERVED) + len(COMMON)}""",
    ),
    "fn_external": (fn_external, "SELECT page_id, page_id % 10 <> 0 AND NOT starts_with(url, 'http://ththre.example.com/') AS ext FROM pages"),
    "fn_language_fallback": (
        fn_language_fallback,
        "SELECT source AS term, coalesce(string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) FILTER (WHERE lang = 'es'), string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS v FROM documents GROUP BY 1",
    ),
    "fn_language_name": (fn_language_name, "SELECT doc_id, coalesce(nullif(lang, 'en'), 'None') AS tag FROM documents"),
    "fn_typed_values": (
        fn_typed_values,
        "SELECT event_id, v::INTEGER AS i, CASE WHEN v >= 0 THEN v END AS n, CASE WHEN v BETWEEN 0 AND 255 THEN v END::INTEGER AS b, v::DOUBLE AS d, CASE WHEN v = 1 THEN true WHEN v = 0 THEN false END AS t FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id - 50 END AS v FROM events)",
    ),
    "fn_term_of": (fn_term_of, "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'I' ELSE 'B' END AS kind FROM pages"),
    "fn_type_groups": (fn_type_groups, "SELECT CASE WHEN event_id % 23 < 7 THEN 'classes' WHEN event_id % 23 < 10 THEN 'rdf' WHEN event_id % 23 < 15 THEN 'set_operators' WHEN event_id % 23 < 22 THEN 'properties' ELSE 'other' END AS filter_group, count(*) AS n FROM events GROUP BY 1"),
    "fn_label_index": (fn_label_index, "SELECT DISTINCT p_brand AS element_type, p_name AS label FROM part WHERE starts_with(lower(p_name), 'sm') AND p_brand IS NOT NULL"),
    "fn_prefix_search": (fn_prefix_search, "SELECT p_type AS element_type, count(DISTINCT p_name) AS n FROM part WHERE starts_with(lower(p_name), 'sm') GROUP BY 1"),
}


def queries() -> dict:
    return {n: f for n, (f, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {n: s for n, (_, s) in QUERIES.items()}
