"""Queries over quads: an ontology made from the part catalogue, its rows, display graph, facets and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.vocabulary import OWL, RDFS, TYPE
from weftgraph.operators import assemble as A
from weftgraph.operators import facets
from weftgraph.plans import snippets
from weftgraph.session import cut, ensure_checkpoint_dir, table
from weftgraph.sources.pieces import read_turtle_pieces, write_turtle_pieces
from weftgraph.sources.store import parse_lines, read_lines, rejected_lines, write_lines
from weftgraph.sources.turtle import STRING

BASE = "urn:o:catalogue"
G = "urn:weftgraph:graph:catalogue"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads: types of parts are classes, brands are classes below their types, parts are individuals of their brand."""
    part = table(spark, sf_dir, "part")
    typ = F.concat(F.lit(f"{BASE}#type_"), F.col("p_type"))
    brand = F.concat(F.lit(f"{BASE}#"), F.regexp_replace("p_brand", "#", "_"))
    one = F.concat(F.lit(f"{BASE}#part_"), F.col("p_partkey").cast("string"))

    def rows(df, s, p, o, literal=False):
        kind = F.lit("L" if literal else "I")
        return df.select(F.lit(G).alias("g"), F.lit("I").alias("s_kind"), s.alias("s"), F.lit(p).alias("p"), kind.alias("o_kind"), o.alias("o"), F.lit(STRING if literal else None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))

    types, brands, both = part.select("p_type").distinct(), part.select("p_brand").distinct(), part.select("p_type", "p_brand").distinct()
    made_by, size = F.lit(f"{BASE}#madeAs"), F.lit(f"{BASE}#size")
    fixed = spark.range(1)
    parts = [
        rows(fixed, F.lit(BASE), TYPE, F.lit(OWL + "Ontology")),
        rows(fixed, F.lit(BASE), OWL + "versionInfo", F.lit("1"), True),
        rows(types, typ, TYPE, F.lit(OWL + "Class")),
        rows(types, typ, RDFS + "label", F.concat(F.lit("Type "), F.col("p_type")), True),
        rows(brands, brand, TYPE, F.lit(OWL + "Class")),
        rows(both, brand, RDFS + "subClassOf", typ),
        rows(part, one, TYPE, brand),
        rows(fixed, made_by, TYPE, F.lit(OWL + "ObjectProperty")),
        rows(fixed, made_by, TYPE, F.lit(OWL + "FunctionalProperty")),
        rows(types, made_by, RDFS + "domain", typ),
        rows(fixed, size, TYPE, F.lit(OWL + "DatatypeProperty")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_nodes(spark, sf_dir):
    return A.assemble(catalogue(spark, sf_dir)).nodes.select("term", "element_type", "label", "individuals")


def graph_edges(spark, sf_dir):
    edges = A.assemble(catalogue(spark, sf_dir)).edges
    return edges.select("domain", "range", "edge_type", "property", "label", F.array_join("characteristics", ",").alias("traits"))


def graph_facets(spark, sf_dir):
    shown = A.assemble(catalogue(spark, sf_dir))
    return facets.counts(shown.nodes, shown.edges)


def graph_totals(spark, sf_dir):
    """The display graph stored, and its totals, counted on the way."""
    ensure_checkpoint_dir(spark)
    shown = A.assemble(catalogue(spark, sf_dir))
    totals = facets.write(shown.nodes, shown.edges, f"{spark.sparkContext.getCheckpointDir()}/display-{uuid.uuid4().hex}")
    return spark.createDataFrame([tuple(totals.values())], ", ".join(f"{n} long" for n in totals))


def graph_visible(spark, sf_dir):
    shown = A.assemble(catalogue(spark, sf_dir))
    return facets.visible(facets.counts(shown.nodes, shown.edges), {"rdfs:subClassOf": False})


def graph_solutions(spark, sf_dir):
    rows = snippets.solutions(cut(catalogue(spark, sf_dir)))
    return rows.groupBy("nodetype", "weight").agg(F.count("*").alias("n"))


def graph_search(spark, sf_dir):
    return facets.search(A.assemble(catalogue(spark, sf_dir)).nodes, "type").select("element_type", F.array_join("labels", ",").alias("labels"))


def graph_lines_round_trip(spark, sf_dir):
    """The catalogue written as N-Quads by all tasks, and read again."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/nquads-{uuid.uuid4().hex}"
    write_lines(catalogue(spark, sf_dir), path)
    return read_lines(spark, path, G).groupBy("p", "o_kind").agg(F.count("*").alias("n"))


def graph_turtle_round_trip(spark, sf_dir):
    """The catalogue written as Turtle by all tasks, and read again in pieces."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/turtle-{uuid.uuid4().hex}"
    write_turtle_pieces(catalogue(spark, sf_dir), path)
    return read_turtle_pieces(spark, path, G)[0].groupBy("p", "o_kind").agg(F.count("*").alias("n"))


def graph_clause(spark, sf_dir):
    """Customers of a nation in a graph of its own: each graph with its name, and one by its name."""
    customer = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    quads = customer.select(
        F.concat(F.lit("urn:n:"), F.col("c_nationkey").cast("string")).alias("g"), F.lit("I").alias("s_kind"), F.concat(F.lit("urn:c:"), F.col("c_custkey").cast("string")).alias("s"),
        F.lit("urn:segment").alias("p"), F.lit("L").alias("o_kind"), F.col("c_mktsegment").alias("o"), F.lit(STRING).alias("o_dt"), none.alias("o_lang"),
    )
    return snippets.run_text(quads, "SELECT ?g ?c ?s { { GRAPH ?g { ?c <urn:segment> ?s } } UNION { GRAPH <urn:n:3> { ?c <urn:segment> ?s } } }")


#: A statement with escapes of every kind, around a key and a name.
ESCAPED = (r"<urn:né:", r'> <urn:p> "café ', r"\t\"\U0001F600\\n\n\b\f\n\r\'" + '"@EN _:own .')


def lines_escapes(spark, sf_dir):
    """N-Quads written with escapes of every kind, read line by line; and how many lines are no statement."""
    nation = table(spark, sf_dir, "nation")
    lines = nation.select(F.concat(F.lit(ESCAPED[0]), F.col("n_nationkey").cast("string"), F.lit(ESCAPED[1]), "n_name", F.lit(ESCAPED[2])).alias("value"))
    both = lines.unionByName(nation.select(F.concat(F.lit('<urn:a> <urn:p> "'), "n_name", F.lit(r'\x" .')).alias("value")))
    rejected = rejected_lines(both).agg(F.count("*").alias("rejected"))
    return parse_lines(both, G).crossJoin(rejected).select(F.regexp_replace("g", "^.*#", "#").alias("g"), "s", F.hex("o").alias("bytes"), "o_lang", "rejected")  # one row of a count


def graph_json(spark, sf_dir):
    return A.to_json(A.assemble(catalogue(spark, sf_dir)))


_T, _B = f"concat('{BASE}#type_', p_type)", f"concat('{BASE}#', replace(p_brand, '#', '_'))"
_EDGES = f"""SELECT DISTINCT {_B} AS domain, {_T} AS range, 'rdfs:subClassOf' AS edge_type, NULL::VARCHAR AS property, NULL::VARCHAR AS label, '' AS traits FROM part
  UNION ALL SELECT DISTINCT {_T}, concat({_T}, '_thing'), 'owl:ObjectProperty', '{BASE}#madeAs', 'madeAs', 'FunctionalProperty' FROM part
  UNION ALL SELECT '{BASE}#size_localthing', '{BASE}#size_localliteral', 'owl:DatatypeProperty', '{BASE}#size', 'size', ''"""
_NODES = f"""SELECT DISTINCT {_T} AS term, 'owl:Class' AS element_type, concat('Type ', p_type) AS label, 0::BIGINT AS individuals FROM part
  UNION ALL SELECT {_B}, 'owl:Class', replace(p_brand, '#', '_'), count(*) FROM part GROUP BY p_brand
  UNION ALL SELECT DISTINCT concat({_T}, '_thing'), 'owl:Thing', 'Thing', 0 FROM part
  UNION ALL SELECT '{BASE}#size_localthing', 'owl:Thing', 'Thing', 0 UNION ALL SELECT '{BASE}#size_localliteral', 'rdfs:Literal', 'Literal', 0"""
_COUNTS = f"SELECT t AS element_type, count(*) AS n FROM (SELECT element_type AS t FROM ({_NODES}) UNION ALL SELECT edge_type FROM ({_EDGES})) GROUP BY 1"

_SOLUTIONS = f"""WITH c AS (SELECT count(*) AS parts, count(DISTINCT p_type) AS types, count(DISTINCT p_brand) AS brands, count(DISTINCT (p_type, p_brand)) AS pairs FROM part)
  SELECT '{OWL}Ontology' AS nodetype, 0 AS weight, 1::BIGINT AS n UNION ALL SELECT '{OWL}Class', 1, types + brands FROM c UNION ALL SELECT '{OWL}versionInfo', 2, 1
  UNION ALL SELECT '{RDFS}subClassOf', 2, pairs FROM c UNION ALL SELECT '{OWL}ObjectProperty', NULL, 1 UNION ALL SELECT '{OWL}FunctionalProperty', NULL, 1 UNION ALL SELECT '{OWL}DatatypeProperty', NULL, 1
  UNION ALL SELECT '{OWL}NamedIndividual', 2, parts + types + brands + 4 FROM c UNION ALL SELECT '{BASE}#madeAs', 2, 2 * types FROM c UNION ALL SELECT '{BASE}#size', 2, 1 UNION ALL SELECT NULL, NULL, types FROM c"""

_STORED = f"""SELECT p, o_kind, count(*) AS n FROM (
          SELECT '{TYPE}' AS p, 'I' AS o_kind FROM part UNION ALL SELECT '{TYPE}', 'I' FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT '{TYPE}', 'I' FROM (SELECT DISTINCT p_brand FROM part)
          UNION ALL SELECT '{TYPE}', 'I' FROM range(4) UNION ALL SELECT '{OWL}versionInfo', 'L' UNION ALL SELECT '{RDFS}label', 'L' FROM (SELECT DISTINCT p_type FROM part)
          UNION ALL SELECT '{RDFS}domain', 'I' FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT '{RDFS}subClassOf', 'I' FROM (SELECT DISTINCT p_type, p_brand FROM part)) GROUP BY 1, 2"""

QUERIES = {
    "graph_nodes": (graph_nodes, _NODES),
    "graph_edges": (graph_edges, _EDGES),
    "graph_facets": (graph_facets, _COUNTS),
    "graph_totals": (
        graph_totals,
        f"SELECT * FROM (SELECT count(*) AS nodes, count(label) AS node_labels, sum(individuals)::BIGINT AS individuals FROM ({_NODES})), (SELECT count(*) AS edges, count(label) AS edge_labels, 0::BIGINT AS cardinalities, count(nullif(traits, '')) AS with_characteristics FROM ({_EDGES}))",
    ),
    "graph_visible": (
        graph_visible,
        f"SELECT CASE WHEN element_type IN ('owl:Class','owl:Thing') THEN 'classes' WHEN element_type='rdfs:Literal' THEN 'rdf' ELSE 'properties' END AS filter_group, sum(CASE WHEN element_type='rdfs:subClassOf' THEN 0 ELSE n END)::BIGINT AS shown, sum(n)::BIGINT AS total FROM ({_COUNTS}) GROUP BY 1",
    ),
    "graph_solutions": (graph_solutions, _SOLUTIONS),
    "graph_search": (graph_search, "SELECT 'owl:Class' AS element_type, string_agg(DISTINCT concat('Type ', p_type), ',' ORDER BY concat('Type ', p_type)) AS labels FROM part"),
    "graph_lines_round_trip": (graph_lines_round_trip, _STORED),
    "graph_turtle_round_trip": (graph_turtle_round_trip, _STORED),
    "graph_clause": (
        graph_clause,
        "SELECT concat('urn:n:', c_nationkey) AS g, concat('urn:c:', c_custkey) AS c, c_mktsegment AS s FROM customer UNION ALL SELECT NULL, concat('urn:c:', c_custkey), c_mktsegment FROM customer WHERE c_nationkey = 3",
    ),
    "lines_escapes": (
        lines_escapes,
        "SELECT '#own' AS g, concat('urn:né:', n_nationkey) AS s, hex(concat('café ', n_name, chr(9), chr(34), chr(128512), chr(92), 'n', chr(10), chr(8), chr(12), chr(10), chr(13), chr(39))) AS bytes, 'en' AS o_lang, (SELECT count(*) FROM nation) AS rejected FROM nation",
    ),
    "graph_json": (graph_json, None),
}


def queries() -> dict:
    return {n: f for n, (f, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {n: s for n, (_, s) in QUERIES.items() if s}
