"""Counts, filters, languages and search over a display graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# The groups of element types that filters switch together.
GROUPS = {
    "classes": ("owl:Class", "rdfs:Class", "owl:AnonymousClass", "owl:ExternalClass", "owl:EquivalentClass", "owl:DeprecatedClass", "owl:Thing"),
    "rdf": ("rdfs:Resource", "rdfs:Literal", "rdfs:Datatype"),
    "set_operators": ("owl:UnionOf", "owl:IntersectionOf", "owl:Complement", "owl:DisjointUnion", "owl:disjointWith"),
    "properties": ("owl:ObjectProperty", "owl:DatatypeProperty", "owl:DeprecatedProperty", "owl:ExternalProperty", "owl:InverseOf", "owl:ValuesFrom", "rdfs:subClassOf"),
}


def in_group(element_type: Column, *groups: str) -> Column:
    return element_type.isin(*[t for g in groups for t in GROUPS[g]])


def group_of(element_type: Column) -> Column:
    out = F.lit("other")
    for g, types in GROUPS.items():
        out = F.when(element_type.isin(*types), g).otherwise(out)
    return out


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """element_type, n: nodes, and elements of edges; the two directions of an inverse are one element."""
    drawn = edges.select("edge_type", F.when(F.col("edge_type") == "owl:InverseOf", F.struct(F.least("domain", "range"), F.greatest("domain", "range"), "label").cast("string")).otherwise(F.monotonically_increasing_id().cast("string")).alias("x")).distinct()
    return nodes.select("element_type").unionByName(drawn.select(F.col("edge_type").alias("element_type"))).groupBy("element_type").agg(F.count("*").alias("n")).orderBy("element_type")


def display_name(element_type: Column) -> Column:
    """What a type is called in a list: its local name in words."""
    local = F.regexp_replace(element_type, "^[^:]*:", "")
    return F.initcap(F.regexp_replace(local, "(?<=[a-z])(?=[A-Z])", " "))


def entries(counted: DataFrame) -> DataFrame:
    """The entries of a filter list, by what they are called."""
    return counted.select(display_name(F.col("element_type")).alias("name"), "element_type", "n").orderBy("name", "element_type")


# What a summary counts of nodes and of edges.
def _of_nodes() -> list[Column]:
    return [F.count("*").alias("nodes"), F.count("label").alias("node_labels"), F.coalesce(F.sum("individuals"), F.lit(0)).alias("individuals")]


def _of_edges() -> list[Column]:
    traits = F.coalesce(F.sum((F.size("characteristics") > 0).cast("long")), F.lit(0))
    return [F.count("*").alias("edges"), F.count("label").alias("edge_labels"), F.count(F.coalesce("card_min", "card_max")).alias("cardinalities"), traits.alias("with_characteristics")]


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals of a display graph, one row."""
    return nodes.agg(*_of_nodes()).crossJoin(edges.agg(*_of_edges()))  # one row each


def write(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """Nodes and edges as tables in ``path``; the totals of ``summary``, counted while the rows are written."""
    seen = {}
    for name, df, counted in (("nodes", nodes, _of_nodes()), ("edges", edges, _of_edges())):
        totals = Observation()
        df.observe(totals, *counted).write.mode("overwrite").parquet(f"{path}/{name}")
        seen |= totals.get
    return seen


def visible(counted: DataFrame, shown: dict[str, bool]) -> DataFrame:
    """Per group: how many elements are shown, and how many there are. Types not named are shown."""
    on = F.lit(True)
    for t, v in shown.items():
        on = F.when(F.col("element_type") == t, F.lit(v)).otherwise(on)
    return counted.groupBy(group_of(F.col("element_type")).alias("filter_group")).agg(F.sum(F.when(on, F.col("n")).otherwise(0)).alias("shown"), F.sum("n").alias("total"))


def hide(nodes: DataFrame, edges: DataFrame, shown: dict[str, bool]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the types that are shown; an edge goes with its ends."""
    off = [t for t, v in shown.items() if not v]
    if not off:
        return nodes, edges
    kept = nodes.where(~F.col("element_type").isin(*off))
    left = edges.where(~F.col("edge_type").isin(*off))
    for end in ("domain", "range"):
        left = left.join(kept.select(F.col("term").alias(end)), end, "left_semi")
    return kept, left


def toggle_all(types: list[str], on: bool) -> dict[str, bool]:
    return dict.fromkeys(types, on)


def in_language(values: Column, lang: str) -> Column:
    """Of values by language those in ``lang``, else all of them."""
    return F.coalesce(F.element_at(values, lang), F.array_sort(F.flatten(F.map_values(values))))


def metadata_in(metadata: DataFrame, lang: str) -> DataFrame:
    """term, prop, values: of each property the values in ``lang``, and all where there are none."""
    chosen = F.collect_set(F.when(F.col("lang") == lang, F.col("value")))
    values = F.when(F.size(chosen) > 0, chosen).otherwise(F.collect_set("value"))
    return metadata.groupBy("term", "prop").agg(F.array_sort(values).alias("values"))


def search(nodes: DataFrame, prefix: str) -> DataFrame:
    """Labels that begin so, whatever their case, by element type."""
    hit = nodes.where(F.lower("label").startswith(prefix.lower()))
    return hit.groupBy("element_type").agg(F.array_sort(F.collect_set("label")).alias("labels"))
