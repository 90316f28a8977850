"""The default query over an ontology graph: which quads become rows (id, nodeType, target, label).

Most rows come from one predicate or one type: these are two rule tables, so one pass over
the quads, joined with the rules, replaces a union of many scans. The rest is put together
from a few tables that are made once: the members of all lists, the operands of all set
operators, the named classes right below anonymous ones, and the ends of properties.

The result is a bag, and says how often something is stated; where a row stands for several
statements at once it is repeated (``_times``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vocabulary as V
from weftgraph.functions.vocabulary import DC, DCTERMS, OWL, RDF, RDFS, XML, XSD
from weftgraph.operators.closure import list_members
from weftgraph.plans import compile as C
from weftgraph.plans.sparql import parse
from weftgraph.session import cut

NOT_SUB = (RDFS + "subClassOf", RDFS + "subPropertyOf")

#: type IRI -> (node type, kinds of id, ids left out)
TYPE_RULES: dict[str, tuple[str, str, tuple]] = {OWL + "Class": (OWL + "Class", "I", ())}
TYPE_RULES |= {OWL + x: (OWL + x, "IB", ()) for x in ("DeprecatedClass", "Thing", "real", "rational", "DatatypeProperty", "DeprecatedProperty", "ObjectProperty", "hasKey", "Ontology", "Axiom")}
TYPE_RULES |= {RDF + x: (RDF + x, "IB", ()) for x in ("HTML", "PlainLiteral", "XMLLiteral")}
TYPE_RULES |= {RDFS + x: (RDFS + x, "IB", ()) for x in ("Literal", "Resource", "Datatype")}
TYPE_RULES |= {OWL + x: (OWL + x, "IB", () if x == "AsymmetricProperty" else NOT_SUB) for x in V.CHARACTERISTICS}
#: Types of values, looked for only when the filter names them.
VALUE_RULES = {XSD + x: (XSD + x, "IB", ()) for x in V.XSD_NAMES}

#: predicate IRI -> node type
PREDICATE_RULES: dict[str, str] = {p: p for p in (*V.RESTRICTION_PREDICATES, OWL + "equivalentClass", OWL + "disjointWith", OWL + "inverseOf", RDF + "Property")}
PREDICATE_RULES |= {ns + n: ns + n for ns in (DC, DCTERMS) for n in V.DC_NAMES}
PREDICATE_RULES |= {RDFS + x: RDFS + x for x in ("comment", "isDefinedBy", "seeAlso")}
PREDICATE_RULES |= {OWL + x: OWL + x for x in ("versionInfo", "versionIRI", "priorVersion", "incompatibleWith", "backwardCompatibleWith", "annotatedSource", "annotatedProperty", "annotatedTarget")}
METADATA = tuple(p for p in PREDICATE_RULES if p.startswith((DC, DCTERMS)) or p in {RDFS + x for x in ("comment", "isDefinedBy", "seeAlso")} | {OWL + x for x in ("versionInfo", "versionIRI", "priorVersion", "incompatibleWith", "backwardCompatibleWith", "annotatedSource", "annotatedProperty", "annotatedTarget")})

COLUMNS = ["id_kind", "id", "nodetype_kind", "nodetype", "target_kind", "target", "target_dt", "target_lang", "label", "label_lang"]


def by_rules(quads: DataFrame, on: set[str] | None = None) -> DataFrame:
    """Rows of all rules in one pass: a quad's predicate, or its type, looked up in the rules (some 120 rows, broadcast).

    ``on``: the node types that a filter lets through; it may name types of values, and leaves metadata out."""
    spark = quads.sparkSession
    types, predicates = TYPE_RULES, PREDICATE_RULES
    if on is not None:
        base = {OWL + "Ontology"} if on else set()
        types = {o: r for o, r in (TYPE_RULES | VALUE_RULES).items() if r[0] in on | base}
        predicates = {p: n for p, n in PREDICATE_RULES.items() if n in on and p not in METADATA}
    rules = [("p", p, n, "IB", []) for p, n in predicates.items()] + [("t", o, n, k, list(x)) for o, (n, k, x) in types.items()]
    table = F.broadcast(spark.createDataFrame(rules, "how string, key string, node string, kinds string, left_out array<string>"))
    is_type = (F.col("p") == V.TYPE) & (F.col("o_kind") == "I")
    keyed = quads.withColumn("how", F.when(is_type, "t").otherwise("p")).withColumn("key", F.when(is_type, F.col("o")).otherwise(F.col("p")))
    hit = keyed.join(table, ["how", "key"]).where(F.col("kinds").contains(F.col("s_kind")) & ~F.array_contains("left_out", F.col("s")))
    target = lambda c: F.when(F.col("how") == "p", F.col(c))
    none = F.lit(None).cast("string")
    return hit.select(
        F.col("s_kind").alias("id_kind"), F.col("s").alias("id"), F.lit("I").alias("nodetype_kind"), F.col("node").alias("nodetype"),
        target("o_kind").alias("target_kind"), target("o").alias("target"), target("o_dt").alias("target_dt"), target("o_lang").alias("target_lang"),
        none.alias("label"), none.alias("label_lang"),
    )


#: Predicates whose object is a list, and those of set operators.
LISTS = tuple(OWL + x for x in ("unionOf", "intersectionOf", "disjointUnionOf", "oneOf"))
OPERATORS = (*(x for x in LISTS if x != OWL + "oneOf"), OWL + "complementOf")
#: Statements that point at an anonymous enumeration, each of which counts its members once more.
ENUMERATION_USES = (OWL + "equivalentClass", RDFS + "subClassOf", RDFS + "range")
#: Where a label is looked for; the first of these that the graph uses at all gives the rows.
LABELS = (RDFS + "label", RDF + "resource", RDF + "ID")
#: Kinds of rows that a filter can't switch off.
ALWAYS = ("label", "ends", "members", "individuals", "deprecated", "xml_base")
O = ("o_kind", "o", "o_dt", "o_lang")


def _row(df: DataFrame, node, id_kind="s_kind", id_="s", target=None, node_kind: Column | None = None, label: Column | None = None, label_lang: Column | None = None) -> DataFrame:
    """Rows in the form of ``COLUMNS``. ``target``: names of four columns, or none."""
    none = F.lit(None).cast("string")
    to_kind, to, dt, lang = [F.col(c) for c in target] if target else [none] * 4
    node = F.lit(node) if isinstance(node, str) else node
    kind = F.when(node.isNotNull(), F.coalesce(node_kind, F.lit("I")) if node_kind is not None else F.lit("I"))
    values = [F.col(id_kind), F.col(id_), kind, node, to_kind, to, dt, lang, none if label is None else label, none if label_lang is None else label_lang]
    return df.select(*[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)])


def _times(df: DataFrame, n: Column) -> DataFrame:
    """Each row as often as ``n`` says."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), n.cast("int")))).drop("_copy")


class Groups:
    """The rows that rules over single quads can't give, by kind."""

    def __init__(self, quads: DataFrame):
        self.q = quads
        stated = self.of(*LISTS).select("s_kind", "s", "p", F.col("o").alias("head"))
        cells = self.of(V.REST).select(F.col("s").alias("a"), F.col("o").alias("b"))
        firsts = self.of(V.FIRST).where((F.col("o_kind") != "I") | (F.col("o") != V.NIL)).select(F.col("s").alias("cell"), *O)
        #: s_kind, s, p and a member (o ...) of every list that p leads to.
        self.listed = cut(list_members(cells, stated, firsts).select("s_kind", "s", "p", *O))
        self.operands = self.listed.where(F.col("p") != OWL + "oneOf").unionByName(self.of(OWL + "complementOf").select("s_kind", "s", "p", *O))
        #: An anonymous class and the named classes stated to be below it: these own what it is made of.
        self.below = cut(self.of(RDFS + "subClassOf").where("s_kind = 'I' AND o_kind <> 'I'").select(F.col("o").alias("s"), F.col("s").alias("named")))
        #: Whatever has a set operator, told from the statement, not from its operands.
        self.made = cut(self.of(*OPERATORS).select("s", "s_kind").distinct())

    def of(self, *predicates: str) -> DataFrame:
        return self.q.where(F.col("p").isin(*predicates))

    def typed(self, *types: str) -> DataFrame:
        return self.of(V.TYPE).where((F.col("o_kind") == "I") & F.col("o").isin(*types))

    def operators(self, predicates=OPERATORS) -> DataFrame:
        rows = self.operands.where(F.col("p").isin(*predicates)).withColumn("anon", F.when(F.col("s_kind") != "I", F.col("s")))
        owned = rows.join(self.below.withColumnRenamed("s", "anon"), "anon", "left")
        owned = owned.withColumns({"id": F.coalesce("named", "s"), "id_kind": F.when(F.col("named").isNotNull(), "I").otherwise(F.col("s_kind"))})
        return _row(owned, F.col("p"), "id_kind", "id", O)

    def anonymous(self) -> DataFrame:
        drawn_with_their_owner = self.below.select("s").distinct().join(self.made.where("s_kind <> 'I'").select("s"), "s", "left_semi")
        rows = self.typed(OWL + "Class", OWL + "Restriction").where("s_kind <> 'I'").join(drawn_with_their_owner, "s", "left_anti")
        return _row(rows, "blanknode", node_kind=F.lit("L"))

    def rdfs_class(self) -> DataFrame:
        better = self.typed(OWL + "Class").select("s", "s_kind").distinct()
        rows = self.typed(RDFS + "Class").where((F.col("s_kind") != "I") | (F.col("s") != OWL + "Class"))
        return _row(rows.join(better, ["s", "s_kind"], "left_anti"), RDFS + "Class")

    def subclass(self) -> DataFrame:
        made = self.made.select(F.col("s").alias("o"), F.col("s_kind").alias("o_kind"))
        return _row(self.of(RDFS + "subClassOf").join(made, ["o", "o_kind"], "left_anti"), RDFS + "subClassOf", target=O)

    def xml_base(self) -> DataFrame:
        return _row(self.of(XML + "base"), XML + "base")

    def deprecated(self) -> DataFrame:
        boolean = (F.col("o_kind") == "L") & (F.col("o_dt") == XSD + "boolean") & F.col("o").isin("true", "1")
        said = (F.col("o_kind") != "B") & (F.lower("o") == "true")
        return _row(self.of(OWL + "deprecated").where(F.coalesce(boolean, F.lit(False)) | said), OWL + "deprecated", target=O)

    def members(self) -> DataFrame:
        uses = self.of(*ENUMERATION_USES).where("o_kind <> 'I'").groupBy(F.col("o").alias("s"), F.col("o_kind").alias("s_kind")).agg(F.count("*").alias("uses"))
        rows = self.listed.where(F.col("p") == OWL + "oneOf").join(uses, ["s", "s_kind"], "left")
        return _row(_times(rows, 1 + F.coalesce("uses", F.lit(0))), OWL + "oneOf", target=O)

    def individuals(self) -> DataFrame:
        rows = self.of(V.TYPE).where((F.col("o_kind") == "I") & (F.col("s_kind") == "I") & (F.col("o") != OWL + "NamedIndividual"))
        rows = rows.withColumns({"dt": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
        return _row(rows, OWL + "NamedIndividual", "o_kind", "o", ("s_kind", "s", "dt", "lang"))

    def ends(self) -> DataFrame:
        """A property, for each of its types, from each domain to each range; what is missing is a Thing, or a Literal for a datatype property."""
        kinds = self.typed(*V.PROPERTY_TYPES).select("s_kind", "s", F.when(F.col("o") == OWL + "DatatypeProperty", RDFS + "Literal").otherwise(OWL + "Thing").alias("usual"))
        domains = self.of(RDFS + "domain").select("s_kind", "s", F.col("o_kind").alias("id_kind"), F.col("o").alias("id"))
        ranges = self.of(RDFS + "range").select("s_kind", "s", *O)
        rows = kinds.join(domains, ["s", "s_kind"], "left").join(ranges, ["s", "s_kind"], "left")
        from_ = F.coalesce("id", F.when(F.col("o").isNull(), OWL + "Thing").otherwise(F.col("usual")))
        rows = rows.withColumns({"id": from_, "id_kind": F.coalesce("id_kind", F.lit("I")), "o": F.coalesce("o", "usual"), "o_kind": F.coalesce("o_kind", F.lit("I"))})
        return _row(rows, F.col("s"), "id_kind", "id", O, node_kind=F.col("s_kind"))

    def label(self) -> DataFrame:
        for i, p in enumerate(LABELS):
            rows = self.of(p)
            if rows.isEmpty():
                continue
            for other in LABELS[i + 1 :]:  # a statement under a later name repeats the row
                more = self.of(other).groupBy("s", "s_kind").agg(F.count("*").alias("n"))
                rows = _times(rows.join(more, ["s", "s_kind"], "left"), F.coalesce("n", F.lit(1))).drop("n")
            return _row(rows, F.lit(None).cast("string"), label=F.when(F.col("o_kind") != "B", F.col("o")), label_lang=F.col("o_lang"))
        nothing = self.q.sparkSession.createDataFrame([(None, None)], "s_kind string, s string")
        return _row(nothing, F.lit(None).cast("string"), label=F.lit(""))


def _weight() -> Column:
    """Where rows come in the order of the query. The ontology first, then classes and axioms, then
    the rest. A row is tested against one after the other; what can't be told, for it has no target, has no weight."""
    axiom = (F.col("target_kind") == "I") & (F.col("target") == OWL + "Axiom")
    tests = F.when(F.col("nodetype") == OWL + "Ontology", 0).when(F.col("nodetype") == OWL + "Class", 1).when(F.col("target").isNull(), F.lit(None)).when(axiom, 1).otherwise(2)
    return F.when(F.col("nodetype").isNotNull(), tests).cast("int")


def solutions(quads: DataFrame, shown: dict[str, bool] | None = None) -> DataFrame:
    """The default query's rows with their weight; the order is by weight, rows without one first.

    ``shown``: of the element types (node types as IRIs, or names of kinds) those that are switched on give rows,
    beside what no filter switches off; metadata is then left out, and with nothing on there are no rows.
    """
    on = None if shown is None else {k for k, v in shown.items() if v}
    groups = Groups(quads)
    parts = {k: getattr(groups, k) for k in ("anonymous", "rdfs_class", "subclass", *ALWAYS)}
    out = by_rules(quads, on)
    for name, rows in parts.items():
        if on is None or name in on or (on and name in ALWAYS):
            out = out.unionByName(rows())
    operators = [p for p in OPERATORS if on is None or p in on or p.removeprefix(OWL) in on]
    if operators:
        out = out.unionByName(groups.operators(operators))
    return out.select(*COLUMNS, _weight().alias("weight"))


def run_text(quads: DataFrame, text: str) -> DataFrame:
    """Any SELECT over quads, its variables as text."""
    return C.solutions(C.select(parse(text), C.QuadGraph(quads)))
