"""From an ontology's quads to its display graph: nodes, edges, metadata, header, annotations, diagnostics.

A fixed sequence of set-oriented phases; each reads what the earlier ones made, so nothing
is deferred or tried again. Where the outcome could depend on the order of rows, the
smallest term decides.

1 base and labels; 2 types of nodes and properties; 3 equivalent classes merged; 4 edges of
the class structure; 5 edges of properties with their missing ends put in; 6 restrictions
folded into edges of their owner; 7 inverse properties merged, by components with a sign; 8 names, counts, traits;
9 nodes for ends that no row typed; 10 output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import terms
from weftgraph.functions import vocabulary as V
from weftgraph.functions.vocabulary import DC, DCTERMS, OWL, RDF, RDFS
from weftgraph.operators.closure import least_members, list_members, representatives, signed_components
from weftgraph.session import cut, cut_some, nothing, numbered, without_rows

NODE = "term string, term_kind string, element_type string, label string, individuals long"
EDGE = ["domain", "range", "edge_type", "property", "label", "card_min", "card_max"]
#: Types of nodes from the most to the least telling: of several, the first counts.
RANK = ("owl:Class", "owl:AnonymousClass", "rdfs:Class", "owl:DeprecatedClass", "rdfs:Datatype", "owl:Thing", "rdfs:Literal", "rdfs:Resource")
#: Set operators, and the node type they give their owner.
OPERATORS = {OWL + "unionOf": "owl:UnionOf", OWL + "intersectionOf": "owl:IntersectionOf", OWL + "complementOf": "owl:Complement", OWL + "disjointUnionOf": "owl:DisjointUnion"}
#: Predicates that lead to a list of what they are about.
LISTS = (OWL + "unionOf", OWL + "intersectionOf", OWL + "disjointUnionOf", OWL + "oneOf")
#: Terms of the languages that are looked for before the phases: those that don't occur cost no job.
MOST_TERMS = 1000
NO_DRAW = "NoDraw"
#: Terms that say what a property is like, and can't be one that is drawn.
NO_PROPERTIES = (RDFS + "domain", RDFS + "label", RDFS + "range")
#: A mark for ends of edges that nothing tells what they are.
UNRESOLVED = "unresolved"


@dataclass
class Display:
    nodes: DataFrame
    edges: DataFrame
    metadata: DataFrame
    header: DataFrame
    annotations: DataFrame
    diagnostics: DataFrame


def _null(kind: str = "string"):
    return F.lit(None).cast(kind)


class Assembler:
    def __init__(self, quads: DataFrame):
        self.spark = quads.sparkSession
        self.q = cut(quads.dropDuplicates())
        self.present = self._present()
        self.base = self._base()
        self.listed = self._listed()

    # ---- helpers
    def _present(self) -> set | None:
        """Which predicates and types of the languages occur, as (predicate, type or None); None if there are too many to tell."""
        told = lambda c: F.col(c).rlike("^(?:" + "|".join(ns.replace(".", "[.]") for ns in (OWL, RDFS, RDF, V.XSD, DC, DCTERMS)) + ")")
        type_ = F.when((F.col("p") == V.TYPE) & (F.col("o_kind") == "I") & told("o"), F.col("o"))
        found = self.q.where(told("p")).select("p", type_.alias("type")).distinct().limit(MOST_TERMS + 1).collect()
        return None if len(found) > MOST_TERMS else {tuple(r) for r in found} | {(r["p"], None) for r in found}

    def nothing(self) -> DataFrame:
        """No quads, and the optimiser knows: what is joined with them costs no job."""
        return self.q.where(F.lit(False))

    def of(self, *predicates: str) -> DataFrame:
        here = [p for p in predicates if self.present is None or (p, None) in self.present]
        return self.q.where(F.col("p").isin(*here)) if here else self.nothing()

    def typed(self, *types: str) -> DataFrame:
        here = [t for t in types if self.present is None or (V.TYPE, t) in self.present]
        return self.q.where((F.col("p") == V.TYPE) & (F.col("o_kind") == "I") & F.col("o").isin(*here)) if here else self.nothing()

    def _listed(self) -> DataFrame:
        """(p, owner, owner_kind, and the member's o_kind, o, o_dt, o_lang) of all lists that the predicates of lists point at, flattened at once."""
        heads = self.of(*LISTS).select("p", F.col("s").alias("owner"), F.col("s_kind").alias("owner_kind"), F.col("o").alias("head"))
        rest = self.of(V.REST).where(F.col("o") != V.NIL).select(F.col("s").alias("a"), F.col("o").alias("b"))
        firsts = self.of(V.FIRST).where(F.col("o") != V.NIL).select(F.col("s").alias("cell"), "o_kind", "o", "o_dt", "o_lang")
        columns = ["p", "owner", "owner_kind", "o_kind", "o", "o_dt", "o_lang"]
        if nothing(heads):
            return firsts.select(F.lit("").alias("p"), F.lit("").alias("owner"), F.lit("").alias("owner_kind"), *columns[3:]).where(F.lit(False))
        return cut(list_members(rest, heads, firsts).select(*columns).distinct())

    def lists(self, predicate: str) -> DataFrame:
        """The rows of ``listed`` of one predicate."""
        found = self.listed.where(F.col("p") == predicate) if self.present is None or (predicate, None) in self.present else self.listed.where(F.lit(False))
        return found.drop("p")

    def _base(self) -> str | None:
        """The document's base: of several ontologies the one with the least name counts."""
        row = self.typed(OWL + "Ontology").where("s_kind = 'I'").agg(F.min("s").alias("s")).first()
        return row["s"] if row else None

    # ---- phases
    def run(self) -> Display:
        self.labels()
        self.same_properties()
        self.types()
        self.merge_equivalents()
        self.structure()
        self.property_edges()
        self.restrictions()
        self.inverses()
        return self.output()

    def labels(self) -> None:
        self.explicit = self.of(RDFS + "label").where("o_kind = 'L'").groupBy(F.col("s").alias("term")).agg(F.min_by("o", F.struct("o", "o_lang")).alias("label"), F.min_by("o_lang", F.struct("o", "o_lang")).alias("lang"))

    def named(self, df: DataFrame, term: str) -> DataFrame:
        """``df`` with ``label``: the explicit label of a term, else what its IRI ends in."""
        found = self.explicit.select(F.col("term").alias(term), F.col("label").alias("_label"))
        iri = F.when(~F.col(term).contains("#b") | F.col(term).rlike("^[a-z]+:"), terms.iri_label(F.col(term)))
        return df.join(found, term, "left").withColumn("label", F.coalesce("_label", iri)).drop("_label")

    def same_properties(self) -> None:
        """Properties that statements of inverses make the same.

        An inverse of an inverse is the property itself, so components of the statements carry a sign. Of the names on
        each side the least stands for all (``same``: property, rep, flip), also for blank nodes, which take the name of the
        other side, turned round, where theirs has none. ``opposite`` pairs the two sides' names; a component in which a
        property would be its own inverse by way of others is ``torn``, is reported, and only its blank nodes are renamed.
        """
        ends = F.array(F.struct(F.col("s").alias("property"), F.col("s_kind").alias("kind")), F.struct(F.col("o").alias("property"), F.col("o_kind").alias("kind")))
        said = self.of(OWL + "inverseOf").where("o_kind <> 'L' AND s <> o")
        if nothing(said):
            none = lambda *names: self.nothing().select(*[F.col("s").alias(n) for n in names])
            self.same, self.opposite, self.torn = none("property", "rep").withColumn("flip", F.lit(False)), none("p1", "p2"), none("property")
            self.sides = none("comp", "property")
            return
        kinds = said.select(F.explode(ends).alias("x")).select("x.*").distinct()
        signed = signed_components(said.select(F.col("s").alias("u"), F.col("o").alias("v"), F.lit(True).alias("opposite")))
        members = cut(signed.select(F.col("node").alias("property"), F.col("root").alias("comp"), "opposite", "torn").join(kinds, "property"))
        named = members.where("kind = 'I'")
        lead = named.groupBy("comp").agg(F.min_by("opposite", "property").alias("turned"))
        members = members.join(lead, "comp").withColumn("side", (F.col("opposite") != F.col("turned")) & ~F.col("torn"))
        reps = members.where("kind = 'I'").groupBy("comp").agg(F.min(F.when(~F.col("side"), F.col("property"))).alias("p1"), F.min(F.when(F.col("side"), F.col("property"))).alias("p2"))
        sided = cut(members.join(reps, "comp"))
        own, other = F.when(F.col("side"), F.col("p2")).otherwise(F.col("p1")), F.when(F.col("side"), F.col("p1")).otherwise(F.col("p2"))
        moved = sided.where((F.col("kind") != "I") | ~F.col("torn")).select("property", F.coalesce(own, other).alias("rep"), own.isNull().alias("flip"))
        self.same = cut(moved.where("property <> rep"))
        whole = sided.where(~F.col("torn") & F.col("p2").isNotNull() & (F.col("kind") == "I"))
        self.opposite = whole.select("p1", "p2").distinct()
        self.sides = whole.select(F.col("p1").alias("comp"), "property")
        self.torn = sided.where("torn AND kind = 'I'").select("property")

    def as_same(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with properties replaced by the one that stands for them, and ``flip`` where it is turned round."""
        on = self.same.select(F.col("property").alias(column), "rep", "flip")
        return df.join(on, column, "left").withColumns({column: F.coalesce("rep", column), "flip": F.coalesce("flip", F.lit(False))}).drop("rep")

    def types(self) -> None:
        rule = {
            OWL + "Class": F.when(F.col("s_kind") == "I", "owl:Class").otherwise("owl:AnonymousClass"), OWL + "Restriction": F.when(F.col("s_kind") == "B", "owl:AnonymousClass"),
            OWL + "DeprecatedClass": F.lit("owl:DeprecatedClass"), RDFS + "Class": F.lit("rdfs:Class"), OWL + "Thing": F.lit("owl:Thing"),
            RDFS + "Literal": F.lit("rdfs:Literal"), RDFS + "Resource": F.lit("rdfs:Resource"), RDFS + "Datatype": F.lit("rdfs:Datatype"),
        }
        rows = self.typed(*rule, *V.DATATYPES)
        element = F.lit("rdfs:Datatype")
        for o, e in rule.items():
            element = F.when(F.col("o") == o, e).otherwise(element)
        rank = F.array_position(F.array(*[F.lit(x) for x in RANK]), F.col("element_type"))
        found = rows.select(F.col("s").alias("term"), F.col("s_kind").alias("term_kind"), element.alias("element_type")).where("element_type IS NOT NULL")
        nodes = found.groupBy("term", "term_kind").agg(F.min_by("element_type", rank).alias("element_type"))
        outside = terms.is_external(F.col("term_kind"), F.col("term"), F.lit(self.base).cast("string"))
        nodes = nodes.withColumn("element_type", F.when(outside & F.col("element_type").isin("owl:Class", "rdfs:Class", "owl:DeprecatedClass", "rdfs:Datatype"), "owl:ExternalClass").otherwise(F.col("element_type")))
        truth = self.of(OWL + "deprecated").where(F.lower("o") == "true").select(F.col("s").alias("term")).distinct()
        self.deprecated = truth
        flagged = nodes.join(truth.withColumn("_d", F.lit(True)), "term", "left")
        upgrade = F.col("_d").isNotNull() & F.col("element_type").isin("owl:Class", "owl:AnonymousClass", "rdfs:Class", "owl:ExternalClass", "owl:EquivalentClass")
        self.nodes = cut_some(flagged.withColumn("element_type", F.when(upgrade, "owl:DeprecatedClass").otherwise(F.col("element_type"))).drop("_d"))
        # properties: object, datatype; a trait or an inverse makes an object property of what has no type
        kinds = {OWL + "DatatypeProperty": "owl:DatatypeProperty", OWL + "ObjectProperty": "owl:ObjectProperty"}
        traits = self.typed(*[OWL + x for x in V.CHARACTERISTICS], RDF + "Property", OWL + "DeprecatedProperty")
        inverse = self.of(OWL + "inverseOf").select(F.explode(F.array(F.struct("s", "s_kind"), F.struct(F.col("o").alias("s"), F.col("o_kind").alias("s_kind")))).alias("x")).select("x.*")
        told = self.typed(*kinds).select("s", "s_kind", F.when(F.col("o") == OWL + "DatatypeProperty", 1).otherwise(2).alias("k"))
        guessed = traits.select("s", "s_kind").unionByName(inverse).select("s", "s_kind", F.lit(3).alias("k"))
        stated = told.unionByName(guessed).where("s_kind = 'I'").select(F.col("s").alias("property"), "k")
        props = self.as_same(stated, "property").groupBy("property").agg(F.min("k").alias("k"))
        props = props.where(~F.col("property").isin(RDFS + "subClassOf", RDFS + "subPropertyOf", *NO_PROPERTIES))
        outside = terms.is_external(F.lit("I"), F.col("property"), F.lit(self.base).cast("string"))
        old = self.typed(OWL + "DeprecatedProperty").select(F.col("s").alias("property")).unionByName(truth.select(F.col("term").alias("property"))).distinct().withColumn("_d", F.lit(True))
        kind = F.when(F.col("k") == 1, "owl:DatatypeProperty").otherwise("owl:ObjectProperty")
        shown = F.when(F.col("_d").isNotNull(), "owl:DeprecatedProperty").when(outside, "owl:ExternalProperty").otherwise(kind)
        self.props = cut_some(props.join(old, "property", "left").select("property", kind.alias("kind"), shown.alias("edge_type")))

    def merge_equivalents(self) -> None:
        """Equivalent classes become one node; restrictions don't take part: they are folded into their owner."""
        folded = self.of(OWL + "onProperty").select(F.col("s").alias("a")).distinct()
        self.restricted = cut_some(folded)
        pairs = self.of(OWL + "equivalentClass").where("o_kind <> 'L'").select(F.col("s").alias("a"), F.col("o").alias("b"))
        pairs = pairs.join(folded, "a", "left_anti").join(folded.withColumnRenamed("a", "b"), "b", "left_anti").where("a <> b")
        roots = least_members(pairs)
        kinds = self.of(OWL + "equivalentClass").select(F.explode(F.array(F.struct(F.col("s").alias("node"), F.col("s_kind").alias("k"), F.lit(0).alias("object")), F.struct(F.col("o").alias("node"), F.col("o_kind").alias("k"), F.lit(1).alias("object")))).alias("x")).select("x.*")
        members = roots.join(kinds.groupBy("node").agg(F.min("k").alias("k"), F.min("object").alias("object")), "node")
        # the representative: a named subject, else a named class, else the least
        chosen = members.groupBy("root").agg(F.min_by("node", F.struct(F.when(F.col("k") == "I", 0).otherwise(1), "object", "node")).alias("rep"), F.sum((F.col("k") == "I").cast("int")).alias("named"))
        self.canon = cut_some(members.join(chosen, "root").select(F.col("node").alias("term"), "rep", "named"))
        merged = self.named(self.canon.where("named > 1"), "term").groupBy(F.col("rep").alias("term")).agg(F.array_join(F.array_sort(F.collect_set("label")), "\n").alias("_merged"))
        own = self.named(self.canon.where("term = rep AND named > 1").select("term"), "term").select("term", F.col("label").alias("_own"))
        others = F.array_except(F.split("_merged", "\n"), F.array("_own"))
        self.merged_labels = cut_some(merged.join(own, "term").select("term", F.array_join(F.array_union(F.array("_own"), others), "\n").alias("merged")))

    def moved(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with terms replaced by what they were merged into."""
        for c in columns:
            on = self.canon.select(F.col("term").alias(c), F.col("rep").alias("_rep"))
            df = df.join(on, c, "left").withColumn(c, F.coalesce("_rep", c)).drop("_rep")
        return df

    def structure(self) -> None:
        """Edges of subclass, disjoint and set operators, and members of enumerations."""
        none = _null()
        sets = None
        for p, node in OPERATORS.items():
            if p == OWL + "complementOf":
                part = self.of(p).select(F.col("s").alias("owner"), F.col("s_kind").alias("owner_kind"), "o_kind", "o", "o_dt", "o_lang")
            else:
                part = self.lists(p)
            part = part.withColumn("node", F.lit(node))
            sets = part if sets is None else sets.unionByName(part)
        sets = cut_some(sets)
        sub = self.of(RDFS + "subClassOf")
        above = sub.where("s_kind = 'I' AND o_kind = 'B'").select(F.col("o").alias("owner"), F.col("s").alias("named"))
        owned = sets.join(above, "owner", "left").withColumn("owner_kind", F.when(F.col("named").isNotNull(), "I").otherwise(F.col("owner_kind"))).withColumn("owner", F.coalesce("named", "owner"))
        self.sets = owned
        operands = sets.select(F.col("owner").alias("o")).distinct()
        plain = sub.where("o_kind <> 'L'").join(operands, "o", "left_anti")
        edge = lambda d, r, t: [F.col(d).alias("domain"), F.col(r).alias("range"), t.alias("edge_type"), none.alias("property"), none.alias("label"), none.alias("card_min"), none.alias("card_max")]
        edges = plain.select(*edge("s", "o", F.lit("rdfs:subClassOf")))
        edges = edges.unionByName(self.of(OWL + "disjointWith").where("o_kind <> 'L'").select(*edge("s", "o", F.lit("owl:disjointWith"))))
        edges = edges.unionByName(owned.where("o_kind <> 'L'").select(*edge("owner", "o", F.lit(NO_DRAW))))
        members = cut_some(self.lists(OWL + "oneOf"))
        value = F.when(F.col("o_kind") == "L", F.concat("owner", F.lit("_value"))).otherwise(F.col("o"))
        members = members.withColumn("member", value)
        edges = edges.unionByName(members.select(*edge("owner", "member", F.lit(NO_DRAW))))
        self.member_nodes = members.groupBy("member").agg(F.max(F.when(F.col("o_kind") == "L", F.col("o"))).alias("label"), F.max("o_kind").alias("k"))
        self.members = members.where("o_kind <> 'L'").select(F.col("owner").alias("cls"), F.col("o").alias("one"))
        self.struct_edges = self.moved(edges, "domain", "range").where("domain <> range OR edge_type NOT IN ('NoDraw', 'rdfs:subClassOf')")  # read once, in output

    def property_edges(self) -> None:
        """Edges of properties between declared ends; a missing end is a Thing or a Literal made for it."""
        said = self.as_same(self.of(RDFS + "domain", RDFS + "range").where("o_kind <> 'L'").select(F.col("s").alias("property"), "p", "o"), "property")
        is_domain = (F.col("p") == RDFS + "domain") != F.col("flip")  # of an inverse, the range
        ends = lambda p, n: said.where(is_domain if p == RDFS + "domain" else ~is_domain).select("property", F.col("o").alias(n)).distinct()
        rows = self.props.join(ends(RDFS + "domain", "domain"), "property", "left").join(ends(RDFS + "range", "range"), "property", "left")
        is_data = F.col("kind") == "owl:DatatypeProperty"
        default = F.when(is_data, RDFS + "Literal").otherwise(OWL + "Thing")
        rows = rows.withColumn("range", F.coalesce("range", default)).withColumn("domain", F.coalesce("domain", F.when(F.col("range") == default, OWL + "Thing").otherwise(default)))
        rows = self.moved(rows, "domain", "range")
        known = self.moved(self.nodes.select("term"), "term").distinct()
        for c in ("domain", "range"):
            rows = rows.join(known.select(F.col("term").alias(c), F.lit(True).alias(f"has_{c}")), c, "left")
        stand_in = lambda c: F.col(f"has_{c}").isNull() & F.col(c).isin(OWL + "Thing", RDFS + "Literal")
        d, r, both = stand_in("domain"), stand_in("range"), stand_in("domain") & stand_in("range")
        thing = lambda c: F.col(c) == OWL + "Thing"
        shared = (self.base or "urn:weftgraph:") + "_thing"
        domain = F.when(both & is_data, terms.synthetic(F.col("property"), "_localthing")).when(both, F.lit(shared)).when(d, F.when(thing("domain"), terms.synthetic(F.col("range"), "_thing")).otherwise(terms.synthetic(F.col("range"), "_literal"))).otherwise(F.col("domain"))
        range_ = F.when(both & is_data, terms.synthetic(F.col("property"), "_localliteral")).when(both, F.lit(shared)).when(r, F.when(thing("range"), terms.synthetic(F.col("domain"), "_thing")).otherwise(terms.synthetic(F.col("property"), "_literal"))).otherwise(F.col("range"))
        self.prop_edges = cut_some(rows.select(domain.alias("domain"), range_.alias("range"), "edge_type", "property", "kind", both.alias("fallback")).distinct())

    def restrictions(self) -> None:
        """Each restriction is one edge of its owner: property, what it leads to, and how often."""
        value = lambda p, c="o": F.max(F.when(F.col("p") == OWL + p, F.col(c)))
        rows = self.of(*V.RESTRICTION_PREDICATES)
        one = rows.groupBy(F.col("s").alias("r")).agg(
            value("onProperty").alias("on"), value("someValuesFrom").alias("some"), value("allValuesFrom").alias("all"), value("hasValue").alias("value"), value("hasValue", "o_kind").alias("value_kind"),
            value("hasSelf").alias("itself"), value("cardinality").alias("n"), value("qualifiedCardinality").alias("qn"), value("minCardinality").alias("lo"), value("minQualifiedCardinality").alias("qlo"),
            value("maxCardinality").alias("hi"), value("maxQualifiedCardinality").alias("qhi"), F.coalesce(value("onClass"), value("onDataRange")).alias("filler"),
        )
        # the property may be given by another name, or as the inverse of another
        one = self.as_same(one.where("on IS NOT NULL"), "on").drop("flip")
        # the owner: the subject of a subclass, equivalence, set or domain statement about the restriction; nested ones are followed up
        direct = self.of(RDFS + "subClassOf", OWL + "equivalentClass").where("o_kind = 'B'").select(F.col("o").alias("r"), F.col("s").alias("owner"))
        operand = self.sets.where("o_kind = 'B'").select(F.col("o").alias("r"), "owner")
        owners = direct.unionByName(operand).join(self.restricted.withColumnRenamed("a", "r"), "r", "left_semi").where("r <> owner").groupBy("r").agg(F.min("owner").alias("owner"))
        nested = self.restricted.select(F.col("a").alias("owner"))
        inner = owners.join(nested, "owner", "left_semi").select(F.col("r").alias("a"), F.col("owner").alias("b"))
        if not inner.isEmpty():
            up = representatives(owners.select(F.col("r").alias("a"), F.col("owner").alias("b")))
            owners = up.select(F.col("a").alias("r"), F.col("root").alias("owner"))
        self.owners = cut_some(owners)
        kinds = self.props.select(F.col("property").alias("on"), "kind", "edge_type")
        ranges = self.prop_edges.where("NOT fallback").groupBy(F.col("property").alias("on")).agg(F.min("range").alias("declared"))
        one = self.moved(one.join(self.owners, "r").join(kinds, "on", "left").join(ranges, "on", "left"), "owner")
        is_data = F.col("kind") == "owl:DatatypeProperty"
        filler = F.coalesce("some", "all", "filler")
        follow = self.owners.select(F.col("r").alias("_to"), F.col("owner").alias("_own"))
        one = one.withColumn("_to", filler).join(follow, "_to", "left").withColumn("_to", F.coalesce("_own", "_to"))
        target = (
            F.when(F.col("itself") == "true", F.col("owner"))
            .when(F.col("value_kind") == "L", terms.synthetic(F.col("r"), "_value"))
            .when(F.col("value").isNotNull(), F.col("value"))
            .when(F.col("_to").isNotNull() & (F.col("_to") != OWL + "Thing"), F.col("_to"))
            .when(is_data, F.coalesce("declared", terms.synthetic(F.col("r"), "_literal")))
            .otherwise(terms.synthetic(F.col("owner"), "_thing"))
        )
        exact, low, high = F.coalesce("n", "qn"), F.coalesce("lo", "qlo"), F.coalesce("hi", "qhi")
        card_min = F.when(F.col("some").isNotNull(), "∃").when(F.col("all").isNotNull(), "∀").when(F.col("value").isNotNull(), "value").when(F.col("itself") == "true", "self").otherwise(F.coalesce(exact, low, F.when(high.isNotNull(), "")))
        card_max = F.when(F.coalesce("some", "all", "value", "itself").isNotNull(), _null()).otherwise(F.coalesce("qn", F.when(low.isNotNull() & high.isNull(), "*"), high))
        shape = F.when(F.coalesce("some", "all").isNotNull(), "owl:ValuesFrom").otherwise(F.coalesce("edge_type", F.lit("owl:ObjectProperty")))
        folded = one.where(card_min.isNotNull()).select(F.col("owner").alias("domain"), target.alias("range"), shape.alias("edge_type"), F.col("on").alias("property"), card_min.alias("card_min"), card_max.alias("card_max"), "r", "value", "value_kind", F.coalesce(is_data, F.lit(False)).alias("is_data"))
        self.folded = cut_some(self.moved(folded, "range"))

    def inverses(self) -> None:
        """Two named inverse properties with mirrored ends are one pair of edges; others stay as they are, with a warning."""
        pairs = self.opposite
        shared = (self.base or "urn:weftgraph:") + "_thing"
        # of a property's ends the first of: a plain class; any stated one; one made for it; what stands in for all
        vague = self.moved(self.sets.select(F.col("owner").alias("domain")), "domain").unionByName(self.canon.where("named > 1").select(F.col("rep").alias("domain")))
        vague = vague.unionByName(self.nodes.where("term_kind = 'B'").select(F.col("term").alias("domain"))).distinct().withColumn("vague", F.lit(True))
        rank = lambda c, v: F.when(~terms.is_synthetic(F.col(c)), F.when(F.col(v).isNull() & ~F.col(c).isin(OWL + "Thing", RDFS + "Literal"), 0).otherwise(1)).when(F.col(c) != shared, 2).otherwise(3)
        ended = self.prop_edges.join(vague, "domain", "left").join(vague.select(F.col("domain").alias("range"), F.col("vague").alias("vague_range")), "range", "left")
        solid = ended.groupBy("property").agg(F.min_by("domain", F.struct(rank("domain", "vague"), "domain")).alias("d"), F.min_by("range", F.struct(rank("range", "vague_range"), "range")).alias("r"))
        on = lambda i: solid.select(F.col("property").alias(f"p{i}"), F.col("d").alias(f"d{i}"), F.col("r").alias(f"r{i}"))
        both = pairs.join(on(1), "p1").join(on(2), "p2")
        loose = lambda c: terms.is_synthetic(F.col(c))
        a = F.when(loose("d1") & ~loose("r2"), F.col("r2")).otherwise(F.col("d1"))
        b = F.when(loose("r1") & ~loose("d2"), F.col("d2")).otherwise(F.col("r1"))
        fits = (loose("d1") | loose("r2") | (F.col("d1") == F.col("r2"))) & (loose("r1") | loose("d2") | (F.col("r1") == F.col("d2")))
        merged = both.withColumns({"a": F.when(loose("d1") & loose("r2"), F.lit(shared)).otherwise(a), "b": F.when(loose("r1") & loose("d2"), F.lit(shared)).otherwise(b), "fits": fits})
        merged = merged.withColumns({"a": F.when((F.col("a") == shared) & (F.col("b") != shared), terms.synthetic(F.col("b"), "_thing")).otherwise(F.col("a")), "b": F.when((F.col("b") == shared) & (F.col("a") != shared), terms.synthetic(F.col("a"), "_thing")).otherwise(F.col("b"))})
        self.inverse = cut_some(merged)

    def output(self) -> Display:
        none = _null()
        gone = self.inverse.where("fits").select(F.explode(F.array("p1", "p2")).alias("property")).distinct()
        # an edge between two made ends goes once its property has a real one, here or in a restriction
        real = self.prop_edges.where("NOT fallback").select("property").unionByName(self.folded.select("property")).distinct()
        kept = self.prop_edges.join(gone, "property", "left_anti")
        kept = kept.where("NOT fallback").unionByName(kept.where("fallback").join(real, "property", "left_anti"))
        # one numeric restriction stands for the property's own edge between the same ends
        numeric = self.folded.where("edge_type <> 'owl:ValuesFrom'").select("domain", "range", "property").distinct()
        kept = kept.join(numeric, ["domain", "range", "property"], "left_anti")
        plain = self.named(kept.select("domain", "range", "edge_type", "property"), "property").select("domain", "range", "edge_type", "property", "label", none.alias("card_min"), none.alias("card_max"))
        folded = self.named(self.folded.join(gone, "property", "left_anti").unionByName(self.folded.join(gone, "property", "left_semi")), "property").select(*EDGE)
        pair = self.inverse.where("fits")
        # every name of both directions, the least property's first
        names = self.named(self.sides, "property").groupBy(F.col("comp").alias("p1")).agg(F.array_sort(F.collect_list(F.struct("property", "label"))).alias("names"))
        text = F.array_join(F.array_distinct(F.transform("names", lambda x: x["label"])), "\n")
        pair = pair.join(names, "p1")
        two = pair.select(F.explode(F.array(F.struct(F.col("a").alias("domain"), F.col("b").alias("range"), F.col("p1").alias("property")), F.struct(F.col("b").alias("domain"), F.col("a").alias("range"), F.col("p2").alias("property")))).alias("x"), text.alias("label"))
        two = two.select("x.domain", "x.range", F.lit("owl:InverseOf").alias("edge_type"), "x.property", "label", none.alias("card_min"), none.alias("card_max"))
        # restrictions that were folded leave no stub
        stubs = self.folded.select(F.col("r").alias("range")).distinct()
        struct = self.struct_edges.join(stubs, "range", "left_anti").join(stubs.withColumnRenamed("range", "domain"), "domain", "left_anti").select(*EDGE)
        edges = struct.unionByName(plain).unionByName(folded).unionByName(two)
        swap = F.col("edge_type") == "owl:disjointWith"
        edges = edges.withColumns({"domain": F.when(swap, F.least("domain", "range")).otherwise(F.col("domain")), "range": F.when(swap, F.greatest("domain", "range")).otherwise(F.col("range"))})
        # the label follows from type and property; whole rows are told apart without sorting them
        edges = cut_some(edges.distinct())
        nodes = self._nodes(edges)
        # an edge with an end that nothing tells of is reported, not drawn
        lost = nodes.where(F.col("element_type") == UNRESOLVED).select("term")
        if lost.isEmpty():  # as a rule: then no edge is dealt out again to look for its ends
            self.lost = without_rows(edges.withColumn("end", F.col("domain")))
        else:
            self.lost = cut_some(edges.withColumn("end", F.explode(F.array_distinct(F.array("domain", "range")))).join(lost.withColumnRenamed("term", "end"), "end"))
            nodes = nodes.where(F.col("element_type") != UNRESOLVED)
            for end in ("domain", "range"):
                edges = edges.join(lost.withColumnRenamed("term", end), end, "left_anti")
        traits = self.as_same(self.typed(*[OWL + x for x in V.CHARACTERISTICS]).select(F.col("s").alias("property"), F.regexp_replace("o", "^.*#", "").alias("trait")), "property").select("property", "trait")
        partner = self.inverse.where("fits").select(F.col("p1").alias("property"), F.col("p2").alias("o")).unionByName(self.inverse.where("fits").select(F.col("p2").alias("property"), F.col("p1").alias("o")))
        traits = traits.unionByName(partner.join(traits.select(F.col("property").alias("o"), "trait"), "o").select("property", "trait"))
        traits = traits.groupBy("property").agg(F.array_sort(F.collect_set("trait")).alias("characteristics"))
        edges = edges.join(traits, "property", "left").withColumn("characteristics", F.coalesce("characteristics", F.array().cast("array<string>"))).select(*EDGE, "characteristics")
        metadata, header = self._metadata(nodes)
        return Display(nodes, edges, metadata, header, self._annotations(), self._diagnostics())

    def _nodes(self, edges: DataFrame) -> DataFrame:
        consumed = self.folded.select(F.col("r").alias("term")).distinct()
        merged_away = self.canon.where("term <> rep").select("term")
        nodes = self.nodes.join(consumed, "term", "left_anti").join(merged_away, "term", "left_anti").select("term", "term_kind", "element_type")
        # an anonymous class whose operands belong to a named class above it is not drawn
        lifted = self.of(RDFS + "subClassOf").where("s_kind = 'I' AND o_kind = 'B'").join(self.of(*OPERATORS).select(F.col("s").alias("o")).distinct(), "o", "left_semi").select(F.col("o").alias("term")).distinct()
        nodes = nodes.join(lifted, "term", "left_anti")
        ops = self.moved(self.sets.select(F.col("owner").alias("term"), "node"), "term").groupBy("term").agg(F.min("node").alias("node"))
        same = self.canon.groupBy(F.col("rep").alias("term")).agg(F.max("named").alias("named"))
        nodes = nodes.join(ops, "term", "left").join(same, "term", "left")
        kind = (
            F.when(F.col("element_type").isin("owl:DeprecatedClass", "owl:ExternalClass"), F.col("element_type"))
            .when(F.coalesce("named", F.lit(0)) > 1, "owl:EquivalentClass")
            .when(F.col("node").isNotNull() & F.col("element_type").isin("owl:Class", "owl:AnonymousClass"), F.col("node"))
            .otherwise(F.col("element_type"))
        )
        nodes = nodes.select("term", "term_kind", kind.alias("element_type"))
        # ends that nothing typed: made ones, members, values, reserved, external and anonymous ones
        ends = edges.select(F.explode(F.array("domain", "range")).alias("term")).distinct().join(nodes.select("term"), "term", "left_anti")
        blanks = self.q.where("s_kind = 'B'").select(F.col("s").alias("term")).distinct().withColumn("_b", F.lit(True))
        members = self.member_nodes.select(F.col("member").alias("term"), F.col("k").alias("_k"))
        values = self.folded.where("value IS NOT NULL").select(F.col("range").alias("term"), F.col("is_data").alias("_data"), "value", "value_kind").dropDuplicates(["term"])
        ends = ends.join(blanks, "term", "left").join(members, "term", "left").join(values, "term", "left")
        t = F.col("term")
        made = F.when(t.rlike("(_literal|_localliteral)$"), "rdfs:Literal").when(t.rlike("_value$"), "rdfs:Literal").when(t.rlike("(_thing|_localthing)$"), "owl:Thing")
        late = F.coalesce(
            F.when(terms.is_synthetic(t), made), F.when(F.col("_k").isNotNull(), "rdfs:Resource"), F.when(F.col("value").isNotNull(), F.when(F.col("_data"), "rdfs:Datatype").otherwise("rdfs:Resource")),
            terms.reserved_type(t), F.when(F.col("_b"), "owl:AnonymousClass"), F.when(terms.is_external(F.lit("I"), t, F.lit(self.base).cast("string")), "owl:ExternalClass"), F.lit(UNRESOLVED),
        )
        ends = ends.select("term", F.when(F.col("_b"), "B").otherwise("I").alias("term_kind"), late.alias("element_type"))
        nodes = nodes.unionByName(ends)
        # a node that was made for an end and has no edge is not drawn; neither are datatypes and things of the languages without one
        used = edges.select(F.explode(F.array("domain", "range")).alias("term")).distinct().withColumn("_used", F.lit(True))
        nodes = nodes.join(used, "term", "left").where("_used OR NOT element_type IN ('owl:Thing') OR NOT term RLIKE '_(thing|localthing)$'").drop("_used")
        literal = self.member_nodes.where("k = 'L'").select(F.col("member").alias("term"), F.col("label").alias("_text")).unionByName(self.folded.where("value_kind = 'L'").select(F.col("range").alias("term"), F.col("value").alias("_text"))).groupBy("term").agg(F.max("_text").alias("_text"))
        named = self.named(nodes, "term").join(self.merged_labels, "term", "left").join(literal, "term", "left")
        plain = F.when(terms.is_synthetic(F.col("term")), F.when(F.col("element_type") == "owl:Thing", "Thing").otherwise("Literal")).when(F.col("term_kind") == "B", _null()).otherwise(F.col("label"))
        named = named.withColumn("label", F.coalesce("merged", "_text", plain)).drop("merged", "_text")
        return cut_some(named.join(self._individuals(), "term", "left").select("term", "term_kind", "element_type", "label", F.coalesce("individuals", F.lit(0)).cast("long").alias("individuals")))

    def _individuals(self) -> DataFrame:
        """Distinct individuals of each class, after merging; members of an enumeration count for it."""
        typed = self.q.where((F.col("p") == V.TYPE) & (F.col("o_kind") == "I") & (F.col("s_kind") == "I") & (F.col("o") != OWL + "NamedIndividual"))
        rows = typed.select(F.col("o").alias("cls"), F.col("s").alias("one")).unionByName(self.members)
        return self.moved(rows, "cls").groupBy(F.col("cls").alias("term")).agg(F.countDistinct("one").alias("individuals"))

    def _metadata(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Values of description properties by term, property and language; and the ontology's own as one row."""
        kept = [RDFS + x for x in ("comment", "isDefinedBy", "seeAlso", "label")] + [OWL + x for x in ("versionInfo", "versionIRI", "priorVersion", "incompatibleWith", "backwardCompatibleWith")] + [ns + n for ns in (DC, DCTERMS) for n in V.DC_NAMES]
        rows = cut_some(self.of(*kept).select(F.col("s").alias("term"), F.col("p").alias("prop"), F.coalesce("o_lang", F.lit("None")).alias("lang"), F.col("o").alias("value")).distinct())
        said = self.moved(rows.where(F.col("prop") != RDFS + "label"), "term")
        of_nodes = said.join(nodes.select("term"), "term", "left_semi")
        self.homeless = said.join(nodes.select("term"), "term", "left_anti").select("term", "prop").distinct()
        own = rows.where(F.col("term") == F.lit(self.base).cast("string"))
        present = {r["prop"] for r in rows.select("prop").distinct().collect()}  # at most as many as are looked for

        def first(*props: str):
            p = next((p for p in props if p in present), None)
            return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("prop") == p, F.struct("lang", "values"))))) if p else F.lit(None).cast("map<string,array<string>>")

        def single(*props: str):
            p = next((p for p in props if p in present), None)
            return F.min(F.when(F.col("prop") == p, F.array_min("values"))) if p else _null()

        by = own.groupBy("prop", "lang").agg(F.array_sort(F.collect_set("value")).alias("values"))
        header = by.agg(
            first(DCTERMS + "title", DC + "title", RDFS + "label").alias("title"), first(DCTERMS + "description", DC + "description", RDFS + "comment").alias("description"),
            first(DCTERMS + "creator", DC + "creator").alias("creator"), first(DCTERMS + "contributor", DC + "contributor").alias("contributor"),
            single(OWL + "versionInfo", OWL + "versionIRI").alias("version"), single(OWL + "priorVersion").alias("prior_version"),
            single(OWL + "incompatibleWith").alias("incompatible_with"), single(OWL + "backwardCompatibleWith").alias("backward_compatible_with"),
        )
        languages = self.of(RDFS + "label").agg(F.array_sort(F.collect_set(F.coalesce("o_lang", F.lit("None")))).alias("languages"))
        header = header.crossJoin(languages).select(F.lit(self.base).cast("string").alias("document_base"), "*")  # one row each
        return of_nodes.select("term", "prop", "lang", "value"), header

    def _annotations(self) -> DataFrame:
        """Annotated axioms: source, property, target, and what is said about them."""
        axioms = self.typed(OWL + "Axiom").select(F.col("s").alias("axiom"))
        rows = self.q.join(axioms, F.col("s") == F.col("axiom"), "left_semi")
        part = lambda n: F.max(F.when(F.col("p") == OWL + n, F.col("o")))
        other = ~F.col("p").isin(V.TYPE, *[OWL + x for x in ("annotatedSource", "annotatedProperty", "annotatedTarget")])
        said = F.map_from_entries(F.array_sort(F.collect_list(F.when(other, F.struct("p", "v")))))
        by = rows.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), "\n").alias("v"), F.max("o").alias("o"))
        return by.groupBy("s").agg(part("annotatedSource").alias("source"), part("annotatedProperty").alias("property"), part("annotatedTarget").alias("target"), said.alias("annotations")).drop("s")

    def _diagnostics(self) -> DataFrame:
        note = lambda df, severity, message: df.select(F.current_timestamp().cast("string").alias("timestamp"), F.lit(severity).alias("severity"), F.lit("Assembly").alias("error_type"), message.alias("message"))
        iri = lambda c: terms.display_term(F.lit("I"), F.col(c))
        lonely = self.restricted.join(self.folded.select(F.col("r").alias("a")), "a", "left_anti")
        out = note(lonely, "Critical", F.format_string("restriction %s has no owner or says nothing", "a"))
        edge = terms.display_triple(iri("domain"), F.coalesce(F.when(F.col("property").isNotNull(), iri("property")), "edge_type"), iri("range"))
        out = out.unionByName(note(self.lost, "Critical", F.concat(edge, F.lit(": unresolved reference: "), iri("end"))))
        typed = self.typed(*V.PROPERTY_TYPES)
        triple = terms.display_triple(terms.display_term(F.col("s_kind"), F.col("s")), iri("p"), iri("o"))
        out = out.unionByName(note(typed.where("s_kind = 'B'"), "Critical", F.concat(triple, F.lit(": a blank node is no property"))))
        out = out.unionByName(note(typed.where(F.col("s").isin(*NO_PROPERTIES)), "Critical", F.concat(triple, F.lit(": a term of the language can't be drawn as a property"))))
        out = out.unionByName(note(self.homeless, "Warning", F.concat(iri("prop"), F.lit(" of "), iri("term"), F.lit(" is dropped: no node is drawn for it"))))
        out = out.unionByName(note(self.inverse.where("NOT fits"), "Warning", F.format_string("%s and %s are inverse, but their ends don't match", "p1", "p2")))
        out = out.unionByName(note(self.torn, "Warning", F.format_string("%s is its own inverse by way of others: statements of inverses contradict each other", "property")))
        more = self.typed(OWL + "Ontology").where((F.col("s_kind") == "I") & (F.col("s") != F.lit(self.base).cast("string")))
        out = out.unionByName(note(more, "Warning", F.format_string("a further ontology is ignored: %s", "s")))
        if self.base is None:
            out = out.unionByName(note(self.spark.range(1), "Warning", F.lit("no document base: nothing is external")))
        return out


def assemble(quads: DataFrame) -> Display:
    """The display graph of one graph's quads."""
    return Assembler(quads).run()


def elements(display: Display) -> tuple[DataFrame, DataFrame]:
    """What is drawn, numbered from 0: (id, term, element_type, label, individuals), nodes first and then an element for
    each edge, one for both directions of an inverse; and (domain, element, range) by these numbers."""
    nodes = numbered(display.nodes.select("term", "element_type", "label", "individuals"), "id", "term", "element_type")
    n = nodes.count()
    shared = F.when(F.col("edge_type") == "owl:InverseOf", F.concat_ws("\n", F.least("domain", "range"), F.greatest("domain", "range"), "label"))
    edges = display.edges.withColumn("one", F.coalesce(shared, F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in EDGE])))
    drawn = edges.groupBy("one").agg(F.min("property").alias("term"), F.first("edge_type").alias("element_type"), F.first("label").alias("label"))
    drawn = numbered(drawn, "id", "one").withColumn("id", F.col("id") + n)
    end = lambda c: nodes.select(F.col("term").alias(c), F.col("id").alias(f"{c}_id"))
    triples = edges.join(drawn.select("one", "id"), "one").join(end("domain"), "domain").join(end("range"), "range")
    both = nodes.unionByName(drawn.select("id", "term", "element_type", "label", F.lit(None).cast("long").alias("individuals")))
    return both, triples.select(F.col("domain_id").alias("domain"), F.col("id").alias("element"), F.col("range_id").alias("range"), "card_min", "card_max", "characteristics")


def to_json(display: Display) -> DataFrame:
    """One row: the numbered elements and triples of a display graph, as JSON. For drawing: the graph must fit one row."""
    drawn, triples = elements(display)
    nodes = drawn.agg(F.array_sort(F.collect_list(F.struct("id", "term", "element_type", "label", "individuals"))).alias("elements"))
    edges = triples.agg(F.array_sort(F.collect_list(F.struct("element", "domain", "range", "card_min", "card_max", "characteristics"))).alias("triples"))
    whole = nodes.crossJoin(edges).crossJoin(display.header)  # one row each
    return whole.select(F.to_json(F.struct("elements", "triples", "document_base", "title", "description", "languages")).alias("graph"))
