"""OWL's functional and XML syntaxes: read into one tree of axioms, which is mapped to triples, and written from triples.

A tree node is (name, children); leaves are terms (kind, text, datatype, language).
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape as xml_escape

from weftgraph.functions.vocabulary import FIRST, NIL, OWL, PREFIXES, RDF, RDFS, REST, TYPE, XML, XSD
from weftgraph.plans.sparql import unescape
from weftgraph.sources.rdfxml import _entities
from weftgraph.sources.turtle import LANG_STRING, STRING, ParseError, escape

SWRL = "http://www.w3.org/2003/11/swrl#"

# ---- functional syntax
TOKEN = re.compile(
    r"""(?P<space>(?:\s|\#[^\n]*)+)|(?P<iri><[^<>"\s]*>)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:[\w.-]+)|(?P<num>\d+(?![\w:]))|(?P<pname>[\w.-]*:[\w.\-%/]*)|(?P<word>[A-Za-z]\w*)|(?P<op>\^\^|[()=])""",
    re.VERBOSE | re.DOTALL,
)


class Functional:
    def __init__(self, text: str, label: str):
        self.label, self.at, self.prefixes = label, 0, dict(PREFIXES)
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected text at {at}: {text[at:at + 30]!r}")
            at = m.end()
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
        self.tokens.append(("end", ""))

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[min(self.at - 1, len(self.tokens) - 1)]

    def need(self, token: str) -> None:
        if self.next()[1] != token:
            raise ParseError(f"expected {token!r} before token {self.at}")

    def document(self) -> tuple:
        while self.tokens[self.at][1] == "Prefix":
            self.next()
            self.need("(")
            name = self.next()[1]
            self.need("=")
            self.prefixes[name.rstrip(":")] = self.next()[1][1:-1]
            self.need(")")
        if self.tokens[self.at][1] != "Ontology":
            raise ParseError("no Ontology")
        out = self.node()
        if self.tokens[self.at][0] != "end":
            raise ParseError("text after the ontology")
        return out

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            return text[1:-1]
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise ParseError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + local

    def node(self):
        kind, text = self.next()
        if kind == "word":
            self.need("(")
            children = []
            while self.tokens[self.at][1] != ")":
                if self.tokens[self.at][0] == "end":
                    raise ParseError("the text ends in an axiom")
                children.append(self.node())
            self.next()
            return text, children
        if kind in ("iri", "pname"):
            return "I", self.iri(kind, text), None, None
        if kind == "blank":
            return "B", f"{self.label}#{text[2:]}", None, None
        if kind == "num":
            return "L", text, XSD + "nonNegativeInteger", None
        if kind == "op" and text == "(":  # a group without a name, as in HasKey
            children = []
            while self.tokens[self.at][1] != ")":
                children.append(self.node())
            self.next()
            return "", children
        if kind == "str":
            body = unescape(text[1:-1])
            if self.tokens[self.at][0] == "lang":
                return "L", body, LANG_STRING, self.next()[1][1:].lower()
            if self.tokens[self.at][1] == "^^":
                self.next()
                return "L", body, self.iri(*self.next()), None
            return "L", body, STRING, None
        raise ParseError(f"unexpected {text!r}")


# ---- XML syntax
ENTITIES = ("Class", "Datatype", "ObjectProperty", "DataProperty", "AnnotationProperty", "NamedIndividual")


def xml_tree(text: str, label: str) -> tuple:
    try:
        root = ET.fromstring(_entities(text))
    except ET.ParseError as e:
        raise ParseError(str(e)) from e
    if root.tag != f"{{{OWL}}}Ontology":
        raise ParseError("no OWL ontology")
    prefixes = dict(PREFIXES) | {x.get("name"): x.get("IRI") for x in root if x.tag.endswith("}Prefix")}
    base = root.get(f"{{{XML}}}base") or root.get("ontologyIRI") or ""

    def named(v: str) -> str:
        p, _, local = v.partition(":")
        if p not in prefixes:
            raise ParseError(f"unknown prefix {p!r}")
        return prefixes[p] + local

    def iri(x) -> str | None:
        if (v := x.get("IRI")) is not None:
            return v if ":" in v else base.rstrip("#") + v if v.startswith("#") else base + v
        if (v := x.get("abbreviatedIRI")) is not None:
            return named(v)
        return None

    def node(x):
        name = x.tag.partition("}")[2]
        if name == "Literal":
            lang, dt = x.get(f"{{{XML}}}lang"), x.get("datatypeIRI")
            return ("L", x.text or "", LANG_STRING, lang.lower()) if lang else ("L", x.text or "", dt or STRING, None)
        if name in ("IRI", "AbbreviatedIRI"):
            v = (x.text or "").strip()
            if name == "AbbreviatedIRI":
                return "I", named(v), None, None
            return "I", v if ":" in v else base.rstrip("#") + v if v.startswith("#") else base + v, None, None
        if name == "AnonymousIndividual":
            return "B", f"{label}#{(x.get('nodeID') or '')[2:]}", None, None
        if (v := iri(x)) is not None:
            return "I", v, None, None
        children = []
        if x.get("cardinality") is not None:
            children.append(("L", x.get("cardinality"), XSD + "nonNegativeInteger", None))
        if name == "FacetRestriction":
            return [("I", x.get("facet"), None, None), *map(node, x)]
        for c in x:
            v = node(c)
            children += v if isinstance(v, list) else [v]
        return name, children

    children: list = [("I", root.get(k), None, None) for k in ("ontologyIRI", "versionIRI") if root.get(k)]
    for x in root:
        name = x.tag.partition("}")[2]
        if name == "Prefix":
            continue
        if name == "Declaration":
            notes = [node(c) for c in x if c.tag.endswith("}Annotation")]
            entity = next((c for c in x if not c.tag.endswith("}Annotation")), None)
            if entity is None or iri(entity) is None:
                raise ParseError("a declaration of nothing")
            children.append(("Declaration", [*notes, (entity.tag.partition("}")[2], [("I", iri(entity), None, None)])]))
        elif name == "Import":
            children.append(("Import", [("I", (x.text or "").strip(), None, None)]))
        else:
            children.append(node(x))
    return "Ontology", children


# ---- axioms to triples
# What the words of the syntaxes stand for.
DECLARED = {
    "Class": OWL + "Class", "Datatype": RDFS + "Datatype", "ObjectProperty": OWL + "ObjectProperty", "DataProperty": OWL + "DatatypeProperty",
    "AnnotationProperty": OWL + "AnnotationProperty", "NamedIndividual": OWL + "NamedIndividual",
}
PAIRS = {
    "SubClassOf": RDFS + "subClassOf", "SubDataPropertyOf": RDFS + "subPropertyOf", "SubAnnotationPropertyOf": RDFS + "subPropertyOf",
    "ObjectPropertyDomain": RDFS + "domain", "DataPropertyDomain": RDFS + "domain", "AnnotationPropertyDomain": RDFS + "domain",
    "ObjectPropertyRange": RDFS + "range", "DataPropertyRange": RDFS + "range", "AnnotationPropertyRange": RDFS + "range",
    "InverseObjectProperties": OWL + "inverseOf", "DatatypeDefinition": OWL + "equivalentClass",
}
CHAINS = {"EquivalentClasses": OWL + "equivalentClass", "EquivalentObjectProperties": OWL + "equivalentProperty", "EquivalentDataProperties": OWL + "equivalentProperty", "SameIndividual": OWL + "sameAs"}
DISJOINT = {
    "DisjointClasses": (OWL + "disjointWith", OWL + "AllDisjointClasses", OWL + "members"),
    "DisjointObjectProperties": (OWL + "propertyDisjointWith", OWL + "AllDisjointProperties", OWL + "members"),
    "DisjointDataProperties": (OWL + "propertyDisjointWith", OWL + "AllDisjointProperties", OWL + "members"),
    "DifferentIndividuals": (OWL + "differentFrom", OWL + "AllDifferent", OWL + "distinctMembers"),
}
TRAITS = {
    "FunctionalObjectProperty": "FunctionalProperty", "FunctionalDataProperty": "FunctionalProperty", "InverseFunctionalObjectProperty": "InverseFunctionalProperty",
    "ReflexiveObjectProperty": "ReflexiveProperty", "IrreflexiveObjectProperty": "IrreflexiveProperty", "SymmetricObjectProperty": "SymmetricProperty",
    "AsymmetricObjectProperty": "AsymmetricProperty", "TransitiveObjectProperty": "TransitiveProperty",
}
SETS = {
    "ObjectIntersectionOf": "intersectionOf", "ObjectUnionOf": "unionOf", "ObjectOneOf": "oneOf", "DataIntersectionOf": "intersectionOf", "DataUnionOf": "unionOf", "DataOneOf": "oneOf",
}
FILLERS = {"SomeValuesFrom": "someValuesFrom", "AllValuesFrom": "allValuesFrom", "HasValue": "hasValue"}
BOUNDS = {"MinCardinality": ("minCardinality", "minQualifiedCardinality"), "MaxCardinality": ("maxCardinality", "maxQualifiedCardinality"), "ExactCardinality": ("cardinality", "qualifiedCardinality")}


class Axioms:
    """Axioms as triples, after the published mapping of OWL to RDF graphs."""

    def __init__(self, tree: tuple, graph: str, label: str):
        self.graph, self.label, self.blanks, self.out = graph, label, 0, []
        self.root(tree[1])

    def add(self, s, p: str, o) -> tuple:
        row = (self.graph, *s[:2], p, *o)
        self.out.append(row)
        return s, p, o

    def fresh(self) -> tuple:
        self.blanks += 1
        return "B", f"{self.label}#x{self.blanks}", None, None

    @staticmethod
    def iri(v: str) -> tuple:
        return "I", v, None, None

    def listed(self, items: list) -> tuple:
        head = self.iri(NIL)
        for x in reversed([self.expression(i) for i in items]):
            b = self.fresh()
            self.add(b, FIRST, x)
            self.add(b, REST, head)
            head = b
        return head

    def root(self, children: list) -> None:
        names = []
        while children and len(children[0]) == 4:
            names.append(children[0])
            children = children[1:]
        s = names[0] if names else self.fresh()
        self.add(s, TYPE, self.iri(OWL + "Ontology"))
        if len(names) > 1:
            self.add(s, OWL + "versionIRI", names[1])
        for name, args in children:
            if name == "Import":
                self.add(s, OWL + "imports", args[0])
            elif name == "Annotation":
                self.annotate(s, args)
            else:
                self.axiom(name, args)

    def annotate(self, s, args: list) -> None:
        inner = [a[1] for a in args if a[0] == "Annotation" and len(a) == 2]
        p, v = [a for a in args if not (a[0] == "Annotation" and len(a) == 2)]
        made = self.add(s, p[1], v)
        if inner:
            self.reify(made, inner)

    def reify(self, triple: tuple, annotations: list) -> None:
        s, p, o = triple
        x = self.fresh()
        self.add(x, TYPE, self.iri(OWL + "Axiom"))
        self.add(x, OWL + "annotatedSource", s)
        self.add(x, OWL + "annotatedProperty", self.iri(p))
        self.add(x, OWL + "annotatedTarget", o)
        for a in annotations:
            self.annotate(x, a)

    def axiom(self, name: str, args: list) -> None:
        annotations = [a[1] for a in args if len(a) == 2 and a[0] == "Annotation"]
        args = [a for a in args if not (len(a) == 2 and a[0] == "Annotation")]
        made: list = []
        if name == "Declaration":
            kind, (x,) = args[0]
            made = [self.add(x, TYPE, self.iri(DECLARED[kind]))]
        elif name in PAIRS:
            a, b = map(self.expression, args)
            made = [self.add(a, PAIRS[name], b)]
        elif name == "SubObjectPropertyOf":
            if len(args[0]) == 2 and args[0][0] in ("ObjectPropertyChain", "SubObjectPropertyChain"):
                made = [self.add(self.expression(args[1]), OWL + "propertyChainAxiom", self.listed(args[0][1]))]
            else:
                made = [self.add(self.expression(args[0]), RDFS + "subPropertyOf", self.expression(args[1]))]
        elif name in CHAINS:
            xs = [self.expression(a) for a in args]
            made = [self.add(a, CHAINS[name], b) for a, b in zip(xs, xs[1:], strict=False)]
        elif name in DISJOINT:
            pair, kind, members = DISJOINT[name]
            if len(args) == 2:
                made = [self.add(self.expression(args[0]), pair, self.expression(args[1]))]
            else:
                x = self.fresh()
                self.add(x, TYPE, self.iri(kind))
                self.add(x, members, self.listed(args))
                for a in annotations:
                    self.annotate(x, a)
        elif name == "DisjointUnion":
            made = [self.add(self.expression(args[0]), OWL + "disjointUnionOf", self.listed(args[1:]))]
        elif name in TRAITS:
            made = [self.add(self.expression(args[0]), TYPE, self.iri(OWL + TRAITS[name]))]
        elif name == "ClassAssertion":
            made = [self.add(args[1], TYPE, self.expression(args[0]))]
        elif name in ("ObjectPropertyAssertion", "DataPropertyAssertion"):
            p, s, o = args
            if len(p) == 2:  # an inverse: the other way round
                p, s, o = p[1][0], o, s
            made = [self.add(s, p[1], o)]
        elif name in ("NegativeObjectPropertyAssertion", "NegativeDataPropertyAssertion"):
            x = self.fresh()
            self.add(x, TYPE, self.iri(OWL + "NegativePropertyAssertion"))
            self.add(x, OWL + "sourceIndividual", args[1])
            self.add(x, OWL + "assertionProperty", self.expression(args[0]))
            self.add(x, OWL + ("targetIndividual" if "Object" in name else "targetValue"), args[2])
        elif name == "AnnotationAssertion":
            made = [self.add(args[1], args[0][1], args[2])]
        elif name == "HasKey":
            keys = [k for a in args[1:] for k in (a[1] if len(a) == 2 and a[0] == "" else [a])]
            made = [self.add(self.expression(args[0]), OWL + "hasKey", self.listed(keys))]
        elif name in ("DLSafeRule", "DGRule"):
            self.add(self.fresh(), TYPE, self.iri(SWRL + "Imp"))
        else:
            raise ParseError(f"unknown axiom {name}")
        if annotations:
            for m in made:
                self.reify(m, annotations)

    def expression(self, x) -> tuple:
        if len(x) == 4:
            return x
        name, args = x
        b = self.fresh()
        if name in ("ObjectInverseOf", "InverseObjectProperty"):
            self.add(b, OWL + "inverseOf", self.expression(args[0]))
            return b
        data = name.startswith("Data")
        short = name.removeprefix("Object").removeprefix("Data")
        if name in SETS:
            self.add(b, TYPE, self.iri(RDFS + "Datatype" if data else OWL + "Class"))
            self.add(b, OWL + SETS[name], self.listed(args))
        elif name == "ObjectComplementOf":
            self.add(b, TYPE, self.iri(OWL + "Class"))
            self.add(b, OWL + "complementOf", self.expression(args[0]))
        elif name == "DataComplementOf":
            self.add(b, TYPE, self.iri(RDFS + "Datatype"))
            self.add(b, OWL + "datatypeComplementOf", self.expression(args[0]))
        elif name == "DatatypeRestriction":
            self.add(b, TYPE, self.iri(RDFS + "Datatype"))
            self.add(b, OWL + "onDatatype", args[0])
            facets = []
            for f, v in zip(args[1::2], args[2::2], strict=True):
                y = self.fresh()
                self.add(y, f[1], v)
                facets.append(y)
            self.add(b, OWL + "withRestrictions", self.listed(facets))
        elif short in FILLERS:
            self.add(b, TYPE, self.iri(OWL + "Restriction"))
            self.add(b, OWL + "onProperty", self.expression(args[0]))
            self.add(b, OWL + FILLERS[short], self.expression(args[-1]))
        elif name == "ObjectHasSelf":
            self.add(b, TYPE, self.iri(OWL + "Restriction"))
            self.add(b, OWL + "onProperty", self.expression(args[0]))
            self.add(b, OWL + "hasSelf", ("L", "true", XSD + "boolean", None))
        elif short in BOUNDS:
            self.add(b, TYPE, self.iri(OWL + "Restriction"))
            self.add(b, OWL + "onProperty", self.expression(args[1]))
            self.add(b, OWL + BOUNDS[short][len(args) > 2], ("L", args[0][1], XSD + "nonNegativeInteger", None))
            if len(args) > 2:
                self.add(b, OWL + ("onDataRange" if data else "onClass"), self.expression(args[2]))
        else:
            raise ParseError(f"unknown expression {name}")
        return b


def read_functional(text: str, graph: str, base: str, label: str) -> list[tuple]:
    return Axioms(Functional(text, label).document(), graph, label).out


def read_owlxml(text: str, graph: str, base: str, label: str) -> list[tuple]:
    return Axioms(xml_tree(text, label), graph, label).out


# ---- triples to axioms
class Rebuild:
    """The axioms that the triples of a graph stand for, as a tree. What no axiom stands for becomes an assertion."""

    def __init__(self, rows: list[tuple]):
        self.by: dict = {}
        for _, sk, s, p, *o in sorted(rows, key=lambda r: tuple(x or "" for x in r)):
            self.by.setdefault((sk, s), []).append((p, tuple(o)))
        self.types = {k: {o[1] for p, o in v if p == TYPE} for k, v in self.by.items()}
        self.data = {k for k, t in self.types.items() if OWL + "DatatypeProperty" in t}
        self.notes = {k for k, t in self.types.items() if OWL + "AnnotationProperty" in t}
        self.axioms: list = []

    def one(self, node, p):
        return next((o for q, o in self.by.get(node[:2], []) if q == p), None)

    def items(self, node) -> list:
        out = []
        while node and node[1] != NIL:
            out.append(self.one(node, FIRST))
            node = self.one(node, REST)
        return out

    def kind(self, p) -> str:
        return "Data" if p[:2] in self.data else "Object"

    def expression(self, x):
        if x[0] != "B" or x[:2] not in self.by:
            return x
        data = RDFS + "Datatype" in self.types[x[:2]]
        side = "Data" if data else "Object"
        for p, o in self.by[x[:2]]:
            local = p.removeprefix(OWL)
            for name, q in SETS.items():
                if local == q and name.startswith(side):
                    return name, [self.expression(i) for i in self.items(o)]
            if local == "complementOf":
                return "ObjectComplementOf", [self.expression(o)]
            if local == "datatypeComplementOf":
                return "DataComplementOf", [self.expression(o)]
            if local == "inverseOf":
                return "ObjectInverseOf", [self.expression(o)]
            if local == "onDatatype":
                facets = [(q, v) for i in self.items(self.one(x, OWL + "withRestrictions")) for q, v in self.by[i[:2]]]
                return "DatatypeRestriction", [o, *[y for q, v in facets for y in (("I", q, None, None), v)]]
        prop = self.one(x, OWL + "onProperty")
        if prop is None:
            return x
        side = self.kind(prop)
        for name, q in FILLERS.items():
            if (o := self.one(x, OWL + q)) is not None:
                return side + name, [self.expression(prop), self.expression(o)]
        if self.one(x, OWL + "hasSelf") is not None:
            return "ObjectHasSelf", [self.expression(prop)]
        for name, qs in BOUNDS.items():
            for q in qs:
                if (o := self.one(x, OWL + q)) is not None:
                    on = self.one(x, OWL + "onClass") or self.one(x, OWL + "onDataRange")
                    return side + name, [("L", o[1], XSD + "nonNegativeInteger", None), self.expression(prop), *([self.expression(on)] if on else [])]
        return x

    def tree(self) -> tuple:
        ontology = next((("I", s, None, None) for (k, s), t in self.types.items() if OWL + "Ontology" in t and k == "I"), None)
        head: list = [ontology] if ontology else []
        if ontology and (v := self.one(ontology, OWL + "versionIRI")):
            head.append(v)
        declared = {v: k for k, v in DECLARED.items()}
        traits = {v: k for k, v in TRAITS.items() if "Data" not in k}
        for (sk, s), facts in self.by.items():
            node = (sk, s, None, None)
            t = self.types[sk, s]
            if OWL + "Ontology" in t:
                for p, o in facts:
                    if p == OWL + "imports":
                        self.axioms.append(("Import", [o]))
                    elif p not in (TYPE, OWL + "versionIRI"):
                        self.axioms.append(("Annotation", [("I", p, None, None), o]))
                continue
            if OWL + "Axiom" in t:
                continue
            for group, members in (("DisjointClasses", OWL + "AllDisjointClasses"), ("DisjointObjectProperties", OWL + "AllDisjointProperties"), ("DifferentIndividuals", OWL + "AllDifferent")):
                if members in t:
                    listed = self.one(node, OWL + "members") or self.one(node, OWL + "distinctMembers")
                    self.axioms.append((group, [self.expression(i) for i in self.items(listed)]))
            if OWL + "NegativePropertyAssertion" in t:
                p, v = self.one(node, OWL + "assertionProperty"), self.one(node, OWL + "targetIndividual")
                self.axioms.append(("NegativeObjectPropertyAssertion" if v else "NegativeDataPropertyAssertion", [p, self.one(node, OWL + "sourceIndividual"), v or self.one(node, OWL + "targetValue")]))
            if sk == "B" and t & {OWL + "Class", OWL + "Restriction", RDFS + "Datatype", OWL + "AllDisjointClasses", OWL + "AllDisjointProperties", OWL + "AllDifferent", OWL + "NegativePropertyAssertion"} or sk == "B" and not t:
                continue
            for p, o in facts:
                self.fact(node, p, o, declared, traits)
        return "Ontology", head + [a for a in self.axioms if a[0] in ("Import", "Annotation")] + [a for a in self.axioms if a[0] not in ("Import", "Annotation")]

    def fact(self, s, p, o, declared, traits) -> None:
        add = lambda name, *args: self.axioms.append((name, list(args)))
        prop = self.kind(s)
        note = s[:2] in self.notes
        if p == TYPE:
            if o[1] in declared and s[0] == "I":
                add("Declaration", (declared[o[1]], [s]))
            elif o[1] in traits and o[1].startswith(OWL):
                pass
            elif o[1].removeprefix(OWL) in TRAITS.values() and o[1].startswith(OWL):
                name = {v: k for k, v in TRAITS.items() if "Data" not in k}[o[1].removeprefix(OWL)]
                add("FunctionalDataProperty" if prop == "Data" and "Functional" in name else name, s)
            else:
                add("ClassAssertion", self.expression(o), s)
            return
        side = "Annotation" if note else prop
        e, f = (lambda: self.expression(s)), (lambda: self.expression(o))
        simple = {
            RDFS + "subClassOf": "SubClassOf", OWL + "equivalentClass": "DatatypeDefinition" if RDFS + "Datatype" in self.types[s[:2]] else "EquivalentClasses", OWL + "disjointWith": "DisjointClasses",
            RDFS + "subPropertyOf": f"Sub{side}PropertyOf", RDFS + "domain": f"{side}PropertyDomain", RDFS + "range": f"{side}PropertyRange", OWL + "inverseOf": "InverseObjectProperties",
            OWL + "equivalentProperty": f"Equivalent{prop}Properties", OWL + "propertyDisjointWith": f"Disjoint{prop}Properties", OWL + "sameAs": "SameIndividual", OWL + "differentFrom": "DifferentIndividuals",
        }
        if p in simple:
            add(simple[p], e(), f())
        elif p == OWL + "disjointUnionOf":
            add("DisjointUnion", s, *[self.expression(i) for i in self.items(o)])
        elif p == OWL + "propertyChainAxiom":
            add("SubObjectPropertyOf", ("ObjectPropertyChain", [self.expression(i) for i in self.items(o)]), s)
        elif p == OWL + "hasKey":
            keys = self.items(o)
            add("HasKey", self.expression(s), ("", [k for k in keys if k[:2] not in self.data]), ("", [k for k in keys if k[:2] in self.data]))
        elif p in (OWL + x for x in ("unionOf", "intersectionOf", "complementOf", "oneOf")):
            name = {"unionOf": "ObjectUnionOf", "intersectionOf": "ObjectIntersectionOf", "oneOf": "ObjectOneOf"}.get(p.removeprefix(OWL))
            add("EquivalentClasses", s, (name, [self.expression(i) for i in self.items(o)]) if name else ("ObjectComplementOf", [self.expression(o)]))
        elif ("I", p) in self.by and ("I", p) not in self.notes and not {OWL + "ObjectProperty", OWL + "DatatypeProperty"}.isdisjoint(self.types["I", p]):
            add("DataPropertyAssertion" if ("I", p) in self.data else "ObjectPropertyAssertion", ("I", p, None, None), s, o)
        else:
            add("AnnotationAssertion", ("I", p, None, None), s, o)


def _ident(b: str) -> str:
    return "b" + re.sub(r"[^A-Za-z0-9]", "_", b.rsplit("/", 1)[-1])


def write_functional(rows: list[tuple], prefixes: dict[str, str] | None = None) -> str:
    names = {ns: p for p, ns in (PREFIXES | (prefixes or {})).items()}

    def show(x) -> str:
        if len(x) == 2:
            return f"{x[0]}({' '.join(map(show, x[1]))})"
        kind, v, dt, lang = x
        if kind == "B":
            return "_:" + _ident(v)
        if kind == "I":
            for ns, p in names.items():
                if v.startswith(ns) and re.fullmatch(r"[A-Za-z_][\w-]*", v[len(ns):]):
                    return f"{p}:{v[len(ns):]}"
            return f"<{v}>"
        if dt == XSD + "nonNegativeInteger" and v.isdigit():
            return v
        tail = f"@{lang}" if lang else "" if dt in (None, STRING) else "^^" + show(("I", dt, None, None))
        return '"' + escape(v) + '"' + tail

    name, children = Rebuild(rows).tree()
    head = "\n".join(f"Prefix({p}:=<{ns}>)" for ns, p in names.items())
    iris = " ".join(show(c) for c in children if len(c) == 4)
    return f"{head}\n\n{name}({iris}\n" + "\n".join(show(c) for c in children if len(c) == 2) + "\n)\n"


def write_owlxml(rows: list[tuple], prefixes: dict[str, str] | None = None) -> str:
    q = lambda t: '"' + xml_escape(t, {'"': "&quot;"}) + '"'
    built = Rebuild(rows)
    name, children = built.tree()
    kinds = {k: next((d for d, v in DECLARED.items() if v in t), "") for k, t in built.types.items()}

    def show(x, where: str, place: int, depth: int) -> str:
        pad = "    " * depth
        if len(x) == 2:
            if x[0] == "":
                return "".join(show(c, where, 1, depth) for c in x[1])
            if x[0] == "Declaration":
                kind, (e,) = x[1][0]
                return f"{pad}<Declaration>\n{pad}    <{kind} IRI={q(e[1])}/>\n{pad}</Declaration>\n"
            args, extra = x[1], ""
            if x[0].endswith("Cardinality"):
                extra, args = f" cardinality={q(args[0][1])}", args[1:]
            if x[0] == "Import":
                return f"{pad}<Import>{xml_escape(args[0][1])}</Import>\n"
            if x[0] == "DatatypeRestriction":
                inner = show(args[0], "range", 0, depth + 1)
                for f, v in zip(args[1::2], args[2::2], strict=True):
                    inner += f"{pad}    <FacetRestriction facet={q(f[1])}>\n{show(v, '', 0, depth + 2)}{pad}    </FacetRestriction>\n"
            else:
                inner = "".join(show(c, x[0], i, depth + 1) for i, c in enumerate(args))
            return f"{pad}<{x[0]}{extra}>\n{inner}{pad}</{x[0]}>\n"
        kind, v, dt, lang = x
        if kind == "L":
            extra = f" xml:lang={q(lang)}" if lang else "" if dt in (None, STRING) else f" datatypeIRI={q(dt)}"
            return f"{pad}<Literal{extra}>{xml_escape(v)}</Literal>\n"
        if kind == "B":
            return f"{pad}<AnonymousIndividual nodeID={q('_:' + _ident(v))}/>\n"
        if where in ("Annotation", "AnnotationAssertion"):
            return f"{pad}<AnnotationProperty IRI={q(v)}/>\n" if place == 0 else f"{pad}<IRI>{xml_escape(v)}</IRI>\n"
        guess = kinds.get((kind, v)) or ("Datatype" if v.startswith((XSD, RDFS + "Literal", RDF)) else "")
        if not guess:
            guess = "NamedIndividual" if "Assertion" in where and place or where in ("SameIndividual", "DifferentIndividuals", "ObjectOneOf", "ObjectHasValue") and (place or "Has" not in where) else "DataProperty" if where.startswith("Data") and place == 0 else "ObjectProperty" if "Propert" in where or where[:6] == "Object" and place == 0 and where not in SETS and where != "ObjectComplementOf" else "Class"
        return f"{pad}<{guess} IRI={q(v)}/>\n"

    iris = [c for c in children if len(c) == 4]
    extra = "".join(f" {k}={q(c[1])}" for k, c in zip(("ontologyIRI", "versionIRI"), iris, strict=False))
    body = "".join(show(c, "", 0, 1) for c in children if len(c) == 2)
    return f'<?xml version="1.0"?>\n<{name} xmlns="{OWL}"{extra}>\n{body}</{name}>\n'
