"""Namespaces, the vocabulary the engine knows, and prefixes."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
XML = "http://www.w3.org/XML/1998/namespace"
DC = "http://purl.org/dc/elements/1.1/"
DCTERMS = "http://purl.org/dc/terms/"

PREFIXES = {"owl": OWL, "rdfs": RDFS, "rdf": RDF, "xsd": XSD, "xml": XML, "dc": DC, "dcterms": DCTERMS}

TYPE = RDF + "type"
NIL, FIRST, REST = RDF + "nil", RDF + "first", RDF + "rest"

# The names of the Dublin Core elements, of the XML Schema datatypes and of the
# property characteristics that the queries look for.
DC_NAMES = (
    "contributor", "coverage", "creator", "date", "description", "format", "identifier", "language",
    "publisher", "relation", "rights", "source", "subject", "title", "type",
)
XSD_NAMES = (
    "int", "integer", "negativeInteger", "nonNegativeInteger", "nonPositiveInteger", "positiveInteger",
    "unsignedInt", "unsignedLong", "unsignedShort", "decimal", "float", "double", "short", "long", "date",
    "dateTime", "dateTimeStamp", "duration", "gDay", "gMonth", "gMonthDay", "gYear", "gYearMonth", "time",
    "anyURI", "ID", "IDREF", "language", "NMTOKEN", "Name", "NCName", "QName", "string", "token",
    "normalizedString", "NOTATION", "anySimpleType", "base64Binary", "boolean", "ENTITY", "unsignedByte",
    "byte", "hexBinary",
)
CHARACTERISTICS = (
    "TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty", "ReflexiveProperty",
    "IrreflexiveProperty", "SymmetricProperty", "AsymmetricProperty",
)
# The types that make a term a property.
PROPERTY_TYPES = (
    OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "DeprecatedProperty", RDF + "Property", *(OWL + x for x in CHARACTERISTICS),
)
# The predicates that a restriction is made of.
RESTRICTION_PREDICATES = tuple(
    OWL + x
    for x in (
        "onProperty", "onClass", "onDataRange", "someValuesFrom", "allValuesFrom", "hasValue", "hasSelf", "cardinality",
        "minCardinality", "maxCardinality", "qualifiedCardinality", "minQualifiedCardinality", "maxQualifiedCardinality",
    )
)
# Datatypes that become nodes of type rdfs:Datatype.
DATATYPES = (
    RDF + "XMLLiteral", RDF + "HTML", RDF + "PlainLiteral", OWL + "real", OWL + "rational",
    *(
        XSD + x
        for x in (
            "anyURI", "base64Binary", "boolean", "byte", "date", "dateTime", "dateTimeStamp", "dayTimeDuration", "decimal",
            "double", "duration", "float", "gDay", "gMonth", "gMonthDay", "gYear", "gYearMonth", "hexBinary", "int", "integer",
            "language", "long", "Name", "NCName", "negativeInteger", "NMTOKEN", "nonNegativeInteger", "nonPositiveInteger",
            "normalizedString", "positiveInteger", "short", "string", "time", "token", "unsignedByte", "unsignedInt",
            "unsignedLong", "unsignedShort", "yearMonthDuration",
        )
    ),
)
# Terms of the languages themselves, which are never external.
RESERVED = (
    *DATATYPES, OWL + "Thing",
    *(RDFS + x for x in ("domain", "Literal", "range", "Resource", "subClassOf", "subPropertyOf")),
    *(
        OWL + x
        for x in (
            "AllDisjointClasses", "AllDisjointProperties", "complementOf", "datatypeComplementOf", "deprecated", "DeprecatedClass",
            "DeprecatedProperty", "differentFrom", "disjointUnionOf", "disjointWith", "equivalentClass", "equivalentProperty",
            "intersectionOf", "unionOf",
        )
    ),
)
NUMERIC = tuple(XSD + x for x in XSD_NAMES if x in ("int", "integer", "negativeInteger", "nonNegativeInteger", "nonPositiveInteger", "positiveInteger", "unsignedInt", "unsignedLong", "unsignedShort", "decimal", "float", "double", "short", "long", "unsignedByte", "byte"))


def short(iri: str) -> str:
    """An IRI by a known prefix, if there is one."""
    for p, ns in PREFIXES.items():
        if iri.startswith(ns):
            return f"{p}:{iri[len(ns):]}"
    return iri


def full(name: str) -> str:
    prefix, _, local = name.partition(":")
    return PREFIXES[prefix] + local
