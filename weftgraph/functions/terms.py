"""Scalar functions on terms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions import vocabulary as V

#: Ends of the IRIs of nodes that stand in for an end that a property lacks.
SUFFIXES = ("_literal", "_localliteral", "_localthing", "_thing", "_value")


def iri_label(iri: Column) -> Column:
    """The fragment of an IRI, else what follows its last slash; null if both are empty."""
    fragment = F.nullif(F.regexp_extract(iri, "#(.*)$", 1), F.lit(""))
    tail = F.nullif(F.regexp_extract(iri, "/([^/#]*)(?:#.*)?$", 1), F.lit(""))
    return F.coalesce(fragment, tail)


def trim_circumfix(text: Column) -> Column:
    """Text without the angle brackets around it."""
    return F.regexp_replace(F.regexp_replace(text, "^<+", ""), ">+$", "")


def synthetic(base: Column, suffix: str) -> Column:
    return F.concat(base, F.lit(suffix))


def is_synthetic(term: Column) -> Column:
    return term.rlike("(" + "|".join(SUFFIXES) + ")$")


def is_reserved(term: Column) -> Column:
    """Whether a term belongs to the languages themselves."""
    return term.isin(*V.RESERVED)


def reserved_type(term: Column) -> Column:
    """The node type that a reserved term has of itself: Thing, or Datatype for every datatype; others have none."""
    return F.when(term == V.OWL + "Thing", F.lit("owl:Thing")).when(term.isin(*V.DATATYPES), F.lit("rdfs:Datatype"))


def in_base(base: Column, iri: Column) -> Column:
    """Whether an IRI lies under a document's base: the base itself, a fragment of it, or below a base that ends a path."""
    ends = base.endswith("/") | base.endswith("#")
    return (iri == base) | iri.startswith(F.concat(base, F.lit("#"))) | (ends & iri.startswith(base))


def is_external(kind: Column, iri: Column, base: Column) -> Column:
    """A named term outside the base that is neither reserved nor synthetic; without a base nothing is external."""
    out = (kind == "I") & ~in_base(base, iri) & ~is_reserved(iri) & ~is_synthetic(iri)
    return F.coalesce(out, F.lit(False))


def numeric_cardinality(low: Column, high: Column) -> Column:
    digits = lambda c: F.coalesce(c, F.lit("")).rlike("^[0-9]*$")
    return digits(low) & digits(high)


def language_name(lang: Column) -> Column:
    return F.coalesce(lang, F.lit("None"))


def graph_name(name: Column, user: Column | None = None, app: str = "weftgraph") -> Column:
    """The IRI of a file's graph: blanks become underscores, brackets go."""
    clean = F.translate(F.regexp_replace(name, " ", "_"), "()[]", "")
    parts = [F.lit(f"urn:{app}:"), *([F.lit("user:"), user, F.lit(":")] if user is not None else []), F.lit("graph:"), clean]
    return F.concat(*parts)


#: The type a literal's value gets, by the local name of its datatype; others stay text.
SPARK_TYPES = (
    {"boolean": "boolean", "byte": "byte", "short": "short", "int": "int", "long": "long", "float": "float", "double": "double", "decimal": "decimal(38,18)"}
    | dict.fromkeys(("integer", "negativeInteger", "nonNegativeInteger", "nonPositiveInteger", "positiveInteger"), "decimal(38,0)")
    | {"unsignedByte": "short", "unsignedShort": "int", "unsignedInt": "long", "unsignedLong": "decimal(20,0)", "date": "date", "dateTime": "timestamp", "dateTimeStamp": "timestamp"}
)
#: Signs that a whole number's datatype allows.
SIGNS = {"negativeInteger": (None, -1), "nonNegativeInteger": (0, None), "nonPositiveInteger": (None, 0), "positiveInteger": (1, None), "unsignedByte": (0, 255), "unsignedShort": (0, 65535), "unsignedInt": (0, (1 << 32) - 1), "unsignedLong": (0, (1 << 64) - 1)}


def typed_value(lexical: Column, datatype: str) -> Column:
    """A literal's value with the type of its datatype; null if the text isn't one of its forms."""
    local = datatype.removeprefix(V.XSD) if datatype.startswith(V.XSD) else ""
    if local in ("hexBinary", "base64Binary"):
        return F.try_to_binary(lexical, F.lit("hex" if local == "hexBinary" else "base64"))
    if datatype == V.OWL + "real":
        return lexical.try_cast("double")
    if local not in SPARK_TYPES:
        return lexical
    if local == "boolean":
        return F.when(lexical.isin("true", "1"), True).when(lexical.isin("false", "0"), False)
    value = lexical.try_cast(SPARK_TYPES[local])
    low, high = SIGNS.get(local, (None, None))
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= F.lit(low).cast("decimal(38,0)"))
    if high is not None:
        ok = ok & (value <= F.lit(high).cast("decimal(38,0)"))
    return F.when(ok, value)


def literal_only(kind: Column, text: Column) -> Column:
    """The text of a literal; of any other term null, to be reported."""
    return F.when(kind == "L", text)


def is_truthy(text: Column) -> Column:
    return text == "true"


def term_of(text: Column) -> Column:
    """kind and text of a name: an IRI if it has a scheme, else a blank node."""
    return F.struct(F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "I").otherwise("B").alias("kind"), text.alias("text"))


def display_term(kind: Column, text: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    """A term as diagnostics show it, as N-Triples writes it; nothing for none."""
    none = F.lit(None).cast("string")
    tail = F.coalesce(F.concat(F.lit("@"), none if lang is None else lang), F.concat(F.lit("^^<"), F.nullif(none if datatype is None else datatype, F.lit(V.XSD + "string")), F.lit(">")), F.lit(""))
    literal = F.concat(F.lit('"'), text, F.lit('"'), tail)
    return F.coalesce(F.when(kind == "I", F.concat(F.lit("<"), text, F.lit(">"))).when(kind == "B", F.concat(F.lit("_:"), text)).otherwise(literal), F.lit(""))


def display_triple(subject: Column, predicate: Column, object_: Column) -> Column:
    """Fixed format: a triple of displayed terms."""
    return F.format_string("Triple{ %s - %s - %s }", subject, predicate, object_)


def display_edge(domain: Column, edge_type: Column, range_: Column) -> Column:
    """Fixed format: an edge of displayed terms."""
    return F.format_string("Edge{ %s - %s - %s }", domain, edge_type, range_)
