"""File types: extensions, MIME types and which parser reads what."""

from __future__ import annotations

# The types, their extensions and MIME types.
TYPES = {
    "owl": ("owl", "application/rdf+xml"),
    "ofn": ("ofn", "text/ofn"),
    "owx": ("owx", "application/owl+xml"),
    "ttl": ("ttl", "text/turtle"),
    "rdf": ("rdf", "application/rdf+xml"),
    "ntriples": ("nt", "application/n-triples"),
    "nquads": ("nq", "application/n-quads"),
    "trig": ("trig", "application/trig"),
    "jsonld": ("jsonld", "application/ld+json"),
    "n3": ("n3", "text/n3"),
    "sparql_json": ("srj", "application/sparql-results+json"),
    "sparql_xml": ("srx", "application/sparql-results+xml"),
    "sparql_csv": ("src", "text/csv"),
    "sparql_tsv": ("tsv", "text/tab-separated-values"),
}
#: Further extensions that name a type of query results.
RESULTS = {"json": "sparql_json", "xml": "sparql_xml", "csv": "sparql_csv", "tsv": "sparql_tsv"}
BY_EXTENSION = {e: t for t, (e, _) in TYPES.items()} | RESULTS
GRAPHS = tuple(t for t in TYPES if not t.startswith("sparql"))
#: What can be exported.
EXPORTS = GRAPHS


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1] if "." in name else ""


def type_of(path: str) -> str:
    """The type that a name's extension tells, whatever its case; "unknown" if none."""
    return BY_EXTENSION.get(extension(path).lower(), "unknown")


def strict_type_of(path: str) -> str | None:
    """The type by an extension in small letters, of graphs only: what reading a path without fallback takes."""
    found = {e: t for t, (e, _) in TYPES.items() if t in GRAPHS}.get(extension(path))
    return found


def mime_type(kind: str) -> str:
    return TYPES[kind][1]
