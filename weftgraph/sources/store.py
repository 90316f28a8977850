"""Reading graph documents into quads, named graphs, import closure, uploads and export.

Line formats (N-Triples, N-Quads) are read by Spark's text reader, which splits large
files over tasks. Documents of the other syntaxes can't be split: each is one row of a
binary-file scan, parsed by one task.
"""

from __future__ import annotations

import hashlib
import re
import urllib.request
import uuid
from datetime import datetime, timezone
from functools import reduce
from operator import and_
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.vocabulary import OWL, PREFIXES
from weftgraph.plans.sparql import unescape
from weftgraph.sources import formats, owl, rdfxml, turtle
from weftgraph.sources.pieces import read_turtle_pieces, write_turtle_pieces
from weftgraph.sources.turtle import QUAD, ParseError
from weftgraph.session import cut, ensure_checkpoint_dir, ship

READERS = {
    "ttl": turtle.read_turtle, "trig": turtle.read_trig, "n3": turtle.read_n3, "ntriples": turtle.read_nquads, "nquads": turtle.read_nquads,
    "rdf": rdfxml.read_rdfxml, "owl": rdfxml.read_rdfxml, "jsonld": rdfxml.read_jsonld, "ofn": owl.read_functional, "owx": owl.read_owlxml,
}
WRITERS = {
    "ttl": turtle.write_turtle, "trig": turtle.write_trig, "n3": turtle.write_turtle, "rdf": rdfxml.write_rdfxml, "owl": rdfxml.write_rdfxml,
    "jsonld": rdfxml.write_jsonld, "ofn": owl.write_functional, "owx": owl.write_owlxml,
    "ntriples": lambda rows, prefixes=None: turtle.write_nquads(rows, graphs=False), "nquads": lambda rows, prefixes=None: turtle.write_nquads(rows),
}
#: The order in which types are tried when the hinted one fails.
ORDER = ("owl", "ofn", "owx", "ttl", "rdf", "ntriples", "nquads", "trig", "jsonld", "n3")
LIMIT = 50_000_000
#: Graphs of one insertion that are looked up by name; with more, all graphs are compared.
SOME_GRAPHS = 1000
#: Tasks that fetch at a time.
FETCHES = 64
APP = "weftgraph"


class StoreError(ValueError):
    """A document that can't be taken in, or a request that can't be met."""


def graph_name(name: str, user: str | None = None) -> str:
    """The IRI of a file's graph; a user's graphs are apart from another's."""
    clean = re.sub(r"[()\[\]]", "", name.replace(" ", "_"))
    return f"urn:{APP}:{f'user:{user}:' if user else ''}graph:{clean}"


def new_user() -> str:
    return str(uuid.uuid4())


def parse_as(text: str, kind: str, graph: str, base: str, label: str) -> list[tuple]:
    """A document's rows, without repeats."""
    if kind not in READERS:
        raise StoreError(f"no reader of {kind}")
    try:
        return list(dict.fromkeys(READERS[kind](text, graph, base, label)))
    except (KeyError, IndexError, TypeError, RecursionError) as e:
        raise ParseError(f"malformed {kind}: {e!r}") from e


def parse_any(text: str, hint: str | None, graph: str, base: str, label: str) -> tuple[list[tuple], str]:
    """Rows and the type that was found: the hinted type first, then all others in order."""
    errors = []
    for kind in dict.fromkeys([*([hint] if hint in READERS else []), *ORDER]):
        try:
            rows = parse_as(text, kind, graph, base, label)
        except ValueError as e:
            errors.append(f"{kind}: {e}")
            continue
        if rows or not text.strip():
            return rows, kind
    raise StoreError("no reader takes the document: " + "; ".join(errors)[:500])


def decoded(text: Column) -> Column:
    """Text with its escapes decoded, in the JVM: doubled backslashes are set apart first, so every other one begins an escape."""
    simple = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'"}

    def one(piece: Column) -> Column:
        kind = F.substr(piece, F.lit(1), F.lit(1))
        code = lambda digits: F.decode(F.unhex(F.lpad(F.substr(piece, F.lit(2), F.lit(digits)), 8, "0")), "UTF-32")
        out = F.when(kind == "u", F.concat(code(4), F.substr(piece, F.lit(6)))).when(kind == "U", F.concat(code(8), F.substr(piece, F.lit(10))))
        for letter, value in simple.items():
            out = out.when(kind == letter, F.concat(F.lit(value), F.substr(piece, F.lit(2))))
        return out.otherwise(piece)

    def part(segment: Column) -> Column:
        return F.array_join(F.transform(F.split(segment, r"\\"), lambda piece, i: F.when(i == 0, piece).otherwise(one(piece))), "")

    whole = F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")
    return F.when(F.contains(text, F.lit("\\")), whole).otherwise(text)


def parse_lines(lines: DataFrame, graph: str) -> DataFrame:
    """Quads of lines (a column value) of N-Triples or N-Quads, taken apart by the JVM; ``rejected_lines`` has those that are no statement."""
    # a line is taken apart once: its groups on lines of their own after an empty one, the literal's text, which alone may hold a line end, last
    order = (1, 2, 3, 4, 5, 7, 8, 9, 10, 6)
    groups = "".join(f"\n${i}" for i in order)
    parts = F.split(F.regexp_replace("value", F.lit(turtle.STATEMENT), F.lit(groups)), "\n", 11)
    whole = F.when(F.contains("value", F.lit("\n")), F.col("value").rlike(turtle.STATEMENT)).otherwise(F.size("_parts") == 11)
    lines = lines.withColumn("_parts", parts).where(whole)
    part = lambda i: F.col("_parts")[order.index(i) + 1]
    iri = lambda i: F.when(part(i) != "", decoded(part(i)))
    blank = lambda i: F.when(part(i) != "", F.concat(F.regexp_extract(F.input_file_name(), "([^/]*)$", 1), F.lit("#"), part(i)))
    # an object that is neither IRI nor blank is a literal, though its text may be empty
    literal = (part(4) == "") & (part(5) == "")
    lang = F.nullif(part(8), F.lit(""))
    return lines.select(
        F.coalesce(iri(9), blank(10), F.lit(graph)).alias("g"),
        F.when(part(2) == "", "I").otherwise("B").alias("s_kind"),
        F.coalesce(blank(2), decoded(part(1))).alias("s"),
        decoded(part(3)).alias("p"),
        F.when(part(5) != "", "B").when(literal, "L").otherwise("I").alias("o_kind"),
        F.coalesce(blank(5), F.when(literal, decoded(part(6)))).alias("o_text"),
        iri(4).alias("o_iri"),
        F.when(literal, F.when(lang.isNotNull(), F.lit(turtle.LANG_STRING)).otherwise(F.coalesce(iri(7), F.lit(turtle.STRING)))).alias("o_dt"),
        F.lower(lang).alias("o_lang"),
    ).select("g", "s_kind", "s", "p", "o_kind", F.coalesce("o_iri", "o_text").alias("o"), "o_dt", "o_lang")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Diagnostics for the lines that are neither empty, nor a comment, nor a statement."""
    bad = lines.where(~F.col("value").rlike(turtle.STATEMENT) & ~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    message = F.concat(F.regexp_extract(F.input_file_name(), "([^/]*)$", 1), F.lit(": not a statement: "), F.substring("value", 1, 60))
    return bad.select(F.current_timestamp().cast("string").alias("timestamp"), F.lit("Critical").alias("severity"), F.lit("Parser").alias("error_type"), message.alias("message"))


def read_lines(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """N-Triples or N-Quads by Spark's text reader: a line is a statement, so a file is split over tasks."""
    return parse_lines(spark.read.text(path), graph).dropDuplicates()


def read_documents(spark: SparkSession, path: str, graph: str | None = None, user: str | None = None, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Quads of all documents that ``path`` (a file, a directory or a pattern) holds, each in its own graph unless
    one is named; and a table of diagnostics. A document that no reader takes, or that is too large, is a record there."""

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = where.rsplit("/", 1)[-1]
                g = graph or graph_name(name, user)
                hint = formats.strict_type_of(name) or formats.type_of(name)
                rows, note = [], None
                try:
                    if len(content) > limit:
                        raise StoreError(f"{len(content)} bytes; the limit is {limit}")
                    rows, kind = parse_any(content.decode("utf-8-sig"), hint, g, where, name)
                    if kind != hint and {kind, hint} != {"owl", "rdf"}:
                        note = ("Warning", f"{name} was read as {kind}, not as {hint}")
                except ValueError as e:
                    note = ("Critical", f"{name}: {e}")
                out = [(*r, None, None) for r in rows] + ([(g, *[None] * 7, *note)] if note else [])
                names = ["g", "s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang", "severity", "message"]
                columns = list(zip(*out, strict=True)) if out else [[]] * 10
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=names)

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = cut(files.mapInArrow(run, QUAD + ", severity string, message string"))
    quads = found.where("severity IS NULL").drop("severity", "message")
    notes = found.where("severity IS NOT NULL").select(F.current_timestamp().cast("string").alias("timestamp"), "severity", F.lit("Parser").alias("error_type"), "message")
    return quads, notes


def rows_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, QUAD)


# ---- the store
class Store:
    """A set of quads with what can be done to it. ``user`` keeps users' graphs apart.

    Quads lie in a table in ``path`` (the shared folder, if none is named), in directories by commit and graph and sorted by
    predicate in each. An insertion is one commit: it is compared with its own graphs alone, and writes only
    what they lack. A graph is read from its directories, a predicate from the files whose bounds fit. A table that is
    there already is opened; a commit counts once its job has marked it as done.
    """

    def __init__(self, spark: SparkSession, user: str | None = None, resolve_imports: bool = False, limit: int = LIMIT, path: str | None = None):
        self.spark, self.user, self.resolve_imports, self.limit = spark, user, resolve_imports, limit
        if path is None:
            ensure_checkpoint_dir(spark)
            path = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
        self.path, self.commits = path.rstrip("/"), []
        while self._done(len(self.commits)):
            self.commits.append(self._commit(len(self.commits)))
        self.notes: list[dict] = []
        self.line_notes: list[str] = []
        self.large_notes: list[DataFrame] = []
        self.uploads: dict[str, list] = {}

    def _commit(self, n: int) -> str:
        return f"{self.path}/commit={n}"

    def _done(self, n: int) -> bool:
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._commit(n)}/_SUCCESS")
        return mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    @property
    def quads(self) -> DataFrame:
        """All quads that are stored."""
        columns = [c.split()[0] for c in QUAD.split(", ")]
        if not self.commits:
            return self.spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c in columns]).where(F.lit(False))
        return self.spark.read.schema(QUAD + ", commit int").option("basePath", self.path).parquet(*self.commits).select(*columns)

    def note(self, severity: str, kind: str, message: str) -> None:
        self.notes.append({"timestamp": datetime.now(timezone.utc).isoformat(), "severity": severity, "error_type": kind, "message": message})

    def diagnostics(self) -> DataFrame:
        """What was noted, and the lines of line formats that are no statement; the others of such a file are kept."""
        out = self.spark.createDataFrame([tuple(n.values()) for n in self.notes], "timestamp string, severity string, error_type string, message string")
        for path in self.line_notes:
            out = out.unionByName(rejected_lines(self.spark.read.text(path)))
        for notes in self.large_notes:
            out = out.unionByName(notes)
        return out

    def add(self, quads: DataFrame, graphs: list[str] | None = None) -> None:
        """Graphs are sets: what is already there stays once. ``graphs``: those that the quads are of, if it is known."""
        new = quads.dropDuplicates()
        if self.commits:
            there = self.quads
            if graphs is None:
                found = [r["g"] for r in quads.select("g").distinct().limit(SOME_GRAPHS + 1).collect()]
                graphs = found if len(found) <= SOME_GRAPHS else None
            if graphs is not None:  # directories of other graphs aren't read
                there = there.where(F.col("g").isin(*graphs))
            old = there.select(*[F.col(c).alias(f"_{c}") for c in there.columns])
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c in ("o_dt", "o_lang") else F.col(c) == F.col(f"_{c}") for c in there.columns]
            new = new.join(old, reduce(and_, same), "left_anti")
        path = self._commit(len(self.commits))
        new.repartitionByRange("g", "p", "s").sortWithinPartitions("g", "p", "s").write.mode("overwrite").partitionBy("g").parquet(path)
        self.commits.append(path)

    def compact(self, path: str) -> "Store":
        """The same quads in a store at ``path``, as one commit: fewer and larger files after many small insertions."""
        whole = Store(self.spark, self.user, self.resolve_imports, self.limit, path)
        if self.commits:
            whole.add(self.quads)
        return whole

    def insert_stored(self, dataset: str, folder: str) -> str:
        """A dataset of the ``CATALOG``, whose file lies in ``folder``; its graph's name."""
        if dataset not in CATALOG:
            raise StoreError(f"no stored dataset {dataset!r}; there are {', '.join(CATALOG)}")
        return self.insert_file(f"{folder.rstrip('/')}/{CATALOG[dataset][0]}")

    def insert_file(self, path: str, name: str | None = None) -> str:
        """A file by its extension, which must be known; its graph's name."""
        kind = formats.strict_type_of(path)
        if kind is None:
            raise StoreError(f"unknown type of {path}")
        g = graph_name(name or path.rsplit("/", 1)[-1], self.user)
        if kind in ("ntriples", "nquads"):
            self._take(g, read_lines(self.spark, path, g), path, None if kind == "nquads" else [g])
            self.line_notes.append(path)
        else:
            quads, notes = read_documents(self.spark, path, g, self.user, self.limit)
            bad = notes.where("severity = 'Critical'").limit(1).collect()
            if bad:
                raise StoreError(bad[0]["message"])
            self._take(g, quads, path, [g] if kind != "trig" else None)
        return g

    def insert_large(self, path: str, name: str | None = None) -> str:
        """A Turtle file of any size, or a directory of such files, read in pieces; its graph's name. Statements that can't be
        read are in ``diagnostics``, the others are kept."""
        g = graph_name(name or path.rstrip("/").rsplit("/", 1)[-1], self.user)
        quads, notes = read_turtle_pieces(self.spark, path, g)
        self._take(g, quads, path, [g])
        self.large_notes.append(notes)
        return g

    def insert_text(self, text: str, name: str, base: str | None = None) -> str:
        """A document in memory; its type is a hint, any reader that takes it will do."""
        if len(text.encode()) > self.limit:
            raise StoreError(f"the document exceeds {self.limit} bytes")
        g, hint = graph_name(name, self.user), formats.type_of(name)
        rows, kind = parse_any(text, hint, g, base or f"file:///{name}", name)
        if kind != hint and {kind, hint} != {"owl", "rdf"}:
            self.note("Warning", "Parser", f"{name} was read as {kind}, not as {hint}")
        self._take(g, rows_frame(self.spark, rows), base or f"file:///{name}")
        return g

    def insert_url(self, url: str) -> str:
        return self.insert_text(fetch(url, self.limit).decode("utf-8-sig"), url.rsplit("/", 1)[-1] or "download", url)

    def insert_query(self, endpoint: str, query: str, kind: str = "ttl") -> str:
        """What a remote query service answers, taken in like a file."""
        request = urllib.request.Request(endpoint, data=query.encode(), headers={"Content-Type": "application/sparql-query", "Accept": formats.mime_type(kind)})
        return self.insert_text(_read(request, self.limit).decode("utf-8-sig"), f"{urlparse(endpoint).netloc}.{formats.TYPES[kind][0]}", endpoint)

    # uploads in parts
    def start_upload(self, name: str) -> str:
        key = str(uuid.uuid4())
        self.uploads[key] = [name if formats.extension(name) else name + ".owl", 0, []]
        return key

    def upload_chunk(self, key: str, chunk: bytes) -> None:
        self.uploads[key][1] += len(chunk)
        self.uploads[key][2].append(chunk)
        if self.uploads[key][1] > self.limit:
            del self.uploads[key]
            raise StoreError(f"the upload exceeds {self.limit} bytes")

    def complete_upload(self, key: str) -> str:
        name, _, chunks = self.uploads.pop(key)
        return self.insert_text(b"".join(chunks).decode("utf-8-sig"), name)

    # imports
    def _take(self, g: str, quads: DataFrame, base: str, graphs: list[str] | None = None) -> None:
        """Quads and, if they are followed, all that they import, as one commit into the store."""
        if self.resolve_imports:
            base = base if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", base) else f"file://{base}"
            quads = cut(quads)
            for level in self._imports(g, base, import_iris(quads.where(F.col("g") == g))):
                quads = quads.unionByName(level)
        self.add(quads, graphs)

    def _imports(self, g: str, base: str, iris: list[str]):
        """Quads of what is imported, level by level: the documents of a level are fetched and read by tasks, each once by its
        resolved location, and by its content where several locations hold the same. They go into the importing graph;
        failures are warnings. The driver holds the locations."""
        seen, contents, front = {base}, set(), [(i, base) for i in iris]
        while front:
            urls = sorted({resolve(i, parent) for i, parent in front if _locates(i, parent)} - seen)
            for i, parent in front:
                if not _locates(i, parent):
                    self.note("Warning", "Import", f"not a location: {i}")
            seen |= set(urls)
            if not urls:
                return
            asked = self.spark.createDataFrame([(u,) for u in urls], "url string").repartition(min(len(urls), FETCHES), "url")
            found = cut(asked.mapInArrow(_fetching(g, self.limit), f"{QUAD}, url string, content string, problem string"))
            docs = found.where("content IS NOT NULL OR problem IS NOT NULL").groupBy("url").agg(F.min("content").alias("content"), F.min("problem").alias("problem"))
            fresh = []
            for r in docs.orderBy("url").collect():  # one row for each location
                if r["problem"] is not None:
                    self.note("Warning", "Import", f"{r['url']}: {r['problem']}")
                elif r["content"] not in contents:
                    contents.add(r["content"])
                    fresh.append(r["url"])
            level = found.where(F.col("s").isNotNull() & F.col("url").isin(*fresh))
            yield level.select(*[c.split()[0] for c in QUAD.split(", ")])
            further = level.where((F.col("p") == OWL + "imports") & (F.col("o_kind") == "I")).select("o", "url").distinct().collect()
            front = sorted((r["o"], r["url"]) for r in further)

    def query(self, text: str, g: str | None = None, terms: bool = False) -> DataFrame:
        """A SELECT over one graph, or over all of them; GRAPH clauses name graphs. Other query forms are refused."""
        from weftgraph.plans import compile as C
        from weftgraph.plans.sparql import parse as parse_query

        quads = self.graph(g) if g else self.quads
        return C.solutions(C.select(parse_query(text), C.QuadGraph(quads)), terms)

    def graph(self, g: str) -> DataFrame:
        return self.quads.where(F.col("g") == g)

    def export(self, g: str, kind: str) -> str:
        """One graph as text. Its statements go through the driver: for graphs that a person reads or draws."""
        if kind not in formats.EXPORTS:
            raise StoreError(f"can't export {kind}")
        rows = [tuple(r) for r in self.graph(g).collect()]
        return WRITERS[kind](rows, PREFIXES)

    def export_lines(self, g: str, path: str, graphs: bool = True) -> None:
        """One graph as N-Quads or N-Triples, written by all tasks: for graphs of any size."""
        write_lines(self.graph(g), path, graphs)

    def export_turtle(self, g: str, path: str) -> None:
        """One graph as Turtle files, written by all tasks: for graphs of any size."""
        write_turtle_pieces(self.graph(g), path)


def write_lines(quads: DataFrame, path: str, graphs: bool = True) -> None:
    def node(kind, text):
        return F.when(F.col(kind) == "I", F.concat(F.lit("<"), F.col(text), F.lit(">"))).otherwise(F.concat(F.lit("_:b"), F.hex(F.xxhash64(text))))

    lexical = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        lexical = F.replace(lexical, F.lit(a), F.lit(b))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_dt") == turtle.STRING, F.lit("")).otherwise(F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">")))
    o = F.when(F.col("o_kind") == "L", F.concat(F.lit('"'), lexical, F.lit('"'), tail)).otherwise(node("o_kind", "o"))
    parts = [node("s_kind", "s"), F.concat(F.lit("<"), F.col("p"), F.lit(">")), o]
    if graphs:
        parts.append(F.concat(F.lit("<"), F.col("g"), F.lit(">")))
    quads.select(F.concat_ws(" ", *parts, F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def _locates(iri: str, parent: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", urljoin(parent, iri)) is not None


def _fetching(g: str, limit: int):
    """Locations to the quads of what they hold, with the hash of the content; or to what went wrong."""

    def run(batches):
        names = ["g", "s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang", "url", "content", "problem"]
        for batch in batches:
            for url in batch.column(0).to_pylist():
                rows, content, problem = [], None, None
                try:
                    data = fetch(url, limit)
                    rows, _ = parse_any(data.decode("utf-8-sig"), formats.type_of(urlparse(url).path), g, url, url)
                    content = hashlib.sha256(data).hexdigest()
                except (OSError, ValueError) as e:
                    problem = str(e)
                out = [*[(*r, url, None, None) for r in rows], (*[None] * 8, url, content, problem)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*out, strict=True)], names=names)

    return run


def import_iris(quads: DataFrame) -> list[str]:
    return [r["o"] for r in quads.where((F.col("p") == OWL + "imports") & (F.col("o_kind") == "I")).select("o").distinct().collect()]


def resolve(iri: str, parent: str) -> str:
    url = urljoin(parent, iri)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", url):
        raise StoreError(f"not a location: {iri}")
    return url


def _read(request, limit: int) -> bytes:
    with urllib.request.urlopen(request, timeout=30) as r:  # the bytes are counted, whatever their announced length
        data = r.read(limit + 1)
    if len(data) > limit:
        raise StoreError(f"more than {limit} bytes")
    return data


def fetch(url: str, limit: int = LIMIT) -> bytes:
    if urlparse(url).scheme not in ("file", "http", "https"):
        raise StoreError(f"can't fetch {url}")
    return _read(url, limit)


# The stored datasets by name, with their file's name and number of classes.
CATALOG = {
    "Friend of a Friend": ("foaf.ttl", 13),
    "OntoViBe": ("ontovibe.ttl", 43),
    "Clinical Trials Ontology": ("clinical-trials.owl", 273),
    "Rendering Benchmark": ("benchmark-2500.ofn", 2500),
    "Environment Ontology": ("envo.owl", 6900),
}
__all__ = ["CATALOG", "Store", "StoreError", "fetch", "graph_name", "parse_any", "read_documents", "read_lines", "unescape", "write_lines"]
