"""Tables as virtual triples.

A row of a table is a subject: an IRI made of the table's template and its key, or a blank
node where no column is a key. A column is a predicate; a foreign key is an IRI of the table
it refers to, any other column a literal. Nothing is materialised: the triples of a query
that share a subject become one scan of the table's columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.vocabulary import TYPE, XSD
from weftgraph.plans import algebra as A
from weftgraph.plans import compile as C
from weftgraph.session import table

NS = "urn:t:"
KINDS = {"int": "int", "bigint": "long", "double": "double", "string": "string", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "boolean": "boolean"}


@dataclass(frozen=True)
class TableMap:
    """How one table becomes triples: its key column (none: blank nodes) and its foreign keys, column -> table."""

    key: str | None
    references: dict = field(default_factory=dict)


TABLES = {
    "region": TableMap("r_regionkey"),
    "nation": TableMap("n_nationkey", {"n_regionkey": "region"}),
    "customer": TableMap("c_custkey", {"c_nationkey": "nation"}),
    "supplier": TableMap("s_suppkey", {"s_nationkey": "nation"}),
    "part": TableMap("p_partkey"),
    "orders": TableMap("o_orderkey", {"o_custkey": "customer"}),
    "lineitem": TableMap(None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": TableMap("event_id", {"user_id": "customer"}),
    "documents": TableMap("doc_id"),
    "labels": TableMap(None, {"doc_id": "documents"}),
    "benchmark": TableMap("item_id"),
    "pages": TableMap("page_id"),
    "conversations": TableMap(None),
}
#: Prefixes of the tables' predicates, as in ``customer:c_name``; and ``t:`` for classes, as in ``t:customer``.
PREFIXES = {t: f"{NS}{t}#" for t in TABLES} | {"t": NS}


def template(name: str) -> str:
    return f"{NS}{name}:"


class TableGraph:
    """The triples of a directory of tables. ``key#`` columns: a key is also given as a literal."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: dict[str, TableMap] | None = None):
        self.spark, self.sf_dir, self.tables = spark, sf_dir, tables or TABLES
        self._frames: dict[str, DataFrame] = {}
        self.steps: dict = {}

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = table(self.spark, self.sf_dir, name)
        return self._frames[name]

    def named(self, name: str) -> TableGraph:
        return self

    def each_named(self, var: str) -> TableGraph:
        return self

    def _place(self, t: A.Triple) -> tuple[str, str] | None:
        """The table and column of a triple's predicate; the type is the column ''."""
        if not isinstance(t.p, A.Link):
            return None
        if t.p.iri == TYPE and isinstance(t.o, A.Iri) and t.o.value.removeprefix(NS) in self.tables:
            return t.o.value.removeprefix(NS), ""
        name, _, column = t.p.iri.removeprefix(NS).partition("#")
        return (name, column) if name in self.tables and column else None

    def bgp(self, triples: list) -> C.Relation:
        stars: dict = {}
        order: list = []
        for t in triples:
            place = self._place(t)
            key = (t.s, place[0]) if place else id(t)
            if key not in stars:
                stars[key] = []
                order.append(key)
            stars[key].append((t, place))
        parts = []
        for key in order:
            group = stars[key]
            names = set().union(*(C._names(t) for t, _ in group))
            if group[0][1] is None:
                parts.append((names, C._has_repeat(group[0][0].p), lambda rel, t=group[0][0]: C._with_path(self, rel, t)))
            else:
                parts.append((names, False, lambda rel, key=key, group=group: C.join(rel, self._star(key[0], key[1], [(t, place[1]) for t, place in group]))))
        return C.joined(self.spark, parts)

    def triple(self, t: A.Triple) -> C.Relation:
        place = self._place(t)
        if place:
            return self._star(t.s, place[0], [(t, place[1])])
        if isinstance(t.p, A.Var):
            return self._any_predicate(t)
        nothing = C.unit(self.spark)
        names = [x.name for x in (t.s, t.o) if isinstance(x, A.Var)]
        for n in names:
            nothing = C.put(nothing, n, C.variable(nothing, n))
        return C.Relation(nothing.df.where(F.lit(False)), nothing.vars)

    def _subject(self, name: str, df: DataFrame) -> tuple[DataFrame, str]:
        m = self.tables[name]
        if m.key:
            return df, m.key
        return df.withColumn("_row", F.monotonically_increasing_id()), "_row"

    def _star(self, subject, name: str, parts: list) -> C.Relation:
        """The triples of one subject as one scan of its table."""
        m, df = self.tables[name], self.frame(name)
        bounds: dict = {}
        cols: dict = {}
        if isinstance(subject, A.Var):
            if m.key:
                cols[subject.name], bounds[subject.name] = F.col(m.key), C.Bound(template(name))
            elif not subject.name.startswith("_"):
                df = df.withColumn("_row", F.monotonically_increasing_id())
                cols[subject.name], bounds[subject.name] = F.concat(F.lit(f"{name}#"), F.col("_row").cast("string")), C.Bound(kind="B")
        else:
            df = df.where(F.col(m.key).cast("string") == subject.value.removeprefix(template(name)))
        for t, column in parts:
            if not column:
                continue
            c = F.col(column)
            df = df.where(c.isNotNull())
            if column in m.references:
                b = C.Bound(template(m.references[column]))
            else:
                b = C.Bound(datatype=XSD + KINDS[dict(df.dtypes)[column]])
            if isinstance(t.o, A.Var):
                if t.o.name in cols:
                    df = df.where(cols[t.o.name] == c)
                else:
                    cols[t.o.name], bounds[t.o.name] = c, b
            elif isinstance(t.o, A.Iri):
                key = t.o.value.removeprefix(b.template or "\0")
                df = df.where((c.cast("string") == key) if b.template and t.o.value.startswith(b.template) else F.lit(False))
            else:
                df = df.where(c == C.constant(t.o).col)
        out = []
        for n, b in bounds.items():
            out.append(cols[n].alias(n))
            if not b.native:
                out += [F.lit("B").alias(n + "#k"), F.lit(None).cast("string").alias(n + "#d"), F.lit(None).cast("string").alias(n + "#g")]
        if not out:
            out = [F.lit(1).alias("_unit")]
        return C.Relation(df.select(*out), bounds)

    def _any_predicate(self, t: A.Triple) -> C.Relation:
        """A variable predicate: each table read once, its columns unpivoted within the scan."""
        quads = None
        for name in self.tables:
            df, key = self._subject(name, self.frame(name))
            m = self.tables[name]
            kinds = dict(df.dtypes)
            items = [F.struct(F.lit(TYPE).alias("p"), F.lit(NS + name).alias("o"), F.lit("I").alias("k"), F.lit(None).cast("string").alias("d"))]
            for c in (c for c, k in kinds.items() if k in KINDS and c != "_row"):
                linked = c in m.references
                text = F.col(c).cast("string")
                items.append(F.struct(
                    F.lit(f"{NS}{name}#{c}").alias("p"), (F.concat(F.lit(template(m.references[c])), text) if linked else text).alias("o"),
                    F.lit("I" if linked else "L").alias("k"), F.lit(None if linked else XSD + KINDS[kinds[c]]).cast("string").alias("d"),
                ))
            s = F.concat(F.lit(template(name) if m.key else f"{name}#"), F.col(key).cast("string"))
            part = df.select(F.lit("I" if m.key else "B").alias("s_kind"), s.alias("s"), F.explode(F.array(*items)).alias("x")).where("x.o IS NOT NULL")
            part = part.select("s_kind", "s", "x.p", F.col("x.k").alias("o_kind"), "x.o", F.col("x.d").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
            quads = part if quads is None else quads.unionByName(part)
        return C.QuadGraph(quads.withColumn("g", F.lit(None).cast("string"))).triple(t)

    def nodes(self) -> DataFrame:
        s = A.Triple(A.Var("s"), A.Var("p"), A.Var("o"))
        rel = self._any_predicate(s)
        ends = rel.df.select(*[F.col(f"`s{p}`").alias("x" + p) for p in C.PARTS])
        return ends.union(rel.df.select(*[F.col(f"`o{p}`").alias("x" + p) for p in C.PARTS])).distinct()
