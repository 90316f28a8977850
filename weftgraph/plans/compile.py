"""From the algebra to DataFrames.

A relation binds each variable in one of two ways. *Native*: one column of a table, as an
IRI with a fixed template before the key, or as a literal of one datatype; joins and
filters then work on the table's own column, so a star over one subject is one table scan
and a foreign key is joined as it is stored. *Term*: four columns (kind, text, datatype,
language), as triples are stored. Where both meet, the native side is written out as a term.

Expressions follow the three-valued logic of the query language: an error is null, IF with
an error is null, COALESCE passes over errors, FILTER takes null for false.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.vocabulary import NUMERIC, RDF, TYPE, XSD
from weftgraph.operators.closure import closure, prepared
from weftgraph.plans import algebra as A
from weftgraph.session import cut

INTEGER, DOUBLE, STRING, BOOLEAN, DATETIME = (XSD + x for x in ("integer", "double", "string", "boolean", "dateTime"))
PARTS = ("", "#k", "#d", "#g")


@dataclass(frozen=True)
class Bound:
    """How a variable is bound: ``template`` for native IRIs, ``datatype`` for native literals, neither for terms."""

    template: str | None = None
    datatype: str | None = None
    maybe: bool = False  # it can be unbound
    kind: str | None = None  # of a term, if it is known

    @property
    def native(self) -> bool:
        return self.template is not None or self.datatype is not None

    def like(self, other: Bound) -> bool:
        return self.native and other.native and (self.template, self.datatype) == (other.template, other.datatype)

    def columns(self, name: str) -> list[str]:
        return [name] if self.native else [name + p for p in PARTS]


@dataclass
class Relation:
    df: DataFrame
    vars: dict[str, Bound] = field(default_factory=dict)
    suffix: object = None  # of a variable's columns, where a relation is one side of a join

    def columns(self) -> list[str]:
        return [c for v, b in self.vars.items() for c in b.columns(v)]

    def slim(self) -> Relation:
        return Relation(self.df.select(*[_c(c) for c in self.columns()]), self.vars)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# ---- values of expressions
@dataclass
class Value:
    """An expression's value: ``what`` is bool, num, text, iri (template) or term; ``col`` is its column, its text or its key."""

    what: str
    col: Column
    template: str | None = None
    kind: Column | None = None
    datatype: object = None
    lang: Column | None = None
    constant: object = None

    def truth(self) -> Column:
        if self.what == "bool":
            return self.col
        if self.what == "num":
            return self.col != 0
        if self.what == "text":
            return F.length(self.col) > 0
        if self.what == "term":
            number = self.col.try_cast("double")
            return F.when(self.datatype == BOOLEAN, self.col.isin("true", "1")).when(self.datatype.isin(*NUMERIC), number != 0).when(self.kind == "L", F.length(self.col) > 0)
        return F.lit(None).cast("boolean")

    def number(self) -> Column:
        if self.what == "num":
            return self.col
        if self.what == "term":
            return F.when(self.datatype.isin(*NUMERIC), self.col.try_cast("double"))
        return self.col.try_cast("double") if self.what == "text" and self.datatype in NUMERIC else F.lit(None).cast("double")

    def text(self) -> Column:
        return F.concat(F.lit(self.template), self.col.cast("string")) if self.what == "iri" else self.col.cast("string")

    def term(self) -> tuple[Column, Column, Column, Column]:
        """text, kind, datatype, language"""
        if self.what == "term":
            return self.col, self.kind, self.datatype, self.lang
        t = self.text()
        if self.what == "iri":
            return t, F.when(t.isNotNull(), F.lit("I")), F.lit(None).cast("string"), F.lit(None).cast("string")
        d = {"bool": BOOLEAN, "num": self.datatype or DOUBLE, "text": self.datatype or STRING}[self.what]
        return t, F.when(t.isNotNull(), F.lit("L")), F.when(t.isNotNull(), F.lit(d)), F.lit(None).cast("string")


def _equal(a: Value, b: Value) -> Column:
    if a.what == b.what == "iri":
        return a.col == b.col if a.template == b.template else a.text() == b.text()
    for x, y in ((a, b), (b, a)):
        if x.what == "iri" and isinstance(y.constant, A.Iri):  # the key is compared, not a text made for each row
            key = y.constant.value.removeprefix(x.template)
            same = x.col.cast("string") == key if y.constant.value.startswith(x.template) else F.lit(False)
            return F.when(x.col.isNotNull(), same)
        if x.what == "iri" and y.what in ("num", "text", "bool"):
            return F.when(x.col.isNotNull() & y.col.isNotNull(), F.lit(False))
        if x.what == "num" and y.what in ("num", "term"):
            return x.number() == y.number()
        if x.what == "bool":
            return x.col == y.truth()
    if a.what == b.what == "text":
        return a.col == b.col
    ta, tb = a.term(), b.term()
    both_numbers = ta[2].isin(*NUMERIC) & tb[2].isin(*NUMERIC)
    same = (ta[0] == tb[0]) & (ta[1] == tb[1]) & ta[2].eqNullSafe(tb[2]) & ta[3].eqNullSafe(tb[3])
    if isinstance(a.constant, A.Iri) or isinstance(b.constant, A.Iri):
        return (ta[0] == tb[0]) & (ta[1] == tb[1])
    for x, y in ((a, tb), (b, ta)):
        if isinstance(x.constant, A.Lit) and x.constant.datatype == BOOLEAN:
            truth = ("true", "1") if x.constant.value in ("true", "1") else ("false", "0")
            return F.when(y[0].isNotNull(), (y[1] == "L") & (y[2] == BOOLEAN) & y[0].isin(*truth))
    return F.when(F.coalesce(both_numbers, F.lit(False)), ta[0].try_cast("double") == tb[0].try_cast("double")).otherwise(same)


def _ordered(op: str, a: Value, b: Value) -> Column:
    x, y = (a.col, b.col) if a.what == b.what == "text" else (a.number(), b.number())
    if "term" in (a.what, b.what) and "num" not in (a.what, b.what):
        numeric = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        (s, _, sd, _), (t, _, td, _) = a.term(), b.term()
        text = {"<": s < t, "<=": s <= t, ">": s > t, ">=": s >= t}[op]
        return F.coalesce(numeric, F.when(sd == td, text))  # unlike literals have no order: an error
    if a.what == "text" and b.what == "text" and DATETIME in (a.datatype, b.datatype):
        x, y = x.try_cast("timestamp"), y.try_cast("timestamp")
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def constant(t) -> Value:
    if isinstance(t, A.Iri):
        return Value("term", F.lit(t.value), kind=F.lit("I"), datatype=F.lit(None).cast("string"), lang=F.lit(None).cast("string"), constant=t)
    if t.datatype in NUMERIC:
        whole = "." not in t.value and "e" not in t.value.lower()
        return Value("num", F.lit(int(t.value) if whole else float(t.value)), datatype=t.datatype, constant=t)
    if t.datatype == STRING:
        return Value("text", F.lit(t.value), datatype=STRING, constant=t)
    return Value("term", F.lit(t.value), kind=F.lit("L"), datatype=F.lit(t.datatype), lang=F.lit(t.lang).cast("string"), constant=t)


def variable(rel: Relation, name: str) -> Value:
    b = rel.vars.get(name)
    suffix = rel.suffix(name) if rel.suffix else ""
    if b is None:
        return Value("term", F.lit(None).cast("string"), kind=F.lit(None).cast("string"), datatype=F.lit(None).cast("string"), lang=F.lit(None).cast("string"))
    if b.template is not None:
        return Value("iri", _c(name + suffix), template=b.template)
    if b.datatype is not None:
        what = "num" if b.datatype in NUMERIC else "bool" if b.datatype == BOOLEAN else "text"
        return Value(what, _c(name + suffix), datatype=b.datatype)
    k = _c(name + "#k" + suffix)
    return Value("term", _c(name + suffix), kind=k, datatype=_c(name + "#d" + suffix), lang=_c(name + "#g" + suffix))


def evaluate(e, rel: Relation) -> Value:
    if isinstance(e, A.Var):
        return variable(rel, e.name)
    if isinstance(e, (A.Iri, A.Lit)):
        return constant(e)
    if not isinstance(e, A.Call):
        raise ValueError(f"{type(e).__name__} can't stand here")
    name = e.name
    if name == "bound":
        return Value("bool", variable(rel, e.args[0].name).col.isNotNull())
    a = [evaluate(x, rel) for x in e.args]
    if name == "or":
        return Value("bool", a[0].truth() | a[1].truth())
    if name == "and":
        return Value("bool", a[0].truth() & a[1].truth())
    if name == "not":
        return Value("bool", ~a[0].truth())
    if name in ("=", "sameterm"):
        return Value("bool", _equal(*a))
    if name == "!=":
        return Value("bool", ~_equal(*a))
    if name in ("<", "<=", ">", ">="):
        return Value("bool", _ordered(name, *a))
    if name == "in":
        out = F.lit(False)
        for x in a[1:]:
            out = out | _equal(a[0], x)
        return Value("bool", out)
    if name in ("isiri", "isuri", "isblank", "isliteral"):
        want = {"isblank": "B", "isliteral": "L"}.get(name, "I")
        return Value("bool", a[0].term()[1] == want)
    if name == "isnumeric":
        return Value("bool", a[0].number().isNotNull())
    if name == "if":
        then, other = _alike(a[1], a[2])
        test = a[0].truth()
        pick = lambda x, y: F.when(test, x).when(~test, y)  # noqa: E731  an error stays an error
        if then.what == "term":
            return Value("term", pick(then.col, other.col), kind=pick(then.kind, other.kind), datatype=pick(then.datatype, other.datatype), lang=pick(then.lang, other.lang))
        return replace(then, col=pick(then.col, other.col), constant=None)
    if name == "coalesce":
        a = _alike(*a)
        if a[0].what == "term":
            some = lambda i: F.coalesce(*[F.when(x.col.isNotNull(), x.term()[i]) if i == 0 else F.when(x.col.isNotNull(), F.struct(x.term()[i].alias("x"))) for x in a])
            return Value("term", some(0), kind=some(1)["x"], datatype=some(2)["x"], lang=some(3)["x"])
        return replace(a[0], col=F.coalesce(*[x.col for x in a]), constant=None)
    if name in ("+", "-", "*", "/"):
        x, y = a[0].number(), a[1].number()
        whole = all(v.datatype in NUMERIC and v.datatype not in (DOUBLE, XSD + "float", XSD + "decimal") for v in a if v.what == "num") and all(v.what == "num" for v in a)
        col = {"+": F.try_add(x, y), "-": F.try_subtract(x, y), "*": F.try_multiply(x, y), "/": F.try_divide(x, y)}[name]
        return Value("num", col, datatype=INTEGER if whole and name != "/" else DOUBLE)
    if name in ("abs", "ceil", "floor", "round"):
        return Value("num", {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round}[name](a[0].number()), datatype=a[0].datatype if isinstance(a[0].datatype, str) else DOUBLE)
    if name in ("year", "month", "day", "hours", "minutes", "seconds"):
        f = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hours": F.hour, "minutes": F.minute, "seconds": F.second}[name]
        return Value("num", f(a[0].col.try_cast("timestamp")), datatype=INTEGER)
    if name == "strlen":
        return Value("num", F.length(a[0].text()), datatype=INTEGER)
    if name in ("contains", "strstarts", "strends"):
        f = {"contains": Column.contains, "strstarts": Column.startswith, "strends": Column.endswith}[name]
        return Value("bool", f(a[0].text(), a[1].text()))
    if name == "regex":
        flags = f"(?{e.args[2].value})" if len(e.args) > 2 and e.args[2].value else ""
        return Value("bool", a[0].text().rlike(flags + e.args[1].value))
    if name == "replace":
        return Value("text", F.regexp_replace(a[0].text(), a[1].text(), a[2].text()), datatype=STRING)
    if name == "substr":
        n = a[2].number().cast("int") if len(a) > 2 else F.lit(1 << 30)
        return Value("text", a[0].text().substr(a[1].number().cast("int"), n), datatype=STRING)
    if name in ("str", "ucase", "lcase", "concat", "strbefore", "strafter", "encode_for_uri"):
        t = [x.text() for x in a]
        col = {
            "str": lambda: t[0], "ucase": lambda: F.upper(t[0]), "lcase": lambda: F.lower(t[0]), "concat": lambda: F.concat(*t),
            "strbefore": lambda: F.when(F.instr(t[0], e.args[1].value) > 0, F.split_part(t[0], t[1], F.lit(1))).otherwise(F.lit("")),
            "strafter": lambda: F.when(F.instr(t[0], e.args[1].value) > 0, t[0].substr(F.instr(t[0], e.args[1].value) + len(e.args[1].value), F.lit(1 << 30))).otherwise(F.lit("")),
            "encode_for_uri": lambda: F.url_encode(t[0]),
        }[name]()
        return Value("text", col, datatype=STRING)
    if name == "lang":
        t = a[0].term()
        return Value("text", F.when(t[1] == "L", F.coalesce(t[3], F.lit(""))), datatype=STRING)
    if name == "langmatches":
        t, r = F.lower(a[0].text()), F.lower(a[1].text())
        return Value("bool", F.when(r == "*", t != "").otherwise((t == r) | t.startswith(F.concat(r, F.lit("-")))))
    if name == "datatype":
        t = a[0].term()
        return Value("term", F.when(t[1] == "L", t[2]), kind=F.when(t[1] == "L", F.lit("I")), datatype=F.lit(None).cast("string"), lang=F.lit(None).cast("string"))
    if name in ("iri", "uri"):
        t = a[0].text()
        return Value("term", t, kind=F.when(t.isNotNull(), F.lit("I")), datatype=F.lit(None).cast("string"), lang=F.lit(None).cast("string"))
    if name == "cast":
        to = e.args[1].value
        x = a[0].text()
        if to in NUMERIC:
            return Value("num", x.try_cast("double" if to in (DOUBLE, XSD + "float", XSD + "decimal") else "long"), datatype=to)
        if to == BOOLEAN:
            return Value("bool", x.try_cast("boolean"))
        return Value("text", x, datatype=to)
    raise ValueError(f"unsupported function {name}")


def _alike(*a: Value) -> list[Value]:
    """Values brought to one form."""
    if len({(x.what, x.template) for x in a}) == 1:
        return list(a)
    out = []
    for x in a:
        t = x.term()
        out.append(Value("term", t[0], kind=t[1], datatype=t[2], lang=t[3]))
    return out


def variables(e) -> set[str]:
    if isinstance(e, A.Var):
        return {e.name}
    if isinstance(e, A.Call):
        return set().union(*map(variables, e.args))
    if isinstance(e, A.Aggregate):
        return variables(e.arg) if e.arg is not None else set()
    return set()


def put(rel: Relation, name: str, v: Value, maybe: bool = True) -> Relation:
    """``rel`` with a variable bound to a value."""
    if v.what == "term":
        df = rel.df.withColumns({name: v.col, name + "#k": F.when(v.col.isNotNull(), v.kind), name + "#d": v.datatype, name + "#g": v.lang})
        kind = {A.Iri: "I", A.Lit: "L"}.get(type(v.constant))
        return Relation(df, rel.vars | {name: Bound(maybe=maybe and v.constant is None, kind=kind)})
    d = None if v.what == "iri" else v.datatype or {"bool": BOOLEAN, "num": DOUBLE, "text": STRING}[v.what]
    return Relation(rel.df.withColumn(name, v.col), rel.vars | {name: Bound(v.template, d, maybe and v.constant is None)})


def as_term(rel: Relation, name: str) -> Relation:
    b = rel.vars[name]
    if not b.native:
        return rel
    t = variable(rel, name).term()
    out = put(rel, name, Value("term", t[0], kind=t[1], datatype=t[2], lang=t[3]), b.maybe)
    return Relation(out.df, out.vars | {name: Bound(maybe=b.maybe, kind="I" if b.template is not None else "L")})


def _aligned(left: Relation, right: Relation) -> tuple[Relation, Relation, list[str]]:
    shared = [v for v in left.vars if v in right.vars]
    for v in shared:
        if not left.vars[v].like(right.vars[v]):
            left, right = as_term(left, v), as_term(right, v)
    return left.slim(), right.slim(), shared


def _suffixed(rel: Relation) -> DataFrame:
    return rel.df.select(*[_c(c).alias(c + "~") for c in rel.columns()])


def _compared(left: Relation, right: Relation, v: str) -> list[str]:
    """The columns of a shared variable that tell whether it is bound alike; the last two of four may be null on both sides."""
    a, b = left.vars[v], right.vars[v]
    return [v] if a.native else [v + p for p in (PARTS if a.kind != "I" and b.kind != "I" else PARTS[:2])]


def _same(left: Relation, right: Relation, v: str) -> Column:
    """A variable bound alike on both sides."""
    return _all([_c(c).eqNullSafe(_c(c + "~")) if c in (v + "#d", v + "#g") else _c(c) == _c(c + "~") for c in _compared(left, right, v)])


#: Variables that may be unbound by which a side is taken apart; a join has one or two as a rule.
SPLIT = 3


def _bound_or_not(rel: Relation, shared: list[str]) -> list[tuple[Column | None, set[str]]]:
    """The rows of a relation by which of the shared variables they leave unbound: a condition, and those variables."""
    loose = [v for v in shared if rel.vars[v].maybe]
    if len(loose) > SPLIT:
        raise ValueError(f"unsupported: {len(loose)} variables that may be unbound in one join")
    out = []
    for unbound in chain.from_iterable(combinations(loose, n) for n in range(len(loose) + 1)):
        tests = [_c(v).isNull() if v in unbound else _c(v).isNotNull() for v in loose]
        out.append((_all(tests) if tests else None, set(unbound)))
    return out


def _compatible(left: Relation, right: Relation, shared: list[str], also: list[Column]):
    """Compatible solutions agree where both are bound. Each side is taken apart by what it leaves unbound, so that every
    part is joined by equality: (left's rows, [(right's rows, conditions, columns that these compare)])."""
    for on_left, no_left in _bound_or_not(left, shared):
        parts = []
        for on_right, no_right in _bound_or_not(right, shared):
            rows = right.df if on_right is None else right.df.where(on_right)
            both = [v for v in shared if v not in no_left | no_right]
            parts.append((_suffixed(Relation(rows, right.vars)), [_same(left, right, v) for v in both] + also, [c for v in both for c in _compared(left, right, v)]))
        yield left.df if on_left is None else left.df.where(on_left), parts


#: Rows of a part, counted first, that may go to every task.
SMALL_PART = 100_000
#: Rows of one value, of the left and of the right side, that a cell of a join takes. A row of the left is followed by those of the right that
#: it is paired with, again and again the same ones: so few that a page of a Parquet file holds many repeats, which compress.
CELL = 4096, 256


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _if_few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_PART + 1).count() <= SMALL_PART else df


def _all_with_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of one side with every one of the other. Both are dealt out evenly, whatever files they come from: the pairs, which grow with
    the product of the sides, are made by some four times as many tasks as there are shuffle partitions. Many pairs are made in cells."""
    if left.count() * right.count() > 4 * _tasks(left) * math.prod(CELL):
        return _in_cells(left, right, [], [])
    n = 2 * math.ceil(math.sqrt(_tasks(left)))
    return left.repartition(n).crossJoin(right.repartition(n))


def _in_cells(left: DataFrame, right: DataFrame, columns: list[str], also: list[Column]) -> DataFrame:
    """An equality join on ``columns`` (the right's end in ~) of two large sides; without columns, every row with every one of the other side.

    The rows of a value are dealt by a hash into blocks of some ``CELL`` rows (rows alike in all columns stay together), and a row goes to the cells of its block with each of the other
    side's. So no value meets in one task, what is buffered is bounded, and the rows that are sent more than once are fewer than the pairs by
    a factor of ``CELL``. The cells are dealt over some four times as many tasks as there are shuffle partitions."""
    n = _tasks(left)
    keyed, keys, blocks = [], [], []
    for df, end, rows in zip((left, right), ("", "~"), CELL, strict=True):
        of = [[c for c in columns if c.split("#")[0] == v] for v in dict.fromkeys(c.split("#")[0] for c in columns)]
        key = [_c(x[0] + end) if len(x) == 1 else F.struct(*[_c(c + end).alias(f"_{i}") for i, c in enumerate(x)]) for x in of]  # in a struct nulls are alike
        named = {f"key~{i}{end}": k for i, k in enumerate(key)}
        df = df.where(_all([_c(x[0] + end).isNotNull() for x in of])) if of else df
        keyed.append(df.withColumns(named) if named else df)
        keys.append(list(named))
        if columns:
            counts = keyed[-1].groupBy(*[_c(k) for k in named]).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
            blocks.append(_if_few(cut(counts.select(*[_c(k).alias(f"of~{i}") for i, k in enumerate(named)], F.ceil(F.col("_n") / rows).cast("int").alias("_n")))))
        else:  # whatever there is, as many blocks as keep all tasks busy
            whole = df.count()
            blocks.append(max(1, math.ceil(whole / rows), min(whole, 2 * math.ceil(math.sqrt(n)))))
    sides = []
    for i, df in enumerate((left, right)):
        end, dealt, many = "~" * i, keyed[i], [F.lit(b) for b in blocks] if not columns else [F.coalesce(_c(f"blocks~{j}"), F.lit(1)) for j in range(2)]
        for j, b in enumerate(blocks if columns else ()):
            b = b.withColumnRenamed("_n", f"blocks~{j}")
            dealt = dealt.join(b, _all([_c(k) == _c(f"of~{x}") for x, k in enumerate(keys[i])]), "left").drop(*b.columns[:-1])
        own = F.pmod(F.xxhash64(*[_c(c) for c in df.columns]), many[i]).cast("int").alias(f"cell~{i}{end}")
        each = F.explode(F.sequence(F.lit(0), many[1 - i] - 1)).alias(f"cell~{1 - i}{end}")
        by = [*keys[i], f"cell~0{end}", f"cell~1{end}"]
        sides.append(dealt.select(*[_c(c) for c in (*df.columns, *keys[i])], own, each).repartition(4 * n, *[_c(c) for c in by]))
    on = [_c(c) == _c(c + "~") for c in (*keys[0], "cell~0", "cell~1")]
    return sides[0].join(sides[1].hint("merge"), _all(on + also)).select(*[_c(c) for c in (*left.columns, *right.columns)])


def _by_few_values(left: DataFrame, right: DataFrame, on: list[Column], columns: list[str], also: list[Column]) -> DataFrame:
    """An equality join of which nothing says that either side has a value once: of few values each gives many pairs from few bytes, and
    by their size all would come to one task. A small right side goes to all tasks, over which the left is dealt out evenly; else ``_in_cells``."""
    if right.limit(SMALL_PART + 1).count() > SMALL_PART:
        return _in_cells(left, right, columns, also) if columns else left.join(right, _all(on))
    return left.repartition(_tasks(left)).join(F.broadcast(right), _all(on))


def _pieces(left: Relation, right: Relation, shared: list[str], how: str, also: list[Column]) -> DataFrame:
    """The join of two aligned relations, both sides' columns side by side; for semi and anti joins the left's alone."""
    out = None

    def add(df: DataFrame) -> None:
        nonlocal out
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)

    def one(rows: DataFrame, part: DataFrame, on: list[Column], columns: list[str], how: str) -> DataFrame:
        if loose and how == "inner":
            return _by_few_values(rows, part, on, columns, also) if on else _all_with_all(rows, part)
        return rows.join(part, _all(on), how) if on else rows.crossJoin(part) if how == "inner" else rows.join(part, F.lit(True), how)

    loose = any(r.vars[v].maybe for r in (left, right) for v in shared)
    for rows, parts in _compatible(left, right, shared, also):
        if len(parts) == 1 or how == "inner":
            for part, on, columns in parts:
                add(one(rows, part, on, columns, how))
            continue
        rest = rows
        for part, on, columns in parts:
            if how == "left":
                add(one(rows, part, on, columns, "inner"))
            elif how == "left_semi":
                add(one(rest, part, on, columns, "left_semi"))
            rest = one(rest, part, on, columns, "left_anti")
        if how != "left_semi":  # what no part fits
            add(rest)
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _merge_vars(left: Relation, right: Relation, optional: bool) -> dict[str, Bound]:
    out = dict(left.vars)
    for v, b in right.vars.items():
        if v in out:
            maybe = out[v].maybe and (b.maybe or optional)
            out[v] = replace(out[v], maybe=maybe, kind=out[v].kind or b.kind)
        else:
            out[v] = replace(b, maybe=b.maybe or optional)
    return out


def join(left: Relation, right: Relation, how: str = "inner", condition=None) -> Relation:
    if not left.vars and how == "inner" and left.df.columns == ["_unit"]:
        return right
    left, right, shared = _aligned(left, right)
    merged, also = _merge_vars(left, right, how == "left"), []
    if condition is not None:
        both = Relation(None, {v: left.vars.get(v) or b for v, b in merged.items()})

        def column(name: str) -> str:
            return name if name in left.vars else name + "~"

        also.append(F.coalesce(_evaluate_sides(condition, both, column), F.lit(False)))
    df = _pieces(left, right, shared, how, also)
    cols = []
    for v, b in merged.items():
        for c in b.columns(v):
            if v in left.vars and v in right.vars and left.vars[v].maybe:
                cols.append(F.coalesce(_c(c), _c(c + "~")).alias(c))
            else:
                cols.append(_c(c) if v in left.vars else _c(c + "~").alias(c))
    return Relation(df.select(*cols), merged)


def _evaluate_sides(e, rel: Relation, column) -> Column:
    """An expression over a join's two sides, before they are merged: ``column`` names where a variable lies."""
    return evaluate(e, Relation(None, {v: b for v, b in rel.vars.items()}, lambda n: "" if column(n) == n else "~")).truth()


def exists(left: Relation, pattern, positive: bool, graph) -> Relation:
    """EXISTS and NOT EXISTS: a semi or an anti join; filters on outer variables go into its condition."""
    filters = []
    while isinstance(pattern, A.Filter):
        filters.append(pattern.condition)
        pattern = pattern.child
    right = compile_pattern(pattern, graph)
    outer = []
    for f in filters:
        if not isinstance(f, A.Exists) and not variables(f) <= set(right.vars):
            outer.append(f)
        else:
            right = filtered(right, f, graph)
    l2, r2, shared = _aligned(left, right)
    also = []
    for f in outer:
        both = Relation(None, r2.vars | l2.vars)
        also.append(F.coalesce(_evaluate_sides(f, both, lambda n: n if n in l2.vars else n + "~"), F.lit(False)))
    return Relation(_pieces(l2, r2, shared, "left_semi" if positive else "left_anti", also), l2.vars)


def minus(left: Relation, right: Relation) -> Relation:
    """Solutions that no compatible one of ``right`` shares a variable with."""
    left, right, shared = _aligned(left, right)
    if not shared:
        return left
    out = None
    for rows, parts in _compatible(left, right, shared, []):
        for part, on, _ in parts:
            if on:  # some variable is bound on both sides
                rows = rows.join(part, _all(on), "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return Relation(out, left.vars)


def union(parts: list[Relation]) -> Relation:
    """Bag union; variables that a part doesn't bind are null in it."""
    names = list(dict.fromkeys(v for p in parts for v in p.vars))
    for v in names:
        have = [p.vars[v] for p in parts if v in p.vars]
        if not all(b.like(have[0]) for b in have):
            parts = [as_term(p, v) if v in p.vars else p for p in parts]
    bounds = {}
    for v in names:
        have = [p.vars.get(v) for p in parts]
        known = [b for b in have if b is not None]
        kinds = {b.kind for b in known}
        bounds[v] = replace(known[0], maybe=None in have or any(b.maybe for b in known), kind=kinds.pop() if len(kinds) == 1 else None)
    out = None
    for p in parts:
        p = p.slim().df
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return Relation(out.select(*[_c(c) for v, b in bounds.items() for c in b.columns(v)]), bounds)


def filtered(rel: Relation, condition, graph) -> Relation:
    if isinstance(condition, A.Exists):
        return exists(rel, condition.pattern, condition.positive, graph)
    if isinstance(condition, A.Call) and condition.name == "and":
        return filtered(filtered(rel, condition.args[0], graph), condition.args[1], graph)
    if isinstance(condition, A.Call) and condition.name == "not" and isinstance(condition.args[0], A.Exists):
        x = condition.args[0]
        return exists(rel, x.pattern, not x.positive, graph)
    return Relation(rel.df.where(evaluate(condition, rel).truth()), rel.vars)


def unit(spark: SparkSession) -> Relation:
    return Relation(spark.range(1).select(F.lit(1).alias("_unit")), {})


# ---- graphs that patterns are matched against
class QuadGraph:
    """Triples of a table of quads: g, s_kind, s, p, o_kind, o, o_dt, o_lang."""

    def __init__(self, quads: DataFrame, graph_var: str | None = None):
        self.spark, self.quads, self.graph_var = quads.sparkSession, quads, graph_var
        self.steps: dict = {}

    def named(self, name: str) -> QuadGraph:
        return QuadGraph(self.quads.where(F.col("g") == name))

    def each_named(self, var: str) -> QuadGraph:
        """Every named graph by itself: the variable binds each triple's graph, so joined triples share it."""
        return QuadGraph(self.quads.where("g IS NOT NULL"), var)

    def bgp(self, triples: list) -> Relation:
        return by_triples(self, triples)

    def triple(self, t: A.Triple) -> Relation:
        df, cols, bounds, same = self.quads, {}, {}, []

        def bind(term, text, kind, datatype, lang, known):
            nonlocal df
            if isinstance(term, A.Var):
                n = term.name
                if n in cols:
                    same.append((cols[n], text))
                    return
                cols[n] = text
                bounds[n] = Bound(kind=known)
                df = df.withColumns({n + "~0": text, n + "~1": kind, n + "~2": datatype, n + "~3": lang})
            elif isinstance(term, A.Iri):
                df = df.where((text == term.value) & (kind == "I"))
            else:
                df = df.where((text == term.value) & (kind == "L") & datatype.eqNullSafe(F.lit(term.datatype)) & lang.eqNullSafe(F.lit(term.lang).cast("string")))

        nothing = F.lit(None).cast("string")
        if isinstance(t.p, A.Link):
            df = df.where(F.col("p") == t.p.iri)
        else:
            bind(t.p, F.col("p"), F.lit("I"), nothing, nothing, "I")
        bind(t.s, F.col("s"), F.col("s_kind"), nothing, nothing, None)
        bind(t.o, F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"), None)
        if self.graph_var:
            bind(A.Var(self.graph_var), F.col("g"), F.lit("I"), nothing, nothing, "I")
        for a, b in same:
            df = df.where(a == b)
        out = df.select(*[_c(f"{n}~{i}").alias(n + p) for n in bounds for i, p in enumerate(PARTS)]) if bounds else df.select(F.lit(1).alias("_unit"))
        return Relation(out, bounds)

    def nodes(self) -> DataFrame:
        q = self.quads
        none = F.lit(None).cast("string")
        ends = q.select(F.col("s").alias("x"), F.col("s_kind").alias("x#k"), none.alias("x#d"), none.alias("x#g"))
        return ends.union(q.select("o", "o_kind", "o_dt", "o_lang")).distinct()


def by_triples(graph, triples: list) -> Relation:
    """Triples one by one; a path is taken apart, and a closure starts from what is bound before it."""
    return joined(graph.spark, [(_names(t), _has_repeat(t.p), lambda rel, t=t: _with_path(graph, rel, t)) for t in triples])


def _names(t: A.Triple) -> set[str]:
    """The variables of a triple pattern."""
    return {x.name for x in (t.s, t.p, t.o) if isinstance(x, A.Var)}


def joined(spark: SparkSession, parts: list[tuple[set[str], bool, Callable]]) -> Relation:
    """Patterns joined one by one: (variables, whether it is a repeated path, how it joins a relation).

    The next one shares a variable with those before it, plain ones before repeated paths, which then start from
    what is bound. Only what shares none with anything is multiplied, and then as a whole, at the end.
    """
    out, left = unit(spark), list(parts)
    while left:
        rel, bound = unit(spark), set()
        while True:
            ready = [p for p in left if p[0] & bound or not p[0]] if bound else left[:1] if all(p[1] for p in left) else [p for p in left if not p[1]][:1]
            if not ready:
                break
            nearest = min(ready, key=lambda p: p[1])
            left.remove(nearest)
            rel = nearest[2](rel)
            bound |= nearest[0]
            if not left:
                break
        out = join(out, rel)
    return out


_fresh = 0


def _new_var() -> A.Var:
    global _fresh
    _fresh += 1
    return A.Var(f"_p{_fresh}")


def _with_path(graph, rel: Relation, t: A.Triple) -> Relation:
    p = t.p
    if isinstance(p, (A.Var, A.Link)):
        return join(rel, graph.triple(t))
    if isinstance(p, A.Inverse):
        return _with_path(graph, rel, A.Triple(t.o, p.path, t.s))
    if isinstance(p, A.Sequence):
        here = t.s
        for i, part in enumerate(p.parts):
            there = t.o if i == len(p.parts) - 1 else _new_var()
            rel = _with_path(graph, rel, A.Triple(here, part, there))
            here = there
        return rel
    if isinstance(p, A.Alternative):
        return join(rel, union([_with_path(graph, unit(graph.spark), A.Triple(t.s, x, t.o)) for x in p.parts]))
    return join(rel, _repeated(graph, rel, t))


def _repeated(graph, rel: Relation, t: A.Triple) -> Relation:
    p: A.Repeat = t.p
    if getattr(graph, "graph_var", None):
        raise ValueError("unsupported: a repeated path under a variable graph")
    pack = lambda n: F.struct(*[_c(n + x).alias(y) for x, y in zip(PARTS, ("t", "k", "d", "g"), strict=True)])
    if p.path not in graph.steps:  # closures over one path share its edges
        a, b = A.Var("_a"), A.Var("_b")
        found = as_term(as_term(_with_path(graph, unit(graph.spark), A.Triple(a, p.path, b)), "_a"), "_b").df
        graph.steps[p.path] = prepared(found.select(pack("_a").alias("a"), pack("_b").alias("b")))
    edges = graph.steps[p.path]
    if isinstance(t.s, A.Var) and t.s.name in rel.vars:
        seeds = as_term(rel, t.s.name).df.where(_c(t.s.name).isNotNull()).select(pack(t.s.name).alias("a"))
    elif isinstance(t.s, A.Iri):
        seeds = graph.spark.range(1).select(F.struct(F.lit(t.s.value).alias("t"), F.lit("I").alias("k"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("g")).alias("a"))
    else:
        seeds = graph.nodes().select(F.struct(*[_c("x" + x).alias(y) for x, y in zip(PARTS, ("t", "k", "d", "g"), strict=True)]).alias("a"))
    if p.most == 1:
        once = edges.select(F.col("_from").alias("a"), F.col("_to").alias("b"))
        pairs = seeds.distinct().select("a", F.col("a").alias("b")).unionByName(once.join(seeds.distinct(), "a", "left_semi")).distinct()
    else:
        pairs = closure(edges, seeds, reflexive=p.least == 0)
    out = Relation(pairs, {})
    for name, end in ((t.s, "a"), (t.o, "b")):
        if isinstance(name, A.Var):
            out = Relation(out.df.withColumns({name.name + x: F.col(f"{end}.{y}") for x, y in zip(PARTS, ("t", "k", "d", "g"), strict=True)}), out.vars | {name.name: Bound()})
        else:
            out = Relation(out.df.where((F.col(f"{end}.t") == name.value) & (F.col(f"{end}.k") == ("I" if isinstance(name, A.Iri) else "L"))), out.vars)
    return out.slim() if out.vars else Relation(out.df.select(F.lit(1).alias("_unit")), {})


# ---- patterns and queries
def compile_pattern(node, graph) -> Relation:
    if isinstance(node, A.Unit):
        return unit(graph.spark)
    if isinstance(node, A.Bgp):
        return graph.bgp(node.triples)
    if isinstance(node, A.Join):
        left = compile_pattern(node.left, graph)
        if isinstance(node.right, A.Bgp) and any(_has_repeat(t.p) for t in node.right.triples):
            rel = left
            for t in node.right.triples:
                rel = _with_path(graph, rel, t)
            return rel
        return join(left, compile_pattern(node.right, graph))
    if isinstance(node, A.Optional):
        return join(compile_pattern(node.left, graph), compile_pattern(node.right, graph), "left", node.condition)
    if isinstance(node, A.Union):
        return union([compile_pattern(x, graph) for x in node.parts])
    if isinstance(node, A.Minus):
        return minus(compile_pattern(node.left, graph), compile_pattern(node.right, graph))
    if isinstance(node, A.Filter):
        return filtered(compile_pattern(node.child, graph), node.condition, graph)
    if isinstance(node, A.Extend):
        child = compile_pattern(node.child, graph)
        return put(child, node.var, evaluate(node.expression, child))
    if isinstance(node, A.Values):
        return _values(node, graph.spark)
    if isinstance(node, A.Graph):
        return compile_pattern(node.child, graph.named(node.name.value) if isinstance(node.name, A.Iri) else graph.each_named(node.name.name))
    if isinstance(node, A.Select):
        return select(node, graph)
    raise ValueError(f"unsupported pattern {type(node).__name__}")


def _has_repeat(p) -> bool:
    if isinstance(p, A.Repeat):
        return True
    return any(map(_has_repeat, p.parts)) if isinstance(p, (A.Sequence, A.Alternative)) else False


def _values(node: A.Values, spark: SparkSession) -> Relation:
    rows, bounds, fields = [], {}, []
    for i, n in enumerate(node.names):
        terms = [r[i] for r in node.rows]
        if all(isinstance(t, A.Lit) and t.datatype == STRING for t in terms):
            bounds[n] = Bound(datatype=STRING)
            fields.append(f"`{n}` string")
        else:
            kinds = {"I" if isinstance(t, A.Iri) else "L" for t in terms if t is not None}
            bounds[n] = Bound(maybe=None in terms, kind=kinds.pop() if len(kinds) == 1 else None)
            fields += [f"`{n}{p}` string" for p in PARTS]
    for r in node.rows:
        row: list = []
        for n, t in zip(node.names, r, strict=True):
            if bounds[n].native:
                row.append(t.value)
            elif t is None:
                row += [None] * 4
            else:
                row += [t.value, "I", None, None] if isinstance(t, A.Iri) else [t.value, "L", t.datatype, t.lang]
        rows.append(tuple(row))
    return Relation(spark.createDataFrame(rows, ", ".join(fields)), bounds)


def _aggregates(e, found: list) -> object:
    """An expression with its aggregates replaced by variables."""
    if isinstance(e, A.Aggregate):
        if e not in found:
            found.append(e)
        return A.Var(f"_g{found.index(e)}")
    if isinstance(e, A.Call):
        return A.Call(e.name, tuple(_aggregates(x, found) for x in e.args))
    return e


def _grouped(q: A.Select, rel: Relation) -> tuple[Relation, A.Select]:
    found: list = []
    extend = [(n, _aggregates(e, found)) for n, e in q.extend]
    having = [_aggregates(e, found) for e in q.having]
    order = [(_aggregates(e, found), up) for e, up in q.order]
    keys = [v for v in q.group or [] if v in rel.vars]
    cols, bounds = [], {v: rel.vars[v] for v in keys}
    for i, a in enumerate(found):
        name = f"_g{i}"
        v = evaluate(a.arg, rel) if a.arg is not None else None
        if a.name == "COUNT":
            if v is None:
                c = F.countDistinct(*[_c(x) for x in rel.columns()]) if a.distinct else F.count(F.lit(1))
            else:
                c = F.countDistinct(F.when(v.col.isNotNull(), F.struct(*v.term())) if v.what == "term" else v.col) if a.distinct else F.count(v.col)
            bounds[name] = Bound(datatype=INTEGER)
        elif a.name in ("SUM", "AVG"):
            f = {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg, ("AVG", True): lambda x: F.try_divide(F.sum_distinct(x), F.countDistinct(x))}[a.name, a.distinct]
            c = F.coalesce(f(v.number()), F.lit(0))
            bounds[name] = Bound(datatype=v.datatype if a.name == "SUM" and isinstance(v.datatype, str) else DOUBLE)
        elif a.name in ("MIN", "MAX"):
            c = {"MIN": F.min, "MAX": F.max}[a.name](v.col)
            bounds[name] = Bound(v.template, None if v.what == "iri" else v.datatype if isinstance(v.datatype, str) else STRING, maybe=True)
        elif a.name == "SAMPLE":
            c = F.min(v.col)  # any will do; the least is the same in every run
            bounds[name] = Bound(v.template, None if v.what == "iri" else v.datatype if isinstance(v.datatype, str) else STRING, maybe=True)
        else:  # GROUP_CONCAT, in order of the texts, so that every run agrees
            items = F.collect_set(v.text()) if a.distinct else F.collect_list(v.text())
            c = F.array_join(F.array_sort(items), a.separator)
            bounds[name] = Bound(datatype=STRING)
        cols.append(c.alias(name))
    key_columns = [c for v in keys for c in rel.vars[v].columns(v)]
    cols = cols or [F.count(F.lit(1)).alias("_n")]
    df = rel.df.groupBy(*[_c(c) for c in key_columns]).agg(*cols) if key_columns else rel.df.agg(*cols)
    return Relation(df, bounds), replace(q, extend=extend, having=having, order=order)


def _has_aggregate(e) -> bool:
    return isinstance(e, A.Aggregate) or isinstance(e, A.Call) and any(map(_has_aggregate, e.args))


def select(q: A.Select, graph) -> Relation:
    rel = compile_pattern(q.pattern, graph)
    if q.group is not None or any(_has_aggregate(e) for _, e in q.extend) or q.having:
        rel, q = _grouped(q, rel)
    for h in q.having:
        rel = filtered(rel, h, graph)
    for n, e in q.extend:
        rel = put(rel, n, evaluate(e, rel))
    order = []
    for e, up in q.order:
        v = evaluate(e, rel)
        order.append(v.col.asc_nulls_first() if up else v.col.desc_nulls_last())
    names = [v for v in rel.vars if not v.startswith("_")] if q.names is None else q.names
    for n in names:
        if n not in rel.vars:
            rel = put(rel, n, variable(rel, n))
    if order and not q.distinct:
        rel = Relation(rel.df.orderBy(*order), rel.vars)
    rel = Relation(rel.df, {n: rel.vars[n] for n in names}).slim()
    if q.distinct:
        rel = Relation(rel.df.distinct(), rel.vars)
        if order:
            rel = Relation(rel.df.orderBy(*order), rel.vars)
    df = rel.df
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return Relation(df, rel.vars)


def solutions(rel: Relation, terms: bool = False) -> DataFrame:
    """The rows of a query: native literals with their types, everything else as text; with ``terms``, all four columns."""
    if terms:
        for v in rel.vars:
            rel = as_term(rel, v)
        return rel.slim().df
    return rel.df.select(*[(variable(rel, v).text() if b.template is not None else _c(v)).alias(v) for v, b in rel.vars.items()])
