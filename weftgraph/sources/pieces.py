"""Turtle of any size: read by many tasks in pieces, and written by all tasks.

Reading. Spark's text reader deals the lines of a document by splits (byte ranges). A token other than a long
string ends in its line, so whether a line begins in a long string is all that a split has to be told:

1 of each split with marks of long strings, the state it ends in is found for each state it may begin in; the
  driver puts these together;
2 each split tells its first and last end of a statement, the text before the one and after the other, and the
  prefixes and bases that it declares; a statement over a border is put together from such texts, over any number of splits;
3 what lies between is parsed where it is, some thousand lines at a time, with the prefixes that are in force there.

The driver holds a row for each split and the document's declarations. A task holds some thousand lines, or one
statement if that is longer. A line is the least that is split. What can't be parsed is halved until single
statements are left; these are reported, and the document's others are kept. An empty document gives no rows.

Writing. Quads are dealt by ranges of (subject, predicate, object) and streamed, so no subject is gathered; statements
end after ``MOST`` objects. Each file is a Turtle document with its prefixes; blank nodes have the same label in all.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.vocabulary import PREFIXES, TYPE
from weftgraph.session import cut, cut_table, ship
from weftgraph.sources.turtle import QUAD, STRING, TOKEN, Turtle, escape

#: Lines that are parsed at a time, and searched for the last end of a statement.
PIECE = 4000
#: Objects of a statement that is written.
MOST = 1000
#: Lines of statements over borders are numbered from here, after all lines of the split they begin in.
AFTER = 1 << 40
CLOSING = {'"""': re.compile(r'(?:[^"\\]++|\\.|"(?!""))*+"""'), "'''": re.compile(r"(?:[^'\\]++|\\.|'(?!''))*+'''")}
STATES = ("", *CLOSING)
DECLARES = re.compile(r"prefix|base", re.IGNORECASE)
TOLD = "struct<line: long, col: int, base: boolean, name: string, iri: string>"


def tokens(line: str, state: str) -> tuple[list[tuple[int, int, str, str]], str]:
    """(start, end, kind, token) of a line that begins in ``state``, without strings; and the state it ends in.

    A state is the mark of the long string that is open, or empty. Text that is no token is passed over: the parser reports it.
    """
    at, out = 0, []
    while at < len(line):
        if state:
            m = CLOSING[state].match(line, at)
            if not m:
                return out, state
            at, state = m.end(), ""
            continue
        if line[at : at + 3] in CLOSING:
            state, at = line[at : at + 3], at + 3
            continue
        m = TOKEN.match(line, at)
        if not m:
            at += 1
            continue
        kind, token = m.lastgroup, m[0]
        if kind in ("pname", "blank"):
            token = token.rstrip(".")
        if kind not in ("space", "str"):
            out.append((at, at + len(token), kind, token))
        at += len(token)
    return out, state


def state_after(line: str, state: str) -> str:
    return tokens(line, state)[1] if '"""' in line or "'''" in line else state


def ends(line: str, state: str) -> list[int]:
    """Columns after the dots that end statements."""
    return [e for _, e, kind, token in tokens(line, state)[0] if kind == "op" and token == "."] if "." in line else []


class Declarations:
    """The prefixes and bases that lines declare, each with its place."""

    def __init__(self):
        self.out, self.open = [], None

    def look(self, n: int, line: str, state: str) -> None:
        if self.open is None and not DECLARES.search(line):
            return
        for at, _, kind, token in tokens(line, state)[0]:
            word = token.lower().lstrip("@")
            if kind in ("directive", "word") and word in ("prefix", "base"):
                self.open = {"line": n, "col": at, "base": word == "base", "name": None}
            elif self.open and kind == "pname" and not self.open["base"] and self.open["name"] is None:
                self.open["name"] = token[:-1]
            elif self.open and kind == "iri":
                self.out.append(self.open | {"iri": token})
                self.open = None
            else:
                self.open = None


class Piece:
    """Lines from a place on, each with the state it begins in; the first may lack what stands before its column."""

    def __init__(self, line: int, col: int = 0):
        self.line, self.col, self.lines, self.states = line, col, [], []

    def add(self, line: str, state: str) -> None:
        self.lines.append(line)
        self.states.append(state)

    def split(self, i: int, col: int) -> tuple[Piece, Piece]:
        left, right = Piece(self.line, self.col), Piece(self.line + i, col + (self.col if i == 0 else 0))
        left.lines, left.states = [*self.lines[:i], self.lines[i][:col]], self.states[: i + 1]
        right.lines, right.states = [self.lines[i][col:], *self.lines[i + 1 :]], ["", *self.states[i + 1 :]]
        return left, right

    def last_end(self) -> tuple[int, int] | None:
        for i in range(len(self.lines) - 1, -1, -1):
            found = ends(self.lines[i], self.states[i])
            if found:
                return i, found[-1]
        return None

    def middle(self) -> tuple[int, int] | None:
        """An end of a statement near the middle, with something on both sides."""
        for i in sorted(range(len(self.lines)), key=lambda i: abs(i - len(self.lines) // 2)):
            for col in ends(self.lines[i], self.states[i]):
                if self.lines[i][col:].strip() or any(x.strip() for x in self.lines[i + 1 :]):
                    return i, col
        return None

    @property
    def text(self) -> str:
        return "\n".join(self.lines)


def _splits(batches):
    """((file, block), its lines) of batches of (value, file, block), whose splits come one after the other."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for (file, block), part in groupby(rows, key=lambda r: (r[1], r[2])):
        yield file, block, (r[0].removeprefix("\ufeff") if block == 0 and i == 0 else r[0] for i, r in enumerate(part))


class Known:
    """What is known of a document's splits, for lookup by (file, block)."""

    def __init__(self, rows: list[tuple]):
        self.rows = sorted(rows, key=lambda r: r[:2])
        self.places = [r[:2] for r in self.rows]

    def before(self, file: str, block: int):
        """The last row of the file in an earlier block."""
        i = bisect_left(self.places, (file, block)) - 1
        return self.rows[i] if i >= 0 and self.rows[i][0] == file else None

    def at(self, file: str, block: int):
        return self.rows[bisect_left(self.places, (file, block))]


def _states(lines: DataFrame) -> Known:
    """(file, block, state after) of the splits that marks of long strings occur in."""

    def run(batches):
        for file, block, part in _splits(batches):
            now = {s: s for s in STATES}
            for line in part:
                after = {s: tokens(line, s)[1] for s in set(now.values())}
                now = {s: after[x] for s, x in now.items()}
            yield pa.RecordBatch.from_pydict({"file": [file], "block": pa.array([block], pa.int64()), "states": [[now[s] for s in STATES]]})

    marked = lines.where(F.contains("value", F.lit('"""')) | F.contains("value", F.lit("'''")))
    rows, state, of = [], "", None
    for r in sorted(marked.mapInArrow(run, "file string, block long, states array<string>").collect(), key=lambda r: r[:2]):  # a row for each split
        state = r["states"][STATES.index(state if r["file"] == of else "")]
        of = r["file"]
        rows.append((of, r["block"], state))
    return Known(rows)


BORDERS = f"file string, block long, first_line long, first_col int, last_line long, last_col int, head string, tail string, told array<{TOLD}>"


def _border(block: int, lines, state: str) -> tuple:
    """A split's first and last end of a statement, the text before and after them, and the declarations between."""
    first, last = ((0, 0), (0, 0)) if block == 0 else (None, None)
    head, told, rest = [], Declarations(), Piece(0)
    tail: list[str] = []

    def search() -> None:
        nonlocal last, tail
        found = rest.last_end()
        if found:
            right = rest.split(*found)[1]
            last, tail = (right.line, right.col), right.lines
        else:
            tail += rest.lines

    for n, line in enumerate(lines):
        told.look(n, line, state)
        if first is None:
            found = ends(line, state)
            head.append(line[: found[0]] if found else line)
            if found:
                first = last = (n, found[0])
                rest = Piece(n, found[0])
                rest.add(line[found[0] :], "")
        else:
            rest.add(line, state)
        state = state_after(line, state)
        if len(rest.lines) >= PIECE:
            search()
            rest = Piece(n + 1)
    search()
    inside = [x for x in told.out if first is not None and first <= (x["line"], x["col"]) < last]
    return *(first or (None, None)), *(last or (None, None)), "\n".join(head), "\n".join(tail), inside


DECLARED = [("line", pa.int64()), ("col", pa.int32()), ("base", pa.bool_()), ("name", pa.string()), ("iri", pa.string())]


def _borders(lines: DataFrame, states) -> DataFrame:
    places = [("file", pa.string()), ("block", pa.int64()), ("first_line", pa.int64()), ("first_col", pa.int32()), ("last_line", pa.int64()), ("last_col", pa.int32())]
    schema = pa.schema([*places, ("head", pa.string()), ("tail", pa.string()), ("told", pa.list_(pa.struct(DECLARED)))])

    def run(batches):
        for file, block, part in _splits(batches):
            before = states.value.before(file, block)
            row = (file, block, *_border(block, part, before[2] if before else ""))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

    return lines.mapInArrow(run, BORDERS)


def _told_over(batches):
    """The declarations in statements over borders."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), *DECLARED])
    for batch in batches:
        for file, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            told, state = Declarations(), ""
            for n, line in enumerate(text.split("\n")):
                told.look(AFTER + n, line, state)
                state = state_after(line, state)
            for x in told.out:
                yield pa.RecordBatch.from_pylist([{"file": file, "block": block} | x], schema=schema)


class Scope:
    """The prefixes and the base in force at a place of a file."""

    def __init__(self, rows: list, base_of):
        self.base_of, self.places, self.values = base_of, {}, {}
        readers: dict[str, Turtle] = {}
        for r in sorted(rows, key=lambda r: (r["file"], r["block"], r["line"], r["col"])):
            reader = readers.setdefault(r["file"], Turtle("", "", base_of(r["file"]), ""))
            iri = reader.iri("iri", r["iri"])
            if r["base"]:
                reader.base = iri
            self.places.setdefault(r["file"], []).append((r["block"], r["line"], r["col"]))
            self.values.setdefault(r["file"], []).append((None if r["base"] else r["name"], iri))

    def at(self, file: str, block: int, line: int, col: int) -> tuple[str, dict[str, str]]:
        base, prefixes = self.base_of(file), {}
        for name, iri in self.values.get(file, [])[: bisect_left(self.places.get(file, []), (block, line, col))]:
            if name is None:
                base = iri
            else:
                prefixes[name] = iri
        return base, prefixes


def _parse(piece: Piece, file: str, block: int, graph: str, label: str, scope: Scope):
    """Rows of a piece, and what can't be read: (quad and two nulls) or (graph, nulls, severity, message)."""
    base, prefixes = scope.at(file, block, piece.line, piece.col)
    try:
        reader = Turtle(piece.text, graph, base, label)
        reader.prefixes, reader.mark = prefixes, f"{block}~{piece.line}~{piece.col}~"
        for row in dict.fromkeys(reader.parse()):
            yield (*row, None, None)
    except (ValueError, KeyError, IndexError, TypeError, RecursionError) as e:
        at = piece.middle()
        if at is None:
            yield (graph, *[None] * 7, "Critical", f"{label}: {str(e)[:200]} in a statement: {piece.text.strip()[:60]!r}")
            return
        for part in piece.split(*at):
            yield from _parse(part, file, block, graph, label, scope)


FOUND = QUAD + ", severity string, message string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], names=names)


def _inside(file: str, block: int, lines, state: str, known: tuple):
    """The pieces between a split's first and last end of a statement."""
    (first, last), piece = (known[2:4], known[4:6]), None
    if first[0] is None:
        return
    for n, line in enumerate(lines):
        if n > last[0]:
            break
        if n == first[0]:
            piece = Piece(*first)
        if piece is not None:
            a, b = first[1] if n == first[0] else 0, last[1] if n == last[0] else len(line)
            piece.add(line[a:b], "" if n == first[0] else state)
            if len(piece.lines) % PIECE == 0 and n < last[0]:
                at = piece.last_end()
                if at is not None:
                    done, piece = piece.split(*at)
                    yield done
        state = state_after(line, state)
    if piece is not None:
        yield piece


def _name(file: str) -> str:
    return file.rsplit("/", 1)[-1]


def read_turtle_pieces(spark: SparkSession, path: str, graph: str, base: str | None = None, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Quads of Turtle documents of any size, and diagnostics. ``base`` is each file's own location where none is given.

    Blank nodes are named after their file, or after ``label``, by which files share them.
    """
    ship(spark)
    share = spark.sparkContext.broadcast
    base_of = (lambda file: base) if base else (lambda file: re.sub("^file:/+", "file:/", file))
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    states = share(_states(lines))
    borders = cut(_borders(lines, states))
    places = ("file", "block", "first_line", "first_col", "last_line", "last_col")
    known = share(Known([tuple(r) for r in borders.select(*places).collect()]))  # a row for each split
    # statements over borders: the tail of a split with an end, and the heads up to the next such split's
    closed = share(Known([r[:2] for r in known.value.rows if r[2] is not None]))

    def begins(batches):
        for batch in batches:
            at = [closed.value.before(f, b)[1] for f, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int64()), batch.column(1), batch.column(2)], names=["file", "begin", "block", "text"])

    heads = borders.where("block > 0").select("file", "block", F.col("head").alias("text")).mapInArrow(begins, "file string, begin long, block long, text string")
    tails = borders.where("last_line IS NOT NULL").select("file", F.col("block").alias("begin"), "block", F.col("tail").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
    joined = tails.withColumn("kind", F.lit(1)).unionByName(heads.withColumn("kind", F.lit(0))).groupBy("file", "begin").agg(parts.alias("parts"))
    over = cut(joined.select("file", F.col("begin").alias("block"), F.array_join(F.col("parts.text"), "\n").alias("text")).where(F.col("text").rlike(r"\S")))
    told = borders.select("file", "block", F.explode("told").alias("x")).select("file", "block", "x.*")
    told = told.unionByName(over.where(F.col("text").rlike("(?i)prefix|base")).mapInArrow(_told_over, "file string, block long, line long, col int, base boolean, name string, iri string"))
    scope = Scope(told.collect(), base_of)  # the documents' declarations
    shared = share(scope.values), share(scope.places)

    def in_force() -> Scope:
        out = Scope([], base_of)
        out.values, out.places = shared[0].value, shared[1].value
        return out

    def inside(batches):
        scope = in_force()
        for file, block, part in _splits(batches):
            before = states.value.before(file, block)
            for piece in _inside(file, block, part, before[2] if before else "", known.value.at(file, block)):
                rows = list(_parse(piece, file, block, graph, label or _name(file), scope))
                if rows:
                    yield _batch(rows)

    def across(batches):
        scope = in_force()
        for batch in batches:
            for file, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece, state = Piece(AFTER), ""
                for line in text.split("\n"):
                    piece.add(line, state)
                    state = state_after(line, state)
                rows = list(_parse(piece, file, block, graph, label or _name(file), scope))
                if rows:
                    yield _batch(rows)

    found = cut_table(lines.mapInArrow(inside, FOUND).unionByName(over.mapInArrow(across, FOUND)))
    quads = found.where("severity IS NULL").drop("severity", "message").dropDuplicates()
    notes = found.where("severity IS NOT NULL").select(F.current_timestamp().cast("string").alias("timestamp"), "severity", F.lit("Parser").alias("error_type"), "message")
    return quads, notes


LOCAL = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
UNFIT = re.compile(r'[\x00-\x20<>"{}|^`\\]')


class Terms:
    """Terms as Turtle. Blank nodes get a label from their whole name, so that no two share one."""

    def __init__(self, prefixes: dict[str, str]):
        self.names = {ns: p for p, ns in prefixes.items()}

    def iri(self, iri: str) -> str:
        at = max(iri.rfind("#"), iri.rfind("/")) + 1
        if iri[:at] in self.names and LOCAL.fullmatch(iri, at):
            return f"{self.names[iri[:at]]}:{iri[at:]}"
        return "<" + UNFIT.sub(lambda m: f"\\u{ord(m[0]):04X}", iri) + ">"

    def term(self, kind: str, value: str, dt: str | None = None, lang: str | None = None) -> str:
        if kind == "I":
            return self.iri(value)
        if kind == "B":
            return "_:b" + value.encode("utf-8", "surrogatepass").hex()
        return f'"{escape(value)}"' + (f"@{lang}" if lang else "" if dt in (None, STRING) else f"^^{self.iri(dt)}")


def write_turtle_pieces(quads: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """One graph as Turtle files, each a document, written by all tasks: for graphs of any size."""
    names = PREFIXES if prefixes is None else prefixes
    order = ["s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang"]

    def run(batches):
        write, header = Terms(names), [f"@prefix {p}: <{ns}> ." for p, ns in names.items()]
        subject = predicate = line = None
        told = 0
        for batch in batches:
            out, header = header, []
            for sk, s, p, *o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = (sk, s) == subject and told < MOST
                if line is not None:
                    out.append(line + (" ." if not same else " ," if p == predicate else " ;"))
                told = told + 1 if same else 1
                verb = "a" if p == TYPE else write.iri(p)
                line = f"        {write.term(*o)}" if same and p == predicate else f"    {verb} {write.term(*o)}" if same else f"{write.term(sk, s)} {verb} {write.term(*o)}"
                subject, predicate = (sk, s), p
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        if line is not None:
            yield pa.RecordBatch.from_pydict({"value": [line + " ."]})

    ship(quads.sparkSession)
    n = int(quads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = quads.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed.mapInArrow(run, "value string").write.mode("overwrite").text(path)
