"""Readers of Turtle, TriG, N3, N-Triples and N-Quads text, and the row form of quads.

A row is (g, s_kind, s, p, o_kind, o, o_dt, o_lang). Blank nodes are named after their
file, so that two files never share one.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

from weftgraph.functions.vocabulary import FIRST, NIL, OWL, RDF, REST, TYPE, XSD
from weftgraph.plans.sparql import unescape

STRING, LANG_STRING = XSD + "string", RDF + "langString"
QUAD = "g string, s_kind string, s string, p string, o_kind string, o string, o_dt string, o_lang string"


class ParseError(ValueError):
    """The text is not in the syntax it was read as."""


TOKEN = re.compile(
    r"""(?P<space>(?:\s|\#[^\n]*)+)
  | (?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  | (?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<directive>@(?:prefix|base|keywords|forSome|forAll)\b)
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<blank>_:[\w\u00b7][\w\u00b7.-]*)
  | (?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  | (?P<pname>(?:[^\W\d_][\w\u00b7.-]*)?:(?:(?:[\w:\u00b7-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:[\w:.\u00b7-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*)?)
  | (?P<var>\?[A-Za-z]\w*)
  | (?P<word>[A-Za-z]\w*)
  | (?P<op>\^\^|=>|<=|[{}()\[\].;,=^!])""",
    re.VERBOSE | re.DOTALL,
)


class Turtle:
    """Turtle and its relatives: ``graphs`` allows TriG's graphs, ``n3`` the shorthands = and => of N3."""

    def __init__(self, text: str, graph: str, base: str, label: str, graphs: bool = False, n3: bool = False):
        self.text, self.graph, self.base, self.label = text, graph, base, label
        self.graphs, self.n3 = graphs, n3
        self.prefixes: dict[str, str] = {"": base + "#"} if n3 else {}
        self.at, self.blanks, self.mark, self.out = 0, 0, "", []
        self.kind = self.token = ""
        self.advance()

    def advance(self) -> tuple[str, str]:
        was = self.kind, self.token
        while True:
            if self.at >= len(self.text):
                self.kind, self.token = "end", ""
                return was
            m = TOKEN.match(self.text, self.at)
            if not m:
                raise ParseError(f"unexpected text at {self.at}: {self.text[self.at:self.at + 30]!r}")
            self.at = m.end()
            if m.lastgroup == "space":
                continue
            self.kind, self.token = m.lastgroup, m[0]
            if self.kind in ("pname", "blank"):  # a dot at the end ends the statement
                extra = len(self.token) - len(self.token.rstrip("."))
                if extra:
                    self.at -= extra
                    self.token = self.token[:-extra]
            return was

    def take(self, *tokens: str) -> bool:
        if self.kind in ("op", "word") and self.token in tokens:
            self.advance()
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            raise ParseError(f"expected {token!r}, found {self.token!r} at {self.at}")

    def fresh(self) -> tuple:
        """A blank node without a label; no label has a tilde. ``mark`` tells pieces of one document apart."""
        self.blanks += 1
        return "B", f"{self.label}#b~{self.mark}{self.blanks}", None, None

    def parse(self) -> list[tuple]:
        while self.kind != "end":
            self.statement()
        return self.out

    def statement(self) -> None:
        low = self.token.lower()
        if self.kind == "directive" or self.kind == "word" and low in ("prefix", "base"):
            at = self.advance()[1].startswith("@")
            if "prefix" in low:
                name = self.advance()[1]
                self.prefixes[name[:-1]] = self.iri(*self.advance())
            elif "base" in low:
                self.base = self.iri(*self.advance())
            else:
                raise ParseError(f"unsupported directive {low}")
            if at:
                self.need(".")
            return
        if self.graphs and (self.token == "{" or self.kind == "word" and low == "graph"):
            if self.kind == "word":
                self.advance()
                self.block(self.subject()[1])
            else:
                self.block(self.graph)
            return
        s = self.subject()
        if self.graphs and self.token == "{":
            self.block(s[1])
            return
        if not (self.token == "." and self.kind == "op" and self.anonymous):
            self.predicates(s)
        self.need(".")

    def block(self, name: str) -> None:
        outer, self.graph = self.graph, name
        self.need("{")
        while not self.take("}"):
            s = self.subject()
            if self.token not in (".", "}"):
                self.predicates(s)
            self.take(".")
        self.graph = outer

    def subject(self) -> tuple:
        self.anonymous = self.token == "["
        t = self.term()
        if t[0] == "L" and not self.n3:
            raise ParseError(f"a literal can't be a subject: {t[1]!r}")
        return t

    def predicates(self, s: tuple) -> None:
        while True:
            swap = False
            if self.kind == "word" and self.token == "a":
                self.advance()
                p = TYPE
            elif self.n3 and self.take("="):
                p = OWL + "sameAs"
            elif self.n3 and self.take("=>"):
                p = "http://www.w3.org/2000/10/swap/log#implies"
            else:
                if self.n3 and self.kind == "word" and self.token == "is":
                    self.advance()
                    swap = True
                k = self.term()
                if k[0] != "I":
                    raise ParseError(f"a predicate must be an IRI, found {k[1]!r}")
                p = k[1]
                if swap:
                    self.need("of")
            while True:
                o = self.term()
                a, b = (o, s) if swap else (s, o)
                self.out.append((self.graph, a[0], a[1], p, b[0], b[1], b[2], b[3]))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.kind == "op" and self.token in (".", "]", "}") or self.kind == "end":
                return

    def term(self) -> tuple:
        kind, token = self.kind, self.token
        if token == "[" and kind == "op":
            self.advance()
            b = self.fresh()
            if not self.take("]"):
                self.predicates(b)
                self.need("]")
            return b
        if token == "(" and kind == "op":
            self.advance()
            items = []
            while not self.take(")"):
                items.append(self.term())
            head: tuple = ("I", NIL, None, None)
            for x in reversed(items):
                b = self.fresh()
                self.out.append((self.graph, "B", b[1], FIRST, *x))
                self.out.append((self.graph, "B", b[1], REST, *head))
                head = b
            return head
        self.advance()
        if kind in ("iri", "pname"):
            return "I", self.iri(kind, token), None, None
        if kind == "blank":
            return "B", f"{self.label}#{token[2:]}", None, None
        if kind == "str":
            body = unescape(token[3:-3] if token[:3] in ('"""', "'''") else token[1:-1])
            if self.kind == "lang":
                return "L", body, LANG_STRING, self.advance()[1][1:].lower()
            if self.take("^^"):
                return "L", body, self.iri(*self.advance()), None
            return "L", body, STRING, None
        if kind == "num":
            return "L", token, XSD + ("double" if "e" in token.lower() else "decimal" if "." in token else "integer"), None
        if kind == "word" and token in ("true", "false"):
            return "L", token, XSD + "boolean", None
        raise ParseError(f"expected a term, found {token!r} at {self.at}")

    def iri(self, kind: str, token: str) -> str:
        if kind == "iri":
            iri = unescape(token[1:-1]) if "\\" in token else token[1:-1]
            return iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else urljoin(self.base, iri) if iri else self.base
        prefix, sep, local = token.partition(":")
        if kind != "pname" or not sep or prefix not in self.prefixes:
            raise ParseError(f"unknown prefix in {token!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)


def read_turtle(text: str, graph: str, base: str, label: str) -> list[tuple]:
    return Turtle(text, graph, base, label).parse()


def read_trig(text: str, graph: str, base: str, label: str) -> list[tuple]:
    return Turtle(text, graph, base, label, graphs=True).parse()


def read_n3(text: str, graph: str, base: str, label: str) -> list[tuple]:
    return Turtle(text, graph, base, label, n3=True).parse()


# A statement of N-Triples or N-Quads on a line, as a regular expression that Python and Java take alike. Groups: 1, 2 the
# subject (IRI, blank), 3 the predicate, 4-8 the object (IRI, blank, literal, datatype, language), 9, 10 the graph (IRI, blank).
_CODE = r"\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|\\U(?!0000[dD][89a-fA-F])00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"
_S = r"[\x20\x09-\x0d]"
# What may be long is matched possessively, run by run: without a step back, and in Java without a frame for each character.
_IRI = rf"<((?!>)[^<>\x00-\x20\\]*+(?:(?:{_CODE})[^<>\x00-\x20\\]*+)*+)>"
_BLANK = r"_:([^\x00-\x20]+{0})"
_TEXT = rf"""\"([^"\\]*+(?:(?:\\[tbnrf"'\\]|{_CODE})[^"\\]*+)*+)\"(?:\^\^{_IRI}|@([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*))?"""
STATEMENT = rf"^{_S}*(?:{_IRI}|{_BLANK.format('')}){_S}*{_IRI}{_S}*(?:{_IRI}|{_BLANK.format('?')}|{_TEXT}){_S}*(?:{_IRI}|{_BLANK.format('?')})?{_S}*\.{_S}*(?:#[\s\S]*)?(?![\s\S])"
LINE = re.compile(STATEMENT)


def read_nquads(text: str, graph: str, base: str, label: str) -> list[tuple]:
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        line = line.strip("\r \t")
        if not line or line.startswith("#"):
            continue
        m = LINE.match(line)
        if not m:
            raise ParseError(f"line {n} is not a statement: {line[:60]!r}")
        s = ("I", unescape(m[1])) if m[1] is not None else ("B", f"{label}#{m[2]}")
        if m[6] is not None:
            o = ("L", unescape(m[6]), LANG_STRING if m[8] else unescape(m[7]) if m[7] else STRING, m[8].lower() if m[8] else None)
        else:
            o = ("I", unescape(m[4]), None, None) if m[4] is not None else ("B", f"{label}#{m[5]}", None, None)
        g = unescape(m[9]) if m[9] else f"{label}#{m[10]}" if m[10] else graph
        out.append((g, *s, unescape(m[3]), *o))
    return out


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def _blank(name: str) -> str:
    return "_:b" + re.sub(r"[^A-Za-z0-9]", "_", name.rsplit("/", 1)[-1])


def nt_term(kind: str, value: str, dt: str | None = None, lang: str | None = None) -> str:
    if kind == "I":
        return f"<{value}>"
    if kind == "B":
        return _blank(value)
    tail = f"@{lang}" if lang else "" if dt in (None, STRING) else f"^^<{dt}>"
    return f'"{escape(value)}"{tail}'


def write_turtle(rows: list[tuple], prefixes: dict[str, str] | None = None) -> str:
    """Rows of one graph as Turtle: statements by subject."""
    names = {ns: p for p, ns in (prefixes or {}).items()}

    def term(kind, value, dt=None, lang=None):
        if kind == "I":
            for ns, p in names.items():
                if value.startswith(ns) and re.fullmatch(r"[A-Za-z_][\w-]*", value[len(ns):]):
                    return f"{p}:{value[len(ns):]}"
        if kind == "L" and dt and not lang and dt != STRING:
            return f'"{escape(value)}"^^{term("I", dt)}'
        return nt_term(kind, value, dt, lang)

    by: dict = {}
    for _, sk, s, p, *o in sorted(rows, key=lambda r: tuple(x or "" for x in r)):
        by.setdefault((sk, s), []).append((p, o))
    out = [f"@prefix {p}: <{ns}> ." for ns, p in names.items()]
    for s, facts in by.items():
        lines = [f"    {'a' if p == TYPE else term('I', p)} {term(*o)}" for p, o in facts]
        out.append(f"\n{term(*s)}\n" + " ;\n".join(lines) + " .")
    return "\n".join(out) + "\n"


def write_trig(rows: list[tuple], prefixes: dict[str, str] | None = None) -> str:
    graphs: dict = {}
    for r in rows:
        graphs.setdefault(r[0], []).append(r)
    head = [f"@prefix {p}: <{ns}> ." for p, ns in (prefixes or {}).items()]
    out = []
    for g, part in sorted(graphs.items()):
        body = [x for x in write_turtle(part, prefixes).split("\n") if not x.startswith("@prefix")]
        out.append(f"<{g}> {{\n" + "\n".join(body) + "}\n")
    return "\n".join(head + out)


def write_nquads(rows: list[tuple], graphs: bool = True) -> str:
    return "".join(f"{nt_term(sk, s)} <{p}> {nt_term(*o)}{f' <{g}>' if graphs else ''} .\n" for g, sk, s, p, *o in rows)
