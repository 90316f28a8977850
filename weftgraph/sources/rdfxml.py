"""RDF/XML and JSON-LD, both ways."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from urllib.parse import urljoin
from xml.sax.saxutils import escape as xml_escape

from weftgraph.functions.vocabulary import FIRST, NIL, PREFIXES, RDF, REST, TYPE, XML, XSD
from weftgraph.sources.turtle import LANG_STRING, STRING, ParseError


def _entities(text: str) -> str:
    """Text with the entities that its document type declares put in."""
    declared = dict(re.findall(r'<!ENTITY\s+([\w.-]+)\s+"([^"]*)"\s*>', text))
    declared |= dict(re.findall(r"<!ENTITY\s+([\w.-]+)\s+'([^']*)'\s*>", text))
    for _ in range(3):
        text = re.sub(r"&([\w.-]+);", lambda m: declared.get(m[1], m[0]), text)
    return text


class RdfXml:
    def __init__(self, text: str, graph: str, base: str, label: str):
        self.graph, self.label, self.blanks, self.out = graph, label, 0, []
        try:
            root = ET.fromstring(_entities(text))
        except ET.ParseError as e:
            raise ParseError(str(e)) from e
        base = root.get(f"{{{XML}}}base", base)
        lang = root.get(f"{{{XML}}}lang")
        if root.tag == f"{{{RDF}}}RDF":
            for x in root:
                self.node(x, base, lang)
        elif "}" in root.tag:
            self.node(root, base, lang)
        else:
            raise ParseError("no RDF element")

    def add(self, s, p, o) -> None:
        self.out.append((self.graph, *s[:2], p, *o))

    def fresh(self):
        self.blanks += 1
        return "B", f"{self.label}#b{self.blanks}", None, None

    @staticmethod
    def name(tag: str) -> str:
        ns, _, local = tag[1:].partition("}")
        return ns + local

    def resolve(self, iri: str, base: str) -> str:
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
            return iri
        return base.split("#")[0] if iri == "" else base.split("#")[0] + iri if iri.startswith("#") else urljoin(base, iri)

    def node(self, x, base, lang):
        base, lang = x.get(f"{{{XML}}}base", base), x.get(f"{{{XML}}}lang", lang)
        about, ident, node_id = (x.get(f"{{{RDF}}}{k}") for k in ("about", "ID", "nodeID"))
        if about is not None:
            s = ("I", self.resolve(about, base), None, None)
        elif ident is not None:
            s = ("I", self.resolve("#" + ident, base), None, None)
        else:
            s = ("B", f"{self.label}#{node_id}", None, None) if node_id else self.fresh()
        if x.tag != f"{{{RDF}}}Description":
            self.add(s, TYPE, ("I", self.name(x.tag), None, None))
        for k, v in x.attrib.items():
            if k.startswith(f"{{{RDF}}}") and k[len(RDF) + 2 :] in ("about", "ID", "nodeID") or k.startswith(f"{{{XML}}}") or "}" not in k:
                continue
            self.add(s, self.name(k), ("I", self.resolve(v, base), None, None) if self.name(k) == TYPE else ("L", v, LANG_STRING if lang else STRING, lang))
        item = 0
        for child in x:
            p = self.name(child.tag)
            if p == RDF + "li":
                item += 1
                p = f"{RDF}_{item}"
            self.property(s, p, child, base, lang)
        return s

    def property(self, s, p, x, base, lang) -> None:
        base, lang = x.get(f"{{{XML}}}base", base), x.get(f"{{{XML}}}lang", lang)
        resource, node_id, kind, dt = (x.get(f"{{{RDF}}}{k}") for k in ("resource", "nodeID", "parseType", "datatype"))
        if resource is not None:
            o = ("I", self.resolve(resource, base), None, None)
        elif node_id is not None:
            o = ("B", f"{self.label}#{node_id}", None, None)
        elif kind == "Collection":
            items = [self.node(c, base, lang) for c in x]
            o = ("I", NIL, None, None)
            for i in reversed(items):
                b = self.fresh()
                self.add(b, FIRST, i)
                self.add(b, REST, o)
                o = b
        elif kind == "Resource":
            o = self.fresh()
            for c in x:
                self.property(o, self.name(c.tag), c, base, lang)
        elif kind == "Literal":
            inner = (x.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in x)
            o = ("L", inner, RDF + "XMLLiteral", None)
        elif len(x):
            o = self.node(x[0], base, lang)
        elif dt is not None:
            o = ("L", x.text or "", self.resolve(dt, base), None)
        else:
            o = ("L", x.text or "", LANG_STRING if lang else STRING, lang.lower() if lang else None)
        self.add(s, p, o)
        if (ident := x.get(f"{{{RDF}}}ID")) is not None:
            r = ("I", self.resolve("#" + ident, base), None, None)
            self.add(r, TYPE, ("I", RDF + "Statement", None, None))
            for k, v in (("subject", s), ("predicate", ("I", p, None, None)), ("object", o)):
                self.add(r, RDF + k, v)


def read_rdfxml(text: str, graph: str, base: str, label: str) -> list[tuple]:
    return RdfXml(text, graph, base, label).out


def write_rdfxml(rows: list[tuple], prefixes: dict[str, str] | None = None) -> str:
    names = {ns: p for p, ns in (PREFIXES | (prefixes or {})).items() if p and ns != XML}

    def qname(iri: str) -> str:
        m = re.match(r"(.*[#/:])([A-Za-z_][\w.-]*)$", iri)
        if not m:
            raise ValueError(f"a predicate that XML can't name: {iri}")
        names.setdefault(m[1], f"ns{len(names)}")
        return f"{names[m[1]]}:{m[2]}"

    q = lambda t: '"' + xml_escape(t, {'"': "&quot;"}) + '"'
    ident = lambda b: "b" + re.sub(r"[^A-Za-z0-9]", "_", b.rsplit("/", 1)[-1])
    by: dict = {}
    for _, sk, s, p, *o in sorted(rows, key=lambda r: tuple(x or "" for x in r)):
        by.setdefault((sk, s), []).append((p, o))
    body = []
    for (sk, s), facts in by.items():
        body.append(f"  <rdf:Description rdf:{'about=' + q(s) if sk == 'I' else 'nodeID=' + q(ident(s))}>")
        for p, (ok, o, dt, lang) in facts:
            name = qname(p)
            if ok == "L":
                extra = f" xml:lang={q(lang)}" if lang else "" if dt in (None, STRING) else f" rdf:datatype={q(dt)}"
                body.append(f"    <{name}{extra}>{xml_escape(o)}</{name}>")
            else:
                body.append(f"    <{name} rdf:{'resource=' + q(o) if ok == 'I' else 'nodeID=' + q(ident(o))}/>")
        body.append("  </rdf:Description>")
    head = "\n".join(f"    xmlns:{p}={q(ns)}" for ns, p in names.items())
    return f'<?xml version="1.0"?>\n<rdf:RDF\n{head}>\n' + "\n".join(body) + "\n</rdf:RDF>\n"


# ---- JSON-LD: contexts with terms, prefixes, types and languages; graphs, lists, reverse properties
class JsonLd:
    def __init__(self, text: str, graph: str, base: str, label: str):
        self.graph, self.base, self.label, self.blanks, self.out = graph, base, label, 0, []
        try:
            data = json.loads(text)
        except json.JSONDecodeError as e:
            raise ParseError(str(e)) from e
        for x in data if isinstance(data, list) else [data]:
            if not isinstance(x, dict):
                raise ParseError("a JSON-LD document holds objects")
            self.node(x, {}, graph)

    def expand(self, name: str, ctx: dict, vocab: bool) -> str:
        if name in ctx and isinstance(ctx[name], (str, dict)):
            v = ctx[name]
            v = v if isinstance(v, str) else v.get("@id", name)
            return v if v == name or v.startswith("@") else self.expand(v, {k: x for k, x in ctx.items() if k != name}, vocab)
        if ":" in name:
            p, _, local = name.partition(":")
            if p in ctx and not local.startswith("//"):
                return self.expand(p, ctx, vocab) + local
            return name
        if vocab and "@vocab" in ctx:
            return ctx["@vocab"] + name
        return urljoin(ctx.get("@base", self.base), name)

    def context(self, x: dict, ctx: dict) -> dict:
        c = x.get("@context")
        for part in c if isinstance(c, list) else [c]:
            if isinstance(part, dict):
                ctx = ctx | part
            elif isinstance(part, str):
                raise ParseError("remote contexts aren't loaded")
        return ctx

    def ref(self, name: str, ctx: dict) -> tuple:
        return ("B", f"{self.label}#{name[2:]}", None, None) if name.startswith("_:") else ("I", self.expand(name, ctx, False), None, None)

    def node(self, x: dict, ctx: dict, graph: str) -> tuple:
        ctx = self.context(x, ctx)
        keys = {self.expand(k, ctx, True) if not k.startswith("@") else k: k for k in x}
        if "@id" in keys:
            s = self.ref(x[keys["@id"]], ctx)
        else:
            self.blanks += 1
            s = ("B", f"{self.label}#b{self.blanks}", None, None)
        for iri, k in keys.items():
            v = x[k]
            items = v if isinstance(v, list) else [v]
            if iri == "@type":
                for t in items:
                    self.out.append((graph, *s[:2], TYPE, "I", self.expand(t, ctx, True), None, None))
            elif iri == "@graph":
                inner = s[1] if "@id" in keys else graph
                for t in items:
                    self.node(t, ctx, inner)
            elif iri == "@reverse":
                for p, w in v.items():
                    for t in w if isinstance(w, list) else [w]:
                        o = self.node(t, ctx, graph)
                        self.out.append((graph, *o[:2], self.expand(p, ctx, True), *s))
            elif not iri.startswith("@"):
                how = ctx.get(k, {}) if isinstance(ctx.get(k), dict) else {}
                if how.get("@container") == "@list":
                    items = [{"@list": items}]
                for t in items:
                    if t is not None:
                        self.out.append((graph, *s[:2], iri, *self.value(t, how, ctx, graph)))
        return s

    def value(self, v, how: dict, ctx: dict, graph: str) -> tuple:
        if isinstance(v, dict):
            if "@list" in v:
                head: tuple = ("I", NIL, None, None)
                items = v["@list"] if isinstance(v["@list"], list) else [v["@list"]]
                for i in reversed([self.value(t, {}, ctx, graph) for t in items]):
                    self.blanks += 1
                    b = ("B", f"{self.label}#b{self.blanks}", None, None)
                    self.out += [(graph, "B", b[1], FIRST, *i), (graph, "B", b[1], REST, *head)]
                    head = b
                return head
            if "@value" in v:
                lang, dt = v.get("@language"), v.get("@type")
                return self.literal(v["@value"], self.expand(dt, ctx, True) if dt else None, lang)
            return self.node(v, ctx, graph)
        kind = how.get("@type")
        if kind in ("@id", "@vocab") and isinstance(v, str):
            return self.ref(v, ctx) if kind == "@id" else ("I", self.expand(v, ctx, True), None, None)
        return self.literal(v, self.expand(kind, ctx, True) if kind else None, how.get("@language", ctx.get("@language")) if isinstance(v, str) and not kind else None)

    @staticmethod
    def literal(v, dt, lang) -> tuple:
        if isinstance(v, bool):
            return "L", str(v).lower(), dt or XSD + "boolean", None
        if isinstance(v, int):
            return "L", str(v), dt or XSD + "integer", None
        if isinstance(v, float):
            return "L", repr(v), dt or XSD + "double", None
        return ("L", v, LANG_STRING, lang.lower()) if lang else ("L", v, dt or STRING, None)


def read_jsonld(text: str, graph: str, base: str, label: str) -> list[tuple]:
    return JsonLd(text, graph, base, label).out


def write_jsonld(rows: list[tuple], prefixes: dict[str, str] | None = None) -> str:
    ident = lambda k, v: v if k == "I" else "_:b" + re.sub(r"[^A-Za-z0-9]", "_", v.rsplit("/", 1)[-1])
    graphs: dict = {}
    for g, sk, s, p, ok, o, dt, lang in sorted(rows, key=lambda r: tuple(x or "" for x in r)):
        node = graphs.setdefault(g, {}).setdefault(ident(sk, s), {"@id": ident(sk, s)})
        if p == TYPE and ok == "I":
            node.setdefault("@type", []).append(o)
        elif ok != "L":
            node.setdefault(p, []).append({"@id": ident(ok, o)})
        else:
            node.setdefault(p, []).append({"@value": o} | ({"@language": lang} if lang else {} if dt in (None, STRING) else {"@type": dt}))
    out = [{"@id": g, "@graph": list(nodes.values())} if g else {"@graph": list(nodes.values())} for g, nodes in graphs.items()]
    return json.dumps(out, ensure_ascii=False, indent=1)
