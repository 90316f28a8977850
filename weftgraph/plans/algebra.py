"""The algebra that queries are parsed into."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    value: str
    datatype: str = "http://www.w3.org/2001/XMLSchema#string"
    lang: str | None = None


# ---- paths
@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Alternative:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """A path any number of times: ``least`` 0 or 1; ``most`` 1 or None for no end."""

    path: object
    least: int
    most: int | None


# ---- graph patterns
@dataclass(frozen=True)
class Triple:
    s: object
    p: object  # Var, or a path
    o: object


@dataclass
class Bgp:
    triples: list


@dataclass
class Join:
    left: object
    right: object


@dataclass
class Optional:
    left: object
    right: object
    condition: object = None


@dataclass
class Union:
    parts: list


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Filter:
    child: object
    condition: object


@dataclass
class Extend:
    child: object
    var: str
    expression: object


@dataclass
class Values:
    names: list
    rows: list


@dataclass
class Graph:
    name: object
    child: object


@dataclass
class Unit:
    """One solution that binds nothing."""


# ---- expressions
@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass
class Exists:
    pattern: object
    positive: bool


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object
    distinct: bool = False
    separator: str = " "


# ---- the query
@dataclass
class Select:
    pattern: object
    names: list | None  # None: all
    extend: list = field(default_factory=list)  # (name, expression) of the projection
    distinct: bool = False
    group: list | None = None
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int = 0
