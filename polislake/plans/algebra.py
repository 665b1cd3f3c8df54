"""Query algebra. Terms are encoded strings (functions/terms.py) or Var."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Path:
    """op: iri, inverse, sequence, alternative, plus, star, optional."""

    op: str
    args: tuple = ()


@dataclass(frozen=True)
class Pattern:
    s: Any
    p: Any
    o: Any


@dataclass
class BGP:
    patterns: list[Pattern]


@dataclass
class Join:
    left: Any
    right: Any


@dataclass
class LeftJoin:
    left: Any
    right: Any
    condition: Any = None


@dataclass
class Union:
    left: Any
    right: Any


@dataclass
class Minus:
    left: Any
    right: Any


@dataclass
class Filter:
    condition: Any
    child: Any


@dataclass
class Extend:
    child: Any
    var: str
    expr: Any


@dataclass
class Values:
    vars: list[str]
    rows: list[list[str | None]]


@dataclass
class Group:
    child: Any
    keys: list[tuple[str, Any]]
    aggregates: list[tuple[str, Any]]


@dataclass
class Project:
    child: Any
    vars: list[str]


@dataclass
class Distinct:
    child: Any


@dataclass
class OrderBy:
    child: Any
    keys: list[tuple[Any, bool]]


@dataclass
class Slice:
    child: Any
    offset: int = 0
    limit: int | None = None


@dataclass(frozen=True)
class Call:
    """An expression: a function or operator by name."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Exists:
    pattern: Any = field(hash=False)
    negated: bool = False


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: Any = None
    distinct: bool = False
    separator: str = " "


@dataclass
class Graph:
    """Patterns of one named graph: an IRI, or a Var that ranges over all."""

    name: Any
    child: Any


@dataclass
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    plan: Any
    vars: list[str]
    template: list[Pattern] = field(default_factory=list)
    described: list = field(default_factory=list)
    default: list[str] | None = None  # FROM; None: the graph as it is
    named: list[str] | None = None  # FROM NAMED; None: all graphs


def variables(node: Any) -> list[str]:
    """Visible variables in order of first appearance."""
    out: dict[str, None] = {}

    def see(x: Any) -> None:
        if isinstance(x, Var):
            out.setdefault(x.name)

    def walk(n: Any) -> None:
        if isinstance(n, BGP):
            for t in n.patterns:
                see(t.s), see(t.p), see(t.o)
        elif isinstance(n, (Join, LeftJoin, Union)):
            walk(n.left), walk(n.right)
        elif isinstance(n, Minus):
            walk(n.left)
        elif isinstance(n, Extend):
            walk(n.child)
            out.setdefault(n.var)
        elif isinstance(n, Values):
            for v in n.vars:
                out.setdefault(v)
        elif isinstance(n, Graph):
            see(n.name)
            walk(n.child)
        elif isinstance(n, Project):
            for v in n.vars:
                out.setdefault(v)
        elif isinstance(n, Group):
            for v, _ in (*n.keys, *n.aggregates):
                out.setdefault(v)
        elif n is not None:
            walk(n.child)

    walk(node)
    return [v for v in out if not v.startswith(".")]
