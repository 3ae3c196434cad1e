"""Syntax trees of expressions and queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from noteweave.functions.literals import Link, to_text


@dataclass(frozen=True)
class Node:
    """Any part of an expression."""


@dataclass(frozen=True)
class Lit(Node):
    value: Any

    def __hash__(self) -> int:
        return hash(repr(self.value))


@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class ListOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class ObjectOf(Node):
    items: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class Bin(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Index(Node):
    value: Node
    key: Node


@dataclass(frozen=True)
class Call(Node):
    func: Node  # Var: a registered function
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Method(Node):
    target: Node
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Lambda(Node):
    params: tuple[str, ...]
    body: Node


@dataclass(frozen=True)
class Not(Node):
    value: Node


def children(n: Node) -> tuple[Node, ...]:
    if isinstance(n, ListOf):
        return n.items
    if isinstance(n, ObjectOf):
        return tuple(v for _, v in n.items)
    if isinstance(n, Bin):
        return n.left, n.right
    if isinstance(n, Index):
        return n.value, n.key
    if isinstance(n, Call):
        return (n.args if isinstance(n.func, Var) else (n.func, *n.args))
    if isinstance(n, Method):
        return (n.target, *n.args)
    if isinstance(n, Lambda):
        return (n.body,)
    return (n.value,) if isinstance(n, Not) else ()


def rebuilt(n: Node, f: Callable[[Node], Node]) -> Node:
    """``n`` with ``f`` of each of its parts."""
    if isinstance(n, ListOf):
        return ListOf(tuple(map(f, n.items)))
    if isinstance(n, ObjectOf):
        return ObjectOf(tuple((k, f(v)) for k, v in n.items))
    if isinstance(n, Bin):
        return Bin(n.op, f(n.left), f(n.right))
    if isinstance(n, Index):
        return Index(f(n.value), f(n.key))
    if isinstance(n, Call):
        return Call(n.func if isinstance(n.func, Var) else f(n.func), tuple(map(f, n.args)))
    if isinstance(n, Method):
        return Method(f(n.target), n.name, tuple(map(f, n.args)))
    if isinstance(n, Lambda):
        return Lambda(n.params, f(n.body))
    return Not(f(n.value)) if isinstance(n, Not) else n


def free_variables(n: Node, bound: frozenset[str] = frozenset()) -> set[str]:
    """Names that an expression takes from its row. Functions are no variables, and parameters hide names in their body only."""
    if isinstance(n, Var):
        return set() if n.name in bound else {n.name}
    if isinstance(n, Lambda):
        bound = bound | set(n.params)
    return set().union(*(free_variables(c, bound) for c in children(n)), set())


def text_of(n: Node) -> str:
    """Canonical text: equal trees have equal texts."""
    if isinstance(n, Lit):
        return f'"{n.value}"' if isinstance(n.value, str) else n.value.markdown() if isinstance(n.value, Link) else to_text(n.value)
    if isinstance(n, Var):
        return n.name
    if isinstance(n, ListOf):
        return "[" + ", ".join(map(text_of, n.items)) + "]"
    if isinstance(n, ObjectOf):
        return "{" + ", ".join(f"{k}: {text_of(v)}" for k, v in n.items) + "}"
    if isinstance(n, Bin):
        return f"({text_of(n.left)} {n.op} {text_of(n.right)})"
    if isinstance(n, Index):
        return f"{text_of(n.value)}[{text_of(n.key)}]"
    if isinstance(n, Call):
        return f"{text_of(n.func)}({', '.join(map(text_of, n.args))})"
    if isinstance(n, Method):
        return f"{text_of(n.target)}.{n.name}({', '.join(map(text_of, n.args))})"
    if isinstance(n, Lambda):
        return f"(({', '.join(n.params)}) => {text_of(n.body)})"
    return f"!{text_of(n.value)}"


@dataclass(frozen=True)
class Query:
    """Any part of a query."""


@dataclass(frozen=True)
class Const(Query):
    value: bool


@dataclass(frozen=True)
class ById(Query):
    id: str


@dataclass(frozen=True)
class ByLink(Query):
    link: Link


@dataclass(frozen=True)
class ByType(Query):
    name: str


@dataclass(frozen=True)
class ByTag(Query):
    tag: str
    exact: bool = False


@dataclass(frozen=True)
class ByPath(Query):
    path: str
    exact: bool = False


@dataclass(frozen=True)
class HasField(Query):
    key: str


@dataclass(frozen=True)
class FieldEquals(Query):
    key: str
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Where(Query):
    expression: Node


@dataclass(frozen=True)
class Tree(Query):
    """Descendants (down) or ancestors of what ``source`` finds; inclusive: with the found objects."""

    source: Query
    down: bool
    inclusive: bool = False


@dataclass(frozen=True)
class Linked(Query):
    """What is linked with the objects of ``source`` over at most ``distance`` links."""

    source: Query
    direction: str  # incoming, outgoing or both
    distance: int = 1
    inclusive: bool = False


@dataclass(frozen=True)
class And(Query):
    items: tuple[Query, ...]


@dataclass(frozen=True)
class Or(Query):
    items: tuple[Query, ...]


@dataclass(frozen=True)
class NotQ(Query):
    item: Query


ALL, NONE = Const(True), Const(False)


def simplify(q: Query) -> Query:
    """``q`` without nested and/or, with constants folded, also through tree and link steps."""
    if isinstance(q, (And, Or)):
        kind, neutral = type(q), isinstance(q, And)
        flat: list[Query] = []
        for x in map(simplify, q.items):
            flat += x.items if isinstance(x, kind) else [x]
        if Const(not neutral) in flat:
            return Const(not neutral)
        flat = [x for x in dict.fromkeys(flat) if x != Const(neutral)]
        return Const(neutral) if not flat else flat[0] if len(flat) == 1 else kind(tuple(flat))
    if isinstance(q, NotQ):
        inner = simplify(q.item)
        return Const(not inner.value) if isinstance(inner, Const) else inner.item if isinstance(inner, NotQ) else NotQ(inner)
    if isinstance(q, Tree):
        source = simplify(q.source)
        if source == NONE or source == ALL and q.inclusive:
            return source
        return Tree(source, q.down, q.inclusive)
    if isinstance(q, Linked):
        source = simplify(q.source)
        if q.distance < 0 or source == NONE or source == ALL and not q.inclusive:
            return NONE
        return source if source == ALL else Linked(source, q.direction, q.distance, q.inclusive)
    return q
