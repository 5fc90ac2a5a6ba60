"""Syntax trees of SPARQL queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union as AnyOf

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = RDF + "type"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Blank:
    label: str


@dataclass(frozen=True)
class Literal:
    value: object
    datatype: str = XSD + "string"
    lang: str | None = None


Term = AnyOf[Var, Iri, Blank, Literal]


# expressions ------------------------------------------------------------------
@dataclass(frozen=True)
class Call:
    """A function or aggregate call; ``name`` is upper case for built-ins, an IRI otherwise."""

    name: str
    args: tuple = ()
    distinct: bool = False
    separator: str | None = None
    over: "Over | None" = None


@dataclass(frozen=True)
class Over:
    partition: tuple = ()
    order: tuple = ()  # (expression, descending)


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Among:
    arg: object
    options: tuple
    negated: bool


@dataclass(frozen=True)
class Exists:
    group: "Group"
    negated: bool


# property paths ---------------------------------------------------------------
@dataclass(frozen=True)
class Sequence:
    steps: tuple


@dataclass(frozen=True)
class Alternative:
    options: tuple


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Repeat:
    """``path`` from ``least`` to ``most`` times (None: without bound)."""

    path: object
    least: int
    most: int | None


@dataclass(frozen=True)
class Negated:
    forward: tuple
    backward: tuple


# graph patterns ---------------------------------------------------------------
@dataclass(frozen=True)
class Triple:
    subject: Term
    predicate: object  # Var, Iri or a path
    object: Term


@dataclass(frozen=True)
class Filter:
    condition: object


@dataclass(frozen=True)
class Bind:
    expression: object
    var: Var


@dataclass(frozen=True)
class Optional:
    group: "Group"


@dataclass(frozen=True)
class Minus:
    group: "Group"


@dataclass(frozen=True)
class Union:
    branches: tuple


@dataclass(frozen=True)
class Graph:
    name: Term
    group: "Group"


@dataclass(frozen=True)
class Service:
    endpoint: Term
    group: "Group"
    silent: bool
    text: str = ""


@dataclass(frozen=True)
class Values:
    variables: tuple
    rows: tuple  # of tuples of terms, None for UNDEF


@dataclass(frozen=True)
class SubSelect:
    query: "Query"


@dataclass(frozen=True)
class Group:
    elements: tuple


@dataclass(frozen=True)
class Projection:
    var: Var
    expression: object | None = None


@dataclass(frozen=True)
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    where: Group
    projection: tuple = ()  # empty: all variables
    distinct: bool = False
    group_by: tuple = ()  # Projection or expression
    having: tuple = ()
    order_by: tuple = ()  # (expression, descending)
    limit: int | None = None
    offset: int | None = None
    values: Values | None = None
    template: tuple = ()
    describe: tuple = ()
    sources: tuple = ()  # FROM
    named_sources: tuple = ()  # FROM NAMED
    prefixes: dict = field(default_factory=dict, hash=False, compare=False)


def variables(node) -> list[str]:
    """Names of the variables of a tree in order of appearance (not those inside subqueries that are not projected)."""
    found: dict[str, None] = {}

    def walk(x) -> None:
        if isinstance(x, Var):
            found.setdefault(x.name)
        elif isinstance(x, SubSelect):
            if x.query.projection:
                for p in x.query.projection:
                    found.setdefault(p.var.name)
            else:
                walk(x.query.where)
        elif isinstance(x, (Filter, Minus)):
            return
        elif isinstance(x, (tuple, list)):
            for y in x:
                walk(y)
        elif hasattr(x, "__dataclass_fields__"):
            for name in x.__dataclass_fields__:
                walk(getattr(x, name))

    walk(node)
    return list(found)


def mentioned(node) -> set[str]:
    """All variables that an expression mentions."""
    if isinstance(node, Var):
        return {node.name}
    if isinstance(node, (tuple, list)):
        return set().union(*map(mentioned, node)) if node else set()
    if hasattr(node, "__dataclass_fields__"):
        return set().union(*(mentioned(getattr(node, f)) for f in node.__dataclass_fields__))
    return set()


def bindable(node) -> set[str]:
    """Variables that the patterns of a group may bind (not those that expressions only mention)."""
    if isinstance(node, Var):
        return {node.name}
    if isinstance(node, (Filter, Minus, Exists)):
        return set()
    if isinstance(node, Bind):
        return {node.var.name}
    if isinstance(node, SubSelect):
        return set(variables(node))
    if isinstance(node, (tuple, list)):
        return set().union(*map(bindable, node)) if node else set()
    if hasattr(node, "__dataclass_fields__"):
        return set().union(*(bindable(getattr(node, f)) for f in node.__dataclass_fields__))
    return set()


def loose(group: Group) -> set[str]:
    """Variables that expressions inside a group mention and its patterns don't bind: they can only come from outside."""
    bound, out = bindable(group), set()
    for element in group.elements:
        if isinstance(element, Filter):
            out |= mentioned(element.condition) - bound
        elif isinstance(element, Bind):
            out |= mentioned(element.expression) - bound
        elif isinstance(element, Optional):
            out |= loose(element.group) - bound
        elif isinstance(element, Union):
            out |= set().union(*map(loose, element.branches))
        elif isinstance(element, Group):
            out |= loose(element)
        elif isinstance(element, (Minus, Graph)):
            out |= loose(element.group)
    return out
