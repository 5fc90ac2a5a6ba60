"""Query trees as text, JSON, DOT or Mermaid."""

from __future__ import annotations

import json
from decimal import Decimal

from trellis.sparql import ast as A


def tree(node) -> dict:
    """A syntax tree as nested dicts with names and children."""
    if isinstance(node, (A.Var, A.Iri, A.Blank, A.Literal)):
        return {"name": term(node), "children": []}
    if isinstance(node, (tuple, list)):
        return {"name": "list", "children": [tree(x) for x in node]}
    if hasattr(node, "__dataclass_fields__"):
        plain, children = [], []
        for name in node.__dataclass_fields__:
            value = getattr(node, name)
            if name == "prefixes" or value in (None, (), False):
                continue
            if isinstance(value, (str, int, float, bool, Decimal)):
                plain.append(f"{name}={value}")
            elif isinstance(value, tuple) and name != "args":
                children += [tree(x) for x in value]
            else:
                children.append(tree(value))
        return {"name": " ".join([type(node).__name__, *plain]), "children": children}
    return {"name": str(node), "children": []}


def term(t) -> str:
    if isinstance(t, A.Var):
        return "?" + t.name
    if isinstance(t, A.Iri):
        return f"<{t.value}>"
    return "_:" + t.label if isinstance(t, A.Blank) else repr(t.value)


def as_text(node) -> str:
    lines: list[str] = []

    def walk(t: dict, depth: int) -> None:
        lines.append("  " * depth + t["name"])
        for c in t["children"]:
            walk(c, depth + 1)

    walk(tree(node), 0)
    return "\n".join(lines)


def as_json(node) -> str:
    return json.dumps(tree(node), indent=1)


def _edges(node) -> tuple[list[str], list[tuple[int, int]]]:
    names: list[str] = []
    edges: list[tuple[int, int]] = []

    def walk(t: dict) -> int:
        me = len(names)
        names.append(t["name"])
        edges.extend((me, walk(c)) for c in t["children"])
        return me

    walk(tree(node))
    return names, edges


def as_dot(node) -> str:
    names, edges = _edges(node)
    nodes = [f"  n{i} [label={json.dumps(n)}];" for i, n in enumerate(names)]
    return "\n".join(["digraph plan {", *nodes, *(f"  n{a} -> n{b};" for a, b in edges), "}"])


def as_mermaid(node) -> str:
    names, edges = _edges(node)
    quoted = (n.replace('"', "'") for n in names)
    return "\n".join(["graph TD", *(f'  n{i}["{n}"]' for i, n in enumerate(quoted)), *(f"  n{a} --> n{b}" for a, b in edges)])


FORMATS = {"text": as_text, "json": as_json, "dot": as_dot, "mermaid": as_mermaid}
