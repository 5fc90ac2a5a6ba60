"""A reader of the Turtle subset that mappings and ontologies use."""

from __future__ import annotations

from collections import defaultdict

from trellis.sparql import ast as A
from trellis.sparql.parser import Parser

Graph = dict[object, dict[str, list]]


class _Turtle(Parser):
    def document(self) -> list[A.Triple]:
        found: list[A.Triple] = []
        while self.peek().kind != "end":
            token = self.peek()
            if token.kind == "lang" and token.text.lower() in ("@prefix", "@base"):
                self.next()
                self._directive(token.text[1:].upper())
                self.need(".")
            elif self.is_word("PREFIX", "BASE"):
                self._directive(self.next().upper)
            else:
                before = len(found)
                subject = self.node(found)
                self.properties(subject, found, optional=len(found) > before)
                self.need(".")
        return found

    def _directive(self, kind: str) -> None:
        if kind == "BASE":
            self.base = self.iri_ref()
            return
        name = self.next().text
        self.prefixes[name[:-1]] = self.iri_ref()


def read(text: str) -> Graph:
    """subject -> predicate IRI -> objects, in document order."""
    graph: Graph = defaultdict(lambda: defaultdict(list))
    for t in _Turtle(text).document():
        graph[t.subject][t.predicate.value].append(t.object)
    return graph
