"""Federated sources: SERVICE as an in-process engine or an HTTP endpoint from an allow-list."""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from trellis.errors import ServiceError
from trellis.plans.scope import Known, Solutions, column_of, empty, unit
from trellis.sparql import ast as A
from trellis.sparql.parser import typed

#: Takes the text of a query; returns SPARQL results as a dict (head, results).
Endpoint = Callable[[str], dict]


@dataclass
class Services:
    endpoints: dict[str, Endpoint] = field(default_factory=dict)
    allowed: set[str] = field(default_factory=set)
    timeout: float = 30.0
    token_variable: str = "TRELLIS_SERVICE_TOKEN"
    most_rows: int = 1_000_000

    def register(self, iri: str, endpoint: Endpoint) -> None:
        self.endpoints[iri] = endpoint

    def allow(self, iri: str) -> None:
        self.allowed.add(iri)

    def fetch(self, iri: str, query: str) -> dict:
        if iri in self.endpoints:
            return self.endpoints[iri](query)
        if iri not in self.allowed:
            raise ServiceError(f"service {iri} is not allowed")
        headers = {"Accept": "application/sparql-results+json", "Content-Type": "application/x-www-form-urlencoded"}
        if token := os.environ.get(self.token_variable):
            headers["Authorization"] = f"Bearer {token}"
        request = urllib.request.Request(iri, urllib.parse.urlencode({"query": query}).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.load(reply)
        except (OSError, ValueError) as e:
            raise ServiceError(f"service {iri}: {e}") from e

    def solve(self, translator, element: A.Service) -> Solutions:
        """The solutions of a SERVICE group, fetched on the driver (bounded) and made a local relation."""
        spark, names = translator.spark, [n for n in A.variables(element.group) if not n.startswith("_:")]
        if not isinstance(element.endpoint, A.Iri):
            raise ServiceError("SERVICE needs a constant endpoint")
        prefixes = "".join(f"PREFIX {k}: <{v}>\n" for k, v in translator.prefixes.items())
        try:
            reply = self.fetch(element.endpoint.value, f"{prefixes}SELECT {' '.join('?' + n for n in names) or '*'} WHERE {element.text}")
            rows = reply["results"]["bindings"]
        except (ServiceError, KeyError, TypeError) as e:
            if element.silent:
                return unit(spark)
            raise e if isinstance(e, ServiceError) else ServiceError(f"service {element.endpoint.value}: no results") from e
        if len(rows) > self.most_rows:
            raise ServiceError(f"service {element.endpoint.value}: more than {self.most_rows} rows")
        if not rows:
            return empty(spark, names)
        terms = [tuple(_term(row.get(n)) for n in names) for row in rows]
        found = translator.values(A.Values(tuple(A.Var(n) for n in names), tuple(terms)))
        return Solutions(found.df, {n: found.known.get(n, Known(True)) for n in names if column_of(n) in found.df.columns})


def _term(cell: dict | None):
    if cell is None or cell.get("value") in (None, ""):
        return None
    if cell["type"] == "uri":
        return A.Iri(cell["value"])
    if cell.get("xml:lang"):
        return A.Literal(cell["value"], A.RDF + "langString", cell["xml:lang"])
    return typed(cell["value"], cell.get("datatype", A.XSD + "string"))
