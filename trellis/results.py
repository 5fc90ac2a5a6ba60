"""Results as SPARQL JSON, pages and chunks."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame

from trellis.sparql import ast as A


def cell(value, kind: str = "unknown", lang: str | None = None, datatype: str | None = None) -> dict | None:
    """One binding; None for an unbound variable."""
    if value is None:
        return None
    if kind == "iri" or (kind == "unknown" and isinstance(value, str) and value.startswith(("http://", "https://"))):
        return {"type": "uri", "value": str(value)}
    if kind == "blank":
        return {"type": "bnode", "value": str(value).removeprefix("_:")}
    if isinstance(value, bool):
        return {"type": "literal", "value": str(value).lower(), "datatype": A.XSD + "boolean"}
    if isinstance(value, int):
        return {"type": "literal", "value": str(value), "datatype": datatype or A.XSD + "integer"}
    if isinstance(value, float):
        return {"type": "literal", "value": repr(value), "datatype": datatype or A.XSD + "double"}
    if isinstance(value, Decimal):
        return {"type": "literal", "value": format(value, "f"), "datatype": datatype or A.XSD + "decimal"}
    if isinstance(value, datetime.datetime):
        return {"type": "literal", "value": value.isoformat(), "datatype": A.XSD + "dateTime"}
    if isinstance(value, datetime.date):
        return {"type": "literal", "value": value.isoformat(), "datatype": A.XSD + "date"}
    out = {"type": "literal", "value": str(value)}
    if lang:
        out["xml:lang"] = lang
    elif datatype and datatype not in (A.XSD + "string", A.RDF + "langString"):
        out["datatype"] = datatype
    return out


def bindings(df: DataFrame, known: dict | None = None) -> Iterator[dict]:
    """Rows as bindings, fetched partition by partition."""
    known = known or {}
    names = df.columns
    for row in df.toLocalIterator(prefetchPartitions=True):
        found = {}
        for name, value in zip(names, row, strict=True):
            k = known.get(name)
            one = cell(value, k.kind, k.lang, k.datatype) if k else cell(value)
            if one is not None:
                found[name] = one
        yield found


def chunks(df: DataFrame, known: dict | None = None, size: int = 500) -> Iterator[str]:
    """SPARQL results JSON in pieces of at most ``size`` rows each; never holds the whole result."""
    yield '{"head": ' + json.dumps({"vars": df.columns}) + ', "results": {"bindings": ['
    held: list[str] = []
    first = True
    for row in bindings(df, known):
        held.append(json.dumps(row))
        if len(held) == size:
            yield ("" if first else ", ") + ", ".join(held)
            held, first = [], False
    yield ("" if first or not held else ", ") + ", ".join(held) + "]}}"


def as_json(df: DataFrame, known: dict | None = None) -> dict:
    return {"head": {"vars": df.columns}, "results": {"bindings": list(bindings(df, known))}}


def pages(df: DataFrame, size: int = 500) -> Iterator[list]:
    """Rows in lists of ``size``, one pass over the result (no repeated LIMIT and OFFSET)."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
