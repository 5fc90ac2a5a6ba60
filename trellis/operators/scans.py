"""Mapped scans: one DataFrame for all triple patterns that a row answers."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.errors import MappingError
from trellis.functions.values import NUMERIC, constant, short
from trellis.plans.scope import Known, Solutions, column_of
from trellis.sources.mapping import MappingStore, Rule, TermMap
from trellis.sparql import ast as A


#: The name of a table of edges (s, p, o), if there is one.
_EDGES = "rdf_triples"


@dataclass
class Catalog:
    """Tables of a session by name; views of the mapping's queries are made when first used."""

    spark: SparkSession
    store: MappingStore
    tables: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    views: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame | None:
        if name in self.tables:
            if callable(self.tables[name]):  # opened when first used
                self.tables[name] = self.tables[name]()
            return self.tables[name]
        if name in self.store.queries:
            if name not in self.views:
                needed = {t: self.table(t) for t in self.tables if re.search(rf"\b{re.escape(t)}\b", self.store.queries[name])}
                query, arguments = self.store.queries[name], {}
                for t, df in needed.items():
                    query = re.sub(rf"(?<![\w.{{]){re.escape(t)}(?![\w.}}(])(?=\s|$|\)|,|`)", "{" + t + "}", query.replace(f"`{t}`", t))
                    arguments[t] = df
                self.views[name] = self.spark.sql(query, **arguments) if arguments else self.spark.sql(query)
            return self.views[name]
        if name.startswith(_EDGES + " ") and (edges := self.table(_EDGES)) is not None:
            return edges.filter(F.col("p") == name.partition(" ")[2]).select("s", "o")
        if " " not in name and self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        return None

    def edge_rules(self, predicate: str) -> list[Rule]:
        """What answers a predicate that no mapping names: the generic edge table, where there is one."""
        edges = self.table(_EDGES)
        if edges is None or not {"s", "p", "o"} <= set(edges.columns):
            return []
        return [Rule(_EDGES, f"{_EDGES} {predicate}", TermMap("column", "s"), predicate, TermMap("column", "o", "unknown"))]

    def usable(self, rule: Rule) -> bool:
        """Whether the table exists and has all columns that the rule names."""
        df = self.table(rule.table)
        return df is not None and {*rule.subject.columns, *rule.object.columns} <= set(df.columns)


def _braces(template: str) -> list[str]:
    return re.split(r"\{([^{}]+)\}", template)


def rendered(term: TermMap, df: DataFrame) -> Column:
    """The IRI (or text) that a term map makes."""
    if term.kind == "constant":
        return constant(term.value).col
    if term.kind == "column":
        return F.col(f"`{term.value}`")
    parts = [F.lit(p) if i % 2 == 0 else F.col(f"`{p}`").cast("string") for i, p in enumerate(_braces(term.value)) if p]
    return F.concat(*parts)


def term_column(term: TermMap, df: DataFrame, mode: str) -> tuple[Column, Known]:
    """The column of a term; in key mode the first column inside a template stands for the IRI."""
    if term.kind == "template":
        if mode == "key":
            return F.col(f"`{term.columns[0]}`"), Known(False, term.term_type, shape=term.shape)
        return rendered(term, df), Known(False, term.term_type, shape=term.shape)
    if term.kind == "constant":
        value = constant(term.value)
        return value.col, Known(False, "iri" if isinstance(term.value, A.Iri) else "literal", value.lang, value.datatype)
    return F.col(f"`{term.value}`"), Known(False, term.term_type if term.term_type != "literal" else "literal", term.lang, term.datatype)


def trailing_key(iri: str) -> str:
    """The number at the end of an IRI, or the IRI."""
    hit = re.search(r"(\d+)/?$", iri)
    return hit[1] if hit else iri


def equals(term: TermMap, df: DataFrame, wanted: A.Term, mode: str) -> Column | bool:
    """The condition that a term is a constant; False if it can never be."""
    if isinstance(wanted, A.Iri):
        if term.kind == "constant":
            return term.value == wanted
        if term.kind == "template":
            hit = term.pattern().match(wanted.value)
            if hit is None:
                return False
            found = True
            for column, text in zip(re.findall(r"\{([^{}]+)\}", term.value), hit.groups(), strict=True):
                one = _same(df, column, text)
                found = one if found is True else found & one
            return found
        return _same(df, term.value, wanted.value if mode == "iri" or short(df.schema[term.value].dataType.simpleString()) == "string" else trailing_key(wanted.value))
    if isinstance(wanted, A.Literal):
        if term.kind == "constant":
            return isinstance(term.value, A.Literal) and term.value.value == wanted.value and term.value.lang == wanted.lang
        if term.kind == "template":
            return False if term.term_type != "literal" else rendered(term, df) == F.lit(str(wanted.value))
        if term.lang and wanted.lang and term.lang.lower() != wanted.lang.lower():
            return False
        kind, value = short(df.schema[term.value].dataType.simpleString()), constant(wanted)
        if kind in NUMERIC and value.type == "string":
            return False
        column = F.col(f"`{term.value}`")
        return column == (value.col.cast("string") if kind == "string" and value.type != "string" else value.col)
    raise MappingError(f"no constant: {wanted}")


def _same(df: DataFrame, column: str, text: str) -> Column:
    """A column equals a text in the column's own type, so that the filter reaches the scan."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(f"`{column}`") == F.lit(int(text)) if re.fullmatch(r"-?\d{1,18}", text) else F.lit(False)
    if short(kind) == "string":
        return F.col(f"`{column}`") == text
    return F.col(f"`{column}`") == F.lit(text).try_cast(kind)


def scan(catalog: Catalog, subject: A.Term, parts: list[tuple[Rule, A.Triple, bool]], mode: str, distinct: bool) -> Solutions | None:
    """One scan for patterns of one subject over one table; (rule, pattern, inverted) each.  None: no row can match."""
    df = catalog.table(parts[0][0].table)
    bound: dict[str, tuple[Column, Known]] = {}
    conditions: list[Column] = []

    def bind(term: A.Term, value: tuple[Column, Known]) -> None:
        name = term.name if isinstance(term, A.Var) else "_:" + term.label
        if name in bound:
            if str(bound[name][0]) != str(value[0]):
                conditions.append(bound[name][0] == value[0])
        else:
            bound[name] = value

    def place(term: A.Term, map_: TermMap) -> bool:
        for column in map_.columns:  # no value, no triple
            conditions.append(F.col(f"`{column}`").isNotNull())
        if isinstance(term, (A.Var, A.Blank)):
            bind(term, term_column(map_, df, mode))
            return True
        same = equals(map_, df, term, mode)
        if same is False:
            return False
        if same is not True:
            conditions.append(same)
        return True

    for rule, pattern, inverted in parts:
        conditions += [F.col(f"`{c}`").isNotNull() for c in rule.also]
        first, second = (rule.object, rule.subject) if inverted else (rule.subject, rule.object)
        if not place(pattern.subject, first):
            return None
        if isinstance(pattern.predicate, A.Var):
            bind(pattern.predicate, (F.lit(rule.predicate), Known(False, "iri")))
        if rule.is_type and isinstance(pattern.object, A.Var):
            bind(pattern.object, (F.lit(rule.object.value.value), Known(False, "iri")))
        elif not (rule.is_type and isinstance(pattern.object, A.Iri)) and not place(pattern.object, second):
            return None
    seen: set[str] = set()
    for condition in conditions:
        if str(condition) not in seen:
            seen.add(str(condition))
            df = df.filter(condition)
    out = df.select(*(col.alias(column_of(n)) for n, (col, _) in bound.items()))
    return Solutions(out.distinct() if distinct else out, {n: k for n, (_, k) in bound.items()})
