"""R2RML mappings: how the rows of tables become triples."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from trellis.errors import MappingError
from trellis.sources.turtle import read
from trellis.sparql import ast as A

RR = "http://www.w3.org/ns/r2rml#"
_BRACES = re.compile(r"\{([^{}]+)\}")


@dataclass(frozen=True)
class TermMap:
    """A column, a template over columns, or a constant."""

    kind: str  # column, template, constant
    value: object
    term_type: str = "iri"  # iri, literal, blank
    datatype: str | None = None
    lang: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        if self.kind == "column":
            return (self.value,)
        return tuple(dict.fromkeys(_BRACES.findall(self.value))) if self.kind == "template" else ()

    @property
    def shape(self) -> str | None:
        """The template with its columns left out; terms of different shapes are never equal."""
        return _BRACES.sub("{}", self.value) if self.kind == "template" else None

    def pattern(self) -> re.Pattern:
        """Matches an IRI made by the template; groups are the columns."""
        parts = _BRACES.split(self.value)
        return re.compile("".join(re.escape(p) if i % 2 == 0 else "([^/]*)" for i, p in enumerate(parts)) + r"\Z")

    def key_of(self, iri: str) -> str | None:
        """The first column's value in an IRI of this template."""
        hit = self.pattern().match(iri) if self.kind == "template" else None
        return hit[1] if hit else None


@dataclass(frozen=True)
class TableInfo:
    """What parquet doesn't say about a table."""

    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = ()  # column, table, column
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    rows: int | None = None

    def is_key(self, columns: tuple[str, ...]) -> bool:
        keys = ([self.primary_key] if self.primary_key else []) + list(self.unique)
        return any(set(k) <= set(columns) for k in keys)

    def states_keys(self) -> bool:
        return bool(self.primary_key or self.unique)


@dataclass(frozen=True)
class Join:
    """rr:joinCondition of an object that is another map's subject."""

    parent: str
    child_column: str
    parent_column: str


@dataclass(frozen=True)
class Rule:
    """One predicate of one triples map."""

    map_id: str
    table: str
    subject: TermMap
    predicate: str
    object: TermMap
    graph: str | None = None
    join: Join | None = None
    also: tuple[str, ...] = ()  # further columns that must have a value

    @property
    def is_type(self) -> bool:
        return self.predicate == A.TYPE and self.object.kind == "constant"


@dataclass
class MappingStore:
    """All rules by predicate, the logical tables given as queries, and the tables' constraints."""

    rules: dict[str, list[Rule]] = field(default_factory=dict)
    classes: dict[str, list[Rule]] = field(default_factory=dict)
    queries: dict[str, str] = field(default_factory=dict)
    tables: dict[str, TableInfo] = field(default_factory=dict)
    maps: dict[str, tuple[str, TermMap]] = field(default_factory=dict)
    version: int = 0

    def add(self, rule: Rule) -> None:
        kind = self.classes.setdefault(rule.object.value.value, []) if rule.is_type else self.rules.setdefault(rule.predicate, [])
        if rule not in kind:
            kind.append(rule)
        self.version += 1

    def all_rules(self) -> list[Rule]:
        return [r for group in (*self.classes.values(), *self.rules.values()) for r in group]

    @property
    def has_graphs(self) -> bool:
        return any(r.graph for r in self.all_rules())

    def merge(self, other: MappingStore) -> None:
        for rule in other.all_rules():
            self.add(rule)
        self.queries.update(other.queries)
        self.tables.update(other.tables)
        self.maps.update(other.maps)

    def keys_unique(self, rule: Rule) -> bool:
        """May several predicates of one subject be read from one row?  Not where a stated key says otherwise."""
        if rule.subject.term_type == "blank":
            return True
        info = self.tables.get(rule.table)
        return info is None or not info.states_keys() or info.is_key(rule.subject.columns)


def _one(properties: dict, name: str):
    found = properties.get(RR + name, [])
    return found[0] if found else None


def _term_map(node, properties: dict, is_subject: bool) -> TermMap:
    constant, template, column = (_one(properties, k) for k in ("constant", "template", "column"))
    stated = _one(properties, "termType")
    term_type = {RR + "IRI": "iri", RR + "Literal": "literal", RR + "BlankNode": "blank"}.get(stated.value if stated else "")
    datatype, lang = _one(properties, "datatype"), _one(properties, "language")
    if constant is not None:
        return TermMap("constant", constant, "iri" if isinstance(constant, A.Iri) else "literal")
    if template is not None:
        return TermMap("template", template.value, term_type or "iri")
    if column is not None:
        name = column.value.strip('"')
        return TermMap("column", name, term_type or ("iri" if is_subject else "literal"), datatype.value if datatype else None, lang.value if lang else None)
    raise MappingError(f"{node}: a term map needs rr:constant, rr:template or rr:column")


def load_r2rml(text: str) -> MappingStore:
    """The store of an R2RML document in Turtle."""
    graph, store = read(text), MappingStore()
    maps = [s for s, p in graph.items() if RR + "logicalTable" in p]
    if not maps and text.strip():
        raise MappingError("no triples map with rr:logicalTable")
    for node in maps:
        properties = graph[node]
        map_id = getattr(node, "value", None) or getattr(node, "label", "")
        logical = graph[_one(properties, "logicalTable")]
        name, query = _one(logical, "tableName"), _one(logical, "sqlQuery")
        if name is not None:
            table = name.value.strip('"')
        elif query is not None:
            table = "view_" + re.sub(r"\W+", "_", map_id.rsplit("#")[-1].rsplit("/")[-1])
            store.queries[table] = query.value
        else:
            raise MappingError(f"{map_id}: a logical table needs rr:tableName or rr:sqlQuery")
        subject_node = _one(properties, "subjectMap") or _one(properties, "subject")
        if subject_node is None:
            raise MappingError(f"{map_id}: no rr:subjectMap")
        subject = TermMap("constant", subject_node) if isinstance(subject_node, A.Iri) and subject_node not in graph else _term_map(subject_node, graph[subject_node], True)
        store.maps[map_id] = (table, subject)
        graphs = [g.value for g in graph[subject_node].get(RR + "graph", [])] if subject_node in graph else []
        own_graph = graphs[0] if graphs else None
        for c in graph[subject_node].get(RR + "class", []) if subject_node in graph else []:
            store.add(Rule(map_id, table, subject, A.TYPE, TermMap("constant", c), own_graph))
        for pom in properties.get(RR + "predicateObjectMap", []):
            inner = graph[pom]
            predicates = [p.value for p in inner.get(RR + "predicate", [])] + [_one(graph[p], "constant").value for p in inner.get(RR + "predicateMap", [])]
            graph_name = _one(inner, "graph")
            for predicate in predicates:
                for obj in inner.get(RR + "objectMap", []):
                    parent = _one(graph[obj], "parentTriplesMap")
                    where = graph_name.value if graph_name else own_graph
                    if parent is not None:
                        condition = _one(graph[obj], "joinCondition")
                        parts = graph[condition] if condition is not None else {}
                        join = Join(getattr(parent, "value", None) or parent.label, _one(parts, "child").value if parts else "", _one(parts, "parent").value if parts else "")
                        store.add(Rule(map_id, table, subject, predicate, TermMap("template", "{}"), where, join))
                    else:
                        store.add(Rule(map_id, table, subject, predicate, _term_map(obj, graph[obj], False), where))
                for obj in inner.get(RR + "object", []):
                    store.add(Rule(map_id, table, subject, predicate, TermMap("constant", obj, "iri" if isinstance(obj, A.Iri) else "literal"), graph_name.value if graph_name else own_graph))
    for kind in store.rules.values():
        for i, rule in enumerate(kind):
            if rule.join:
                kind[i] = _joined(store, rule)
    return store


def _joined(store: MappingStore, rule: Rule) -> Rule:
    """A reference to another map's subject; over the parent's own key columns it needs no join."""
    if rule.join.parent not in store.maps:
        raise MappingError(f"{rule.map_id}: unknown parent map {rule.join.parent}")
    table, subject = store.maps[rule.join.parent]
    child, parent = rule.join.child_column, rule.join.parent_column
    if not child and table == rule.table:
        return Rule(rule.map_id, rule.table, rule.subject, rule.predicate, subject, rule.graph)
    if subject.columns == (parent,) and subject.kind in ("template", "column"):
        value = subject.value.replace("{" + parent + "}", "{" + child + "}") if subject.kind == "template" else child
        return Rule(rule.map_id, rule.table, rule.subject, rule.predicate, TermMap(subject.kind, value, subject.term_type), rule.graph)
    view = f"join_{rule.table}_{table}_{child}_{parent}"
    columns = ", ".join(f"p.`{c}` AS `parent_{c}`" for c in subject.columns)
    store.queries[view] = f"SELECT c.*, {columns} FROM `{rule.table}` c JOIN `{table}` p ON c.`{child}` = p.`{parent}`"
    value = _BRACES.sub(lambda m: "{parent_" + m[1] + "}", subject.value) if subject.kind == "template" else f"parent_{subject.value}"
    return Rule(rule.map_id, view, rule.subject, rule.predicate, TermMap(subject.kind, value, subject.term_type), rule.graph)


def flat_rules(rows: list[tuple[str, str, str, str]]) -> MappingStore:
    """The store of flat rows (predicate, table, subject template, object column)."""
    store = MappingStore()
    for predicate, table, template, column in rows:
        store.add(Rule(f"{table}/{template}", table, TermMap("template", template), predicate, TermMap("column", column, "literal")))
        store.maps[f"{table}/{template}"] = (table, TermMap("template", template))
    return store
