"""The engine: SPARQL over tables of a Spark session."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis import results
from trellis.errors import QueryRejected
from trellis.functions.builtins import Registry
from trellis.functions.values import Value
from trellis.operators.scans import Catalog
from trellis.plans import bgp, explain
from trellis.plans.cache import PlanCache
from trellis.plans.scope import Known
from trellis.plans.translate import Translator
from trellis.sources import ontology as onto
from trellis.sources.mapping import MappingStore, TableInfo, flat_rules, load_r2rml
from trellis.sources.service import Services
from trellis.sparql import ast as A
from trellis.sparql.parser import parse

MOST_BYTES = 256 * 1024


def validate(text: str) -> None:
    """Refuse oversized texts and control characters before parsing."""
    if len(text.encode()) > MOST_BYTES:
        raise QueryRejected(f"the query is longer than {MOST_BYTES} bytes")
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f`]", text):
        raise QueryRejected("the query holds control characters or backticks")
    if not text.strip():
        raise QueryRejected("the query is empty")


class Engine:
    """Tables, a mapping and an ontology; queries become DataFrames.

    ``node_mode`` "key": a node is the key inside its template, so tables join by value; "iri": the whole IRI.
    ``max_path_depth``: bound of unbounded paths (None: to the fixpoint).
    """

    def __init__(self, spark: SparkSession, node_mode: str = "key", max_path_depth: int | None = None, reasoning: bool = True, correlated_subselect: bool = False, prefixes: dict[str, str] | None = None):
        if node_mode not in ("key", "iri"):
            raise ValueError("node_mode is 'key' or 'iri'")
        self.spark, self.node_mode, self.max_path_depth, self.reasoning = spark, node_mode, max_path_depth, reasoning
        self.correlated_subselect, self.prefixes = correlated_subselect, dict(prefixes or {})
        self.store, self.ontology, self.registry = MappingStore(), onto.Ontology(), Registry()
        self.services, self.cache, self.metrics = Services(), PlanCache(), Counter()
        self.tables: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        self.catalog = Catalog(spark, self.store, self.tables)

    # sources ------------------------------------------------------------------
    def register_table(self, name: str, df: DataFrame | Callable[[], DataFrame], info: TableInfo | None = None) -> None:
        self.tables[name] = df
        if info is not None:
            self.store.tables[name] = info
        self.catalog.views.clear()
        self.store.version += 1

    def register_parquet(self, directory: str, names: list[str], infos: dict[str, TableInfo] | None = None) -> None:
        """Tables of a folder; each is opened when a query first needs it."""
        for name in names:
            self.register_table(name, lambda name=name: self.spark.read.parquet(f"{directory}/{name}.parquet"), (infos or {}).get(name))

    def load_mapping(self, text: str) -> int:
        """Add an R2RML document; returns the number of its rules."""
        found = load_r2rml(text)
        self.store.merge(found)
        self.catalog.views.clear()
        return len(found.all_rules())

    def load_mapping_file(self, path: str) -> int:
        return self.load_mapping(Path(path).read_text(encoding="utf-8"))

    def load_mapping_table(self, df: DataFrame) -> int:
        """Add the documents of a table with columns name and ttl_content."""
        return sum(self.load_mapping(r["ttl_content"]) for r in df.select("ttl_content").collect())

    def load_flat_mapping(self, df: DataFrame) -> int:
        """Add rows (predicate, table_name, subject_template, object_col)."""
        rows = [tuple(r) for r in df.select("predicate", "table_name", "subject_template", "object_col").collect()]
        self.store.merge(flat_rules(rows))
        return len(rows)

    def load_ontology(self, text: str) -> onto.Ontology:
        found = onto.load_ontology(text)
        self.ontology.merge(found)
        return found

    def refresh(self) -> dict:
        """Forget views and plans made so far; tables of the session's catalog are found anew."""
        self.catalog.views.clear()
        return {"tables": len(self.tables), "rules": len(self.store.all_rules()), "forgotten_plans": self.cache.clear()}

    def register_function(self, name: str, build: Callable[..., Column | Value], least: int = 0, most: int | None = None) -> None:
        """A function by name or IRI; ``build`` takes and returns columns (Spark functions, pandas UDFs)."""
        self.registry.register(name, build, least, most)

    def register_aggregate(self, name: str, build: Callable[..., Column]) -> None:
        """An aggregate by name or IRI; ``build`` takes columns and returns an aggregate column."""
        self.registry.register_aggregate(name, build)

    # queries ------------------------------------------------------------------
    def parse(self, text: str) -> A.Query:
        validate(text)
        key = (text, self.store.version, self.ontology.version, tuple(sorted(self.prefixes.items())))
        return self.cache.get(key, lambda: parse(text, self.prefixes))

    def _translator(self, query: A.Query, notes: list[str] | None = None) -> Translator:
        graphs = frozenset(query.sources) if query.sources else None
        ctx = bgp.Context(self.catalog, self.store, self.ontology, self.node_mode, self.reasoning, graphs, self.max_path_depth, notes)
        return Translator(ctx, self.registry, self.services, self.correlated_subselect, query.prefixes or self.prefixes)

    def query(self, text: str) -> DataFrame:
        """A query's result: variables as columns; ASK one boolean; CONSTRUCT and DESCRIBE triples."""
        return self._run(self.parse(text))[0]

    def _run(self, query: A.Query) -> tuple[DataFrame, dict[str, Known]]:
        began = time.perf_counter()
        translator = self._translator(query)
        known: dict[str, Known] = {}
        if query.form == "SELECT":
            df, known = translator.select(query)
            df = df.toDF(*known)
        elif query.form == "ASK":
            df = translator.group(query.where).df.limit(1).agg((F.count("*") > 0).alias("boolean"))
        elif query.form == "CONSTRUCT":
            df = translator.construct(query)
        else:
            df = translator.describe(query)
        self.metrics["queries"] += 1
        self.metrics["planning_microseconds"] += int(1e6 * (time.perf_counter() - began))
        return df, known

    def ask(self, text: str) -> bool:
        return bool(self.query(text).first()["boolean"])

    def construct_bindings(self, text: str) -> DataFrame:
        """The solutions behind a CONSTRUCT, before its template."""
        query = self.parse(text)
        solutions = self._translator(query).group(query.where)
        return solutions.output([n for n in solutions.known if not n.startswith("_:")])

    def triples(self) -> DataFrame:
        """All triples of the mapping as text: subject, predicate, object."""
        pattern = A.Query("CONSTRUCT", A.Group((A.Triple(A.Var("s"), A.Var("p"), A.Var("o")),)), template=(A.Triple(A.Var("s"), A.Var("p"), A.Var("o")),))
        return self._translator(pattern).construct(pattern)

    def json_rows(self, text: str) -> DataFrame:
        """Each solution as one JSON text."""
        return self.query(text).select(F.to_json(F.struct("*")).alias("json"))

    def sparql_json(self, text: str) -> dict:
        """SPARQL results JSON (collected)."""
        query = self.parse(text)
        df, known = self._run(query)
        if query.form == "ASK":
            return {"head": {}, "boolean": bool(df.first()["boolean"])}
        return results.as_json(df, known)

    def stream_json(self, text: str, size: int = 500):
        """SPARQL results JSON in chunks."""
        df, known = self._run(self.parse(text))
        return results.chunks(df, known, size)

    def pages(self, text: str, size: int = 500):
        return results.pages(self.query(text), size)

    def explain(self, text: str, form: str = "text") -> str:
        """The syntax tree as text, json, dot or mermaid; "plan": the scans and Spark's plan."""
        query = self.parse(text)
        if form != "plan":
            return explain.FORMATS[form](query)
        notes: list[str] = []
        translator = self._translator(query, notes)
        df = translator.select(query)[0] if query.form == "SELECT" else translator.group(query.where).df
        return "\n".join([*notes, df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))])

    # inspection ---------------------------------------------------------------
    def inspect_ontology(self) -> dict:
        """The ontology as JSON-LD, with the mappings and their number."""
        o, mapped = self.ontology, self.store
        classes = sorted({*o.classes, *mapped.classes})
        objects = sorted({*o.object_properties, *(p for p, rules in mapped.rules.items() if any(r.object.term_type == "iri" for r in rules))})
        data = sorted({*o.datatype_properties, *(p for p in mapped.rules if p not in objects)})

        def entry(iri: str, kind: str) -> dict:
            out = {"@id": iri, "@type": kind}
            for key, value in (("rdfs:label", o.labels.get(iri)), ("rdfs:comment", o.comments.get(iri)), ("rdfs:domain", sorted(o.domain.get(iri, ()))), ("rdfs:range", sorted(o.range.get(iri, ())))):
                if value:
                    out[key] = value
            parents = sorted(p for p, children in o.sub_class.items() if iri in children)
            if parents:
                out["rdfs:subClassOf"] = parents
            return out

        graph = [entry(c, "owl:Class") for c in classes] + [entry(p, "owl:ObjectProperty") for p in objects] + [entry(p, "owl:DatatypeProperty") for p in data if p not in objects]
        mappings = [{"predicate": r.predicate, "table": r.table, "subject": str(r.subject.value), "object": str(getattr(r.object.value, "value", r.object.value))} for r in mapped.all_rules()]
        return {"@context": {"owl": A.OWL, "rdf": A.RDF, "rdfs": A.RDFS, "xsd": A.XSD}, "@graph": graph, "mappings": mappings, "stats": {"classes": len(classes), "properties": len({*objects, *data}), "mappings": len(mappings)}}

    def inspect_mappings(self) -> DataFrame:
        rows = [(f"{r.subject.value} <{r.predicate}> {getattr(r.object.value, 'value', r.object.value)}", self.store.queries.get(r.table, r.table)) for r in self.store.all_rules()]
        return self.spark.createDataFrame(rows, "target_triple string, sql_source string")

    def inspect_metadata(self) -> dict:
        names = [*self.tables, *(t.name for t in self.spark.catalog.listTables() if t.name not in self.tables)]
        out = {}
        for name in names:
            df, info = self.catalog.table(name), self.store.tables.get(name, TableInfo())
            out[name] = {"columns": dict(df.dtypes), "primary_key": list(info.primary_key), "unique": [list(u) for u in info.unique], "foreign_keys": [list(k) for k in info.foreign_keys], "not_null": list(info.not_null)}
        return out

    def cache_stats(self) -> dict:
        return self.cache.stats() | {"queries": self.metrics["queries"], "planning_microseconds": self.metrics["planning_microseconds"]}

    def clear_cache(self) -> int:
        return self.cache.clear()

    def materialize(self, path: str, format: str = "ntriples") -> None:
        """Write all triples: N-Triples lines, or parquet."""
        triples = self.triples()
        if format == "parquet":
            triples.write.parquet(path)
            return

        def escaped(c: Column) -> Column:
            for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
                c = F.replace(c, F.lit(raw), F.lit(safe))
            return c

        def node(c: Column) -> Column:
            return F.when(c.startswith("_:"), c).when(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^ ]*$"), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(F.concat(F.lit('"'), escaped(c), F.lit('"')))

        triples.select(F.concat_ws(" ", node(F.col("subject")), node(F.col("predicate")), node(F.col("object")), F.lit(".")).alias("value")).write.text(path)
