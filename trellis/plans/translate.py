"""Groups and queries to DataFrames: one function for each kind of pattern."""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.errors import UnsupportedFeature
from trellis.functions.builtins import Registry
from trellis.functions.values import Value
from trellis.operators import paths
from trellis.operators.scans import scan, trailing_key
from trellis.plans import bgp
from trellis.plans.expressions import Compiler, aggregates_in, typed
from trellis.plans.scope import Known, Solutions, bindings, column_of, empty, filter_join, join, left_join, marked, marked_by, unit, union
from trellis.sources.service import Services
from trellis.sparql import ast as A
from trellis.sparql.parser import AGGREGATES


class Translator:
    def __init__(self, ctx: bgp.Context, registry: Registry, services: Services, correlated_subselect: bool = False, prefixes: dict[str, str] | None = None):
        self.ctx, self.registry, self.services, self.correlated = ctx, registry, services, correlated_subselect
        self.spark = ctx.catalog.spark
        self.marks = 0
        self.given: Solutions | None = None  # bindings from outside of the EXISTS at hand
        self.prefixes = prefixes or {}

    def aggregates(self, e) -> list[A.Call]:
        """Aggregate calls of an expression, the user's own too."""
        return aggregates_in(e, AGGREGATES | self.registry.aggregates.keys())

    # groups -------------------------------------------------------------------
    def group(self, group: A.Group, outer: frozenset[str] = frozenset()) -> Solutions:
        """The solutions of a group; its filters hold for the whole of it."""
        solutions, filters = self._pattern(group, outer)
        solutions = self._told(solutions, filters)
        for e in filters:
            solutions = self.filtered(solutions, e)
        return solutions

    def _told(self, solutions: Solutions, expressions: list, near: Solutions | None = None) -> Solutions:
        """Solutions with the bindings from outside of an EXISTS, if expressions need them."""
        have = solutions.known.keys() | (near.known.keys() if near else set())
        if self.given is not None and any((A.mentioned(e) - have) & self.given.known.keys() for e in expressions):
            return join(solutions, self.given)
        return solutions

    def _marked(self, solutions: Solutions, group: A.Group, mark: str) -> Solutions:
        """Solutions with a column that tells whether a group has a solution for each."""
        known = solutions.known
        names = [n for n in known if n in A.mentioned(group)]
        if not A.loose(group) & known.keys():
            right = self.group(group, frozenset(known))
            if not any(x.known[n].nullable for x in (solutions, right) for n in right.known if n in known):
                return marked(solutions, right, mark)
        if not names:
            return marked(solutions, self.group(group, frozenset(known)), mark)
        self.marks += 1
        tag, before = f"outer${self.marks}", self.given
        self.given = bindings(solutions, names, tag)
        try:
            inner, filters = self._pattern(group, frozenset(known))
            if tag not in inner.known:
                inner = join(inner, self.given)
            for e in filters:
                inner = self.filtered(inner, e)
        finally:
            self.given = before
        return marked_by(solutions, names, tag, inner, mark)

    def _pattern(self, group: A.Group, outer: frozenset[str] = frozenset()) -> tuple[Solutions, list]:
        """A group's solutions before its filters, and the filters."""
        solutions, pending, filters = unit(self.spark), [], []

        def settle() -> None:
            nonlocal solutions
            if pending:
                solutions = join(solutions, self._triples(list(pending)))
                pending.clear()

        for element in group.elements:
            if isinstance(element, A.Triple):
                pending.append(element)
                continue
            if isinstance(element, A.Filter):
                filters += _conjuncts(element.condition)
                continue
            settle()
            if isinstance(element, A.Optional):
                solutions = self._optional(solutions, element)
            elif isinstance(element, A.Minus):
                solutions = filter_join(solutions, self.group(element.group), keep=False, need_shared=True)
            elif isinstance(element, A.Bind):
                solutions = self._told(solutions, [element.expression])
                compiler = self.compiler(solutions)
                value = typed(compiler.value(element.expression), solutions)
                solutions = compiler.scope.with_value(element.var.name, value)
            else:
                solutions = join(solutions, self._element(element, solutions, group, outer))
        settle()
        return solutions, filters

    def _element(self, element, solutions: Solutions, group: A.Group, outer: frozenset[str]) -> Solutions:
        beside = outer | {v for e in group.elements if e is not element for v in A.variables(e)}
        if isinstance(element, A.Union):
            return union([self.group(b, beside) for b in element.branches])
        if isinstance(element, A.Values):
            return self.values(element, solutions)
        if isinstance(element, A.SubSelect):
            query = element.query
            if self.correlated:
                query = self._promoted(query, beside)
            df, known = self.select(query)
            return Solutions(df, known)
        if isinstance(element, A.Graph):
            return self._graph(element, beside)
        if isinstance(element, A.Service):
            return self.services.solve(self, element)
        if isinstance(element, A.Group):
            return self.group(element, beside)
        raise UnsupportedFeature(type(element).__name__)

    def _triples(self, patterns: list[A.Triple]) -> Solutions:
        simple, long = [], []
        for p in patterns:
            for q in self._unfolded(p):
                (simple if isinstance(q.predicate, (A.Iri, A.Var)) else long).append(q)
        done = bgp.plan(self.ctx, simple) if simple else unit(self.spark)
        for p in long:
            done = join(done, paths.solve(self.ctx, p))
        return done

    def _unfolded(self, p: A.Triple) -> list[A.Triple]:
        """Sequences and inverses become plain patterns, so that stars can take them in."""
        if isinstance(p.predicate, A.Inverse):
            return self._unfolded(A.Triple(p.object, p.predicate.path, p.subject))
        if isinstance(p.predicate, A.Sequence):
            self.marks += 1
            nodes = [p.subject, *(A.Blank(f"p{self.marks}_{i}") for i in range(len(p.predicate.steps) - 1)), p.object]
            return [t for a, step, b in zip(nodes, p.predicate.steps, nodes[1:], strict=False) for t in self._unfolded(A.Triple(a, step, b))]
        return [p]

    def _optional(self, solutions: Solutions, element: A.Optional) -> Solutions:
        right, filters = self._pattern(element.group, frozenset(solutions.known))
        right = self._told(right, filters, solutions)
        inner = [e for e in filters if _plain(e) and A.mentioned(e) <= set(right.known)]
        for e in inner:
            right = self.filtered(right, e)
        rest = [e for e in filters if e not in inner]
        if any(not _plain(e) for e in rest):
            for e in [e for e in rest if not _plain(e)]:
                right = self.filtered(right, e)
            rest = [e for e in rest if _plain(e)]
        return left_join(solutions, right, self._conditions(rest) if rest else None)

    def _conditions(self, filters: list):
        return lambda scope: reduce(lambda a, b: a & b, (Compiler(scope, self.registry, self.ctx.mode).condition(e) for e in filters))

    def filtered(self, solutions: Solutions, e) -> Solutions:
        """Solutions that pass a filter; EXISTS at its top is a semi or anti join."""
        if isinstance(e, A.Unary) and e.op == "!" and isinstance(e.arg, A.Exists):
            e = A.Exists(e.arg.group, not e.arg.negated)
        if isinstance(e, A.Exists):
            # plain filters on top of the group become conditions of the join; what is deeper needs the bindings inside
            deep = A.Group(tuple(x for x in e.group.elements if not (isinstance(x, A.Filter) and _plain(x.condition))))
            if not A.loose(deep) & solutions.known.keys():
                right, filters = self._pattern(e.group, frozenset(solutions.known))
                right = self._told(right, filters, solutions)
                across = [f for f in filters if _plain(f) and not A.mentioned(f) <= set(right.known)]
                for f in filters:
                    if f not in across:
                        right = self.filtered(right, f)
                return filter_join(solutions, right, not e.negated, self._conditions(across) if across else None)
        compiler = self.compiler(solutions)
        condition = compiler.condition(e)
        return Solutions(compiler.scope.df.filter(condition), solutions.known).select(list(solutions.known)) if compiler.scope.df is not solutions.df else Solutions(solutions.df.filter(condition), solutions.known)

    def compiler(self, solutions: Solutions, computed: dict | None = None) -> Compiler:
        """A compiler whose EXISTS calls add mark columns to its scope."""
        out = Compiler(solutions, self.registry, self.ctx.mode, dict(computed or {}))

        def exists(e: A.Exists) -> Value:
            self.marks += 1
            mark = f"mark${self.marks}"
            known = out.scope.known
            columns = {column_of(n) for n in known}
            helpers = {c: Known() for c in out.scope.df.columns if c not in columns}  # marks, keys of groups and of the order
            flagged = self._marked(Solutions(out.scope.df, known | helpers), e.group, mark)
            out.scope = Solutions(flagged.df, known)
            return Value(~F.col(f"`{mark}`") if e.negated else F.col(f"`{mark}`"), "boolean")

        out.exists = exists
        return out

    def _graph(self, element: A.Graph, outer: frozenset[str]) -> Solutions:
        before = self.ctx
        try:
            if isinstance(element.name, A.Iri):
                self.ctx = replace(before, graphs=frozenset([element.name.value]))
                return self.group(element.group, outer)
            names = sorted({r.graph for r in before.store.all_rules() if r.graph and (before.graphs is None or r.graph in before.graphs)})
            parts = []
            for name in names:
                self.ctx = replace(before, graphs=frozenset([name]))
                found = self.group(element.group, outer)
                tagged = Value(F.lit(name), "string", "iri")
                if element.name.name in found.known:
                    parts.append(Solutions(found.df.filter(found.col(element.name.name) == name), found.known))
                else:
                    parts.append(found.with_value(element.name.name, tagged))
            return union(parts) if parts else empty(self.spark, list(dict.fromkeys([element.name.name, *A.variables(element.group)])))
        finally:
            self.ctx = before

    def values(self, element: A.Values, near: Solutions | None = None) -> Solutions:
        """Inline data as a local relation; Catalyst sees how small it is."""
        names = [v.name for v in element.variables]
        if not names:
            return unit(self.spark) if element.rows else empty(self.spark, [])
        if not element.rows:
            return empty(self.spark, names)
        columns, known = [], {}
        for i, name in enumerate(names):
            terms = [row[i] for row in element.rows]
            plain = [self._inline(t) for t in terms]
            kinds = {type(v) for v in plain if v is not None}
            kind = {bool: pa.bool_(), int: pa.int64(), float: pa.float64(), Decimal: pa.decimal128(38, 18)}.get(next(iter(kinds), str), pa.string()) if len(kinds) == 1 else pa.float64() if kinds and kinds <= {int, float, Decimal} else pa.string()
            if kind == pa.string():
                plain = [None if v is None else str(v) for v in plain]
            elif kind == pa.float64():
                plain = [None if v is None else float(v) for v in plain]
            columns.append(pa.array(plain, kind))
            bound = [t for t in terms if t is not None]
            known[name] = Known(len(bound) < len(terms), "iri" if bound and all(isinstance(t, A.Iri) for t in bound) else "literal" if all(isinstance(t, A.Literal) for t in bound) else "unknown")
        df = self.spark.createDataFrame(pa.Table.from_arrays(columns, names=[column_of(n) for n in names]))
        # dates given as typed literals
        for i, name in enumerate(names):
            types = {t.datatype for row in element.rows if isinstance(t := row[i], A.Literal)}
            if types in ({A.XSD + "date"}, {A.XSD + "dateTime"}):
                df = df.withColumn(column_of(name), F.col(f"`{column_of(name)}`").try_cast("date" if types == {A.XSD + "date"} else "timestamp"))
        return Solutions(df, known)

    def _inline(self, term):
        if term is None:
            return None
        if isinstance(term, A.Literal):
            return term.value
        if self.ctx.mode == "key":
            key = trailing_key(term.value)
            return int(key) if key.isdigit() else term.value
        return term.value

    def _promoted(self, query: A.Query, outside: set[str]) -> A.Query:
        """A grouped subquery whose unprojected variables occur outside is grouped by them too."""
        aggregated = query.group_by or any(self.aggregates(p.expression) for p in query.projection)
        projected = {p.var.name for p in query.projection}
        missing = [v for v in A.variables(query.where) if v in outside and v not in projected]
        if not aggregated or not missing:
            return query
        more = tuple(A.Projection(A.Var(v)) for v in missing)
        return replace(query, projection=(*query.projection, *more), group_by=(*query.group_by, *(m for m in more if m not in query.group_by)))

    # queries ------------------------------------------------------------------
    def select(self, query: A.Query) -> tuple[DataFrame, dict[str, Known]]:
        """A SELECT's DataFrame (columns named by column_of) and what is known of its variables."""
        before, self.given = self.given, None  # a subquery sees nothing from outside
        try:
            return self._select(query)
        finally:
            self.given = before

    def _select(self, query: A.Query) -> tuple[DataFrame, dict[str, Known]]:
        solutions = self.group(query.where)
        if query.values is not None:
            solutions = join(solutions, self.values(query.values))
        visible = [n for n in A.variables(query.where) if not n.startswith("_:")]
        if query.values is not None:
            visible += [v.name for v in query.values.variables if v.name not in visible]
        computed: dict = {}
        grouped = bool(query.group_by) or any(self.aggregates(p.expression) for p in query.projection) or any(self.aggregates(h) for h in query.having)
        if grouped:
            solutions, computed = self._grouped(query, solutions)
        for e in query.having:
            compiler = self.compiler(solutions, computed)
            solutions = Solutions(compiler.scope.df.filter(compiler.condition(e)), solutions.known)
        names = [p.var.name for p in query.projection] or [n for n in dict.fromkeys(visible) if n in solutions.known]
        for p in query.projection:
            if p.expression is not None:
                compiler = self.compiler(solutions, computed)
                value = typed(compiler.value(p.expression), compiler.scope)
                solutions = Solutions(compiler.scope.df, solutions.known).with_value(p.var.name, value)
            elif p.var.name not in solutions.known:
                solutions = solutions.with_value(p.var.name, Value(F.lit(None).cast("string"), "string", "unknown"))
        order = []
        for i, (e, down) in enumerate(query.order_by):
            compiler = self.compiler(solutions, computed)
            value = compiler.value(e)
            solutions = Solutions(compiler.scope.df.withColumn(f"order${i}", value.col), solutions.known)
            order.append(_way(F.col(f"`order${i}`"), down))
        if query.distinct:
            # keys that are not projected cannot order distinct rows; projected ones are computed again
            solutions = Solutions(solutions.select(names).df.distinct(), {n: solutions.known[n] for n in names})
            order = [_way(Compiler(solutions, self.registry, self.ctx.mode).value(e).col, down) for e, down in query.order_by]
        df = solutions.df
        if order:
            df = df.orderBy(*order)
        if query.offset:
            df = df.offset(query.offset)
        if query.limit is not None:
            df = df.limit(query.limit)
        return df.select(*(solutions.col(n) for n in names)), {n: solutions.known[n] for n in names}

    def _grouped(self, query: A.Query, solutions: Solutions) -> tuple[Solutions, dict]:
        keys: list[str] = []
        computed: dict = {}
        for i, g in enumerate(query.group_by):
            name = g.var.name if isinstance(g, A.Projection) else f"group${i}"
            expression = g.expression if isinstance(g, A.Projection) else g
            if expression is not None:
                compiler = self.compiler(solutions)
                value = typed(compiler.value(expression), solutions)
                solutions = compiler.scope.with_value(name, value)
            elif name not in solutions.known:
                solutions = solutions.with_value(name, Value(F.lit(None).cast("string"), "string", "unknown"))
            keys.append(name)
            if not isinstance(g, A.Projection):
                computed[g] = name
        if not query.group_by:  # variables projected beside aggregates are keys
            keys = [p.var.name for p in query.projection if p.expression is None and p.var.name in solutions.known]
        calls = list(dict.fromkeys(a for e in (*(p.expression for p in query.projection), *query.having, *(o for o, _ in query.order_by)) for a in self.aggregates(e)))
        compiler = Compiler(solutions, self.registry, self.ctx.mode)
        values = [compiler.aggregate(c) for c in calls]
        columns = [v.col.alias(f"agg${i}") for i, v in enumerate(values)]
        by = [solutions.col(k) for k in keys]
        if columns:
            df = solutions.df.groupBy(*by).agg(*columns) if by else solutions.df.agg(*columns)
        else:
            df = solutions.df.select(*by).distinct()
        known = {k: solutions.known[k] for k in keys}
        out = Solutions(df, known)
        found: dict = {c: Value(F.col(f"`agg${i}`"), v.type, v.kind, v.lang, v.datatype) for i, (c, v) in enumerate(zip(calls, values, strict=True))}
        found |= {g: out.value(name) for g, name in computed.items()}
        return out, found

    def construct(self, query: A.Query) -> DataFrame:
        """The distinct triples of a template: subject, predicate, object as text."""
        solutions = self.group(query.where)
        scope = Solutions(solutions.df, solutions.known)
        if any(isinstance(t, A.Blank) for p in query.template for t in (p.subject, p.object)):
            scope = Solutions(solutions.df.withColumn("row$", F.monotonically_increasing_id().cast("string")), solutions.known)

        def text(term) -> Column:
            if isinstance(term, A.Var):
                return scope.value(term.name).text() if term.name in scope.known else F.lit(None).cast("string")
            if isinstance(term, A.Blank):
                return F.concat(F.lit(f"_:{term.label}_"), F.col("`row$`"))
            return F.lit(str(term.value))

        triples = [F.struct(text(p.subject).alias("subject"), text(p.predicate).alias("predicate"), text(p.object).alias("object")) for p in query.template]
        if query.limit is not None or query.offset:
            df = scope.df.offset(query.offset or 0)
            scope = Solutions(df.limit(query.limit) if query.limit is not None else df, scope.known)
        rows = scope.df.select(F.explode(F.array(*triples)).alias("t")).select("t.*")
        return rows.filter("subject is not null and predicate is not null and object is not null").distinct()

    def describe(self, query: A.Query) -> DataFrame:
        """All triples whose subject is a described node: subject, predicate, object as text."""
        iris = [t for t in query.describe if isinstance(t, A.Iri)]
        names = [t.name for t in query.describe if isinstance(t, A.Var)]
        solutions = self.group(query.where) if query.where.elements else None
        if solutions is not None and not query.describe:
            names = list(solutions.known)
        parts = []
        for iri in iris:
            pattern = [A.Triple(iri, A.Var("p"), A.Var("o"))]
            found = bgp.plan(self.ctx, pattern)
            key = paths._constant(self.ctx, iri)
            parts.append(_texts(found.with_value("s", Value(F.lit(key), "string", "iri"))))
        for name in names:
            rows = solutions.select([name]).df.distinct()
            if query.limit is not None:
                rows = rows.limit(query.limit)
            every = bgp.plan(self.ctx, [A.Triple(A.Var(name), A.Var("p"), A.Var("o"))])
            shape = solutions.known[name].shape
            if shape is not None:
                every = self._of_shape(name, shape)
            parts.append(_texts(join(every, Solutions(rows, {name: solutions.known[name]})), name))
        if not parts:
            return self.spark.range(0).select(*(F.lit("").alias(c) for c in ("subject", "predicate", "object")))
        return reduce(DataFrame.unionByName, parts).distinct()

    def _of_shape(self, name: str, shape: str) -> Solutions:
        pattern = A.Triple(A.Var(name), A.Var("p"), A.Var("o"))
        scans = [scan(self.ctx.catalog, pattern.subject, [(r, pattern, inv)], self.ctx.mode, False) for r, inv in bgp.choices(self.ctx, pattern) if r.subject.shape == shape]
        return union([s for s in scans if s is not None])


def _texts(s: Solutions, subject: str = "s") -> DataFrame:
    return s.df.select(*(s.value(n).text().alias(a) for n, a in ((subject, "subject"), ("p", "predicate"), ("o", "object"))))


def _way(column: Column, down: bool) -> Column:
    """Unbound values are least."""
    return column.desc_nulls_last() if down else column.asc_nulls_first()


def _conjuncts(e) -> list:
    return [*_conjuncts(e.left), *_conjuncts(e.right)] if isinstance(e, A.Binary) and e.op == "&&" else [e]


def _plain(e) -> bool:
    """No EXISTS inside."""
    if isinstance(e, A.Exists):
        return False
    if isinstance(e, (tuple, list)):
        return all(map(_plain, e))
    return all(_plain(getattr(e, f)) for f in e.__dataclass_fields__) if hasattr(e, "__dataclass_fields__") else True
