"""Expressions to columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from trellis.errors import UnsupportedFeature
from trellis.functions.builtins import Registry, unified
from trellis.functions.values import Value, comparable, constant, short
from trellis.operators.scans import trailing_key
from trellis.plans.scope import Solutions
from trellis.sparql import ast as A
from trellis.sparql.parser import AGGREGATES, WINDOW_ONLY

_TIMES = ("date", "timestamp", "timestamp_ntz")
_NAMES = {"RANK": F.rank, "DENSE_RANK": F.dense_rank, "ROW_NUMBER": F.row_number, "PERCENT_RANK": F.percent_rank, "CUME_DIST": F.cume_dist}


@dataclass
class Compiler:
    """Compiles expressions over a scope.  ``computed``: expressions that have columns already (aggregates, EXISTS)."""

    scope: Solutions
    registry: Registry
    mode: str = "key"
    computed: dict[object, Value] = field(default_factory=dict)
    exists: Callable[[A.Exists], Value] | None = None

    def value(self, e) -> Value:
        if e in self.computed:
            return self.computed[e]
        if isinstance(e, A.Var):
            return self.scope.value(e.name) if e.name in self.scope.known else Value(F.lit(None).cast("string"), "string", "unknown")
        if isinstance(e, (A.Iri, A.Literal)):
            return constant(e)
        if isinstance(e, A.Unary):
            x = self.value(e.arg)
            return Value(~self._truth(x), "boolean") if e.op == "!" else Value(F.negative(x.number()), x.type if x.numeric else "double")
        if isinstance(e, A.Binary):
            return self._binary(e)
        if isinstance(e, A.Among):
            found: Column | None = None
            for option in e.options:
                one = self._equal(self.value(e.arg), self.value(option))
                found = one if found is None else found | one
            found = F.lit(False) if found is None else found
            return Value(~found if e.negated else found, "boolean")
        if isinstance(e, A.Exists):
            if self.exists is None:
                raise UnsupportedFeature("EXISTS in this place")
            return self.exists(e)
        if isinstance(e, A.Call):
            return self._call(e)
        raise UnsupportedFeature(f"expression {e}")

    def condition(self, e) -> Column:
        """A filter's column: errors and unbound values do not pass."""
        return self._truth(self.value(e))

    def _truth(self, x: Value) -> Column:
        """The effective boolean value."""
        if x.type in ("boolean", None):
            return x.col
        return x.col != 0 if x.numeric else F.length(x.text()) > 0

    def _binary(self, e: A.Binary) -> Value:
        if e.op in ("&&", "||"):
            a, b = self._truth(self.value(e.left)), self._truth(self.value(e.right))
            return Value(a & b if e.op == "&&" else a | b, "boolean")
        a, b = self.value(e.left), self.value(e.right)
        if e.op in ("=", "!="):
            same = self._equal(a, b)
            return Value(same if e.op == "=" else ~same, "boolean")
        if e.op in ("<", "<=", ">", ">="):
            x, y = comparable(a, b)
            return Value({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.op], "boolean")
        if e.op == "-" and a.type in _TIMES and b.type in _TIMES:
            return Value(F.date_diff(a.col, b.col).cast("bigint"), "bigint")
        x, y = a.number(), b.number()
        op = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[e.op]
        _, _, wide = unified(a if a.numeric else Value(x, "double"), b if b.numeric else Value(y, "double"))
        if e.op == "/":
            return Value(op(x, y), "decimal" if wide == "decimal" else "double")
        return Value(op(x, y), wide)

    def _equal(self, a: Value, b: Value) -> Column:
        for x, y in ((a, b), (b, a)):
            if isinstance(y.constant, A.Iri) and x.constant is None and self.mode == "key" and x.type != "string":
                return x.col == F.lit(trailing_key(y.constant.value)).try_cast("bigint" if x.type in ("int", "smallint", "tinyint", "bigint") else x.type or "string")
        x, y = comparable(a, b)
        return x == y

    def _call(self, e: A.Call) -> Value:
        if e.over is not None:
            return self._window(e)
        if e.name in AGGREGATES or e.name in self.registry.aggregates:
            return self.aggregate(e)
        if e.name in WINDOW_ONLY:
            raise UnsupportedFeature(f"{e.name} without OVER")
        return self.registry.call(e.name, [self.value(a) for a in e.args])

    def aggregate(self, e: A.Call) -> Value:
        """An aggregate's column, for groupBy or a window."""
        if e.name in self.registry.aggregates:
            return typed(Value(self.registry.aggregates[e.name](*(self.value(a).col for a in e.args))), self.scope)
        if e.name == "COUNT" and not e.args:
            return Value(self._count_all(e.distinct), "bigint")
        x = self.value(e.args[0])
        if e.name == "COUNT":
            return Value(F.count_distinct(x.col) if e.distinct else F.count(x.col), "bigint")
        if e.name in ("SUM", "AVG"):
            n = x.number()
            if e.name == "AVG":
                return Value(_avg_distinct(n) if e.distinct else F.avg(n), "decimal" if x.type == "decimal" else "double")
            kind = x.type if x.type in ("double", "float", "decimal") else ("bigint" if x.numeric else "double")
            return Value(F.coalesce(F.sum_distinct(n) if e.distinct else F.sum(n), F.lit(0)), "double" if kind == "float" else kind)
        if e.name in ("MIN", "MAX"):
            return x.with_col((F.min if e.name == "MIN" else F.max)(x.col))
        if e.name == "SAMPLE":
            return x.with_col(F.min(x.col))  # any value will do; the least one is the same each time
        items = F.array_sort(F.collect_set(x.text()) if e.distinct else F.collect_list(x.text()))
        return Value(F.array_join(items, e.separator if e.separator is not None else " "), "string")

    def _count_all(self, distinct: bool) -> Column:
        if not distinct:
            return F.count("*")
        return F.count_distinct(F.struct(*(self.scope.col(n) for n in self.scope.known)))

    def _window(self, e: A.Call) -> Value:
        window = Window.partitionBy(*(self.value(p).col for p in e.over.partition))
        order = [self.value(o).col.desc() if down else self.value(o).col.asc() for o, down in e.over.order]
        if order:
            window = window.orderBy(*order)
        if e.name in _NAMES:
            return Value(_NAMES[e.name]().over(window).cast("double" if e.name in ("PERCENT_RANK", "CUME_DIST") else "bigint"), "double" if e.name in ("PERCENT_RANK", "CUME_DIST") else "bigint")
        if e.name == "NTILE":
            return Value(F.ntile(int(e.args[0].value)).over(window).cast("bigint"), "bigint")
        if e.name in ("LAG", "LEAD"):
            x = self.value(e.args[0])
            n = int(e.args[1].value) if len(e.args) > 1 else 1
            return x.with_col((F.lag if e.name == "LAG" else F.lead)(x.col, n).over(window))
        if e.name in ("FIRST_VALUE", "LAST_VALUE"):
            x = self.value(e.args[0])
            return x.with_col((F.first if e.name == "FIRST_VALUE" else F.last)(x.col).over(window))
        if e.name in AGGREGATES:
            x = self.aggregate(A.Call(e.name, e.args, e.distinct, e.separator))
            if order:
                window = window.rangeBetween(Window.unboundedPreceding, Window.currentRow)
            if e.name == "SUM":  # a sum that may be missing: the coalesce stands outside the window
                n = self.value(e.args[0])
                return Value(F.coalesce(F.sum(n.number()).over(window), F.lit(0)), x.type)
            return x.with_col(x.col.over(window))
        raise UnsupportedFeature(f"{e.name} OVER")


def _avg_distinct(n: Column) -> Column:
    return F.try_divide(F.sum_distinct(n), F.count_distinct(n))


def aggregates_in(e, names=AGGREGATES) -> list[A.Call]:
    """Aggregate calls of an expression, outermost only, without those of windows' own function."""
    if isinstance(e, A.Call):
        if e.over is not None:
            inner = [a for x in (*e.args, *e.over.partition, *(o for o, _ in e.over.order)) for a in aggregates_in(x, names)]
            return inner
        if e.name in names:
            return [e]
    if isinstance(e, (tuple, list)):
        return [a for x in e for a in aggregates_in(x, names)]
    if hasattr(e, "__dataclass_fields__") and not isinstance(e, (A.Exists, A.Group)):
        return [a for f in e.__dataclass_fields__ for a in aggregates_in(getattr(e, f), names)]
    return []


def typed(value: Value, scope: Solutions) -> Value:
    """A value with the type that Spark gives its column, where it was not known."""
    if value.type is not None:
        return value
    kind = short(scope.df.select(value.col.alias("x")).schema["x"].dataType.simpleString())
    return Value(value.col, kind, value.kind, value.lang, value.datatype)
