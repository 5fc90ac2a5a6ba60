"""Solutions: a DataFrame whose columns are variables, with what is known of each."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.builtins import unified
from trellis.functions.values import Value, short


@dataclass(frozen=True)
class Known:
    """What planning knows of a variable."""

    nullable: bool = False
    kind: str = "unknown"
    lang: str | None = None
    datatype: str | None = None
    shape: str | None = None  # template of its IRIs


def column_of(name: str) -> str:
    """A column name that differs for variables that differ in case only."""
    upper = [str(i) for i, c in enumerate(name) if c != c.lower()]
    return name.lower() + ("$" + "_".join(upper) if upper else "")


@dataclass
class Solutions:
    df: DataFrame
    known: dict[str, Known]
    is_unit: bool = False

    def col(self, name: str) -> Column:
        return F.col(f"`{column_of(name)}`")

    def type_of(self, name: str) -> str:
        return short(self.df.schema[column_of(name)].dataType.simpleString())

    def value(self, name: str) -> Value:
        k = self.known[name]
        return Value(self.col(name), self.type_of(name), k.kind, k.lang, k.datatype)

    def select(self, names: list[str]) -> Solutions:
        return Solutions(self.df.select(*(self.col(n) for n in names)), {n: self.known[n] for n in names})

    def with_value(self, name: str, value: Value) -> Solutions:
        return Solutions(self.df.withColumn(column_of(name), value.col), self.known | {name: Known(True, value.kind, value.lang, value.datatype)})

    def output(self, names: list[str]) -> DataFrame:
        """Columns named as the variables are; those never bound are null."""
        return self.df.select(*(self.col(n).alias(n) if n in self.known else F.lit(None).cast("string").alias(n) for n in names))


def unit(spark: SparkSession) -> Solutions:
    """The one empty solution."""
    return Solutions(spark.range(1).select(), {}, True)


def empty(spark: SparkSession, names: list[str]) -> Solutions:
    df = spark.range(0).select(*(F.lit(None).cast("string").alias(column_of(n)) for n in names))
    return Solutions(df, {n: Known(True) for n in names})


def _both(a: Known, b: Known, nullable: bool) -> Known:
    return Known(nullable, a.kind if a.kind == b.kind else ("unknown" if "unknown" in (a.kind, b.kind) else a.kind), a.lang if a.lang == b.lang else None, a.datatype if a.datatype == b.datatype else None, a.shape or b.shape)


def _aligned(left: Solutions, right: Solutions, shared: list[str]) -> tuple[Solutions, Solutions]:
    """Shared variables in types that compare without an error."""
    for name in shared:
        a, b = left.value(name), right.value(name)
        if a.type == b.type or (a.numeric and b.numeric):
            continue
        x, y, _ = unified(a, b)
        left = Solutions(left.df.withColumn(column_of(name), x), left.known)
        right = Solutions(right.df.withColumn(column_of(name), y), right.known)
    return left, right


def _renamed(right: Solutions, shared: list[str]) -> Solutions:
    return Solutions(right.df.withColumnsRenamed({column_of(n): "right$" + column_of(n) for n in shared}), right.known)


def right_col(name: str) -> Column:
    return F.col(f"`right${column_of(name)}`")


def compatible(left: Solutions, right: Solutions, shared: list[str]) -> list[Column]:
    """Conditions that shared variables agree; an unbound one agrees with anything."""
    out = []
    for n in shared:
        same, free = left.col(n) == right_col(n), []
        if left.known[n].nullable:
            free.append(left.col(n).isNull())
        if right.known[n].nullable:
            free.append(right_col(n).isNull())
        out.append(reduce(lambda a, b: a | b, free, same))
    return out


#: More than so many ways to be unbound are one join with the condition spelt out.
_MOST_CASES = 16


def _where(df: DataFrame, columns: list[Column], bound: frozenset[int]) -> DataFrame:
    for i, c in enumerate(columns):
        df = df.filter(c.isNotNull() if i in bound else c.isNull())
    return df


def _subsets(n: int) -> list[frozenset[int]]:
    return [frozenset(i for i in range(n) if bits >> i & 1) for bits in range(1 << n)]


def cases(left: Solutions, right: Solutions, other: DataFrame, shared: list[str]) -> list[tuple[DataFrame, list[tuple[DataFrame, list[Column]]]]]:
    """The left solutions by which shared variables are bound, each with the right ones that may agree and equalities.

    Every pair of compatible solutions is in one case, so that each case is an equi-join; ``other``: the renamed right side.
    """
    free = [n for n in shared if left.known[n].nullable]
    open_ = [n for n in shared if right.known[n].nullable]
    if len(free) + len(open_) > _MOST_CASES.bit_length() - 1:
        return [(left.df, [(other, compatible(left, right, shared))])]
    out = []
    for bound in _subsets(len(free)):
        unbound = {n for i, n in enumerate(free) if i not in bound}
        need = [n for n in open_ if n not in unbound]
        found = []
        for there in _subsets(len(need)):
            missing = unbound | {n for i, n in enumerate(need) if i not in there}
            found.append((_where(other, [right_col(n) for n in need], there), [left.col(n) == right_col(n) for n in shared if n not in missing]))
        out.append((_where(left.df, [left.col(n) for n in free], bound), found))
    return out


def _on(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def _matching(parts, keep: bool, more: list[Column], need_equal: bool = False) -> DataFrame:
    """The left solutions of ``cases`` with (without) a right one; each once."""
    out = []
    for df, found in parts:
        for other, equal in found:
            if need_equal and not equal:
                continue
            if keep:
                out.append(df.join(other, _on(equal + more), "left_semi"))
            df = df.join(other, _on(equal + more), "left_anti")
        if not keep:
            out.append(df)
    return reduce(DataFrame.unionAll, out) if out else parts[0][0].limit(0)


def shared_of(left: Solutions, right: Solutions) -> list[str]:
    return [n for n in left.known if n in right.known]


def join(left: Solutions, right: Solutions) -> Solutions:
    """Natural join; the physical join is Catalyst's choice."""
    shared = shared_of(left, right)
    if left.is_unit:
        return right
    if right.is_unit:
        return left
    if not shared:
        return Solutions(left.df.crossJoin(right.df), left.known | right.known)
    left, right = _aligned(left, right, shared)
    known = left.known | right.known | {n: _both(left.known[n], right.known[n], left.known[n].nullable and right.known[n].nullable) for n in shared}
    if not any(s.known[n].nullable for s in (left, right) for n in shared):
        return Solutions(left.df.join(right.df, [column_of(n) for n in shared]), known)
    other = _renamed(right, shared)
    return Solutions(_joined(left, right, other, shared, []), known)


def _joined(left: Solutions, right: Solutions, other: Solutions, shared: list[str], more: list[Column]) -> DataFrame:
    parts = [df.join(there, _on(equal + more)) for df, found in cases(left, right, other.df, shared) for there, equal in found]
    return reduce(DataFrame.unionAll, (_merged(df, left, right, shared) for df in parts))


def _merged(df: DataFrame, left: Solutions, right: Solutions, shared: list[str]) -> DataFrame:
    columns = [F.coalesce(left.col(n), right_col(n)).alias(column_of(n)) if n in shared and left.known[n].nullable else left.col(n) for n in left.known]
    return df.select(*columns, *(right.col(n) for n in right.known if n not in shared))


def left_join(left: Solutions, right: Solutions, condition=None) -> Solutions:
    """OPTIONAL; ``condition`` gives the filter's column for the joined solutions."""
    shared = shared_of(left, right)
    left, right = _aligned(left, right, shared)
    other = _renamed(right, shared)
    known = left.known | {n: replace(right.known[n], nullable=True) for n in right.known if n not in shared}
    for n in shared:
        known[n] = _both(left.known[n], right.known[n], left.known[n].nullable)
    more = [condition(_Pair(left, right, other, shared))] if condition is not None else []
    parts = cases(left, right, other.df, shared)
    if len(parts) == 1 and len(parts[0][1]) == 1:
        return Solutions(_merged(left.df.join(other.df, _on(parts[0][1][0][1] + more), "left"), left, right, shared), known)
    alone = _matching(parts, False, more).select(*(left.col(n) for n in left.known), *(F.lit(None).cast(right.df.schema[column_of(n)].dataType).alias(column_of(n)) for n in right.known if n not in shared))
    return Solutions(_joined(left, right, other, shared, more).unionAll(alone), known)


class _Pair(Solutions):
    """Both sides of a join as one scope for its condition."""

    def __init__(self, left: Solutions, right: Solutions, renamed: Solutions, shared: list[str]):
        self.left, self.right, self.shared = left, right, shared
        super().__init__(left.df, right.known | left.known)

    def col(self, name: str) -> Column:
        if name in self.shared:
            return F.coalesce(self.left.col(name), right_col(name)) if self.left.known[name].nullable else self.left.col(name)
        return (self.left if name in self.left.known else self.right).col(name)

    def type_of(self, name: str) -> str:
        return (self.left if name in self.left.known else self.right).type_of(name)


def filter_join(left: Solutions, right: Solutions, keep: bool, condition=None, need_shared: bool = False) -> Solutions:
    """Solutions of ``left`` with (without) a compatible one in ``right``: EXISTS and MINUS."""
    shared = shared_of(left, right)
    if need_shared and not shared:
        return left
    left, right = _aligned(left, right, shared)
    names = list(right.known) if condition is not None else shared
    narrow = right.select(names) if names else Solutions(right.df.select(F.lit(1).alias("right$one")).limit(1), {})
    other = _renamed(narrow, shared) if names else narrow
    more = [condition(_Pair(left, narrow, other, shared))] if condition is not None else []
    parts = cases(left, narrow, other.df, shared)
    if need_shared and parts[0][0] is left.df and any(left.known[n].nullable or narrow.known[n].nullable for n in shared):
        # MINUS takes away only where some shared variable is bound on both sides
        more.append(reduce(lambda a, b: a | b, (left.col(n).isNotNull() & right_col(n).isNotNull() for n in shared)))
    return Solutions(_matching(parts, keep, more, need_shared), left.known)


def marked(left: Solutions, right: Solutions, mark: str) -> Solutions:
    """``left`` with a boolean column that tells whether a compatible solution exists; shared variables are bound."""
    shared = shared_of(left, right)
    left, right = _aligned(left, right, shared)
    if not shared:
        flag = right.df.limit(1).agg((F.count("*") > 0).alias(mark))
        return Solutions(left.df.crossJoin(F.broadcast(flag)), left.known)
    narrow = Solutions(right.select(shared).df.distinct(), {n: right.known[n] for n in shared})
    other = _renamed(narrow, shared)
    flagged = other.df.withColumn(mark, F.lit(True))
    df = left.df.join(flagged, reduce(lambda a, b: a & b, compatible(left, narrow, shared)), "left")
    return Solutions(df.select(*(left.col(n) for n in left.known), F.coalesce(F.col(mark), F.lit(False)).alias(mark)), left.known)


def _tag(left: Solutions, names: list[str]) -> Column:
    """What tells solutions apart by some variables; unbound ones are equal to each other."""
    return F.struct(*(left.col(n) for n in names), F.lit(1).alias("one"))


def bindings(left: Solutions, names: list[str], tag: str) -> Solutions:
    """The distinct bindings of some variables, each with its tag."""
    df = left.df.select(*(left.col(n) for n in names)).distinct()
    narrow = Solutions(df, {n: left.known[n] for n in names})
    return Solutions(df.withColumn(tag, _tag(narrow, names)), narrow.known | {tag: Known()})


def marked_by(left: Solutions, names: list[str], tag: str, found: Solutions, mark: str) -> Solutions:
    """``left`` with a boolean column that tells whether the tag of its bindings is among those found."""
    flagged = found.df.select(found.col(tag)).distinct().withColumn(mark, F.lit(True))
    df = left.df.withColumn(tag, _tag(left, names)).join(flagged, tag, "left")
    return Solutions(df.select(*(left.col(n) for n in left.known), F.coalesce(F.col(mark), F.lit(False)).alias(mark)), left.known)


def union(parts: list[Solutions]) -> Solutions:
    """All solutions of all parts; types are widened, or become text where they differ."""
    names = list(dict.fromkeys(n for p in parts for n in p.known))
    types: dict[str, str | None] = {}
    for n in names:
        found = [p.value(n) for p in parts if n in p.known]
        out = found[0]
        for v in found[1:]:
            out = out.with_col(out.col, unified(out, v)[2])
        types[n] = out.type if any(v.type != out.type for v in found) else None
    frames = []
    for p in parts:
        columns = []
        for n in names:
            if n not in p.known:
                columns.append(F.lit(None).alias(column_of(n)))
            elif types[n] and p.type_of(n) != types[n]:
                columns.append(p.col(n).cast(types[n]).alias(column_of(n)) if types[n] != "decimal" else p.col(n).cast("decimal(38,18)").alias(column_of(n)))
            else:
                columns.append(p.col(n))
        frames.append(p.df.select(*columns))
    known = {}
    for n in names:
        infos = [p.known.get(n) for p in parts]
        have = [k for k in infos if k]
        known[n] = reduce(lambda a, b: _both(a, b, a.nullable or b.nullable), have) if have else Known(True)
        shapes = {k.shape for k in have}
        known[n] = replace(known[n], nullable=known[n].nullable or None in infos, shape=shapes.pop() if len(shapes) == 1 else None)
    return Solutions(reduce(DataFrame.unionByName, frames), known)
