"""Values of expressions: a column with what is known of its RDF type while planning."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.sparql import ast as A

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
# Datatype of each kind of column.
XSD_OF = {
    "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "float", "double": "double", "decimal": "decimal",
    "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "string": "string", "time": "time",
}
SPARK_OF = {"integer": "bigint", "int": "bigint", "long": "bigint", "decimal": "decimal(38,18)", "float": "float", "double": "double", "boolean": "boolean", "string": "string", "date": "date", "dateTime": "timestamp"}


@dataclass(frozen=True)
class Value:
    col: Column
    type: str | None = None  # Spark's simple name, decimals without their scale
    kind: str = "literal"  # iri, literal, blank, unknown
    lang: str | None = None
    datatype: str | None = None
    constant: A.Term | None = None

    @property
    def numeric(self) -> bool:
        return self.type in NUMERIC

    @property
    def xsd(self) -> str:
        if self.lang:
            return A.RDF + "langString"
        return self.datatype or A.XSD + XSD_OF.get(self.type or "string", "string")

    def with_col(self, col: Column, type_: str | None = None) -> Value:
        return replace(self, col=col, type=type_ or self.type, constant=None)

    def text(self) -> Column:
        return self.col if self.type == "string" else self.col.cast("string")

    def number(self) -> Column:
        """The value as a number; text that is none is unbound."""
        return self.col if self.numeric else self.col.try_cast("double")


def short(type_name: str) -> str:
    return type_name.partition("(")[0]


def constant(term: A.Term) -> Value:
    """A literal or IRI as a value."""
    if isinstance(term, A.Iri):
        return Value(F.lit(term.value), "string", "iri", constant=term)
    short_type = term.datatype.removeprefix(A.XSD)
    col, kind = F.lit(term.value), {bool: "boolean", int: "bigint", float: "double", str: "string"}.get(type(term.value), "decimal")
    if isinstance(term.value, int) and not isinstance(term.value, bool):
        col = F.lit(term.value).cast("bigint") if abs(term.value) < 1 << 63 else F.lit(str(term.value)).cast("decimal(38,0)")
    if isinstance(term.value, str) and short_type in ("date", "dateTime"):
        kind = SPARK_OF[short_type]
        col = col.try_cast(kind)
    return Value(col, kind, lang=term.lang, datatype=term.datatype, constant=term)


def comparable(a: Value, b: Value) -> tuple[Column, Column]:
    """Both sides in a common type; text that has no such value is unbound rather than an error."""
    if a.type == b.type or a.type is None or b.type is None or (a.numeric and b.numeric):
        return a.col, b.col
    times = ("date", "timestamp", "timestamp_ntz")
    for x, y, flip in ((a, b, False), (b, a, True)):
        if x.type == "string":
            if y.numeric:
                pair = (x.col.try_cast("double"), y.col)
            elif y.type in (*times, "boolean"):
                pair = (x.col.try_cast(y.type), y.col)
            else:
                pair = (x.col, y.col.cast("string"))
            return (pair[1], pair[0]) if flip else pair
    if {a.type, b.type} == {"timestamp", "timestamp_ntz"}:  # the constant follows the column, so that filters reach the scan
        return (a.col.cast(b.type), b.col) if a.constant is not None else (a.col, b.col.cast(a.type))
    if a.type in times and b.type in times:
        return a.col.cast("timestamp"), b.col.cast("timestamp")
    return a.col.cast("string"), b.col.cast("string")
