"""Built-in functions, each a composition of Spark's own functions (only geometry needs Python)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.errors import QuerySyntaxError, UnsupportedFeature
from trellis.functions import geo
from trellis.functions.values import SPARK_OF, Value, comparable
from trellis.sparql import ast as A

GEOF = "http://www.opengis.net/def/function/geosparql/"


@dataclass(frozen=True)
class Function:
    build: Callable[..., Value]
    least: int
    most: int | None


@dataclass
class Registry:
    """Functions by upper-case name or IRI; users add their own."""

    functions: dict[str, Function] = field(default_factory=dict)
    aggregates: dict[str, Callable[..., Column]] = field(default_factory=dict)

    def register_aggregate(self, name: str, build: Callable[..., Column]) -> None:
        """``build`` takes the arguments' columns and returns an aggregate (Spark's own, or a grouped pandas UDF)."""
        self.aggregates[name if ":" in name else name.upper()] = build

    def register(self, name: str, build: Callable[..., Column | Value], least: int = 0, most: int | None = None) -> None:
        """``build`` takes the arguments' columns and returns a column (any Spark function or UDF)."""

        def wrapped(*args: Value) -> Value:
            out = build(*(a.col for a in args))
            return out if isinstance(out, Value) else Value(out)

        self.functions[name if ":" in name else name.upper()] = Function(wrapped, least, most)

    def call(self, name: str, args: list[Value]) -> Value:
        found = self.functions.get(name) or BUILTINS.get(name)
        if found is None and name.startswith(A.XSD):
            return cast(args[0], name.removeprefix(A.XSD))
        if found is None:
            raise UnsupportedFeature(f"unknown function {name}")
        if len(args) < found.least or (found.most is not None and len(args) > found.most):
            raise QuerySyntaxError(f"{name} takes {found.least}{'' if found.most == found.least else f' to {found.most}'} arguments, {len(args)} given")
        return found.build(*args)


def cast(x: Value, name: str) -> Value:
    """xsd casts; what cannot be cast is unbound."""
    to = SPARK_OF.get(name)
    if to is None:
        raise UnsupportedFeature(f"cast to xsd:{name}")
    if to == "string":
        return Value(x.text(), "string")
    if to == "bigint" and x.type == "string":
        return Value(x.col.try_cast("decimal(38,18)").try_cast("bigint"), "bigint", datatype=A.XSD + name)
    return Value(x.col.try_cast(to), to.partition("(")[0], datatype=A.XSD + name)


def _text(fn: Callable[..., Column], type_: str = "string") -> Callable[..., Value]:
    """A function of texts; a text result keeps the first argument's language."""
    return lambda *args: Value(fn(*(a.text() for a in args)), type_, lang=args[0].lang if args and type_ == "string" else None)


def _number(fn: Callable[[Column], Column], whole: bool = False) -> Callable[..., Value]:
    return lambda x: Value(fn(x.number()), ("bigint" if whole and x.type in ("double", "float", "string") else x.type) if x.numeric else "double")


def _substr(s: Value, start: Value, length: Value | None = None) -> Value:
    begin = start.number().cast("int")
    if length is None:
        return Value(F.substring(s.text(), begin, F.lit(2147483647)), "string", lang=s.lang)
    return Value(F.substring(s.text(), begin, length.number().cast("int")), "string", lang=s.lang)


def _before(a: Column, b: Column) -> Column:
    at = F.position(b, a)
    return F.when(F.length(b) == 0, F.lit("")).when(at > 0, F.substring(a, F.lit(1), at - 1)).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit("")))


def _after(a: Column, b: Column) -> Column:
    at = F.position(b, a)
    return F.when(F.length(b) == 0, a).when(at > 0, F.substring(a, at + F.length(b), F.lit(2147483647))).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit("")))


def _flagged(pattern: Value, flags: Value | None) -> Column:
    return pattern.text() if flags is None else F.when(F.length(flags.text()) > 0, F.concat(F.lit("(?"), F.replace(flags.text(), F.lit("q"), F.lit("")), F.lit(")"), pattern.text())).otherwise(pattern.text())


def _regex(t: Value, p: Value, flags: Value | None = None) -> Value:
    return Value(t.text().rlike(p.constant.value) if flags is None and p.constant is not None else F.regexp_like(t.text(), _flagged(p, flags)), "boolean")


def _replace(t: Value, p: Value, r: Value, flags: Value | None = None) -> Value:
    return Value(F.regexp_replace(t.text(), _flagged(p, flags), r.text()), "string", lang=t.lang)


def _if(c: Value, a: Value, b: Value) -> Value:
    x, y, type_ = unified(a, b)
    return Value(F.when(c.col, x).when(~c.col, y), type_, a.kind if a.kind == b.kind else "unknown")


def unified(a: Value, b: Value) -> tuple[Column, Column, str | None]:
    """Both in one type: the wider number, or text."""
    if a.type == b.type:
        return a.col, b.col, a.type
    if a.numeric and b.numeric:
        order = ["tinyint", "smallint", "int", "bigint", "decimal", "float", "double"]
        wide = max(a.type, b.type, key=order.index)
        return (a.col, b.col, wide) if wide == "decimal" else (a.col.cast(wide), b.col.cast(wide), wide)
    if a.type is None or b.type is None:
        return a.col, b.col, a.type or b.type
    return a.text(), b.text(), "string"


def _coalesce(*args: Value) -> Value:
    out = args[0]
    for x in args[1:]:
        a, b, type_ = unified(out, x)
        out = Value(F.coalesce(a, b), type_, out.kind if out.kind == x.kind else "unknown")
    return out


def _part(fn: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda x: Value(fn(x.col if x.type in ("date", "timestamp", "timestamp_ntz") else x.col.try_cast("timestamp")).cast("bigint"), "bigint")


def _seconds(x: Value) -> Value:
    moment = x.col if x.type in ("timestamp", "timestamp_ntz") else x.col.try_cast("timestamp")
    return Value(F.extract(F.lit("SECOND"), moment), "decimal")


def _offset(x: Value) -> Column:
    moment = x.col if x.type == "timestamp" else x.col.try_cast("timestamp")
    return (F.unix_timestamp(F.from_utc_timestamp(moment, F.current_timezone())) - F.unix_timestamp(moment)).cast("bigint")


def _tz(x: Value) -> Value:
    minutes = _offset(x) / 60
    text = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int"))
    return Value(F.when(minutes == 0, F.lit("Z")).otherwise(text), "string")


def _datatype(x: Value) -> Value:
    return Value(F.when(x.col.isNotNull(), F.lit(x.xsd)) if x.kind != "iri" else F.lit(None).cast("string"), "string", "iri")


_IRI_TEXT = r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]*$"


def _is_iri(x: Value) -> Value:
    if x.kind in ("iri", "literal", "blank"):
        return Value(F.when(x.col.isNotNull(), F.lit(x.kind == "iri")), "boolean")
    return Value(x.text().rlike(_IRI_TEXT), "boolean")


def _is_literal(x: Value) -> Value:
    found = _is_iri(x).col
    return Value(F.when(x.col.isNotNull(), F.lit(False)) if x.kind == "blank" else ~found, "boolean")


def _numeric(x: Value) -> Value:
    return Value(F.when(x.col.isNotNull(), F.lit(x.numeric)), "boolean")


def _lang_matches(tag: Value, wanted: Value) -> Value:
    t, w = F.lower(tag.text()), F.lower(wanted.text())
    return Value(F.when(w == "*", F.length(t) > 0).otherwise((t == w) | F.startswith(t, F.concat(w, F.lit("-")))), "boolean")


def _hash(bits: int) -> Callable[[Value], Value]:
    return lambda x: Value(F.sha2(F.encode(x.text(), "UTF-8"), bits), "string")


def _uri(x: Value) -> Value:
    return Value(x.text(), "string", "iri")


def _compare_function(op: str) -> Callable[[Value, Value], Value]:
    def build(a: Value, b: Value) -> Value:
        x, y = comparable(a, b)
        return Value({"EQ": x == y, "NEQ": x != y, "LT": x < y, "LTE": x <= y, "GT": x > y, "GTE": x >= y}[op], "boolean")

    return build


def _geo(name: str) -> Callable[..., Value]:
    return lambda a, b: Value(geo.relate(name, a, b), "boolean")


BUILTINS: dict[str, Function] = {
    name: Function(build, least, most)
    for name, build, least, most in [
        # text
        ("STR", lambda x: Value(x.text(), "string"), 1, 1), ("LCASE", _text(F.lower), 1, 1), ("LOWER", _text(F.lower), 1, 1), ("UCASE", _text(F.upper), 1, 1),
        ("UPPER", _text(F.upper), 1, 1), ("STRLEN", _text(lambda x: F.length(x).cast("bigint"), "bigint"), 1, 1), ("LENGTH", _text(lambda x: F.length(x).cast("bigint"), "bigint"), 1, 1),
        ("CONTAINS", _text(F.contains, "boolean"), 2, 2), ("STRSTARTS", _text(F.startswith, "boolean"), 2, 2), ("STRENDS", _text(F.endswith, "boolean"), 2, 2),
        ("CONCAT", _text(F.concat), 0, None), ("SUBSTR", _substr, 2, 3), ("SUBSTRING", _substr, 2, 3), ("STRBEFORE", _text(_before), 2, 2), ("STRAFTER", _text(_after), 2, 2),
        ("REGEX", _regex, 2, 3), ("REPLACE", _replace, 3, 4), ("ENCODE_FOR_URI", _text(lambda x: F.regexp_replace(F.regexp_replace(F.url_encode(x), r"\+", "%20"), r"\*", "%2A")), 1, 1),
        ("TRIM", _text(F.trim), 1, 1),
        # terms
        ("LANG", lambda x: Value(F.when(x.col.isNotNull(), F.lit(x.lang or "")), "string"), 1, 1), ("LANGMATCHES", _lang_matches, 2, 2), ("DATATYPE", _datatype, 1, 1),
        ("STRLANG", lambda x, tag: Value(x.text(), "string", lang=str(tag.constant.value) if tag.constant else "und"), 2, 2),
        ("STRDT", lambda x, kind: cast(x, kind.constant.value.removeprefix(A.XSD)) if kind.constant and kind.constant.value.removeprefix(A.XSD) in SPARK_OF else Value(x.text(), "string", datatype=kind.constant.value if kind.constant else None), 2, 2),
        ("ISIRI", _is_iri, 1, 1), ("ISURI", _is_iri, 1, 1), ("ISLITERAL", _is_literal, 1, 1), ("ISNUMERIC", _numeric, 1, 1),
        ("ISBLANK", lambda x: Value(F.when(x.col.isNotNull(), F.lit(x.kind == "blank")), "boolean"), 1, 1), ("IRI", _uri, 1, 1), ("URI", _uri, 1, 1),
        ("BNODE", lambda *x: Value(F.concat(F.lit("_:"), x[0].text() if x else F.expr("uuid()")), "string", "blank"), 0, 1),
        ("UUID", lambda: Value(F.concat(F.lit("urn:uuid:"), F.expr("uuid()")), "string", "iri"), 0, 0), ("STRUUID", lambda: Value(F.expr("uuid()"), "string"), 0, 0),
        ("SAMETERM", lambda a, b: Value(a.col.eqNullSafe(b.col) if a.type == b.type else F.lit(False), "boolean"), 2, 2), ("BOUND", lambda x: Value(x.col.isNotNull(), "boolean"), 1, 1),
        # numbers and conditions
        ("ABS", _number(F.abs), 1, 1), ("CEIL", _number(F.ceil, True), 1, 1), ("FLOOR", _number(F.floor, True), 1, 1),
        ("ROUND", lambda x, n=None: Value(F.round(x.number(), int(n.constant.value)) if n else F.round(x.number()), x.type if x.numeric else "double"), 1, 2),
        ("RAND", lambda: Value(F.rand(), "double"), 0, 0), ("MOD", lambda a, b: Value(F.try_mod(a.number(), b.number()), a.type if a.numeric else "double"), 2, 2),
        ("IF", _if, 3, 3), ("COALESCE", _coalesce, 1, None),
        ("MD5", lambda x: Value(F.md5(F.encode(x.text(), "UTF-8")), "string"), 1, 1), ("SHA1", lambda x: Value(F.sha1(F.encode(x.text(), "UTF-8")), "string"), 1, 1),
        ("SHA256", _hash(256), 1, 1), ("SHA384", _hash(384), 1, 1), ("SHA512", _hash(512), 1, 1),
        ("AND", lambda a, b: Value(a.col & b.col, "boolean"), 2, 2), ("OR", lambda a, b: Value(a.col | b.col, "boolean"), 2, 2), ("NOT", lambda a: Value(~a.col, "boolean"), 1, 1),
        *((op, _compare_function(op), 2, 2) for op in ("EQ", "NEQ", "LT", "LTE", "GT", "GTE")),
        # dates
        ("NOW", lambda: Value(F.current_timestamp(), "timestamp"), 0, 0), ("YEAR", _part(F.year), 1, 1), ("MONTH", _part(F.month), 1, 1), ("DAY", _part(F.dayofmonth), 1, 1),
        ("HOURS", _part(F.hour), 1, 1), ("MINUTES", _part(F.minute), 1, 1), ("SECONDS", _seconds, 1, 1), ("TIMEZONE", lambda x: Value(_offset(x), "bigint"), 1, 1), ("TZ", _tz, 1, 1),
        # geometry
        *((f"{GEOF}sf{name}", _geo(name.lower()), 2, 2) for name in ("Within", "Contains", "Intersects", "Overlaps", "Equals", "Disjoint", "Crosses", "Touches")),
        (f"{GEOF}intersects", _geo("intersects"), 2, 2), (f"{GEOF}distance", lambda a, b, unit=None: Value(geo.distance(a, b), "double"), 2, 3),
        (f"{GEOF}buffer", lambda g, r, unit=None: geo.buffer(g, r), 2, 3),
        ("POINT", lambda x, y: Value(F.concat(F.lit("POINT("), x.text(), F.lit(" "), y.text(), F.lit(")")), "string"), 2, 2),
    ]
}
