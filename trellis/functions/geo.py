"""GeoSPARQL on WKT: points by arithmetic on columns, other shapes by vectorised Python.

Distances are planar, as the units of the coordinates are; the unit argument is accepted and not applied.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.functions.values import Value, constant
from trellis.sparql import ast as A

_POINT = r"^\s*(?:SRID=\d+;|<[^>]*>)?\s*POINT\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*\)\s*$"
_BUFFER = re.compile(r"^BUFFER\((.*),([-+0-9.eE]+)\)$", re.S)


def point(wkt: Column) -> tuple[Column, Column]:
    """The coordinates of a point; null for any other shape."""
    return tuple(F.regexp_extract(F.upper(wkt), _POINT, i).try_cast("double") for i in (1, 2))


def buffer(g: Value, radius: Value) -> Value:
    """A buffered geometry, kept as its shape and radius: within it means no farther than the radius."""
    if g.constant is not None and radius.constant is not None:
        return constant(A.Literal(f"BUFFER({g.constant.value},{float(radius.constant.value)!r})"))
    return Value(F.concat(F.lit("BUFFER("), g.text(), F.lit(","), radius.text(), F.lit(")")), "string")


def distance(a: Value, b: Value) -> Column:
    (ax, ay), (bx, by) = point(a.text()), point(b.text())
    fast = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    if _is_point(a) and _is_point(b):
        return fast
    # Spark hands every row to a Python UDF; where both are points it gets nulls and has nothing to do
    other = fast.isNull()
    return F.coalesce(fast, _distance()(F.when(other, a.text()), F.when(other, b.text())))


def _is_point(x: Value) -> bool:
    return x.constant is not None and bool(re.match(_POINT, str(x.constant.value).upper()))


#: Up to so many edges of a constant shape a point is held against it by column arithmetic.
_MOST_EDGES = 64
_SWAPPED = {"within": "contains", "contains": "within"}


def relate(name: str, a: Value, b: Value) -> Column:
    """A simple-features relation.  Points against a constant shape are column arithmetic, other pairs a vectorised UDF."""
    for x, y, how in ((a, b, name), (b, a, _SWAPPED.get(name, name))):
        if x.constant is None and y.constant is not None:
            try:
                g = shape(str(y.constant.value))
            except (ValueError, TypeError, IndexError):
                return F.lit(None).cast("boolean")
            if len(_segments(g)) > _MOST_EDGES:
                break
            px, py = point(x.text())
            fast = _point_relation(how, px, py, g)
            other = F.when(px.isNull(), x.text())  # Spark hands every row to a Python UDF; where a point is, it gets nulls
            return F.when(px.isNotNull(), fast).otherwise(_relation(how)(other, y.text()))
    return _relation(name)(a.text(), b.text())


def _point_relation(name: str, px: Column, py: Column, g) -> Column:
    """A relation of the point (px, py) to a constant shape."""
    kind, rings, radius = g
    nothing, no = F.lit(None).cast("boolean"), F.lit(False)
    squares, parity = [], F.lit(0)
    for x1, y1, x2, y2 in _segments((kind, rings, 0.0)).tolist():
        dx, dy = x2 - x1, y2 - y1
        t = F.lit(0.0) if dx == dy == 0 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
        ex, ey = px - x1 - t * dx, py - y1 - t * dy
        squares.append(ex * ex + ey * ey)
        if kind == "POLYGON" and dy:
            parity = parity + F.when(((F.lit(y1) > py) != (F.lit(y2) > py)) & (px < (py - y1) * dx / dy + x1), 1).otherwise(0)
    edge = F.sqrt(F.least(*squares) if len(squares) > 1 else squares[0])
    on, inside = edge < 1e-12, parity % 2 == 1
    if radius:
        near = F.when(inside, 0.0).otherwise(edge) - radius <= 1e-12
        return {"within": near, "intersects": near, "disjoint": ~near}.get(name, nothing if name != "contains" else no)
    met = on | inside
    if name in ("intersects", "disjoint"):
        return met if name == "intersects" else ~met
    if kind == "POINT":
        return on if name in ("within", "contains", "equals") else no
    ends = [rings[0][0], rings[0][-1]] if kind == "LINESTRING" and not np.allclose(rings[0][0], rings[0][-1]) else []
    boundary = on if kind == "POLYGON" else no
    for x, y in ends:
        boundary = boundary | (on & (F.abs(px - float(x)) + F.abs(py - float(y)) < 1e-12))
    if name == "within":
        return met & ~boundary
    return boundary if name == "touches" else no


def _each_once(f, a: pd.Series, b: pd.Series) -> list:
    """f of each pair of a batch; equal pairs are worked out once."""
    pairs = list(zip(a, b, strict=True))
    known = {pair: f(*pair) for pair in dict.fromkeys(pairs)}
    return [known[pair] for pair in pairs]


@lru_cache
def _distance():
    @F.pandas_udf(T.DoubleType())
    def far(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_each_once(shape_distance, a, b), dtype="float64")

    return far


@lru_cache
def _relation(name: str):
    @F.pandas_udf(T.BooleanType())
    def holds(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_each_once(lambda x, y: shape_relation(name, x, y), a, b), dtype="object")

    return holds


@lru_cache(maxsize=4096)
def shape(wkt: str) -> tuple[str, list[np.ndarray], float]:
    """Kind, rings or lines, and buffer radius of a WKT text."""
    radius = 0.0
    while hit := _BUFFER.match(wkt.strip()):
        wkt, radius = hit[1], radius + float(hit[2])
    text = re.sub(r"^\s*(?:SRID=\d+;|<[^>]*>)\s*", "", wkt).strip()
    kind = re.match(r"[A-Za-z]+", text)
    rings = re.findall(r"\(([^()]*)\)", text)
    if not kind or kind[0].upper() not in ("POINT", "LINESTRING", "POLYGON") or not rings:
        raise ValueError(f"no geometry: {wkt[:40]!r}")
    return kind[0].upper(), [np.array([[float(n) for n in p.split()[:2]] for p in ring.split(",")]) for ring in rings], radius


def _in_ring(p: np.ndarray, ring: np.ndarray) -> bool:
    (x, y), a, b = p, ring[:-1], ring[1:]
    cross = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((cross & (x < at)).sum() % 2)


def _segments(g) -> np.ndarray:
    kind, rings, _ = g
    if kind == "POINT":
        return np.concatenate([rings[0], rings[0]], axis=1)
    return np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for r in rings])


def _point_to_segments(p: np.ndarray, s: np.ndarray) -> float:
    a, d = s[:, :2], s[:, 2:] - s[:, :2]
    size = (d * d).sum(1)
    t = np.clip(np.where(size > 0, ((p - a) * d).sum(1) / np.where(size > 0, size, 1), 0), 0, 1)
    return float(np.sqrt((((a + d * t[:, None]) - p) ** 2).sum(1)).min())


def _on_edge(p: np.ndarray, g) -> bool:
    return _point_to_segments(p, _segments(g)) < 1e-12


def _place(p: np.ndarray, g) -> int:
    """1 inside, 0 on the boundary, -1 outside."""
    kind, rings, radius = g
    if radius:
        d = max(0.0, _raw_distance(("POINT", [p[None]], 0.0), (kind, rings, 0.0))) - radius
        return 0 if abs(d) < 1e-12 else (1 if d < 0 else -1)
    if kind == "POINT":
        return 1 if np.allclose(p, rings[0][0], atol=1e-12, rtol=0) else -1
    if kind == "LINESTRING":
        if not _on_edge(p, g):
            return -1
        ends = rings[0][[0, -1]]
        return 0 if not np.allclose(ends[0], ends[1]) and min(np.abs(ends - p).sum(1)) < 1e-12 else 1
    if _on_edge(p, g):
        return 0
    return 1 if _in_ring(p, rings[0]) and not any(_in_ring(p, r) for r in rings[1:]) else -1


def _crossings(a, b) -> list[np.ndarray]:
    """Points where segments of a and b cross properly."""
    found = []
    for s in _segments(a):
        p, r = s[:2], s[2:] - s[:2]
        for q in _segments(b):
            o, d = q[:2], q[2:] - q[:2]
            det = r[0] * d[1] - r[1] * d[0]
            if abs(det) < 1e-15:
                continue
            t, u = ((o - p)[0] * d[1] - (o - p)[1] * d[0]) / det, ((o - p)[0] * r[1] - (o - p)[1] * r[0]) / det
            if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                found.append(p + t * r)
    return found


def _raw_distance(a, b) -> float:
    if _meet(a, b):
        return 0.0
    ends = [_point_to_segments(p, _segments(b)) for ring in a[1] for p in ring] + [_point_to_segments(p, _segments(a)) for ring in b[1] for p in ring]
    return min(ends)


def _meet(a, b) -> bool:
    return any(_place(p, (b[0], b[1], 0.0)) >= 0 for ring in a[1] for p in ring) or any(_place(p, (a[0], a[1], 0.0)) >= 0 for ring in b[1] for p in ring) or bool(_crossings(a, b))


def _samples(g, other) -> list[np.ndarray]:
    """Points that between them tell where g lies: corners, and middles of the pieces that the other cuts."""
    out = [p for ring in g[1] for p in ring]
    cuts = _crossings(g, other) if g[0] != "POINT" and other[0] != "POINT" else []
    for s in _segments(g):
        on = [s[:2], s[2:], *(c for c in cuts if _point_to_segments(c, s[None]) < 1e-9), *(p for ring in other[1] for p in ring if _point_to_segments(p, s[None]) < 1e-12)]
        on = sorted(on, key=lambda p: float(((p - s[:2]) ** 2).sum()))
        out += [(x + y) / 2 for x, y in zip(on, on[1:], strict=False)]
    if g[0] == "POLYGON":
        out += [_inner(g)]
    return out


def _inner(g) -> np.ndarray:
    """A point inside a polygon."""
    ring = g[1][0]
    centre = ring[:-1].mean(0)
    if _place(centre, (g[0], g[1], 0.0)) > 0:
        return centre
    for i in range(len(ring) - 1):
        for j in range(i + 2, len(ring) - 1):
            middle = (ring[i] + ring[j]) / 2
            if _place(middle, (g[0], g[1], 0.0)) > 0:
                return middle
    return centre


def _inside(g, other) -> bool:
    """Whether a sample shows that the interiors meet: any point of g inside an area, or an inner point of g on a line."""
    return any(_place(p, other) > 0 and (other[0] == "POLYGON" or _place(p, g) > 0) for p in _samples(g, other))


def shape_distance(a: str | None, b: str | None) -> float | None:
    """Planar distance; None for texts that are no geometry."""
    if a is None or b is None:
        return None
    try:
        x, y = shape(a), shape(b)
    except (ValueError, TypeError, AttributeError, IndexError):
        return None
    return max(0.0, _raw_distance(x, y) - x[2] - y[2])


def shape_relation(name: str, a: str | None, b: str | None) -> bool | None:
    """A simple-features relation; None for texts that are no geometry."""
    if a is None or b is None:
        return None
    try:
        x, y = shape(a), shape(b)
    except (ValueError, TypeError, AttributeError, IndexError):
        return None
    if name == "contains":
        return shape_relation("within", b, a)
    if x[2] or y[2]:
        apart = _raw_distance((*x[:2], 0.0), (*y[:2], 0.0)) - x[2] - y[2]
        if name in ("intersects", "disjoint"):
            return (apart <= 1e-12) == (name == "intersects")
        if name == "within":
            return all(_place(p, y) >= 0 for ring in x[1] for p in ring) if not x[2] else all(_raw_distance(("POINT", [p[None]], 0.0), (*y[:2], 0.0)) + x[2] <= y[2] + 1e-12 for ring in x[1] for p in ring)
        return None
    meet = _meet(x, y)
    if name in ("intersects", "disjoint"):
        return meet == (name == "intersects")
    if not meet:
        return False
    of_x, of_y = [_place(p, y) for p in _samples(x, y)], [_place(p, x) for p in _samples(y, x)]
    x_in, y_in = all(p >= 0 for p in of_x), all(p >= 0 for p in of_y)
    inner = _inside(x, y) or _inside(y, x) or (x[0] == y[0] and x_in and y_in)
    dims = {"POINT": 0, "LINESTRING": 1, "POLYGON": 2}
    if name == "equals":
        return x_in and y_in
    if name == "within":
        return x_in and inner
    if name == "touches":
        return not inner
    if name == "overlaps":
        return dims[x[0]] == dims[y[0]] and inner and not x_in and not y_in
    if name == "crosses":
        if dims[x[0]] == dims[y[0]] == 1:
            shared = [p for p in _crossings(x, y) if _place(p, x) > 0 and _place(p, y) > 0]
            return bool(shared) and not x_in and not y_in and not any(p > 0 for p in of_x[len(x[1][0]) :])
        small, of = (of_x, dims[x[0]] < dims[y[0]]) if dims[x[0]] < dims[y[0]] else (of_y, dims[y[0]] < dims[x[0]])
        return of and max(small) > 0 and min(small) < 0
    raise ValueError(f"unknown relation {name}")
