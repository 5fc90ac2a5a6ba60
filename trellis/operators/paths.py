"""Property paths: joins, unions and a fixpoint of semi-naive rounds.

A path yields pairs of columns ``s`` and ``o``.  Sequences and alternatives keep duplicates; repeated paths are distinct
pairs.  Each round of a closure joins the newest pairs with the edges, drops those known, and writes what is new to the
shared folder, so lineage stays short and lost executors cost one round at most.  A constant end seeds the closure from
that side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.errors import UnsupportedFeature
from trellis.functions.values import constant as constant_value
from trellis.functions.values import short
from trellis.operators.scans import trailing_key
from trellis.plans import bgp
from trellis.plans.scope import Known, Solutions, column_of, empty, join, union
from trellis.sources.storage import kept
from trellis.sparql import ast as A

_S, _O = A.Var("s"), A.Var("o")


@dataclass
class Pairs:
    df: DataFrame  # columns s, o
    s: Known
    o: Known

    def flipped(self) -> Pairs:
        return Pairs(self.df.select(F.col("o").alias("s"), F.col("s").alias("o")), self.o, self.s)


def _pairs(solutions: Solutions) -> Pairs:
    return Pairs(solutions.df.select("s", "o"), solutions.known["s"], solutions.known["o"])


def _step(ctx: bgp.Context, iri: str) -> Pairs:
    pattern = A.Triple(_S, A.Iri(iri), _O)
    if not bgp.choices(ctx, pattern):
        return _pairs(empty(ctx.catalog.spark, ["s", "o"]))
    return _pairs(bgp.plan(ctx, [pattern]))


def _as_solutions(p: Pairs) -> Solutions:
    return Solutions(p.df, {"s": p.s, "o": p.o})


def _union(parts: list[Pairs]) -> Pairs:
    return parts[0] if len(parts) == 1 else _pairs(union([_as_solutions(p) for p in parts]))


def _linked(a: Pairs, b: Pairs) -> Pairs:
    """a then b, joined on the middle."""
    left = Solutions(a.df.select("s", F.col("o").alias("m")), {"s": a.s, "m": a.o})
    right = Solutions(b.df.select(F.col("s").alias("m"), "o"), {"m": b.s, "o": b.o})
    return _pairs(join(left, right))


def evaluate(ctx: bgp.Context, path, seed: DataFrame | None = None) -> Pairs:
    """The pairs of a path; ``seed`` (column s): only those that begin there."""
    if isinstance(path, A.Iri):
        return _seeded(_step(ctx, path.value), seed)
    if isinstance(path, A.Inverse):
        return _seeded(evaluate(ctx, path.path).flipped(), seed)
    if isinstance(path, A.Sequence):
        done = evaluate(ctx, path.steps[0], seed)
        for step in path.steps[1:]:
            done = _linked(done, evaluate(ctx, step))
        return done
    if isinstance(path, A.Alternative):
        return _union([evaluate(ctx, p, seed) for p in path.options])
    if isinstance(path, A.Negated):
        return _seeded(_negated(ctx, path), seed)
    if isinstance(path, A.Repeat):
        return _repeated(ctx, path, seed)
    raise UnsupportedFeature(f"path {path}")


def _seeded(p: Pairs, seed: DataFrame | None) -> Pairs:
    return p if seed is None else Pairs(p.df.join(_cast(seed, p.df, "s"), "s", "left_semi"), p.s, p.o)


def _cast(seed: DataFrame, like: DataFrame, name: str) -> DataFrame:
    kind = like.schema[name].dataType.simpleString()
    return seed.select(F.col("s").try_cast(kind).alias(name))


def _negated(ctx: bgp.Context, path: A.Negated) -> Pairs:
    parts = []
    for names, flip in ((path.forward, False), (path.backward, True)):
        if names or not flip and not path.backward:
            others = [iri for iri in [*ctx.store.rules, *([A.TYPE] if ctx.store.classes else [])] if iri not in names]
            others = [iri for iri in others if iri == A.TYPE or bgp.choices(ctx, A.Triple(_S, A.Iri(iri), _O))]
            steps = [_type_pairs(ctx) if iri == A.TYPE else _step(ctx, iri) for iri in others]
            if steps:
                found = _union(steps)
                parts.append(found.flipped() if flip else found)
    return _union(parts) if parts else _pairs(empty(ctx.catalog.spark, ["s", "o"]))


def _type_pairs(ctx: bgp.Context) -> Pairs:
    return _pairs(bgp.plan(ctx, [A.Triple(_S, A.Iri(A.TYPE), _O)]))


def _nodes(edges: DataFrame, seed: DataFrame | None) -> DataFrame:
    """Pairs of length zero: the seeds, or all nodes of the edges."""
    if seed is not None:
        nodes = _cast(seed, edges, "s")
    else:
        nodes = edges.select("s").union(edges.select(F.col("o").cast(edges.schema["s"].dataType).alias("s"))).distinct()
    return nodes.filter("s is not null").select("s", F.col("s").alias("o"))


def _repeated(ctx: bgp.Context, path: A.Repeat, seed: DataFrame | None) -> Pairs:
    inner = evaluate(ctx, path.path)
    if inner.df.schema["s"].dataType != inner.df.schema["o"].dataType:
        both = union([Solutions(inner.df.select(F.col("s").alias("x")), {"x": inner.s}), Solutions(inner.df.select(F.col("o").alias("x")), {"x": inner.o})])
        kind = both.df.schema["x"].dataType
        inner = Pairs(inner.df.select(F.col("s").cast(kind).alias("s"), F.col("o").cast(kind).alias("o")), inner.s, inner.o)
    known = Known(False, inner.s.kind, shape=inner.s.shape if inner.s.shape == inner.o.shape else None)
    if path.least == 0 and path.most == 1:
        step = _seeded(inner, seed).df
        return Pairs(step.union(_nodes(inner.df, seed)).distinct(), known, known)
    edges = kept(inner.df.distinct(), "edges")
    most = path.most if path.most is not None else ctx.max_path_depth
    frontier = _nodes(edges, seed)
    depth = 0
    while depth < path.least:  # exact steps before the closure
        frontier = _advance(frontier, edges)
        depth += 1
    reached = frontier = kept(frontier.distinct(), "reach")
    while most is None or depth < most:
        new = kept(_advance(frontier, edges).join(reached, ["s", "o"], "left_anti"), "reach")
        if new.isEmpty():
            break
        reached, frontier = reached.union(new), new
        depth += 1
    return Pairs(reached, known, known)


def _advance(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    step = edges.select(F.col("s").alias("m"), F.col("o").alias("n"))
    return frontier.join(step, frontier["o"] == step["m"]).select("s", F.col("n").alias("o")).distinct()


def solve(ctx: bgp.Context, pattern: A.Triple) -> Solutions:
    """The solutions of a pattern whose predicate is a path."""
    spark, path, subject, obj = ctx.catalog.spark, pattern.predicate, pattern.subject, pattern.object
    flip = not isinstance(obj, (A.Var, A.Blank)) and isinstance(subject, (A.Var, A.Blank))
    start = obj if flip else subject
    seed = None
    if not isinstance(start, (A.Var, A.Blank)):
        seed = spark.range(1).select(F.lit(_constant(ctx, start)).alias("s"))
    pairs = evaluate(ctx, A.Inverse(path) if flip and not _has_closure(path) else (_reverse(path) if flip else path), seed)
    if flip:
        pairs = pairs.flipped()
    df, columns, known = pairs.df, [], {}
    for term, column, info in ((subject, "s", pairs.s), (obj, "o", pairs.o)):
        if isinstance(term, (A.Var, A.Blank)):
            name = term.name if isinstance(term, A.Var) else "_:" + term.label
            if name in known:
                df = df.filter("s = o")
            else:
                columns.append(F.col(column).alias(column_of(name)))
                known[name] = info
        elif seed is None or term is not start:
            kind = short(df.schema[column].dataType.simpleString())
            df = df.filter(F.col(column) == F.lit(_constant(ctx, term)).try_cast(kind))
    return Solutions(df.select(*columns), known)


def _constant(ctx: bgp.Context, term: A.Term) -> str:
    """The key of a constant node."""
    if isinstance(term, A.Iri):
        if ctx.mode == "iri":
            return term.value
        for _, subject in ctx.store.maps.values():
            if (key := subject.key_of(term.value)) is not None:
                return key
        return trailing_key(term.value)
    return str(constant_value(term).constant.value)


def _has_closure(path) -> bool:
    return isinstance(path, A.Repeat) or any(_has_closure(p) for p in getattr(path, "steps", getattr(path, "options", ())))


def _reverse(path):
    """The path read backwards, so that a constant object seeds it."""
    if isinstance(path, A.Sequence):
        return A.Sequence(tuple(_reverse(p) for p in reversed(path.steps)))
    if isinstance(path, A.Alternative):
        return A.Alternative(tuple(_reverse(p) for p in path.options))
    if isinstance(path, A.Repeat):
        return A.Repeat(_reverse(path.path), path.least, path.most)
    if isinstance(path, A.Inverse):
        return path.path
    return A.Inverse(path)
