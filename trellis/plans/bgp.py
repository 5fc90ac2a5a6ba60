"""Planning of basic graph patterns: rules and ontology, stars, join order."""

from __future__ import annotations

from dataclasses import dataclass, replace

from trellis.operators.scans import Catalog, scan
from trellis.plans.scope import Solutions, empty, join, union
from trellis.sources.mapping import MappingStore, Rule, TermMap
from trellis.sources.ontology import Ontology
from trellis.sparql import ast as A


@dataclass
class Context:
    """What planning needs: the mapping, the ontology, the tables, and the active graphs."""

    catalog: Catalog
    store: MappingStore
    ontology: Ontology
    mode: str = "key"
    reasoning: bool = True
    graphs: frozenset[str] | None = None  # None: the default graph, all rules
    max_path_depth: int | None = None
    explain: list[str] | None = None

    def in_graphs(self, rule: Rule) -> bool:
        return self.graphs is None or not self.store.has_graphs or rule.graph in self.graphs

    def note(self, text: str) -> None:
        if self.explain is not None:
            self.explain.append(text)


Choice = tuple[Rule, bool]  # a rule, and whether its subject and object change places


def choices(ctx: Context, pattern: A.Triple) -> list[Choice]:
    """All rules that can answer a pattern, with those that the ontology adds."""
    found: dict[tuple[str, Rule, bool], Choice] = {}

    def add(rules: list[Rule], inverted: bool = False) -> None:
        for rule in rules:
            if ctx.in_graphs(rule) and ctx.catalog.usable(rule):
                found.setdefault((rule.map_id, rule, inverted), (rule, inverted))

    predicate, store = pattern.predicate, ctx.store
    if isinstance(predicate, A.Var):
        for rules in store.classes.values():
            add(rules if not isinstance(pattern.object, A.Iri) else [r for r in rules if r.object.value == pattern.object])
        for rules in store.rules.values():
            add(rules)
    elif predicate.value == A.TYPE:
        if isinstance(pattern.object, A.Iri):
            concepts = ctx.ontology.concepts_of(pattern.object.value) if ctx.reasoning else [("class", pattern.object.value)]
            for concept in concepts:
                if concept[0] == "class":
                    add(store.classes.get(concept[1], []))
                else:
                    for rule in store.rules.get(concept[1], []):
                        as_type = Rule(rule.map_id, rule.table, rule.object if concept[2] else rule.subject, A.TYPE, TermMap("constant", pattern.object), rule.graph)
                        add([replace(as_type, also=rule.object.columns if not concept[2] else rule.subject.columns)])
        else:
            for rules in store.classes.values():
                add(rules)
    else:
        names = ctx.ontology.properties_of(predicate.value) if ctx.reasoning else [(predicate.value, False)]
        for name, inverted in names:
            add(store.rules.get(name, []), inverted)
            if not found and not store.rules.get(name):
                add(ctx.catalog.edge_rules(name), inverted)
    return list(found.values())


def _subject_shape(choice: Choice) -> str | None:
    rule, inverted = choice
    return (rule.object if inverted else rule.subject).shape


def _key(term: A.Term) -> str:
    return "?" + term.name if isinstance(term, A.Var) else repr(term)


def _identities(ctx: Context, patterns: list[A.Triple]) -> tuple[list[A.Triple], dict[str, str]]:
    """Patterns over predicates whose object is the subject's own column: the two variables become one."""
    same: dict[str, str] = {}
    for p in patterns:
        if isinstance(p.subject, A.Var) and isinstance(p.object, A.Var) and isinstance(p.predicate, A.Iri) and p.subject != p.object:
            rules = choices(ctx, p)
            if rules and all(not inv and r.object.columns and r.object.columns[0] == r.subject.columns[0] for r, inv in rules if r.subject.columns) and ctx.mode == "key":
                same[p.object.name] = same.get(p.subject.name, p.subject.name)

    def renamed(term):
        return A.Var(same[term.name]) if isinstance(term, A.Var) and term.name in same else term

    return [A.Triple(renamed(p.subject), p.predicate, renamed(p.object)) for p in patterns], same


def plan(ctx: Context, patterns: list[A.Triple]) -> Solutions:
    """The solutions of simple triple patterns (no paths)."""
    patterns = list(dict.fromkeys(patterns))
    patterns, same = _identities(ctx, patterns)
    stars: dict[str, list[A.Triple]] = {}
    for p in patterns:
        stars.setdefault(_key(p.subject), []).append(p)
    parts = []
    for star in stars.values():
        found = _star(ctx, star)
        if found is None:
            names = [n for p in patterns for n in A.variables(p)]
            return _restored(empty(ctx.catalog.spark, list(dict.fromkeys(names))), same)
        constants = sum(not isinstance(t, (A.Var, A.Blank)) for p in star for t in (p.subject, p.object) if not (isinstance(p.predicate, A.Iri) and p.predicate.value == A.TYPE))
        parts.append((found, constants))
    return _restored(_joined(parts), same)


def _restored(solutions: Solutions, same: dict[str, str]) -> Solutions:
    for name, of in same.items():
        if of in solutions.known:
            known = solutions.known[of]
            solutions = solutions.with_value(name, solutions.value(of))
            solutions.known[name] = known
    return Solutions(solutions.df, {n: k for n, k in solutions.known.items()}, solutions.is_unit)


def _joined(parts: list[tuple[Solutions, int]]) -> Solutions:
    """Connected stars one after another, those with constants first; Catalyst chooses how each join runs."""
    left = sorted(range(len(parts)), key=lambda i: -parts[i][1])
    done = parts[left.pop(0)][0]
    while left:
        linked = [i for i in left if set(parts[i][0].known) & set(done.known)]
        i = (linked or left)[0]
        left.remove(i)
        done = join(done, parts[i][0])
    return done


def _star(ctx: Context, star: list[A.Triple]) -> Solutions | None:
    """All patterns of one subject.

    Each template of subjects is a branch of its own: subjects of different templates are never equal.  Inside a branch
    patterns that one row answers become one scan.
    """
    options = [choices(ctx, p) for p in star]
    if not all(options):
        return None
    shapes = [{_subject_shape(c) for c in found} for found in options]
    common = set.intersection(*shapes)
    if None in set.union(*shapes) or not common:
        branches = [options]
        if not common and ctx.mode == "iri" and None not in set.union(*shapes):
            return None
    else:
        order = dict.fromkeys(_subject_shape(c) for found in options for c in found)
        branches = [[[c for c in found if _subject_shape(c) == shape] for found in options] for shape in order if shape in common]
    found = [b for b in (_branch(ctx, star, branch) for branch in branches) if b is not None]
    if not found:
        return None
    return found[0] if len(found) == 1 else union(found)


def _branch(ctx: Context, star: list[A.Triple], options: list[list[Choice]]) -> Solutions | None:
    # a map that answers every pattern by itself takes them all; other maps join in only where a pattern needs them
    groups: dict[tuple, list[tuple[Rule, A.Triple, bool]]] = {}
    several: list[Solutions] = []
    for pattern, found in zip(star, options, strict=True):
        typed = isinstance(pattern.predicate, A.Iri) and pattern.predicate.value == A.TYPE and isinstance(pattern.object, A.Iri)
        plain = [c for c in found if not c[0].also]
        if len(found) == 1 or (typed and plain and len({(r.table, r.subject) for r, _ in found}) == 1):
            rule, inverted = (plain or found)[0]
            side = rule.object if inverted else rule.subject
            groups.setdefault((rule.table, side, inverted and rule.subject), []).append((rule, pattern, inverted))
            continue
        scans = []
        for rule, inverted in found:
            one = scan(ctx.catalog, pattern.subject, [(rule, pattern, inverted)], ctx.mode, distinct=False)
            if one is not None:
                scans.append(one)
        if not scans:
            return None
        ctx.note(f"union of {len(scans)} scans for {_key(pattern.subject)}")
        merged = union(scans) if len(scans) > 1 else scans[0]
        if len(scans) > 1 and not isinstance(pattern.predicate, A.Var):
            merged = Solutions(merged.df.distinct(), merged.known)  # a triple that two rules make is one triple
        several.append(merged)
    parts: list[Solutions] = []
    for (table, _, inverted), rows in groups.items():
        merge = len(rows) == 1 or (not inverted and ctx.store.keys_unique(rows[0][0]))
        for chunk in [rows] if merge else [[r] for r in rows]:
            one = scan(ctx.catalog, rows[0][1].subject, chunk, ctx.mode, distinct=not ctx.store.keys_unique(chunk[0][0]) and len(rows) > 1)
            if one is None:
                return None
            ctx.note(f"scan of {table} for {len(chunk)} pattern(s) of {_key(rows[0][1].subject)}")
            parts.append(one)
    done = None
    for part in [*parts, *several]:
        done = part if done is None else join(done, part)
    return done
