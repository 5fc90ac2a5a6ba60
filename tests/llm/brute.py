"""Plain versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def order(docs: list[tuple]) -> list[tuple]:
    """Documents by id, those without one last."""
    return sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))


def _covered(n: int, size: int, hits: list[int]) -> list[bool]:
    out = [False] * n
    for i in hits:
        out[i : i + size] = [True] * size
    return out


def removed(docs: list[tuple], unit, size: int) -> list[tuple[object, object, list[bool]]]:
    """(id, units, removed) by windows of ``size`` units that start in a document with a smaller id."""
    owners: dict = {}
    cut = []
    for doc_id, text in docs:
        parts = unit(text)
        grams = [bytes(parts[i : i + size]) if isinstance(parts, bytes) else tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)]
        cut.append((doc_id, parts, grams))
        for g in grams:
            key = math.inf if doc_id is None else doc_id
            owners[g] = min(owners.get(g, math.inf), key)
    return [(i, parts, _covered(len(parts), size, [k for k, g in enumerate(grams) if owners[g] < (math.inf if i is None else i)])) for i, parts, grams in cut]


def suffix_rows(docs: list[tuple], size: int) -> Counter:
    out = Counter()
    for doc_id, data, gone in removed(docs, lambda t: (t or "").encode(), size):
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[(doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def substring_rows(docs: list[tuple], size: int) -> Counter:
    out = Counter()
    for doc_id, parts, gone in removed(docs, words, size):
        kept = b" ".join(w for w, g in zip(parts, gone) if not g)
        out[(doc_id, len(parts), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def shingles(text: str | None, size: int) -> set:
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def groups(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_rows(docs: list[tuple], size: int, percent: int) -> Counter:
    sets = [(i, shingles(t, size)) for i, t in docs]
    holders = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                holders[g].append(k)
    links = set()
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        common = Counter(o for g in s for o in holders[g] if o < k)
        links |= {(i, sets[o][0]) for o, c in common.items() if 100 * c >= percent * (len(s) + len(sets[o][1]) - c)}
    of = groups({i for i, _ in docs if i is not None}, links)
    return Counter((i, len(s), of.get(i)) for i, s in sets)


def cosine_rows(rows: list[tuple], least: float) -> Counter:
    """Rows without an id are nodes of their own."""
    node = [("id", i) if i is not None else ("row", k) for k, (i, _) in enumerate(rows)]
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            good[k] = a / np.sqrt((a * a).sum())
    near = {k: [o for o in good if o != k and len(good[o]) == len(good[k]) and float(good[o] @ good[k]) >= least] for k in good}
    of = groups(set(node), [(node[k], node[o]) for k, os in near.items() for o in os])  # ids come before rows
    found = [of[n][1] if of[n][0] == "id" else None for n in node]
    return Counter((i, len(near.get(k, ())), found[k], i is not None and found[k] == i) for k, (i, _) in enumerate(rows))
