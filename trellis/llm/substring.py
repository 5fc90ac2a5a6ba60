"""Substring dedup over words: difference-cover anchors.

Word windows are hashed only at positions that lie, modulo a period, in a difference cover; whatever the offsets of two
equal windows of ``window`` words, some shift below the period puts both on the cover, so they share an anchor of
window - period + 1 words.  Anchors that two documents share are extended: every window that contains one sends its
fingerprint (96 bits) and the smallest document id of its unit, and learns whether a smaller document has it.  A word is
removed if a window that covers it also starts in a document with a smaller id, judged on the input.

Defined cases: null and empty texts have no words; a null id counts as larger than any other; rows that repeat an id are
not matched with each other; texts shorter than a window stay whole; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trellis.llm.rounds import Layout, Message, Spread, answer, bits, ids_of, runs, unit_of
from trellis.llm.words import U64, Words, flatten, inverse, mix, packed, powers

#: Perfect difference sets: every residue is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
_SECOND = 0xA24BAED4963EE407


def period_for(window: int) -> int:
    """The largest period that leaves anchors of at least a third of the window."""
    return max(p for p in COVERS if p == 1 or window - p + 1 >= max(2, window // 3))


class _Unit:
    """Words, anchors and windows of a unit's documents."""

    def __init__(self, docs: pa.Table, window: int):
        self.window, self.period = window, period_for(window)
        self.ids = ids_of(docs)
        self.data, self.offsets = flatten(docs["text"])
        self.words = Words(self.data, self.offsets)
        self.hashes = self.words.hashes()
        size = window - self.period + 1
        at, keys = self.words.grams(self.hashes, size)
        on = np.zeros(self.period, bool)
        on[list(COVERS[self.period])] = True
        chosen = on[(at - self.words.at[self.words.doc[at]]) % self.period]
        self.at, keys = at[chosen], keys[chosen] & ~U64(1)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(ranked)] - 1 if len(first) else first
        doc = self.ids[self.words.doc[self.at]]
        several = doc[order[first]] != doc[order[last]]  # rows are sorted by id and the sort is stable
        self.keys = ranked[first] | several.astype(U64)
        self.key_of = np.empty(len(keys), np.int64)
        self.key_of[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]]) if len(ranked) else 0

    def anchors(self, buckets: int) -> Spread:
        return Spread(self.keys >> U64(1), buckets)

    def windows(self, shared: np.ndarray) -> None:
        """The windows that contain a shared anchor, and their distinct fingerprints with the smallest id."""
        words, n = self.words, len(self.words)
        hit = self.at[shared[self.key_of]]
        doc = words.doc[hit]
        low = np.maximum(hit - self.period + 1, words.at[doc])
        high = np.minimum(hit, words.at[doc + 1] - self.window)
        fits = high >= low
        edge = np.bincount(low[fits], minlength=n + 1).astype(np.int64)
        edge -= np.bincount(high[fits] + 1, minlength=n + 1)[: n + 1]
        self.start = np.flatnonzero(np.cumsum(edge)[:n] > 0)
        one = self._fingerprint(self.hashes, 0xD6E8FEB86659FD93)
        two = self._fingerprint(mix(self.hashes ^ U64(_SECOND)), 0x8CB92BA72F3D8DD7).astype(np.uint32)
        order = np.argsort(one, kind="stable")
        a, b = one[order], two[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.one, self.two = a[first], b[first]
        self.least = self.ids[words.doc[self.start[order[first]]]]
        self.window_of = np.empty(len(one), np.int64)
        self.window_of[order] = np.cumsum(new) - 1

    def _fingerprint(self, hashes: np.ndarray, base: int) -> np.ndarray:
        sums = np.zeros(len(hashes) + 1, U64)
        np.cumsum(hashes * powers(base, len(hashes)), out=sums[1:])
        return mix((sums[self.start + self.window] - sums[self.start]) * powers(inverse(base), len(hashes) + 1)[self.start])

    def spread(self, buckets: int) -> Spread:
        """Fingerprints by bucket, by smallest id inside a bucket."""
        by_id = np.argsort(self.least, kind="stable")
        found = Spread(self.one[by_id] >> U64(7), buckets)
        found.order = by_id[found.order]
        return found


def _anchors(pairs: list[tuple[int, bytes]], bucket: int) -> Iterable[Message]:
    """Tell each unit which of its anchors two documents have."""
    parts = [np.frombuffer(blob, U64) for _, blob in pairs]
    keys = np.concatenate(parts)
    order = np.argsort(keys)
    ranked = keys[order] >> U64(1)
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    group = np.cumsum(first) - 1
    weight = np.bincount(group) + np.bincount(group, weights=(keys[order] & U64(1)).astype(float))
    shared = np.empty(len(keys), bool)
    shared[order] = weight[group] > 1
    at = 0
    for (g, _), part in zip(pairs, parts, strict=True):
        yield g, bucket, 0, bits(shared[at : at + len(part)])
        at += len(part)


def _windows(pairs: list[tuple[int, bytes]], bucket: int) -> Iterable[Message]:
    """Tell each unit which of its fingerprints a document smaller than its own has."""
    one, two, ids, sizes = [], [], [], []
    for _, blob in pairs:
        n, m = (int(x) for x in np.frombuffer(blob, np.int64, 2))
        at = 16
        one.append(np.frombuffer(blob, U64, n, at))
        two.append(np.frombuffer(blob, np.uint32, n, at + 8 * n))
        at += 12 * n
        ids.append(np.repeat(np.frombuffer(blob, np.int64, m, at), np.frombuffer(blob, np.uint32, m, at + 8 * m)))
        sizes.append(n)
    one, two, ids = np.concatenate(one), np.concatenate(two), np.concatenate(ids)
    order = np.lexsort((two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    smaller = np.empty(len(ids), bool)
    smaller[order] = least < ids[order]
    at = 0
    for (g, _), n in zip(pairs, sizes, strict=True):
        yield g, bucket, 1, bits(smaller[at : at + n])
        at += n


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (words joined by a space), spans (removed runs of words)."""
    layout = Layout(df, id_col, text_col)
    buckets = layout.n_buckets

    def ask(docs: pa.Table) -> Iterable[Message]:
        unit = _Unit(docs, window)
        for b, at in unit.anchors(buckets).parts():
            yield unit_of(docs), b, 0, packed(unit.keys[at])

    def extend(docs: pa.Table, got: dict) -> Iterable[Message]:
        unit = _Unit(docs, window)
        unit.windows(unit.anchors(buckets).collect(got, 0))
        for b, at in unit.spread(buckets).parts():
            ids, counts = runs(unit.least[at])
            yield unit_of(docs), b, 1, packed(np.array([len(at), len(ids)], np.int64), unit.one[at], unit.two[at], ids, counts)

    def finish(docs: pa.Table, got: dict) -> pa.Table:
        unit = _Unit(docs, window)
        unit.windows(unit.anchors(buckets).collect(got, 0))
        smaller = unit.spread(buckets).collect(got, 1)
        own = unit.ids[unit.words.doc[unit.start]]
        gone = smaller[unit.window_of] | (own > unit.least[unit.window_of])
        n = len(unit.words)
        edge = np.bincount(unit.start[gone], minlength=n + window + 1).astype(np.int64)
        edge[window:] -= edge[:-window].copy() if window else 0
        return _kept(docs, unit, np.cumsum(edge)[:n] > 0, id_col)

    shared = answer(layout.ask(ask), _anchors)
    found = answer(layout.join_ask(shared, extend), _windows)
    schema = f"`{id_col}` long, n_words long, n_removed long, kept string, spans array<struct<first: long, last: long>>"
    return layout.join(shared.unionByName(found), finish, schema)


def _kept(docs: pa.Table, unit: _Unit, removed: np.ndarray, id_col: str) -> pa.Table:
    words, offsets, n_docs = unit.words, unit.offsets, docs.num_rows
    data = unit.data.copy()
    kept_start, kept_end = words.starts[~removed], words.ends[~removed]
    inner = kept_end < offsets[words.doc[~removed] + 1]
    data[kept_end[inner]] = 0x20
    stop = kept_end + inner
    edge = np.bincount(kept_start, minlength=len(data) + 2).astype(np.int8) - np.bincount(stop, minlength=len(data) + 2).astype(np.int8)
    mask = np.cumsum(edge[: len(data)], dtype=np.int8) > 0
    kept = data[mask]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    bounds = total[offsets].tolist()
    texts = []
    raw = kept.tobytes()
    for i in range(n_docs):
        piece = raw[bounds[i] : bounds[i + 1]]
        texts.append(piece[:-1] if piece.endswith(b" ") else piece)
    doc_first = words.at[words.doc]
    opens = np.zeros(len(removed) + 1, bool)
    opens[words.at] = True
    begin = np.flatnonzero(removed & (opens[:-1] | ~np.r_[False, removed][:-1]))
    end = np.flatnonzero(removed & (opens[1:] | ~np.r_[removed, False][1:])) + 1
    owner = words.doc[begin]
    spans = pa.StructArray.from_arrays([pa.array(begin - doc_first[begin], pa.int64()), pa.array(end - doc_first[begin], pa.int64())], ["first", "last"])
    counts = np.bincount(owner, minlength=n_docs)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), spans)
    n_removed = np.bincount(words.doc[removed], minlength=n_docs)
    columns = [docs["id"].combine_chunks(), pa.array(words.count, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), lists]
    return pa.Table.from_arrays(columns, names=[id_col, "n_words", "n_removed", "kept", "spans"])
