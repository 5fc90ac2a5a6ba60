"""Suffix-array dedup of byte strings.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a smaller id, judged on
the input.  Shards are made so that equal strings always meet: a string has the least hashed ``gram`` bytes inside it (its
minimizer) together with half of its other bytes before or behind them, whichever side has room first; these bytes are
the string's anchor, equal strings have equal ones, and the consecutive strings of a document with one anchor travel as
one piece of text.  Pieces whose anchor occurs in one document alone are left at home, so what travels are repeats, not
words that many texts use.  A shard holds its distinct pieces, each once, and sorts all their suffixes with the external
induced sort (``induced``); neighbours in the suffix array that share ``length`` bytes are equal strings, and each string
learns whether a smaller document has it.  A bucket holds several shards, sorted one after another, so that units and
buckets (every unit writes to every bucket) can be large while a sort stays small; work on a unit's bytes goes slice by
slice, so its arrays are a few times its text.

An anchor with very many occurrences (the edge of a passage that a third of all documents quote, each in its own
surroundings) is split: its strings travel singly, dealt by their own hash, after those that repeat inside a unit are
merged.

Defined cases: a null text is empty; a null id counts as larger than any other; rows that repeat an id are not matched
with each other; texts shorter than ``length`` stay whole; extra columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.induced import CAP, suffix_sort
from trellis.llm.rounds import Layout, Message, Spread, answer, bits, ids_of, runs, unit_of
from trellis.llm.shared import units
from trellis.llm.words import U64, flatten, mix, packed, slices

_SLICE = 1 << 18
_LOW = U64((1 << 24) - 1)
#: What an anchor weighs whose unit has it in 1, 2.., 8.., 64.. documents.
_WEIGHTS = np.array([1, 2, 8, 64])
_STEPS = np.array([2, 8, 64])


def _eights(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes at each of the first n offsets as an integer."""
    out = np.empty(n, np.uint64)
    raw = data.tobytes() + b"\0" * 16
    for j in range(8):
        out[j::8] = np.frombuffer(raw, "<u8", len(out[j::8]), j)
    return out


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the spans that begin at ``start``, one after another."""
    bounds = np.r_[0, np.cumsum(size, dtype=np.int64)]
    out = np.empty(int(bounds[-1]), data.dtype)
    for i, j in slices(bounds, _SLICE):
        low, high = int(bounds[i]), int(bounds[j])
        out[low:high] = data[np.arange(high - low) + np.repeat(start[i:j] - (bounds[i:j] - low), size[i:j])]
    return out


def _binary(data: np.ndarray, size: np.ndarray) -> pa.LargeBinaryArray:
    bounds = np.r_[0, np.cumsum(size, dtype=np.int64)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(data)])


class _Unit:
    """Pieces of a unit's documents: runs of strings with one anchor."""

    def __init__(self, docs: pa.Table, length: int, gram: int):
        self.length, self.gram = length, gram
        self.ids = ids_of(docs)
        self.data, self.offsets = flatten(docs["text"])
        parts = [self._pieces(i, j) for i, j in slices(self.offsets, _SLICE)]
        self.first, self.last, self.key, self.doc = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))
        del parts
        self.key = self.key.astype(U64)
        order = np.argsort(self.key).astype(self.first.dtype)
        ranked = self.key[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        doc = self.ids[self.doc[order]]
        other = np.r_[False, doc[1:] != doc[:-1]] & ~new if len(doc) else new
        n_docs = 1 + np.bincount(group, weights=other, minlength=len(start)).astype(np.int64)
        self.keys = ranked[start] | np.searchsorted(_STEPS, n_docs, "right").astype(U64)
        self.key_of = np.empty(len(order), order.dtype)
        self.key_of[order] = group

    def _pieces(self, i: int, j: int) -> tuple[np.ndarray, ...]:
        base = int(self.offsets[i])
        data, offsets = self.data[base : int(self.offsets[j])], self.offsets[i : j + 1] - base
        n, span = len(data), self.length - self.gram + 1
        if n < self.length:
            return (np.zeros(0, np.int64),) * 4
        m = n - self.gram + 1
        eights = _eights(data, n - 7)
        key = mix(eights[:m] * U64(0x9E3779B97F4A7C15) ^ (eights[self.gram - 8 : self.gram - 8 + m] + U64(0x7F4A7C15)) * U64(0xD6E8FEB86659FD93))
        parts = []
        for at in range(0, m, 1 << 23):  # positions fit the low bits
            here = key[at : at + (1 << 23) + span]
            least = (here & ~_LOW) | np.arange(len(here), dtype=np.uint64)
            width = 1
            while width < span:
                step = min(width, span - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            parts.append((least & _LOW).astype(np.int32)[: 1 << 23] + np.int32(at) if n < 1 << 31 else (least & _LOW).astype(np.int64)[: 1 << 23] + at)
        where = (np.concatenate(parts) if len(parts) > 1 else parts[0])[: n - self.length + 1]
        half = (self.length - self.gram) // 2
        before = where - np.arange(len(where), dtype=where.dtype) >= half  # else there is room behind the minimizer
        new = np.empty(len(where), bool)
        new[0] = True
        new[1:] = (where[1:] != where[:-1]) | (before[1:] != before[:-1])
        for edge in (offsets[:-1], offsets[1:] - self.length + 1):  # where a document begins, and where its strings end
            new[edge[(edge >= 0) & (edge < len(new))]] = True
        at = np.flatnonzero(new)
        last = np.r_[at[1:], len(new)] - 1
        doc = np.searchsorted(offsets, at, "right") - 1
        whole = at + self.length <= offsets[doc + 1]
        at, last, doc = at[whole], last[whole], doc[whole]
        anchor = where[at].astype(np.int64) - np.where(before[at], half, 0)
        size, found = half + self.gram, np.where(before[at], U64(1), U64(2))
        for k in (*range(0, size - 8, 8), size - 8):
            found = mix((found + eights[anchor + k]) * U64(0x9E3779B97F4A7C15))
        narrow = np.int32 if len(self.data) < 1 << 31 else np.int64
        return (at + base).astype(narrow), (last + base).astype(narrow), found & ~U64(3), (doc + i).astype(narrow)

    def anchors(self, buckets: int) -> Spread:
        return Spread(self.keys >> U64(2), buckets)

    def contents(self, shared: np.ndarray, hot: np.ndarray, buckets: int, parts: int) -> None:
        """The distinct pieces with a shared anchor, with the smallest id that has each; hot ones string by string."""
        take, burst = shared[self.key_of], hot[self.key_of] & shared[self.key_of]
        plain = np.flatnonzero(take & ~burst)
        split = np.flatnonzero(burst)
        count = (self.last[split] - self.first[split] + 1).astype(np.int64)
        single = np.arange(int(count.sum())) + np.repeat(self.first[split] - (np.cumsum(count) - count), count)
        self.start = np.r_[self.first[plain], single].astype(np.int64)
        self.n_strings = np.r_[self.last[plain] - self.first[plain] + 1, np.ones(len(single), np.int64)].astype(np.int64)
        size = self.n_strings + (self.length - 1)
        coded = _binary(_gather(self.data, self.start, size), size).dictionary_encode()
        self.piece_of = coded.indices.to_numpy(zero_copy_only=False)
        self.pieces, bounds = flatten(coded.dictionary)
        self.piece_start, self.piece_size = bounds[:-1], np.diff(bounds)
        self.least = np.full(len(self.piece_size), np.iinfo(np.int64).max)
        self.owner = self.ids[np.r_[self.doc[plain], np.repeat(self.doc[split], count)]]
        np.minimum.at(self.least, self.piece_of, self.owner)
        one = np.zeros(len(self.least), np.int64)
        one[self.piece_of] = np.arange(len(self.piece_of))  # any occurrence: equal pieces have one anchor
        route = np.r_[self.key[plain], self._hashes(single)][one] >> U64(2)
        shard = (route % U64(buckets * parts)).astype(np.int64)
        self.part = (shard % parts).astype(np.int16)
        by_shard = np.lexsort((self.least, shard))
        self.spread = Spread((shard // parts)[by_shard].astype(U64), buckets)
        self.spread.order = by_shard[self.spread.order]

    def _hashes(self, at: np.ndarray) -> np.ndarray:
        """Of the whole strings at some offsets."""
        found = np.zeros(len(at), U64)
        if not len(at):
            return found
        eights = np.lib.stride_tricks.as_strided(self.data, (len(self.data) - 7, 8), (1, 1))
        for k in (*range(0, self.length - 8, 8), self.length - 8):
            found = mix((found + eights[at + k].view("<u8").ravel()) * U64(0x9E3779B97F4A7C15))
        return found

    def message(self, at: np.ndarray, parts: int) -> bytes:
        """Pieces of a bucket, ordered by shard: how many each shard has, the smallest ids, sizes and bytes."""
        ids, counts = runs(self.least[at])
        size = self.piece_size[at]
        body = packed(ids, counts, size.astype(np.uint16), _gather(self.pieces, self.piece_start[at], size))
        return packed(np.array([len(body), len(ids), *np.bincount(self.part[at], minlength=parts)], np.int64)) + pa.compress(body, "zstd", asbytes=True)

    def repeats(self, smaller: np.ndarray) -> np.ndarray:
        """At which offsets a string begins that a smaller document has; ``smaller``: by the strings of the distinct pieces."""
        begin = np.cumsum(self.piece_size - self.length + 1) - (self.piece_size - self.length + 1)
        out = np.zeros(len(self.data), bool)
        for i, j in slices(np.r_[0, np.cumsum(self.n_strings)], _SLICE):
            many, of = self.n_strings[i:j], self.piece_of[i:j]
            inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            gone = smaller[np.repeat(begin[of], many) + inner] | np.repeat(self.owner[i:j] > self.least[of], many)
            out[(np.repeat(self.start[i:j], many) + inner)[gone]] = True
        return out


def _packed(keys: np.ndarray) -> bytes:
    """Ascending anchors of one bucket, by their upper 32 bits (a collision can only make a piece travel), and what they weigh."""
    upper = (keys >> U64(32)).astype(np.uint32)
    planes = np.diff(upper, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return packed(np.array([len(keys)], np.int64), planes, (keys & U64(3)).astype(np.uint8))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    planes = np.frombuffer(blob, np.uint8, 4 * n, 8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32), np.frombuffer(blob, np.uint8, n, 8 + 4 * n)


def _anchors(most: int):
    """Tell each unit which anchors two documents have, and which are hot."""

    def reply(pairs: list[tuple[int, bytes]], bucket: int) -> Iterable[Message]:
        parts, levels = zip(*(_unpacked(blob) for _, blob in pairs), strict=True)
        keys, level = np.concatenate(parts), np.concatenate(levels)
        order = np.argsort(keys)
        ranked = keys[order]
        group = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
        weight = np.bincount(group, weights=_WEIGHTS[level[order]])
        total = np.empty(len(keys))
        total[order] = weight[group]
        at = 0
        for (g, _), part in zip(pairs, parts, strict=True):
            mine = total[at : at + len(part)]
            yield g, bucket, 0, bits(mine > 1)
            if (mine >= most).any():
                yield g, bucket, 1, bits(mine >= most)
            at += len(part)

    return reply


def _shards(length: int, memory: int, parts: int):
    """Suffix-sort the distinct pieces of a bucket's shards; tell each unit which strings a document smaller than its own has."""

    def reply(pairs: list[tuple[int, bytes]], bucket: int) -> Iterable[Message]:
        ids, sizes, texts, cuts, edges = [], [], [], [], []
        for _, blob in pairs:
            raw, m, *per = np.frombuffer(blob, np.int64, 2 + parts).tolist()
            body = np.frombuffer(pa.decompress(memoryview(blob)[8 * (2 + parts) :], raw, "zstd"), np.uint8)
            cut = [0, *accumulate(per)]
            size = body[12 * m : 12 * m + 2 * cut[-1]].view(np.uint16)
            ids.append(np.repeat(body[: 8 * m].view(np.int64), body[8 * m : 12 * m].view(np.uint32)))
            sizes.append(size)
            texts.append(body[12 * m + 2 * cut[-1] :])
            cuts.append(cut)
            edges.append(np.r_[0, np.cumsum(size, dtype=np.int64)][cut].tolist())
        seen: list[list[np.ndarray]] = [[] for _ in pairs]
        for p in range(parts):
            owner, size = (np.concatenate([x[cut[p] : cut[p + 1]] for x, cut in zip(column, cuts, strict=True)]) for column in (ids, sizes))
            if not len(size):
                continue
            text = np.concatenate([x[edge[p] : edge[p + 1]] for x, edge in zip(texts, edges, strict=True)])
            flags, done = _seen(owner, size, text, length, memory), 0
            for found, cut, edge in zip(seen, cuts, edges, strict=True):
                n = edge[p + 1] - edge[p] - (cut[p + 1] - cut[p]) * (length - 1)
                found.append(flags[done : done + n])
                done += n
        for (g, _), found in zip(pairs, seen, strict=True):
            yield g, bucket, 2, bits(np.concatenate(found))

    return reply


def _seen(owner: np.ndarray, size: np.ndarray, data: np.ndarray, length: int, memory: int) -> np.ndarray:
    """Whether a smaller owner has each string of a shard's pieces, in the order of the pieces."""
    coded = _binary(data, size).dictionary_encode()
    del data
    piece_of = coded.indices.to_numpy(zero_copy_only=False)
    data, bounds = flatten(coded.dictionary)
    least = np.full(len(bounds) - 1, np.iinfo(np.int64).max)
    np.minimum.at(least, piece_of, owner)
    # pieces one after another, each ended by symbol 0; no byte of UTF-8 is 255, so symbols fit a byte
    piece_size = np.diff(bounds)
    wide = bool(len(data)) and int(data.max()) == 255
    text = np.zeros(len(data) + len(bounds) - 1, np.uint16 if wide else np.uint8)
    begin = bounds[:-1] + np.arange(len(piece_size))
    inside = np.ones(len(text), bool)
    inside[begin + piece_size] = False
    text[inside] = data.astype(text.dtype) + text.dtype.type(1)
    del coded, data, inside
    with tempfile.TemporaryDirectory() as folder:
        order, shared = suffix_sort(text, memory, folder, length)
        order, shared = np.asarray(order), np.asarray(shared)
    n_strings = piece_size - length + 1
    narrow = np.int32 if len(text) < 1 << 31 else np.int64
    piece_at = np.repeat(np.arange(len(begin), dtype=narrow), piece_size + 1)
    edge = np.zeros(len(text) + 1, np.int8)
    edge[begin] += np.int8(1)
    edge[begin + n_strings] -= np.int8(1)
    is_start = np.cumsum(edge[:-1], dtype=np.int8).view(bool)[order]  # of the strings of a piece
    # runs of the suffix array that share ``length`` symbols; between two strings of a run all neighbours share it too
    run = np.cumsum(shared < length, dtype=narrow)
    at, run = order[is_start], run[is_start]
    del order, shared, is_start, edge
    new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    lowest = np.minimum.reduceat(least[piece_at[at]], new)
    best = np.empty(len(text), np.int64)
    best[at] = np.repeat(lowest, np.diff(np.r_[new, len(at)]))
    del piece_at, at, run
    many = n_strings[piece_of]
    out = np.empty(int(many.sum()), bool)
    bounds = np.r_[0, np.cumsum(many)]
    for i, j in slices(bounds, _SLICE):
        low, high = int(bounds[i]), int(bounds[j])
        spots = np.arange(high - low) + np.repeat(begin[piece_of[i:j]] - (bounds[i:j] - low), many[i:j])
        out[low:high] = best[spots] < np.repeat(owner[i:j], many[i:j])
    return out


def dedup_suffixes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 16, hot: int = 256, memory: int = 1 << 21, carry: tuple[str, ...] = (), as_text: bool = False, unit_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20, shard_bytes: int = 3 << 20) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (binary), spans (removed runs of bytes).

    Columns named in ``carry`` follow; ``as_text``: kept as a string, without the bytes of cut characters.  ``length`` at most CAP; ``hot``: the occurrences from which an anchor is split; ``memory``: entries that
    a shard's sort holds; the rest of a larger shard is in files of the task's scratch folder.  ``unit_bytes``,
    ``bucket_bytes`` and ``shard_bytes``: of the input, for each unit, bucket and shard of a bucket.
    """
    if not gram <= length <= CAP or gram < 8:
        raise ValueError("8 <= gram <= length <= CAP is needed")
    layout = Layout(df, id_col, text_col, unit_bytes=unit_bytes, bucket_bytes=bucket_bytes, carry=carry)
    buckets, carried = layout.n_buckets, layout.carried
    parts = units(layout.total, buckets * shard_bytes, least=1)

    def ask(docs: pa.Table) -> Iterable[Message]:
        unit = _Unit(docs, length, gram)
        for b, at in unit.anchors(buckets).parts():
            yield unit_of(docs), b, 0, _packed(unit.keys[at])

    def send(docs: pa.Table, got: dict) -> Iterable[Message]:
        unit = _pieces(docs, got)
        for b, at in unit.spread.parts():
            yield unit_of(docs), b, 2, unit.message(at, parts)

    def _pieces(docs: pa.Table, got: dict) -> _Unit:
        unit = _Unit(docs, length, gram)
        anchors = unit.anchors(buckets)
        unit.contents(anchors.collect(got, 0), anchors.collect(got, 1), buckets, parts)
        return unit

    def finish(docs: pa.Table, got: dict) -> pa.Table:
        unit = _pieces(docs, got)
        per = unit.piece_size - length + 1
        bounds = np.r_[0, np.cumsum(per)]
        smaller = np.zeros(int(bounds[-1]), bool)
        for b, at in unit.spread.parts():
            if (blob := got.get((2, b))) is not None:
                many = per[at]
                smaller[np.arange(int(many.sum())) + np.repeat(bounds[at] - (np.cumsum(many) - many), many)] = np.unpackbits(np.frombuffer(blob, np.uint8), count=int(many.sum())).view(bool)
        begins = unit.repeats(smaller)
        del unit.key, unit.key_of, unit.first, unit.last, unit.doc, unit.pieces, smaller
        tables = []
        for i, j in slices(unit.offsets, 4 * _SLICE):
            low, high = int(unit.offsets[i]), int(unit.offsets[j])
            begun = np.r_[np.zeros(length, np.int32), np.cumsum(begins[low:high], dtype=np.int32 if high - low < 1 << 31 else np.int64)]
            table = _kept(docs.slice(i, j - i), unit.data[low:high], unit.offsets[i : j + 1] - low, begun[length:] > begun[:-length], id_col)
            tables.append(table.set_column(table.schema.get_field_index("kept"), "kept", _texts(table["kept"])) if as_text else table)
        found = pa.concat_tables(tables)
        for c, name in zip(carry, carried, strict=True):
            found = found.append_column(c, docs[name])
        return found

    shared = answer(layout.ask(ask), _anchors(hot))
    found = answer(layout.join_ask(shared, send), _shards(length, memory, parts))
    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, spans array<struct<first: long, last: long>>" + layout.carried_ddl
    return layout.join(shared.unionByName(found), finish, schema)


def _kept(docs: pa.Table, data: np.ndarray, offsets: np.ndarray, removed: np.ndarray, id_col: str) -> pa.Table:
    n_docs, n = docs.num_rows, len(removed)
    doc_start, doc_end = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    doc_start[offsets[:-1]] = doc_end[offsets[1:]] = True
    begin = np.flatnonzero(removed & (doc_start[:n] | ~np.r_[False, removed[:-1]]) if n else removed)
    end = np.flatnonzero(removed & (doc_end[1:] | ~np.r_[removed[1:], False])) if n else begin
    owner = np.searchsorted(offsets, begin, "right") - 1
    n_spans = np.bincount(owner, minlength=n_docs)
    total = np.r_[0, np.cumsum(removed, dtype=np.int64)]
    n_removed = total[offsets[1:]] - total[offsets[:-1]]
    kept = data[~removed]
    bounds = np.r_[0, np.cumsum(np.diff(offsets) - n_removed)].astype(np.int64)
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_docs, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(kept.tobytes())]).cast(pa.binary())
    spans = pa.StructArray.from_arrays([pa.array(begin - offsets[owner], pa.int64()), pa.array(end + 1 - offsets[owner], pa.int64())], ["first", "last"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_spans)], pa.int32()), spans)
    columns = [docs["id"].combine_chunks(), pa.array(np.diff(offsets), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), texts, lists]
    return pa.Table.from_arrays(columns, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "spans"])


def _texts(kept: pa.ChunkedArray) -> pa.Array:
    """Kept bytes as text without the bytes of characters that were cut; U+FFFD that was there before stays."""
    return pa.array([x.as_py().decode("utf-8", "ignore") for x in kept], pa.string())


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``df`` with repeated strings cut from its texts; bytes of a cut character go, and rows that keep no word go."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    names = {c: f"__carried{i}" for i, c in enumerate(others)}
    found = dedup_suffixes(df.withColumnsRenamed(names), id_col, text_col, length, carry=tuple(names.values()), as_text=True)
    rows = found.withColumnRenamed("kept", "kept_text").filter(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*(F.col("kept_text" if c == text_col else names.get(c, c)).alias(c) for c in df.columns))
