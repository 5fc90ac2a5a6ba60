"""N-gram Jaccard join: rare-first prefix filtering.

1. Count.  Units send the distinct shingles of their distinct sets to buckets and learn each one's document count on a
   log scale (a 32-bit key inside a bucket; a collision can only raise a count).
2. Prefix.  A set is ordered rarest first; two sets that reach the threshold share a shingle among the first
   n - ceil(t n) + 1 of each.  Shingles that one set alone has cannot be shared and are left out, so most sets send
   nothing, and positions and lengths count the others only.  Equal sets are one set from here on.
3. Join.  Each prefix shingle names one of its sets as leader, and a set goes once to each leader that its shingles name,
   so two sets that share a prefix shingle meet, though they share hundreds.  What meets at a leader is cut into blocks of
   bounded bytes.  A task holds a block and the leader's block and looks at pairs of different components only: length
   filter, prefix and positional filter, suffix filter (a bound on the overlap from the counts of 64 classes of
   shingles), then one exact verification against the packed shingles.  It returns a spanning forest, not pairs.
4. Rest.  Where a leader had several blocks, its sets that are still outside of the leader's component meet its other
   blocks, two bounded blocks a task.  All other pairs were looked at or lie in one component, so no link between
   components is lost.

Leaders are found by partial aggregates and joined back, which adaptive execution can split, so a shingle that a third
of all documents hold is no task of its own.

Defined cases: null and empty texts have an empty set and no links; a null id links with nothing and has a null
component; rows that repeat an id are one node; ties are broken by id; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.components import components
from trellis.llm.rounds import NO_ID, Layout, Message, Spread, answer, ids_of, trimmed, unit_of
from trellis.llm.shared import materialize, units
from trellis.llm.words import U64, Words, flatten, mix, packed, slices

_CLASSES = 64
#: What a block of sets holds at most (as dealt by hash), and a task about.
_BLOCK_SETS, _BLOCK_BYTES, _TASK_BYTES = 512, 6 << 20, 12 << 20


@dataclass(frozen=True)
class Join:
    size: int = 4
    percent: int = 85

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (self.percent * n + 99) // 100 + 1

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The overlap that sets of a and b shingles must have."""
        return -(-self.percent * (a + b) // (100 + self.percent))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and the n+1 bounds."""
    words = Words(data, offsets)
    hashes = words.hashes(lower=True)
    at, keys = words.grams(hashes, size)
    doc = words.doc[at]
    for k in range(1, size):  # shorter texts are one shingle as a whole
        short = np.flatnonzero(words.count == k)
        if len(short):
            first, own = words.grams(hashes, k)
            mine = np.isin(first, words.at[short])
            mine &= words.count[words.doc[first]] == k
            keys, doc = np.r_[keys, mix(own[mine] ^ U64(0x51ED2700 + k))], np.r_[doc, words.doc[first[mine]]]
    order = np.argsort(keys)
    n_docs = len(offsets) - 1
    order = order[np.argsort(doc[order].astype(np.uint16 if n_docs < 1 << 16 else np.int64), kind="stable")]
    keys, doc = keys[order], doc[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])] if len(keys) else np.zeros(0, bool)
    keys, doc = keys[new], doc[new]
    return keys, np.r_[0, np.cumsum(np.bincount(doc, minlength=n_docs))]


class _Unit:
    """The distinct sets of a unit."""

    def __init__(self, docs: pa.Table, join: Join):
        self.ids = ids_of(docs)
        data, offsets = flatten(docs["text"])
        parts, sizes = [], []
        for i, j in slices(offsets, 4 << 20):
            keys, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], join.size)
            parts.append(keys)
            sizes.append(np.diff(bounds))
        self.keys = np.concatenate(parts) if parts else np.zeros(0, U64)
        self.n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        bounds = np.r_[0, np.cumsum(self.n)]
        one, two = (np.r_[U64(0), np.cumsum(mix(self.keys ^ U64(c)))] for c in (0x1F3D5B79, 0x2468ACE013579BDF))
        signature = np.empty(len(self.n), [("n", np.int64), ("a", U64), ("b", U64)])
        signature["n"], signature["a"], signature["b"] = self.n, one[bounds[1:]] - one[bounds[:-1]], two[bounds[1:]] - two[bounds[:-1]]
        self.signature = signature.view(np.uint8).reshape(-1, 24)
        _, first, inverse = np.unique(signature, return_index=True, return_inverse=True)
        self.rep = first[inverse.ravel()]  # rows are sorted by id: the first is the smallest
        usable = (self.n > 0) & (self.ids != NO_ID)
        self.reps = np.flatnonzero(usable & (self.rep == np.arange(len(self.n))))
        self.copies = np.flatnonzero(usable & (self.rep != np.arange(len(self.n))) & (self.ids != self.ids[self.rep]))
        count = self.n[self.reps]
        self.flat = np.arange(int(count.sum())) + np.repeat(bounds[self.reps] - (np.cumsum(count) - count), count)
        self.set_keys, self.set_of = self.keys[self.flat], np.repeat(np.arange(len(self.reps)), count)
        order = np.argsort(self.set_keys)
        ranked = self.set_keys[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
        self.distinct = ranked[new]
        group = np.cumsum(new) - 1
        self.held_by = np.bincount(group, minlength=len(self.distinct))
        self.distinct_of = np.empty(len(order), np.int64)
        self.distinct_of[order] = group

    def spread(self, buckets: int) -> Spread:
        found = Spread(self.distinct, buckets)  # ascending inside a bucket: the sort is stable
        return found


def _count(pairs: list[tuple[int, bytes]], bucket: int) -> Iterable[Message]:
    """Tell each unit how many sets hold each of its shingles: ceil(log2)."""
    keys, held = [], []
    for _, blob in pairs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        planes = np.frombuffer(blob, np.uint8, 4 * n, 8).reshape(4, n)
        keys.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32))
        held.append(np.frombuffer(blob, np.uint8, n, 8 + 4 * n))
    every, weight = np.concatenate(keys), np.concatenate(held).astype(np.int64)
    order = np.argsort(every)
    ranked = every[order]
    group = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
    level = np.ceil(np.log2(np.bincount(group, weights=weight[order]))).astype(np.uint8)
    out = np.empty(len(every), np.uint8)
    out[order] = level[group]
    at = 0
    for (g, _), part in zip(pairs, keys, strict=True):
        yield g, bucket, 0, out[at : at + len(part)].tobytes()
        at += len(part)


_FOUND = "kind int, id long, n int, other long, token long, m int, prefix int, signature binary, keys binary"


def _binary(rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of bytes given by their bounds."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _found(layout: Layout, join: Join) -> DataFrame:
    """Rows of kind 0 (document and set size), 1 (copies inside a unit), 2 (prefix shingles), 3 (the sets of kind 2)."""
    buckets = layout.n_buckets

    def ask(docs: pa.Table) -> Iterable[Message]:
        unit = _Unit(docs, join)
        for b, at in unit.spread(buckets).parts():
            keys = np.sort((unit.distinct[at] >> U64(32)).astype(np.uint32))
            delta = np.diff(keys, prepend=np.uint32(0))
            order = np.argsort(unit.distinct[at] >> U64(32), kind="stable")
            held = np.minimum(unit.held_by[at][order], 255).astype(np.uint8)
            yield unit_of(docs), b, 0, packed(np.array([len(at)], np.int64), delta.astype("<u4").view(np.uint8).reshape(-1, 4).T, held)

    def prefix(docs: pa.Table, got: dict) -> pa.Table:
        unit = _Unit(docs, join)
        level = np.zeros(len(unit.distinct), np.uint8)
        for b, at in unit.spread(buckets).parts():
            level[at[np.argsort(unit.distinct[at] >> U64(32), kind="stable")]] = np.frombuffer(got[(0, b)], np.uint8)
        rank = level[unit.distinct_of]
        order = np.lexsort((rank, unit.set_of))  # stable: by hash inside a level
        count = unit.n[unit.reps]
        start = np.cumsum(count) - count
        pos = np.arange(len(order)) - np.repeat(start, count)
        owner, common = unit.set_of[order], rank[order] > 0
        sent = (pos < join.prefix(count)[owner]) & common
        token, sender = unit.set_keys[order][sent], owner[sent]
        ahead = np.bincount(sender, minlength=len(count))  # prefix shingles of each set
        active = np.flatnonzero(ahead)
        shared = np.bincount(owner, weights=common, minlength=len(count)).astype(np.int64)
        body = common & (ahead > 0)[owner]
        n_docs, n_copies, n_sent, n_active = docs.num_rows, len(unit.copies), len(token), len(active)
        nulls = pa.nulls

        def stack(parts: list, kind: pa.DataType) -> pa.ChunkedArray:
            return pa.chunked_array([p.cast(kind) if isinstance(p, pa.Array) else pa.array(p).cast(kind) for p in parts], kind)

        ids, reps = unit.ids, unit.reps
        keys = _binary(unit.set_keys[order][body], np.r_[0, np.cumsum(8 * shared[active])])
        signatures = _binary(unit.signature[reps[active]], np.arange(n_active + 1) * 24)
        columns = [
            stack([np.repeat([0, 1, 2, 3], [n_docs, n_copies, n_sent, n_active])], pa.int32()),
            stack([docs["id"].combine_chunks(), ids[unit.copies], ids[reps][sender], ids[reps][active]], pa.int64()),
            stack([unit.n, unit.n[unit.copies], count[sender], count[active]], pa.int32()),
            stack([nulls(n_docs), ids[unit.rep[unit.copies]], nulls(n_sent), nulls(n_active)], pa.int64()),
            stack([nulls(n_docs), nulls(n_copies), token.view(np.int64), nulls(n_active)], pa.int64()),
            stack([nulls(n_docs), nulls(n_copies), nulls(n_sent), shared[active]], pa.int32()),
            stack([nulls(n_docs), nulls(n_copies), nulls(n_sent), ahead[active]], pa.int32()),
            stack([nulls(n_docs), nulls(n_copies), nulls(n_sent), signatures], pa.binary()),
            stack([nulls(n_docs), nulls(n_copies), nulls(n_sent), keys], pa.binary()),
        ]
        return pa.Table.from_arrays(columns, names=["kind", "id", "n", "other", "token", "m", "prefix", "signature", "keys"])

    return materialize(layout.join(answer(layout.ask(ask), _count), prefix, _FOUND), "jaccard")


def _flat(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions first..first+size of each row, one after another, and where each row begins."""
    begin = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - begin, size), begin


class Block:
    """Sets that meet in a task: packed shingles in rare-first order, the first ``ahead`` of them the prefix."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, ahead: np.ndarray, keys: np.ndarray, bounds: np.ndarray, join: Join):
        self.ids, self.n, self.ahead, self.join = ids, n, ahead, join
        self.first, self.m = bounds[:-1], np.diff(bounds)
        self.known, self.key = np.unique(keys, return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), self.m)
        kind = owner * _CLASSES + (keys >> U64(58)).astype(np.int64)
        self.classes = np.bincount(kind, minlength=len(ids) * _CLASSES).astype(np.int32).reshape(-1, _CLASSES)
        self.place = np.full(len(self.known), -1, np.int64)  # of the keys of the set at hand

    def links(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Those of ``ys`` that reach the threshold with x."""
        n, m, join = self.n, self.m, self.join
        need = join.need(n[x], n[ys])
        fits = (np.minimum(n[x], n[ys]) * 100 >= join.percent * np.maximum(n[x], n[ys])) & (np.minimum(m[x], m[ys]) >= need)
        ys, need = ys[fits], need[fits]
        if not len(ys):
            return ys
        own = self.key[self.first[x] : self.first[x] + m[x]]
        self.place[own] = np.arange(m[x])
        at, begin = _flat(self.first[ys], self.ahead[ys])
        there = self.place[self.key[at]]
        py = at - np.repeat(self.first[ys], self.ahead[ys])
        # the first prefix shingle that both have: all that either has before it the other lacks
        rest = np.where((there >= 0) & (there < self.ahead[x]), 1 + np.minimum(m[x] - there - 1, np.repeat(m[ys], self.ahead[ys]) - py - 1), 0)
        fits = np.maximum.reduceat(rest, begin) >= need
        ys, need = ys[fits], need[fits]
        if len(ys):
            fits = np.minimum(self.classes[x], self.classes[ys]).sum(axis=1) >= need
            ys, need = ys[fits], need[fits]
        if len(ys):
            at, begin = _flat(self.first[ys], m[ys])
            ys = ys[np.add.reduceat((self.place[self.key[at]] >= 0).astype(np.int32), begin) >= need]
        self.place[own] = -1
        return ys


def forest(block: Block, rows: np.ndarray, label: np.ndarray, home: np.ndarray, other: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join components among the ``rows`` of a block: home rows against other ones; ``label`` gives the components so far."""
    us, vs = [], []
    label = label.copy()
    both = home & other
    for k in np.flatnonzero(home).tolist():
        ys = np.flatnonzero(other & (label != label[k]))
        ys = ys[~both[ys] | (ys > k)] if both[k] else ys
        if not len(ys):
            continue
        linked = np.searchsorted(rows, block.links(int(rows[k]), rows[ys]))
        if len(linked):
            old, one = np.unique(label[linked], return_index=True)
            us += [int(rows[k])] * len(one)
            vs += rows[linked[one]].tolist()
            label[np.isin(label, old)] = label[k]
    return us, vs


def _looked_at(table: pa.Table, join: Join) -> pa.Table:
    """A spanning forest of the links in each group (leader, part) of a task."""
    if not table.num_rows:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    table = table.sort_by([("leader", "ascending"), ("part", "ascending"), ("first", "descending"), ("id", "ascending"), ("home", "descending")])
    column = {c: table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("leader", "part", "id", "n", "prefix", "label", "home", "other")}
    data, offsets = flatten(table["keys"])
    ids = column["id"]
    block = Block(ids, column["n"].astype(np.int64), column["prefix"].astype(np.int64), data.view(U64), offsets // 8, join)
    cut = np.flatnonzero(np.r_[True, (column["leader"][1:] != column["leader"][:-1]) | (column["part"][1:] != column["part"][:-1]), True])
    us, vs = [], []
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        u, v = forest(block, np.arange(i, j), column["label"][i:j], column["home"][i:j], column["other"][i:j])
        us += u
        vs += v
    return pa.table({"u": pa.array(ids[us] if us else [], pa.int64()), "v": pa.array(ids[vs] if vs else [], pa.int64())})


def _links(meeting: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Links u, v of rows (leader, part, id, m, label, first, home, other), whose sets are packed in ``sets``.

    Groups are dealt to tasks by a hash, so that many small ones share a task; a task's bytes are those of a few blocks.
    """
    total = meeting.agg(F.coalesce(F.sum(F.col("m").cast("long")), F.lit(0)).alias("m")).first()["m"]
    rows = meeting.drop("m").join(sets.select("id", "n", "prefix", "keys"), "id")
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("leader", "part"), F.lit(units(8 * total, _TASK_BYTES))).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        return trimmed(_looked_at(table, join))

    return materialize(dealt.groupBy("task").applyInArrow(run, "u long, v long"), "jaccard-links")


def _blocks(rows: DataFrame, by: str) -> DataFrame:
    """How many blocks the sets of each leader make."""
    return rows.groupBy("leader").agg(F.ceil(F.greatest(F.count("*") / _BLOCK_SETS, F.sum(F.col("m").cast("long")) * 8 / _BLOCK_BYTES)).cast("int").alias(by))


def link_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links)."""
    found = _found(Layout(df, id_col, text_col), join)
    every = found.filter("kind = 3")
    first = every.groupBy("signature").agg(F.min("id").alias("same"))
    named = every.select("id", "n", "m", "signature").join(first, "signature")
    sets = found.filter("kind = 3").join(named.filter("id = same").select("id"), "id", "left_semi")
    tokens = found.filter("kind = 2").select("token", "id").join(named.filter("id = same").select("id", "m"), "id")
    leaders = tokens.groupBy("token").agg(F.min(F.struct(F.xxhash64("id").alias("r"), "id")).alias("least"), F.count("*").alias("k"))
    member = tokens.join(leaders.filter("k > 1").select("token", F.col("least.id").alias("leader")), "token").select("leader", "id", "m").distinct()
    member = materialize(member, "jaccard-members")
    blocks = _blocks(member, "blocks")
    # the leader is in its block 0, which goes to all its other blocks too
    block = F.when(F.col("leader") == F.col("id"), 0).otherwise(F.pmod(F.xxhash64(F.lit(1), "id"), F.col("blocks"))).cast("int")
    dealt = member.join(blocks, "leader").withColumn("block", block)
    parts = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    flags = (F.col("id").alias("label"), (F.col("leader") == F.col("id")).alias("first"), F.lit(True).alias("home"), F.lit(True).alias("other"))
    near = _links(dealt.select("leader", F.explode(parts).alias("part"), "id", "m", *flags), sets, join)
    copies = found.filter("kind = 1").select(F.col("id").alias("u"), F.col("other").alias("v"))
    same = named.filter("id <> same").select(F.col("id").alias("u"), F.col("same").alias("v"))
    label = components(copies.unionByName(same).unionByName(near))
    split = dealt.filter("blocks > 1")
    if not split.isEmpty():
        far = _links(_rest(split, label), sets, join)
        if not far.isEmpty():
            label = components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(far))
    documents = found.filter("kind = 0").select("id", F.col("n").cast("long").alias("n_shingles"))
    joined = documents.join(label.withColumnRenamed("node", "id"), "id", "left")
    return joined.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _rest(split: DataFrame, label: DataFrame) -> DataFrame:
    """The sets outside of their leader's component against the blocks that they have not met."""
    labelled = split.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    main = labelled.filter("id = leader").select("leader", F.col("label").alias("main"))
    rows = materialize(labelled.join(main, "leader").filter("block > 0"), "jaccard-rest")
    outside = rows.filter("label <> main")
    rows = rows.join(_blocks(outside, "outer"), "leader")
    outer = F.pmod(F.xxhash64(F.lit(2), "id"), F.col("outer")).cast("int")
    part = F.concat_ws("-", F.col("i"), F.col("j"))
    common = ("leader", "id", "m", "label", F.lit(False).alias("first"))
    home = rows.filter("label <> main").withColumn("i", outer).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1))).filter("j <> block")
    other = rows.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)))
    home = home.select(part.alias("part"), *common, F.lit(True).alias("home"), F.lit(False).alias("other"))
    return home.unionByName(other.select(part.alias("part"), *common, F.lit(False).alias("home"), F.lit(True).alias("other")))


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """The rows of ``df`` without those of linked documents other than the smallest id of their group."""
    linked = link_documents(df, id_col, text_col, join)
    gone = linked.filter(linked["component_id"] < linked[id_col]).select(F.col(id_col).alias("__gone")).distinct()
    return df.join(gone, df[id_col] == gone["__gone"], "left_anti")
