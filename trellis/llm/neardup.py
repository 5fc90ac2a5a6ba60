"""Embedding near-dedup: an exact metric range join.

Vectors on the unit sphere within cosine t are within distance eps = sqrt(2 - 2t).  Pivots (from a bounded sample) cut
the space into cells, each vector's home being its nearest pivot.  By the triangle inequality a vector can only be
within eps of something in the cell of pivot j if it lies within eps of the plane between its own pivot i and j:
(|v - pj|^2 - |v - pi|^2) / (2 |pi - pj|) <= eps.  It is copied to those cells, so every cell finds all neighbours of its
home vectors by itself.  The home vectors of a cell and the copies that came to it are cut into blocks, and a task
compares two blocks, whatever the size of the cell; the links that a vector found in its blocks are summed afterwards.

The number of pivots is the one whose cost, estimated on the sample, is least: where distances are too alike for the
inequality to prune anything (random directions in many dimensions) this is one cell, compared block by block.

Equal vectors are one vector with a count.  A block gives each of its vectors the number of its links and, instead of
pairs, a star of every group of linked vectors, so no group emits all its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing (n_links 0,
component the id itself); vectors of different length are not compared; rows that repeat an id are one node; a row without
an id links as any other and is a node of its own, whose component is the smallest id that it reaches, null if there is
none, and which is not kept; ties are broken by id; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.components import components
from trellis.llm.shared import materialize


@dataclass(frozen=True)
class Range:
    cosine: float = 0.95
    #: Vectors that the pivots are chosen from and costs are estimated on.
    sample: int = 4096
    most_pivots: int = 1024
    block: int = 8192
    chunk: int = 2048


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components of a list column (nulls as NaN) and the bounds of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float), np.r_[0, np.cumsum(sizes)]


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; 0 rows where that is impossible."""
    with np.errstate(all="ignore"):
        scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
        out = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    out[~np.isfinite(out).all(axis=1)] = 0
    return out


def _homes(unit: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and the cells that it is copied to (its home too)."""
    near = unit @ pivots.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
    gap = near[np.arange(len(home)), home][:, None] - near  # half the difference of the squared distances
    return home, gap <= eps * apart[home] + 1e-9


def choose_pivots(sample: np.ndarray, n: int, most: int, eps: float, block: int = 4096) -> np.ndarray:
    """Farthest-first pivots from the sample, as many as cost least for n vectors."""
    order, far = [0], np.full(len(sample), np.inf)
    while len(order) < min(most, len(sample)):
        far = np.minimum(far, 2 - 2 * sample @ sample[order[-1]])
        if far.max() < 1e-9:
            break
        order.append(int(far.argmax()))
    best, least, k = 1, np.inf, 1
    while k <= len(order):
        home, copied = _homes(sample, sample[order[:k]], eps)
        share = np.bincount(home, minlength=k) / len(home)
        homes, guests = share * n, (copied.mean(axis=0) - share) * n
        compare = float((homes * (homes / 2 + guests)).sum())
        moved = float((homes * (np.ceil(homes / block) + np.ceil(guests / block)) + guests * np.ceil(homes / block)).sum())
        cost = compare + 200.0 * moved + 2.0 * n * k
        if cost < least:
            best, least = k, cost
        k *= 4
    return sample[order[:best]]


def _linked(home: np.ndarray, member: np.ndarray, home_id: np.ndarray, member_id: np.ndarray, home_n: np.ndarray, member_n: np.ndarray, cosine: float, chunk: int):
    """For each home vector the weight of its neighbours among the members, for each member that among the home vectors, and star links of what is linked."""
    count, back = np.zeros(len(home_id), np.int64), np.zeros(len(member_id), np.int64)
    us, vs = [], []
    for i in range(0, len(home_id), chunk):
        for j in range(0, len(member_id), chunk):
            near = home[i : i + chunk] @ member[j : j + chunk].T >= cosine
            if not near.any():
                continue
            h, m = home_id[i : i + chunk], member_id[j : j + chunk]
            rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            part, label = near[np.ix_(rows, cols)], h[rows].copy()
            count[i + rows] += part @ member_n[j + cols]
            back[j + cols] += home_n[i + rows] @ part
            top = np.iinfo(np.int64).max
            while True:
                of_member = np.minimum(np.where(part, label[:, None], top).min(axis=0), m[cols])
                new = np.where(part, of_member[None, :], top).min(axis=1)
                if (new == label).all():
                    break
                label = new
            for ids, to in ((h[rows], label), (m[cols], of_member)):
                us.append(ids[ids != to])
                vs.append(to[ids != to])
    return count, back, np.concatenate(us) if us else count[:0], np.concatenate(vs) if vs else count[:0]


def _dealt(key: np.ndarray, own: np.ndarray, homes: np.ndarray, guests: np.ndarray, most: int = 8192) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, left, right, whether it is the left one) of the pairs of blocks that the copies of vectors go to.

    A copy is given by its vector's key, whether it is at home, and the numbers of home blocks and guest blocks of its
    cell.  Each two home blocks of a cell meet once (a block also meets itself), and each home block meets each guest
    block, numbered behind the home blocks.  The arrays are of ``most`` rows or of one copy at a time.
    """
    block = key % np.maximum(np.where(own, homes, guests), 1)
    times = np.where(own, homes + guests, homes) * (homes > 0)
    total = np.cumsum(times)
    at = 0
    while at < len(key):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        row = np.repeat(np.arange(at, end), times[at:end])
        other = np.arange(len(row)) - np.repeat(np.cumsum(times[at:end]) - times[at:end], times[at:end])
        mine = np.where(own[row], block[row], homes[row] + block[row])
        yield row, np.minimum(mine, other), np.maximum(mine, other), mine <= other
        at = end


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limits: Range = Range()) -> DataFrame:
    """One row per input row: id, n_links (other vectors at ``cosine`` or above), component_id, kept."""
    spark = df.sparkSession
    eps = float(np.sqrt(2 - 2 * limits.cosine))
    given = df.schema[vector_col].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    kind = "array<float>" if single else "array<double>"  # floats travel as such and are compared as doubles
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast(kind).alias("v"))
    sound = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    vectors = rows.filter(sound).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    # vectors that no id has: numbers above all ids
    nameless = F.lit(np.iinfo(np.int64).max) - F.monotonically_increasing_id()
    vectors = materialize(vectors.withColumns({"key": F.xxhash64("v"), "dim": F.size("v"), "id": F.coalesce("id", nameless)}), "vectors")
    highest = rows.agg(F.max("id").alias("id")).first()["id"]
    pivots: dict[int, np.ndarray] = {}
    for r in vectors.groupBy("dim").count().orderBy(F.desc("count")).limit(1).collect():
        sample = vectors.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("id", "key")).limit(limits.sample).select("v").toArrow()
        values, _ = matrix(sample["v"])
        pivots[r["dim"]] = choose_pivots(unit_rows(values.reshape(-1, r["dim"])), r["count"], limits.most_pivots, eps, limits.block)

    def placed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(rows, home cells, cells copied to, dimension) of the vectors of each dimension in a batch."""
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        values, bounds = matrix(batch.column("v"))
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            unit = unit_rows(np.stack([values[bounds[i] : bounds[i + 1]] for i in at]))
            if dim in pivots:
                home, copied = _homes(unit, pivots[dim], eps)
            else:
                home, copied = np.zeros(len(at), np.int64), np.ones((len(at), 1), bool)
            yield at, home, copied, dim

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, home, copied, dim in placed(batch):
                k = copied.shape[1]
                homes = np.bincount(home, minlength=k)
                columns = [np.full(k, dim), np.arange(k), homes, copied.sum(axis=0) - homes]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["dim", "cell", "n", "guests"])

    sizes = vectors.select("dim", "v").mapInArrow(census, "dim int, cell int, n long, guests long").groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.sum("guests").alias("guests"))
    # one row per pivot, and one per odd dimension
    blocks = {(r["dim"], r["cell"]): (-(-r["n"] // limits.block), -(-r["guests"] // limits.block)) for r in sizes.collect()}
    schema = "dim int, cell int, left int, right int, home boolean, id long, key long, n long, v " + kind

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for at, home, copied, dim in placed(batch):
                who, cell = np.nonzero(copied)
                many = np.array([blocks.get((dim, c), (0, 0)) for c in range(copied.shape[1])], np.int64)[cell]
                for row, left, right, first in _dealt(keys[at[who]], home[who] == cell, many[:, 0], many[:, 1]):
                    for i in range(0, len(row), 8192):
                        part = slice(i, i + 8192)
                        take = pa.array(at[who[row[part]]])
                        flags = [np.full(len(take), dim), cell[row[part]], left[part], right[part]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in flags), pa.array(first[part]), *(batch.column(c).take(take) for c in ("id", "key", "n", "v"))], names=["dim", "cell", "left", "right", "home", "id", "key", "n", "v"])

    def join(pair: pa.Table) -> pa.Table:
        dim, same = pair["dim"][0].as_py(), pair["left"][0].as_py() == pair["right"][0].as_py()
        guests = pair["right"][0].as_py() >= blocks[dim, pair["cell"][0].as_py()][0]
        pair = pair.sort_by([("id", "ascending"), ("key", "ascending")])
        home, ids, keys, n = (pair[c].to_numpy() for c in ("home", "id", "key", "n"))
        unit = unit_rows(matrix(pair["v"])[0].reshape(-1, dim))
        other = home if same else ~home
        count, back, u, v = _linked(unit[home], unit[other], ids[home], ids[other], n[home], n[other], limits.cosine, limits.chunk)
        # a guest finds its own neighbours where it is at home
        if not same and not guests:
            ids, keys, count = np.r_[ids[home], ids[other]], np.r_[keys[home], keys[other]], np.r_[count, back]
        else:
            ids, keys = ids[home], keys[home]
        some = count > 0
        k, m = int(some.sum()), len(u)
        columns = [np.r_[ids[some], u], np.r_[keys[some], np.zeros(m, np.int64)], np.r_[count[some], np.zeros(m, np.int64)]]
        links = pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(v, pa.int64())])
        return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in columns), links], names=["id", "key", "n_near", "other"])

    dealt = vectors.select("id", "key", "n", "dim", "v").mapInArrow(deal, schema)
    found = materialize(dealt.groupBy("dim", "cell", "left", "right").applyInArrow(join, "id long, key long, n_near long, other long"), "near")
    label = components(found.filter("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")))
    near = found.filter("other is null").groupBy(F.col("id").alias("rep"), "key").agg(F.sum("n_near").alias("n_near"))
    own = vectors.select("v", F.col("id").alias("rep"), "key")
    tagged = rows.withColumn("w", F.when(sound, F.col("v"))).join(own.withColumnRenamed("v", "w"), "w", "left").select("id", "rep", "key")
    joined = tagged.join(near, ["rep", "key"], "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    reached = F.coalesce("component", "rep", "id")
    component = F.when(reached <= F.lit(highest).cast("long"), reached)
    return joined.select(F.col("id").alias(id_col), F.coalesce(F.greatest(F.col("n_near") - 1, F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
