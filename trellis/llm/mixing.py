"""Mixing sources to target weights: cube-method balanced sampling.

Targets: weights share ``budget`` times all sizes; a source's target stops at ``most`` times its size and the excess is
shared again.  A document's expected copies are target / source size; the whole part is taken outright and the rest is
its inclusion probability.  The cube method moves the probabilities of three documents at a time along the null space of
the two balancing constraints (documents and tokens of the source) until one of them is 0 or 1, so that both totals stay
as they are; blocks of a source do this independently, what each leaves open (two documents at most) meets in the next
round, and the last round of a source holds a dozen documents of spread sizes back and lands them with the two left
open: the rounding with the nearest token total.

Only ids, sources and sizes are shuffled.  Blocks are dealt by a hash of the id, so a source with a third of all rows
is as many blocks as its rows need.  Random numbers come from a seed and the block, so reruns agree.

Defined cases: null or empty texts have size 0 and are taken 0 words; a null source is a source of its own, last in
order; rows that repeat an id are sampled each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3, 1, 2)
    budget: float = 1.5
    most: float = 2.0
    block_rows: int = 20_000
    seed: int = 17
    #: Documents of a source that its last round keeps for the landing problem, besides the two left open.
    reserve: int = 12
    #: Sources that one task puts in order.
    sources_a_task: int = 100_000


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """The rows (src, s, n) of ``sizes`` with their target: weights dealt in code point order with null last.

    Where every source stops at ``most`` times its size or takes its weight's share, a target is the lesser of the two for
    one common level, found by a sum over the sources a round; the driver holds sums only.
    """
    parts = max(1, -(-sizes.count() // mix.sources_a_task))
    dealt = sizes.repartitionByRange(parts, F.col("src").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "mix-sources")
    before, counts = {}, {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    for part in sorted(counts):
        before[part] = sum(counts[q] for q in counts if q < part)
    first = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("part")) if before else F.lit(0)
    place = first + F.row_number().over(Window.partitionBy("part").orderBy(F.col("src").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in mix.weights)), (place % len(mix.weights) + 1).cast("int"))
    known = materialize(dealt.withColumn("weight", weight).withColumn("limit", F.col("s") * mix.most), "mix-weights")
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("limit")
        total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
        row = known.agg(total("s").alias("s"), total(F.when(over, F.col("limit"))).alias("full"), total(F.when(~over, F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("n")).first()
        if row["n"] == full or not row["open"]:
            break
        full, level = row["n"], (mix.budget * row["s"] - row["full"]) / row["open"]
    return known.withColumn("target", F.least(F.col("weight") * level, "limit")).select("src", "s", "n", "target")


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities moved to 0 or 1 except for two at most; the sums of p and of p * size stay."""
    p, size = p.tolist(), size.tolist()
    eps, n, nxt, used = 1e-9, len(p), 0, 0
    active: list[int] = []
    draws = draws.tolist()
    while True:
        while len(active) < 3 and nxt < n:
            if eps < p[nxt] < 1 - eps:
                active.append(nxt)
            else:
                p[nxt] = float(round(p[nxt]))
            nxt += 1
        if len(active) == 3:
            a, b, c = active
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if u == (0, 0, 0):
                u = (1, -1, 0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = (1, -1)
        else:
            return np.array(p)
        up = down = float("inf")
        for i, x in zip(active, u, strict=True):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, p[i] / -x), min(down, (1 - p[i]) / -x)
        step = up if draws[used % len(draws)] * (up + down) < down else -down
        used += 1
        still = []
        for i, x in zip(active, u, strict=True):
            q = p[i] + step * x
            if q <= eps or q >= 1 - eps:
                p[i] = float(round(q))
            else:
                p[i] = q
                still.append(i)
        if len(still) == len(active):  # rounding kept all of them open: settle the nearest
            i = min(still, key=lambda i: min(p[i], 1 - p[i]))
            p[i] = float(round(p[i]))
            still.remove(i)
        active = still


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few open probabilities rounded so that the token total is nearest to its expectation, the count close to it."""
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    out = p.copy()
    if len(open_):
        codes = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        tokens = np.abs(codes @ size[open_] - (p[open_] * size[open_]).sum())
        count = np.maximum(np.abs(codes.sum(1) - p[open_].sum()) - 1, 0)
        out[open_] = codes[np.argmin(tokens / max(1.0, float(size[open_].mean())) + count)]
    return np.round(out)


def settle(p: np.ndarray, size: np.ndarray, draws: np.ndarray, reserve: int) -> np.ndarray:
    """The last round of a source (sizes descending): flight of all but a few documents of spread sizes, then landing."""
    held = np.zeros(len(p), bool)
    held[np.unique(np.linspace(0, len(p) - 1, min(reserve, len(p))).astype(int))] = True
    p = p.copy()
    p[~held] = flight(p[~held], size[~held], draws)
    return land(p, size)


def _round(rows: DataFrame, blocks: int, seed: int, reserve: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "row_hash", "id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        name = f"{seed}/{pdf['src'].iloc[0]}/{pdf['block'].iloc[0]}/{blocks}"
        draws = np.random.default_rng(zlib.crc32(name.encode())).random(len(pdf) + 1)
        p, size = pdf["p"].to_numpy(float), pdf["size"].to_numpy(np.int64)
        pdf["p"] = settle(p, size, draws, reserve) if pdf["single"].iloc[0] else flight(p, size, draws)
        return pdf.drop(columns=["block"])

    dealt = rows.withColumn("block", F.pmod(F.col("row_hash"), F.greatest(F.lit(1), F.col("n_blocks"))))
    return dealt.groupBy("src", "block").applyInPandas(run, rows.schema)


def row_hash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mix: Mix = Mix()) -> Column:
    """What tells rows apart and deals them to blocks."""
    return F.xxhash64(df[id_col], df[text_col].cast("string"), F.lit(mix.seed))


def mix_sources(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", mix: Mix = Mix(), hash_col: str | None = None) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken; ``hash_col``: ``row_hash`` too."""
    size = F.coalesce(F.regexp_count(df[text_col].cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    # rows that repeat an id are dealt by their text too
    rows = materialize(df.select(df[id_col].alias("id"), df[source_col].cast("string").alias("src"), size.alias("size"), row_hash(df, id_col, text_col, mix).alias("row_hash")), "mix-sizes")
    aims = targets(rows.groupBy("src").agg(F.sum("size").alias("s"), F.count("*").alias("n")), mix)
    blocks = F.ceil(F.col("n") / mix.block_rows).cast("long").alias("n_blocks")
    rate = F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(0.0).alias("rate")
    by_source = materialize(aims.select("src", F.col("s").alias("source_size"), "target", rate, blocks), "mix-targets")
    joined = rows.join(by_source, rows["src"].eqNullSafe(by_source["src"]), "left").drop(by_source["src"])
    joined = joined.withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("long"))
    joined = joined.withColumn("p", F.when((F.col("size") > 0) & (F.col("rate") - F.col("whole") > 1e-9), F.col("rate") - F.col("whole")).otherwise(F.lit(0.0)))
    joined = joined.withColumn("single", F.col("n_blocks") <= 1)
    undecided = (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
    done = [joined.filter(~undecided)]
    pending, most = joined.filter(undecided), by_source.agg(F.coalesce(F.max("n_blocks"), F.lit(1)).alias("n")).first()["n"]
    while True:
        moved = materialize(_round(pending, most, mix.seed, mix.reserve), "mix-round")
        if most <= 1:
            done.append(moved)
            break
        done.append(moved.filter(~undecided | F.col("single")))
        most = -(-2 * most // mix.block_rows)
        pending = moved.filter(undecided & ~F.col("single")).withColumn("n_blocks", F.ceil(2 * F.col("n_blocks") / mix.block_rows).cast("long"))
        pending = pending.withColumn("single", F.col("n_blocks") <= 1)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.col("whole") + F.round("p").cast("long")
    return out.select(F.col("id").alias(id_col), F.col("src").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *([F.col("row_hash").alias(hash_col)] if hash_col else []))
