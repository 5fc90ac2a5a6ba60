"""The operators against their plain versions, on small tables with every odd case."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import re
import time
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trellis.llm import html_text, induced, jaccard, mixing, neardup, pieces, quality, queries, rounds, substring, suffix_dedup, tokens, warc
from trellis.llm.components import components
from trellis.llm.induced import CAP, suffix_sort
from trellis.llm.rounds import Layout

DOCS = "doc_id long, text string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Texts that share passages, copies, near copies, nulls, empty and very short texts, repeated ids, a null id."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"Word{i}" for i in range(400)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base, out = say(70), say(120), []
    for i in range(n):
        text = say(rng.randrange(5, 150))
        if i % 4 == 0:
            text = f"{say(rng.randrange(20))} {passage}\n{say(rng.randrange(20))}"
        if i % 5 == 0:
            w = base.split()
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w[: rng.randrange(115, 121)])
        out.append((i, text))
    return [*out, (n, base), (n + 1, base), (n + 2, None), (n + 3, ""), (n + 4, " \t\n"), (n + 5, "one"), (n + 6, "one"), (n + 7, "a b"), (3, out[3][1]), (7, passage), (None, base), (n + 8, "x" * 9000), (n + 9, "x" * 8000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def with_extras(df):
    """Columns whose names the operators use themselves."""
    return df.select("*", *(F.lit(1).alias(c) for c in ("id", "g", "kind", "b", "component_id", "n", "kept", "size", "ids", "row", "v")))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# suffix arrays -------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(12))
def test_suffix_sort(seed, tmp_path):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 4, int(rng.integers(1, 300))).astype(np.uint8 if seed % 2 else np.uint16)
    if seed % 3 == 0:
        text = np.tile(text, 2)
    order, shared = suffix_sort(text, 8 if seed % 4 else 1 << 20, str(tmp_path))
    plain = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert list(order) == plain

    def common(a, b):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k] and k < CAP:
            k += 1
        return k

    assert list(shared) == [0, *(common(a, b) for a, b in zip(plain, plain[1:]))]


@pytest.mark.parametrize("width", [np.uint8, np.uint16])
def test_suffix_sort_of_ten_times_its_memory(tmp_path, monkeypatch, width):
    """Names recur in recursion, tuples go through disk, and what the sort allocates follows its budget, not the text."""
    rng = np.random.default_rng(7)
    half = rng.integers(1, 25, 60_000).astype(width)
    text, budget, spilled = np.r_[half, half], 12_000, []
    close = induced.SuffixQueue.close
    monkeypatch.setattr(induced.SuffixQueue, "close", lambda q: (spilled.append(q.spilled), close(q)))
    want = suffix_sort(text, 1 << 30, None, 50)
    assert not any(spilled)
    tracemalloc.start()
    got = suffix_sort(text, budget, str(tmp_path), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    assert max(spilled) > budget and peak < 150 * budget < 16 * len(text)
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize(("length", "gram", "hot"), [(50, 16, 256), (50, 16, 2), (20, 8, 3)])
def test_suffix_dedup(docs, length, gram, hot):
    got = suffix_dedup.dedup_suffixes(with_extras(docs), length=length, gram=gram, hot=hot, memory=500)
    rows = Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
    assert rows == brute.suffix_rows(corpus(), length)


def test_suffix_dedup_with_many_shards_a_bucket(docs):
    got = suffix_dedup.dedup_suffixes(docs, hot=3, unit_bytes=1 << 10, bucket_bytes=1 << 10, shard_bytes=100)
    rows = Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
    assert rows == brute.suffix_rows(corpus(), 50)


class _Held:
    """Stands in for Layout and for tables of messages: keeps the functions of a run."""

    n_buckets, total, carried, carried_ddl = 48, 1 << 20, [], ""
    ask = join_ask = join = unionByName = lambda self, *given: self.held.extend(x for x in given if callable(x)) or self


def test_suffix_unit_memory(monkeypatch):
    """A unit whose every anchor another unit has too; peaks of its rounds in bytes for a byte of text."""
    held = _Held()
    held.held = []
    monkeypatch.setattr(suffix_dedup, "Layout", lambda *_, **__: held)
    monkeypatch.setattr(suffix_dedup, "answer", lambda messages, _: messages)
    suffix_dedup.dedup_suffixes(None)
    ask, send, finish = held.held
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=4000)) for _ in range(250)]
    docs = pa.table({"g": pa.array([0] * 250, pa.int32()), "id": pa.array(range(250), pa.int64()), "text": texts})
    got = {}
    for _, b, _, blob in ask(docs):
        got |= {(kind, b): reply for g, _, kind, reply in suffix_dedup._anchors(256)([(0, blob), (1, blob)], b) if g == 0}
    for step in (lambda: list(send(docs, got)), lambda: finish(docs, got)):
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80 * 1_000_000, peak


def test_suffix_messages_at_6_gb(spark, docs, monkeypatch):
    """Every unit writes to every bucket: 6 GB of parquet files (10 GB of text) are under a million pairs."""
    made = []
    monkeypatch.setattr(rounds, "text_bytes", lambda *_: 10 << 30)
    monkeypatch.setattr(suffix_dedup, "Layout", lambda *a, **k: made.append(Layout(*a, **k)) or made[-1])
    suffix_dedup.dedup_suffixes(docs)
    assert made[0].n_units * made[0].n_buckets < 1_000_000


def test_suffix_spans_and_carry(docs):
    got = suffix_dedup.dedup_suffixes(docs.withColumn("more", F.lit("m")), carry=("more",))
    for r in got.collect():
        assert sum(s["last"] - s["first"] for s in r["spans"]) == r["n_removed"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] and r["more"] == "m"


def test_without_repeats_keeps_columns(docs):
    out = suffix_dedup.without_repeats(with_extras(docs))
    assert out.columns == with_extras(docs).columns and out.filter("text is null or trim(text) = ''").isEmpty()


def test_without_repeats_keeps_replacement_marks(spark):
    """U+FFFD in the texts stays; only the bytes of cut characters go."""
    line = "a \ufffd line that both of the texts hold, with an ü and a \ufffd"
    rows = [(1, "one \ufffd text without any repeat \ufffd\ufffd."), (2, f"é{line}é"), (3, f"first è{line}è \ufffd last"), (4, "\ufffd")]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    want = {i: bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore") for i, data, gone in brute.removed(rows, lambda t: t.encode(), 50)}
    assert got == want and got[1] == rows[0][1] and got[4] == "\ufffd" and "\ufffd last" in got[3]


@pytest.mark.parametrize("window", [50, 12, 3])
def test_substring_dedup(docs, window):
    got = substring.dedup_substrings(with_extras(docs), window=window)
    rows = Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256)).collect())
    assert rows == brute.substring_rows(corpus(), window)
    assert all(sum(s["last"] - s["first"] for s in r["spans"]) == r["n_removed"] for r in got.collect())


@pytest.mark.parametrize("same", [None, 7])
def test_rows_of_one_id_are_dealt_out(spark, monkeypatch, same):
    """A third of the rows without an id, or with one id: no unit and no block of the mixture holds them all."""
    from pyspark.sql import GroupedData

    rows = [(same if i % 3 == 0 else i, " ".join(f"w{i}x{k}" for k in range(1 + i % 40)), "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert max(r["count"] for r in Layout(df, "doc_id", "text").docs.groupBy("g").count().collect()) < 150
    plain = GroupedData.applyInPandas

    def bounded(grouped, func, schema):
        def checked(pdf):
            assert pdf["single"].iloc[0] or len(pdf) <= 200, f"a block holds {len(pdf)} rows"
            return func(pdf)

        return plain(grouped, checked, schema)

    monkeypatch.setattr(GroupedData, "applyInPandas", bounded)
    assert mixing.mix_sources(df, mix=mixing.Mix(block_rows=100)).count() == len(rows)


def test_one_id_on_many_texts(spark):
    """Repeats among rows of one id, which are in several units, against the plain versions."""
    docs = [(None if i % 2 else 3, text) for i, (_, text) in enumerate(corpus(5))]
    df = spark.createDataFrame(docs, DOCS)
    got = suffix_dedup.dedup_suffixes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert Counter(tuple(r) for r in got.collect()) == brute.suffix_rows(docs, 50)
    got = substring.dedup_substrings(df, window=12).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256))
    assert Counter(tuple(r) for r in got.collect()) == brute.substring_rows(docs, 12)
    assert Counter(tuple(r) for r in jaccard.link_documents(df).collect()) == brute.jaccard_rows(docs, 4, 85)


def test_covers_hold_every_difference():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# near duplicates ---------------------------------------------------------------------------
@pytest.mark.parametrize("join", [jaccard.Join(4, 85), jaccard.Join(5, 80), jaccard.Join(1, 50)])
def test_jaccard(docs, join):
    got = Counter(tuple(r) for r in jaccard.link_documents(with_extras(docs), join=join).collect())
    assert got == brute.jaccard_rows(corpus(), join.size, join.percent)


def test_jaccard_chains(spark):
    """A chain of texts, each near the next only: one component through links alone."""
    w = [f"t{i}" for i in range(140)]
    rows = [(100 - i, " ".join(w[i * 2 : i * 2 + 60])) for i in range(40)]
    got = Counter(tuple(r) for r in jaccard.link_documents(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute.jaccard_rows(rows, 4, 85) and len({r[2] for r in got}) == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_family_over_many_blocks(spark, monkeypatch, seed):
    """A family of near copies whose pairs lie on both sides of the threshold, cut into blocks of a few sets."""
    monkeypatch.setattr(jaccard, "_BLOCK_SETS", 6)
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(90)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((1000 - i, " ".join(words[: rng.choice([90, 90, 88, 80])])))
    rows += [(i, rows[i][1]) for i in range(20)]
    want = brute.jaccard_rows(rows, 4, 85)
    assert len({r[2] for r in want}) > 10
    assert Counter(tuple(r) for r in jaccard.link_documents(spark.createDataFrame(rows, DOCS)).collect()) == want


def test_one_per_group(docs):
    kept = [r["doc_id"] for r in jaccard.one_per_group(docs).collect()]
    want = brute.jaccard_rows(corpus(), 4, 85)
    assert Counter(kept) == Counter(i for (i, _, c), k in want.items() for _ in range(k) if i is None or c == i)


def vectors() -> list[tuple]:
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.25).tolist()) for i in range(150)]
    rows += [(150 + i, rows[0][1]) for i in range(30)] + [(200, None), (201, []), (202, [0.0] * 8), (203, [None, *[1.0] * 7]), (204, [float("nan")] * 8), (205, [float("inf"), *[1.0] * 7])]
    return [*rows, (206, [1.0, 2.0]), (207, [2.0, 4.0]), (None, rows[1][1]), (5, rows[5][1]), (208, [x * 1e30 for x in rows[2][1]])]


@pytest.mark.parametrize("limits", [neardup.Range(), neardup.Range(block=16, chunk=7, sample=64), neardup.Range(cosine=0.8, block=32)])
def test_near_duplicates(spark, limits):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(0))
    assert Counter(tuple(r) for r in neardup.near_duplicates(df, limits=limits).collect()) == brute.cosine_rows(rows, limits.cosine)


def test_tasks_hold_two_blocks(spark, monkeypatch):
    """A tight cluster of unequal vectors, in one cell and in many: no task may see more than two blocks of it."""
    from pyspark.sql import GroupedData

    plain = GroupedData.applyInArrow

    def bounded(grouped, func, schema):
        def checked(table):
            assert "home" not in table.column_names or table.num_rows <= 128, f"a task holds {table.num_rows} vectors"
            return func(table)

        return plain(grouped, checked, schema)

    monkeypatch.setattr(GroupedData, "applyInArrow", bounded)
    rng = np.random.default_rng(9)
    rows = [(i, (np.eye(8)[0 if i < 300 else i % 8] + rng.normal(size=8) * 0.05).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for limits in (neardup.Range(block=32, most_pivots=1), neardup.Range(block=32, sample=256)):
        assert Counter(tuple(r) for r in neardup.near_duplicates(df, limits=limits).collect()) == brute.cosine_rows(rows, limits.cosine)


def test_each_pair_of_vectors_meets_once():
    """In a cell, each two vectors at home, and each guest with each vector at home."""
    key = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 50)
    own = np.arange(50) < 30
    met, sides = Counter(), {}
    for row, left, right, first in neardup._dealt(key, own, np.full(50, 4), np.full(50, 3), most=16):
        for r, a, b, side in zip(row.tolist(), left.tolist(), right.tolist(), first.tolist(), strict=True):
            sides.setdefault((a, b), ([], []))[not side].append(r)
    for (a, b), (one, two) in sides.items():
        met.update(frozenset(x) for x in ({(r, s) for r in one for s in two} if a != b else {(r, s) for r in one for s in one if r < s}))
    assert met == Counter(frozenset((r, s)) for r in range(30) for s in range(r + 1, 50))


def test_pivots_prune_clusters():
    rng = np.random.default_rng(2)
    unit = neardup.unit_rows(np.eye(16)[rng.integers(0, 16, 2000)] + rng.normal(size=(2000, 16)) * 0.01)
    pivots = neardup.choose_pivots(unit, 1_000_000, 64, 0.316)
    home, copied = neardup._homes(unit, pivots, 0.316)
    assert len(pivots) >= 16 and copied.sum(1).mean() < len(pivots) / 2
    near = unit @ unit.T >= 0.95
    assert all(copied[j, home[i]] for i, j in zip(*np.nonzero(near)))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(2000 + i, 2001 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = brute.groups({x for a, b in links for x in (a, b)}, links)
    assert got == {n: c for n, c in want.items() if n in got} and all(n in got or sum(c == want[n] for c in want.values()) == 1 for n in want)


# quality, tokens, pieces -----------------------------------------------------------------------
def quality_rows(rows, rules=quality.Rules()):
    out = Counter()
    for doc_id, text in rows:
        text = text or ""
        w = [x.decode() for x in text.encode().split()]
        lines = [x for x in text.split("\n") if x.encode().split()]
        later = [x in lines[:k] for k, x in enumerate(lines)]

        def spread(starts, n):
            return [any(k - n < s <= k for s in starts) for k in range(len(w))]

        grams = {n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for n in {rules.window, *rules.ngram_limits}}
        count = Counter(grams[rules.window])
        repeat = sum(spread([i for i, g in enumerate(grams[rules.window]) if count[g] > 1], rules.window))
        chars, failed = sum(map(len, w)), len(w) < rules.min_words or 100 * repeat > rules.window_percent * len(w)
        bad = 100 * sum(len(x) for x, d in zip(lines, later) if d) > rules.line_limit * sum(map(len, lines))
        for n, limit in rules.ngram_limits.items():
            seen, starts = set(), []
            for i, g in enumerate(grams[n]):
                starts += [i] if g in seen else []
                seen.add(g)
            bad |= 100 * sum(len(x) for x, s in zip(w, spread(starts, n)) if s) > limit * chars
        out[(doc_id, len(w), chars, sum(c in "#*$%&|<>" for c in text), sum(later), repeat, failed, not (failed or bad))] += 1
    return out


def noisy() -> list[tuple]:
    line = "the same long line of words again and again here"
    return [*corpus(3, 20), (500, "\n".join([line] * 6)), (501, "a b c d e f g h i j k l m n\n\n\n" * 4), (502, "#$ " * 30), (503, "ü ö ä " * 20), (504, line + "\r\n" + line)]


def test_quality(spark):
    rows = noisy()
    df = spark.createDataFrame(rows, DOCS)
    got = quality.repetition_rules(with_extras(df)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = quality_rows(rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = quality.keep_good(with_extras(df))
    assert kept.columns == with_extras(df).columns and kept.count() == sum(k for r, k in want.items() if r[-1])


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_counts(spark, rule):
    rows = [*corpus(4, 12), (900, "a\n\n\nb\n \n\t\n c" * 5), (901, " " * 2_000_00 + "x"), (902, "naïve 漢字\r\nline")]
    got = tokens.count_tokens(with_extras(spark.createDataFrame(rows, DOCS)), rule=rule).collect()
    library = tokens.encoder(tokens.VOCABULARY)
    by_id = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got)
    assert by_id == Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows)
    for r in got:
        assert sum(r["section_tokens"]) == r["n_tokens"] and len(r["section_tokens"]) == len(r["section_ends"]) == r["n_sections"]


def test_boundary_rule():
    ends, bounds = np.array([2, 7, 9]), np.array([0, 3, 5, 9])
    assert [tokens.attribute(ends, bounds, r)[0].tolist() for r in tokens.RULES] == [[2, 0, 1], [1, 1, 1], [1, 0, 2]]
    assert tokens.attribute(ends, bounds, "most")[1] == 1


def test_long_white_space_is_encoded_as_the_library_does():
    text = "a" + " " * 6000 + "b\n" + "\n" * 5500 + "  c"
    e = tokens.encoder(tokens.VOCABULARY)
    assert e.encode(text) == e.library.encode_ordinary(text)


def test_pieces(spark):
    rng = random.Random(9)
    giant = " ".join(rng.choice(["hello", "wörld", "漢字", "  ", "x\ny", "thing", "12345", "▁odd"]) for _ in range(600))
    rows = [*corpus(6, 10), (800, giant), (801, " " * 400 + "end"), (801, giant)]
    df = spark.createDataFrame(rows, DOCS)
    got = pieces.decode(pieces.encode(df, giant=300, chunk=64)).collect()
    library = pieces.codec(pieces.MODEL).library
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(library.encode(t or ""))) for i, t in rows)
    assert all(r["decoded"] == (r["text"] or "") for r in got if "▁" not in (r["text"] or ""))


def test_pieces_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6), (2, "giant " * 60, 7, 8)], "doc_id long, text string, IDS long, __row long")
    got = pieces.decode(pieces.encode(df, giant=300, chunk=64), out_col="__row").orderBy("doc_id").collect()
    assert [r["__row"] for r in got] == ["a b", "giant " * 60] and got[0].__fields__ == ["doc_id", "text", "ids", "__row"]


def test_scan_products_are_associative():
    model = pieces.codec(pieces.MODEL)
    text = model.library.normalize("the quick brown fox jumps over the lazy dog " * 3)
    cuts = [0, 13, 40, 77, len(text)]
    parts = [pieces.transfer(model, *pieces._surrounded(model, text, a, b)) for a, b in zip(cuts, cuts[1:])]
    left = pieces.combine(pieces.combine(parts[0], parts[1]), parts[2])
    right = pieces.combine(parts[0], pieces.combine(parts[1], parts[2]))
    assert left[:2] == right[:2] and np.array_equal(left[2], right[2])


# mixtures ---------------------------------------------------------------------------------------
def plain_targets(sizes: dict, mix=mixing.Mix()) -> dict:
    """Shares by weight; what is above its limit stops there, the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    left, share, out = mix.budget * sum(sizes.values()), list(names), {}
    while share:
        even = {s: left * weight[s] / sum(weight[x] for x in share) for s in share}
        over = [s for s in share if even[s] > mix.most * sizes[s]]
        if not over:
            return out | even
        out |= {s: mix.most * sizes[s] for s in over}
        left -= sum(mix.most * sizes[s] for s in over)
        share = [s for s in share if s not in over]
    return out


@pytest.mark.parametrize("many", [0, 1, 3, 40])
def test_targets(spark, many):
    rng = random.Random(many)
    sizes = {rng.choice(["ü", "z", "A", "\U0001f600", "\uffee"]) * (i + 1): rng.choice([0, 1, 5, 900, 10**6]) for i in range(many)} | ({None: 77} if many > 1 else {})
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "src string, s long, n long")
    got = {r["src"]: r["target"] for r in mixing.targets(df, mixing.Mix(sources_a_task=7)).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_flight_balances():
    rng = np.random.default_rng(1)
    p, size = np.full(500, 0.37), rng.integers(1, 900, 500)
    q = mixing.flight(p, size, rng.random(600))
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 400), ["a", "b", "c", None, "ü"][i % 5 if i % 3 else 0]) for i in range(2000)] + [(5, "w w w", "a"), (None, "w", "b"), (3000, None, "c"), (3001, "", "empty")]
    df = spark.createDataFrame(rows, DOCS + ", source string").withColumn("p", F.lit(1))
    for mix in (mixing.Mix(), mixing.Mix(block_rows=50)):
        out = mixing.mix_sources(df, mix=mix).toPandas()
        assert len(out) == len(rows) and (out["taken"] <= 2 * out["size"]).all() and out["copies"].between(0, 2).all()
        assert Counter(out["size"]) == Counter(len((t or "").split()) for _, t, _ in rows)
        for _, part in out.groupby("source", dropna=False):
            assert abs(part["taken"].sum() - part["target"].iloc[0]) <= max(3, 0.002 * part["target"].iloc[0])
        again = mixing.mix_sources(df.repartition(7), mix=mix).toPandas()
        assert Counter(zip(out["doc_id"].fillna(-1), out["copies"])) == Counter(zip(again["doc_id"].fillna(-1), again["copies"]))


# pages and archives --------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<div id="cookie-notice">We use cookies.</div><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy now, buy more.</div><article><h1>Tom &amp; Jerry</h1><p>First   paragraph&nbsp;with <b>bold</b> and<br>a break.<p>Short.<div class="share">Share this</div><p>Last one, with a <a href="z">link</a> in it.</p>
<section class="comments"><p>A reader writes a long comment, and it has many words in it.</p></section></article><aside>Related things.</aside><form><label>Mail</label></form><footer>&copy; x</footer></body></html>"""
TEXT = "Tom & Jerry First paragraph with bold and a break. Short. Last one, with a link in it."


def test_html(spark):
    plain = "<body><h1>A title of some length</h1><p>This page has no article element, but it has sentences. Many of them.</p><p>So.</p><p>The text goes on for a while, with commas, and it ends here. Or here.</p><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul>"
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p"), (5, "u", "<nav>x</nav><div hidden>y</div>"), (6, "u", plain), (None, "u", PAGE[: PAGE.index("Last one")] + "Last"), (1, "u", PAGE), (7, "u", "<article>" + "<div>" * 3000 + "deep text" + "</p></b>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    found = {(r["page_id"]): r["text"] for r in got}
    assert found[1] == TEXT and found[2] == found[3] == found[5] == "" and found[7] == "deep text"
    assert found[6] == "A title of some length This page has no article element, but it has sentences. Many of them. So. The text goes on for a while, with commas, and it ends here. Or here."
    assert found[None] == TEXT[: TEXT.index("Last one")] + "Last" and all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(rows)


LONG = "The council met on Tuesday, and it spoke about the bridge for hours. Nobody had expected that, least of all the mayor. The vote is due in May; until then, the old bridge stays open."


@pytest.mark.parametrize(
    "page",
    [
        f'<div style="overflow:hidden"><article><p>{LONG}</p></article></div>',
        f'<div title="the hidden valley"><p>{LONG}</p></div><p data-hidden="false">{LONG}</p>',
        f"<form action=x><div><article><p>{LONG}</p></article></div></form>",
        f"<form action=x><h1>The old bridge</h1><p>{LONG}</p><p>{LONG}</p></form>",
        f'<div class="content-with-sidebar"><p>{LONG}</p></div>',
        f'<div class="sidebar-layout"><p>{LONG}</p><p>{LONG}</p><div class="ad">Buy now.</div></div>',
        f'<article class="post category-reviews"><h1>The old bridge</h1><p>{LONG}</p></article>',
        f'<div class="widget"><article><p>{LONG}</p></article></div><div class="sidebar"><p>{LONG.replace("bridge", "tower")}</p></div>',
        f'<aside><div role="main"><p>{LONG}</p></div></aside>',
        f'<body class="layout with-sidebar"><div><p>{LONG}</p></div><div><p>{LONG}</p></div>',
        f'<article class="post has-header no-sidebar"><p>{LONG}</p></article>',
        f'<article class="reviews"><p>{LONG}</p><p>{LONG}</p></article>',
        f'<form id="aspnet"><article><p>{LONG}</p></article></form>',
        f'<div class="comments-open"><main><p>{LONG}</p></main></div>',
        f'<main><div class="legal"><p>{LONG}</p></div></main>',
    ],
)
def test_html_words_do_not_drop_articles(page):
    """Names and values that only look like boilerplate, and wrappers of whole pages."""
    wanted = page.replace('<div class="ad">Buy now.</div>', "").split('<div class="sidebar"><p>')[0]
    assert html_text.main_text(page) == " ".join(re.sub("<[^>]*>", " ", wanted).split())


def test_html_has_no_self_closing_form():
    article = f"<article><p>{LONG}</p></article>"
    assert html_text.main_text(f'<script src="a.js"/>var leak = 1;</script>{article}') == LONG
    assert html_text.main_text(f'<div><nav/><a href="x">Leak</a></div>{article}<svg width="2"/><p>After. It goes on, and ends here.</p>').startswith(LONG)
    assert "Leak" not in html_text.main_text(f'<div><nav/><a href="x">Leak</a></div>{article}')


def test_cut_overrules_scores():
    """Short blocks between paragraphs are content by their neighbours alone, also without an article element."""
    costs, flips = html_text.Costs(), 0
    for page, kept in (
        (f"<div><p>{LONG}</p><p>Yes</p><p>{LONG}</p></div>", "Yes"),
        (f"<article><h1>Bridge</h1><p>{LONG}</p><p><a href=x>See here</a></p><p>{LONG}</p></article><footer>Yes</footer>", "See here"),
    ):
        found = html_text.blocks(page)
        scores = [html_text.score(b, costs, w) for b, w in zip(found, html_text.waived(found, costs))]
        sides = html_text.label(found, costs)
        flips += sum((x > 0) != y for x, y in zip(scores, sides))
        assert kept in html_text.main_text(page) and sides == html_text.min_cut(len(found), [max(0, x) for x in scores], [max(0, -x) for x in scores], html_text.smooth_edges(found, costs))
        assert not html_text.main_text(page).endswith("Yes")
    assert flips >= 2


def test_cut_by_parts_is_a_minimum_cut():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 14)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.3]
        cost = lambda s: sum(max(0, -x) if y else max(0, x) for x, y in zip(scores, s)) + sum(w for a, b, w in edges if s[a] != s[b])  # noqa: B023, E731
        assert cost(html_text.cut_by_parts(scores, edges)) == pytest.approx(cost(html_text.min_cut(n, [max(0, x) for x in scores], [max(0, -x) for x in scores], edges)))


@pytest.mark.parametrize("page", ["<b> </b>" * 130_000, "<div>" * 100_000 + "</section>" * 50_000, "<p>ab</p>" * 110_000, "<i>" * 200_000 + "<div>x</div>" * 40_000, "<b><div>" + "<i>" * 150_000 + "x</b>" * 100_000, '<a href="' * 100_000, "<ul><li>a" * 100_000])
def test_html_pages_of_a_megabyte(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 15


@pytest.mark.parametrize("aside", ["<div hidden><article><p>%s</p></article></div>", '<div class="share">%s</div>', '<section class="comments"><p>%s</p></section>', '<form id="f"><p>%s</p></form>', '<p aria-hidden="true">%s</p>', "<nav>%s</nav>", '<div id=cookie-notice><p>%s</div>', '<article class="comment"><p>%s</p></article>'])
def test_html_asides_still_go(aside):
    page = f"<h1>The old bridge</h1>{aside % LONG.replace('bridge', 'tower')}"
    article = f"<p>{LONG}</p>" * 3
    assert html_text.main_text(f"<article>{article}</article>{page}").replace("The old bridge", "").strip() == " ".join([LONG] * 3)


def test_min_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(1, 8)
        s, t = [rng.randrange(0, 9) / 2 for _ in range(n)], [rng.randrange(0, 9) / 2 for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 6) / 2) for _ in range(rng.randrange(0, 10))]
        edges = [e for e in edges if e[0] != e[1]]

        def cost(side):
            return sum(s[i] if not side[i] else t[i] for i in range(n)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(code >> i & 1) for i in range(n)]) for code in range(1 << n))
        assert cost(html_text.min_cut(n, s, t, edges)) == pytest.approx(best)


def test_warc(spark):
    rows = [(4, "http://a/ü", "same"), (2, "http://b", "same"), (9, None, "other\r\n\r\nWARC/1.1\r\n"), (7, "x\r\ny", None), (8, "u", ""), (2, "http://b", "same"), (None, "u", "same"), (11, "u", "é" * 50_000), (None, "u", "nameless"), (None, "u", "nameless"), (12, "http://long/" + "é" * 400_000, "long url")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1))
    got = warc.round_trip(spark, df, "page_id", "url", "html").collect()
    assert not [r for r in got if r["record_type"] == "gap" or r["reason"]]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        ref = first.get(h or "")
        ref = None if ref == i else ref
        want[(str(i), len(data), warc.digest(data), "revisit" if ref is not None else "response", None if ref is None else f"{warc._ID}{ref}")] += 1
    assert Counter((r["record_id"].removeprefix(warc._ID), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    large = warc.round_trip(spark, df, "page_id", "url", "html", min_bytes=5)
    assert large.filter("record_type = 'revisit'").isEmpty()


def test_warc_null_ids_as_in_sql(spark, tmp_path):
    rows = [(3, "u", "a"), (None, "u", "a"), (None, "u", "b"), (None, "u", "b"), (5, "u", None), (4, "u", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(queries.ORACLE_SQL["op9_warc"])
    names = [d[0] for d in found.description]
    got = queries.QUERIES["op9_warc"](spark, str(tmp_path)).select(*names).collect()
    assert Counter(tuple(r) for r in got) == Counter(found.fetchall())


def test_salvage_of_headers_longer_than_a_step():
    data = warc.record("response", 1, "http://u/" + "x" * 2_000_000, b"text", warc.digest(b"text"))
    for whole in (data, warc.member(data)):
        found = list(warc.salvage(io.BytesIO(whole + b"junk"), len(whole) + 4))
        assert len(found[0][2].headers["warc-target-uri"]) == 2_000_009 and found[1][2] is None


def test_near_null_ids_as_in_sql(spark, tmp_path):
    rows = [(3, [1.0, 0.0]), (None, [1.0, 0.25]), (2, [1.0, 0.5]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (7, [-1.0, 0.0]), (None, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(queries.ORACLE_SQL["op10_embedding_near_dedup"])
    names = [d[0] for d in found.description]
    got = Counter(tuple(r) for r in queries.QUERIES["op10_embedding_near_dedup"](spark, str(tmp_path)).select(*names).collect())
    assert got == Counter(found.fetchall()) and got == brute.cosine_rows(rows, 0.95)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    whole = [warc.record("response", i, f"http://x/{i}", f"payload {i} ".encode() * 40, warc.digest(f"payload {i} ".encode() * 40)) for i in range(6)]
    members = [warc.member(r) if packed else r for r in whole]
    members[2] = members[2][:40] + b"\0\xff\x1f\x8b\x08\0WARC/1." + members[2][60:]
    data = b"junk" + b"".join(members)[:-9]
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    assert [r.headers["warc-record-id"][-2] for _, _, r, _ in found if r] == ["0", "1", "3", "4"]
    gaps = [(a, b) for a, b, r, _ in found if r is None]
    assert len(gaps) == 3 and gaps[0] == (0, 4) and gaps[-1][1] == len(data) and all(reason for _, _, r, reason in found if r is None)
    assert [a for a, _, _, _ in found] == [0, *(b for _, b, _, _ in found[:-1])]
    if packed:
        assert gzip.decompress(data[found[1][0] : found[1][1]]) == whole[0]


def test_salvage_of_members_with_several_records(monkeypatch):
    whole = [warc.record("response", i, f"http://x/{i}", (text := f"payload {i} ".encode() * 40), warc.digest(text)) for i in range(6)]
    broken = whole[3].replace(b"payload", b"PAYLOAD")

    def read(data):
        return [(a, b, r and int(r.headers["warc-record-id"][-2]), bool(why)) for a, b, r, why in warc.salvage(io.BytesIO(data), len(data))]

    for step in (64, 1 << 18):
        monkeypatch.setattr(warc, "_STEP", step)
        data = gzip.compress(b"".join(whole))
        assert read(data) == [(0, len(data), i, False) for i in range(6)]
        two = [warc.member(whole[0] + whole[1]), warc.member(whole[2] + b"junk" + broken + whole[4] + b"rest"), warc.member(whole[5])]
        a, b, c = len(two[0]), len(two[0] + two[1]), len(b"".join(two))
        assert read(b"".join(two)) == [(0, a, 0, False), (0, a, 1, False), (a, b, 2, False), (a, b, None, True), (a, b, 4, False), (a, b, None, True), (b, c, 5, False)]
        # a false length neither fills the memory nor hides what follows
        false = whole[1].replace(b"Content-Length: ", b"Content-Length: 99999999")
        assert [r for _, _, r, _ in read(gzip.compress(whole[0] + false + whole[2]))] == [0, None, 2]
    # a cut archive: what was whole before the cut is found, the rest is a gap
    big = [warc.record("response", i, "u", (text := random.Random(i).randbytes(300_000)), warc.digest(text)) for i in range(5)]
    data = gzip.compress(b"".join(big))[:-400_000]
    assert read(data + warc.member(whole[5])) == [(0, 0, 0, False), (0, 0, 1, False), (0, 0, 2, False), (0, len(data), None, True), (len(data), len(data) + len(warc.member(whole[5])), 5, False)]


# empty tables -----------------------------------------------------------------------------------------
def test_empty_tables(spark, nothing):
    assert suffix_dedup.dedup_suffixes(nothing).isEmpty() and substring.dedup_substrings(nothing).isEmpty() and jaccard.link_documents(nothing).isEmpty()
    assert quality.repetition_rules(nothing).isEmpty() and tokens.count_tokens(nothing).isEmpty() and pieces.encode(nothing).isEmpty()
    assert mixing.mix_sources(nothing.withColumn("source", F.lit("a"))).isEmpty()
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).isEmpty() and warc.round_trip(spark, pages, "page_id", "url", "html").isEmpty()


def test_digest_is_that_of_the_ids(spark):
    df = spark.createDataFrame([(1, [3, 4, 5]), (2, None)], "doc_id long, ids array<int>")
    found = {r["doc_id"]: r["sha"] for r in pieces.decode(df, digest_col="sha").collect()}
    assert found[1] == hashlib.sha256(np.array([3, 4, 5], "<i4").tobytes()).hexdigest() and found[2] == hashlib.sha256(b"").hexdigest()
