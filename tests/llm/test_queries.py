"""The registered queries over sf0.001: SQL where there is some, plain versions where there is none."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import plain_targets, quality_rows
from trellis.llm import pieces, queries, tokens


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(db):
    return db.execute("select doc_id, text from documents").fetchall()


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(name, spark, sf_dir, db):
    df = queries.QUERIES[name](spark, sf_dir)
    found = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == Counter(found.fetchall())


def test_op1(spark, sf_dir, documents):
    got = queries.QUERIES["op1_suffix_array_dedup"](spark, sf_dir)
    assert Counter(tuple(r) for r in got.collect()) == brute.suffix_rows(documents, 50)


def test_op2(spark, sf_dir, db):
    import html
    import re

    want = {}
    for i, page in db.execute("select page_id, html from pages").fetchall():
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = (html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", p))) for p in re.split(r"</?(?:p|h1)>", article))
        want[i] = " ".join(" ".join(p.split()) for p in parts if p.strip())
    assert {r["page_id"]: r["text"] for r in queries.QUERIES["op2_html_extraction"](spark, sf_dir).collect()} == want


def test_op3(spark, sf_dir, documents):
    got = queries.QUERIES["op3_substring_dedup"](spark, sf_dir)
    assert Counter(tuple(r) for r in got.collect()) == brute.substring_rows(documents, 50)


def test_op4(spark, sf_dir, documents):
    got = queries.QUERIES["op4_ngram_jaccard"](spark, sf_dir)
    assert Counter(tuple(r) for r in got.collect()) == brute.jaccard_rows(documents, 4, 85)


def test_op5(spark, sf_dir, documents):
    out = queries.QUERIES["op5_mix_sources"](spark, sf_dir).toPandas()
    assert dict(zip(out["doc_id"], out["size"])) == {i: len(brute.words(t)) for i, t in documents}
    assert (out["taken"] <= 2 * out["size"]).all()
    sums = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), stated=("source_size", "first"))
    assert (sums["size"] == sums["stated"]).all() and sums["target"].sum() == pytest.approx(1.5 * out["size"].sum()) and (sums["target"] <= 2 * sums["size"] + 1e-6).all()
    want = plain_targets({None if s != s else s: n for s, n in out.groupby("source", dropna=False)["size"].sum().items()})
    assert {None if s != s else s: t for s, t in out.groupby("source", dropna=False)["target"].first().items()} == pytest.approx(want)
    rate = out["target"] / out["source_size"]
    assert ((out["copies"] >= np.floor(rate + 1e-12)) & (out["copies"] <= np.ceil(rate - 1e-12)) | (out["size"] == 0)).all() and (out["taken"] == out["copies"] * out["size"]).all()
    # a source of a few documents can only come as near as whole documents do
    assert ((sums["taken"] - sums["target"]).abs() <= 0.02 * sums["target"] + 5).all()


def test_op6(spark, sf_dir, documents):
    library = tokens.encoder(tokens.VOCABULARY).library
    got = {r["doc_id"]: (r["n_tokens"], r["n_sections"], sum(r["section_tokens"])) for r in queries.QUERIES["op6_token_counts"](spark, sf_dir).collect()}
    for i, text in documents:
        n = len(library.encode_ordinary(text or ""))
        assert got[i] == (n, max(1, len((text or "").removesuffix("\n").split("\n"))), n)


def test_op7(spark, sf_dir, documents):
    got = queries.QUERIES["op7_quality_rules"](spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter(tuple(r) for r in got.collect()) == quality_rows(documents)


def test_op8(spark, sf_dir, documents):
    library = pieces.codec(pieces.MODEL).library
    got = {r["doc_id"]: (r["n_pieces"], r["pieces_sha256"], r["round_trip"]) for r in queries.QUERIES["op8_sentencepiece"](spark, sf_dir).collect()}
    for i, text in documents:
        ids = library.encode(text or "")
        assert got[i] == (len(ids), pieces.sha_of(ids), True)


def test_pipeline(spark, sf_dir, db):
    """Each stage against its plain version, on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, sf_dir).cache()
    good = {r[0] for r in quality_rows(rows) if r[-1]}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == good
    rows = [r for r in rows if r[0] in good]
    single = stages["n-gram Jaccard join"](spark, kept, sf_dir).cache()
    first = {r[0] for r in brute.jaccard_rows(rows, 5, 80) if r[0] == r[2]}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == first
    rows = [r for r in rows if r[0] in first]
    cut = stages["suffix-array dedup"](spark, single, sf_dir).cache()
    want = {i: bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore") for i, data, gone in brute.removed(rows, lambda t: t.encode(), 50)}
    assert cut.columns == columns and {r["doc_id"]: r["text"] for r in cut.collect()} == {i: t for i, t in want.items() if t.encode().split()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    mixed = stages["mixing sources"](spark, cut, sf_dir).cache()
    times = Counter(r["doc_id"] for r in mixed.collect())
    sizes = {r["doc_id"]: len(brute.words(r["text"])) for r in cut.collect()}
    assert mixed.columns == columns and max(times.values()) <= 2 and abs(sum(sizes[i] * k for i, k in times.items()) - 1.5 * sum(sizes.values())) < 0.02 * sum(sizes.values())
    last = stages["SentencePiece"](spark, mixed, sf_dir).collect()
    library = pieces.codec(pieces.MODEL).library
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert Counter(r["doc_id"] for r in last) == times and all(r["piece_ids"] == library.encode(texts[r["doc_id"]]) for r in last)


def test_stages_bear_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "word " * 30, None, None, 5), (4, "x y z " * 5, "en", None, 1), (4, "x y z " * 5, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).collect()
        stage(spark, docs.limit(0), sf_dir).collect()


def test_entry_lists_all():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names and os.path.exists("/root/testdata")
