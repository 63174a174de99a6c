"""The pipeline, stage by stage, against brute force on its own input."""

import os
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline as P
from lumenframe.plans.staging import Staged


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, f in P.STAGES:
        before = docs.toPandas()
        docs = Staged(f(spark, docs, sf), "test").df
        out.append((before, docs.toPandas()))
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert list(after.columns) == list(before.columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_clean_documents(spark, sf):
    """At the scale above ``sf``: sf0.001 itself has eleven bad labels, too few to learn from or to judge by."""
    sf = os.path.join(os.path.dirname(sf), "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    y = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    kept = {r["doc_id"] for r in P.good_quality(spark, docs, sf).select("doc_id").collect()}
    held = [r["doc_id"] for r in docs.where("crc32(cast(doc_id as string)) % 5 = 0").select("doc_id").collect()]
    good, bad = ([i for i in held if y.get(i) == v] for v in (1, 0))
    assert np.mean([i in kept for i in good]) >= 0.98 and np.mean([i in kept for i in bad]) <= 0.25


def test_one_document_of_each_group(stages):
    before, after = stages[1]
    s = {i: shingles(t) for i, t in zip(before.doc_id, before.text, strict=True)}
    comp, where = {i: i for i in s}, {}
    for i, x in s.items():
        for g in x:
            where.setdefault(g, []).append(i)
    for i, x in s.items():
        for j, n in Counter(j for g in x for j in where[g] if j < i).items():
            if 100 * n >= 80 * (len(x) + len(s[j]) - n) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = {k: lo if c == hi else c for k, c in comp.items()}
    assert sorted(after.doc_id) == sorted(set(comp.values()))


def test_no_benchmark_is_left(stages, sf):
    before, after = stages[2]
    items = [shingles(t) for t in pd.read_parquet(f"{sf}/benchmark.parquet").text]
    leaks = {i for i, t in zip(before.doc_id, before.text, strict=True) for x in items if x and 100 * len(x & shingles(t)) >= 80 * len(x)}
    assert set(before.doc_id) - set(after.doc_id) == leaks


def test_mix(stages):
    before, after = stages[3]
    copies = Counter(after.doc_id)
    assert set(copies) <= set(before.doc_id) and max(copies.values()) <= 3
    rows = before.set_index("doc_id")
    size = rows.text.map(lambda t: len((t or "").split()))
    assert sum(size[i] * c for i, c in copies.items()) == pytest.approx(size.sum(), rel=0.05)
    assert (after.drop_duplicates("doc_id").set_index("doc_id").text == rows.text[after.drop_duplicates("doc_id").doc_id]).all()


def test_tokens(stages):
    before, after = stages[4]
    assert sorted(after.doc_id) == sorted(before.doc_id)
    after = after.sort_values("start")
    assert (after.start.to_numpy() == np.concatenate([[0], np.cumsum(after.n_tokens)[:-1]])).all()


def test_run(spark, sf, stages):
    assert sorted(r["doc_id"] for r in P.run(spark, sf).collect()) == sorted(stages[4][1].doc_id)


def test_repeated_and_null_rows(spark, sf):
    rows = [(1, "a b c d e f g h", "en", "s", 1), (1, "a b c d e f g h", "en", "s", 1), (2, "a b c d e f g h", "en", "s", 1), (None, "no id", "en", "s", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in P.one_of_each(spark, docs, sf).collect()]
    assert sorted(got, key=str) == [1, 3, None]
    assert P.no_benchmark(spark, docs, sf).count() == 5 and P.good_quality(spark, docs.limit(0), sf).count() == 0


def test_odd_tables(spark, sf):
    """Empty tables, very long texts and extra columns with the stages' own names go through every stage."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, long, "en", "s", 9), (2, long + " end", "en", "s", 9), (3, "", "en", "t", 0), (4, None, None, None, None), (None, "no id", "en", "t", 1), (5, "a plain text of some words that stays", "en", "t", 1)]
    extra = ("1 AS score", "'x' AS h", "2 AS id", "3 AS size", "true AS kept", "4 AS component_id", "5 AS n", "6 AS part", "7 AS row")
    docs = spark.createDataFrame(rows, kind).selectExpr("*", *extra)
    for _, stage in P.STAGES[:-1]:
        before = docs.columns
        docs = Staged(stage(spark, docs, sf), "odd").df
        assert docs.columns == before
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not {1, 2} <= left
    empty = spark.createDataFrame([], kind).selectExpr("*", *extra)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0
