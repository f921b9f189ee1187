"""The pipeline's near-copy stage against all pairs of five-word Jaccard similarity 0.8 or more."""

import random

import numpy as np
import pytest

import corpus_pipeline
from sparkfolio.llm import simhash

from . import brute
from .conftest import SCHEMA, passage


def copies():
    """Texts of 12 to 400 words with copies of which one word in some is exchanged, chains, and a passage that many share."""
    r, texts = random.Random(3), []
    for k in range(60):
        ws = passage(500 + k, r.choice([12, 40, 100, 400])).split()
        for _ in range(r.randint(1, 6)):
            texts.append(" ".join(ws))
            for _ in range(max(1, len(ws) // 60)):
                ws[r.choice([0, len(ws) - 1, r.randrange(len(ws))])] = f"new{r.random()}"
    return texts + [passage(7, 30) + " " + passage(900 + k, 60) for k in range(150)] + [passage(8, 100) + f" end{k}" for k in range(150)]


def rows_of(df):
    return sorted([(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("which", ["copies", "sf0.01", "edge"])
def test_stage(spark, request, which, sf_dir):
    if which == "copies":
        df = spark.createDataFrame([(k, t, "en", "s", 0, "k", 0, 0.0) for k, t in enumerate(copies())], SCHEMA).repartition(5)
    else:
        df = request.getfixturevalue("edge") if which == "edge" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = rows_of(df)
    first, pairs = brute.similar([t for _, _, t in rows])
    want = [r for r, k in zip(rows, first) if (r[0], r[1]) == rows[k][:2]]
    assert rows_of(corpus_pipeline.without_near_copies(spark, df, sf_dir)) == want and len(want) < len(rows)
    assert pairs


def test_checks_exactly_and_with_any_order(spark, monkeypatch):
    df = spark.createDataFrame([(k, t, "en", "s", 0, "k", 0, 0.0) for k, t in enumerate(copies())], SCHEMA).repartition(3)
    want = rows_of(simhash.keep_one_similar(df))
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    assert rows_of(simhash.keep_one_similar(df)) == want
    sets = [np.arange(10, dtype=np.uint64), np.arange(8, dtype=np.uint64), np.arange(1, 9, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    assert simhash.similar(sets, np.zeros(4, np.uint64), 0.8, 22).tolist() == [0, 0, 0, 3]
    assert simhash.similar(sets, np.zeros(4, np.uint64), 0.85, 22).tolist() == [0, 1, 2, 3]


def test_no_place_holds_a_large_group(spark, monkeypatch):
    """Large groups are parted by sketches and then by tiles, with the result of groups that are checked whole."""
    import pyarrow.compute as pc

    df = spark.createDataFrame([(k, t, "en", "s", 0, "k", 0, 0.0) for k, t in enumerate([*copies(), *copies()[::7]])], SCHEMA).repartition(3)
    want, most, by_group = rows_of(simhash.keep_one_similar(df)), 20_000, simhash._by_group

    def bounded(f, *more):
        def g(t):
            if t.schema.names[-1] in ("text", "data"):
                sizes = pc.binary_length(t.column(t.num_columns - 1)).to_numpy()
                for key in np.unique(t.column(0).to_numpy()):
                    if (held := sizes[t.column(0).to_numpy() == key].sum()) > 3 * most:
                        raise ValueError(f"{held} bytes of a group in one place")
            return f(t)

        return by_group(g, *more)

    monkeypatch.setattr(simhash, "_by_group", bounded)
    monkeypatch.setattr(simhash, "GROUP_BYTES", most, raising=False)
    monkeypatch.setattr(simhash, "SKETCH_BYTES", 10_000, raising=False)
    assert rows_of(simhash.keep_one_similar(df)) == want


def test_similar_sets_have_sketches_of_one_length():
    r = np.random.default_rng(5)
    for n in (2, 2000, 2048, 2049, 2500, 4096, 4100, 5100, 9000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        one = dict(simhash.graded(a, 0.8))
        for m in {max(1, -(-8 * n // 10)), n - 1}:
            other = dict(simhash.graded(a[:m], 0.8))
            assert one.keys() & other.keys()
            for k in one.keys() & other.keys():
                x, y = (np.frombuffer(d[k], np.uint64) for d in (one, other))
                assert len(x) * 64 == k and np.bitwise_count(x ^ y).sum() <= n - m
