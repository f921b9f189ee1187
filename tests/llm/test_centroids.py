"""op12 against plain Python integers."""

import hashlib
import math
import random

import pytest

from sparkfolio.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, id int, key string, n string, cluster int"


def brute(rows, k=8, rounds=10, seed=3):
    """rows: (id, vector). The rows that stay, with all columns but the id first."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    cs = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(cs)), key=lambda c: (dist(v, cs[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v), []).append(v)
        cs = [[sum(c) // len(groups[g]) for c in zip(*groups[g])] if g in groups else old for g, old in enumerate(cs)]
    at = [(i, near(v), dist(v, cs[near(v)])) for i, v in kept]
    return [(i, c, d, sum(x[2] for x in at if x[1] == c), sum(x[2] for x in at), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in at]


def same(got, want):
    order = lambda rows: sorted(tuple((x is not None, x) for x in r) for r in rows)
    assert order([tuple(r) for r in got]) == order(want)


def vectors(seed, n, spread=0.2):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    return [[m + r.gauss(0, spread) for m in r.choice(middle)] for _ in range(n)]


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = centroids.op12_centroids(spark, sf_dir)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    same(got.collect(), brute(rows))


def test_edge_rows(spark):
    v = vectors(1, 40)
    bad = [None, [], v[0][:63], v[0] + [0.0], v[0][:63] + [None], v[0][:63] + [math.nan], v[0][:63] + [math.inf], v[0][:63] + [-math.inf]]
    rows = [(k, x) for k, x in enumerate(v)] + [(100 + k, x) for k, x in enumerate(bad)] + [(200 + k, v[3]) for k in range(60)] + [(5, v[5]), (5, v[6]), (None, v[7]), (None, v[7])]
    clash = [(i, x, 1, 2, "k", "n", 9) for i, x in rows]
    df = spark.createDataFrame(clash, SCHEMA).repartition(4)
    as_float = [(i, x) for i, x, *_ in df.select("vec_id", "embedding").collect()]
    same(centroids.cluster(df).collect(), brute(as_float))
    same(centroids.cluster(df, k=3, rounds=1, seed=7).collect(), brute(as_float, 3, 1, 7))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_and_equal_vectors(spark, n):
    rows = [(k, [0.5] * 64) for k in range(n)] + [(50 + k, None) for k in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.cluster(df).collect()
    same(got, brute(rows) if n else [])
    assert {r["cluster"] for r in got} <= {0}


def test_large_components(spark):
    rows = [(k, [x * 5e4 for x in v]) for k, v in enumerate(vectors(2, 30))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(centroids.cluster(df).collect(), brute(rows))
    with pytest.raises(Exception, match="steps"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()
