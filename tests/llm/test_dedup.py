"""op7, op8, op10 and components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from sparkfolio.llm import exact_dedup, simhash, substring
from sparkfolio.llm.components import components

from . import brute
from .conftest import SCHEMA, passage


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    rows = [(i, brute.fingerprint(t)) for i, t in rows_of(df)]
    last = 2**62  # null ids come last
    least = brute.components([(last if i is None else i, f) for i, f in rows])
    want = [(i, f, None if c == last else c) for (i, f), c in zip(rows, least)]
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_groups(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == sorted((c is None, c) for c in {c for _, _, c in want})


@pytest.mark.parametrize("tile", [4096, 64, 16])
def test_links_close_like_all_pairs(spark, tile):
    r = random.Random(tile)
    prints = {0}
    for _ in range(60):  # chains of near fingerprints, hot blocks and strangers
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            prints.add(f)
            for b in r.sample(range(64), r.randint(0, 3)):
                f ^= 1 << b
    base = r.getrandbits(48)
    prints |= {base | r.getrandbits(16) << 48 for _ in range(300)}
    prints = sorted(prints)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    fps = spark.createDataFrame(signed, "fp long")
    made = simhash.links(fps, 2, tile).collect()
    pos = {p: k for k, (p,) in enumerate(signed)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in made:
        i, j = pos[e["a"]], pos[e["b"]]
        root[find(i)] = find(j)
    want = brute.components(list(enumerate(prints)))
    got = [find(i) for i in range(len(prints))]
    assert len({*zip(got, want)}) == len({*got}) == len({*want})


def test_bit_slices_count_exactly():
    r = np.random.default_rng(2)
    fp = r.integers(0, 2**63, 128, dtype=np.uint64)
    fp[64:] = fp[:64] ^ (np.uint64(1) << r.integers(0, 64, 64).astype(np.uint64))
    planes = simhash._planes(fp[None, :])
    masks = np.uint64(0) - (fp[None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1))
    valid = np.full((len(fp), 2), 2**64 - 1, np.uint64)
    for radius in range(6):
        got = np.unpackbits(simhash.near(planes, masks[:, :, None], valid.copy(), radius).view(np.uint8), axis=1, bitorder="little").astype(bool)
        assert (got == (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius)).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(200, 300)] + [(0, k) for k in range(1, 80)] + [(r.randrange(400, 600), r.randrange(400, 600)) for _ in range(150)] + [(5, 5), (7, 6), (6, 7)]
    least = {}
    for a, b in edges:
        least.setdefault(a, a)
        least.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in least.items() if k in linked and k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_substring(request, which):
    df = request.getfixturevalue(which)
    rows = rows_of(df)
    want = [(i, *x) for (i, _), x in zip(rows, brute.repeats([t for _, t in rows]))]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_substring_hot_passages_and_self_overlap(spark):
    r = random.Random(9)
    common, texts = passage(77, 50), []
    for k in range(120):
        own = passage(1000 + k, r.randint(0, 90)).split()
        at = r.randint(0, len(own))
        texts.append(" ".join([*own[:at], *(common.split() if k % 3 else []), *own[at:], *own[: r.randint(0, 60)]]))
    texts += ["y " * n for n in (34, 35, 36, 100)] + ["a b " * 40, passage(5, 34), passage(6, 35), passage(6, 35)]
    df = spark.createDataFrame([(k, t, "en", "s", 0, "k", 0, 0.0) for k, t in enumerate(texts)], SCHEMA).repartition(5)
    for size, seed, most in ((35, 6, 10**5), (35, 6, 3), (5, 3, 10**5), (5, 3, 1)):
        got = [(x["n_words"], x["n_removed"], x["kept_text"]) for x in substring.remove_repeats(df, size=size, seed=seed, most=most).orderBy("doc_id").collect()]
        assert got == brute.repeats(texts, size), (size, most)


def test_substring_paths(spark):
    """Two passages whose middles agree: the graph branches at both ends of what they share."""
    a, b, c = passage(31, 80).split(), passage(32, 80).split(), passage(33, 60).split()
    texts = [" ".join(x) for x in (a + c + b, a + c + b, b + c + a, b + c + a, passage(34, 50).split())]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    made = substring.chains(substring._keyed(df, "doc_id", "text"))
    walks = [t.split() for t in texts]
    edges = {tuple(w[i : i + 35]) for w in walks[:4] for i in range(len(w) - 34)}
    own = made.where("src IS NOT NULL").collect()
    assert sum(r["n"] for r in own) == len(edges)
    paths = substring.compacted(made).select("key", "id", "head").distinct().count()
    assert paths == 5  # a into c, b into c, c, c into a, c into b
    assert substring.compacted(made).count() == len(own) > paths
    for r in substring.occurrences(made).collect():
        assert walks[r["id"]][r["start"] : r["start"] + r["n"] + 34] == walks[r["rid"]][r["rstart"] : r["rstart"] + r["n"] + 34]


def test_substring_rejects_colliding_hashes(spark, monkeypatch):
    """Nodes that all have the hash 0 make unequal windows of one minimizer look repeated; the words don't."""
    common = passage(41, 34)
    df = spark.createDataFrame([(k, f"w{k} {common} z{k}") for k in range(4)], "doc_id long, text string")
    assert {r["n_removed"] for r in substring.remove_repeats(df).collect()} == {0}

    def same(h, size):
        return np.zeros(max(0, len(h) - size + 2), np.uint32)

    monkeypatch.setattr(substring, "node_hashes", same)
    with pytest.raises(Exception, match="give another salt"):
        substring.remove_repeats(df).collect()


@pytest.mark.parametrize("table_bytes", [64 << 20, 2000])
@pytest.mark.parametrize("which", ["edge", "docs"])
def test_exact(request, which, table_bytes):
    df = request.getfixturevalue(which)
    rows, groups = [(i, brute.SPACE.sub(" ", t or "")) for i, t in rows_of(df)], {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    keep = {t: min((x for x in g if x is not None), default=None) for t, g in groups.items()}
    want = [(i, keep[t], len(groups[t]), i == keep[t], brute.sha(t)) for i, t in rows]
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.mark_copies(df, table_bytes=table_bytes).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    assert Counter(brute.SPACE.sub(" ", r["text"] or "") for r in left.collect()) == Counter(list(groups))


def test_grace_with_colliding_hashes():
    records = [(k % 50 % 3, b"t%d" % (k % 50), k, 1, 1) for k in range(500)]
    got = {c: (first, n) for _, c, first, _, n in exact_dedup.grace(iter(records), table_bytes=500)}
    assert got == {b"t%d" % k: (k, 10) for k in range(50)}


def test_empty_tables(empty):
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert substring.remove_repeats(empty).count() == 0
    assert exact_dedup.mark_copies(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_one_row_of_each_group(spark):
    t, u, other = passage(51, 80), passage(51, 79), passage(52, 60)
    rows = [(5, t, "a"), (5, u, "b"), (2, u, "c"), (None, t, "d"), (2, u, "e"), (2, t, "f"), (9, other, "g"), (9, other, "h"), (None, None, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    for left in (simhash.keep_one(df), simhash.keep_one_similar(df)):
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in left.collect())
        assert got == [-1, 2, 9] and left.columns == df.columns


def test_columns_that_clash(spark):
    names = ["kept", "ties", "keep_id", "group_size", "text_sha256", "text", "id", "key", "h", "n"]
    df = spark.createDataFrame([(1, *["x"] * 10), (2, *["x"] * 10), (3, *["y"] * 10)], ["doc_id", *names])
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(df).collect()) == [1, 3]
    assert exact_dedup.drop_copies(df).columns == df.columns and exact_dedup.mark_copies(df).count() == 3
    assert substring.remove_repeats(df, carry=("kept", "key", "id", "n")).count() == 3


def test_grace_leaves_one_large_content_in_place(monkeypatch):
    monkeypatch.setattr(exact_dedup.tempfile, "TemporaryDirectory", None)
    assert [r[4] for r in exact_dedup.grace(iter([(7, b"x" * 1000, 1, 1, 1)] * 3), table_bytes=10)] == [3]
