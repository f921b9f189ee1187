"""op11 against brute force: all pairs of words compared, forms followed one by one."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from sparkfolio.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, one_in=97):
    out = []
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run
            if len(word) >= 5:
                out.append(word)
    return out


def brute(counts, times=2):
    """counts: n by word. word -> form, root, n, n_near, form_n."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def made(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("which", ["edge", "docs"])
@pytest.mark.parametrize("one_in", [97, 3])
def test_words(request, which, one_in):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = Counter(r["word"] for r in spelling.words(df, one_in=one_in).collect())
    assert got == Counter(brute_words(rows, one_in))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = Counter(brute_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    counts = {w: n for w, n in counts.items() if n >= 3}
    kept = dict(sorted(counts.items())[::4])  # brute force is quadratic: a quarter of the words stands for a vocabulary
    assert made(spelling.variants(spark.createDataFrame(list(kept.items()), "word string, n long"))) == brute(kept)
    got = spelling.op11_spelling_variants(spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {k: v[2] for k, v in made(got).items()} == counts


@pytest.mark.parametrize("tile", [2048, 5, 1])
def test_one_edit_of_every_kind(spark, tile):
    r = random.Random(tile)
    words = {"aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "ababa", "éclair", "eclair", "éclairs", "×÷×÷×"}
    for _ in range(12):
        w = "".join(r.choice("abcé") for _ in range(r.randint(5, 11)))
        for _ in range(12):  # chains of edits; repeated letters, edits at both ends and in the middle
            words.add(w)
            i, c = r.randrange(len(w) + 1), r.choice("abcé")
            w = r.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :] if len(w) > 5 else w, w[:i] + c + w[i + 1 :]])
    counts = {w: r.choice([3, 3, 4, 6, 7, 12, 30, 100]) for w in sorted(words)}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    pairs = [(x["a"], x["b"]) for x in spelling.near_pairs(vocab, tile).collect()]
    assert len({frozenset(p) for p in pairs}) == len(pairs)
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in counts for b in counts if a < b and one_edit(a, b)}
    assert made(spelling.variants(vocab, tile=tile)) == brute(counts)


def test_long_chains_and_empty(spark, empty):
    counts = {"a" * (5 + k): 3 * 2**k for k in range(20)}
    got = made(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts) and got["aaaaa"][1] == "a" * 24
    assert spelling.variants(spelling.vocabulary(spelling.words(empty))).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), times=1)
