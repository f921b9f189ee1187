"""Each stage of the pipeline against brute force on what its predecessor kept, and the driver contract."""

from collections import Counter

from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from sparkfolio.llm import quality
from sparkfolio.llm.common import labels
from sparkfolio.llm.tokens import vocabulary

from . import brute


def rows(df):
    return sorted([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()])


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = [(10**6 + k, r["text"].replace(" ", f" {'zq' * k}", 1), r["lang"], r["source"], r["n_chars"]) for k, r in enumerate(docs.orderBy("n_chars", ascending=False).limit(4).collect(), 1)]
    docs = docs.unionByName(spark.createDataFrame(near, docs.schema)).cache()
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5
    before = rows(docs)

    verdict = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels(spark, sf_dir)).collect()}
    first = stages[0](spark, docs, sf_dir)
    assert rows(first) == [r for r in before if verdict[r[0]]] and 0 < sum(verdict.values()) < len(before)

    first, seen, want = first.cache(), set(), []
    for r in rows(first):
        t = brute.SPACE.sub(" ", r[1] or "")
        want += [r] * (t not in seen)
        seen.add(t)
    second = stages[1](spark, first, sf_dir).cache()
    assert rows(second) == want and len(want) < first.count()

    x = rows(second)
    group, _ = brute.similar([r[1] for r in x])  # rows are in order of doc_id
    third = stages[2](spark, second, sf_dir).cache()
    assert rows(third) == [r for k, r in enumerate(x) if group[k] == k] and third.count() < len(x)

    x, want = rows(third), []
    for r, (n, gone, kept) in zip(x, brute.repeats([r[1] for r in x])):
        if not gone:
            want.append(r)
        elif gone < n:
            want.append((r[0], kept, r[2], r[3], len(kept)))
    fourth = stages[3](spark, third, sf_dir).cache()
    assert rows(fourth) == want and want != x

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    got, by = stages[4](spark, fourth, sf_dir).collect(), {}
    assert Counter(r["doc_id"] for r in got) == Counter({r[0]: -(-(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1) // 2048) for r in rows(fourth)})
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= 2048


def test_contract():
    names = {n.split("_")[0] for n in __spark_entry__.queries()}
    assert {f"op{n}" for n in range(1, 11)} <= names and "pipeline" in names
    assert all(isinstance(s, str) for s in __spark_entry__.oracle_sql().values())
