"""The registered queries of the training-data operators, every column of theirs, over a whole table and over the edge rows
stored as one."""

import functools
import hashlib
import math
import zlib

import numpy as np
import pytest

from sparkfolio.llm import registry
from sparkfolio.llm.common import documents

from . import brute
from .test_tokens import ids_of as encoded
from .test_tokens import tok_cache

ids_of = functools.cache(encoded)  # three queries need the same ids


@pytest.fixture(scope="module", params=["whole", "edge"])
def table(request, spark, sf_dir, edge, tmp_path_factory):
    """A folder of tables, and its documents as (id, text) without nulls in text."""
    where = sf_dir
    if request.param == "edge":
        where = f"file://{tmp_path_factory.mktemp('edge')}"
        edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source").write.parquet(f"{where}/documents.parquet")
    return where, sorted((r["doc_id"], r["text"] or "") for r in documents(spark, where).select("doc_id", "text").collect())


def rows(spark, table, name, columns, kinds):
    df = registry.QUERIES[name](spark, table[0])
    assert df.columns[: len(columns)] == columns and [dict(df.dtypes)[c] for c in columns] == kinds.split()
    return [tuple(r[c] for c in columns) for r in df.collect()], df


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1(spark, table):
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got, _ = rows(spark, table, "op1_media_columns", columns, "bigint bigint bigint string bigint bigint string string")
    want = {}
    for i, text in table[1]:
        raw = text.encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        want[i] = (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
    assert {r[0]: r[1:5] for r in got} == want and len(got) == len(want)
    by_text, text_of = {}, dict(table[1])
    for r in got:
        assert r[5] >= r[2] and len(r[6]) == 64 and by_text.setdefault(text_of[r[0]], r[5:]) == r[5:]


def test_op3(spark, table):
    got, _ = rows(spark, table, "op3_token_records", ["doc_id", "start", "n_tokens", "ids_crc32"], "bigint bigint bigint bigint")
    want, at = [], 0
    for i, text in table[1]:
        ids = [*ids_of("word_bpe_49k.json", text), 1]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert sorted(got) == want


def test_op4(spark, table):
    got, _ = rows(spark, table, "op4_token_counts", ["scope", "length", "n_docs", "n_longer", "total_tokens", "truncated_tokens", "rank_to", "all_docs"], "string bigint bigint bigint bigint bigint bigint bigint")
    lang = {r["doc_id"]: r["lang"] for r in documents(spark, table[0]).collect()}
    size = {i: len(ids_of("byte_bpe_50k.json", t)) for i, t in table[1]}
    want = []
    for scope in {"all", *lang.values()} - {None}:
        own = [n for i, n in size.items() if scope in ("all", lang[i])]
        for n in sorted(set(own)):
            want.append((scope, n, own.count(n), sum(x > n for x in own), sum(own), sum(min(x, n) for x in own), sum(x <= n for x in own), len(own)))
    assert sorted(r for r in got if r[0] is not None) == sorted(want)


def test_op5(spark, table):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sequences", "at_least"]
    got, _ = rows(spark, table, "op5_packing", columns, "bigint int bigint bigint bigint bigint bigint bigint bigint")
    want = []
    for i, text in table[1]:
        ids, at, k = [*ids_of("byte_bpe_50k.json", text), 0], 0, 0
        while at < len(ids):
            size = (len(ids) - at - 1) % 2048 + 1
            want.append((i, k, at, size, brute.crc(ids[at : at + size])))
            at, k = at + size, k + 1
    assert sorted(r[:5] for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r[5], []).append((r[6], r[3]))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 2048
    assert {r[7] for r in got} == {len(held)} and all(r[8] <= r[7] for r in got) and got[0][8] >= math.ceil(sum(r[3] for r in got) / 2048)


def test_op6(spark, table):
    got, _ = rows(spark, table, "op6_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "bigint bigint string string")
    want = []
    for i, text in table[1]:
        ids = ids_of("byte_bpe_50k.json", text)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok_cache("byte_bpe_50k.json").decode(ids, skip_special_tokens=False))))
    assert sorted(got) == want


def test_op7(spark, table):
    got, _ = rows(spark, table, "op7_simhash", ["doc_id", "fingerprint", "component_id"], "bigint string bigint")
    prints = [(i, brute.fingerprint(t)) for i, t in table[1]]
    assert sorted(got) == [(i, f"{f:016x}", c) for (i, f), c in zip(prints, brute.components(prints))]


def test_op8(spark, table):
    got, _ = rows(spark, table, "op8_substring_dedup", ["doc_id", "n_words", "n_removed", "kept_sha256"], "bigint bigint bigint string")
    want = [(i, n, gone, sha(kept)) for (i, _), (n, gone, kept) in zip(table[1], brute.repeats([t for _, t in table[1]]))]
    assert sorted(got) == want


def test_op10(spark, table):
    got, _ = rows(spark, table, "op10_exact_dedup", ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "bigint bigint bigint boolean string")
    texts = {i: brute.SPACE.sub(" ", t) for i, t in table[1]}
    same = {}
    for i, t in texts.items():
        same.setdefault(t, []).append(i)
    assert sorted(got) == [(i, min(same[t]), len(same[t]), i == min(same[t]), sha(t)) for i, t in sorted(texts.items())]


def test_op2_and_op9_follow_their_columns(spark, sf_dir):
    """Verdicts are what the bounds say; differences are those of the two sides, and every document has one row."""
    ids = sorted(r["doc_id"] for r in documents(spark, sf_dir).collect())
    x = registry.QUERIES["op2_quality"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in x) == ids
    for r in x:
        inside = r["perplexity"] is not None and r["low"] * (1 - 1e-12) <= r["perplexity"] <= r["high"] * (1 + 1e-12)
        assert r["keep"] == inside
    y = registry.QUERIES["op9_cross_entropy"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in y) == ids
    for r in y:
        if r["n_units"]:
            assert r["ce_difference"] == pytest.approx(r["ce_target"] - r["ce_background"], abs=1e-9)
    assert np.std([r["ce_difference"] for r in y if r["n_units"]]) > 0
