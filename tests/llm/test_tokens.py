"""op1, op3, op4, op5, op6 against the libraries that define them."""

import hashlib
import random
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkfolio.llm import bpe, media, packing, records, token_counts
from sparkfolio.llm.common import scratch_path
from sparkfolio.llm.tokens import vocabulary

from . import brute


def tok(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(name, text):
    return tok_cache(name).encode(text or "", add_special_tokens=False).ids


_made = {}


def tok_cache(name):
    return _made.setdefault(name, tok(name))


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("kind", ["ppm", "bmp"])
@pytest.mark.parametrize("which", ["edge", "docs"])
def test_media_round_trip(request, which, kind):
    df = request.getfixturevalue(which)
    got = media.media_tiles(media.text_images(df, kind=kind)).collect()
    want = []
    for i, t in rows_of(df):
        b = (t or "").encode()
        p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        want.append((i, len(b), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(want, key=key) == sorted(((r["id"], r["n_bytes"], hashlib.sha256(r["samples"]).hexdigest(), zlib.crc32(r["samples"][-16:])) for r in got), key=key)
    assert all(r["media_error"] is None and r["height"] * 192 == len(r["samples"]) for r in got)


def plain_area(x, height, width):
    """Exact means over areas, pixel by pixel."""
    out = [[Fraction(0)] * width for _ in range(height)]
    sy, sx = Fraction(x.shape[0], height), Fraction(x.shape[1], width)
    for i in range(height):
        for j in range(width):
            for a in range(x.shape[0]):
                h = min(sy * (i + 1), a + 1) - max(sy * i, a)
                for b in range(x.shape[1]):
                    w = min(sx * (j + 1), b + 1) - max(sx * j, b)
                    if h > 0 and w > 0:
                        out[i][j] += h * w * int(x[a, b])
    return np.array([[float(v / (sy * sx)) for v in row] for row in out])


def test_area_resize_is_exact():
    r = np.random.default_rng(1)
    for shape, to in (((7, 11), (3, 4)), ((5, 5), (8, 9)), ((16, 18), (8, 9)), ((1, 1), (2, 2))):
        x = r.integers(0, 256, shape, dtype=np.uint8)
        assert np.allclose(media.area_resize(x, *to), plain_area(x, *to))


def test_difference_hash():
    r = np.random.default_rng(3)
    for shape in ((16, 18), (16, 18, 3), (3, 64, 3), (40, 9)):
        x = r.integers(0, 256, shape, dtype=np.uint8)
        planes = [x] if x.ndim == 2 else [x[:, :, k] for k in range(3)]
        weights = [1.0] if x.ndim == 2 else [0.299, 0.587, 0.114]
        small = np.round(sum(w * plain_area(p, 8, 9) for w, p in zip(weights, planes)), 6)
        bits = "".join("1" if small[i, j] < small[i, j + 1] else "0" for i in range(8) for j in range(8))
        assert media.difference_hash(x) == f"{int(bits, 2):016x}"


def bmp(bits, rows, palette=b"", packed=0, extra=b"", header=40):
    """A BMP of one row of bytes."""
    head = struct.pack("<IiiHHIIiiII", 40, 4, 1, 1, bits, packed, len(rows), 0, 0, len(palette) // 4, 0) if header == 40 else struct.pack("<IHHHH", 12, 4, 1, 1, bits)
    start = 14 + len(head) + len(extra) + len(palette)
    return struct.pack("<2sIHHI", b"BM", start + len(rows), 0, 0, start) + head + extra + palette + rows


def test_bmp_forms():
    two, sixteen = bytes([1, 2, 3, 0, 4, 5, 6, 0]), b"".join(bytes([k, k + 1, k + 2, 0]) for k in range(16))
    assert media.decode(bmp(1, b"\xa0\0\0\0", two)).tolist() == [[[6, 5, 4], [3, 2, 1], [6, 5, 4], [3, 2, 1]]]
    assert media.decode(bmp(4, b"\x1f\x20\0\0", sixteen)).tolist() == [[[3, 2, 1], [17, 16, 15], [4, 3, 2], [2, 1, 0]]]
    core = b"".join(bytes([k, k, k]) for k in range(256))
    assert media.decode(bmp(8, b"\x05\x06\x07\x08", core, header=12))[0, :, 0].tolist() == [5, 6, 7, 8]
    assert media.decode(bmp(16, struct.pack("<4H", 0x7FFF, 0x7C00, 0x03E0, 0x001F))).tolist() == [[[255] * 3, [255, 0, 0], [0, 255, 0], [0, 0, 255]]]
    masks = struct.pack("<III", 0xF800, 0x07E0, 0x001F)
    assert media.decode(bmp(16, struct.pack("<4H", 0xFFFF, 0xF800, 0x07E0, 0x001F), packed=3, extra=masks)).tolist() == [[[255] * 3, [255, 0, 0], [0, 255, 0], [0, 0, 255]]]
    masks = struct.pack("<III", 0xFF000000, 0xFF0000, 0xFF00)
    assert media.decode(bmp(32, struct.pack("<4I", 0x01020300, 0, 0, 0xFFFFFF00), packed=3, extra=masks))[0, 0].tolist() == [1, 2, 3]


def test_media_forms_and_damage(spark):
    x = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    assert (media.decode(media.to_ppm(x)) == x).all() and (media.decode(media.to_bmp(x)) == x).all()
    assert (media.decode(b"P2\n# note\n2 2\n255\n0 1\n2 3\n") == [[0, 1], [2, 3]]).all()
    assert (media.decode(b"P4\n9 1\n\x80\x80") == [[0, 255, 255, 255, 255, 255, 255, 255, 0]]).all()
    bad = spark.createDataFrame([(1, None), (2, b"P6\n9 9\n255\nxx"), (3, b"junk"), (4, b""), (5, b"P5\n99999999999 99999999999\n255\n"), (6, b"P5\n9999999999 9999999999\n255\n"), (7, b"P5\n1 1\n0\n\0"), (8, b"P2\n1 1\n255\n-5\n"), (9, b"P5\n1 1\n70000\n\0\0"), (10, b"P2\n1 1\n3\n7\n"), (11, b"P2\n1 1\n9\nx\n"), (12, b"BM" + bytes(60)), (13, b"P6\n0 0\n255\n"), (14, bmp(8, b"1234", packed=1))], "id long, media binary")
    got = {r["id"]: r for r in media.media_tiles(bad).collect()}
    assert all(got[k]["samples"] is None for k in got) and got[1]["media_error"] is None and all(got[k]["media_error"] for k in range(2, 15))


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_records(spark, request, which):
    df = request.getfixturevalue(which)
    name = "word_bpe_49k.json"
    manifest = records.write_records(df, scratch_path(spark, "rec"), name, shard_bytes=100_000)
    got = records.read_records(manifest).orderBy("start").collect()
    rows = sorted(rows_of(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows):
        ids = [*ids_of(name, t), 1]
        assert (r["id"], r["start"], bytes(r["ids"])) == (i, at, b"".join(x.to_bytes(4, "little") for x in ids)), (i, t and t[:50])
        at += len(ids)
    mixed = [(r["id"], tuple(r["ids"])) for r in records.shuffled(manifest, 3, 4).collect()]
    assert Counter(mixed) == Counter((r["id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got)
    assert mixed != [(r["id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got]


def test_record_damage_shows(tmp_path):
    p = tmp_path / "x"
    data = bytearray(records.frame(b"hello") + records.frame(b""))
    p.write_bytes(data)
    with p.open("rb") as f:
        assert [records.unframe(f) for _ in range(3)] == [b"hello", b"", None]
    for at in (0, 9, 14, len(data) - 1):
        p.write_bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        with p.open("rb") as f, pytest.raises(ValueError):
            while records.unframe(f) is not None:
                pass


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_token_counts(request, which):
    df = request.getfixturevalue(which)
    sums = token_counts.suffix_sums(token_counts.length_histogram(df, "byte_bpe_50k.json", scope="lang"))
    n = [len(ids_of("byte_bpe_50k.json", t)) for _, t in rows_of(df)]
    got = [r for r in sums.collect() if r["scope"] == "all"]
    assert {r["length"]: r["n_docs"] for r in got} == Counter(n)
    for r in got:
        x = r["length"]
        assert (r["n_longer"], r["total_tokens"], r["truncated_tokens"], r["rank_to"]) == (sum(v > x for v in n), sum(n), sum(min(v, x) for v in n), sum(v <= x for v in n))
    limits = {r["limit"]: (r["n_longer"], r["truncated_tokens"]) for r in token_counts.at_limits(sums, [0, 1, 100, 10**6]).collect()}
    assert limits == {x: (sum(v > x for v in n), sum(min(v, x) for v in n)) for x in (0, 1, 100, 10**6)}
    assert {r["scope"]: r["length"] for r in token_counts.quantile(sums, 0.5).collect()}["all"] == sorted(n)[-(-len(n) // 2) - 1]


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    name, capacity = "byte_bpe_50k.json", 2048
    got = packing.pack(packing.pieces(df, name, capacity), capacity).collect()
    want = []
    for i, t in rows_of(df):
        ids = [*ids_of(name, t), 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, brute.crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(want, key=key) == sorted(((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= capacity
    sizes = Counter(r["length"] for r in got)
    assert packing.lower_bound(sizes, capacity) <= len(by) <= sum(n for _, n in packing.best_fit(sizes, capacity))


def test_plans_are_optimal_on_small_cases():
    r = random.Random(7)
    for _ in range(150):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        made = packing.plan(Counter(sizes), 20, nodes=500)
        assert Counter({s: sum(n * dict(p).get(s, 0) for p, n in made) for s in set(sizes)}) == Counter(sizes)
        assert all(sum(a * b for a, b in p) <= 20 for p, _ in made)
        best = brute.fewest_bins(sizes, 20)
        assert packing.lower_bound(Counter(sizes), 20) <= best == sum(n for _, n in made), sizes


@pytest.mark.parametrize("leaf,spread", [(64, 2000), (8192, 65_536)])
@pytest.mark.parametrize("which", ["edge", "docs"])
def test_bpe(request, which, leaf, spread):
    df = request.getfixturevalue(which)
    name = "byte_bpe_50k.json"
    got = [(r["id"], tuple(r["ids"]), r["decoded"]) for r in bpe.encode(df, name, leaf=leaf, spread=spread, round_trip=True).collect()]
    want = []
    for i, t in rows_of(df):
        ids = ids_of(name, t)
        want.append((i, tuple(ids), tok_cache(name).decode(ids, skip_special_tokens=False)))
    assert sorted(got, key=key) == sorted(want, key=key)
    again = bpe.decode(bpe.encode(df, name), name).collect()
    assert sorted((r["decoded"] for r in again)) == sorted(w[2] for w in want)


def test_bpe_joins_unsplit_texts():
    r = random.Random(3)
    t, e = tok_cache("byte_bpe_50k.json"), bpe.TreeEncoder(vocabulary("byte_bpe_50k.json"), leaf=16)
    for alphabet in ("ab", "abcdefgh", "the ing ", "  \n\t x", "0123 a", "'sltd Im", "éü中😀a ", "=-!? ", "  a "):
        texts = ["".join(r.choice(alphabet) for _ in range(n)) for n in (1, 15, 17, 100, 700)]
        assert [x.tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts], alphabet


def test_empty_tables(spark, empty):
    assert media.media_tiles(media.text_images(empty)).count() == 0
    m = records.write_records(empty, scratch_path(spark, "rec"), "word_bpe_49k.json")
    assert records.read_records(m).count() == 0 and records.shuffled(m, 1, 2).count() == 0
    assert token_counts.suffix_sums(token_counts.length_histogram(empty, "byte_bpe_50k.json", scope="lang")).count() == 0
    assert packing.pack(packing.pieces(empty, "byte_bpe_50k.json", 2048), 2048).count() == 0
    assert bpe.encode(empty, "byte_bpe_50k.json").count() == 0
