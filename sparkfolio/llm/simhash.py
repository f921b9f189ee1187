"""SimHash near-dedup by bit-sliced comparison.

Fingerprints within `radius` bits share at least two of four 16-bit blocks if radius is 2, so those that
may link meet in a bucket keyed by two whole blocks. In a bucket bit planes are stored vertically: one
machine word holds the same bit of 64 fingerprints, an XOR compares 64 at once, carry-save adders count the
differing bits in a few words, and blocks whose lanes have all passed the radius are abandoned. A bucket
hands on a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, stored
from .components import components
from .substring import _by_group
from .words import ranges

#: Fingerprints of a bucket that are compared in one place; larger buckets are dealt as pairs of tiles.
TILE = 32_768
#: Bits of a set's sketch: each differing bit of two sketches is a hash that only one of the sets holds.
SKETCH = 2048
#: Bytes of a candidate group's texts that are checked in one place. Of a larger group the sketches are compared first, so
#: many bytes of them in one place; what stays together and is still larger is dealt as pairs of tiles.
GROUP_BYTES, SKETCH_BYTES = 4 << 20, 2 << 20
#: Radius for texts of similarity 0.8, where 10 bits differ and 22 are four standard deviations more.
WIDE = 22
#: Shingles that OFTEN of one in SAMPLE texts hold come last in prefixes, the most frequent MOST_COMMON of them.
SAMPLE, OFTEN, MOST_COMMON = 16, 4, 100_000
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included: XXH64 with seed 42. A shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included."""
    return majority(shingles(text, shingle)) if text.split() else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, *carry: str) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a long) and carried longs for each row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                fp = np.array([fingerprint(x or b"", shingle) for x in part.column(1).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), *part.columns[2:]], ["id", "fp", *carry])

    asked = docs.select(docs[id_col].cast("long").alias("id"), docs[text].cast("string").alias("text"), *carry)
    return asked.mapInArrow(run, ", ".join(f"{c} long" for c in ("id", "fp", *carry)))


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is greater than radius."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], _ONES)
    for j in range(len(counters) - 1, -1, -1):
        if radius >> j & 1:
            same &= counters[j]
        else:
            more |= same & counters[j]
            same &= ~counters[j]
    return more


def near(planes: np.ndarray, masks: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """planes, masks: 64 x rows x words, a mask all ones where the row's query has the bit. Returns, rows x
    words, the valid lanes within radius of their row's query."""
    out, alive = np.zeros_like(valid), np.arange(len(valid))
    counters = [np.zeros_like(valid) for _ in range(max(1, (radius + 1).bit_length()))]
    far = ~valid
    for b in range(64):
        carry = planes[b] ^ masks[b]
        for j in range(len(counters)):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        far = far | carry
        if b % 8 == 7 and b < 63:
            keep = np.flatnonzero(((far | _over(counters, radius)) != _ONES).any(axis=1))
            if not len(keep):
                return out
            if 2 * len(keep) < len(alive):
                alive, far, counters = alive[keep], far[keep], [c[keep] for c in counters]
                planes = planes[:, keep] if planes.shape[1] > 1 else planes
                masks = masks[:, keep]
    out[alive] = ~(far | _over(counters, radius))
    return out


def _planes(rows: np.ndarray) -> np.ndarray:
    """rows x lanes of fingerprints, lanes a multiple of 64, to 64 planes x rows x words."""
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(*rows.shape, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)


def _small(rows: np.ndarray, size: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Forest edges inside many buckets of at most 64 fingerprints; rows: buckets x 64, filled with zeros."""
    planes, most = _planes(rows), int(size.max())
    valid = (_ONES >> (64 - size).astype(np.uint64)).reshape(-1, 1)
    reach = []
    for k in range(most):
        masks = (np.uint64(0) - (planes >> np.uint64(k) & np.uint64(1))).astype(np.uint64)
        reach.append(np.where(size > k, near(planes, masks, valid, radius)[:, 0], np.uint64(0)))
    for k in range(most):
        for j in range(most):
            reach[j] = reach[j] | reach[k] & (np.uint64(0) - (reach[j] >> np.uint64(k) & np.uint64(1)))
    out = []
    for j in range(1, most):
        low = np.bitwise_count((reach[j] & (np.uint64(0) - reach[j])) - np.uint64(1)).astype(np.int64)  # the lowest lane reached
        at = np.flatnonzero((size > j) & (low < j))
        out.append((rows[at, j], rows[at, low[at]]))
    return out


def _large(fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Forest edges inside one bucket, breadth first from its least fingerprint: only those not yet reached are
    compared, so one that links to nearly all leaves little to do. Equal groups in many buckets give equal edges."""
    left, out = np.sort(fp), []
    while len(left):
        seed, left = left[0], left[1:]
        front, at = left[:0], 0
        queue = [np.array([seed])]
        while queue and len(left):
            front = queue.pop(0)
            for at in range(0, len(front), 256):
                q = front[at : at + 256]
                lanes = np.zeros((1, -(-len(left) // 64) * 64), np.uint64)
                lanes[0, : len(left)] = left
                valid = np.packbits(np.arange(lanes.shape[1]) < len(left), bitorder="little").view(np.uint64)
                masks = np.uint64(0) - (q[None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1))
                links = near(_planes(lanes), masks[:, :, None], np.broadcast_to(valid, (len(q), len(valid))).copy(), radius)
                got = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(links, axis=0).view(np.uint8), bitorder="little"))
                if len(got):
                    out.append((left[got], np.full(len(got), seed)))
                    queue.append(left[got])
                    left = np.delete(left, got)
                if not len(left):
                    break
    return out


def _bucket_edges(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """key: sorted, whole buckets only."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    out = []
    for low, high in ((2, 4), (5, 16), (17, 64)):
        some = np.flatnonzero((size >= low) & (size <= high))
        for at in range(0, len(some), 2048):
            s = some[at : at + 2048]
            rows = np.zeros((len(s), 64), np.uint64)
            n = size[s]
            row = np.repeat(np.arange(len(s)), n)
            lane = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            rows[row, lane] = fp[start[s][row] + lane]
            out += _small(rows, n, radius)
    for k in np.flatnonzero(size > 64):
        out += _large(fp[start[k] : start[k] + size[k]], radius)
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def links(fps: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """fps: one column of distinct fingerprints, fp. Returns a, b: in every bucket a spanning forest of the
    links, so their transitive closure is that of all pairs within radius. Radius 2 at most."""
    if radius > 2:
        raise ValueError("two equal blocks of four are sure up to radius 2 only")
    pairs = list(combinations(range(4), 2))
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.lit(k << 32).cast("long") + F.shiftleft(block[i], 16) + block[j] for k, (i, j) in enumerate(pairs)]
    return bucket_links(fps.select("fp", F.explode(F.array(*keys)).alias("key")), radius, tile)


def _compared(rows: DataFrame, radius: int, most: int | None = None) -> DataFrame:
    """rows: bucket, fp. a, b: a forest of each bucket's links, bucket null. The rows of a bucket of over `most` come
    back as they are instead: a their fp, b null, and their bucket."""
    names = ["a", "b", "bucket"]

    def links_(t: pa.RecordBatch) -> pa.RecordBatch:
        a, b = _bucket_edges(t.column(0).to_numpy(), t.column(1).to_numpy().view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], names)

    def whole(t: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([t.column(1), pa.nulls(t.num_rows, pa.int64()), t.column(0)], names)

    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_by_group(links_, most, whole), "a long, b long, bucket long")


def bucket_links(rows: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """rows: fp, key. Returns a, b: for each key a spanning forest of the links among its fingerprints. One shuffle;
    only the rows of keys with over `tile` of them go through another, dealt as pairs of tiles."""
    x = stored(_compared(rows.select(F.col("key").alias("bucket"), "fp"), radius, tile), "links")
    big = x.where("bucket IS NOT NULL").select(F.col("bucket").alias("key"), F.col("a").alias("fp"))
    size = big.groupBy("key").agg(F.count("*").alias("n"))
    split = big.join(size, "key").withColumn("tiles", F.ceil(F.col("n") * 2 / tile).cast("long")).withColumn("own", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("tiles")))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiles = split.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp")
    return x.where("bucket IS NULL").select("a", "b").unionByName(_compared(tiles, radius).select("a", "b"))


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    ident = docs[id_col].cast("long")
    return docs.select(ident.alias("id"), F.xxhash64(ident, body).alias("key"), body.alias("text"))


def _grouped(docs: DataFrame, id_col: str, text: str, shingle: int, radius: int) -> DataFrame:
    """id, key (of id and text), fp, root (the component) and component_id for each row."""
    rows = _keyed(docs, id_col, text)
    fp = stored(fingerprints(rows, "id", "text", shingle, "key"), "fingerprints")
    nodes = fp.groupBy("fp").agg(F.min("id").alias("least"))
    root = components(links(nodes.select("fp"), radius))
    named = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fp.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of docs: its id, fp and component_id, the smallest id of the rows that it reaches
    over links of at most radius bits, its own included. Equal fingerprints are one node, so copies cost one
    row. Null ids stay null and count as the largest; repeated rows each get their row; an empty table gives none."""
    return _grouped(docs, id_col, text, shingle, radius).select(F.col("id").alias(id_col), "fp", "component_id")


def _without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, id_col: str, text: str) -> DataFrame:
    """docs without the rows named in gone (id, key), and one row only of those in repeated (id, key), whose id and
    text come more than once."""
    ident = docs[id_col].cast("long")
    key = F.xxhash64(ident, F.coalesce(docs[text].cast("string"), F.lit("")))

    def named(df: DataFrame):
        x = df.select(F.col("id").alias("__i"), F.col("key").alias("__k"))
        return x, (key == F.col("__k")) & ident.eqNullSafe(F.col("__i"))

    left = docs.join(*named(gone), "left_anti")
    again = left.join(*named(repeated), "left_semi").dropDuplicates([id_col, text])
    return left.join(*named(repeated), "left_anti").unionByName(again)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs with exactly one row of each near-duplicate group: the one with the smallest id, null ids last; of
    several rows with that id the one whose id and text hash lowest, and one of those that are equal in both."""
    x = stored(_grouped(docs, id_col, text, shingle, radius).select("id", "key", "root"), "grouped")
    best = x.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
    gone = x.join(best, "root").where(~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))))
    repeated = x.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1")
    return _without(docs, gone.select("id", "key").distinct(), repeated, id_col, text)


def common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """Shingles, sorted, that one in SAMPLE texts hold OFTEN or more, at most MOST_COMMON. They only order a
    prefix, which is right with any set of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                each = [np.unique(shingles(x, shingle)) for x in part.column(0).cast(pa.binary()).to_pylist()]
                hashes, n = np.unique(np.concatenate(each), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["gram", "n"])

    some = texts.where(F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(np.array([r["gram"] for r in counts.orderBy(F.desc("n"), "gram").limit(MOST_COMMON).collect()], np.int64).view(np.uint64))


def _sketches(rows: DataFrame, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """id, key, fp, the SimHash of the distinct shingles, bytes of the text, and prefix, the hashes of which two texts of
    that similarity share one at least: all but as many as they have to share, less one, common shingles last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                fp, prefix = [], []
                for x in part.column(2).cast(pa.binary()).to_pylist():
                    h = np.unique(shingles(x, shingle))
                    last = np.isin(h, common, assume_unique=True) if len(common) else np.zeros(len(h), bool)
                    most = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
                    fp.append(majority(h))
                    prefix.append(np.concatenate([h[~last], h[last]])[:most].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(prefix, pa.binary()), part.column(3)], ["id", "key", "fp", "prefix", "bytes"])

    return rows.select("id", "key", "text", F.octet_length("text").cast("long").alias("bytes")).mapInArrow(run, "id long, key long, fp long, prefix binary, bytes long")


def _prefix_rows(sketches: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                each = [len(x) // 8 for x in part.column(1).to_pylist()]
                fp = np.repeat(part.column(0).to_numpy(), each)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64))], ["fp", "key"])

    return sketches.select("fp", "prefix").mapInArrow(run, "fp long, key long")


def _reached(size: np.ndarray, sketch: np.ndarray, fp: np.ndarray, similarity: float, radius: int, check: Callable[[int, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The first set that each reaches over links. Linked are those that sizes, sketches and fingerprints don't tell apart
    and, of these, the ones that check(set, others) leaves."""
    group = np.full(len(size), -1)
    for seed in range(len(size)):
        if group[seed] >= 0:
            continue
        group[seed], front = seed, [seed]
        while front:
            x = front.pop()
            near_ = (group < 0) & (np.bitwise_count(fp ^ fp[x]) <= radius)
            rest = np.flatnonzero(near_ & (np.minimum(size, size[x]) >= similarity * np.maximum(size, size[x]) - 1e-9))
            differ = np.bitwise_count(sketch[rest] ^ sketch[x]).sum(axis=1, dtype=np.int64)
            # similar sets hold no more hashes apart than this
            rest = rest[differ <= (1 - similarity) / (1 + similarity) * (size[rest] + size[x]) + 1e-9]
            found = check(x, rest) if check and len(rest) else rest
            group[found] = seed
            front += found.tolist()
    return group


def similar(sets: list[np.ndarray], fp: np.ndarray, similarity: float, radius: int) -> np.ndarray:
    """For sets of sorted distinct hashes, none empty: the first set that each reaches over links. A link is a
    Jaccard similarity of at least `similarity` and fingerprints within radius."""
    size = np.array([len(x) for x in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin, mark = np.cumsum(size) - size, np.zeros(len(values), bool)
    bits = np.zeros((len(sets), SKETCH), bool)
    bits[np.repeat(np.arange(len(sets)), size), np.concatenate(sets) % np.uint64(SKETCH)] = True
    sketch = np.packbits(bits, axis=1).view(np.uint64)
    del values, bits

    def check(x: int, rest: np.ndarray) -> np.ndarray:
        own = code[begin[x] : begin[x] + size[x]]
        mark[own] = True
        n = size[rest]
        both = np.add.reduceat(mark[code[ranges(begin[rest], n)]], np.cumsum(n) - n, dtype=np.int64)
        mark[own] = False
        return rest[both >= similarity * (n + size[x] - both) - 1e-9]

    return _reached(size, sketch, fp, similarity, radius, check)


def graded(hashes: np.ndarray, similarity: float) -> list[tuple[int, bytes]]:
    """Sketches of a set with a bit for each of its hashes at least, a power of two and SKETCH or more, so that long texts
    tell apart too; with a number for the length. A set that may be similar to one with half as many bits has that sketch
    as well, so any two similar sets have sketches of one length."""
    n = max(SKETCH, 1 << (len(hashes) - 1).bit_length())
    bits = np.zeros(n, bool)
    bits[hashes % np.uint64(n)] = True
    out = [(n, np.packbits(bits).tobytes())]
    if n > SKETCH and similarity * len(hashes) <= n // 2 + 1e-9:
        out.append((n // 2, np.packbits(bits.reshape(2, -1).any(axis=0)).tobytes()))
    return out


def _hashed(texts: DataFrame, shingle: int, similarity: float | None) -> DataFrame:
    """texts: root, key, fp, text. In place of text its number of distinct shingles, size, and data, these or, for a similarity,
    sketches of them, a row for each grade."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                sets = [np.unique(shingles(x, shingle)) for x in part.column(3).cast(pa.binary()).to_pylist()]
                made = [graded(x, similarity) if similarity else [(0, x.tobytes())] for x in sets]
                row = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in made]))
                grade, data = zip(*(y for x in made for y in x))
                own = [c.take(row) for c in (*part.columns[:3], pa.array([len(x) for x in sets], pa.int64()))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(grade, pa.int64()), pa.array(data, pa.binary())], ["root", "key", "fp", "size", "grade", "data"])

    return texts.select("root", "key", "fp", "text").mapInArrow(run, "root long, key long, fp long, size long, grade long, data binary")


def _met(hashed: DataFrame, similarity: float, radius: int, limit: int) -> DataFrame:
    """hashed: as of _hashed(). node and root over the links among rows of one root, by sketches alone (grade over 0) or by the
    sets; a node is a key. Of a root and grade with more bytes than limit every two tiles meet in a place of their own."""

    def edges(t: pa.RecordBatch) -> pa.RecordBatch:
        bucket, key, fp, size, grade = (t.column(k).to_numpy() for k in range(5))
        a, b = [key[:0]], [key[:0]]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
        for i, j in zip(cuts, cuts[1:]):
            data = [np.frombuffer(x, np.uint64) for x in t.column(5).slice(i, j - i).to_pylist()]
            own = fp[i:j].view(np.uint64)
            group = _reached(size[i:j], np.stack(data), own, similarity, radius) if grade[i] else similar(data, own, similarity, radius)
            a.append(key[i:j])
            b.append(key[i + group])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    x = stored(hashed, "hashed")
    tiles = F.when(F.sum(F.octet_length("data")) > limit, F.ceil(F.sum(F.octet_length("data")) * 2 / limit)).otherwise(1).cast("long")
    x = x.join(x.groupBy("root", "grade").agg(tiles.alias("tiles")), ["root", "grade"]).withColumn("own", F.pmod(F.xxhash64(F.lit(7), "key"), F.col("tiles")))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    x = x.select(F.xxhash64("root", "grade", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "key", "fp", "size", "grade", "data")
    x = x.repartition("bucket").sortWithinPartitions("bucket", "grade").mapInArrow(_by_group(edges), "a long, b long")
    return components(stored(x, "met"))


def _totals(rows: DataFrame) -> DataFrame:
    """rows (root, id, key, fp, bytes) of roots with two rows or more, with the root's rows n and bytes total."""
    return rows.join(rows.groupBy("root").agg(F.count("*").alias("n"), F.sum("bytes").alias("total")).where("n > 1"), "root")


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = WIDE, most: int | None = None, sketches: int | None = None
) -> DataFrame:
    """One row for each row of docs that may have a near copy: id, key (of id and text), component_id, the smallest
    id that it reaches over links, and stays, true where id and key are the least of its component. A link is a Jaccard similarity of the distinct shingles (by their 64-bit
    hashes) of at least `similarity` between texts whose SimHashes are within radius. Texts as similar share a
    shingle of their prefixes, so those meet in buckets, of any size, where fingerprints are compared bit-sliced;
    the groups that come of it are checked shingle by shingle, each in one place. A group with over `most` bytes of texts
    (GROUP_BYTES) is parted before, by links that sketches allow, of which `sketches` bytes (SKETCH_BYTES) meet in one place; if
    a part is still larger, every two of its tiles are checked in a place of their own. Null ids count as the largest."""
    most, sketches = most or GROUP_BYTES, sketches or SKETCH_BYTES
    rows = _keyed(docs, id_col, text)
    x = stored(_sketches(rows, shingle, similarity, common_shingles(rows, shingle)), "sketches")
    root = components(bucket_links(_prefix_rows(x), radius))
    near_ = x.select("id", "key", "fp", "bytes").join(root, x["fp"] == root["node"], "left").select("id", "key", "fp", "bytes", F.coalesce("root", "fp").alias("root"))
    near_ = _totals(stored(near_, "roots"))

    def texts(asked: DataFrame) -> DataFrame:
        asked = asked.select("root", "fp", F.col("id").alias("__i"), F.col("key").alias("__k")).distinct()
        return rows.join(asked, (rows["key"] == asked["__k"]) & rows["id"].eqNullSafe(asked["__i"])).select("root", "id", "key", "fp", "text")

    def made(t: pa.RecordBatch) -> pa.RecordBatch:
        root, fp = t.column(0).to_numpy(), t.column(3).to_numpy().view(np.uint64)
        top = np.iinfo(np.int64).max
        ident, key = t.column(1).fill_null(top).to_numpy(), t.column(2).to_numpy()
        out, stays = np.full(len(root), top), np.zeros(len(root), bool)
        cuts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1], [True]])).tolist()
        for a, b in zip(cuts, cuts[1:]):
            sets = [np.unique(shingles(v or b"", shingle)) for v in t.column(4).slice(a, b - a).cast(pa.binary()).to_pylist()]
            group = similar(sets, fp[a:b], similarity, radius)
            order = np.lexsort((key[a:b], ident[a:b]))
            least = np.full(b - a, -1)
            least[group[order[::-1]]] = order[::-1]  # the last one written is the first in order
            of = a + least[group]
            out[a:b] = ident[of]
            stays[a:b] = (ident[a:b] == ident[of]) & (key[a:b] == key[of])
        return pa.RecordBatch.from_arrays([t.column(1), t.column(2), pa.array(out, mask=out == top), pa.array(stays)], ["id", "key", "component_id", "stays"])

    def checked(asked: DataFrame) -> DataFrame:
        return texts(asked).repartition("root").sortWithinPartitions("root").mapInArrow(_by_group(made), "id long, key long, component_id long, stays boolean")

    def parted(large: DataFrame, similarity_: float | None, limit: int, what: str) -> DataFrame:
        met = _met(_hashed(texts(large), shingle, similarity_), similarity, radius, limit)
        x = large.select("id", "key", "fp", "bytes").join(met, F.col("key") == F.col("node"), "left")
        return stored(x.select("id", "key", "fp", "bytes", F.coalesce("root", "key").alias("root")), what)

    small, large = near_.where(F.col("total") <= most), near_.where(F.col("total") > most)
    if large.isEmpty():
        return checked(small)
    parts = _totals(parted(large, similarity, sketches, "parts"))
    small, large = small.unionByName(parts.where(F.col("total") <= most)), parts.where(F.col("total") > most)
    if large.isEmpty():
        return checked(small)
    whole = parted(large, None, most, "whole")
    best = whole.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))
    return checked(small).unionByName(whole.join(best, "root").select("id", "key", F.col("best.id").alias("component_id"), stays.alias("stays")))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = WIDE) -> DataFrame:
    """docs with exactly one row of each group of similar_groups(): the one with the smallest id, null ids last; of
    several rows with that id the one whose id and text hash lowest, and one of those that are equal in both."""
    x = stored(similar_groups(docs, id_col, text, shingle, similarity, radius), "similar")
    repeated = x.where("stays").groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1")
    return _without(docs, x.where("NOT stays").select("id", "key").distinct(), repeated, id_col, text)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = near_groups(documents(spark, sf_dir))
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
