"""Substring dedup on a compacted de Bruijn graph of word windows.

A node is size - 1 words, an edge the window of `size` words from one node to the next, and documents are walks.
Nodes are dealt by minimizer, the least hash of their runs of `seed` words: neighbours mostly share it, so a
stretch of a walk travels as one row, and equal edges always meet. There edges are counted; each repeated edge
gets source coordinates, its least occurrence, and repeated edges that always follow each other become chains.
Chains join at their end nodes: where one chain enters and one leaves (degrees by aggregation), the two are one
path. Every occurrence of a path, or of a part of one, is then verified: the words at its source coordinates are
spelled out, brought to it and compared. Node hashes only propose; a disagreement stops the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, slices, stored, strings
from .words import BASE, hashes, mix, ranges, rolling, sliding_min, split

SIZE, SEED = 35, 6
#: Stretches of one minimizer that one task holds; those of a more frequent one go on as single edges, which
#: aggregation counts and a join of skewed keys brings back.
MOST = 100_000
_RUNS = "mkey long, c int, key long, id long, span long, end long, nodes binary"
_PIECES = "key long, id long, start int, n int, rkey long, rid long, rstart int, src long, dst long, edge long, c int"
#: How a copied stretch names its lead: key, whether there is an id, id, start.
_LEAD = np.dtype([("key", "<i8"), ("there", "<i8"), ("id", "<i8"), ("start", "<i8")])


def node_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """32 bits for each node; with its minimizer they name it."""
    return (rolling(h, size - 1) >> np.uint64(32)).astype(np.uint32)


def _copies(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows with these keys: a stable sorting order, each sorted row's group, and which sorted rows begin one."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new) - 1, new


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: for each row so many items of data."""
    bounds = np.concatenate([[0], np.cumsum(data.itemsize * counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])


def _by_group(f: Callable[[pa.RecordBatch], pa.RecordBatch], most: int | None = None, beyond: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None):
    """Streams a partition sorted by its first column: f gets whole groups of it, many at a time. A group that
    grows beyond `most` rows goes to `beyond` in parts instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = hot = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            held = None
            key = t.column(0).to_numpy()
            cut = int(np.searchsorted(key, hot, "right")) if hot is not None else 0
            if cut:
                yield beyond(t.slice(0, cut))
                t, key = t.slice(cut), key[cut:]
            if not t.num_rows:
                continue
            hot, whole = None, int(np.searchsorted(key, key[-1]))
            if whole:
                yield f(t.slice(0, whole))
            held = t.slice(whole)
            if most and held.num_rows > most:
                yield beyond(held)
                hot, held = key[-1], None
        if held is not None and held.num_rows:
            yield f(held)

    return run


def _stretches(rows: DataFrame, size: int, seed: int, salt: int) -> DataFrame:
    """Each document's walk cut where the minimizer of the edges' first nodes changes. span: first edge << 32 |
    edges; end: the minimizer of the last node; nodes: edges + 1 node hashes; c: how many equal stretches a slice
    of 8 MB has, sent once. The others have c 0, their lead's coordinates in place of nodes, and are dealt anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                words, off = split(strings(part.column(2)))
                h = hashes(words, salt)
                doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
                n = max(0, len(doc) - size + 1)
                least, node = sliding_min(rolling(h, seed), size - seed), node_hashes(h, size)
                place = np.flatnonzero(doc[:n] == doc[size - 1 :]) if n else np.empty(0, np.int64)
                d, m = doc[place], least[place]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (m[1:] != m[:-1])])) if len(place) else np.empty(0, np.int64)
                at, edges, d, m = place[first], np.diff(np.append(first, len(place))), d[first], m[first]
                start = at - off[d]
                end = least[at + edges]
                flat = ranges(at, edges + 1)
                steps = np.arange(len(flat)) - np.repeat(np.cumsum(edges + 1) - edges - 1, edges + 1)
                content = mix(node[flat].astype(np.uint64) << np.uint64(32) | steps.astype(np.uint64))
                content = np.add.reduceat(content, np.cumsum(edges + 1) - edges - 1) if len(at) else np.empty(0, np.uint64)
                order, group, new = _copies(m, content, edges)
                lead = order[new][group]  # of each sorted row
                c = np.zeros(len(at), np.int32)
                c[order[new]] = np.bincount(group) if len(at) else 0
                keys, ident = part.column(0).to_numpy(), part.column(1)
                there, value = ident.is_valid().to_numpy(zero_copy_only=False), ident.fill_null(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [_i64(m), pa.array(c), pa.array(keys[d]), ident.take(pa.array(d)), pa.array(start << 32 | edges), _i64(end), _binary(node[flat], edges + 1)],
                    ["mkey", "c", "key", "id", "span", "end", "nodes"],
                ).filter(pa.array(c > 0))
                copy, of = order[~new], lead[~new]
                told = np.zeros(len(copy), _LEAD)
                for name, x in (("key", keys[d[of]]), ("there", there[d[of]]), ("id", value[d[of]]), ("start", start[of])):
                    told[name] = x
                dealt = mix(keys[d[copy]].view(np.uint64) + start[copy].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [_i64(dealt), pa.array(np.zeros(len(copy), np.int32)), pa.array(keys[d[copy]]), ident.take(pa.array(d[copy])), pa.array(start[copy] << 32 | edges[copy]), _i64(np.zeros(len(copy), np.int64)), _binary(told, np.ones(len(copy), np.int64))],
                    ["mkey", "c", "key", "id", "span", "end", "nodes"],
                )

    return rows.select("key", "id", "text").mapInArrow(run, _RUNS)


class _Edges:
    """The edges of a batch of stretches, in order of document and place, and the copied stretches beside them."""

    def __init__(self, t: pa.RecordBatch):
        self.names = [f.split()[0] for f in _PIECES.split(", ")]
        c, key, span = (t.column(k).to_numpy() for k in (1, 2, 4))
        ident = t.column(3)
        there, value = ident.is_valid().to_numpy(zero_copy_only=False), ident.fill_null(0).to_numpy()
        start, n = span >> 32, span & 0xFFFFFFFF
        lead = np.flatnonzero(c > 0)
        lead = lead[np.lexsort((start[lead], value[lead], there[lead], key[lead]))]
        copy = np.flatnonzero(c == 0)
        told = np.frombuffer(b"".join(t.column(6).take(pa.array(copy)).to_pylist()), _LEAD)
        none = pa.nulls(len(copy), pa.int64())
        self.copies = pa.RecordBatch.from_arrays(
            [pa.array(key[copy]), ident.take(pa.array(copy)), pa.array(start[copy], pa.int32()), pa.array(n[copy], pa.int32()), pa.array(told["key"]), pa.array(told["id"], mask=told["there"] == 0), pa.array(told["start"], pa.int32()), none, none, none, pa.nulls(len(copy), pa.int32())],
            self.names,
        )
        own = n[lead]
        nodes = np.frombuffer(b"".join(t.column(6).take(pa.array(lead)).to_pylist()), np.uint32).astype(np.uint64)
        self.row = np.repeat(np.arange(len(lead)), own)
        self.step = np.arange(len(self.row)) - np.repeat(np.cumsum(own) - own, own)
        at = (np.cumsum(own + 1) - own - 1)[self.row] + self.step
        self.v, self.w = nodes[at], nodes[at + 1]
        m, end = (t.column(k).to_numpy().view(np.uint64)[lead][self.row] for k in (0, 5))
        self.m, self.c = m, c[lead][self.row]
        self.key, self.start = key[lead][self.row], start[lead][self.row] + self.step
        self.ident, self.last = ident.take(pa.array(lead)), self.step + 1 == own[self.row]
        name = lambda low, node: mix(low ^ (node + np.uint64(1)) * np.uint64(BASE))
        self.src, self.dst = name(m, self.v), name(np.where(self.last, end, m), self.w)
        self.edge = self.v << np.uint64(32) | self.w

    def ids(self, at: np.ndarray) -> pa.Array:
        return self.ident.take(pa.array(self.row[at]))


def _chained(t: pa.RecordBatch) -> pa.RecordBatch:
    """The chains of the repeated edges of whole minimizers: one row for each occurrence, with its source's
    coordinates; the source's own row has the chain's end nodes. Two edges are in one chain if every occurrence
    of each has the other beside it, so a chain occurs whole wherever it occurs."""
    x = _Edges(t)
    order, group, new = _copies(x.m, x.edge)
    if not len(order):
        return x.copies
    g = np.empty(len(order), np.int64)
    g[order] = group
    source = order[new]  # the least occurrence of each edge, by document and place
    hit = np.bincount(group, x.c[order])[g] > 1
    inside = np.zeros(len(g), bool)  # follows a repeated edge of its stretch
    inside[1:] = (x.row[1:] == x.row[:-1]) & hit[1:] & hit[:-1]
    before, after = np.full(len(g), -1), np.full(len(g), -1)
    before[1:][inside[1:]] = g[:-1][inside[1:]]
    after[:-1][inside[1:]] = g[1:][inside[1:]]
    agree = [np.bincount(g, y != y[source][g]) == 0 for y in (before, after)]
    joined = inside & agree[0][g]
    joined[1:] &= agree[1][g[:-1]]
    at = np.flatnonzero(hit)
    head = np.flatnonzero(~joined[at])
    first, n = at[head], np.diff(np.append(head, len(at)))
    of, last = source[g[first]], first + n - 1
    other = of != first
    made = pa.RecordBatch.from_arrays(
        [pa.array(x.key[first]), x.ids(first), pa.array(x.start[first], pa.int32()), pa.array(n, pa.int32()), pa.array(x.key[of]), x.ids(of), pa.array(x.start[of], pa.int32()), pa.array(x.src[first].view(np.int64), mask=other), pa.array(x.dst[last].view(np.int64), mask=other), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int32())],
        x.names,
    )
    return pa.Table.from_batches([made, x.copies]).combine_chunks().to_batches(max_chunksize=1 << 30)[0] if len(n) else x.copies


def _single(t: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of a minimizer that is too frequent for one place: one for each edge."""
    x = _Edges(t)
    n = len(x.row)
    none = pa.nulls(n, pa.int64())
    made = pa.RecordBatch.from_arrays(
        [pa.array(x.key), x.ids(np.arange(n)), pa.array(x.start, pa.int32()), pa.array(np.ones(n), pa.int32()), none, none, pa.nulls(n, pa.int32()), _i64(x.src), _i64(x.dst), _i64(mix(x.m ^ mix(x.edge))), pa.array(x.c, pa.int32())],
        x.names,
    )
    return pa.Table.from_batches([made, x.copies]).combine_chunks().to_batches(max_chunksize=1 << 30)[0]


def chains(rows: DataFrame, size: int = SIZE, seed: int = SEED, salt: int = 1, most: int = MOST) -> DataFrame:
    """rows: key, id, text. key, id, start, n (edges), rkey, rid, rstart (the source's coordinates), src and dst
    (nodes, at the source only): every occurrence of every chain of repeated edges. Copies inside a slice name
    their lead as source and have no nodes."""
    x = _stretches(rows, size, seed, salt).repartition("mkey").sortWithinPartitions("mkey").mapInArrow(_by_group(_chained, most, _single), _PIECES)
    x = stored(x, "chains", "zstd")
    single = x.where("edge IS NOT NULL")
    source = single.groupBy("edge").agg(F.sum("c").alias("total"), F.min(F.struct("key", "id", "start")).alias("r")).where("total > 1")
    own = (F.col("key") == F.col("r.key")) & F.col("id").eqNullSafe(F.col("r.id")) & (F.col("start") == F.col("r.start"))
    found = single.drop("rkey", "rid", "rstart").join(source, "edge")
    found = found.select("key", "id", "start", "n", F.col("r.key").alias("rkey"), F.col("r.id").alias("rid"), F.col("r.start").alias("rstart"), *(F.when(own, F.col(c)).alias(c) for c in ("src", "dst")))
    return x.where("edge IS NULL").drop("edge", "c").unionByName(found)


def compacted(made: DataFrame) -> DataFrame:
    """chains() to paths: key, id, start of each source chain, and head, the start of its path. A node with one
    chain in and one out, in a row in the source document, is inside a path; every other node ends one."""
    own = made.where("src IS NOT NULL").select("key", "id", "start", "n", "src", "dst").dropDuplicates(["key", "id", "start"])
    ends = own.select(F.col("dst").alias("node"), F.lit(1).alias("enter"), F.lit(0).alias("leave"))
    ends = ends.unionByName(own.select(F.col("src").alias("node"), F.lit(0).alias("enter"), F.lit(1).alias("leave")))
    inner = ends.groupBy("node").agg(F.sum("enter").alias("enter"), F.sum("leave").alias("leave")).where("enter = 1 AND leave = 1").select("node")
    entering = own.select(F.col("dst").alias("node"), F.col("key").alias("__k"), F.col("id").alias("__i"), (F.col("start") + F.col("n")).alias("next")).join(inner, "node")
    x = own.join(entering, own["src"] == entering["node"], "left")
    linked = (F.col("key") == F.col("__k")) & F.col("id").eqNullSafe(F.col("__i")) & (F.col("start") == F.col("next"))
    x = x.select("key", "id", "start", F.when(~F.coalesce(linked, F.lit(False)), F.col("start")).alias("begins"))
    w = Window.partitionBy("key", "id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("key", "id", "start", F.last("begins", True).over(w).alias("head"))


def occurrences(made: DataFrame) -> DataFrame:
    """key, id, start, n, rkey, rid, rstart: the occurrences of paths, or of the parts of them that a document
    has, each a row of chains that follow each other in the document and in the source."""
    path = compacted(made).select(F.col("key").alias("rkey"), F.col("id").alias("__i"), F.col("start").alias("rstart"), "head")
    x = made.join(path, (made["rkey"] == path["rkey"]) & made["rid"].eqNullSafe(path["__i"]) & (made["rstart"] == path["rstart"]), "left")
    x = x.select("key", "id", "start", "n", made["rkey"], "rid", made["rstart"], F.coalesce("head", F.lit(-1)).alias("head"), (F.col("start") - made["rstart"]).alias("shift"))
    by = ["key", "id", "rkey", "rid", "head", "shift"]
    w = Window.partitionBy(*by).orderBy("start")
    fresh = F.coalesce(F.col("start") > F.max(F.col("start") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    x = x.withColumn("fresh", fresh).withColumn("part", F.sum(F.col("fresh").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy(*by, "part").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("until"), F.min("rstart").alias("rstart"))
    return x.select("key", "id", "start", (F.col("until") - F.col("start")).alias("n"), "rkey", "rid", "rstart")


def _packed(rows: DataFrame) -> DataFrame:
    """rows with text as zstd, a smaller load for the shuffle that brings texts and spans together."""
    import zstandard

    names = rows.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, place):
                cols = list(part.columns)
                cols[place] = pa.array([c.compress(x) for x in part.column(place).cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'text' else k}" for c, k in rows.dtypes))


def _texts(column: pa.Array) -> pa.Array:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return pa.array([d.decompress(x) for x in column.to_pylist()], pa.binary()).cast(pa.string())


def _keyed(docs: DataFrame, id_col: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    ident = docs[id_col].cast("long")
    return docs.select(F.xxhash64(ident, body).alias("key"), ident.alias("id"), body.alias("text"), *(docs[c].alias(f"c_{k}") for k, c in enumerate(carry)))


def _meet(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    b = b.withColumnRenamed("key", "__k").withColumnRenamed("id", "__i")
    return a.join(b, (a["key"] == b["__k"]) & a["id"].eqNullSafe(b["__i"]), how).drop("__k", "__i")


def _flat(lists: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """A column of lists of structs: the row of each struct, and its fields. Null lists are empty."""
    n = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), n), lists.flatten().flatten()


def _joined(words: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """words[a:b] joined by one space, for each pair."""
    flat = words.take(pa.array(ranges(a, b - a)))
    return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(b - a)]), pa.int32()), flat), " ")


def _spelled(packed: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """asked: key, id and spans (start, n) of sources. key, id, start, n and words, joined by one space."""
    x = _meet(packed, asked, "inner")
    last = len(x.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                words, off = split(_texts(part.column(2)))
                row, (start, n) = _flat(part.column(last))
                a = off[row] + start.to_numpy()
                b = a + n.to_numpy() + size - 1
                for at in range(0, len(row), 20_000):
                    some = slice(at, at + 20_000)
                    pick = pa.array(row[some])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), start[some], n[some], _joined(words, a[some], b[some])], ["key", "id", "start", "n", "words"])

    return x.mapInArrow(run, "key long, id long, start int, n int, words string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, seed: int = SEED, carry: tuple[str, ...] = (), salt: int = 1, most: int = MOST) -> DataFrame:
    """One row for each row of docs: its id, the carried columns, text (null: empty), n_words, n_removed and
    kept_text, the words that no repeated window covers, joined by one space. Rows that repeat are documents
    like others, so their windows repeat; null ids are allowed; an empty table gives no rows. Where the words at
    two places with equal hashes differ the job fails and names the remedy, another salt; nothing wrong is removed."""
    rows = _keyed(docs, id_col, text, carry)
    found = stored(occurrences(chains(rows, size, seed, salt, most)), "spans", "zstd")
    packed = _packed(rows)
    other = ~((F.col("key") == F.col("rkey")) & F.col("id").eqNullSafe(F.col("rid")) & (F.col("start") == F.col("rstart")))
    asked = found.where(other).groupBy(F.col("rkey").alias("key"), F.col("rid").alias("id")).agg(F.collect_set(F.struct(F.col("rstart").alias("start"), "n")).alias("spans"))
    words = _spelled(packed, asked, size).toDF("__k", "__i", "__s", "__n", "words")
    here = other & (F.col("rkey") == F.col("__k")) & F.col("rid").eqNullSafe(F.col("__i")) & (F.col("rstart") == F.col("__s")) & (F.col("n") == F.col("__n"))
    told = found.join(words, here, "left").select("key", "id", "start", "n", other.alias("other"), "words")
    spans = told.groupBy("key", "id").agg(F.collect_list(F.struct("start", "n", "other", "words")).alias("spans"))
    x = _meet(packed, spans, "left")
    last, kept = len(x.columns) - 1, [c for c in x.columns if c.startswith("c_")]
    kinds = ", ".join(f"{c} {k}" for c, k in x.select(kept).dtypes)
    names = ["id", *kept, "text", "n_words", "n_removed", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                texts = _texts(part.column(2))
                words, off = split(texts)
                row, (start, n, other, want) = _flat(part.column(last))
                a, b = off[row] + start.to_numpy(), off[row] + start.to_numpy() + n.to_numpy() + size - 1
                ask = np.flatnonzero(other.to_numpy(zero_copy_only=False))
                if (b > off[row + 1]).any() or not pa.compute.all(pa.compute.fill_null(pa.compute.equal(_joined(words, a[ask], b[ask]), want.take(pa.array(ask))), False), min_count=0).as_py():
                    raise ValueError("windows with different words have equal hashes; give another salt")
                edge = np.bincount(a, minlength=len(words) + 1) - np.bincount(b, minlength=len(words) + 1)
                keep = np.cumsum(edge)[:-1] == 0
                places = np.concatenate([[0], np.cumsum(keep)])[off]
                lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), words.filter(pa.array(keep)))
                n = np.diff(off)
                yield pa.RecordBatch.from_arrays([*part.columns[1:2], *part.columns[3:last], texts, pa.array(n), pa.array(n - np.diff(places)), pa.compute.binary_join(lists, " ")], names)

    made = x.mapInArrow(run, f"id long, {kinds + ', ' if kinds else ''}text string, n_words long, n_removed long, kept_text string")
    return made.select(F.col("id").alias(id_col), *(F.col(c).alias(name) for c, name in zip(kept, carry)), "text", "n_words", "n_removed", "kept_text")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = remove_repeats(documents(spark, sf_dir))
    return x.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') END AS words FROM documents),
g AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 33, 1))) AS pos FROM w),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY sha256(array_to_string(list_slice(words, pos, pos + 34), ' '))) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM r WHERE n > 1),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
k AS (SELECT p.doc_id, count(c.pos) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE c.pos IS NULL) AS kept FROM p LEFT JOIN c USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
