"""Token-ID output as length-delimited binary records, with an offset index for shuffled reads.

A record: length (u64), masked checksum of those 8 bytes (u32), payload, masked checksum of the payload
(u32); all little-endian. A payload: id (i64), whether there is one (u8), bytes a token (u8: 2 or 4),
token ids. The checksum is CRC-32 (zlib's), rotated right by 15 bits plus a constant, so that checksums
stored inside checked data don't confuse it. An index file holds (offset u64, tokens u64, id i64) for
each record of its shard. Files go to any folder that pyarrow.fs or a mounted path can open.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, scratch_path, slices, stored, strings
from .tokens import encoder, tokenizer, vocabulary

#: Fixed value: the constant that masking adds.
MASK = 0xA282EAD8
SHARD_BYTES = 256 << 20
#: The layouts of a length, a checksum and a payload's head.
LEN, CRC, HEAD = "<Q", "<I", "<qBB"
INDEX = np.dtype([("offset", "<u8"), ("tokens", "<u8"), ("id", "<i8")])
_MANIFEST = "shard long, part long, path string, index_path string, n_records long, n_tokens long, n_bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack(LEN, len(payload))
    return b"".join((n, struct.pack(CRC, masked(n)), payload, struct.pack(CRC, masked(payload))))


def unframe(f) -> bytes | None:
    """The next payload of an open file, None at its end; damage raises."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack_from(CRC, head, 8)[0] != masked(head[:8]):
        raise ValueError("a record's length is damaged")
    size = struct.unpack_from(LEN, head)[0]
    body = f.read(size + 4)
    if len(body) < size + 4 or struct.unpack_from(CRC, body, size)[0] != masked(body[:size]):
        raise ValueError("a record's payload is damaged")
    return body[:size]


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    key, there, width = struct.unpack_from(HEAD, payload)
    return key if there else None, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD)).astype("<u4")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "file://" + path.removeprefix("file:"))


def write_records(docs: DataFrame, to: str, vocab: str, end_id: int | None = 1, id_col: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes every row's whole text, encoded, with end_id after it, in ascending order of id (nulls first,
    equal ids by text), and returns the manifest: one row a shard file. Null and empty texts give a record
    of end_id alone; an empty table writes no file. Texts are dealt by ranges of ids and each task writes
    its range under new names; only the manifest, stored once, says which files count, so a task that is
    lost or runs twice leaves files that nobody reads."""
    path = vocabulary(vocab)
    small = tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 and (end_id or 0) < 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, f = TaskContext.get().partitionId(), 0, None
        store, root = _filesystem(to)
        end = np.array([] if end_id is None else [end_id], "<u2" if small else "<u4")

        def begin():
            name = f"{root.rstrip('/')}/part-{shard:06d}-{part:04d}-{uuid.uuid4().hex}"
            store.create_dir(root, recursive=True)
            return store.open_output_stream(name + ".rec", buffer_size=1 << 20), name, [], 0

        def finish() -> pa.RecordBatch:
            f.close()
            rows = np.array(index, INDEX)
            with store.open_output_stream(name + ".idx") as g:
                g.write(rows.tobytes() + struct.pack(CRC, masked(rows.tobytes())))
            return pa.RecordBatch.from_pylist([dict(shard=shard, part=part, path=f"{to.rstrip('/')}/{name.rpartition('/')[2]}.rec", index_path=f"{to.rstrip('/')}/{name.rpartition('/')[2]}.idx", n_records=len(rows), n_tokens=int(rows["tokens"].sum()), n_bytes=at)], manifest)

        for batch in batches:
            for piece in slices(batch, 1):
                flat, offsets = encoder(path).encode(strings(piece.column(1)))
                flat = flat.astype(end.dtype)
                for key, a, b in zip(piece.column(0).to_pylist(), offsets, offsets[1:]):
                    if f is None:
                        f, name, index, at = begin()
                    record = frame(struct.pack(HEAD, key or 0, key is not None, end.itemsize) + flat[a:b].tobytes() + end.tobytes())
                    f.write(record)
                    index.append((at, b - a + len(end), key or 0))
                    at += len(record)
                    if at >= shard_bytes:
                        yield finish()
                        f, part = None, part + 1
        if f is not None:
            yield finish()

    manifest = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("path", pa.string()), ("index_path", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    # the second key, which orders as the text does, splits an id, or null, that many rows share
    rows = rows.repartitionByRange("id", F.substring("text", 1, 64)).sortWithinPartitions("id", "text")
    return stored(rows.mapInArrow(run, _MANIFEST), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """id, start (tokens of all records before it) and ids (little-endian u32) of every record, each file by
    one task, checksums verified."""
    n = max(1, min(manifest.count(), 100_000))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["id", "start", "ids"])

        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = _filesystem(path)
                keys, starts, ids, held = [], [], [], 0
                with store.open_input_stream(name, buffer_size=1 << 20) as f:
                    while (payload := unframe(f)) is not None:
                        key, x = parse(payload)
                        keys.append(key)
                        starts.append(at)
                        ids.append(x.tobytes())
                        at += len(x)
                        if (held := held + 4 * len(x)) > 4 << 20:
                            yield out()
                            keys, starts, ids, held = [], [], [], 0
                if keys:
                    yield out()

    return manifest.select("path", before.cast("long").alias("start")).repartition(n).mapInArrow(run, "id long, start long, ids binary")


def shuffled(manifest: DataFrame, seed: int, n_parts: int = 64) -> DataFrame:
    """id and ids (array of int) of every record in an order that seed fixes: the index is read and dealt
    by a hash of seed, shard and offset, and each record is fetched at its offset."""
    n = max(1, min(manifest.count(), 100_000))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, idx in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = _filesystem(idx)
                with store.open_input_stream(name) as f:
                    data = f.read()
                if struct.unpack_from(CRC, data, len(data) - 4)[0] != masked(data[:-4]):
                    raise ValueError(f"{idx} is damaged")
                rows = np.frombuffer(data[:-4], INDEX)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(rows["offset"].astype(np.int64))], ["path", "offset"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            got = []
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    store, name = _filesystem(path)
                    files[path] = store.open_input_file(name)
                files[path].seek(offset)
                got.append(parse(unframe(files[path])))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([x.astype(np.int32) for _, x in got], pa.list_(pa.int32()))], ["id", "ids"])

    # names differ from run to run; the place of a file in the order of ids doesn't
    places = manifest.select("path", "index_path", (F.col("shard") * 1_000_000 + F.col("part")).alias("place"))
    at = places.select("path", "index_path").repartition(n).mapInArrow(index, "path string, offset long")
    mixed = at.join(F.broadcast(places.select("path", "place")), "path") if n <= 10_000 else at.join(places.select("path", "place"), "path")
    mixed = mixed.withColumn("key", F.xxhash64(F.lit(seed), "place", "offset"))
    return mixed.repartitionByRange(n_parts, "key").sortWithinPartitions("key").select("path", "offset").mapInArrow(fetch, "id long, ids array<int>")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_records(documents(spark, sf_dir), scratch_path(spark, "records"), "word_bpe_49k.json")
    return read_records(manifest).select(F.col("id").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
