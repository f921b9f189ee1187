"""Exact dedup by Grace hashing: records are partitioned to spill files, again and again, until a bucket's
distinct contents fit an open-addressing table that compares complete content."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, documents

#: Bytes of distinct content one table may hold; spill files of one partitioning step.
TABLE_BYTES, FANOUT = 64 << 20, 16
#: Fixed value: the layout of a spilled record's head.
HEAD = "<qqqqI"
_NO_ID = 2**63 - 1

Record = tuple[int, bytes, int, int, int]  # hash, content, smallest id, rows with that id, rows


class OpenTable:
    """Linear probing over int32 slots; a hit needs equal hashes and equal content."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int32)
        self.rows: list[list] = []
        self.bytes = 0

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int32)
        mask = len(self.slots) - 1
        for k, row in enumerate(self.rows):
            at = row[0] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def add(self, record: Record) -> None:
        h, content, first, ties, n = record
        if 2 * len(self.rows) >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            row = self.rows[k]
            if row[0] == h and row[1] == content:
                if first < row[2]:
                    row[2], row[3] = first, ties
                elif first == row[2]:
                    row[3] += ties
                row[4] += n
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.rows)
        self.rows.append([h, content, first, ties, n])
        self.bytes += len(content) + 200


def _read(path: str) -> Iterator[Record]:
    with open(path, "rb", buffering=1 << 18) as f:
        while head := f.read(struct.calcsize(HEAD)):
            h, first, ties, n, size = struct.unpack(HEAD, head)
            yield h, f.read(size), first, ties, n


def grace(records: Iterable[Record], table_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[Record]:
    """One record for each distinct content. Memory: one table; beyond it the bucket goes to FANOUT spill
    files by the next bits of the hash. A bucket with one content stays, however long that is; contents that
    share all 64 bits end in one table, still compared whole."""
    records = iter(records)
    table = OpenTable()
    for record in records:
        table.add(record)
        if table.bytes > table_bytes and len(table.rows) > 1 and level < 15:
            break
    else:
        yield from map(tuple, table.rows)
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = [os.path.join(folder, str(k)) for k in range(FANOUT)]
        files = [open(p, "wb", buffering=1 << 16) for p in paths]
        for source in (table.rows, records):
            for h, content, first, ties, n in source:
                f = files[(h >> (60 - 4 * level)) & 15]
                f.write(struct.pack(HEAD, h, first, ties, n, len(content)))
                f.write(content)
        table = None
        for f in files:
            f.close()
        for p in paths:
            yield from grace(_read(p), table_bytes, level + 1)
            os.unlink(p)


def normalised(text: Column) -> Column:
    """Each run of ASCII white space is one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), ASCII_SPACE, " ")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            h, text, first, ties, n = (c.to_pylist() for c in batch.slice(at, 500).columns)
            yield from zip(h, (t if isinstance(t, bytes) else t.encode() for t in text), first, ties, n)


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """text_sha256, keep_id, ties, group_size: one row for each text, in normalised form, that two rows or
    more share. keep_id is the smallest id (null only if no row of the group has one) and ties the number
    of rows with that id. Every partition is reduced to its distinct texts before the shuffle, so a text
    in a third of all rows costs one record a partition."""

    def run(last: bool):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            held = 0

            def flush() -> pa.RecordBatch:
                cols = list(zip(*rows))
                if last:
                    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array([None if x == _NO_ID else x for x in cols[1]], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["text_sha256", "keep_id", "ties", "group_size"])
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["h", "text", "first", "ties", "n"])

            for h, content, first, ties, n in grace(_records(batches), table_bytes):
                if last and n < 2:
                    continue
                rows.append((hashlib.sha256(content).hexdigest(), first, ties, n) if last else (h, content, first, ties, n))
                held += 100 if last else len(content)
                if held > 4 << 20:
                    yield flush()
                    rows, held = [], 0
            if rows:
                yield flush()

        return f

    body = normalised(docs[text])
    one = docs.select(F.xxhash64(body).alias("h"), body.alias("text"), F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("first"), F.lit(1).cast("long").alias("ties"), F.lit(1).cast("long").alias("n"))
    local = one.mapInArrow(run(False), "h long, text binary, first long, ties long, n long")
    return local.repartition("h").mapInArrow(run(True), "text_sha256 string, keep_id long, ties long, group_size long")


def _marked(docs: DataFrame, id_col: str, text: str, carry: tuple[str, ...], table_bytes: int) -> DataFrame:
    """id, the carried columns as c_0, c_1, ... and the verdict of each row of docs."""
    groups = copy_groups(docs, id_col, text, table_bytes)
    rows = docs.select(docs[id_col].alias("id"), *(docs[c].alias(f"c_{k}") for k, c in enumerate(carry)), F.sha2(normalised(docs[text]), 256).alias("text_sha256"))
    x = rows.join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return x.select(
        "id", *(f"c_{k}" for k in range(len(carry))), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.coalesce("ties", F.lit(1)).cast("long").alias("ties"), "text_sha256",
    )


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each row of docs: its id, keep_id, group_size, kept, ties and text_sha256. The row with the
    smallest id stays; ids that are null come last; rows that repeat that smallest id with an equal text are all
    marked as kept, and counted in ties. The verdicts join by the content's SHA-256, a join whose hot keys Spark
    splits. Other columns of docs, whatever their names, are not read."""
    return _marked(docs, id_col, text, (), table_bytes).withColumnRenamed("id", id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without copies: exactly one row of each group stays, with docs' own columns."""
    rest = tuple(c for c in docs.columns if c != id_col)
    x = _marked(docs, id_col, text, rest, TABLE_BYTES).where("kept")
    x = x.where("ties = 1").unionByName(x.where("ties > 1").dropDuplicates(["text_sha256"]))
    place = {c: f"c_{k}" for k, c in enumerate(rest)} | {id_col: "id"}
    return x.select(*(F.col(place[c]).alias(c) for c in docs.columns))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
