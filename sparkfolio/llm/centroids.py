"""Centroid clustering in whole numbers: equal quantised vectors are one vector with a weight, Lloyd's rounds run on
those, and the assignments are joined back to the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, scratch_path

#: Components of a vector, steps of a unit, clusters, rounds, and what start() hashes before an id.
DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Largest component in steps: squared distances of 64 components then fit 64 bits. Up to EXACT doubles hold them exactly.
MOST, EXACT = 1 << 27, 1 << 21
RAISED = 1 << 31


def quantised(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id and key for each row whose vector has exactly dims components, none null, NaN or infinite: floor(scale * x) of each
    as big-endian 32-bit integers raised by 2**31, so keys sort as vectors do. Other rows are left out. A component beyond 2**27 steps fails the job: distances
    would not fit 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False)
            batch = batch.filter(full)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            good = np.isfinite(x).all(axis=1)
            q = np.floor(scale * x[good])
            if q.size and np.abs(q).max() > MOST:
                raise ValueError(f"a component is beyond {MOST} steps")
            keys = pa.Array.from_buffers(pa.binary(4 * dims), len(q), [None, pa.py_buffer(np.ascontiguousarray((q + RAISED).astype(">u4")))])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), keys.cast(pa.binary())], ["id", "key"])

    return df.select(df[id_col].cast("long"), df[vector].cast("array<double>")).mapInArrow(run, "id long, key binary")


def start(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the k rows with the smallest SHA-256 of "<seed>:<id>" (ties by the vector, null ids last), in that
    order; of all rows if there are fewer."""
    top = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).alias("h"), "key").orderBy(F.asc_nulls_last("h"), "key").limit(k)
    return _vectors([r["key"] for r in top.collect()])


def _vectors(keys: list) -> np.ndarray:
    return np.stack([np.frombuffer(x, ">u4") for x in keys]).astype(np.int64) - RAISED if keys else np.empty((0, 0), np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid (the smaller of two as near) and its squared distance, exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, c = x.astype(float), centroids.astype(float)
        d = ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(d)), at]


def _blocks(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for a in range(0, batch.num_rows, rows):
        part = batch.slice(a, rows)
        key = part.column(0)
        data, first = np.frombuffer(key.buffers()[2], np.uint8), np.frombuffer(key.buffers()[1], np.int32)[key.offset : key.offset + len(key) + 1]
        yield part, data[first[0] : first[-1]].view(">u4").reshape(len(key), -1).astype(np.int64) - RAISED


def weighted_sums(distinct: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and componentwise weighted sum of each cluster, as Python integers. A task sums its partition; what
    reaches the driver is one number a cluster and component."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for part, x in _blocks(batch):
                at, _ = nearest(x, centroids)
                n = part.column(1).to_numpy()
                own = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1) * n[:, None]
                for c in np.unique(at):
                    total[c] += own[at == c].sum(axis=0)
        where = np.flatnonzero(total[:, -1])
        if len(where):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(where, dims + 1)), pa.array(np.tile(np.arange(dims + 1), len(where))), pa.array(total[where].ravel())], ["cluster", "at", "v"])

    sums = distinct.select("key", "n").mapInArrow(run, "cluster long, at long, v long").groupBy("cluster", "at").agg(F.sum("v").alias("v"))
    out = np.zeros((k, dims + 1), object)
    for r in sums.collect():
        out[r["cluster"], r["at"]] = r["v"]
    return out[:, -1], out[:, :-1]


def moved(centroids: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """floor(sum / weight) for clusters that have vectors; the others stay."""
    return np.array([[int(s) // int(w) for s in row] if w else list(c) for c, w, row in zip(centroids, weights, sums)], np.int64)


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """key, n, cluster and squared distance of each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch):
                at, d = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at.astype(np.int32)), pa.array(d)], ["key", "n", "cluster", "distance"])

    return distinct.select("key", "n").mapInArrow(run, "key binary, n long, cluster int, distance long")


def cluster(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each row of df that has a whole vector
    (see quantised), repeated and null ids included; no row if none has. Equal vectors are summed to one with a weight
    before they are shuffled, so a vector in a third of all rows costs a row a task, and every round reads distinct
    vectors only. Fewer rows than k give as many clusters. Two equal start vectors: the smaller number takes all, the
    other stays empty. The driver holds the k centroids. Assignments come back by a join on the vector's SHA-256, whose
    hot keys Spark splits. Other columns of df, whatever their names, are not read. Sums beyond 64 bits fail the job."""
    spark = df.sparkSession
    held = [scratch_path(spark, "vectors"), scratch_path(spark, "distinct")]
    quantised(df, id_col, vector, dims, scale).write.parquet(held[0])
    rows = spark.read.parquet(held[0])
    rows.groupBy("key").agg(F.count("*").alias("n")).write.parquet(held[1])
    distinct, centroids = spark.read.parquet(held[1]), start(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        new = moved(centroids, *weighted_sums(distinct, centroids))
        if (new == centroids).all():  # later rounds would not move them either
            break
        centroids = new
    path = scratch_path(spark, "assigned")
    x = assigned(distinct, centroids).select(F.unhex(F.sha2("key", 256)).alias("h"), "n", "cluster", "distance")
    x.write.parquet(path)
    x = spark.read.parquet(path)
    delete(spark, held[1])
    inertia = {r["cluster"]: int(r["v"]) for r in x.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("v")).collect()}
    if sum(inertia.values()) >= 1 << 63:
        raise ValueError("the inertia does not fit 64 bits")
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), sha[c]) for c in range(len(sha))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    back = rows.select("id", F.unhex(F.sha2("key", 256)).alias("h")).join(x.select("h", "cluster", "distance"), "h")
    return back.join(F.broadcast(table), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def _sql() -> str:
    """The same rounds spelled out, over all rows."""
    assign = lambda k: f"""
a{k} AS MATERIALIZED (SELECT vec_id, v, CAST(x % {CLUSTERS} AS INTEGER) AS c, CAST(x // {CLUSTERS} AS BIGINT) AS d FROM (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v,
 min(CAST(list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS BIGINT) * {CLUSTERS} + c) AS x FROM q CROSS JOIN c{k} GROUP BY row))"""  # noqa: E731
    move = lambda k: f""",
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(new.m, c{k}.m) AS m FROM c{k} LEFT JOIN (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM
 (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{k} CROSS JOIN (SELECT unnest(range(1, {DIMS + 1})) AS i) GROUP BY 1, 2) GROUP BY 1) new USING (c)),"""  # noqa: E731
    return (
        f"""WITH q AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {DIMS} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM q ORDER BY h, v LIMIT {CLUSTERS})),"""
        + "".join(assign(k) + move(k) for k in range(ROUNDS))
        + assign(ROUNDS)
        + f"""
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)"""
    )


OP12_SQL = _sql()
