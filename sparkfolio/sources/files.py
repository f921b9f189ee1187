"""Files that every executor sees: scratch folders, digests, small JSON documents."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Only local sessions may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkfolio-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def digests(spark: SparkSession, *paths: str) -> DataFrame:
    """path, name (without folders and suffix) and the SHA-256 of each file's content. Files of up to 2 GB."""
    x = spark.read.format("binaryFile").load(list(paths))
    return x.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def newest_by_name(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str:
    """The file whose path sorts last; an error when there is none. Contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).agg(F.max("path")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return found


def digest(df: DataFrame) -> dict:
    """Row count and an order-free digest of all rows: hashes summed as decimals, so copies count. No map columns."""
    x = df.select(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("h")) if df.columns else df.select(F.lit(0).cast("decimal(38,0)").alias("h"))
    r = x.agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("s")).first()
    return {"rows": r["n"], "digest": r["s"], "schema": df.schema.simpleString()}


class Folder:
    """A folder of any Hadoop file system, by the driver: small documents, exclusive creation, renames."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, jvm = path.rstrip("/"), spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def create(self, name: str, value: object) -> None:
        """Writes JSON; FileExistsError if the file is there."""
        if self.exists(name):
            raise FileExistsError(f"{self.path}/{name}")
        out = self._fs.create(self._at(name), False)  # fails too if another driver is first
        out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
        out.close()

    def load(self, name: str):
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def rename(self, a: str, b: str) -> None:
        self._fs.mkdirs(self._at(b).getParent())
        if not self._fs.rename(self._at(a), self._at(b)):
            raise OSError(f"cannot rename {a} to {b} in {self.path}")
