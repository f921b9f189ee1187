"""Token counts: an exact histogram of encoded lengths and the suffix sums that answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, slices, stored, strings
from .tokens import encoder, vocabulary

#: Lengths of one block of the two-level sums.
BLOCK = 1024


def token_lengths(docs: DataFrame, vocab: str, id_col: str = "doc_id", text: str = "text", scope: str | None = None) -> DataFrame:
    """One row per row of docs: its id, its scope and n_tokens. A null or empty text has 0 tokens; rows
    that repeat count each time; other columns are not read."""
    path = vocabulary(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                n = np.diff(encoder(path).encode(strings(part.column(2)))[1])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["id", "scope", "n_tokens"])

    asked = docs.select(docs[id_col].alias("id"), (docs[scope].cast("string") if scope else F.lit(None).cast("string")).alias("scope"), docs[text].alias("text"))
    return asked.mapInArrow(run, T_LENGTHS(asked))


def T_LENGTHS(asked: DataFrame) -> str:
    return f"id {asked.schema['id'].dataType.simpleString()}, scope string, n_tokens long"


def length_histogram(docs: DataFrame, vocab: str, text: str = "text", scope: str | None = None) -> DataFrame:
    """scope, length, n_docs: documents by exact encoded length; the scope 'all' holds all rows and a null
    scope counts as 'none'. Aggregated before the shuffle, so a hot length costs one row a task."""
    some = token_lengths(docs.withColumn("__row", F.lit(0)), vocab, "__row", text, scope)
    by = some.groupBy(F.coalesce("scope", F.lit("none")).alias("scope"), F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))
    if scope is None:
        return by.withColumn("scope", F.lit("all"))
    return by.withColumn("scope", F.explode(F.array("scope", F.lit("all")))).groupBy("scope", "length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each scope and present length L: n_docs, n_longer (documents over L), total_tokens of the scope,
    truncated_tokens (sum of min(length, L)), and rank_to (documents of at most L tokens, which answers
    every quantile). Two levels of sums, by blocks of lengths and inside a block, keep any one task small.
    An empty histogram gives no rows."""
    h = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("scope", "block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    over = Window.partitionBy("scope").orderBy("block")
    later = over.rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy("scope")
    blocks = blocks.select(
        "scope", "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("later_docs"),
        F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("all_tokens"),
        F.coalesce(F.sum("bt").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier_tokens"),
    )
    inside = Window.partitionBy("scope", "block").orderBy("length")
    x = h.join(blocks, ["scope", "block"])
    longer = F.col("later_docs") + F.coalesce(F.sum("n_docs").over(inside.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    upto = F.col("earlier_tokens") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return x.select(
        "scope", "length", F.col("n_docs").cast("long").alias("n_docs"), longer.cast("long").alias("n_longer"),
        F.col("all_tokens").cast("long").alias("total_tokens"), (upto + F.col("length") * longer).cast("long").alias("truncated_tokens"),
        (F.col("all_docs") - longer).cast("long").alias("rank_to"), F.col("all_docs").cast("long").alias("all_docs"),
    )


def at_limits(sums: DataFrame, limits: list[int], scope: str = "all") -> DataFrame:
    """limit, n_longer, truncated_tokens for any limits, present as lengths or not, read off the suffix sums at the
    next present length: all documents that exceed the limit reach it, so each loses the difference and no more.
    Beyond the longest document nothing is cut. A scope without documents has zeros."""
    after = [F.min(F.when(F.col("length") > x, F.struct("length", "n_docs", "n_longer", "truncated_tokens"))).alias(f"x{k}") for k, x in enumerate(limits)]
    found = sums.where(F.col("scope") == scope).agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total"), *after)
    rows = []
    for k, x in enumerate(limits):
        at = F.col(f"x{k}")
        longer = F.coalesce(at["n_longer"] + at["n_docs"], F.lit(0)).cast("long")
        cut = F.when(at.isNull(), F.col("total")).otherwise(at["truncated_tokens"] - (at["length"] - x) * longer)
        rows.append(F.struct(F.lit(x).cast("long").alias("limit"), longer.alias("n_longer"), cut.cast("long").alias("truncated_tokens")))
    return found.select(F.inline(F.array(*rows)))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """scope, length: the smallest length that at least a share q of the scope's documents do not exceed."""
    return sums.where(F.col("rank_to") >= F.col("all_docs") * F.lit(q)).groupBy("scope").agg(F.min("length").alias("length"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sums read the histogram twice; stored, it is counted once
    return suffix_sums(stored(length_histogram(documents(spark, sf_dir), "byte_bpe_50k.json", scope="lang"), "lengths"))
