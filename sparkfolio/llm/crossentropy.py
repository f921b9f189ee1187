"""LM scoring by cross-entropy difference (Moore and Lewis): a target and a background model, matched in order and
smoothing and over one vocabulary, the 65,536 UTF-16 code units; each token's loss under the one less its loss
under the other, averaged, scores a document. Lower is closer to the target.

Both are interpolated modified Kneser-Ney models of order 4. Their counts are exact and cover every document, so
the tables grow with the corpus; they are counted, discounted and interpolated as Spark tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, slices, stored, strings
from .quality import MOST_ROWS, UNIFORM, Model, count_ngrams, gram_rows, kneser_ney, probabilities, together, units

SIDES = ("target", "background")
#: Bytes of text that a task scores at a time; it holds some fifty bytes for each.
SCORED = 1 << 20


def matched_models(docs: DataFrame) -> DataFrame:
    """docs: text and target (boolean). The stored model tables of both sides; the background is every row, the
    target's included. Rows that repeat count each time; null texts have no units."""
    by = count_ngrams(docs.select(F.when(F.col("target"), SIDES[0]).otherwise("rest").alias("lang"), "text"))
    return kneser_ney(by.where(F.col("lang") == SIDES[0]).unionByName(together(by, SIDES[1])))


def score(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS) -> DataFrame:
    """One row for each row of docs: its id, n_units, ce_target and ce_background (nats a unit) and
    ce_difference; the three are null for texts without units. Models of at most most_rows rows together are
    broadcast; larger ones stay sharded and are joined with each document's counted n-grams."""
    asked = docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text"))
    schema = f"id {asked.schema['id'].dataType.simpleString()}, n_units long, ce_target double, ce_background double, ce_difference double"
    if model.count() > most_rows:
        return _score_by_joins(asked, model).withColumnRenamed("id", id_col)
    shared = docs.sparkSession.sparkContext.broadcast(Model.collected(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for part in slices(batch, 1, SCORED):
                codes, n = units(strings(part.column(1)).to_pylist())
                place, distinct = pd.factorize(codes)
                ends, cols = np.cumsum(n), []
                for side in SIDES:
                    logs = models[side].log_p(distinct) if side in models else np.full(len(distinct), np.log(UNIFORM))
                    sums = np.concatenate([[0.0], np.cumsum(logs[place])])
                    cols.append((sums[ends - n] - sums[ends]) / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *(pa.array(c, mask=n == 0) for c in (*cols, cols[0] - cols[1]))], ["id", "n_units", "ce_target", "ce_background", "ce_difference"])

    return asked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _score_by_joins(asked: DataFrame, model: DataFrame) -> DataFrame:
    rows = stored(asked.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "scored")
    grams = gram_rows(rows)
    types = grams.where("gram IS NOT NULL").select("gram").distinct()
    p = [probabilities(types.select(F.lit(side).alias("model"), "gram"), model).select("gram", (-F.log("p")).alias(side)) for side in SIDES]
    sums = [F.sum(F.col("c") * F.col(side)).alias(side) for side in SIDES]
    x = grams.join(p[0].join(p[1], "gram"), "gram", "left").groupBy("row").agg(F.sum("c").alias("n_units"), *sums)
    mean = [F.try_divide(side, "n_units") for side in SIDES]
    return rows.join(x, "row").select("id", "n_units", mean[0].alias("ce_target"), mean[1].alias("ce_background"), (mean[0] - mean[1]).alias("ce_difference"))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Target: the documents labelled good and not toxic; background: all documents. Labels join by id, a null
    id is no target. Without any target every unit costs the same under the target model; an empty table gives
    no rows."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(labels[id_col].alias("__good")).distinct()
    # a merge join at every size: a broadcast of small label tables would make plans differ as they grow
    rows = docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text")).join(good.hint("merge"), F.col("id") == F.col("__good"), "left")
    return score(docs, matched_models(rows.select("text", F.col("__good").isNotNull().alias("target"))), id_col, text)


def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(documents(spark, sf_dir), labels(spark, sf_dir))
