"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

One model a language, over UTF-16 code units, order 4. Counts, continuation counts, discounts and context
weights are Spark tables keyed by language and n-gram; joins between the orders, sharded by those keys, give
each seen n-gram its interpolated probability and each context its weight. Documents are scored by their
n-grams and rejected where their perplexity is beyond a quantile of the trusted documents of their language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, labels, slices, stored, strings

ORDER = 4
#: Trusted documents of a language that train at most (None: all that are not held out), and the fewest it needs for a
#: model of its own.
MAX_TRAIN_DOCS, MIN_LANG_DOCS = None, 20
#: Rows of a model that are broadcast (16 bytes each); a larger model is joined with the documents' n-grams.
MOST_ROWS = 4_000_000
#: The model of all languages, for documents whose language has none.
POOLED = "*"
#: Training documents that are broadcast by id and language; more are joined.
MOST_IDS = 1_000_000
#: Quantiles of trusted documents' log perplexity, and the margins beyond them in nats a unit: one for all, and
#: one that shrinks with the square root of a text's units, as the spread of a mean does.
LOW, HIGH, MARGIN, SHORT = 0.002, 0.995, 0.05, 1.5
#: One in so many trusted documents is held out of the model; the fewest of a language that set a bound of its own.
HELD, MIN_HELD = 5, 10
#: Fixed value: probability of any of the 65,536 code units before anything is known.
UNIFORM = 1 / 65536


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, three units of padding before each, and each text's number of them."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    n = np.fromiter((len(b) // 2 for b in raw), np.int64, len(raw))
    u = np.frombuffer(b"".join(bytes(2 * ORDER - 2) + b for b in raw), np.uint16).astype(np.uint64)
    if len(u) < ORDER:
        return np.empty(0, np.uint64), n
    codes = u[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        codes |= u[ORDER - 1 - k : len(u) - k] << np.uint64(16 * k)
    starts = np.cumsum(n + ORDER - 1) - n - ORDER + 1
    ends = np.cumsum(n)
    return codes[np.repeat(starts - ends + n, n) + np.arange(ends[-1])], n


def _language(df: DataFrame, lang: str) -> Column:
    return F.coalesce(df[lang].cast("string"), F.lit(""))


def trusted(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", most: int | None = None) -> DataFrame:
    """id, lang and held of every document of rows (id, lang) that is labelled good and not toxic. Held is one in HELD,
    by a hash of the id: they set the upper bound, all others are in the model. With `most`, or MAX_TRAIN_DOCS if not
    given, about that many of each language are in the model at most, by another hash, and the rest is held too."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(labels[id_col].cast("long").alias("id")).where("id IS NOT NULL").distinct()
    x = stored(rows.select("id", "lang").join(good, "id").distinct().withColumn("held", F.pmod(F.xxhash64(F.lit(HELD), "id"), F.lit(HELD)) == 0), "labelled")
    most = MAX_TRAIN_DOCS if most is None else most
    if most is None:
        return x.select("id", "lang", "held")
    n = x.where("NOT held").groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * F.col("n") / (1 << 30)
    return x.join(n, "lang", "left").select("id", "lang", (F.col("held") | (place >= most)).alias("held"))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """docs: lang, text. The stored table lang, gram, c: how often each n-gram of full order occurs, for each
    language; added up in each task before the shuffle, so memory is bounded by a slice's n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                langs, texts = np.array(part.column(0).to_pylist(), object), np.array(strings(part.column(1)).to_pylist(), object)
                for name in sorted(set(langs)):
                    place, codes = pd.factorize(units(list(texts[langs == name]))[0])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(np.bincount(place, minlength=len(codes)))], ["lang", "gram", "c"])

    return stored(docs.select("lang", "text").mapInArrow(run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")), "ngrams")


def together(counts: DataFrame, name: str = POOLED) -> DataFrame:
    """The counts of all languages together, under a name of their own."""
    return counts.groupBy("gram").agg(F.sum("c").alias("c")).select(F.lit(name).alias("lang"), "gram", "c")


def _discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, ctx, a) and (lang, ctx, gamma) of one order: a = (c - D(c)) / total, gamma the mass that
    the discounts leave. D1, D2, D3+ come from the language's counts of counts and stay within [0, c]. Their
    broadcast has a row a model: the languages with MIN_LANG_DOCS training documents, and one."""
    cc = counts.groupBy("lang").agg(*(F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    d = [F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.5 * k)))).alias(f"d{k}") for k in (1, 2, 3)]
    x = counts.join(F.broadcast(cc.select("lang", *d)), "lang").withColumn("ctx", F.shiftrightunsigned("gram", 16))
    x = x.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
    total = x.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
    total = total.select("lang", "ctx", "total", (F.col("left") / F.col("total")).alias("gamma"))
    return x.join(total, ["lang", "ctx"]).select("lang", "gram", "ctx", ((F.col("c") - F.col("d")) / F.col("total")).alias("a"), "gamma"), total.select("lang", "ctx", "gamma")


def kneser_ney(counts: DataFrame) -> DataFrame:
    """counts: lang, gram, c of full order. The models: lang, k (order; -k for the weight of a context that
    order k extends), gram, v. Lower orders count distinct preceding units. No counts give an empty model,
    with which every unit has the uniform probability."""
    out, below = None, None
    tables = [stored(counts, "order")]
    for k in range(ORDER - 1, 0, -1):
        mask = (1 << 16 * k) - 1
        tables.append(tables[-1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask).cast("long")).alias("gram")).agg(F.count("*").alias("c")))
        tables[-1] = stored(tables[-1], "order")
    for k in range(1, ORDER + 1):
        a, gamma = _discounted(tables[ORDER - k])
        if k == 1:
            p = a.select("lang", "gram", (F.col("a") + F.col("gamma") * UNIFORM).alias("v"))
        else:
            mask = F.lit((1 << 16 * (k - 1)) - 1).cast("long")
            low = below.select("lang", F.col("gram").alias("tail"), F.col("v").alias("p"))
            p = a.withColumn("tail", F.col("gram").bitwiseAND(mask)).join(low, ["lang", "tail"]).select("lang", "gram", (F.col("a") + F.col("gamma") * F.col("p")).alias("v"))
        p = stored(p, "order")
        rows = p.withColumn("k", F.lit(k)).unionByName(gamma.select("lang", F.col("ctx").alias("gram"), F.col("gamma").alias("v"), F.lit(-k).alias("k")))
        out, below = rows if out is None else out.unionByName(rows), p
    return stored(out.select("lang", "k", "gram", "v"), "model")


def train(docs: DataFrame) -> DataFrame:
    """docs: lang, text of trusted documents. A model for each language that has enough
    documents and one for all together."""
    by = count_ngrams(docs)
    enough = docs.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_LANG_DOCS).select("lang")
    return kneser_ney(by.join(enough, "lang", "left_semi").unionByName(together(by)))


class Model:
    """Sorted arrays of one language: for each order k its n-grams' probabilities, under -k its contexts' weights."""

    def __init__(self, k: np.ndarray, gram: np.ndarray, v: np.ndarray):
        self.at = {}
        for own in np.unique(k).tolist():
            g, x = gram[k == own], v[k == own]
            order = np.argsort(g)
            self.at[own] = g[order], x[order]

    @classmethod
    def collected(cls, model: DataFrame) -> dict[str, "Model"]:
        """All languages' models, read as Arrow; the caller has checked the number of rows."""
        t = model.toArrow().combine_chunks()
        lang = t["lang"].combine_chunks().dictionary_encode()
        codes, k, gram, v = lang.indices.to_numpy(), t["k"].to_numpy(), t["gram"].to_numpy().view(np.uint64), t["v"].to_numpy()
        return {name: cls(k[codes == i], gram[codes == i], v[codes == i]) for i, name in enumerate(lang.dictionary.to_pylist())}

    def find(self, k: int, gram: np.ndarray, missing: float) -> np.ndarray:
        keys, values = self.at.get(k, (np.empty(0, np.uint64), np.empty(0)))
        if not len(keys):
            return np.full(len(gram), missing)
        i = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        return np.where(keys[i] == gram, values[i], missing)

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        p = np.full(len(gram), UNIFORM)
        for k in range(1, ORDER + 1):
            own = gram & np.uint64((1 << 16 * k) - 1)
            seen = self.find(k, own, np.nan)
            p = np.where(np.isnan(seen), self.find(-k, own >> np.uint64(16), 1.0) * p, seen)
        return np.log(p)


def score(docs: DataFrame, model: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """docs: id, lang, text. id, lang, n_units and log_ppl (null for an empty text), the mean negative log
    probability of a unit, under the language's model or else the pooled one. A model of at most most_rows
    rows is broadcast; a larger one stays sharded and is joined with each document's counted n-grams."""
    names = [r["lang"] for r in model.select("lang").distinct().collect()]  # languages with MIN_LANG_DOCS training documents, and one
    x = docs.select("id", "lang", F.when(F.col("lang").isin(names), F.col("lang")).otherwise(POOLED).alias("model"), "text")
    schema = "id long, lang string, n_units long, log_ppl double"
    if model.count() > most_rows:
        return _score_by_joins(x, model)
    shared = docs.sparkSession.sparkContext.broadcast(Model.collected(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for part in slices(batch, 3):
                which, texts = np.array(part.column(2).to_pylist(), object), np.array(strings(part.column(3)).to_pylist(), object)
                n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                for name in sorted(set(which)):
                    rows = np.flatnonzero(which == name)
                    codes, own = units(list(texts[rows]))
                    place, distinct = pd.factorize(codes)
                    logs = models[name].log_p(distinct)[place] if name in models else np.full(len(codes), np.log(UNIFORM))
                    sums = np.concatenate([[0.0], np.cumsum(logs)])
                    ends = np.cumsum(own)
                    n[rows], total[rows] = own, sums[ends] - sums[ends - own]
                mean = -total / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(mean, mask=n == 0)], ["id", "lang", "n_units", "log_ppl"])

    return x.mapInArrow(run, schema)


def gram_rows(rows: DataFrame) -> DataFrame:
    """rows: row, text. row, gram, c: each text's distinct n-grams, counted; a text without units has one row
    with a null gram and c 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                codes, count = np.unique(units([text.as_py()])[0], return_counts=True)
                gram = pa.array(codes.view(np.int64)) if len(codes) else pa.array([None], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(gram), pa.int64()), gram, pa.array(count if len(codes) else [0], pa.int64())], ["row", "gram", "c"])

    return rows.select("row", "text").mapInArrow(run, "row long, gram long, c long")


def probabilities(types: DataFrame, model: DataFrame) -> DataFrame:
    """types: model, gram (distinct). model, gram and p, by joins with the orders, least first."""
    x = types.withColumn("p", F.lit(UNIFORM))
    for k in range(1, ORDER + 1):
        seen = model.where(F.col("k") == k).select(F.col("lang").alias("model"), F.col("gram").alias("own"), F.col("v").alias("seen"))
        weight = model.where(F.col("k") == -k).select(F.col("lang").alias("model"), F.col("gram").alias("ctx"), F.col("v").alias("weight"))
        own = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1).cast("long")) if k < 4 else F.col("gram")
        x = x.withColumn("own", own).withColumn("ctx", F.shiftrightunsigned("own", 16)).join(seen, ["model", "own"], "left").join(weight, ["model", "ctx"], "left")
        x = x.select("model", "gram", F.coalesce("seen", F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p"))
    return x


def _score_by_joins(x: DataFrame, model: DataFrame) -> DataFrame:
    rows = stored(x.select(F.monotonically_increasing_id().alias("row"), "id", "lang", "model", "text"), "scored")
    grams = gram_rows(rows).join(rows.select("row", "model"), "row")
    p = probabilities(grams.where("gram IS NOT NULL").select("model", "gram").distinct(), model)
    sums = grams.join(p, ["model", "gram"], "left").groupBy("row").agg(F.sum("c").alias("n_units"), F.sum(F.col("c") * F.log("p")).alias("total"))
    return rows.join(sums, "row").select("id", "lang", "n_units", F.when(F.col("n_units") > 0, -F.col("total") / F.col("n_units")).alias("log_ppl"))


def thresholds(scores: DataFrame, good: DataFrame, low: float = LOW, high: float = HIGH, margin: float = MARGIN) -> DataFrame:
    """lang, low, high: quantiles of log_ppl, less and plus the margin, for each language and of all together for
    POOLED; low among all trusted documents, high among all of them that are not in the model, whose perplexity
    is what an unseen text of their kind has. Exact to a bin of 0.001; a language has at most some thousand bins."""
    x = scores.where("log_ppl IS NOT NULL").join(good, ["id", "lang"]).select("lang", "held", F.floor(F.col("log_ppl") * 1000).alias("bin"))
    x = x.withColumn("lang", F.explode(F.array("lang", F.lit(POOLED)))).groupBy("lang", "bin").agg(F.count("*").alias("n"), F.count_if("held").alias("h"))
    w = Window.partitionBy("lang")
    for c in ("n", "h"):
        x = x.withColumn(f"{c}_upto", F.sum(c).over(w.orderBy("bin"))).withColumn(f"{c}_all", F.sum(c).over(w))
    at = lambda c, q: F.min(F.when(F.col(f"{c}_upto") >= F.col(f"{c}_all") * q, F.col("bin")))
    return x.groupBy("lang").agg((at("n", low) / 1000 - margin).alias("low"), ((at("h", high) + 1) / 1000 + margin).alias("high"), F.max("n_all").alias("n_trusted"), F.max("h_all").alias("n_held"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each row of docs: its id, lang, n_units, perplexity (of a code unit), low and high (the
    bounds) and keep. Rejected: texts without a unit, and perplexities beyond the bounds of the language, or
    of all languages where it has fewer than MIN_LANG_DOCS trusted documents or MIN_HELD held ones. Null
    languages are one language of their own; a side without any document to set it has no bound, so without
    trusted documents every text with a unit stays. Labels name documents by id_col too."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), _language(docs, lang).alias("lang"), docs[text].cast("string").alias("text"))
    good = stored(trusted(rows, labels, id_col), "trusted")
    fit = good.where("NOT held").select("id", "lang")
    model = train(rows.join(F.broadcast(fit) if fit.count() <= MOST_IDS else fit, ["id", "lang"], "left_semi"))
    scores = stored(score(rows, model), "scores")
    limits = stored(thresholds(scores, good), "limits")
    own = limits.where((F.col("n_trusted") >= MIN_LANG_DOCS) & (F.col("n_held") >= MIN_HELD) & (F.col("lang") != POOLED)).drop("n_trusted", "n_held")
    pooled = limits.where(F.col("lang") == POOLED).first()
    low, high = ((pooled["low"], pooled["high"]) if pooled and pooled["n_held"] else (None, None))
    low, high = (float("-inf") if low is None else low, float("inf") if high is None else high)
    x = scores.join(own, "lang", "left").withColumn("low", F.coalesce("low", F.lit(low))).withColumn("high", F.coalesce("high", F.lit(high)))
    x = x.withColumn("low", F.col("low") - SHORT / F.sqrt(F.greatest("n_units", F.lit(1)))).withColumn("high", F.col("high") + SHORT / F.sqrt(F.greatest("n_units", F.lit(1))))
    keep = F.coalesce((F.col("log_ppl") >= F.col("low")) & (F.col("log_ppl") <= F.col("high")), F.lit(False))
    return x.select(F.col("id").alias(id_col), "lang", "n_units", F.exp("log_ppl").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without what classify() rejects; rows that repeat an id share its verdict, and stay if any is good."""
    kept = classify(docs, labels, id_col, text, lang).where("keep").select(F.col(id_col).alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("__kept")), "left_semi")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), labels(spark, sf_dir))
