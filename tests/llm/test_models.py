"""op2 and op9 against a plain Kneser-Ney model and held-out labels."""

import math

import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import crossentropy, quality

from . import brute


@pytest.fixture(scope="module")
def small(spark):
    texts = ["the cat sat", "the cat ran", None, "", "a dog sat 😀", "zzzz zzzz", "the the the", "le chat", "le chien", "les chats"]
    rows = [(k, t, "fr" if k > 6 else "en", t) for k, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "id long, text string, lang string, gram string")


@pytest.mark.parametrize("most_rows", [10**6, 0])
def test_kneser_ney(small, most_rows, monkeypatch):
    rows, df = small
    monkeypatch.setattr(quality, "MIN_LANG_DOCS", 4)
    train = df.where("id < 5 OR id > 6")
    got = {r["id"]: (r["n_units"], r["log_ppl"]) for r in quality.score(df, quality.train(train), most_rows).collect()}
    en = brute.KneserNey([t for k, t, g, _ in rows if g == "en" and k < 5])
    both = brute.KneserNey([t for k, t, _, _ in rows if k < 5 or k > 6])
    for k, t, g, _ in rows:
        want = (en if g == "en" else both).loss(t)
        assert got[k][0] == len(brute.units(t or ""))
        assert want is None and got[k][1] is None or math.isclose(want, got[k][1], rel_tol=1e-9), t


@pytest.mark.parametrize("most_rows", [10**6, 0])
def test_cross_entropy(small, most_rows):
    rows, df = small
    model = crossentropy.matched_models(df.select("text", (F.col("id") < 4).alias("target")))
    got = {r["id"]: r for r in crossentropy.score(df, model, "id", most_rows=most_rows).collect()}
    target, background = brute.KneserNey([t for k, t, _, _ in rows if k < 4]), brute.KneserNey([t for _, t, _, _ in rows])
    for k, t, _, _ in rows:
        if not t:
            assert got[k]["ce_difference"] is None and got[k]["n_units"] == 0
        else:
            a, b = target.loss(t), background.loss(t)
            assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in ((a, got[k]["ce_target"]), (b, got[k]["ce_background"]), (a - b, got[k]["ce_difference"])))


def test_no_target_and_empty(spark, small, empty):
    _, df = small
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert crossentropy.cross_entropy_difference(empty, none).count() == 0 and quality.classify(empty, none).count() == 0
    got = crossentropy.cross_entropy_difference(df, none.withColumnRenamed("doc_id", "id"), "id").collect()
    assert len(got) == 10 and all(r["ce_target"] is None or math.isclose(r["ce_target"], math.log(65536)) for r in got)
    kept = quality.classify(df, none.withColumnRenamed("doc_id", "id"), "id").collect()
    assert {r["id"] for r in kept if not r["keep"]} == {2, 3}


def test_edges(spark, edge):
    labels = spark.createDataFrame([(9, 1, 0), (21, 1, None), (21, 1, 0), (None, 1, 0), (4, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(edge, labels).collect()
    assert len(got) == edge.count() and all(not r["keep"] for r in got if r["doc_id"] in (1, 2))
    assert quality.keep_good(edge, labels).columns == edge.columns
    assert crossentropy.cross_entropy_difference(edge, labels).count() == edge.count()


def test_held_out_quality(spark):
    """Trained on labels of even ids, judged on odd ones: clean documents stay, nearly all bad ones go."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    x = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    n = {(r["quality"], r["keep"]): r["count"] for r in x.where("toxic = 0 OR quality = 0").groupBy("quality", "keep").count().collect()}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0))


def test_all_trusted_documents_set_the_bounds(spark, monkeypatch):
    """With more labels than train, a rare language keeps a model and bounds of its own, and every trusted document counts."""
    monkeypatch.setattr(quality, "MAX_TRAIN_DOCS", 40)
    rows = [(k, "xx" if k < 100 else "yy", f"{'abc' if k < 100 else 'defg'} {k} text" * (1 + k % 3)) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    good = quality.trusted(docs.selectExpr("doc_id AS id", "lang"), labels)
    n = {r["lang"]: (r["n"], r["fit"]) for r in good.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~F.col("held")).alias("fit")).collect()}
    assert n["xx"][0] == 100 and n["yy"][0] == 1900 and all(20 <= fit <= 60 for _, fit in n.values())
    scores = quality.score(docs.selectExpr("doc_id AS id", "lang", "text"), quality.train(docs.withColumnRenamed("doc_id", "id").join(good.where("NOT held"), ["id", "lang"], "left_semi")))
    limits = {r["lang"]: r for r in quality.thresholds(scores, good).collect()}
    x = sorted(r["log_ppl"] for r in scores.join(good.where("held"), ["id", "lang"]).where("lang = 'yy'").collect())
    assert limits["yy"]["n_trusted"] == 1900 and limits["yy"]["n_held"] == 1900 - n["yy"][1] == len(x)
    assert math.isclose(limits["yy"]["high"], (math.floor(1000 * x[math.ceil(0.995 * len(x)) - 1]) + 1) / 1000 + quality.MARGIN, abs_tol=1e-9)
    got = {r["lang"]: (r["low"], r["high"]) for r in quality.classify(docs, labels).where("n_units = 30 OR n_units > 30").groupBy("lang").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    assert got["xx"] != got["yy"]


def test_scoring_holds_a_bounded_piece(spark, monkeypatch):
    """Texts are scored a megabyte at a time, and cuts change nothing."""
    docs = spark.createDataFrame([(k, f"text number {k} " * 2000, k % 2 == 0) for k in range(90)], "doc_id long, text string, target boolean").coalesce(1)
    model = crossentropy.matched_models(docs.limit(4))
    want = {r["doc_id"]: r["ce_difference"] for r in crossentropy.score(docs, model).collect()}
    monkeypatch.setattr(crossentropy, "SCORED", 40_000)
    got = {r["doc_id"]: r["ce_difference"] for r in crossentropy.score(docs, model).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_every_trusted_document_trains_or_is_held_out(spark):
    """Over 20,000 documents of a language: all but one in five are in the model."""
    rows = spark.range(30_000).selectExpr("id", "'xx' AS lang")
    good = quality.trusted(rows, rows.selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic"))
    n = good.agg(F.count("*").alias("n"), F.count_if("held").alias("held")).first()
    assert n["n"] == 30_000 and 30_000 / quality.HELD * 0.95 < n["held"] < 30_000 / quality.HELD * 1.05
