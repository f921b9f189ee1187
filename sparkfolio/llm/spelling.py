"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join, and the chain of more frequent
forms that each leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, documents, scratch_path, stored
from .url_graph import LOWER, UPPER

#: Runs of these letters are words; of the runs whose CRC-32 is divisible by ONE_IN a letter is deleted.
LETTERS, ONE_IN = "A-Za-zÀ-ÿ", 97
MIN_LETTERS, MIN_COUNT = 5, 3
#: A form is at least so many times as frequent as its variant.
TIMES = 2
#: Rows of one bucket that a cell compares on either side; larger buckets are dealt as a grid of cells.
TILE = 2048


def words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", one_in: int = ONE_IN) -> DataFrame:
    """One column, word: maximal runs of letters of the whole texts, A-Z lower-cased, at least MIN_LETTERS long after one
    letter of some of them was deleted: let h be the CRC-32 of "<id>:<run>"; where one_in divides h, that is the letter
    h % length. A null text has no words, a null id counts as empty."""
    runs = F.regexp_extract_all(docs[text].cast("string"), F.lit(f"[{LETTERS}]{{{MIN_LETTERS},}}"), F.lit(0))
    x = docs.select(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":")).alias("head"), F.explode(runs).alias("run"))
    x = x.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    x = x.withColumn("h", F.crc32(F.concat("head", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return x.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= MIN_LETTERS)


def vocabulary(w: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words with at least min_count occurrences."""
    return w.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _letters(word: Column) -> Column:
    """A bit for each letter that occurs, by its code point modulo 64."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a.bitwiseOR(bit(c))))


def _segments(vocab: DataFrame) -> DataFrame:
    """Four rows a word: its two halves, indexed under its own length, and as a probe of words one letter shorter the
    pieces where their halves lie if one letter was inserted, the second one shifted by a letter."""
    n, half, less = F.length("word"), F.floor(F.length("word") / 2).cast("int"), F.floor((F.length("word") - 1) / 2).cast("int")
    row = lambda length, second, piece, longer: F.struct(length.cast("int").alias("length"), F.lit(second).alias("second"), piece.alias("piece"), F.lit(longer).alias("longer"))
    rows = F.array(
        row(n, False, F.substr("word", F.lit(1), half), False), row(n, True, F.substr("word", half + 1), False),
        row(n - 1, False, F.substr("word", F.lit(1), less), True), row(n - 1, True, F.substr("word", less + 2), True),
    )
    return vocab.select("word", "n", _letters(F.col("word")).alias("letters"), F.explode(rows).alias("k")).select("k.*", "word", "n", "letters")


def near_pairs(vocab: DataFrame, tile: int = TILE, held: list[str] | None = None) -> DataFrame:
    """a, n_a, b, n_b: every two words exactly one inserted, deleted or replaced letter apart, once. One edit leaves one
    of two halves of the shorter word intact: in place, or at the end of the other word. So words are compared only
    where they share such a piece, in a join that passes on a pair when it is one edit apart; before that, a
    comparison of their letters' bits. Two words of equal length share one half only. A pair that shares both pieces is
    taken by the first. Buckets of over `tile` rows are dealt as a grid of cells, in which every pair meets once.
    held: takes the names of the written tables that the result reads."""
    spark, paths = vocab.sparkSession, [scratch_path(vocab.sparkSession, what) for what in ("segments", "hot")]
    if held is not None:
        held += paths
    _segments(vocab).write.parquet(paths[0])
    rows = spark.read.parquet(paths[0])
    key = ["length", "second", "piece"]
    hot = rows.groupBy(key).count().where(F.col("count") > tile).select(*key, F.ceil(F.col("count") / tile).cast("int").alias("t"))
    hot.write.parquet(paths[1])
    hot = spark.read.parquet(paths[1])
    x = rows.join(hot, key, "left").withColumn("t", F.coalesce("t", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("t")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("t") - 1))
    left = x.where("NOT longer").select(*key, own.alias("i"), others.alias("j"), F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("letters").alias("l_a"))
    right = x.select(*key, others.alias("i"), own.alias("j"), "longer", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("letters").alias("l_b"))
    differ = F.bit_count(F.col("l_a").bitwiseXOR(F.col("l_b"))) <= 2
    first = F.col("second") & F.col("longer") & F.col("b").startswith(F.substr("a", F.lit(1), F.floor(F.col("length") / 2).cast("int")))
    one = (F.col("longer") | (F.col("a") < F.col("b"))) & differ & (F.levenshtein("a", "b", 1) == 1) & ~first
    return left.join(right, [*key, "i", "j"]).where(one).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form. Returns word and root, the last of the chain of forms, by pointer doubling: a chain whose counts
    at least double has fewer links than counts have bits, so a few rounds do. Each round is stored."""
    spark = forms.sparkSession
    path = scratch_path(spark, "roots")
    forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")).write.parquet(path)
    now = spark.read.parquet(path)
    while now.where("moved").limit(1).count():
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = scratch_path(spark, "roots")
        now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")).write.parquet(new)
        delete(spark, path)
        path, now = new, spark.read.parquet(new)
    return now.select("word", "root")


def variants(vocab: DataFrame, times: int = TIMES, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of vocab (word, n; words are distinct): the near word of largest n
    (ties: the first in code-point order) is the form, if its n is at least `times` the word's n; the root is the last of
    the chain of forms, or the word itself. Words without near words have n_near 0 and no form. Hot words: what a word
    has of near words is summed before it is shuffled. `times` is over 1, so that chains end."""
    if times <= 1:
        raise ValueError("times is over 1")
    spark, held = vocab.sparkSession, [scratch_path(vocab.sparkSession, "vocabulary")]
    vocab.write.parquet(held[0])
    vocab = spark.read.parquet(held[0])
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    links = near_pairs(vocab, tile, held).select(F.explode(both).alias("x")).select("x.*")
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    x = vocab.join(best, "word", "left")
    more = F.coalesce(-F.col("best.m") >= times * F.col("n"), F.lit(False))
    x = stored(
        x.select("word", F.when(more, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(more, -F.col("best.m")).alias("form_n")),
        "forms",
    )
    for path in held:
        delete(spark, path)
    end = roots(x.where("form IS NOT NULL"))
    return x.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(words(documents(spark, sf_dir))))


def _sql() -> str:
    """Near words by deleting each letter; CRC-32 byte by byte, with its table from the polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    bytes_ = "flatten(list_transform(string_split(head || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END))"
    step = f"lambda a, b: xor(a >> 8, CAST({table} AS BIGINT[])[CAST(xor(a & 255, b) AS BIGINT) + 1])"
    return f"""WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]{{{MIN_LETTERS},}}')) AS run FROM documents),
c AS (SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, CAST({bytes_} AS BIGINT[])), {step}), 4294967295::BIGINT) AS h FROM r),
e AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM c),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM e WHERE length(word) >= {MIN_LETTERS} GROUP BY 1 HAVING count(*) >= {MIN_COUNT}),
d AS MATERIALIZED (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word AS a, a.n AS m, b.word AS b, b.n AS n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word < b.word UNION SELECT a.word, a.n, b.word, b.n FROM d a JOIN w b ON a.rest = b.word),
l AS (SELECT a AS word, b AS near, n AS m FROM p UNION ALL SELECT b, a, m FROM p),
best AS (SELECT word, max(m) AS m, count(*) AS n_near FROM l GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.m >= {TIMES} * w.n THEN best.m END AS form_n,
 CASE WHEN best.m >= {TIMES} * w.n THEN (SELECT min(near) FROM l WHERE l.word = w.word AND l.m = best.m) END AS form FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)"""


OP11_SQL = _sql()
