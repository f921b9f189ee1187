"""URL filters: rules by host and path, and for what no rule judges trust and distrust that flow over the links
between hosts. Only DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, scratch_path

#: verdict, host, path. A rule fits its host and all subdomains where the url's path starts with the rule's.
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Rules are compiled into one expression.
MOST_RULES = 1000
#: Rounds of propagation, the share of a score that follows links, and the units that the seeds of a side have together
#: (whole numbers that doubles hold exactly, so results don't depend on the order of sums).
ROUNDS, DAMPING, UNITS = 20, 0.85, 10**15
#: Rounds between two written tables.
CUT = 5
#: A host is blocked if its distrust is more than so many times its trust.
RATIO = 1.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Attributes href with an absolute or protocol-relative address; the group is the host.
LINK = r"""[\x20\x09-\x0D"'/][Hh][Rr][Ee][Ff][\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^\x20\x09-\x0D"'<>/?#]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without :// and for null."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without :// and for null."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _first_fitting(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The rule with the longest text that fits, as a struct of verdict and rule; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    if len({(h, p) for _, h, p in rules}) < len(rules) or {v for v, _, _ in rules} - {"allow", "block"}:
        raise ValueError("rules are allow or block, and one for each host and path")
    found = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))))
    return F.coalesce(*found, F.lit(None).cast("struct<verdict:string,rule:string>"))


def by_rules(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, rule and the rule's verdict, both null where none fits."""
    x = pages.select(pages[id_col].alias("id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    return x.withColumn("r", _first_fitting(rules, F.col("host"), F.col("path"))).select("id", "host", "path", "r.rule", "r.verdict")


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, pages: how many pages of one host link to another host. Repeated links of a page count once."""
    found = F.transform(F.regexp_extract_all(pages[html], F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER))
    x = pages.select(host_of(pages[url]).alias("src"), F.explode(F.array_distinct(found)).alias("dst"))
    return x.where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("pages"))


def _edges(links: DataFrame) -> DataFrame:
    """side, src, dst, share: trust (0) follows the links, distrust (1) goes back along them; the share is of all that
    leaves src on that side."""
    both = links.select(F.lit(0).alias("side"), "src", "dst", "pages").unionByName(links.select(F.lit(1).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "pages"))
    leaving = both.groupBy("side", "src").agg(F.sum("pages").alias("leaving"))
    return both.join(leaving, ["side", "src"]).select("side", "src", "dst", (F.col("pages").cast("double") / F.col("leaving").cast("double")).alias("share"))


def _seeds(judged: DataFrame) -> DataFrame:
    """side, host, seed: the allowed pages of a host are its share of all trust, the blocked ones of all distrust."""
    x = judged.where("verdict IS NOT NULL AND host <> ''").groupBy((F.col("verdict") == "block").cast("int").alias("side"), "host").agg(F.count("*").alias("n"))
    total = x.groupBy("side").agg(F.sum("n").alias("total"))
    return x.join(F.broadcast(total), "side").select("side", "host", F.floor(F.lit(float(UNITS)) * F.col("n").cast("double") / F.col("total").cast("double")).alias("seed"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """side, host, score: personalised PageRank by power iteration. A score is (1 - damping) of the host's own seed and
    damping of what its neighbours hand on, in whole units rounded down; what a host without links would hand on is
    lost. Each round is a join on the sending host and a sum by the receiving one, summed before the shuffle; a host
    with very many links is a hot key of that join, which Spark splits. Every CUT rounds the scores are written, which
    cuts lineage, and the rounds end once they no longer change (a fixed point, so later rounds would not change them).
    """
    spark = links.sparkSession
    held = [scratch_path(spark, "edges"), scratch_path(spark, "seeds")]
    _edges(links).write.parquet(held[0])
    seeds.select("side", "host", "seed").write.parquet(held[1])
    edges, seeds = spark.read.parquet(held[0]), spark.read.parquet(held[1])
    own = seeds.select("side", "host", F.lit(0).cast("long").alias("got"), "seed")
    scores, mark = seeds.select("side", "host", F.col("seed").alias("score")), None
    for k in range(rounds):
        got = F.floor(F.col("score").cast("double") * F.col("share"))
        x = scores.withColumnRenamed("host", "src").join(edges, ["side", "src"]).select("side", F.col("dst").alias("host"), got.alias("got"), F.lit(0).cast("long").alias("seed"))
        kept = F.floor(F.lit(1 - damping) * F.sum("seed").cast("double")) + F.floor(F.lit(damping) * F.sum("got").cast("double"))
        scores = x.unionByName(own).groupBy("side", "host").agg(kept.cast("long").alias("score")).where("score > 0")
        if (k + 1) % CUT == 0 or k + 1 == rounds:
            path = scratch_path(spark, "scores")
            scores.write.parquet(path)
            scores = spark.read.parquet(path)
            held.append(path)
            new = scores.agg(F.count("*"), F.sum(F.xxhash64("side", "host", "score").cast("decimal(38,0)"))).first()
            if new == mark:
                break
            mark = new
    for path in held[:-1]:
        delete(spark, path)
    return scores


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url: str = "url", html: str = "html", rounds: int = ROUNDS, damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    """id, host, path, rule, verdict, trust, distrust: one row for each row of pages. The verdict is the longest fitting
    rule's; without one the page is blocked if its host's distrust is more than ratio times its trust, else allowed, so
    hosts that neither reaches are allowed. A url that is null or has no :// has an empty host and path: no rule fits
    it, it sends and receives nothing and is allowed. Null html has no links. Rows may repeat, ids may be null; each row
    counts. Other columns of pages, whatever their names, are not read. Hot hosts: sums are partial before they are
    shuffled, and the last join, of all pages on their host, is one that Spark splits."""
    judged = by_rules(pages, rules, id_col, url)
    scores = propagate(host_links(pages, url, html), _seeds(judged), rounds, damping)
    side = lambda k: F.sum(F.when(F.col("side") == k, F.col("score")).otherwise(0))
    hosts = scores.groupBy("host").agg(side(0).alias("trust"), side(1).alias("distrust"))
    x = judged.join(hosts, "host", "left").select("id", "host", "path", "rule", "verdict", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("trust", "distrust")))
    method = F.when(F.col("distrust").cast("double") > F.lit(ratio) * F.col("trust").cast("double"), "block").otherwise("allow")
    return x.withColumn("verdict", F.coalesce("verdict", method))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")


def _sql() -> str:
    """The same rounds spelled out."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{of(v, h, p)}'" for v, h, p in order) + " END"
    pattern = LINK.replace("'", "''")
    rounds = "".join(
        f""",
s{k + 1} AS MATERIALIZED (SELECT side, host, CAST(floor({1 - DAMPING!r}::DOUBLE * CAST(sum(seed) AS DOUBLE)) + floor({DAMPING!r}::DOUBLE * CAST(sum(got) AS DOUBLE)) AS BIGINT) AS score FROM (
 SELECT side, dst AS host, CAST(floor(CAST(score AS DOUBLE) * share) AS BIGINT) AS got, 0 AS seed FROM s{k} JOIN edges USING (side, src) UNION ALL SELECT side, host, 0, seed FROM seeds) GROUP BY 1, 2 HAVING score > 0)""".replace(f"FROM s{k} JOIN", f"FROM (SELECT side, host AS src, score FROM s{k}) JOIN")
        for k in range(ROUNDS)
    )
    return f"""WITH a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
judged AS MATERIALIZED (SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS verdict FROM b),
links AS (SELECT src, dst, count(*) AS pages FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{pattern}', 1), lambda h: translate(h, '{UPPER}', '{LOWER}')))) AS dst FROM b) WHERE src <> '' AND src <> dst GROUP BY 1, 2),
ways AS (SELECT 0 AS side, src, dst, pages FROM links UNION ALL SELECT 1, dst, src, pages FROM links),
edges AS MATERIALIZED (SELECT side, src, dst, CAST(pages AS DOUBLE) / CAST(sum(pages) OVER (PARTITION BY side, src) AS DOUBLE) AS share FROM ways),
counted AS (SELECT CASE verdict WHEN 'block' THEN 1 ELSE 0 END AS side, host, count(*) AS n FROM judged WHERE verdict IS NOT NULL AND host <> '' GROUP BY 1, 2),
seeds AS MATERIALIZED (SELECT side, host, CAST(floor({float(UNITS)}::DOUBLE * CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY side) AS DOUBLE)) AS BIGINT) AS seed FROM counted),
s0 AS (SELECT side, host, seed AS score FROM seeds){rounds},
hosts AS (SELECT host, sum(CASE WHEN side = 0 THEN score ELSE 0 END) AS trust, sum(CASE WHEN side = 1 THEN score ELSE 0 END) AS distrust FROM s{ROUNDS} GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > {RATIO!r} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust
FROM judged LEFT JOIN hosts USING (host)"""


OP13_SQL = _sql()
