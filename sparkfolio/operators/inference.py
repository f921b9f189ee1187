"""Resampling and multiple testing: block lengths, stationary bootstrap, SPA, step-down, confidence sets, Kelly."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED, REPLICATIONS = 20260719, 10_000
#: Fixed value: the largest share of capital that the worst value may take.
SOLVENT = 0.98
#: Replications that one task draws.
CHUNK = 500


def autocovariances(x: np.ndarray, most: int) -> np.ndarray:
    """Of lags 0 to most, divided by the length."""
    d = x - x.mean()
    return np.correlate(d, d, "full")[len(x) - 1 : len(x) + most] / len(x)


def _memory(rho: np.ndarray, n: int, run: int) -> int:
    """The lag after which `run` correlations in a row are insignificant; the last one if none is."""
    small = np.abs(rho[1:]) < 2 * np.sqrt(np.log10(n) / n)
    if len(small) < run:
        return len(rho) - 1
    calm = np.lib.stride_tricks.sliding_window_view(small, run).all(axis=1)
    return int(calm.argmax()) + 1 if calm.any() else len(rho) - 1


def block_length(x: np.ndarray) -> float:
    """Mean block length of the stationary bootstrap: (G / g)^(2/3) n^(1/3), where g is the spectrum at 0 and G its
    first moment, both through the flat-top window of twice the memory (Politis and White 2004, corrected by Patton,
    Politis and White 2009). At least 1, with no upper bound; infinite where the spectrum vanishes and its moment
    doesn't; 1 for constant returns."""
    n = len(x)
    if np.ptp(x) == 0:
        return 1.0
    run = max(5, int(np.log10(n)))
    most = min(n - 1, run + int(np.ceil(np.sqrt(n))))
    gamma = autocovariances(x, most)
    width = min(most, 2 * _memory(gamma / gamma[0], n, run))
    k = np.arange(-width, width + 1)
    window = np.clip(2 - 2 * np.abs(k) / width, 0, 1) * gamma[np.abs(k)]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.float64(np.abs(k) @ window) / window.sum()
    return 1.0 if np.isnan(ratio) else max(1.0, float(np.cbrt(n * ratio * ratio)))


def common_block_length(series: list[np.ndarray]) -> int:
    """The largest of the series' block lengths, rounded up; refused beyond a tenth of their length."""
    longest = max(block_length(x) for x in series)
    if not longest <= len(series[0]) // 10:
        raise ValueError(f"a block length of {longest:.4g} needs more than {len(series[0])} days")
    return math.ceil(longest)


def indices(n: int, mean_block: float, replications: int, seed: int, chunk: int = 0) -> np.ndarray:
    """replications x n source rows of the stationary bootstrap: uniform starts, geometric blocks, circular."""
    rng = np.random.default_rng([seed, chunk])
    fresh = rng.random((n, replications)) < 1 / mean_block
    starts = rng.integers(0, n, (n, replications))
    out = np.empty((n, replications), np.int64)
    out[0] = starts[0]
    for t in range(1, n):
        out[t] = np.where(fresh[t], starts[t], (out[t - 1] + 1) % n)
    return out.T


def bootstrap(spark: SparkSession, matrix: np.ndarray, mean_block: float, replications: int = REPLICATIONS, seed: int = SEED) -> DataFrame:
    """chunk, size and means: each replication's column means of the resampled matrix (days x candidates, a small
    table, sent once), as float64 bytes, row by row. Chunks carry their own seeds, so tasks can be run again. The
    order of draws is this package's own: no published sequence is repeated."""
    shared, n = spark.sparkContext.broadcast(matrix), len(matrix)
    sizes = [(c, min(CHUNK, replications - c * CHUNK)) for c in range(math.ceil(replications / CHUNK))]

    def run(it):
        for pdf in it:
            for c, size in zip(pdf["chunk"], pdf["size"]):
                rows = indices(n, mean_block, size, seed, int(c))
                means = np.stack([np.bincount(r, minlength=n) @ shared.value / n for r in rows])
                yield pd.DataFrame({"chunk": [c], "size": [size], "means": [means.tobytes()]})

    table = spark.createDataFrame(sizes, "chunk long, size long").repartition(max(1, len(sizes)))
    return table.mapInPandas(run, "chunk long, size long, means binary")


def _summed(drawn: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of f over all chunks of drawn means: each task sends one array of the family's size."""

    def run(it):
        total = 0
        for pdf in it:
            for size, data in zip(pdf["size"], pdf["means"]):
                total = total + f(np.frombuffer(data).reshape(size, -1))
        if not np.isscalar(total):
            yield pd.DataFrame({"x": [np.asarray(total, float).tolist()]})

    x = drawn.mapInPandas(run, "x array<double>").select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in x.orderBy("at").collect()])


def long_run_variances(x: np.ndarray, mean_block: float) -> np.ndarray:
    """Of each column's mean times sqrt(n), with the stationary bootstrap's weights over all lags."""
    n, q = len(x), 1 / mean_block
    d = x - x.mean(axis=0)
    k = np.arange(1, n)
    w = (1 - k / n) * (1 - q) ** k + k / n * (1 - q) ** (n - k)
    auto = np.stack([(d[: n - i] * d[i:]).sum(axis=0) / n for i in k]) if n > 1 else np.zeros((0, x.shape[1]))
    return (d * d).sum(axis=0) / n + 2 * (w[:, None] * auto).sum(axis=0)


def studentized(means: np.ndarray, boot: np.ndarray, variances: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    s = np.sqrt(variances / n)
    return means / s, (boot - means) / s


class Family:
    """Superior predictive ability, step-down and model confidence set of one family of candidates, whose means the
    same replications resample. What is compared is fixed before the counting: observed scores, the step-down's
    order, the set's order of elimination. count() is what a task does with its replications."""

    def __init__(self, names: list[str], means: np.ndarray, variances: np.ndarray, n: int, spread: np.ndarray):
        """spread: the mean square of (difference drawn - difference observed) for every two candidates."""
        if (variances <= 0).any():
            raise ValueError("a candidate without variance")
        self.names, self.means, self.se = names, means, np.sqrt(variances / n)
        self.score = means / self.se
        rank = {k: i for i, k in enumerate(sorted(names))}
        self.down = np.array(sorted(range(len(names)), key=lambda i: (-self.score[i], rank[names[i]])))
        self.centre = np.where(self.score > -math.sqrt(2 * math.log(math.log(n))), means, 0.0)
        self.top = max(0.0, self.score.max())
        gap = means[:, None] - means[None, :]
        if ((spread == 0) & (gap != 0)).any():
            raise ValueError("two candidates differ by a constant")
        self.sd = np.sqrt(np.where(spread > 0, spread, 1.0))
        self.gap, left, out, self.widest = gap / self.sd, list(range(len(names))), [], []
        while len(left) > 1:
            worst = min(left, key=lambda i: (self.gap[i, left].min(), rank[names[i]]))
            self.widest.append(self.gap[np.ix_(left, left)].max())
            left.remove(worst)
            out.append(worst)
        self.out = np.array(out + left)

    @staticmethod
    def squares(drawn: np.ndarray, means: np.ndarray) -> np.ndarray:
        """Sums over replications for the spread, flat: sum (a - b)^2 from sums of products."""
        d = drawn - means
        own, both = (d * d).sum(axis=0), d.T @ d
        return np.maximum(own[:, None] + own[None, :] - 2 * both, 0).ravel()

    def count(self, drawn: np.ndarray) -> np.ndarray:
        """How many replications reach the observed: SPA, each step down, each elimination."""
        best = np.maximum(0, ((drawn - self.centre) / self.se).max(axis=1)) >= self.top
        z = ((drawn - self.means) / self.se)[:, self.down]
        rest = np.maximum.accumulate(z[:, ::-1], axis=1)[:, ::-1]  # the largest of what remains at each step
        range_, reached = np.zeros(len(drawn)), []
        for k in range(len(self.out) - 2, -1, -1):
            i, later = self.out[k], self.out[k + 1 :]
            moved = (drawn[:, [i]] - drawn[:, later]) - (self.means[i] - self.means[later])
            range_ = np.maximum(range_, (np.abs(moved) / self.sd[i, later]).max(axis=1))
            reached.append((range_ >= self.widest[k]).sum())
        return np.concatenate([[best.sum()], (rest >= self.score[self.down]).sum(axis=0), reached[::-1]])

    def decided(self, counts: np.ndarray, replications: int) -> list[tuple[str, float, float, float, float]]:
        """name, mean, step-down p, confidence set p (1 for the last one left) and the family's SPA p."""
        p, m = (counts + 1) / (replications + 1), len(self.names)
        down, kept = np.empty(m), np.ones(m)
        down[self.down] = np.maximum.accumulate(p[1 : m + 1])
        kept[self.out[:-1]] = np.maximum.accumulate(p[m + 1 :]) if m > 1 else 1.0
        return [(k, float(self.means[i]), float(down[i]), float(kept[i]), float(p[0])) for i, k in enumerate(self.names)]


def family_tests(spark: SparkSession, matrix: np.ndarray, names: list[str], mean_block: float, replications: int = REPLICATIONS, seed: int = SEED) -> DataFrame:
    """candidate, mean, stepdown_p, mcs_p, spa_p. Two passes over the replications, both in tasks: the spread of every
    two candidates, then the counts."""
    drawn, means = bootstrap(spark, matrix, mean_block, replications, seed).cache(), matrix.mean(axis=0)
    spread = _summed(drawn, lambda x: Family.squares(x, means)).reshape(len(names), -1) / replications
    family = Family(names, means, long_run_variances(matrix, mean_block), len(matrix), spread)
    rows = family.decided(_summed(drawn, family.count), replications)
    drawn.unpersist()
    return spark.createDataFrame(rows, "candidate string, mean double, stepdown_p double, mcs_p double, spa_p double")


def spa_by_length(spark: SparkSession, matrix: np.ndarray, names: list[str], fixed: tuple[int, ...] = (5, 10, 20, 60), replications: int = REPLICATIONS, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """label, block, statistic, spa_p, passes, all_pass: superior predictive ability at the family's own block length, refused
    beyond a tenth of the days (see common_block_length), and at the fixed ones; the family passes where it passes at
    all of them. One job: a row for each length and chunk of replications, whose counts are summed."""
    lengths = [("selected", common_block_length(list(matrix.T))), *((f"fixed_{b}", b) for b in fixed)]
    n, means = len(matrix), matrix.mean(axis=0)
    judged = {}
    for _, block in lengths:
        se = np.sqrt(long_run_variances(matrix, block) / n)
        if not (se > 0).all():
            raise ValueError(f"candidates without variance: {', '.join(k for k, s in zip(names, se) if not s > 0)}")
        judged[block] = (np.where(means / se > -math.sqrt(2 * math.log(math.log(n))), means, 0.0), se, max(0.0, float((means / se).max())))
    shared = spark.sparkContext.broadcast((matrix, judged))
    rows = [(b, c, min(CHUNK, replications - c * CHUNK)) for b in judged for c in range(math.ceil(replications / CHUNK))]

    def run(it):
        x, by = shared.value
        for pdf in it:
            for b, c, size in zip(pdf["block"], pdf["chunk"], pdf["size"]):
                centre, se, top = by[int(b)]
                drawn = np.stack([np.bincount(r, minlength=len(x)) @ x / len(x) for r in indices(len(x), float(b), int(size), seed, int(c))])
                yield pd.DataFrame({"block": [b], "reached": [int((np.maximum(0, ((drawn - centre) / se).max(axis=1)) >= top).sum())]})

    counted = spark.createDataFrame(rows, "block long, chunk long, size long").repartition(len(rows)).mapInPandas(run, "block long, reached long")
    p = counted.groupBy("block").agg(((F.sum("reached") + 1) / (replications + 1)).alias("spa_p"))
    said = spark.createDataFrame([(label, b, judged[b][2]) for label, b in lengths], "label string, block long, statistic double")  # a row a length
    x = said.join(p, "block").withColumn("passes", F.col("spa_p").cast("decimal(38,18)") <= F.lit(str(alpha)).cast("decimal(38,18)"))
    every = x.agg(F.bool_and("passes").alias("all_pass")).withColumn("one", F.lit(1))
    return x.withColumn("one", F.lit(1)).join(F.broadcast(every), "one").select("label", "block", "statistic", "spa_p", "passes", "all_pass")


def probabilistic_sharpe(n: int, sharpe: float, skew: float, kurt: float, benchmark: float) -> float | None:
    spread = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    return NormalDist().cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread)) if n >= 3 and spread > 0 else None


def expected_max_sharpe(trials: int, variance: float) -> float:
    gamma, z = 0.5772156649015329, NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - gamma) * z(1 - 1 / trials) + gamma * z(1 - 1 / (trials * math.e))) if trials > 1 else 0.0


def deflated_sharpe(moments: DataFrame, trials: int, variance: float) -> DataFrame:
    """moments: n, sharpe, skew, kurt and keys. Adds psr (against 0) and dsr (against the best of many trials)."""
    bench = expected_max_sharpe(trials, variance)

    @F.pandas_udf("psr double, dsr double")
    def f(n: pd.Series, s: pd.Series, sk: pd.Series, ku: pd.Series) -> pd.DataFrame:
        rows = list(zip(n, s, sk, ku))
        return pd.DataFrame({"psr": [probabilistic_sharpe(*r, 0.0) for r in rows], "dsr": [probabilistic_sharpe(*r, bench) for r in rows]})

    return moments.withColumn("__p", f("n", "sharpe", "skew", "kurt")).select("*", "__p.psr", "__p.dsr").drop("__p")


def clopper_pearson_upper(events: int, trials: int, confidence: float = 0.95) -> float:
    """One-sided exact upper bound of a probability: where at most `events` of `trials` has the chance 1 - confidence.
    Newton's steps on the binomial distribution function, whose slope is the density of a beta variable."""
    if events >= trials:
        return 1.0
    k = np.arange(events + 1)
    choose = np.array([math.lgamma(trials + 1) - math.lgamma(i + 1) - math.lgamma(trials - i + 1) for i in k])
    low, high, p = 0.0, 1.0, (events + 1) / (trials + 1)
    for _ in range(200):
        terms = np.exp(choose + k * math.log(p) + (trials - k) * math.log1p(-p))
        over = math.fsum(terms) - (1 - confidence)
        low, high = (p, high) if over > 0 else (low, p)
        slope = terms[-1] * (trials - events) / (1 - p)
        step = p + over / slope if slope > 0 else low  # far from the root the slope vanishes
        step = float(step) if low < step < high else (low + high) / 2
        if step in (p, low, high):
            break
        p = step
    return p


def kelly_fraction(r: np.ndarray, alpha: float, beta: float, most: float = 0.05) -> float:
    """The growth-optimal fraction whose chance to fall to alpha of the start is at most beta: E[(1 + f r)^-lambda] <= 1
    with lambda = ln(beta) / ln(alpha). 0 for fewer than two values. The worst value leaves some capital (SOLVENT)."""
    if len(r) < 2:
        return 0.0
    lam = math.log(beta) / math.log(alpha)
    cap = min(most, SOLVENT / -r.min()) if r.min() < 0 else most

    def risk(f: float) -> float:
        return float(np.mean((1 + f * r) ** -lam)) - 1

    if r.mean() <= 0:
        return 0.0
    if risk(cap) > 0:
        lo, hi = 0.0, cap
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if risk(mid) <= 0 else (lo, mid)
        cap = lo
    lo, hi, g = 0.0, cap, (math.sqrt(5) - 1) / 2
    growth = lambda f: float(np.mean(np.log1p(f * r)))
    for _ in range(100):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if growth(a) >= growth(b) else (a, hi)
    return (lo + hi) / 2
