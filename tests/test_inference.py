"""Published values and hand-computed cases of the statistical operators."""

import math

import numpy as np
import pytest

from sparkfolio.operators import inference as inf


def test_block_length():
    cases = [(np.arange(2.0), 1.0), (np.array([1.0, -1, 1]), 3.634241185664279), (np.array([1.0, -1, 1, -1]), 1.587401051968198), (np.arange(5.0), 1.3049558803896213), (np.arange(6.0), 1.1447142425533319)]
    for values, want in cases:
        assert inf.block_length(values) == pytest.approx(want, rel=1e-12)


def test_clopper_pearson():
    for k, want in ((0, 0.258865550893052), (1, 0.394163302436505), (5, 0.777558898991871), (10, 1.0)):
        assert inf.clopper_pearson_upper(k, 10) == pytest.approx(want, rel=1e-12)


def test_stepdown():
    drawn = np.array([[4, 0, 0], [0, 2.5, 0], [0, 0, 1.5], [0, 0, 0]], float) + np.array([3.0, 2, 1])
    f = inf.Family(["a", "b", "c"], np.array([3.0, 2, 1]), np.full(3, 100.0), 100, np.ones((3, 3)))
    assert [x[2] for x in f.decided(f.count(drawn), 4)] == pytest.approx([0.4, 0.4, 0.4])
    obs, b = inf.studentized(np.array([0.1, -0.2]), np.array([[0.2, -0.1], [0, -0.4]]), np.array([1.0, 4.0]), 100)
    assert obs == pytest.approx([1, -1]) and b == pytest.approx(np.array([[1, 0.5], [-1, -1]]))
    with pytest.raises(ValueError):
        inf.Family(["a", "b"], np.array([1.0, 2]), np.array([1.0, 0]), 100, np.ones((2, 2)))


def test_indices_are_circular_blocks():
    x = inf.indices(50, 5.0, 400, 1)
    follow = (x[:, 1:] == (x[:, :-1] + 1) % 50).mean()
    assert x.min() == 0 and x.max() == 49 and abs(follow - (0.8 + 0.2 / 50)) < 0.02
    assert (x == inf.indices(50, 5.0, 400, 1)).all() and (x != inf.indices(50, 5.0, 400, 2)).any()


def test_long_run_variance_is_the_bootstrap_variance():
    x = np.random.default_rng(4).normal(size=(60, 2)).cumsum(axis=0) * 0.1
    drawn = x[inf.indices(60, 6.0, 20_000, 9)].mean(axis=1)
    assert drawn.var(axis=0) * 60 == pytest.approx(inf.long_run_variances(x, 6.0), rel=0.05)


def plain_family(means, boot, variances, n):
    """SPA, step-down and confidence set one replication and one pair at a time."""
    m, reps, se = len(means), len(boot), [math.sqrt(v / n) for v in variances]
    t = [means[i] / se[i] for i in range(m)]
    keep = [means[i] if t[i] > -math.sqrt(2 * math.log(math.log(n))) else 0.0 for i in range(m)]
    spa = sum(max(0, *((b[i] - keep[i]) / se[i] for i in range(m))) >= max(0, *t) for b in boot)
    down, left, least = {}, list(range(m)), 0.0
    while left:
        i = max(left, key=lambda k: (t[k], -k))
        least = max(least, (sum(max((b[k] - means[k]) / se[k] for k in left) >= t[i] for b in boot) + 1) / (reps + 1))
        down[i] = least
        left.remove(i)
    dev = lambda b, i, j: (b[i] - b[j]) - (means[i] - means[j])
    sd = {(i, j): math.sqrt(sum(dev(b, i, j) ** 2 for b in boot) / reps) or 1.0 for i in range(m) for j in range(m)}
    kept, left, least = {}, list(range(m)), 0.0
    while len(left) > 1:
        pairs = [(i, j) for i in left for j in left if i != j]
        widest = max((means[i] - means[j]) / sd[i, j] for i, j in pairs)
        least = max(least, (sum(max(abs(dev(b, i, j)) / sd[i, j] for i, j in pairs) >= widest for b in boot) + 1) / (reps + 1))
        worst = min(left, key=lambda i: (min((means[i] - means[j]) / sd[i, j] for j in left), i))
        kept[worst] = least
        left.remove(worst)
    kept[left[0]] = 1.0
    return [(down[i], kept[i], (spa + 1) / (reps + 1)) for i in range(m)]


def test_family_tests(spark):
    rng = np.random.default_rng(8)
    x, names = rng.normal(0, 1, (120, 5)) + np.array([0.4, 0.0, 0.1, -0.5, 0.3]), list("abcde")
    got = inf.family_tests(spark, x, names, 3.0, 1200, 2).orderBy("candidate").collect()
    boot = np.concatenate([x[inf.indices(120, 3.0, size, 2, c)].mean(axis=1) for c, size in enumerate((500, 500, 200))])
    want = plain_family(x.mean(axis=0), boot, inf.long_run_variances(x, 3.0), 120)
    for r, w in zip(got, want):
        assert (r["stepdown_p"], r["mcs_p"], r["spa_p"]) == pytest.approx(w, abs=1e-12)
    assert got[0]["stepdown_p"] < 0.05 and got[3]["mcs_p"] < 0.05 and got[0]["mcs_p"] == 1.0


def test_sharpe_and_kelly():
    assert inf.probabilistic_sharpe(2, 0.1, 0, 3, 0) is None
    assert inf.probabilistic_sharpe(101, 0.2, 0, 3, 0.0) == pytest.approx(0.5 * (1 + math.erf(0.2 * 10 / math.sqrt(1.02) / math.sqrt(2))))
    assert inf.expected_max_sharpe(1, 1.0) == 0 and 2.4 < inf.expected_max_sharpe(100, 1.0) < 2.6
    assert inf.kelly_fraction(np.array([-1.0, -1, 1]), 0.9, 0.05) == 0
    f = inf.kelly_fraction(np.array([-1.0, 1.2] * 50), 0.5, 0.5, most=0.5)
    assert 0 < f <= 0.5 and np.mean((1 + f * np.array([-1.0, 1.2])) ** -1.0) <= 1 + 1e-9
    assert inf.kelly_fraction(np.array([5.0]), 0.9, 0.05) == 0 and inf.kelly_fraction(np.array([-1.0, 50.0]), 0.01, 0.99, most=5.0) <= 0.98


def test_spa_at_every_length(spark):
    rng = np.random.default_rng(12)
    x, names = rng.normal(0, 1, (200, 4)) + np.array([0.0, 0.35, -0.2, 0.1]), list("abcd")
    got = {r["label"]: r for r in inf.spa_by_length(spark, x, names, (5, 60), 1100, 3).collect()}
    assert got.keys() == {"selected", "fixed_5", "fixed_60"} and got["selected"]["block"] == inf.common_block_length(list(x.T))
    for r in got.values():
        alone = inf.family_tests(spark, x, names, float(r["block"]), 1100, 3).first()
        assert r["spa_p"] == pytest.approx(alone["spa_p"], abs=1e-12) and r["passes"] == (r["spa_p"] <= 0.05)
        assert r["all_pass"] == all(v["passes"] for v in got.values())
    with pytest.raises(ValueError, match="block length"):
        inf.spa_by_length(spark, np.cumsum(x, axis=0)[:40], names, (5,), 50, 3)
    with pytest.raises(ValueError, match="without variance: a"):
        inf.spa_by_length(spark, np.concatenate([np.ones((200, 1)), x[:, 1:]], axis=1), names, (5,), 50, 3)
