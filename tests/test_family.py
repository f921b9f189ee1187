"""Family diagnostics against plain formulas, every reason why there are none, and evidence texts with every problem."""

import math
from decimal import Decimal
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest

from sparkfolio.operators import diagnostics
from sparkfolio.sources import evidence
from sparkfolio.sources.evidence import Field

KINDS = "candidate string, label int, value double"


def plain(m, manual=5):
    """m: candidate -> values in order of the labels."""
    names, n = sorted(m), len(next(iter(m.values())))
    x = {k: np.array(v) for k, v in m.items()}
    rho = min(1.0, max(0.0, float(np.mean([np.corrcoef(x[a], x[b])[0, 1] for a, b in combinations(names, 2)]))))
    n_eff = min(manual + len(names), manual + rho + (1 - rho) * len(names))
    sharpe = {k: v.mean() / v.std(ddof=1) for k, v in x.items()}
    spread = float(np.var(list(sharpe.values()), ddof=1))
    z, g = NormalDist().inv_cdf, 0.5772156649015329
    best = lambda t: math.sqrt(spread) * ((1 - g) * z(1 - 1 / t) + g * z(1 - 1 / (t * math.e)))
    dsr = {}
    for k, v in x.items():
        s = (v - v.mean()) / v.std(ddof=1)
        skew, kurt = (s**3).mean(), (s**4).mean()
        dsr[k] = [NormalDist().cdf((sharpe[k] - best(t)) * math.sqrt(n - 1) / math.sqrt(1 - skew * sharpe[k] + (kurt - 1) / 4 * sharpe[k] ** 2)) for t in (n_eff, manual + len(names))]
    return rho, n_eff, sharpe, dsr


def family(seed=3, items=8, labels=12, gap=0.0):
    r = np.random.default_rng(seed)
    common = r.normal(0, 1, labels)
    return {f"c{k}": (common + r.normal(0.1 * k + gap * (k == 7), 1, labels)).tolist() for k in range(items)}


def table(spark, m):
    return spark.createDataFrame([(k, 10 * at, float(v)) for k, vs in m.items() for at, v in enumerate(vs)], KINDS).repartition(3)


def test_diagnostics_like_plain_formulas(spark):
    m = family(gap=6.0)
    rows = {r["candidate"]: r for r in diagnostics.family_diagnostics(table(spark, m), "candidate", "label", "value", 8).collect()}
    rho, n_eff, sharpe, dsr = plain(m)
    assert rows.keys() == m.keys()
    for k, r in rows.items():
        assert r["status"] == "available" and r["rho_bar"] == pytest.approx(rho) and r["n_eff"] == pytest.approx(n_eff) and r["labels"] == 12
        assert r["sharpe"] == pytest.approx(sharpe[k]) and [r["dsr_effective"], r["dsr_nominal"]] == pytest.approx(dsr[k], abs=1e-9)
        assert r["dsr_ok"] == (dsr[k][0] >= 0.9) and r["pbo_ok"] == (r["pbo"] <= 0.2) and r["passed"] == (r["dsr_ok"] and r["pbo_ok"])
    assert rows["c7"]["passed"] and not rows["c0"]["passed"]


@pytest.mark.parametrize(
    "change, formal, reason",
    [
        (lambda m: m, 9, "8 candidates for 9"), (lambda m: {k: v[:3] for k, v in m.items()}, 8, "3 windows"), (lambda m: m | {"c1": m["c1"][:-1]}, 8, "95 cells of 96"),
        (lambda m: m | {"c1": [math.nan, *m["c1"][1:]]}, 8, "1 of them not finite"), (lambda m: m | {"c1": [math.inf, *m["c1"][1:]]}, 8, "1 of them not finite"), (lambda m: m | {"c1": [1.0] * 12}, 8, "correlations are undefined"),
        (lambda m: {k: m["c1"] for k in m}, 8, "do not vary"),
    ],
)
def test_reasons(spark, change, formal, reason):
    rows = diagnostics.family_diagnostics(table(spark, change(family())), "candidate", "label", "value", formal).collect()
    assert len(rows) == 1 and rows[0]["status"] == "unavailable" and reason in rows[0]["reason"] and rows[0]["candidate"] is None and rows[0]["passed"] is None


def test_shared_windows(spark):
    rows = [("x", "a", 1, 1.0), ("x", "a", 2, 2.0), ("x", "b", 2, 4.0), ("x", "b", 3, 9.0), ("y", "a", 2, 6.0), ("y", "b", 2, 8.0), ("y", "b", 1, 0.0)]
    cells = spark.createDataFrame(rows, "task string, candidate string, label int, value double")
    assert sorted(map(tuple, diagnostics.synchronized(cells, "task", "candidate", "label", "value").collect())) == [("a", 2, 4.0), ("b", 2, 6.0)]
    with pytest.raises(Exception, match="a cell comes twice"):
        diagnostics.synchronized(cells.unionByName(cells.limit(1)), "task", "candidate", "label", "value").collect()
    spans = spark.createDataFrame([("x", 1, 9), ("x", 3, 12), ("y", 2, 10)], "task string, a int, b int")
    assert list(map(tuple, diagnostics.common_bounds(spans, "task", "a", "b").collect())) == [(2, 10)]
    assert diagnostics.common_bounds(spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], spans.schema), "task", "a", "b").count() == 0


FIELDS = [Field("schema", "text", fixed="v1"), Field("n", "long"), Field("p", "decimal"), Field("names", "texts"), Field("ok", "flag", required=False), Field("inner", "object"), Field("inner.k", "long"), Field("inner.free", "object", required=False)]
GOOD = '{"schema": "v1", "n": 3, "p": 0.050, "names": ["a"], "inner": {"k": 1, "free": {"x": [1]}}}'


@pytest.mark.parametrize(
    "text, problems",
    [
        (GOOD, []), (GOOD.replace("0.050", "12345678901234567890.123456789012345678"), []), (GOOD.replace('["a"]', "[]"), []), (None, ["malformed"]), ("", ["malformed"]), ("[1]", ["malformed"]), ("{", ["malformed"]),
        (GOOD.replace('"n": 3', '"n": 3, "n": 4'), ["malformed"]), (GOOD.replace('"n": 3', '"n": 3, "z": 1, "y": 2'), ["unknown y", "unknown z"]), (GOOD.replace('"k": 1', '"k": 1, "w": 0'), ["unknown inner.w"]),
        (GOOD.replace('"n": 3, ', ""), ["missing n"]), (GOOD.replace('"k": 1, ', ""), ["missing inner.k"]), (GOOD.replace('"n": 3', '"n": "3"'), ["wrong n"]), (GOOD.replace('"n": 3', '"n": null'), ["wrong n"]), (GOOD.replace('"n": 3', '"n": 3.5'), ["wrong n"]),
        (GOOD.replace("0.050", "5e-2"), ["inexact p"]), (GOOD.replace("0.050", "0." + "1" * 60), ["inexact p"]), (GOOD.replace("0.050", "true"), ["wrong p"]), (GOOD.replace('["a"]', '["a", 1]'), ["wrong names"]),
        (GOOD.replace("v1", "v2"), ["fixed schema"]), (GOOD.replace('"k": 1', '"k": {}'), ["wrong inner.k"]), (GOOD.replace('{"k": 1, "free": {"x": [1]}}', "7"), ["wrong inner", "missing inner.k"]),
    ],
)
def test_evidence_problems(spark, text, problems):
    df = spark.createDataFrame([(1, text)], "id int, json string")
    assert evidence.checked(df, FIELDS).first()["problems"] == problems
    if problems:
        with pytest.raises(Exception, match="evidence is refused: " + problems[0]):
            evidence.typed(df, FIELDS).collect()
    else:
        r = evidence.typed(df, FIELDS, keep=["id"]).first()
        assert (r["id"], r["n"], r["inner_k"], r["ok"], r["inner_free"]) == (1, 3, 1, None, '{"x":[1]}')


def test_round_trip(spark):
    rows = [("v1", 5, Decimal("0.1"), ["x", "y"], True, 7), ("v1", -1, Decimal("123456789.000000000000000001"), [], None, 0)]
    fields = FIELDS[:7]
    df = spark.createDataFrame(rows, "schema string, n long, p decimal(38,18), names array<string>, ok boolean, inner_k long")
    back = evidence.typed(evidence.written(df, fields), fields)
    assert sorted(map(tuple, back.drop("inner").select(df.columns).collect()), key=str) == sorted(rows, key=str)
    with pytest.raises(ValueError):
        evidence.checked(df.withColumnRenamed("schema", "json"), [Field("a", "number")])


def test_variation_pbo_pools_shared_windows(spark):
    """Cells that one variation lacks don't shift the others; pooled windows in order make the matrix."""
    from sparkfolio.operators import monitoring, walkforward

    r = np.random.default_rng(6)
    rows = [(v, i, m, w, float(x)) for v in "pqrs" for i in "ab" for m in (18, 24) for w in range(5) for x in r.normal(0, 1, 1)]
    rows = [x for x in rows if x[:3] != ("q", "b", 24) and x[:4] != ("r", "a", 18, 2)]
    got = monitoring.variation_pbo(spark.createDataFrame(rows, "variation string, instrument string, train_months int, label int, value double").repartition(3)).first()
    kept = [(v, (i, m, w), x) for v, i, m, w, x in rows if (i, m) != ("b", 24) and (i, m, w) != ("a", 18, 2)]
    place = {s: k for k, s in enumerate(sorted({s for _, s, _ in kept}))}
    want = walkforward.pbo(spark.createDataFrame([(v, place[s], x) for v, s, x in kept], "variation string, at int, value double"), "variation", "at", "value").first()
    assert len(place) == 14 and (got["pbo"], got["splits"]) == (want["pbo"], want["splits"]) and got["splits"] == 252


def test_ranked_with_diagnostics(spark):
    from sparkfolio.operators import selection

    ranked = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "candidate string, mean double")
    told = spark.createDataFrame([("a", 0.9, 0.8), ("b", 0.8999999, 0.7)], "candidate string, dsr_effective double, dsr_nominal double")
    got = {r["candidate"]: (r["dsr"], r["dsr_ok"]) for r in selection.with_diagnostics(ranked, told, "candidate").collect()}
    assert got == {"a": (0.9, True), "b": (0.8999999, False), "c": (None, False)}


WINDOW = '{"window": "w1", "test_start_ns": 1, "test_end_ns": 5, "net_r_events": [[2, 0.5], [3, "-1.25"], [4, 7]]}'


def test_candidate_windows(spark):
    from sparkfolio.sources.windows import candidate_windows

    texts = spark.createDataFrame([("c", "m", f"[{WINDOW}, {WINDOW.replace('w1', 'w2').replace('[[2', '[[-2')}]"), ("c", "n", "[]"), ("d", "m", f"[{WINDOW}]")], "candidate string, market string, json string")
    got = {(r["candidate"], r["market"], r["window"]): r for r in candidate_windows(texts, ["candidate", "market"]).collect()}
    assert got.keys() == {("c", "m", "w1"), ("c", "m", "w2"), ("d", "m", "w1")}
    r = got["c", "m", "w1"]
    assert (r["test_start_ns"], r["test_end_ns"]) == (1, 5) and [tuple(e) for e in r["events"]] == [(2, Decimal("0.5")), (3, Decimal("-1.25")), (4, Decimal(7))]


@pytest.mark.parametrize(
    "text, reason",
    [
        (None, "not a list of windows"), (WINDOW, "not a list of windows"), ("[1", "not a list of windows"), ("[7]", "window 0: no object"), (f"[{WINDOW}, {WINDOW}]", "repeats window w1"), (f"[{WINDOW.replace(': 1,', ': 1.5,')}]", "window 0: test_start_ns"),
        (f"[{WINDOW.replace(': 5,', ': null,')}]", "window 0: test_end_ns"), (f"[{WINDOW.replace('[2, 0.5]', '[2]')}]", "window 0: net_r_events"), (f"[{WINDOW.replace('[2, 0.5]', '[2.5, 1]')}]", "window 0: net_r_events"),
        (f"[{WINDOW.replace('[2, 0.5]', '[2, true]')}]", "window 0: net_r_events"), (f"[{WINDOW.replace('-1.25', 'x')}]", "window 0: net_r_events"), (f"[{WINDOW.replace('[[2, 0.5], [3, ' + chr(34) + '-1.25' + chr(34) + '], [4, 7]]', '{}')}]", "window 0: net_r_events"),
    ],
)
def test_candidate_windows_refused(spark, text, reason):
    from sparkfolio.sources.windows import candidate_windows

    with pytest.raises(Exception, match=f"c/m: {reason}"):
        candidate_windows(spark.createDataFrame([("c", "m", text)], "candidate string, market string, json string"), ["candidate", "market"]).collect()


def test_windows_of_odd_trades(spark, monkeypatch):
    """Several years of a text in any order; trades without R are no events, wherever they stand, and may leave a window empty."""
    from datetime import datetime

    from sparkfolio.queries import family

    def rows(k, *trades):
        return [("b__train_18m", k, datetime(y, m, 1), r) for y, m, r in trades]

    trades = rows(1, (1999, 2, 0.5), (1997, 3, -1.25), (1999, 1, None), (1999, 5, 1e-6), (1997, 1, 2.0), (1998, 4, None)) + rows(2, (1969, 12, -0.5), (1969, 11, None), (1970, 1, 1.0))
    x = spark.createDataFrame(trades, "candidate string, k4 long, ts_closed timestamp_ntz, r double").repartition(3)
    monkeypatch.setattr(family.tb, "candidates", lambda *a: x)
    ns = lambda y, m: int((datetime(y, m, 1) - datetime(1970, 1, 1)).total_seconds()) * 10**9
    want = [(1, "1997", 2, 0.75, ns(1997, 1)), (1, "1998", 0, 0.0, None), (1, "1999", 2, 0.500001, ns(1999, 2)), (2, "1969", 1, -0.5, ns(1969, 12)), (2, "1970", 1, 1.0, 0)]
    assert sorted(tuple(r)[1:] for r in family.w14(spark, "").collect()) == want


def test_a_texts_events_meet_in_one_shuffle(spark, sf_dir):
    """Windows are written, read and checked for repeats where a text's events have met."""
    from sparkfolio.queries import family

    plan = family.w14(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


def test_the_trades_are_read_once_for_all_diagnostics(spark, sf_dir, monkeypatch):
    from sparkfolio.queries import family

    seen, whole = [], family.diagnostics.family_diagnostics
    monkeypatch.setattr(family.diagnostics, "family_diagnostics", lambda m, *a: seen.append(m.inputFiles()) or whole(m, *a))
    assert family.a32(spark, sf_dir).count() and not any("lineitem" in f for f in seen[0])
