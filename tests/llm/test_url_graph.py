"""op13 against a plain version: rules by hand, PageRank in whole units over dictionaries."""

import math
import random
import re

import pytest

from sparkfolio.llm import url_graph

SCHEMA = "page_id long, url string, html string, host string, rule string, side int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path, rules=url_graph.RULES):
    fit = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def brute(rows, rounds=20, damping=0.85, ratio=1.0):
    """rows: (id, url, html)."""
    judged = [(i, *parts(u), *ruled(*parts(u))) for i, u, _ in rows]
    links, seeds = {}, {}
    for (_, src, _, _, verdict), (_, _, html) in zip(judged, rows):
        if src and verdict:
            side = int(verdict == "block")
            seeds[side, src] = seeds.get((side, src), 0) + 1
        for dst in {parts("://" + m)[0] for m in re.findall(url_graph.LINK, html or "")} - {src}:
            if src:
                links[0, src, dst] = links.get((0, src, dst), 0) + 1
                links[1, dst, src] = links.get((1, dst, src), 0) + 1
    total, leaving = {}, {}
    for (side, _), n in seeds.items():
        total[side] = total.get(side, 0) + n
    for (side, src, _), n in links.items():
        leaving[side, src] = leaving.get((side, src), 0) + n
    seeds = {k: math.floor(1e15 * n / total[k[0]]) for k, n in seeds.items()}
    score = dict(seeds)
    for _ in range(rounds):
        got = {}
        for (side, src, dst), n in links.items():
            got[side, dst] = got.get((side, dst), 0) + math.floor(float(score.get((side, src), 0)) * (n / leaving[side, src]))
        score = {k: math.floor((1 - damping) * seeds.get(k, 0)) + math.floor(damping * got.get(k, 0)) for k in {*seeds, *got}}
    out = []
    for i, host, path, rule, verdict in judged:
        t, d = score.get((0, host), 0), score.get((1, host), 0)
        out.append((i, host, path, rule, verdict or ("block" if d > ratio * t else "allow"), t, d))
    return out


def same(df, want):
    order = lambda rows: sorted(tuple((x is not None, x) for x in r) for r in rows)
    assert order([tuple(r) for r in df.collect()]) == order(want)


def linked(*hosts):
    return "".join(f'<p><a class="x" href="{h}">t</a>' for h in hosts)


def test_query(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = url_graph.op13_url_filters(spark, sf_dir)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]
    same(got, brute(rows))


def test_rules(spark):
    cases = [
        ("http://a.com/x", "com/", "allow"), ("http://a.com", None, "allow"), ("HTTP://EXAMPLE.COM/en/1", "example.com/en/", "block"), ("http://www.example.com/en/?q", "www.example.com/en/", "allow"),
        ("http://m.www.example.com/en/", "www.example.com/en/", "allow"), ("http://notexample.com/en/", "com/", "allow"), ("http://example.com/EN/", "com/", "allow"), ("http://x.net/es/a#b", "net/es/", "block"),
        ("http://x.net/es", None, "block"), ("http://com:80/", None, "allow"), ("//a.com/x", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("a://", None, "allow"), ("x://y://com/", None, "allow"),
    ]
    rows = [(k, url, None) for k, (url, _, _) in enumerate(cases)] + [(99, "http://x.net/fr/", None)]
    df = url_graph.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["id"]: (r["rule"], r["verdict"]) for r in df.collect()}
    assert [got[k] for k in range(len(cases))] == [c[1:] for c in cases]
    same(df, brute(rows))


def test_scores_flow_over_links(spark):
    """A trusted host vouches for what it links to; a host that links to blocked pages is distrusted, its readers are not."""
    rows = [
        (1, "http://good.com/a", linked("http://friend.org/x", "//Friend.ORG/y", "/own", "mailto:x@y")), (2, "http://spam.net/es/", linked("http://victim.org/")),
        (3, "http://farm.org/", linked("https://spam.net/es/", "http://friend.org/")), (4, "http://friend.org/", linked("http://second.org/?a")), (5, "http://victim.org/", None),
        (6, "http://second.org/", "<A HREF = 'HTTP://good.com'> <link href=//FRIEND.org>"), (7, "http://alone.org/", ""), (None, None, linked("http://friend.org")), (None, None, None),
    ]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame([(*r, "h", "r", 3) for r in rows], SCHEMA).repartition(3)
    want = brute(rows)
    same(url_graph.judge(df), want)
    verdict = {h: v for _, h, _, _, v, _, _ in want}
    assert verdict["farm.org"] == "block" and verdict["friend.org"] == verdict["second.org"] == verdict["victim.org"] == verdict["alone.org"] == "allow"
    same(url_graph.judge(df, rounds=7, damping=0.5, ratio=0.01), brute(rows, 7, 0.5, 0.01))


def test_random_graph_with_a_hub(spark):
    r = random.Random(3)
    hosts = [f"h{k}.{t}" for k in range(30) for t in ("com", "net", "org")]
    rows = [(k, f"http://{r.choice(hosts)}/{r.choice(['es', 'en', 'fr'])}/", linked(*(f"http://{r.choice(hosts)}/" for _ in range(r.randint(0, 4))))) for k in range(200)]
    rows += [(1000 + k, "http://hub.org/", linked(*(f"http://{h}/" for h in hosts))) for k in range(60)] + [(2000 + k, f"http://{h}/", linked("http://hub.org")) for k, h in enumerate(hosts)]
    same(url_graph.judge(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)), brute(rows))


def test_empty_and_bad_rules(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert url_graph.judge(none).count() == 0
    for rules in ([("deny", "com", "/")], [("allow", "com", "/"), ("block", "com", "/")], [("allow", f"h{k}", "/") for k in range(1001)]):
        with pytest.raises(ValueError):
            url_graph.judge(none, rules)
    assert url_graph.judge(spark.createDataFrame([(1, "http://a.b/", None)], "page_id long, url string, html string"), []).first()["rule"] is None


def test_native_plan(spark, sf_dir):
    plan = url_graph.op13_url_filters(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
