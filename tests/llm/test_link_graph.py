"""Trust and distrust over host links, held against plain loops, and the URL filter's edge cases."""

import random

import pytest

from locusweave.llm import url_filters

PAGE = "page_id long, url string, html string"


def plain(edges, seeds, damping=0.85):
    """Personalised PageRank by loops until nothing moves."""
    total = sum(seeds.values())
    base = {h: s / total for h, s in seeds.items() if s}
    out, score = {}, dict(base)
    for (s, _), w in edges.items():
        out[s] = out.get(s, 0) + w
    for _ in range(400):
        now = {h: (1 - damping) * b for h, b in base.items()}
        for (s, d), w in edges.items():
            now[d] = now.get(d, 0) + damping * score.get(s, 0) * w / out[s]
        score = now
    return score


@pytest.mark.parametrize("seed", range(2))
def test_propagation_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    hosts = [f"h{i}.net" for i in range(14)]
    edges = {}
    for _ in range(40):
        a, b = rnd.sample(hosts, 2)
        edges[a, b] = edges.get((a, b), 0) + 1
    seeds = {h: rnd.randrange(3) for h in hosts[:5]} | {hosts[5]: 2}
    got = url_filters.propagate(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight long"), spark.createDataFrame(list(seeds.items()), "host string, seed long"))
    got, told = {r["host"]: r["score"] for r in got.collect()}, plain(edges, seeds)
    assert all(abs(got.get(h, 0) - told.get(h, 0)) < 1e-5 for h in hosts)


def test_verdicts_by_brute_force(spark):
    rnd = random.Random(5)
    good, bad, open_ = [f"g{i}.org" for i in range(3)], [f"b{i}.com" for i in range(3)], [f"u{i}.net" for i in range(12)]
    rows, edges, hosts = [], {}, {"good": {}, "bad": {}}
    for i in range(90):
        host = rnd.choice(good + bad + open_)
        links = rnd.choices(good + bad + open_, k=rnd.randrange(4))
        kind = "good" if host in good else "bad" if host in bad else None
        if kind:
            hosts[kind][host] = hosts[kind].get(host, 0) + 1
        rows.append((i, f"http://{host}/{'de/' if host in bad else ''}{i}", "".join(f'<a href="https://{x.upper()}/p?q">' for x in links) or None))
        for x in links:
            if x != host:
                edges[host, x] = edges.get((host, x), 0) + 1
    trust, distrust = plain(edges, hosts["good"]), plain({(d, s): w for (s, d), w in edges.items()}, hosts["bad"])
    pages = spark.createDataFrame(rows, PAGE)
    got = url_filters.judge_urls(pages).collect()
    sure = [r for r in got if r["host"] in open_ and abs(trust.get(r["host"], 0) - distrust.get(r["host"], 0)) > 1e-4]
    assert {r["verdict"] for r in sure} == {"allow", "block"}
    assert all((r["verdict"] == "block") == (distrust.get(r["host"], 0) > trust.get(r["host"], 0)) for r in sure)
    # Links out of a page and its copies weigh alike, so twice the table gives each verdict twice.
    twice = url_filters.judge_urls(pages.unionByName(pages)).collect()
    assert sorted(map(tuple, twice), key=str) == sorted([tuple(r) for r in got] * 2, key=str)


def test_distrust_reaches_far(spark):
    chain = [f"c{i}.net" for i in range(26)]
    rows = [(i, f"http://{h}/", f'<a href="http://{(chain + ["spam.com"])[i + 1]}/x">') for i, h in enumerate(chain)] + [(99, "http://spam.com/de/", "")]
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(spark.createDataFrame(rows, PAGE)).collect()}
    assert set(got.values()) == {"block"}


def test_edge_cases(spark):
    none = spark.createDataFrame([], PAGE)
    assert url_filters.judge_urls(none).count() == 0
    long = "<p>" + "x" * 2_000_000 + '<a href="http://spam.com/">'
    rows = [(1, "http://far.net/", long, "a", "b"), (2, "http://spam.com/de/1", None, None, None), (None, None, None, None, None)]
    got = url_filters.judge_urls(spark.createDataFrame(rows, PAGE + ", host string, verdict string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert {r["page_id"]: (r["host"], r["verdict"]) for r in got.collect()} == {1: ("far.net", "block"), 2: ("spam.com", "block"), None: ("", "allow")}
