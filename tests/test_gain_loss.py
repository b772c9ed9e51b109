"""Gain and loss along a tree, held against a plain rise of state sets."""

import random
from itertools import combinations

import pytest

from locusweave.operators import profiles


def grown(rnd, tips):
    """A random tree as (parent, child) with two or three children a node."""
    live, edges, k = [f"t{i}" for i in range(tips)], [], 0
    while len(live) > 1:
        took = [live.pop(rnd.randrange(len(live))) for _ in range(min(len(live), rnd.choice([2, 2, 3])))]
        edges += [(f"n{k}", c) for c in took]
        live.append(f"n{k}")
        k += 1
    return edges


def states(edges, present):
    kids = {}
    for p, c in edges:
        kids.setdefault(p, []).append(c)

    def rise(node):
        if node not in kids:
            found[node] = {1} if node in present else {0}
        else:
            below = [rise(c) for c in kids[node]]
            found[node] = set.intersection(*below) or set.union(*below)
        return found[node]

    found = {}
    rise(next(p for p, _ in edges if p not in {c for _, c in edges}))
    return {n: min(s) for n, s in found.items()}


@pytest.mark.parametrize("seed", range(3))
def test_gain_loss_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    edges = grown(rnd, 11)
    held = {r: {f"t{i}" for i in range(11) if rnd.random() < 0.4} for r in "abcdef"} | {"none": set()}
    moved = {r: {c for p, c in edges if states(edges, held[r])[p] != states(edges, held[r])[c]} for r in held}
    rows = [(r, f"t{i}", 1 if f"t{i}" in held[r] else 0) for r in held for i in range(11) if f"t{i}" in held[r] or i % 2] + [("a", "elsewhere", 1)]
    tips = spark.createDataFrame(rows + rows[:5], "r string, tip string, s int")
    changes = profiles.branch_changes(tips, spark.createDataFrame(edges, "parent string, child string"), "r", "tip", "s")
    assert sorted((x["r"], x["child"]) for x in changes.collect()) == sorted((r, c) for r in moved for c in moved[r])
    told = {(a, b): (len(moved[a] & moved[b]), len(moved[a]) + len(moved[b])) for a, b in combinations(sorted(held), 2)}
    pairs = profiles.shared_changes(changes, "r")
    assert {(x["a"], x["b"]): (x["shared"], x["total"]) for x in pairs.collect()} == {k: v for k, v in told.items() if v[0]}
    one = profiles.change_summary(pairs, changes, tips, "r").first()
    scores = [s / t for s, t in told.values() if t]
    assert (one["pairs"], one["sharing"]) == (len(scores), sum(s > 0 for s in scores))
    assert abs(one["mean"] - sum(scores) / len(scores)) < 1e-12 and abs(one["greatest"] - max(scores)) < 1e-12


def test_gain_loss_of_nothing(spark):
    edges = spark.createDataFrame([("n", "x"), ("n", "y")], "parent string, child string")
    tips = spark.createDataFrame([], "r string, tip string, s int")
    changes = profiles.branch_changes(tips, edges, "r", "tip", "s")
    pairs = profiles.shared_changes(changes, "r")
    assert pairs.count() == 0
    assert tuple(profiles.change_summary(pairs, changes, tips, "r").first()) == (0, 0, None, None)
    lone = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "r string, tip string, s int")
    assert profiles.gain_loss(lone, edges.where("false"), "r", "tip", "s").count() == 0
