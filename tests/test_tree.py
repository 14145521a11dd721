import math

import numpy as np
import pytest

from drawlake.operators import tree as T


def random_tree(n, rng, chain=False):
    """(node, parent, divt) of a binary tree over the leaves 1..n; inner nodes are numbered at random."""
    names = [-int(i) for i in rng.permutation(n - 1) + 1]
    rows, tops = [], list(range(1, n + 1))
    for name in names:
        if not chain:
            rng.shuffle(tops)
        a, b = tops.pop(), tops.pop()
        rows += [(a, name), (b, name)]
        tops.append(name)
    parent = dict(rows) | {tops[0]: 0}
    time = {}

    def at(v):
        path = []
        while v and v not in time:
            path.append(v)
            v = parent[v]
        for u in reversed(path):
            time[u] = 1.0 if u > 0 else time.get(parent[u], 0.0) + (1 - time.get(parent[u], 0.0)) * 0.1
        return None

    for v in parent:
        at(v)
    return [(v, parent[v], time[v]) for v in parent]


@pytest.fixture(scope="module")
def trees():
    rng = np.random.default_rng(1)
    return {1: random_tree(40, rng), 2: random_tree(60, rng, chain=True), 3: random_tree(2, rng), 4: [(1, 0, 1.0)], 5: random_tree(300, rng)}


def frame(spark, trees):
    return spark.createDataFrame([(t, *r) for t, rows in trees.items() for r in rows], "tree long, node int, parent int, divt double")


def above(rows):
    """The ancestors of each node, nearest first."""
    parent, out = {v: p for v, p, _ in rows}, {}
    for v in parent:
        path, u = [], parent[v]
        while u:
            path.append(u)
            u = parent[u]
        out[v] = path
    return out


def test_tour_against_paths(spark, trees):
    got = {(r.tree, r.node): r for r in T.tour(frame(spark, trees), {"total": T.F.col("divt")}).collect()}
    for t, rows in trees.items():
        up, time = above(rows), {v: d for v, _, d in rows}
        for v in up:
            r, below = got[t, v], [u for u in up if u == v or v in up[u]]
            assert (r.depth, r.size, r.leaves) == (len(up[v]), len(below), sum(u > 0 for u in below))
            assert r.total == pytest.approx(sum(time[u] for u in (v, *up[v])))
            assert {got[t, u].place for u in below} == set(range(r.place - len(below) + 1, r.place + 1))
    assert len(got) == sum(map(len, trees.values()))


@pytest.mark.parametrize("fan", [T.FAN, 2, 3])
def test_common_ancestors_against_paths(spark, trees, monkeypatch, fan):
    monkeypatch.setattr(T, "FAN", fan)
    rng = np.random.default_rng(2)
    asked, want = [], {}
    for t, rows in trees.items():
        up, time = above(rows), {v: d for v, _, d in rows}
        for a, b in rng.integers(1, max(v for v, *_ in rows) + 1, (60, 2)).tolist():
            asked.append((t, a, b))
            want[t, a, b] = 1.0 if a == b else time[next(u for u in up[a] if u in up[b])]
    tours = T.tour(frame(spark, trees))
    pairs = spark.createDataFrame(asked, "tree long, a int, b int")
    got = {(r.tree, r.a, r.b): r.divt for r in T.common_ancestor(pairs, tours).collect()}
    assert got == want
    three = spark.createDataFrame([(*x, y[2]) for x, y in zip(asked, asked[1:]) if x[0] == y[0]], "tree long, a int, b int, c int")
    for r in T.triples(three, tours).collect():
        up, time = above(trees[r.tree]), {v: d for v, _, d in trees[r.tree]}
        of = lambda a, b: 1.0 if a == b else time[next(u for u in up[a] if u in up[b])]
        assert r.closer == (of(r.a, r.b) > of(r.a, r.c))


def test_tables_and_probabilities_against_paths(spark, trees):
    nodes = frame(spark, trees)
    tours = T.tour(nodes)
    table = {(r.tree, r.node): r for r in T.node_table(tours).collect()}
    cuts = {(r.tree, r.leaf): r.cluster for r in T.cut(nodes, 0.3).collect()}
    paths = {(r.tree, r.leaf): r.log_prob for r in T.path_log_prob(nodes, tours).collect()}
    logs = {r.tree: r.log_prob for r in T.divergence_log_prob(tours, 0.0, 1.0, 0.5).collect()}
    depths = {r.tree: (r.average, r.deepest) for r in T.depth_summary(T.leaf_depths(tours)).collect()}
    for t, rows in trees.items():
        up, time, parent = above(rows), {v: d for v, _, d in rows}, {v: p for v, p, _ in rows}
        leaves = {v: sum(u > 0 and (u == v or v in up[u]) for u in up) for v in up}
        total = 0.0
        for v in up:
            if v < 0:
                kids = sorted(u for u in up if parent[u] == v)
                assert table[t, v].children == 2 and [(c.child, c.leaves) for c in table[t, v].by_child] == [(u, leaves[u]) for u in kids]
                rise = lambda x: -math.log(1 - x) + 0.5 * (1 / (1 - x) - 1)
                t0 = time.get(parent[v], 0.0)
                total += math.log(1 / (1 - time[v]) + 0.5 / (1 - time[v]) ** 2) - sum(1 / i for i in range(1, leaves[v])) * (rise(time[v]) - rise(t0))
                continue
            late = [u for u in up[v] if time[u] > 0.3]
            assert cuts[t, v] == (late[-1] if late else v)
            chain = [v, *up[v]]
            assert paths[t, v] == pytest.approx(sum(math.log(leaves[x] / leaves[y]) for x, y in zip(chain, chain[1:])))
        if len(rows) > 1:
            assert logs[t] == pytest.approx(total)
        own = [len(up[v]) for v in up if v > 0]
        assert depths[t] == (pytest.approx(np.mean(own)), max(own))


def test_tables_of_many_nodes_are_not_broadcast(spark, trees, monkeypatch):
    """Written files are far smaller than what they hold, so that Spark would send them to the driver."""
    nodes = frame(spark, trees)
    plain = {(r.tree, r.node): r.place for r in T.tour(nodes).collect()}
    monkeypatch.setattr(T, "MOST_ROWS", 1)
    tours = T.tour(nodes)
    plans = [tours, T.divergence_log_prob(tours, 0.0, 1.0, 0.5), T.common_ancestor(spark.createDataFrame([(1, 1, 2), (5, 7, 9)], "tree long, a int, b int"), tours)]
    assert not any("Broadcast" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert {(r.tree, r.node): r.place for r in tours.collect()} == plain


def test_deep_chain(spark):
    """A chain of 6,000 leaves: two rows a node in the tour, a row a node and little more in the minima."""
    n = 6_000
    leaf = spark.range(1, n + 1).selectExpr("CAST(1 AS LONG) AS tree", "CAST(id AS INT) AS node", f"CAST(CASE WHEN id = {n} THEN {1 - n} ELSE -id END AS INT) AS parent", "1.0D AS divt")
    inner = spark.range(1, n).selectExpr("CAST(1 AS LONG) AS tree", "CAST(-id AS INT) AS node", "CAST(CASE WHEN id = 1 THEN 0 ELSE 1 - id END AS INT) AS parent", f"id / {n}.0D AS divt")
    tours = T.tour(leaf.unionByName(inner))
    tours = T.written(tours, "tours")
    minima, _ = T._minima(tours)
    assert tours.count() == 2 * n - 1 and minima.count() < 1.1 * 2 * n
    asked = spark.createDataFrame([(1, a, b) for a, b in ((1, n), (n, n - 1), (777, 5_000), (9, 9))], "tree long, a int, b int")
    got = {(r.a, r.b): r.divt for r in T.common_ancestor(asked, tours).collect()}
    assert got == {(1, n): pytest.approx(1 / n), (n, n - 1): pytest.approx((n - 1) / n), (777, 5_000): pytest.approx(777 / n), (9, 9): 1.0}


def test_harmonic_numbers(spark):
    got = spark.range(0, 300).select("id", T.harmonic(T.F.col("id")).alias("h")).collect()
    assert all(r.h == pytest.approx(sum(1 / i for i in range(1, r.id + 1)), rel=1e-13) for r in got)
