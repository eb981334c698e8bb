"""Neighbours, spanning forests and density clusters against plain versions over all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from factloom.operators.graph import follow, merge_tree, spanning_forest
from factloom.stats import density
from factloom.stats.density import density_clusters, selected
from factloom.stats.neighbours import nearest_neighbours


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 6, (4, 3))
    points = [centres[i % 4] + rng.normal(0, 0.4 + 0.3 * (i % 4), 3) if i % 7 else rng.uniform(-12, 12, 3) for i in range(n)]
    return [(i, [float(x) for x in p]) for i, p in enumerate(points)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)


@pytest.mark.parametrize("block_rows", [60])
def test_neighbours(spark, block_rows):
    rows = vectors(120)
    rows += [(200 + i, rows[5][1]) for i in range(30)] + [(300, None), (301, None)]
    rows += [(400 + i, [3.0, 3.0, float(i)]) for i in range(12)]  # equal distances
    full = [r for r in rows if r[1] is not None]
    expected = {}
    for i, v in full:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(u)) ** 2).sum())), j) for j, u in full if j != i)[:6]
        expected.update({(i, r): (j, pytest.approx(d)) for r, (d, j) in enumerate(near, 1)})
    got = nearest_neighbours(frame(spark, rows), "id", "vec", 6, block_rows).collect()
    assert {(r.id, r.rank): (r.neighbour, r.distance) for r in got} == expected


def test_neighbours_of_few(spark):
    got = nearest_neighbours(frame(spark, [(1, [0.0]), (2, [1.0]), (3, [5.0])]), "id", "vec", 10).collect()
    assert sorted((r.id, r.rank, r.neighbour) for r in got) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]
    assert nearest_neighbours(frame(spark, [(1, [0.0])]), "id", "vec", 3).count() == 0
    assert nearest_neighbours(frame(spark, []), "id", "vec", 3).count() == 0


@pytest.mark.parametrize("task_rows", [10, 1000])
def test_follow(spark, task_rows):
    pointers = [(i, i - 1 if i % 50 else i) for i in range(200)]
    got = follow(spark.createDataFrame(pointers, "node long, next long"), task_rows).collect()
    assert {r.node: r.root for r in got} == {i: i - i % 50 for i in range(200)}


def kruskal(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    best = {}
    for a, b, w in links:
        if a != b:
            k = (min(a, b), max(a, b))
            best[k] = min(w, best.get(k, w))
    out = []
    for w, a, b in sorted((w, *k) for k, w in best.items()):
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
            out.append((a, b, w))
    return out, {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("task_rows", [20, 1000])
def test_spanning_forest(spark, task_rows):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80), float(rng.randrange(12))) for _ in range(150)] + [(i, i + 1, 1.0) for i in range(100, 130)] + [(7, 7, 0.0)]
    forest, names = spanning_forest(spark.createDataFrame(links, "a long, b long, w double"), task_rows)
    expected, roots = kruskal(links)
    assert sorted(map(tuple, forest.collect())) == sorted(expected)
    groups = defaultdict(set)
    for r in names.collect():
        groups[r.component].add(r.node)
    want = defaultdict(set)
    for x, r in roots.items():
        want[r].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("task_edges", [25])
def test_merge_tree(spark, task_edges):
    rng = random.Random(9)
    edges = [(rng.randrange(i), i, float(rng.randrange(20))) for i in range(1, 60)] + [(i, i + 1, float(i)) for i in range(100, 120)]
    expected, roots = kruskal(edges)
    table = spark.createDataFrame(edges, "a long, b long, w double")
    _, names = spanning_forest(table)
    merges, nodes = merge_tree(table, names, task_edges)
    order = sorted((w, a, b) for a, b, w in edges)
    group, top, first, parent, sizes = {}, {}, {}, {}, {}
    for rank, (w, a, b) in enumerate(order):
        sides = [group.setdefault(x, frozenset([x])) for x in (a, b)]
        for x in (a, b):
            first.setdefault(x, rank)
        for s in sides:
            if s in top:
                parent[top[s]] = rank
        both = sides[0] | sides[1]
        top[both], sizes[rank] = rank, sorted(map(len, sides))
        group.update({x: both for x in both})
    assert {r.rank: (r.w, r.parent, sorted((r.left, r.right))) for r in merges.collect()} == {k: (w, parent.get(k), sizes[k]) for k, (w, _, _) in enumerate(order)}
    assert {r.node: r.parent for r in nodes.collect()} == first


def plain_clusters(rows, min_size, min_samples, k):
    """Labels, probabilities and outlier scores by recursion from the top."""
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = [[j for _, _, j in sorted((d[i, j], ids[j], j) for j in range(len(ids)) if j != i)[:k]] for i in range(len(ids))]
    core = [d[i, n[min(min_samples, len(n)) - 1]] for i, n in enumerate(near)]
    links = [(ids[i], ids[j], max(d[i, j], core[i], core[j])) for i in range(len(ids)) for j in near[i]]
    forest, _ = kruskal(links)

    def parts(nodes, edges):
        seen, out, by = set(), [], defaultdict(list)
        for a, b, _ in edges:
            by[a].append(b)
            by[b].append(a)
        for n in nodes:
            if n not in seen:
                stack, found = [n], set()
                while stack:
                    m = stack.pop()
                    if m not in found:
                        found.add(m)
                        stack += by[m]
                seen |= found
                out.append(found)
        return out
    label, prob, score, info = {}, {}, {}, {}

    def grow(nodes, edges, birth, may):
        """A cluster's name; fills ``info`` with its leavers, children and stability."""
        name, left, kids, total = len(info), [], [], 0.0
        info[name] = None
        todo, deaths = sorted(edges, key=lambda e: (e[2], e[0], e[1])), []
        while todo:
            a, b, w = todo[-1]
            rest, lam = todo[:-1], 1 / w
            halves = sorted(parts(nodes, rest), key=lambda s: a not in s)
            large = [h for h in halves if len(h) >= min_size]
            deaths.append(lam)
            if len(large) == 2:
                for h in halves:
                    total += len(h) * (lam - birth)
                    kids.append(grow(h, [e for e in rest if e[0] in h], lam, True))
                break
            for h in halves:
                if len(h) < min_size:
                    left += [(n, lam) for n in h]
                    total += len(h) * (lam - birth)
            if not large:
                break
            nodes, todo = large[0], [e for e in rest if e[0] in large[0]]
        info[name] = {"left": left, "kids": kids, "stability": total, "death": max(deaths), "may": may}
        return name

    trees = parts(ids, forest)
    large = [t for t in trees if len(t) >= min_size]
    roots = [grow(t, [e for e in forest if e[0] in t], 0.0, len(large) > 1) for t in large]

    def settle(c):
        i = info[c]
        below = [settle(k) for k in i["kids"]]
        i["deepest"] = max([i["death"]] + [info[k]["deepest"] for k in i["kids"]])
        i["kept"] = i["may"] and (not below or i["stability"] >= sum(below))
        return i["stability"] if i["kept"] else sum(below)

    def name(c, chosen):
        i = info[c]
        chosen = c if chosen is None and i["kept"] else chosen
        for n, lam in i["left"]:
            label[n], score[n] = chosen, (i["deepest"] - lam) / i["deepest"]
            prob[n] = 0.0 if chosen is None else min(lam, info[chosen]["death"]) / info[chosen]["death"]
        for k in i["kids"]:
            name(k, chosen)
    for r in roots:
        settle(r)
        name(r, None)
    firsts = {}
    for n in sorted(label):
        if label[n] is not None:
            firsts.setdefault(label[n], len(firsts))
    return {i: (firsts[label[i]] if label.get(i) is not None else -1, prob.get(i, 0.0), score.get(i, 1.0)) for i in ids}


@pytest.mark.parametrize("min_size,k,task_rows", [(5, 199, 100_000), (8, 12, 100_000)])
def test_density_clusters(spark, min_size, k, task_rows):
    rows = vectors(200, 3)
    expected = plain_clusters(rows, min_size, min_size, k)
    got = density_clusters(frame(spark, rows), "id", "vec", min_size, k=k, task_rows=task_rows).collect()
    assert len({c for c, _, _ in expected.values()}) > 2
    assert {r.id: (r.cluster, r.probability, r.outlier_score) for r in got} == {
        i: (c, pytest.approx(p), pytest.approx(s, abs=1e-9)) for i, (c, p, s) in expected.items()}


def test_density_clusters_copies_and_gaps(spark):
    rows = vectors(60, 5)
    base = density_clusters(frame(spark, rows), "id", "vec", 4).collect()
    more = rows + [(100 + i, rows[3][1]) for i in range(20)] + [(999, None)]
    got = {r.id: (r.cluster, r.probability, r.outlier_score) for r in density_clusters(frame(spark, more), "id", "vec", 4).collect()}
    assert all(got[r.id] == pytest.approx((r.cluster, r.probability, r.outlier_score)) for r in base)
    assert all(got[100 + i] == got[3] for i in range(20)) and got[999] == (None, None, None)
    one = density_clusters(frame(spark, [(1, [0.0, 1.0])]), "id", "vec", 4).collect()
    assert [(r.cluster, r.probability, r.outlier_score) for r in one] == [(-1, 0.0, 1.0)]


@pytest.mark.parametrize("task_rows", [7, 1000])
def test_selected_in_deep_trees(spark, monkeypatch, task_rows):
    rng, tree = random.Random(4), [(0, None, 5.0, 1.0), (500, None, 1.0, 2.0)]
    for i in range(1, 61, 2):  # a chain: of two children one goes on
        tree += [(i, max(i - 2, 0), rng.uniform(0, 4), rng.uniform(1, 9)), (i + 1, max(i - 2, 0), rng.uniform(0, 4), rng.uniform(1, 9))]
    tree += [(501 + i, 500 + (i // 2), rng.uniform(0, 9 / (i + 1)), rng.uniform(1, 9)) for i in range(14)]
    kids, best, kept, deepest, chosen = defaultdict(list), {}, {}, {}, {}
    for c, p, _, _ in tree:
        kids[p].append(c)
    for c, p, stability, death in sorted(tree, reverse=True):
        below = sum(best[k] for k in kids[c])
        kept[c] = not kids[c] or stability >= below
        best[c], deepest[c] = stability if kept[c] else below, max([death, *(deepest[k] for k in kids[c])])
    for c, p, _, _ in sorted(tree):
        chosen[c] = chosen.get(p) if chosen.get(p) is not None else c if kept[c] else None
    written, cut = [], density.cut_lineage
    monkeypatch.setattr(density, "cut_lineage", lambda df: written.append(df) or cut(df))
    got = selected(spark.createDataFrame(tree, "c long, parent long, stability double, death double"), task_rows).collect()
    assert len({c for c in chosen.values()}) > 5
    assert {r.c: (r.chosen, r.deepest) for r in got} == {c: (chosen[c], pytest.approx(deepest[c])) for c in chosen}
    assert len(written) <= 30  # one or more per level of the chain would be 60
