"""Communities in levels: modularity beside a plain Louvain, connected parts, no dependence on partitions."""

import random

import pytest

from ledgerloom.operators import graph as g


def planted(n, size, inside, outside, seed):
    """n nodes in groups of `size`, in the groups of groups that make levels worth while; edges may be parallel."""
    rng, edges = random.Random(seed), []
    for i in range(n):
        for _ in range(inside):
            edges.append((i, i // size * size + rng.randrange(size)))
        for _ in range(outside):
            edges.append((i, (i // (size * 5) * size * 5 + rng.randrange(size * 5)) % n if rng.random() < 0.7 else rng.randrange(n)))
    return [(f"n{a:05d}", f"n{b:05d}") for a, b in edges if a != b]


def adjacency(edges):
    near = {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {}).setdefault(y, 0)
            near[x][y] += 1
    return near


def quality(near, label):
    total = sum(sum(v.values()) for v in near.values())
    mass, within = {}, 0
    for x, ys in near.items():
        mass[label[x]] = mass.get(label[x], 0) + sum(ys.values())
        within += sum(w for y, w in ys.items() if label[y] == label[x])
    return within / total - sum(m * m for m in mass.values()) / total**2


def louvain(near):
    """The plain method, one node after the other, level by level."""
    place = {x: x for x in near}
    graph, loops = {x: dict(v) for x, v in near.items()}, dict.fromkeys(near, 0)
    total = sum(sum(v.values()) for v in near.values())
    while True:
        degree = {x: sum(v.values()) + loops[x] for x, v in graph.items()}
        label, mass, changed = {x: x for x in graph}, dict(degree), False
        go = True
        while go:
            go = False
            for x in sorted(graph):
                mass[label[x]] -= degree[x]
                towards = {}
                for y, w in graph[x].items():
                    towards[label[y]] = towards.get(label[y], 0) + w
                best = max(sorted({*towards, label[x]}), key=lambda c: (towards.get(c, 0) - degree[x] * mass.get(c, 0) / total, c == label[x]))
                go, changed = go or best != label[x], changed or best != label[x]
                label[x] = best
                mass[best] = mass.get(best, 0) + degree[x]
        place = {x: label[p] for x, p in place.items()}
        if not changed:
            return place
        new, inner = {}, {}
        for x, ys in graph.items():
            inner[label[x]] = inner.get(label[x], 0) + loops[x]
            new.setdefault(label[x], {})
            for y, w in ys.items():
                if label[y] == label[x]:
                    inner[label[x]] += w
                else:
                    new[label[x]][label[y]] = new[label[x]].get(label[y], 0) + w
        graph, loops = new, inner


def found(spark, edges, parts=4, **options):
    df = spark.createDataFrame(edges, "source string, target string").repartition(parts)
    return {r["node"]: r["community"] for r in g.communities(df, **options).collect()}


def connected(near, label):
    for c in set(label.values()):
        members = {x for x in label if label[x] == c}
        seen, todo = set(), [min(members)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in near[x] if y in members]
        if seen != members or len(members) < 2:
            return False
    return True


def test_modularity_of_a_large_graph(spark):
    edges = planted(2_000, 20, 4, 2, 1)
    near = adjacency(edges)
    got, want = found(spark, edges), louvain(near)
    full = lambda label: {x: label.get(x, x) for x in near}
    assert quality(near, full(got)) >= 0.98 * quality(near, want)
    assert connected(near, got)


@pytest.mark.parametrize("seed", [3])
def test_levels_do_not_lose_modularity_nor_depend_on_partitions(spark, seed):
    edges = planted(80, 8, 3, 1, seed)
    near = adjacency(edges)
    many, one, flat = found(spark, edges, 8), found(spark, edges[::-1], 1), found(spark, edges, levels=1)
    assert many == one and connected(near, many)
    full = lambda label: {x: label.get(x, x) for x in near}
    assert quality(near, full(many)) >= quality(near, full(flat)) - 1e-9
    labels = spark.createDataFrame(list(many.items()), "node string, label string")
    pairs = spark.createDataFrame([(a, b, float(w)) for a, ys in near.items() for b, w in ys.items() if a < b], "a string, b string, w double")
    assert abs(g.modularity(pairs, labels) - quality(near, full(many))) < 1e-9


def test_no_edges(spark):
    assert found(spark, [("a", "a")]) == {}


def test_rounds_work_on_numbers_in_the_order_of_the_names(spark, monkeypatch):
    """Edges of names were shuffled, sorted and compared as text in every half round."""
    names = spark.createDataFrame([(f"n{i % 7}{i}",) for i in range(300)], "name string").repartition(7)
    numbered = sorted((r["name"], r["node"]) for r in g._numbered(names).collect())
    assert [n for _, n in numbered] == list(range(300))
    seen, moves = [], g._moves
    monkeypatch.setattr(g, "_moves", lambda weights, nodes, *rest: seen.append((weights.schema["a"].dataType.typeName(), nodes.schema["label"].dataType.typeName())) or moves(weights, nodes, *rest))
    assert len(found(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")])) == 5
    assert set(seen) == {("long", "long")}
