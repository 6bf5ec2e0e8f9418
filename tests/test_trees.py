"""Trees as tables against brute force over all ancestors, and a long ladder."""

import random

import pytest
from pyspark.sql import functions as F

from cladeforge.operators import trees

SCHEMA = "tree long, node long, parent long, dist double, is_leaf boolean, sp string"


def random_tree(tree: int, n: int, rng: random.Random, reach: int) -> list[tuple]:
    """A node's parent is one of the ``reach`` nodes before it; ids aren't in that order."""
    ids = rng.sample(range(1000), n)
    parents = [None] + [rng.randrange(max(0, i - reach), i) for i in range(1, n)]
    return [(tree, ids[i], None if p is None else ids[p], float(rng.randint(0, 9)), i not in parents, f"s{rng.randint(0, 4)}") for i, p in enumerate(parents)]


def ancestors(rows: list[tuple]) -> dict:
    """(tree, node) -> its ancestors with steps and length, itself first."""
    up = {(t, n): (p, d) for t, n, p, d, *_ in rows}
    out = {}
    for t, n in up:
        way, steps, length, at = [], 0, 0.0, n
        while at is not None:
            way.append((at, steps, length))
            at, length, steps = up[t, at][0], length + up[t, at][1], steps + 1
        out[t, n] = way
    return out


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(3)
    rows = [r for t in range(12) for r in random_tree(t, rng.choice([1, 2, 9, 40]), rng, rng.choice([1, 2, 50]))]
    nodes = spark.createDataFrame(rows, SCHEMA)
    return rows, ancestors(rows), nodes, trees.routes(nodes)


def test_ways_are_few_and_list_all_ancestors(forest):
    rows, up, _, ways = forest
    got = {tuple(r) for r in trees.closure(ways).collect()}
    assert got == {(t, n, a, s, d) for (t, n), way in up.items() for a, s, d in way}
    sizes = {t: sum(r[0] == t for r in rows) for t in range(12)}
    for r in ways.groupBy("tree", "node").count().collect():
        assert 2 ** (r["count"] - 1) <= sizes[r["tree"]]


def test_what_is_below(forest):
    rows, up, nodes, ways = forest
    below = {}
    for t, n, _, _, leaf, sp in rows:
        for a, s, d in up[t, n] if leaf else []:
            below.setdefault((t, a), []).append((n, sp, d))
    assert {(r.tree, r.node): r.n_leaves for r in trees.leaf_counts(nodes, ways).collect()} == {k: len(x) for k, x in below.items()}
    assert {(r.tree, r.node): r.species for r in trees.species_below(nodes, ways).collect()} == {k: sorted({s for _, s, _ in x}) for k, x in below.items()}
    every = {t: [r for r in rows if r[0] == t and r[4]] for t in range(12)}
    above = {k: sorted({r[5] for r in every[k[0]] if r[1] not in [n for n, _, _ in x]}) for k, x in below.items()}
    assert {(r.tree, r.node): r.species for r in trees.species_above(nodes, ways).collect()} == above
    inner = {k: x for k, x in below.items() if k not in {(t, n) for t, n, _, _, leaf, _ in rows if leaf}}
    ends = {k: (min((d, n) for n, _, d in x)[1], min((-d, n) for n, _, d in x)[1]) for k, x in inner.items()}
    assert {(r.tree, r.node): (r.closest, r.farthest) for r in trees.extreme_leaves(nodes, ways).collect()} == ends
    near = {}
    for (t, _), x in below.items():
        for _, a, da in x:
            for _, b, db in x:
                if a < b:
                    near[t, a, b] = min(near.get((t, a, b), 1e9), da + db)
    assert {(r.tree, r.sp_a, r.sp_b): r.dist for r in trees.closest_pairs(nodes, ways).collect()} == near
    counts = {k: (len(up[k]) - 1, sum(k[0] == t and k[1] in [a for a, _, _ in w] for (t, _), w in up.items()) - 1) for k in up}
    assert {(r.tree, r.node): (r.above, r.below) for r in trees.comparable(ways).collect()} == counts


def test_common_ancestors_and_highest(spark, forest):
    rows, up, nodes, ways = forest
    rng = random.Random(5)
    names = {t: [r[1] for r in rows if r[0] == t] for t in range(12)}
    sets = {(t, k): set(rng.choices(names[t], k=k + 1)) for t in range(12) for k in range(4)}

    def lowest(t, xs):
        shared = set.intersection(*({a for a, _, _ in up[t, x]} for x in xs))
        return next(a for a, _, _ in up[t, next(iter(xs))] if a in shared)

    frame = spark.createDataFrame([(t, k, x) for (t, k), xs in sets.items() for x in xs], "tree long, set int, node long")
    assert {(r.tree, r.set): r.node for r in trees.mrca(ways, frame).collect()} == {k: lowest(k[0], xs) for k, xs in sets.items()}

    pairs = {(t, *rng.choices(names[t], k=2)) for t in range(12) for _ in range(9)}
    got = {(r.tree, r.a, r.b): (r.steps, r.dist) for r in trees.distances(ways, spark.createDataFrame(list(pairs), "tree long, a long, b long")).collect()}
    for t, a, b in pairs:
        top = lowest(t, {a, b})
        legs = [next((s, d) for x, s, d in up[t, y] if x == top) for y in (a, b)]
        assert got[t, a, b] == (legs[0][0] + legs[1][0], legs[0][1] + legs[1][1])

    picked = nodes.where("dist >= 5").select("tree", "node")
    chosen = {tuple(r) for r in picked.collect()}
    want = {(t, n) for t, n in chosen if not any((t, a) in chosen for a, s, _ in up[t, n] if s)}
    assert {tuple(r) for r in trees.highest(ways, picked).collect()} == want


def test_events_and_splits(forest):
    rows, up, nodes, ways = forest
    kids = {}
    for t, n, _, _, leaf, sp in rows:
        way = [a for a, _, _ in up[t, n]]
        for kid, parent in zip(way, way[1:]) if leaf else ():
            kids.setdefault((t, parent), {}).setdefault(sp, set()).add(kid)
    sizes = {k: (sum(len(x) > 1 for x in s.values()), len(s)) for k, s in kids.items()}
    assert {(r.tree, r.node): (r.n_shared, r.n_all) for r in trees.overlap_sizes(nodes, ways).collect()} == sizes
    assert {(r.tree, r.node): r.event for r in trees.overlap_labels(nodes, ways).collect()} == {k: "D" if a else "S" for k, (a, _) in sizes.items()}
    listed = trees.splits(nodes, ways)
    for kept in ("node % 3 <> 0", "false", "true"):
        plain, prints = (trees.robinson_foulds(s, s.where(kept)) for s in (listed, trees.split_prints(nodes, ways)))
        assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in prints.collect()}


def test_no_trees(spark):
    nodes = spark.createDataFrame([], SCHEMA)
    ways = trees.routes(nodes)
    assert trees.leaf_counts(nodes, ways).count() == trees.closest_pairs(nodes, ways).count() == trees.monophyly(nodes, ways).count() == 0


def test_long_ladder_has_two_ways_a_leaf(spark):
    n = 100_000  # inner nodes 0, 2, 4, ...; the leaf of each is the next odd id
    ids = spark.range(2 * n + 1).withColumnRenamed("id", "node")
    odd = F.col("node") % 2 == 1
    parent = F.when(F.col("node") == 0, None).when(odd, F.col("node") - 1).otherwise(F.col("node") - 2)
    nodes = ids.select(F.lit(0).cast("long").alias("tree"), "node", parent.alias("parent"), F.lit(1.0).alias("dist"), (odd | (F.col("node") == 2 * n)).alias("is_leaf"), F.concat(F.lit("s"), (F.col("node") % 7).cast("string")).alias("sp"))
    ways = trees.routes(nodes)
    assert ways.count() <= 4 * n + 2
    counts = trees.leaf_counts(nodes, ways).agg(F.sum("n_leaves"), F.max("n_leaves")).first()
    assert counts[0] == sum(n + 1 - i for i in range(n)) + n + 1 and counts[1] == n + 1
    assert trees.comparable(ways).agg(F.max("above")).first()[0] == n
    assert trees.species_counts(nodes, ways).where("node = 0").count() == 7


def test_species_above_makes_no_row_for_each_node_and_species(spark):
    """Nodes meet their tree's species as one list: counted rows are as many as a node's own species."""
    rows = random_tree(1, 40, random.Random(3), 4)
    nodes = spark.createDataFrame(rows, SCHEMA)
    found = trees.species_above(nodes, trees.routes(nodes))
    left = [s for s in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in s]
    assert found.count() == 40 and not any("LeftOuter" in s and "sp#" in s for s in left)
