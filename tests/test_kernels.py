"""Tree, reconciliation, consensus and alignment kernels on small cases."""

from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeforge.functions import align, consensus, newick, reconcile
from cladeforge.operators import genetrees, orthogroups


@st.composite
def trees(draw, least=3):
    """Newick text of random binary trees."""
    parts = [f"x{k}:{draw(st.integers(1, 9))}" for k in range(draw(st.integers(least, 9)))]
    while len(parts) > 1:
        k = draw(st.integers(0, len(parts) - 2))
        parts[k : k + 2] = [f"({parts[k]},{parts[k + 1]}):{draw(st.integers(1, 9))}"]
    return parts[0].rpartition(":")[0] + ";"


@given(trees())
@settings(max_examples=50, deadline=None)
def test_newick_round_trip(text):
    assert newick.write(newick.parse(text)) == text


@given(trees(), st.data())
@settings(max_examples=50, deadline=None)
def test_rerooting_keeps_distances(text, data):
    t = newick.parse(text)
    want = {(a.name, b.name): newick.distance(a, b) for a, b in combinations(sorted(t.leaves(), key=lambda n: n.name), 2)}
    new = newick.reroot(t, data.draw(st.sampled_from([n for n in t.preorder() if n.up is not None])))
    got = {(a.name, b.name): newick.distance(a, b) for a, b in combinations(sorted(new.leaves(), key=lambda n: n.name), 2)}
    assert got == pytest.approx(want) and len(new.children) == 2


@given(trees(4))
@settings(max_examples=30, deadline=None)
def test_neighbour_joining_finds_additive_trees(text):
    t = newick.unroot(newick.parse(text))
    leaves = sorted(t.leaves(), key=lambda n: n.name)
    d = [[0.0 if a is b else newick.distance(a, b) for b in leaves] for a in leaves]
    got = newick.neighbour_joining([n.name for n in leaves], d)
    at = {n.name: n for n in got.leaves()}
    assert [[round(newick.distance(at[a.name], at[b.name]), 6) if a is not b else 0.0 for b in leaves] for a in leaves] == d


def test_prune_ultrametric_polytomy_rows():
    t = newick.parse("((a:1,b:2):1,(c:1,d:4):2,e:3);")
    assert sorted(newick.prune(t.copy(), {"a", "d"}).names()) == ["a", "d"]
    assert all(len(n.children) in (0, 2) for n in newick.resolve_polytomies(t.copy()).preorder())
    u = newick.ultrametric(t.copy())
    assert len({round(newick.distance(u, n), 9) for n in u.leaves()}) == 1
    r = newick.rows(t, 7)
    assert newick.write(newick.from_rows([(x[1], x[2], x[3], x[4]) for x in r])) == newick.write(t)
    assert newick.midpoint(newick.parse("(a:1,(b:1,c:9):1);")).name == "c"


def test_splits_and_consensus():
    taxa = list("abcd")
    assert len(consensus.splits(newick.parse("((a,b),(c,d));"), taxa)) == 5
    t, other = "((a:1,b:1):1,(c:1,d:1):1);", "((a:1,c:1):1,(b:1,d:1):1);"
    got = consensus.consensus([newick.parse(x) for x in (t, t, other)], taxa)
    assert {m for m in consensus.splits(got, taxa)} == {m for m in consensus.splits(newick.parse(t), taxa)}
    assert consensus.compatible({0b11000: 2, 0b10010: 1, 0b11100: 3}, 5) == [0b11100, 0b11000]


def test_parsimony_root():
    f = frozenset
    clades = {"r1": (f("ab"), f("cd")), "r2": (f("a"), f("bcd"))}
    assert consensus.parsimony_root(clades, {f("ab"): 3, f("bc"): 1}) == ["r1"]


def test_reconciliation_of_a_duplication():
    sp = reconcile.label(newick.parse("((A,B),C);"))
    of = lambda g: g.partition("|")[0]
    t = reconcile.root_on_species(newick.parse("((A|1:1,B|1:1):1,((A|2:1,B|2:1):1,C|1:3):1);"), sp, of)
    got = reconcile.reconcile(t, sp, of)
    assert [(x[1], x[2]) for x in got["duplications"]] == [("N1", 1.0)]
    assert sorted((level, tuple(g)) for level, _, g in got["hogs"]) == [("N0", ("A|1", "A|2", "B|1", "B|2", "C|1")), ("N1", ("A|1", "B|1")), ("N1", ("A|2", "B|2"))]
    pairs = {frozenset(x[1:3]) for x in reconcile.ortholog_pairs(got["sides"], of)}
    assert frozenset(("A|1", "B|2")) not in pairs and frozenset(("A|1", "B|1")) in pairs and frozenset(("A|2", "C|1")) in pairs
    assert ("n0", "C", "A", 1, 2) in reconcile.multiplicities(reconcile.ortholog_pairs(got["sides"], of), of)


def test_topological_distances():
    far = reconcile.topological_distances(newick.parse("(((A,B),C),(D,E));"))
    assert far["A"] == {"B": 0, "C": 1, "D": 2, "E": 2} and far["D"] == {"E": 0, "A": 1, "B": 1, "C": 1}


def test_a_misplaced_gene_is_no_duplication():
    """A|x sits among far species: the node above isn't a duplication, its orthologs there go, and those below are suspect."""
    sp = reconcile.label(newick.parse("((((((A,B),C),D),E),F),(((((G,H),I),J),K),L));"))
    of = lambda g: g.partition("|")[0]
    t = newick.parse("((((((A|1,B|1),C|1),D|1),E|1),F|1),((((((G|1,A|x),H|1),I|1),J|1),K|1),L|1));")
    got = reconcile.reconcile(t, sp, of)
    assert got["duplications"] == [] and got["misplaced"] == [("A|x",)]
    pairs = {frozenset(x[1:3]): x[3] for x in reconcile.ortholog_pairs(got["sides"], of)}
    assert frozenset(("A|x", "B|1")) not in pairs and pairs[frozenset(("A|x", "G|1"))] and not pairs[frozenset(("A|1", "L|1"))]
    assert all("A|x" not in genes for _, _, genes in got["hogs"])


def test_attested_levels():
    sp = reconcile.label(newick.parse("(((A,B),C),D);"))
    at = {n.name: n for n in sp.preorder()}
    assert reconcile.attested_level([at["N0"], at["N1"]]).name == "N1" and reconcile.attested_level([at["N2"], at["C"]]) is None
    assert reconcile.attested_level([at["N0"], at["N1"], at["N2"]]).name == "N1"


def test_hierarchical_groups_cover_skipped_levels_once():
    """A tree of A and B alone gives the levels above their node as well, each once; a duplication below stops the levels at it."""
    sp = reconcile.label(newick.parse("(((A,B),C),D);"))
    of = lambda g: g.partition("|")[0]
    hogs = reconcile.reconcile(newick.parse("(A|1,B|1);"), sp, of)["hogs"]
    assert sorted((x[0], x[2]) for x in hogs) == [("N0", ["A|1", "B|1"]), ("N1", ["A|1", "B|1"]), ("N2", ["A|1", "B|1"])]
    hogs = reconcile.reconcile(newick.parse("(((A|1,B|1),(A|2,B|2)),C|1);"), sp, of)["hogs"]
    assert sorted((x[0], tuple(x[2])) for x in hogs) == [("N0", ("A|1", "A|2", "B|1", "B|2", "C|1")), ("N1", ("A|1", "A|2", "B|1", "B|2", "C|1")), ("N2", ("A|1", "B|1")), ("N2", ("A|2", "B|2"))]


def test_root_separates_the_first_split():
    sp = reconcile.label(newick.parse("((A,B),(C,D));"))
    of = lambda g: g.partition("|")[0]
    t = reconcile.root_on_species(newick.parse("(A|1:1,B|1:1,(C|1:1,D|1:1):1);"), sp, of)
    assert sorted(sorted(c.names()) for c in t.children) == [["A|1", "B|1"], ["C|1", "D|1"]]


@given(st.lists(st.text("ACDE", min_size=1, max_size=12), min_size=2, max_size=5))
@settings(max_examples=50, deadline=None)
def test_alignments_keep_sequences(seqs):
    rows = align.centre_star(seqs)
    assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == seqs


def test_trim_keeps_enough_columns():
    rows = ["A" * 600 + "-" * 100] * 19 + ["A" * 700]
    assert align.trim_columns(rows) == list(range(600))
    assert len(align.trim_columns(["A" + "-" * 9] * 20)) == 10


def test_multicopy_allowance():
    assert orthogroups.multicopy_allowance(4) == [0, 1, 2, 3]
    assert orthogroups.multicopy_allowance(8) == [0, 1, 1, 1, 2, 2, 4, 7]


def test_closest_pair_by_blocks_is_the_first_of_the_whole_matrix():
    rng = np.random.default_rng(3)
    for n in (4, 63, 64, 65, 150):
        m = rng.integers(0, 4, (n, n)).astype(float)  # ties
        m += m.T
        np.fill_diagonal(m, 0)
        total = m.sum(axis=1)
        q = (n - 2) * m - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        assert newick._closest_pair(m, total) == divmod(int(np.round(q, 9).argmin()), n)


def test_distance_trees_take_names_a_group_at_a_time(spark):
    d = spark.createDataFrame([(1, 10, 20, 0.3), (1, 10, 30, 0.5), (1, 20, 30, 0.6), (2, 40, 50, 0.2), (3, 60, 70, 0.2)], "og int, a long, b long, d double")
    names = spark.createDataFrame([(1, 10, "z"), (1, 20, "y"), (1, 30, "x"), (2, 40, "q"), (2, 50, "p"), (3, 60, "lone"), (9, 1, "none")], "og int, gene long, name string")
    got = {r["og"]: r["newick"] for r in genetrees.distance_trees(d, names).collect()}
    joined = d.join(names.selectExpr("og", "gene as a", "name as x"), ["og", "a"]).join(names.selectExpr("og", "gene as b", "name as y"), ["og", "b"])
    assert got == {r["og"]: r["newick"] for r in genetrees.distance_trees(joined.selectExpr("og", "x as a", "y as b", "d")).collect()}
    assert set(got) == {1, 2}
