"""Supported duplications, root choice and root probabilities."""

from itertools import combinations

import pytest

from cladeforge.functions import rooting
from cladeforge.functions.newick import parse

TREE = "((A:1,B:1):1,((C:1,D:1):1,(E:1,F:1):1):1);"
SPECIES = frozenset("ABCDEF")


def first(gene):
    return gene[0]


def found(text):
    return rooting.supported_duplications(parse(text), first, SPECIES, rooting.clades(parse(TREE)))


def test_directions_hold_what_a_plain_split_gives():
    for text in (TREE, "(A,B,((C,D),(E,F)));", "(((A,B),C),D,(E,F));"):
        t = parse(text)
        whole, u = frozenset(t.names()), rooting.Unrooted(t)
        want = {frozenset(n.names()) for n in t.preorder() if n is not t}
        assert set(u.species.values()) == want | {whole - s for s in want}
        assert all(u.species[a, b] == whole - u.species[b, a] for a, b in u.species)


def test_clades_of_both_directions():
    got = rooting.clades(parse(TREE))
    assert frozenset("CDEF") in got and frozenset("ABEF") in got and frozenset("A") not in got and SPECIES not in got
    assert {frozenset(map(frozenset, x)) for x in got[frozenset("CDEF")]} == {frozenset([frozenset("C"), frozenset("D")]), frozenset([frozenset("E"), frozenset("F")])}


def test_a_duplication_of_a_clade_is_supported_wherever_the_gene_tree_is_rooted():
    for text in ("((A1,B1),(((C1,D1),(E1,F1)),((C2,D2),(E2,F2))));", "(A1,B1,(((C1,D1),(E1,F1)),((C2,D2),(E2,F2))));", "((C1,D1),(E1,F1),(((C2,D2),(E2,F2)),(A1,B1)));"):
        (clade, genes), = found(text)
        assert clade == frozenset("CDEF") and genes == {x + k for x in "CDEF" for k in "12"}


def test_what_is_not_supported():
    assert found("(A1,B1,(((C1,D1),(E1,F1)),((C2,E2),(D2,F2))));") == []  # other arrangement
    assert found("(A1,B1,(((C1,D1),(E1,F1)),(C2,D2)));") == []  # species missing
    assert found("(A1,B1,A2);") == []  # two species
    assert found("((A1,B1),(A2,B2),(A3,B3),C1);") == []  # polytomy
    assert found("((A1,A2),B1,C1);") == [(frozenset("A"), None)]
    with pytest.raises(ValueError, match="X"):
        found("(A1,B1,X1);")


def test_sides_of_many_genes():
    (_, genes), = rooting.supported_duplications(parse("(A1,B1,(((C1,D1),(E1,F1)),((C2,D2),(E2,F2))));"), first, SPECIES, rooting.clades(parse(TREE)), most=3)
    assert genes == {rooting.TOO_MANY}


def test_the_root_contradicts_least():
    observed = {frozenset("CDEF"): 5, frozenset("CD"): 2, frozenset("AB"): 3, frozenset("EFAB"): 1}
    roots, support = rooting.best_roots(parse(TREE), observed)
    against = {r: sum(n for s, n in observed.items() if s & r and s - r) for r in map(frozenset, ("A", "B", "C", "D", "E", "F", "AB", "CD", "EF"))}
    assert set(roots) == {r for r, n in against.items() if n == min(against.values())} and support == 11 - min(against.values())
    assert roots[0] == frozenset("AB")


def test_ties_go_to_the_root_farthest_from_its_support():
    roots, support = rooting.best_roots(parse(TREE), {frozenset("EF"): 4})
    splits = [rooting.nearest_support(parse(TREE), r, {frozenset("EF"): 4}) for r in roots]
    assert support == 4 and splits == sorted(splits, reverse=True) and frozenset("E") not in roots
    assert rooting.best_roots(parse(TREE), {})[1] == 0


def test_rooting_at_a_clade_that_straddles_the_root():
    t = rooting.rooted_at(parse(TREE), frozenset("ABEF"))
    assert {frozenset(c.names()) for c in t.children} == {frozenset("CD"), frozenset("ABEF")}
    with pytest.raises(ValueError):
        rooting.rooted_at(parse(TREE), frozenset("AC"))


def test_root_probabilities_add_up_and_follow_the_duplications():
    observed = {frozenset("CDEF"): 12, frozenset("CD"): 6, frozenset("AB"): 9, frozenset("EF"): 7}
    got = rooting.root_probabilities(parse(TREE), observed)
    assert len(got) == 9 and sum(got.values()) == pytest.approx(1) and max(got, key=got.get) == frozenset("AB")
    even = rooting.root_probabilities(parse("(A,B,C);"), {})
    assert set(even) == {frozenset(x) for x in "ABC"} and all(p == pytest.approx(1 / 3) for p in even.values())


def test_orientations_of_a_branch_against_sums():
    """The root's likelihood is the integral over its place of the products of Poisson counts, by numbers."""
    import numpy as np

    m, n, alpha = 3, 2, 0.2
    x, y, root = rooting.log_orientations(m, n, alpha)
    true = (m + n) / (1 + alpha)
    at = (np.arange(20000) + 0.5) / 20000
    pois = lambda k, rate: np.exp(-rate) * rate**k / np.prod(np.arange(1, k + 1))
    one, two = true * at + alpha * true * (1 - at), true * (1 - at) + alpha * true * at
    assert np.exp(root) == pytest.approx((pois(m, one) * pois(n, two)).mean(), rel=1e-5)
    assert np.exp(x) == pytest.approx(pois(m, true) * pois(n, alpha * true)) and np.exp(y) == pytest.approx(pois(m, alpha * true) * pois(n, true))
    assert all(np.isfinite(v) for a, b in combinations((0, 1, 5), 2) for v in rooting.log_orientations(a, b, alpha))


def test_a_table_of_gene_trees_roots_the_species_tree(spark):
    from cladeforge.operators import genetrees

    one = "(A|1,B|1,(((C|1,D|1),(E|1,F|1)),((C|2,D|2),(E|2,F|2))));"
    trees = spark.createDataFrame([(1, one), (2, one), (3, None), (4, "(A|1,B|1"), (5, "(A|1,B|1);")], "og long, newick string")
    dups = genetrees.supported_duplications(trees, TREE)
    assert sorted(r["og"] for r in dups.collect()) == [1, 2]
    rooted, support, probable = genetrees.species_tree_root(dups, "(C:1,D:1,((E:1,F:1):1,(A:1,B:1):1):1);")
    sides = {frozenset(c.names()) for c in parse(rooted).children}
    assert support == 2 and not any(s & frozenset("CDEF") and s - frozenset("CDEF") and (SPECIES - s) & frozenset("CDEF") for s in sides)
    assert sum(probable.values()) == pytest.approx(1)
    rooted, support, _ = genetrees.species_tree_root(dups.where("og > 2"), TREE)
    assert support == 0 and set(parse(rooted).names()) == SPECIES
