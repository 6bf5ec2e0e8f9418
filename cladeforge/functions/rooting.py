"""Where a species tree's root lies, by gene duplications that single gene trees support.

Trees are taken without their roots: of a node, its neighbours' directions are what is looked at. A duplication at a node is
supported where two of its three directions hold the species of one clade of the species tree, in that clade's arrangement.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import exp, inf, lgamma, log, log1p

from cladeforge.functions.newick import Node, distance, reroot

#: What stands for the genes of a side that has more than ``most``.
TOO_MANY = "*"
#: Fixed value: the prior of branches that are not ends of the tree is so many times smaller.
INNER_PRIOR = 10


class Unrooted:
    """Neighbours of every node, and what lies in each direction. A root of two children is passed over."""

    def __init__(self, tree: Node, species_of=lambda name: name):
        self.near: dict[Node, list[Node]] = {n: [*n.children, *([n.up] if n.up is not None else [])] for n in tree.preorder()}
        if len(tree.children) == 2:
            a, b = tree.children
            self.near[a][-1], self.near[b][-1] = b, a
            del self.near[tree]
        self.species: dict[tuple[Node, Node], frozenset] = {}
        down = [n for n in tree.postorder() if n in self.near]
        above = {n: next((x for x in self.near[n] if x not in n.children), None) for n in down}
        for n in down:
            if above[n] is not None:
                self.species[above[n], n] = frozenset([species_of(n.name)]) if n.is_leaf else frozenset().union(*(self.species[n, c] for c in n.children))
        for n in reversed(down):
            for c in n.children:
                self.species[c, n] = frozenset().union(*(self.species[n, x] for x in self.near[n] if x is not c))
        if len(tree.children) == 2:  # each side of the passed-over root sees the other, and its own children see past it
            for n in tree.children:
                for c in n.preorder():
                    for d in c.children:
                        self.species[d, c] = frozenset().union(*(self.species[c, x] for x in self.near[c] if x is not d))

    def ahead(self, a: Node, b: Node) -> list[Node]:
        return [x for x in self.near[b] if x is not a]

    def parts(self, a: Node, b: Node) -> list[frozenset]:
        """Species of what b parts into, seen from a; of b itself where it is a leaf."""
        return [self.species[b, x] for x in self.ahead(a, b)] or [self.species[a, b]]

    def grandparts(self, a: Node, b: Node) -> list[list[frozenset]]:
        return [self.parts(b, x) for x in self.ahead(a, b)] or [[self.species[a, b]]]

    def binary(self, n: Node) -> bool:
        return all(len(self.near[x]) in (1, 3) for x in self.near[n])

    def leaves(self, a: Node, b: Node, most: int) -> frozenset:
        """Names of the leaves in a direction."""
        out, stack = [], [(a, b)]
        while stack:
            x, y = stack.pop()
            onward = self.ahead(x, y)
            if not onward:
                out.append(y.name)
                if len(out) > most:
                    return frozenset([TOO_MANY])
            stack += [(y, z) for z in onward]
        return frozenset(out)


def clades(species_tree: Node) -> dict[frozenset, list[list[frozenset]]]:
    """Clade of two species or more, in either direction of every branch -> its arrangement two levels down."""
    t = Unrooted(species_tree)
    whole = frozenset(species_tree.names())
    return {s: t.grandparts(a, b) for (a, b), s in t.species.items() if 1 < len(s) < len(whole)}


def arranged(observed: list[list[frozenset]], expected: list[list[frozenset]]) -> bool:
    """Whether each part of a direction lies within one side of the expected clade, two parts in different sides."""
    sides = [frozenset().union(*x) for x in expected]
    found = [[k for k, side in enumerate(sides) if all(s <= side for s in part)] for part in observed]
    return all(len(x) == 1 for x in found) and len({x[0] for x in found}) == len(found)


def supported_duplications(tree: Node, species_of, species: frozenset, expected: dict[frozenset, list[list[frozenset]]], most: int = 2000) -> list[tuple[frozenset, frozenset | None]]:
    """(clade, genes after the duplication) of every supported duplication; a duplication within one species has no gene set.

    Two directions of a node support a clade if it is a smallest one around both, each holds some of every grandchild of it, and both
    are ``arranged`` as it is. Nodes beside a polytomy support nothing. A tree of under three species has none; a gene of an unknown
    species is an error.
    """
    found = {species_of(x) for x in tree.names()}
    if found - species:
        raise ValueError(f"species that the species tree hasn't: {sorted(found - species)}")
    if len(found) < 3:
        return []
    t, out = Unrooted(tree, species_of), []

    def smallest(s: frozenset) -> set[frozenset]:
        around = [k for k in expected if s <= k]
        least = min(map(len, around), default=0)
        return {k for k in around if len(k) == least}

    for n, near in t.near.items():
        if len(near) != 3:
            continue
        for a, b in combinations(near, 2):
            one, two = t.species[n, a], t.species[n, b]
            if len(one) == 1 and one == two:
                out.append((one, None))
            if min(len(one), len(two)) < 2 or not t.binary(n):
                continue
            for k in sorted(smallest(one) & smallest(two), key=sorted):
                want = expected[k]
                resolved = len(want) == 2 and all(len(x) <= 2 for x in want)
                if resolved and all(s & one and s & two for x in want for s in x) and arranged(t.grandparts(n, a), want) and arranged(t.grandparts(n, b), want):
                    out.append((k, t.leaves(n, a, most) | t.leaves(n, b, most)))
    return out


def canonical(clade: frozenset, species: frozenset) -> frozenset:
    """The smaller side of a branch; of equal ones that with the first species."""
    other = species - clade
    return min(clade, other, key=lambda s: (len(s), sorted(s)))


def contradictions(species: frozenset, roots: list[frozenset], observed: dict[frozenset, int]) -> dict[frozenset, tuple[int, int]]:
    """Candidate -> (terminal, other) duplications with species on both of its sides; terminal ones are of one species or all but one."""
    out = {}
    for r in roots:
        against = [0, 0]
        for s, n in observed.items():
            if s & r and s - r:
                against[len(s) not in (1, len(species) - 1)] += n
        out[r] = (against[0], against[1])
    return out


def best_roots(species_tree: Node, observed: dict[frozenset, int]) -> tuple[list[frozenset], int]:
    """(root candidates with fewest contradictions, the preferred one first; duplications that don't contradict them).

    Among equals, the root is preferred whose closest supported clade is most splits away, then by branch length, then in order.
    """
    species = frozenset(species_tree.names())
    against = {r: sum(x) for r, x in contradictions(species, sorted({canonical(c, species) for c in clades(species_tree)}, key=sorted), observed).items()}
    least = min(against.values(), default=0)
    roots = [r for r, n in against.items() if n == least]
    if len(roots) > 1 and observed:
        roots.sort(key=lambda r: tuple(-x for x in nearest_support(species_tree, r, observed)))
    return roots, sum(observed.values()) - least


def copied(tree: Node) -> Node:
    new = {n: Node(n.name, n.dist, n.support) for n in tree.preorder()}
    for n in tree.preorder():
        for c in n.children:
            new[n].add(new[c])
    return new[tree]


def rooted_at(species_tree: Node, clade: frozenset) -> Node:
    """A copy rooted on the clade's branch; the clade may straddle the old root."""
    tree = copied(species_tree)
    whole = frozenset(tree.names())
    for wanted in (clade, whole - clade):
        for n in tree.preorder():
            if n is not tree and frozenset(n.names()) == wanted:
                return reroot(tree, n)
    raise ValueError(f"no branch parts {sorted(clade)} from the rest")


def nearest_support(species_tree: Node, root: frozenset, observed: dict[frozenset, int]) -> tuple[float, float]:
    """(splits, branch length) from a root to its closest supported clade; (-1, -1) without one."""
    tree = rooted_at(species_tree, root)
    found = [(len(n.ancestors()) - 1, distance(tree, n)) for n in tree.preorder() if observed.get(frozenset(n.names()))]
    return min(found, default=(-1, -1))


# ---- probabilities ------------------------------------------------------------------------------------------------


def log_sum(*xs: float) -> float:
    top = max(xs)
    return top if top == -inf else top + log(sum(exp(x - top) for x in xs))


def log_poisson(k: int, rate: float) -> float:
    return k * log(rate) - rate - lgamma(k + 1)


def rates(species: frozenset, roots: list[frozenset], observed: dict[frozenset, int]) -> tuple[float, float, float]:
    """(false positives for each true one on inner branches, rate of true and of false duplications on terminal branches)."""
    against = contradictions(species, roots, observed)
    least = min(map(sum, against.values()))
    inner = [x[1] for x in against.values() if sum(x) == least]
    false = sum(inner) / len(inner)
    n_inner = sum(n for s, n in observed.items() if len(s) not in (1, len(species) - 1))
    inward = sorted((n for s, n in observed.items() if len(s) == len(species) - 1), reverse=True)
    return (false + 1) / (n_inner - false + 1), sum(inward[:2]) / 2 + 1, (sum(inward) + 1) / len(species)


def log_orientations(m: int, n: int, alpha: float) -> tuple[float, float, float]:
    """Log-likelihoods of m duplications towards one side of an inner branch and n towards the other, where time runs to the one, to the
    other, or from a root on the branch; there, the root's place is integrated out and false ones are summed over."""
    if not m + n:
        return 0.0, 0.0, 0.0
    true = (m + n) / (1 + alpha)
    false = alpha * true
    terms = []
    for s in range(m + 1):
        for t in range(n + 1):
            x, y = m - s + t, n - t + s
            integral = lgamma(x + 1) + lgamma(y + 1) - lgamma(x + y + 2)
            terms.append(integral + (m + n) * log(true) - true - false + (s + t) * log(alpha) - sum(lgamma(k + 1) for k in (m - s, s, n - t, t)))
    return log_poisson(m, true) + log_poisson(n, false), log_poisson(m, false) + log_poisson(n, true), log_sum(*terms)


def log_prior(n_species: int) -> tuple[float, float]:
    """(of one direction, of the root) of a branch: each of the 2n - 3 branches is as likely to hold the root."""
    branches = 2 * n_species - 3
    return log(0.5) + log1p(-1 / branches), -log(branches)


def root_probabilities(species_tree: Node, observed: dict[frozenset, int]) -> dict[frozenset, float]:
    """The smaller side of every branch -> the probability that the root lies there; they add up to 1.

    A branch's posterior over (towards, away, root) comes from the duplications of its two sides; a root's probability is the product
    of its own and of all other branches' running away from it. Time never runs from a leaf inwards. For three species or more.
    """
    species = frozenset(species_tree.names())
    tree = Unrooted(species_tree)
    roots = [s for s in tree.species.values() if 1 < len(s) < len(species)]
    alpha, term_true, term_false = rates(species, roots, observed)
    way, here = log_prior(len(species))
    towards: dict[frozenset, float] = {}
    at: dict[frozenset, float] = {}
    for a in set(tree.species.values()):
        b = species - a
        count_a, count_b = observed.get(a, 0), observed.get(b, 0)
        if len(a) == 1 or len(b) == 1:
            inward = count_b if len(a) == 1 else count_a
            along, root = log_poisson(inward, term_false) + way, log_poisson(inward, term_true) + here
            x, y = (along, -inf) if len(a) == 1 else (-inf, along)
        else:
            x, y, root = log_orientations(count_a, count_b, alpha / INNER_PRIOR)
            x, y, root = x + way, y + way, root + here
        whole = log_sum(x, y, root)
        towards[a], at[canonical(a, species)] = x - whole, root - whole
    below: dict[tuple[Node, Node], float] = {}

    def running(a: Node, b: Node) -> float:
        """Sum over inner branches beyond a-b that time runs along them."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            onward = [(y, z) for z in tree.ahead(x, y)]
            missing = [e for e in onward if e not in below]
            if missing:
                stack += missing
                continue
            below[x, y] = sum(below[e] + towards[tree.species[e]] for e in onward)
            stack.pop()
        return below[a, b]

    logs = {canonical(s, species): running(a, b) + running(b, a) + at[canonical(s, species)] for (a, b), s in tree.species.items()}
    whole = log_sum(*logs.values())
    return {r: exp(x - whole) for r, x in logs.items()}
