"""Splits of trees over the same taxa, the compatible ones, and their consensus tree."""

from __future__ import annotations

from cladeforge.functions.newick import Node


def splits(tree: Node, taxa: list[str]) -> dict[int, float]:
    """Canonical bit mask (the first taxon's bit clear) -> branch length; the root's two branches are one."""
    bit, full = {t: 1 << k for k, t in enumerate(taxa)}, (1 << len(taxa)) - 1
    mask: dict[int, int] = {}
    out: dict[int, float] = {}
    for n in tree.postorder():
        mask[id(n)] = bit[n.name] if n.is_leaf else sum(mask[id(c)] for c in n.children)
        if n is not tree:
            m = mask[id(n)]
            m = full ^ m if m & 1 else m
            out[m] = out.get(m, 0.0) + n.dist if n.up is tree and len(tree.children) == 2 else n.dist
    return out


def compatible(counts: dict[int, int], n_taxa: int) -> list[int]:
    """Splits by falling count, then by mask, that are nested in or apart from all kept before."""
    kept: list[int] = []
    for m in sorted(counts, key=lambda m: (-counts[m], m)):
        if m and all(m & k in (0, m, k) for k in kept):
            kept.append(m)
    return kept


def consensus(trees: list[Node], taxa: list[str]) -> Node:
    """Greedy consensus: support is the share of trees, length the mean over trees that have the split."""
    lengths: dict[int, list[float]] = {}
    for t in trees:
        for m, d in splits(t, taxa).items():
            lengths.setdefault(m, []).append(d)
    kept = set(compatible({m: len(x) for m, x in lengths.items()}, len(taxa)))
    return assemble({m: (len(x), sum(x) / len(x)) for m, x in lengths.items() if m in kept}, taxa, len(trees))


def assemble(found: dict[int, tuple[int, float]], taxa: list[str], n_trees: int) -> Node:
    """The tree of compatible splits: mask -> (trees that have it, mean length). Leaves that no split names have length 0."""
    full = (1 << len(taxa)) - 1
    first = full ^ 1
    root = Node()
    nodes = [(full, root)]
    for m in sorted((set(found) | {1 << k for k in range(1, len(taxa))}) - {first}, key=lambda m: (-m.bit_count(), m)):
        n, length = found.get(m, (0, 0.0))
        parent = min((x for x in nodes if m & x[0] == m and x[0] != m), key=lambda x: x[0].bit_count())[1]
        nodes.append((m, parent.add(Node(taxa[m.bit_length() - 1] if m.bit_count() == 1 else "", length, n / n_trees if n_trees else 0.0))))
    root.add(Node(taxa[0], found.get(first, (0, 0.0))[1]))
    return root


def closest_distances(tree: Node, species_of) -> dict[tuple[str, str], float]:
    """(species, species), in order -> the least length between leaves of the two; branches below 0 count as 0. Only each species' nearest leaf below a node is carried up."""
    near: dict[int, dict[str, float]] = {}
    out: dict[tuple[str, str], float] = {}
    for n in tree.postorder():
        if n.is_leaf:
            near[id(n)] = {species_of(n.name): 0.0}
            continue
        held: dict[str, float] = {}
        for c in n.children:
            own = {s: d + max(c.dist, 0.0) for s, d in near.pop(id(c)).items()}
            for s, d in own.items():
                for t, e in held.items():
                    if s != t:
                        key = (s, t) if s < t else (t, s)
                        out[key] = min(out.get(key, d + e), d + e)
            for s, d in own.items():
                held[s] = min(held.get(s, d), d)
        near[id(n)] = held
    return out


def parsimony_root(clades: dict[str, tuple[frozenset, frozenset]], observed: dict[frozenset, int]) -> list[str]:
    """Root candidates with fewest contradicting duplications. ``clades``: name -> the two sides of a root; an observed set of species
    contradicts a root if it holds species of both sides but isn't all of either's, or of the whole."""
    whole = frozenset().union(*(a | b for a, b in clades.values())) if clades else frozenset()
    against = {c: sum(n for s, n in observed.items() if s != whole and s & a and s & b) for c, (a, b) in clades.items()}
    least = min(against.values(), default=0)
    return sorted(c for c, n in against.items() if n == least)
