"""A species tree from many gene trees: one species tree a gene tree, the splits of all, and the greedy consensus of those.

Splits are bit masks over the sorted taxa in words of 62 bits, the first taxon's bit clear.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeforge.functions import consensus, newick
from cladeforge.operators.clustering import cut
from cladeforge.operators.genetrees import read_tree

WORD = 62


def closest_species_trees(trees: DataFrame, species: Sequence[str], separator: str = "|") -> DataFrame:
    """(og, newick) species trees of the gene trees (og, newick; leaves ``species<separator>gene``) that have all ``species`` and no other.

    Each is the neighbour-joining tree of the least distances between the genes of two species. Trees that can't be read are set aside.
    """
    every = sorted(species)

    def run(batches):
        species_of = lambda gene: gene.partition(separator)[0]
        for batch in batches:
            rows = []
            for og, text in zip(batch["og"], batch["newick"], strict=True):
                tree, _ = read_tree(text)
                if tree is None or sorted(set(map(species_of, tree.names()))) != every:
                    continue
                d = consensus.closest_distances(tree, species_of)
                matrix = [[0.0 if a == b else d[min(a, b), max(a, b)] for b in every] for a in every]
                rows.append((og, newick.write(newick.neighbour_joining(every, matrix))))
            yield pd.DataFrame(rows, columns=["og", "newick"])

    return trees.select("og", "newick").mapInPandas(run, f"og {dict(trees.dtypes)['og']}, newick string")


def tree_splits(trees: DataFrame, taxa: Sequence[str]) -> DataFrame:
    """(og, split, length) of all branches of trees over the same taxa; a root's two branches are one. Trees that can't be read or have other taxa are set aside."""
    every = sorted(taxa)
    words = range(0, max(len(every), 1), WORD)

    def run(batches):
        for batch in batches:
            rows = []
            for og, text in zip(batch["og"], batch["newick"], strict=True):
                tree, _ = read_tree(text)
                if tree is None or sorted(tree.names()) != every:
                    continue
                rows += [(og, [m >> k & (1 << WORD) - 1 for k in words], d) for m, d in consensus.splits(tree, every).items()]
            yield pd.DataFrame(rows, columns=["og", "split", "length"])

    return trees.select("og", "newick").mapInPandas(run, f"og {dict(trees.dtypes)['og']}, split array<long>, length double")


def split_counts(splits: DataFrame) -> DataFrame:
    """(split, n, length): trees that have a split, and its mean length in them."""
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("length"))


def taxa_of(split: Column, taxa: Sequence[str]) -> Column:
    """The sorted taxa of a split."""
    at = [F.when(split[k // WORD].bitwiseAND(F.lit(1 << k % WORD)) != 0, F.lit(t)) for k, t in enumerate(sorted(taxa))]
    return F.filter(F.array(*at), lambda x: x.isNotNull())


def bits(split: Column) -> Column:
    return F.aggregate(split, F.lit(0), lambda n, w: n + F.bit_count(w))


def fits(split: Column, other: Sequence[int]) -> Column:
    """Whether a split is nested in, around, or apart from another."""
    known = F.array(*map(F.lit, other))
    both = F.zip_with(split, known, lambda a, b: a.bitwiseAND(b))
    return (both == split) | (both == known) | F.forall(both, lambda w: w == 0)


def compatible_splits(counts: DataFrame, n_taxa: int, at_once: int = 1000) -> list[tuple[list[int], int, float]]:
    """The splits of more than one taxon on either side that the greedy consensus keeps, as (split, n, length): by falling count, then by mask, each that fits all
    kept before. ``at_once`` splits come to the driver at a time; what fits none of those kept is never sent. No more than n_taxa - 3 are kept, so the
    rounds end early. Means come rounded to twelve places.
    """
    sized = counts.withColumn("k", bits(F.col("split")))
    left = cut(sized.where((F.col("k") > 1) & (F.col("k") < n_taxa - 1)).select("split", "n", F.round("length", 12).alias("length"), F.reverse("split").alias("high")))
    kept: list[tuple[list[int], int, float]] = []
    while len(kept) < n_taxa - 3:
        rows = left.orderBy(F.desc("n"), "high").limit(at_once).collect()
        for r in rows:
            x = sum(w << WORD * k for k, w in enumerate(r["split"]))
            others = [sum(w << WORD * k for k, w in enumerate(s)) for s, _, _ in kept]
            if all(x & y in (0, x, y) for y in others):
                kept.append((list(r["split"]), r["n"], r["length"]))
        if len(rows) < at_once:
            break
        last = rows[-1]
        after = (F.col("n") < last["n"]) | (F.col("n") == last["n"]) & (F.col("high") > F.array(*map(F.lit, last["high"])))
        for s, _, _ in kept:
            after &= fits(F.col("split"), s)
        left = left.where(after)
    return kept[: max(n_taxa - 3, 0)]


def consensus_tree(trees: DataFrame, taxa: Sequence[str]) -> tuple[str | None, int]:
    """(Newick text of the greedy consensus of trees (og, newick) over the same taxa, how many trees there are). Supports are shares of trees, lengths means over
    those that have the split. (None, 0) without a tree."""
    every = sorted(taxa)
    splits = cut(tree_splits(trees, every))
    n_trees = splits.select("og").distinct().count()
    if not n_trees:
        return None, 0
    counts = cut(split_counts(splits))
    ends = counts.where((bits(F.col("split")) == 1) | (bits(F.col("split")) >= len(every) - 1)).collect()  # a row a taxon
    found = compatible_splits(counts, len(every)) + [(r["split"], r["n"], r["length"]) for r in ends]
    masks = {sum(w << WORD * k for k, w in enumerate(s)): (n, d) for s, n, d in found}
    return newick.write(consensus.assemble(masks, every, n_trees), "support"), n_trees


def species_tree(trees: DataFrame, species: Sequence[str], separator: str = "|") -> tuple[str | None, int]:
    """(unrooted species tree, gene trees that it rests on) by consensus of the species trees of all gene trees with every species. Two or three species need none: their tree is a star."""
    if len(species) < 4:
        return star(species), 0
    return consensus_tree(cut(closest_species_trees(trees, species, separator)), species)


def star(species: Sequence[str]) -> str:
    return "(" + ",".join(f"{s}:1" for s in sorted(species)) + ");"


def distance_species_tree(distances: DataFrame) -> str:
    """Neighbour-joining tree of (sp_a, sp_b, d), a row a species pair; pairs without a distance lie 1.1 times the largest apart."""
    d = {tuple(sorted((r["sp_a"], r["sp_b"]))): max(float(r["d"]), 0.0) for r in distances.select("sp_a", "sp_b", "d").collect()}  # species squared
    every = sorted({s for pair in d for s in pair})
    far = 1.1 * max(d.values(), default=0.0)
    return newick.write(newick.neighbour_joining(every, [[0.0 if a == b else d.get((min(a, b), max(a, b)), far) for b in every] for a in every]))


def topology_lines(trees: DataFrame, separator: str = "|", first: int = 50) -> DataFrame:
    """(og, value): trees without lengths, their leaves named by species alone, as programs that combine gene trees read them. Trees of under four leaves are left out, and
    so are groups before ``first``, the largest ones."""

    def run(batches):
        for batch in batches:
            rows = []
            for og, text in zip(batch["og"], batch["newick"], strict=True):
                tree, _ = read_tree(text)
                if tree is None or len(tree.leaves()) < 4:
                    continue
                for leaf in tree.leaves():
                    leaf.name = leaf.name.partition(separator)[0]
                rows.append((og, newick.write(tree, "none", lengths=False)))
            yield pd.DataFrame(rows, columns=["og", "value"])

    return trees.where(F.col("og") >= first).select("og", "newick").mapInPandas(run, f"og {dict(trees.dtypes)['og']}, value string")
