"""New species added to known groups: profile search, then groups of what is left within clades of new species.

Every stage is a table of a ``Stages`` folder, so a run that was killed goes on where it ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.functions import newick
from cladeforge.operators import clustering, gathering, genetrees, orthogroups, profiles, results, similarity, trees
from cladeforge.sources.stages import Stages


def new_species_clades(spark, species_tree: str, core: list[str], most: int = 2) -> DataFrame:
    """(clade, sp): the highest clades of a rooted species tree (Newick) with ``most`` core species at most, and a new one."""
    tree = spark.createDataFrame([(0, newick.write(newick.parse(species_tree)))], "og long, newick string")
    nodes = clustering.cut(genetrees.tree_nodes(tree))
    paths = trees.routes(nodes)
    leaves = nodes.where("is_leaf").select("tree", F.col("node").alias("leaf"), F.col("name").alias("sp"))
    known = leaves.where(F.col("sp").isin(core)).select("leaf")
    top = trees.small_clades(nodes, paths, known, most)
    below = trees.leaves_below(nodes, paths).join(top.select("tree", "node"), ["tree", "node"]).join(leaves, ["tree", "leaf"])
    fresh = below.where(~F.col("sp").isin(core)).select("node").distinct()
    return below.join(fresh, "node", "left_semi").select(F.col("node").alias("clade"), "sp")


def clade_hits(genes: DataFrame, clades: DataFrame, pieces, least: float) -> DataFrame:
    """(q, h, score) of genes (gene, sp, seq) of species of one clade, by the Jaccard similarity of their pieces. One join serves all clades: a piece is keyed by its clade."""
    placed = genes.join(F.broadcast(clades), "sp")  # a row a species
    rows = pieces(placed.select("gene", "seq")).join(placed.select("gene", "clade"), "gene")
    index = rows.select(F.xxhash64("clade", "piece").alias("piece"), "gene")
    sizes = index.groupBy("gene").agg(F.count(F.lit(1)).alias("n_pieces"))
    return similarity.jaccard_join(index.join(sizes, "gene").select("piece", "gene", "n_pieces"), least)


def assign(stages: Stages, core: DataFrame, genes: DataFrame, species_tree: str | None, pieces, n: int = 20, selection: str = "random", aligned: DataFrame | None = None, least_shared: int = 3, least: float = 0.1, inflation: float = 1.2, flow: bool = True) -> DataFrame:
    """(og, sp, gene) of known groups (``core``: og, sp, gene) with the genes of further species (``genes``: gene, sp, seq, len; core genes among them) added.

    A new gene joins the group of its closest profile gene. Genes of any species that are then in no group of two or more are searched within clades
    of new species, where a species tree is given, and grouped there with length-normalised scores; those groups are numbered on from the known ones. The rest are
    groups of one. Without new genes the known groups come back, with groups of one for what they lack.
    """
    core = stages.table("core", lambda: core.select("og", "sp", "gene"))
    genes = stages.table("genes", lambda: genes.select("gene", "sp", "seq", "len"))
    profile = stages.table("profiles", lambda: profiles.profiles(core, n, selection, aligned))
    core_species = [r[0] for r in core.select("sp").distinct().collect()]  # a row a species
    fresh = genes.where(~F.col("sp").isin(core_species))
    index = profiles.profile_index(profile, genes, pieces)
    hits = stages.table("profile_hits", lambda: profiles.profile_hits(fresh.select("gene", "seq"), index, pieces, least_shared))
    found = stages.table("assigned", lambda: similarity.assign(hits))
    stages.table("closest_species", lambda: similarity.closest_species(found, genes))
    added = found.join(genes.select("gene", "sp"), "gene").select("og", "sp", "gene")
    grouped = stages.table("grouped", lambda: core.unionByName(added))
    rest = stages.table("not_grouped", lambda: orthogroups.not_grouped(grouped, genes.select("sp", "gene")).select("gene").join(genes, "gene"))
    kept = orthogroups.of_size(grouped, 2).select("og")
    members = grouped.join(kept, "og", "left_semi").select("og", "gene")
    if species_tree is not None:
        clades = stages.table("clades", lambda: new_species_clades(stages.spark, species_tree, core_species))

        def clade_groups() -> DataFrame:
            between = clade_hits(rest, clades, pieces, least)
            edges = clustering.cut(gathering.orthogroup_graph(between, rest.select("gene", "sp", "len"), gathering.normalise_by_length))
            labels = clustering.markov(edges, inflation) if flow else clustering.components(edges)
            return orthogroups.renumber(labels.join(genes.select("gene", "sp"), "gene"))

        own = stages.table("clade_groups", clade_groups)
        members = results.merged_groups(members, own.select("og", "gene"))
    merged = stages.table("merged", lambda: members.join(genes.select("gene", "sp"), "gene").select("og", "sp", "gene"))
    return stages.table("members", lambda: orthogroups.with_singletons(merged, genes.select("sp", "gene")))
