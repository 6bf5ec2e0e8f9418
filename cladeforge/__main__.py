"""Groups of sequence files, gene trees and orthologs: three commands.

``python -m cladeforge FASTA_FOLDER OUTPUT [-s TREE]`` finds orthogroups, and with a species tree goes on to orthologs. ``python -m cladeforge NEW_FASTA_FOLDER OUTPUT
--assign CORE_OUTPUT [-s TREE]`` adds species to the groups of an earlier run. ``python -m cladeforge TREE_FOLDER OUTPUT --resolve [-s TREE]`` rearranges gene trees. A
run that was ended goes on at its first unfinished stage when it is started again.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.operators import clustering, gathering, genetrees, orthogroups, profiles, results, similarity, species_trees
from cladeforge.plans import assignment
from cladeforge.sources import sequences, sinks
from cladeforge.sources.stages import Stages


def run(
    spark: SparkSession, folder: str, output: str, k: int = 5, least: float = 0.1, inflation: float = 1.2, components: bool = False, scores_v2: bool = False, species_tree: str | None = None, unrooted: bool = False, rearrange: bool = True,
    stop: str | None = None, infer: bool = False, only: list[str] | None = None, species_info: str | None = None,
) -> DataFrame:
    """Read, join by k-mers, gather, cluster, write; with a rooted species tree (Newick) also trees and what they give. Returns (og, sp, gene). ``stop``: "sequences",
    "hits", "groups" or "trees", after which no more is done (the last table made comes back). ``infer``: without a species tree, make one of the gene trees.
    ``only``: the species to read. ``species_info``: a table of ``sequences.read_species_info``, with which groups are written as OrthoXML too."""
    settings = {"folder": folder, "k": k, "least": least, "inflation": inflation, "components": components, "scores_v2": scores_v2, "species_tree": species_tree, "unrooted": unrooted, "rearrange": rearrange, "infer": infer}
    if only is not None:
        settings["only"] = sorted(only)
    stages = Stages(spark, f"{output}/Stages", settings)
    seqs = stages.table("sequences", lambda: sequences.read_fasta(spark, folder, only=only))
    if stop == "sequences":
        return seqs
    genes = seqs.select("accession", F.col("species").alias("sp"), "len", F.concat("species_id", F.lit("_"), "seq_idx").alias("gene"), "residues")

    def all_hits() -> DataFrame:
        pieces = genes.select("gene", F.array_distinct(similarity.kmers(F.col("residues"), k)).alias("pieces"))
        index = pieces.select("gene", F.size("pieces").alias("n_pieces"), F.explode("pieces").alias("text")).select(F.xxhash64("text").alias("piece"), "gene", "n_pieces")
        return similarity.jaccard_join(index, least)

    hits = stages.table("hits", all_hits)
    if stop == "hits":
        return hits
    normalise = gathering.normalise_by_length if scores_v2 else gathering.normalise_by_fit
    edges = stages.table("edges", lambda: gathering.orthogroup_graph(hits, genes, normalise))
    labels = stages.table("labels", lambda: clustering.components(edges) if components else clustering.markov(edges, inflation))
    grouped = stages.table("grouped", lambda: orthogroups.renumber(labels.join(genes.select("gene", "sp"), "gene")))
    members = stages.table("members", lambda: orthogroups.with_singletons(grouped, genes).join(genes.select("gene", "accession"), "gene").select("og", "sp", F.col("accession").alias("gene")))
    species = species_of(genes)
    sinks.write_groups(members, species, output)
    sinks.write_unassigned_fasta(genes.select(F.col("accession").alias("gene"), "sp", F.col("residues").alias("seq")), members, f"{output}/Unassigned_Sequences")
    if species_info is not None:
        sinks.write_orthoxml(members, f"{output}/Orthogroups.orthoxml", sequences.read_species_info(spark, species_info, species))
    if (species_tree is not None or infer) and stop != "groups":
        named = genes.select("gene", "sp", F.concat_ws("|", "sp", "accession").alias("name"))
        scored = normalise(gathering.with_genes(gathering.best_per_pair(hits), genes))
        write_orthologs(stages, grouped, scored, named, species, species_tree, output, unrooted, rearrange, stop)
    return members


def species_of(genes: DataFrame) -> list[str]:
    return [r[0] for r in genes.select("sp").distinct().orderBy("sp").collect()]  # a row a species


def write_orthologs(stages: Stages, grouped: DataFrame, scored: DataFrame, named: DataFrame, species: list, species_tree: str | None, output: str, unrooted: bool = False, rearrange: bool = True, stop: str | None = None) -> None:
    """Gene trees from hits, reconciled with a rooted species tree (Newick): ortholog pairs, duplications, hierarchical groups and their statistics.
    ``named``: (gene, sp, name), name being ``species|accession``. With ``unrooted`` the species tree's root is chosen by supported duplications. Without a species tree one is
    made: by consensus where there is a group with all species, else from the median distances between species; its root is chosen likewise."""
    a, b = (named.select(F.col("gene").alias(c), F.col("name").alias(f"n_{c}")) for c in "ab")

    def distances() -> DataFrame:
        d = genetrees.group_distances(grouped, scored)
        return d.join(a, "a").join(b, "b").select("og", F.col("n_a").alias("a"), F.col("n_b").alias("b"), "d")

    trees = stages.table("gene_trees", lambda: genetrees.distance_trees(distances()))
    trees.select("og", "newick").write.mode("overwrite").parquet(f"{output}/Gene_Trees")
    if stop == "trees":
        return
    if species_tree is None:
        found, n = species_trees.species_tree(trees, species)
        if found is None:
            found = species_trees.distance_species_tree(genetrees.species_distances(genetrees.closest_species_distances(genetrees.group_distances(grouped, scored), named)))
        species_tree, unrooted = found, len(species) > 2
        named.sparkSession.createDataFrame([(found, n)], "species_tree string, gene_trees long").coalesce(1).write.mode("overwrite").json(f"{output}/Unrooted_Species_Tree")
    confirmed = named.select(F.array("name").alias("genes")).where("false")
    if unrooted:
        supported = stages.table("supported", lambda: genetrees.supported_duplications(trees, species_tree))
        confirmed = supported.where("genes is not null").select("genes")
        species_tree, support, probable = genetrees.species_tree_root(supported, species_tree)
        rows = [(", ".join(sorted(r)), p, species_tree, support) for r, p in probable.items()]
        named.sparkSession.createDataFrame(rows, "outgroup string, probability double, species_tree string, support long").coalesce(1).write.mode("overwrite").json(f"{output}/Species_Tree")  # a row a branch
    rows = stages.table("reconciled", lambda: genetrees.reconciled(trees, species_tree, rearrange_trees=rearrange))
    if rearrange:
        genetrees.rearranged(trees, species_tree).write.mode("overwrite").parquet(f"{output}/Resolved_Gene_Trees")
    genes = named.select(F.col("name").alias("gene"), "sp")
    sides = stages.table("sides", lambda: genetrees.ortholog_sides(rows, genes))
    orthologs = stages.table("orthologs", lambda: results.ortholog_rows(sides.where("not suspect")))
    one_way = orthologs.where("sp_a < sp_b").select("og", "sp_a", F.split("genes_a", ", ").alias("genes_a"), "sp_b", F.split("genes_b", ", ").alias("genes_b"))
    sinks.write_orthologs(one_way, f"{output}/Orthologues")
    dups = rows.where("kind = 'duplication'").select("og", "level", "node", "support", "genes_1", "genes_2")
    sinks.write_duplications(results.duplication_rows(dups, confirmed), f"{output}/Duplications.tsv")
    sinks.write_table(results.suspect_rows(sides), f"{output}/Putative_Xenologs")
    sinks.write_statistics(results.multiplicity_totals(orthologs), dups, species, f"{output}/Comparative_Genomics_Statistics")
    sinks.write_hogs(rows.where("kind = 'hog'").select("og", "level", "node", F.col("genes_1").alias("genes")), genes, species, f"{output}/Phylogenetic_Hierarchical_Orthogroups")
    sinks.write_by_species(rows.where("kind = 'misplaced'").select(F.col("genes_1")[0].alias("gene")).join(genes, "gene"), f"{output}/Misplaced_Genes")
    sinks.write_table(rows.where("kind = 'unreadable'").select("og", F.col("node").alias("problem")), f"{output}/Unreadable_Gene_Trees")


def assign(spark: SparkSession, folder: str, output: str, core: str, species_tree: str | None = None, k: int = 5, least: float = 0.1, n_profile: int = 20, inflation: float = 1.2, components: bool = False) -> DataFrame:
    """Species of a folder of sequence files added to the groups that an earlier run (or addition) left in ``core``. Returns (og, sp, gene), gene being ``species|accession``."""
    settings = {"folder": folder, "k": k, "least": least, "n_profile": n_profile, "species_tree": species_tree, "inflation": inflation, "components": components}
    stages = Stages(spark, f"{output}/Stages", settings, previous=f"{core}/Stages")
    earlier = stages.chain()[1]
    known = earlier.find("sequences")
    first = known.agg(F.max("species_id")).first()[0] + 1
    new = stages.table("new_sequences", lambda: sequences.read_fasta(spark, folder, least=1, first_id=first))
    clash = [r[0] for r in new.select("species").distinct().join(known.select("species").distinct(), "species").collect()]
    if clash:
        raise ValueError(f"species that the groups have already: {', '.join(sorted(clash))}")
    seqs = stages.table("sequences", lambda: known.unionByName(new))
    named = F.concat_ws("|", F.col("species"), F.col("accession"))
    genes = seqs.select(named.alias("gene"), F.col("species").alias("sp"), F.col("residues").alias("seq"), "len")
    members = earlier.find("members")
    full = F.when(F.col("gene").contains("|"), F.col("gene")).otherwise(F.concat_ws("|", "sp", "gene")).alias("gene")
    out = assignment.assign(stages, members.select("og", "sp", full), genes, species_tree, profiles.letter_pieces(k), n_profile, least=least, inflation=inflation, flow=not components)
    sinks.write_groups(out, species_of(genes), output)
    profile = stages.find("profiles")
    sinks.write_fasta(profiles.profile_names(profile, genes), f"{output}/Profile_Sequences", by=None)
    sinks.write_table(stages.find("closest_species").orderBy("sp"), f"{output}/Closest_Species")
    return out


def resolve(spark: SparkSession, folder: str, output: str, species_tree: str | None = None, separator: str = "_") -> DataFrame:
    """Gene trees of a folder, a file each, rooted on a species tree if there is one, rearranged, their nodes named D or S; (og, newick, n_moves), og being the
    file's name, and a file a tree. Trees that can't be read are listed in ``Unreadable_Gene_Trees``."""
    texts = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("og"), F.trim("value").alias("newick"))
    out = clustering.cut(genetrees.rearranged(texts, species_tree, separator, events=True))
    out.repartition("og").select("og", F.col("newick").alias("value")).write.mode("overwrite").partitionBy("og").text(f"{output}/Resolved_Gene_Trees")
    sinks.write_table(genetrees.unreadable(texts), f"{output}/Unreadable_Gene_Trees")
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("folder")
    p.add_argument("output")
    p.add_argument("--assign", metavar="CORE_OUTPUT", help="add the folder's species to the groups of this run")
    p.add_argument("--resolve", action="store_true", help="the folder holds gene trees: rearrange them")
    p.add_argument("-I", "--inflation", type=float, default=1.2)
    p.add_argument("-k", type=int, default=5, help="k-mer length")
    p.add_argument("--least", type=float, default=0.1, help="least Jaccard similarity of a hit")
    p.add_argument("--components", action="store_true", help="connected components in place of flow clusters")
    p.add_argument("--scores-v2", action="store_true", help="normalise by length alone")
    p.add_argument("-s", "--species-tree", help="file with the rooted species tree (Newick); gene trees are made and reconciled with it")
    p.add_argument("--unrooted", action="store_true", help="choose the species tree's root by supported duplications")
    p.add_argument("--infer-species-tree", action="store_true", help="without a species tree, make one of the gene trees")
    p.add_argument("--no-rearrangement", action="store_true", help="reconcile gene trees as they are")
    p.add_argument("--profile-genes", type=int, default=20, help="with --assign: genes of a group's profile")
    p.add_argument("--separator", default="_", help="with --resolve: what parts species and gene in a leaf's name")
    p.add_argument("--only", nargs="+", metavar="SPECIES", help="read the files of these species only")
    p.add_argument("--species-info", help="table of sequence file, name, taxon number, database and version: groups are written as OrthoXML too")
    p.add_argument("--stop", choices=["sequences", "hits", "groups", "trees"], help="the last stage to be done")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    tree = None if a.species_tree is None else "".join(r[0] for r in spark.read.text(a.species_tree).collect())  # one tree
    if a.resolve:
        resolve(spark, a.folder, a.output, tree, a.separator)
    elif a.assign:
        assign(spark, a.folder, a.output, a.assign, tree, a.k, a.least, a.profile_genes, a.inflation, a.components)
    else:
        run(spark, a.folder, a.output, a.k, a.least, a.inflation, a.components, a.scores_v2, tree, a.unrooted, not a.no_rearrangement, a.stop, a.infer_species_tree, a.only, a.species_info)


if __name__ == "__main__":
    main()
