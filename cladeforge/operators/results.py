"""What reconciled trees give: ortholog, duplication and hierarchical-group tables.

``sides``: (og, node, side, sp, gene), the genes on each side (0, 1) of a speciation node. ``dups``: (og, level, node, support,
genes_1, genes_2). Rows of one node meet in one group; nothing larger does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cell(genes: str) -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.col(genes).cast("string"))), ", ")


def ortholog_rows(sides: DataFrame) -> DataFrame:
    """(og, node, sp_a, genes_a, n_a, sp_b, genes_b, n_b) of every two species across a node, both directions."""
    cells = sides.groupBy("og", "node", "side", "sp").agg(_cell("gene").alias("genes"), F.count(F.lit(1)).alias("n"))
    other = cells.select("og", "node", F.col("side").alias("o_side"), F.col("sp").alias("sp_b"), F.col("genes").alias("genes_b"), F.col("n").alias("n_b"))
    rows = cells.join(other, ["og", "node"]).where("side <> o_side and sp <> sp_b")
    return rows.select("og", "node", F.col("sp").alias("sp_a"), F.col("genes").alias("genes_a"), F.col("n").alias("n_a"), "sp_b", "genes_b", "n_b")


def multiplicity_totals(rows: DataFrame) -> DataFrame:
    """(sp_a, sp_b, total, one_one, one_many, many_one, many_many): genes of sp_a with orthologs in sp_b, by how many there are on each side."""
    one = lambda cond, value: F.sum(F.when(F.expr(cond), value).otherwise(F.lit(0))).alias
    n_a = F.col("n_a")
    return rows.groupBy("sp_a", "sp_b").agg(F.sum("n_a").alias("total"), one("n_a = 1 and n_b = 1", n_a)("one_one"), one("n_a = 1 and n_b > 1", n_a)("one_many"), one("n_a > 1 and n_b = 1", n_a)("many_one"), one("n_a > 1 and n_b > 1", n_a)("many_many"))


def square(totals: DataFrame, value: str, species: list) -> DataFrame:
    """A matrix of one of the totals, a row and a column a species, 0 where a pair has none."""
    rows = totals.sparkSession.createDataFrame([(s,) for s in species], totals.select("sp_a").schema)
    return rows.join(totals.groupBy("sp_a").pivot("sp_b", species).agg(F.sum(value)), "sp_a", "left").na.fill(0)


def gene_pairs(sides: DataFrame) -> DataFrame:
    """(og, node, a, b): every ortholog pair of genes, the side 0 gene first."""
    b = sides.where("side = 1").select("og", "node", F.col("sp").alias("sp_b"), F.col("gene").alias("b"))
    return sides.where("side = 0").join(b, ["og", "node"]).where("sp <> sp_b").select("og", "node", F.col("gene").alias("a"), "b")


def suspect_rows(sides: DataFrame) -> DataFrame:
    """(og, node, sp_a, genes_a, sp_b, genes_b), both directions: ``suspect`` genes of a side against all genes of the other."""
    key = ["og", "node", "side", "sp"]
    odd = sides.where("suspect").groupBy(key).agg(_cell("gene").alias("genes_a"))
    every = sides.groupBy(key).agg(_cell("gene").alias("genes_b")).withColumnsRenamed({"side": "o_side", "sp": "sp_b"})
    rows = odd.join(every, ["og", "node"]).where("side <> o_side and sp <> sp_b").select("og", "node", F.col("sp").alias("sp_a"), "genes_a", "sp_b", "genes_b")
    return rows.unionByName(rows.select("og", "node", F.col("sp_b").alias("sp_a"), F.col("genes_b").alias("genes_a"), F.col("sp_a").alias("sp_b"), F.col("genes_a").alias("genes_b")))


def misplaced(sides: DataFrame) -> DataFrame:
    """(sp, gene) of every suspect gene, once."""
    return sides.where("suspect").select("sp", "gene").distinct()


def duplication_rows(dups: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(og, level, node, support, type, genes_1, genes_2) with sorted genes joined. ``confirmed``: (genes), sorted arrays of the genes below
    duplications that the species tree's root was found by. Levels that don't start with N are species."""
    both = dups.withColumn("genes", F.array_sort(F.concat("genes_1", "genes_2")))
    marked = both.join(confirmed.select("genes").distinct().withColumn("known", F.lit(True)), "genes", "left")
    kind = F.when(~F.col("level").startswith("N"), "Terminal").when(F.col("known"), "Non-Terminal: STRIDE").otherwise("Non-Terminal")
    join = lambda c: F.array_join(F.array_sort(c), ", ").alias(c)
    return marked.select("og", "level", "node", "support", kind.alias("type"), join("genes_1"), join("genes_2"))


def duplications_per_level(dups: DataFrame, key: str = "level") -> DataFrame:
    """(key, n, n_50): duplications and those with a support of a half or more."""
    return dups.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("support") >= 0.5).alias("n_50"))


def duplications_per_group(dups: DataFrame) -> DataFrame:
    """(og, n, n_50) of groups 0 to the largest with a duplication; 0 where a group has none."""
    top = dups.agg(F.max("og").alias("top"))  # one row
    grid = top.where("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias("og"))
    return grid.join(duplications_per_level(dups, "og"), "og", "left").na.fill(0)


def numbered_hogs(rows: DataFrame) -> DataFrame:
    """(level, og, node, ...) -> the same with ``hog``, ``N0.HOG0000000`` and on in each level by (og, node). Rows are ranked within their group, and
    group sizes summed over a level, so that no task holds a level's rows."""
    inside = rows.withColumn("rank", F.row_number().over(Window.partitionBy("level", "og").orderBy("node")))
    sizes = rows.groupBy("level", "og").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.partitionBy("level").orderBy("og")) - F.col("n")).drop("n")
    number = F.col("start") + F.col("rank") - 1
    return inside.join(starts, ["level", "og"]).withColumn("hog", F.concat("level", F.format_string(".HOG%07d", number))).drop("rank", "start")


def ancestors_of_species(species_tree: DataFrame) -> DataFrame:
    """(node, above, steps) from a species tree's (node, parent), a driver's table of a row a node: itself and all above it."""
    tree = {r["node"]: r["parent"] for r in species_tree.select("node", "parent").collect()}  # a row a species-tree node
    rows = []
    for node in tree:
        at, steps = node, 0
        while at is not None:
            rows.append((node, at, steps))
            at, steps = tree[at], steps + 1
    return species_tree.sparkSession.createDataFrame(rows, "node string, above string, steps long")


def small_group_levels(members: DataFrame, paths: DataFrame) -> DataFrame:
    """(og, level) of groups of two or three genes, which have no tree: every level above the species' common ancestor, and that itself
    for groups of several species. ``paths`` is ``ancestors_of_species``; species are named as its leaves."""
    size = members.groupBy("og").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sp").alias("n_sp")).where("n between 2 and 3")
    seen = members.join(size, "og").select("og", "n_sp", "sp").distinct().join(F.broadcast(paths), F.col("sp") == F.col("node"))  # a row a pair of species-tree nodes
    common = seen.groupBy("og", "n_sp", "above").agg(F.count(F.lit(1)).alias("k")).where("k = n_sp").select("og", "n_sp", "above")
    return common.join(F.broadcast(paths.groupBy("node").agg(F.max("steps").alias("depth"))), F.col("above") == F.col("node")).withColumn("deepest", F.max("depth").over(Window.partitionBy("og"))).where("n_sp > 1 or depth < deepest").select("og", F.col("above").alias("level"))


def small_group_sides(members: DataFrame) -> DataFrame:
    """``sides`` of groups of two or three genes: of two species, each on its side; of three, the first (by species, gene) against the others, and then
    those two. Groups of one species have none."""
    size = members.groupBy("og").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("sp")).alias("sps")).where("n between 2 and 3 and size(sps) > 1")  # three genes at most
    rows = members.join(size, "og").withColumn("at", F.expr("array_position(sps, sp)"))
    two = rows.where("size(sps) = 2").select("og", F.lit(0).alias("node"), (F.col("at") - 1).cast("int").alias("side"), "sp", "gene")
    three = rows.where("size(sps) = 3")
    first = three.select("og", F.lit(0).alias("node"), (F.col("at") > 1).cast("int").alias("side"), "sp", "gene")
    rest = three.where("at > 1").select("og", F.lit(1).alias("node"), (F.col("at") > 2).cast("int").alias("side"), "sp", "gene")
    return two.union(first).union(rest)


def merged_groups(assigned: DataFrame, more: DataFrame) -> DataFrame:
    """(og, gene) of assigned genes and, numbered on from the largest, of further groups."""
    last = assigned.agg(F.coalesce(F.max("og") + 1, F.lit(0)).alias("last"))
    return assigned.select("og", "gene").unionByName(more.crossJoin(F.broadcast(last)).select((F.col("og") + F.col("last")).alias("og"), "gene"))  # one row


def coorthologs(pairs: DataFrame) -> DataFrame:
    """(a, b) -> (a, other): genes of the first species that share an ortholog of the second, themselves included. Each two genes meet once, and
    the other way round is added to what is distinct. A null gene comes before all."""
    once = pairs.select("a", "b").where("b is not null").distinct()
    two = once.join(once.select(F.col("a").alias("other"), "b"), "b").where("a < other or a is null and other is not null").select("a", "other").distinct()
    both = two.select(F.inline(F.array(F.struct("a", "other"), F.struct(F.col("other").alias("a"), F.col("a").alias("other")))))
    return once.select("a").distinct().select("a", F.col("a").alias("other")).union(both)


def same_orthologs(pairs: DataFrame) -> DataFrame:
    """(genes_a, genes_b): genes of the first species grouped by the orthologs that they have in the second."""
    sets = pairs.select("a", "b").distinct().groupBy("a").agg(_cell("b").alias("genes_b"))
    return sets.groupBy("genes_b").agg(_cell("a").alias("genes_a")).select("genes_a", "genes_b")


def locus_sides(nodes: DataFrame, events: DataFrame, genes: DataFrame) -> DataFrame:
    """(og, node, side, sp, gene) of the speciations of reconciled locus trees. ``nodes``: ``genetrees.tree_nodes``; ``events``: (tree, name, event), a row a node;
    ``genes``: gene, sp. A speciation whose name no node has is the root's. Nodes of other than two children have none."""
    spec = events.where("event = 'spec'").select("tree", "name").distinct()
    known = spec.join(nodes.select("tree", "name", "node"), ["tree", "name"], "left")
    root = nodes.where("parent is null").select("tree", F.col("node").alias("root"))
    at = known.join(root, "tree").select("tree", F.coalesce("node", "root").alias("parent")).distinct()
    child = Window.partitionBy("tree", "parent").orderBy("node")
    kids = nodes.join(at, ["tree", "parent"]).select("tree", "parent", "node", (F.row_number().over(child) - 1).alias("side"), F.count(F.lit(1)).over(Window.partitionBy("tree", "parent")).alias("n"), "pre", (F.col("post") + F.col("depth")).alias("last"))
    leaf = nodes.where("is_leaf").select("tree", F.col("name").alias("gene"), F.col("pre").alias("at"))
    below = kids.where("n = 2").join(leaf, "tree").where("at between pre and last")
    return below.join(genes.select("gene", "sp"), "gene").select(F.col("tree").alias("og"), F.col("parent").alias("node"), "side", "sp", "gene")


def ortholog_classes(pairs: DataFrame) -> DataFrame:
    """(sp_a, sp_b, genes_a, genes_b): genes of a species that have the same orthologs in another, and those. ``pairs``: (a, sp_a, b, sp_b)."""
    sets = pairs.select("sp_a", "sp_b", "a", "b").distinct().groupBy("sp_a", "sp_b", "a").agg(_cell("b").alias("genes_b"))
    return sets.groupBy("sp_a", "sp_b", "genes_b").agg(_cell("a").alias("genes_a")).select("sp_a", "sp_b", "genes_a", "genes_b")


def enough_for_species_tree(members: DataFrame, n_species: int, least: int = 100) -> DataFrame:
    """(n, enough): groups with all species, and whether there are ``least``."""
    full = members.groupBy("og").agg(F.count_distinct("sp").alias("n_sp")).where(F.col("n_sp") == n_species)
    return full.agg(F.count(F.lit(1)).alias("n")).withColumn("enough", F.col("n") >= least)


def counts_from_cells(table: DataFrame, species: list[str]) -> DataFrame:
    """A group table's ``, ``-joined cells as numbers of genes; empty and null ones are 0."""
    size = lambda s: F.when(F.coalesce(F.col(f"`{s}`"), F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(F.col(f"`{s}`"), ", "))).cast("long").alias(s)
    return table.select("og", *(size(s) for s in species))


def parsimony_roots(clades: DataFrame, observed: DataFrame) -> DataFrame:
    """(clade, against) of the root candidates with the fewest contradictions. ``clades``: (clade, species) rows of each candidate; ``observed``: (id,
    n, species) rows of duplications' species sets. A set contradicts a clade if it has species inside and outside."""
    # ids of the same species are one row from here on
    sets = observed.groupBy("id", "n").agg(F.array_sort(F.collect_set("species")).alias("species")).groupBy("species").agg(F.sum("n").alias("n"))
    wanted = clades.groupBy("clade").agg(F.collect_set("species").alias("inside"))
    common = F.size(F.array_intersect("species", "inside"))
    against = sets.crossJoin(F.broadcast(wanted)).where((common > 0) & (common < F.size("species"))).groupBy("clade").agg(F.sum("n").alias("against"))  # species-tree rows
    every = clades.select("clade").distinct().join(against, "clade", "left").na.fill(0, ["against"])
    least = every.agg(F.min("against").alias("least"))  # one row
    return every.crossJoin(F.broadcast(least)).where("against = least").drop("least")
