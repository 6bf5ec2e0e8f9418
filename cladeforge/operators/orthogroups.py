"""Tables and statistics of groups. ``members``: (og, sp, gene)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeforge.operators.ranking import with_rank

#: Lower edges of the size histogram's bins.
SIZE_EDGES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 16, 21, 51, 101, 151, 201, 501, 1001]


def name(og: Column) -> Column:
    return F.format_string("OG%07d", og)


def renumber(members: DataFrame) -> DataFrame:
    """Group numbers by size, largest first, then smallest member."""
    sizes = members.groupBy("og").agg(F.count(F.lit(1)).alias("n"), F.min("gene").alias("first"))
    ranked = with_rank(sizes, -F.col("n"), F.col("first"), name="new")
    return members.join(ranked.select("og", "new"), "og").drop("og").withColumnRenamed("new", "og").select("og", "sp", "gene")


def lines(members: DataFrame) -> DataFrame:
    """(og, line): the group's name and its sorted genes."""
    return members.groupBy("og").agg(F.array_join(F.array_sort(F.collect_list(F.col("gene").cast("string"))), " ").alias("genes")).select("og", F.concat(name(F.col("og")), F.lit(": "), "genes").alias("line"))


def gene_table(members: DataFrame, species: list, least: int = 2) -> DataFrame:
    """One column per species with its sorted genes; groups of ``least`` genes and more."""
    big = members.groupBy("og").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("og")
    cells = F.array_join(F.array_sort(F.collect_list(F.col("gene").cast("string"))), ", ")
    return members.join(big, "og", "left_semi").groupBy("og").pivot("sp", species).agg(cells).na.fill("")


def unassigned(members: DataFrame) -> DataFrame:
    """Members of groups of one."""
    return members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("og"))).where("n = 1").drop("n")


def counts(members: DataFrame) -> DataFrame:
    """(og, sp, n) of the species that a group has."""
    return members.groupBy("og", "sp").agg(F.count(F.lit(1)).alias("n"))


def count_table(members: DataFrame, species: list, least: int = 2) -> DataFrame:
    """Genes per group and species, one column each, and their total."""
    wide = members.groupBy("og").pivot("sp", species).count().na.fill(0)
    total = sum((F.col(f"`{s}`") for s in species), F.lit(0))
    return wide.withColumn("total", total).where(F.col("total") >= least)


def of_size(members: DataFrame, least: int) -> DataFrame:
    """Groups of at least so many genes, with their sizes."""
    return members.groupBy("og").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def species_overlap(members: DataFrame) -> DataFrame:
    """(sp_a, sp_b, n): groups that both species are in; the diagonal counts a species' groups."""
    present = members.select("og", "sp").distinct()
    return present.withColumnRenamed("sp", "sp_a").join(present.withColumnRenamed("sp", "sp_b"), "og").groupBy("sp_a", "sp_b").agg(F.count(F.lit(1)).alias("n"))


def with_singletons(members: DataFrame, genes: DataFrame) -> DataFrame:
    """The groups and, as groups of one, genes that are in none; ids go on from the largest."""
    rest = genes.join(members.select("gene").distinct(), "gene", "left_anti").select("sp", "gene")
    last = members.agg(F.coalesce(F.max("og"), F.lit(-1)).alias("last"))
    numbered = with_rank(rest, F.col("gene"), name="rn").withColumn("rn", F.col("rn") + 1).crossJoin(F.broadcast(last))  # one row
    return members.select("og", "sp", "gene").unionByName(numbered.select((F.col("last") + F.col("rn")).cast(members.schema["og"].dataType).alias("og"), "sp", "gene"))


def not_grouped(members: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes that are in no group of two or more."""
    grouped = members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("og"))).where("n > 1").select("gene")
    return genes.join(grouped, "gene", "left_anti")


def size_histogram(members: DataFrame, spark: SparkSession) -> DataFrame:
    """(lo, n_groups, n_genes, pct_groups, pct_genes) by mean genes per species, zero bins included."""
    n_sp = members.select("sp").distinct().count()
    sizes = members.groupBy("og").agg(F.count(F.lit(1)).alias("n")).withColumn("mean", F.floor(F.col("n") / n_sp))
    return _binned(sizes, spark, "mean", [])


def species_histogram(members: DataFrame, spark: SparkSession) -> DataFrame:
    """The same per species, by the species' own genes in a group."""
    return _binned(counts(members).withColumn("size", F.col("n")), spark, "size", ["sp"])


def _binned(sizes: DataFrame, spark: SparkSession, by: str, keys: list[str]) -> DataFrame:
    edges = F.array(*(F.lit(x) for x in SIZE_EDGES))
    lo = F.array_max(F.filter(edges, lambda e: e <= F.col(by)))
    got = sizes.withColumn("lo", lo).groupBy(*keys, "lo").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_genes"))
    bins = spark.sql(f"select explode(array({', '.join(map(str, SIZE_EDGES))})) as lo")
    grid = sizes.select(*keys).distinct().crossJoin(F.broadcast(bins)) if keys else bins  # bins: a fixed list
    out = grid.join(got, [*keys, "lo"], "left").na.fill(0, ["n_groups", "n_genes"])
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    pct = lambda c: F.round(100 * F.col(c) / F.sum(c).over(whole), 1)
    return out.withColumn("pct_groups", pct("n_groups")).withColumn("pct_genes", pct("n_genes"))


def n50(members: DataFrame) -> DataFrame:
    """(g50, o50): sizes ascending, the size at which the running sum first passes half of all, and how many groups are from
    there to the largest. Sizes are first counted, so that the running sum is over distinct sizes only."""
    sizes = members.groupBy("og").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("k"))
    up = Window.orderBy("size")
    rows = sizes.withColumn("below", F.sum(F.col("size") * F.col("k")).over(up) - F.col("size") * F.col("k")).withColumn("total", F.sum(F.col("size") * F.col("k")).over(Window.partitionBy(F.lit(0))))
    rows = rows.withColumn("above", F.sum("k").over(Window.orderBy(F.desc("size")))).where(F.col("below") + F.col("size") * F.col("k") > F.col("total") / 2)
    skipped = F.floor((F.col("total") / 2 - F.col("below")) / F.col("size"))  # groups of this size that come before
    return rows.select(F.col("size").alias("g50"), (F.col("above") - F.greatest(skipped, F.lit(0))).cast("long").alias("o50"), F.row_number().over(up).alias("rn")).where("rn = 1").drop("rn")


def species_totals(genes: DataFrame) -> DataFrame:
    """(sp, n_genes) of (sp, gene)."""
    return genes.groupBy("sp").agg(F.count(F.lit(1)).alias("n_genes"))


def overall(members: DataFrame, totals: DataFrame) -> DataFrame:
    """One row of figures over all species. ``totals``: (sp, n_genes), as ``species_totals`` makes."""
    n_sp = totals.where("sp is not null").count()
    per = members.groupBy("og").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sp").alias("k")).where("n > 1")
    got = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_assigned"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("k") == 1).alias("n_specific"), F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("n"))), F.lit(0)).alias("genes_specific"),
        F.round(F.avg("n"), 1).alias("mean_size"), F.percentile("n", F.lit(0.5)).alias("median_size"), F.count_if(F.col("k") == n_sp).alias("n_all_species"), F.count_if((F.col("k") == n_sp) & (F.col("n") == n_sp)).alias("n_single_copy"),
    )
    total = totals.agg(F.sum("n_genes").alias("n_genes"))
    return total.crossJoin(got).withColumn("n_unassigned", F.col("n_genes") - F.col("n_assigned")).withColumn("pct_assigned", F.round(100 * F.col("n_assigned") / F.col("n_genes"), 1))  # two single rows


def per_species(members: DataFrame, totals: DataFrame) -> DataFrame:
    """One row of figures per species. ``totals``: (sp, n_genes), as ``species_totals`` makes."""
    sized = members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("og"))).withColumn("k", F.size(F.collect_set("sp").over(Window.partitionBy("og")))).where("n > 1")
    got = sized.groupBy("sp").agg(F.count(F.lit(1)).alias("n_assigned"), F.countDistinct("og").alias("n_groups"), F.countDistinct(F.when(F.col("k") == 1, F.col("og"))).alias("n_specific"), F.count_if(F.col("k") == 1).alias("genes_specific"))
    out = totals.join(got, "sp", "left").na.fill(0)
    n_groups = sized.agg(F.countDistinct("og").alias("all_groups"))
    out = out.crossJoin(F.broadcast(n_groups))  # one row
    return out.withColumn("n_unassigned", F.col("n_genes") - F.col("n_assigned")).withColumn("pct_assigned", F.round(100 * F.col("n_assigned") / F.col("n_genes"), 1)).withColumn("pct_groups", F.round(100 * F.col("n_groups") / F.col("all_groups"), 1)).drop("all_groups")


def multicopy_allowance(n_species: int, factor: float = 0.25, limit: float = 0.25) -> list[int]:
    """For 0 to n-1 species in which a group isn't single copy, the most of them that may be multicopy.

    A group of which k species aren't single is taken as long as the chance 1 - (1 - factor * m / n)^(n - k) of a hidden
    fault stays within ``limit``; none are allowed beyond k itself.
    """
    out = []
    for k in range(n_species):
        fits = [m for m in range(k + 1) if 1 - (1 - factor * m / n_species) ** (n_species - k) <= limit]
        out.append(max(fits))
    return out


def single_copy(members: DataFrame, fraction: float, n_species: int | None = None) -> DataFrame:
    """Groups in which more than ``fraction`` of all species are single copy and few enough of the rest are multicopy."""
    n_sp = n_species or members.select("sp").distinct().count()
    allowed = F.array(*(F.lit(m) for m in multicopy_allowance(n_sp)))
    per = counts(members).groupBy("og").agg(F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multi"))
    return per.where((F.col("single") > fraction * n_sp) & (F.col("multi") <= F.coalesce(F.get(allowed, n_sp - F.col("single")), F.lit(0))))


def occupancy(members: DataFrame, n_species: int | None = None) -> DataFrame:
    """(k, n): groups in which at least k species are single copy, within the multicopy allowance."""
    n_sp = n_species or members.select("sp").distinct().count()
    allowed = F.array(*(F.lit(m) for m in multicopy_allowance(n_sp)))
    per = counts(members).groupBy("og").agg(F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multi"))
    per = per.where(F.col("multi") <= F.coalesce(F.get(allowed, n_sp - F.col("single")), F.lit(0))).groupBy("single").agg(F.count(F.lit(1)).alias("n"))
    grid = members.sparkSession.range(1, n_sp + 1).select(F.col("id").cast("int").alias("k"))
    return grid.join(F.broadcast(per), per["single"] >= grid["k"], "left").groupBy("k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))  # a row a species


def choose_occupancy(found: list[tuple[int, int]], enough: int = 1000, least: int = 100, gain: float = 2.0, steep_gain: float = 4.0) -> int:
    """The number of species to ask for: from all downwards, stop with ``enough`` groups; with ``least``, go on only while
    one species fewer pays in groups (proportionally ``gain``, or ``steep_gain`` below half of the species)."""
    n_by, top = dict(found), max(k for k, _ in found)
    k = top
    while k > 2:
        n = n_by[k]
        if n > enough:
            return k
        if n >= least:
            after = n_by[k - 1]
            share = (after - n) / n / (1 / k)
            if share < (gain if k - 1 > top / 2 else steep_gain):
                return k
        k -= 1
    return k
