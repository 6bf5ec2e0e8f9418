"""Results as files. All are Spark writers, partitioned by what a reader would pick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.operators import alignments, orthogroups, results
from cladeforge.operators.ranking import with_rank


def write_groups(members: DataFrame, species: list, path: str) -> None:
    """Group lines, gene table, unassigned genes and counts, each a folder under ``path``; tables end lines with CRLF."""
    orthogroups.lines(members).orderBy("og").select("line").write.mode("overwrite").text(f"{path}/Orthogroups.txt")
    named = lambda df: df.withColumn("Orthogroup", orthogroups.name(F.col("og"))).orderBy("og").select("Orthogroup", *[c for c in df.columns if c != "og"])
    write_table(named(orthogroups.gene_table(members, species)), f"{path}/Orthogroups.tsv")
    write_table(named(orthogroups.gene_table(orthogroups.unassigned(members), species, least=1)), f"{path}/Orthogroups_UnassignedGenes.tsv")
    write_table(named(orthogroups.count_table(members, species).withColumnRenamed("total", "Total")), f"{path}/Orthogroups.GeneCount.tsv")


def write_table(df: DataFrame, path: str, compress: bool = False) -> None:
    """Tab-separated rows, lines ended with CRLF. Part files keep the order of ``df``; each has the header."""
    cells = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))
    writer = cells.write.mode("overwrite").options(sep="\t", header=True, lineSep="\r\n", quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    (writer.option("compression", "gzip") if compress else writer).csv(path)


def write_hogs(hogs: DataFrame, genes: DataFrame, species: list, path: str) -> None:
    """(og, level, node, genes) as a table for each level, ``path``/level=N0 and so on: HOG, OG, Gene Tree Parent Clade, and a column of genes for each species.
    Rows are numbered in their level by group and node. ``genes``: (gene, sp)."""
    rows = results.numbered_hogs(hogs.select("og", "level", "node", "genes"))
    cells = rows.select("level", "hog", "og", "node", F.explode("genes").alias("gene")).join(genes.select("gene", "sp"), "gene")
    wide = cells.groupBy("level", "hog", "og", "node").pivot("sp", species).agg(F.array_join(F.array_sort(F.collect_list("gene")), ", ")).na.fill("")
    line = F.concat_ws("\t", "hog", orthogroups.name(F.col("og")), F.coalesce("node", F.lit("-")), *(F.col(f"`{s}`") for s in species))
    title = "\t".join(["HOG", "OG", "Gene Tree Parent Clade", *map(str, species)])
    body = wide.select("level", F.lit(1).alias("part"), "hog", line.alias("value"))
    head = wide.select("level").distinct().select("level", F.lit(0).alias("part"), F.lit("").alias("hog"), F.lit(title).alias("value"))
    head.union(body).repartition("level").sortWithinPartitions("level", "part", "hog").select("level", "value").write.mode("overwrite").option("lineSep", "\r\n").partitionBy("level").text(path)


def write_duplications(rows: DataFrame, path: str) -> None:
    """``results.duplication_rows`` as one table, by group and node."""
    out = rows.orderBy("og", "node").select(orthogroups.name(F.col("og")).alias("Orthogroup"), F.col("level").alias("Species Tree Node"), F.col("node").alias("Gene Tree Node"), F.col("support").alias("Support"), F.col("type").alias("Type"), F.col("genes_1").alias("Genes 1"), F.col("genes_2").alias("Genes 2"))
    write_table(out, path)


def write_statistics(totals: DataFrame, dups: DataFrame, species: list, path: str) -> None:
    """Five matrices of ortholog totals, and duplications by species-tree node and by group."""
    names = {"total": "Totals", "one_one": "one-to-one", "one_many": "one-to-many", "many_one": "many-to-one", "many_many": "many-to-many"}
    for column, name in names.items():
        write_table(results.square(totals, column, species).orderBy("sp_a").withColumnRenamed("sp_a", ""), f"{path}/OrthologuesStats_{name}.tsv")
    columns = {"n": "Duplications (all)", "n_50": "Duplications (50% support)"}
    write_table(results.duplications_per_level(dups).orderBy("level").withColumnsRenamed({"level": "Species Tree Node", **columns}), f"{path}/Duplications_per_Species_Tree_Node.tsv")
    by_group = results.duplications_per_group(dups).orderBy("og").select(orthogroups.name(F.col("og")).alias("Orthogroup"), "n", "n_50")
    write_table(by_group.withColumnsRenamed(columns), f"{path}/Duplications_per_Orthogroup.tsv")


def write_clusters(members: DataFrame, path: str) -> None:
    """(og, gene) as cluster records, ``<og> <ids> $``, in order of groups."""
    members.groupBy("og").agg(F.array_join(F.array_sort(F.collect_list("gene")), " ").alias("ids")).orderBy("og").select(F.concat_ws(" ", F.col("og").cast("string"), "ids", F.lit("$")).alias("value")).write.mode("overwrite").text(path)


def write_by_species(rows: DataFrame, path: str) -> None:
    """(sp, gene), a folder for each species, genes in order: misplaced or unassigned genes."""
    rows.repartition("sp").sortWithinPartitions("sp", "gene").select("sp", F.col("gene").cast("string").alias("value")).write.mode("overwrite").partitionBy("sp").text(path)


def write_sorted(df: DataFrame, path: str, *order: str) -> None:
    """A table in order of ``order``, with its rows numbered in a first column ``row``."""
    ranked = with_rank(df, *map(F.col, order), name="row").orderBy("row")
    write_table(ranked.select("row", *df.columns), path)


def write_fasta(rows: DataFrame, path: str, by: str | None = "og", width: int = 80) -> None:
    """(by, name, seq) to FASTA, a folder for each value of ``by``, sequences in order of names."""
    body = F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n"))
    if by is None:
        rows.orderBy("name").select(body.alias("value")).write.mode("overwrite").text(path)
    else:
        rows.repartition(F.col(by)).sortWithinPartitions(by, "name").select(F.col(by), body.alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def write_graph(edges: DataFrame, path: str) -> None:
    """One line a node: ``<id>    <id>:<weight> ... $`` with three decimals."""
    per = edges.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("h", "weight"))).alias("e"))
    cells = F.array_join(F.transform("e", lambda x: F.concat(x["h"].cast("string"), F.lit(":"), F.format_string("%.3f", x["weight"]))), " ")
    per.orderBy("q").select(F.concat(F.col("q").cast("string"), F.lit("    "), cells, F.lit(" $"))).write.mode("overwrite").text(path)


def write_orthologs(pairs: DataFrame, path: str, compress: bool = False) -> None:
    """(og, sp_a, genes_a, sp_b, genes_b), both directions, a folder for each species and other species."""
    both = pairs.select("og", "sp_a", "genes_a", "sp_b", "genes_b").union(pairs.select("og", "sp_b", "genes_b", "sp_a", "genes_a"))
    rows = both.select("sp_a", "sp_b", F.concat_ws("\t", orthogroups.name(F.col("og")), F.array_join("genes_a", ", "), F.array_join("genes_b", ", ")).alias("value"))
    writer = rows.repartition("sp_a", "sp_b").sortWithinPartitions("sp_a", "sp_b", "value").write.mode("overwrite").partitionBy("sp_a", "sp_b")
    (writer.option("compression", "gzip") if compress else writer).text(path)


def orthoxml(members: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """(part, at, line): an OrthoXML document's lines, in order of (part, at): genes (og, sp, gene) by species, numbered over all, then groups. ``info``: ``read_species_info``;
    without it species have no taxon number. A line holds a gene, so that no row grows with a genome or a group."""
    quote = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    place = lambda c, step, k: F.concat(c, F.lit("\t" + step), F.lpad(k.cast("string"), 19, "0"))
    sp, zero = F.col("sp").cast("string"), F.lit(0)
    genes = with_rank(members.select(sp.alias("sp"), F.col("gene").cast("string").alias("gene")).distinct(), F.col("sp"), F.col("gene"), name="id")
    species = genes.select("sp").distinct()
    if info is None:
        head = F.concat(F.lit('  <species name="'), quote(sp), F.lit('">\n    <database>\n      <genes>'))
    else:
        species = species.join(info, "sp")
        database = F.concat(F.lit('">\n    <database name="'), quote(F.col("source")), F.lit('" version="'), quote(F.col("version")), F.lit('">\n      <genes>'))
        head = F.concat(F.lit('  <species name="'), quote(F.col("name")), F.lit('" NCBITaxId="'), quote(F.col("taxon")), database)
    opened = species.select(F.lit(1).alias("part"), place(sp, "0", zero).alias("at"), head.alias("line"))
    closed = species.select(F.lit(1), place(sp, "2", zero), F.lit("      </genes>\n    </database>\n  </species>"))
    each = genes.select(F.lit(1), place(sp, "1", F.col("id")), F.concat(F.lit('        <gene id="'), F.col("id").cast("string"), F.lit('" geneId="'), quote(F.col("gene")), F.lit('"/>')))
    og = F.lpad(F.col("og").cast("string"), 19, "0")
    groups = members.select("og").distinct()
    refs = members.select("og", sp.alias("sp"), F.col("gene").cast("string").alias("gene")).distinct().join(genes, ["sp", "gene"])
    refs = refs.select(F.lit(3), place(og, "1", F.col("id")), F.concat(F.lit('      <geneRef id="'), F.col("id").cast("string"), F.lit('"/>')))
    begun = groups.select(F.lit(3), place(og, "0", zero), F.concat(F.lit('    <orthologGroup id="'), F.col("og").cast("string"), F.lit('">')))
    ended = groups.select(F.lit(3), place(og, "2", zero), F.lit("    </orthologGroup>"))
    frame = members.sparkSession.createDataFrame([(0, "", '<orthoXML version="0.3" origin="cladeforge" xmlns="http://orthoXML.org/2011/">'), (2, "", "  <groups>"), (4, "", "  </groups>\n</orthoXML>")], "part int, at string, line string")
    for rows in (opened, each, closed, begun, refs, ended):
        frame = frame.union(rows)
    return frame


def write_orthoxml(members: DataFrame, path: str, info: DataFrame | None = None) -> None:
    """The document as part files that follow each other."""
    orthoxml(members, info).orderBy("part", "at").select("line").write.mode("overwrite").text(path)


def write_stockholm(aligned: DataFrame, path: str) -> None:
    """Alignments (og, gene, aligned) as Stockholm records; a record is whole in its part file."""
    alignments.stockholm(aligned).repartition("og").sortWithinPartitions("og", "part", "gene").select("line").write.mode("overwrite").text(path)


def write_named_fasta(seqs: DataFrame, names: DataFrame, path: str, by: str | None = "og") -> None:
    """Sequences (by, gene, seq) of the genes that ``names`` (gene, name) has, under those names."""
    picked = seqs.join(names.select("gene", "name").dropDuplicates(["gene"]), "gene")
    write_fasta(picked.select(*([] if by is None else [by]), "name", "seq"), path, by)


def write_unassigned_fasta(genes: DataFrame, members: DataFrame, path: str) -> None:
    """Sequences (gene, sp, seq) of the genes that aren't in a group of ``members`` (og, gene) with another gene, a folder a species."""
    grouped = members.select("sp", "gene").join(orthogroups.unassigned(members), ["sp", "gene"], "left_anti")
    loose = genes.join(grouped, ["sp", "gene"], "left_anti")
    write_fasta(loose.select("sp", F.col("gene").alias("name"), "seq"), path, by="sp")


def write_species_orthologs(pairs: DataFrame, path: str, compress: bool = False) -> None:
    """(og, sp_a, genes_a, sp_b, genes_b), both directions, as a table for each species: Orthogroup, Species, its genes, the other species' genes."""
    both = pairs.select("og", "sp_a", "genes_a", "sp_b", "genes_b").union(pairs.select("og", "sp_b", "genes_b", "sp_a", "genes_a"))
    title = F.concat_ws("\t", F.lit("Orthogroup"), F.lit("Species"), "sp_a", F.lit("Orthologs"))
    line = F.concat_ws("\t", orthogroups.name(F.col("og")), "sp_b", F.array_join("genes_a", ", "), F.array_join("genes_b", ", "))
    rows = both.select("sp_a", F.lit(1).alias("part"), line.alias("value")).union(both.select("sp_a").distinct().select("sp_a", F.lit(0), title))
    _write_lines(rows, ["sp_a"], path, compress)


def split_orthologs(spark: SparkSession, folder: str, path: str, compress: bool = False) -> None:
    """Tables of ``write_species_orthologs``, gzipped or not, as one for each pair of species: Orthogroup and a column of each."""
    lines = spark.read.option("basePath", folder).text(folder).withColumn("f", F.split(F.regexp_replace("value", "\r$", ""), "\t")).where(F.size("f") == 4)
    rows = lines.select(F.col("sp_a").cast("string").alias("sp_a"), "f").where("f[1] <> 'Species'").select("sp_a", F.col("f")[1].alias("sp_b"), F.concat_ws("\t", F.col("f")[0], F.col("f")[2], F.col("f")[3]).alias("value"))
    title = rows.select("sp_a", "sp_b").distinct().select("sp_a", "sp_b", F.lit(0).alias("part"), F.concat_ws("\t", F.lit("Orthogroup"), "sp_a", "sp_b").alias("value"))
    _write_lines(rows.select("sp_a", "sp_b", F.lit(1).alias("part"), "value").union(title), ["sp_a", "sp_b"], path, compress)


def _write_lines(rows: DataFrame, by: list[str], path: str, compress: bool) -> None:
    """(by..., part, value) as text, a folder for each key, the title (part 0) first."""
    writer = rows.repartition(*by).sortWithinPartitions(*by, "part", "value").select(*by, "value").write.mode("overwrite").option("lineSep", "\r\n").partitionBy(*by)
    (writer.option("compression", "gzip") if compress else writer).text(path)


def write_hog_fasta(hogs: DataFrame, seqs: DataFrame, path: str, level: str = "N0") -> None:
    """Sequences (gene, seq) of each hierarchical group of a level, a folder a group. ``hogs``: (hog, level, genes)."""
    rows = hogs.where(F.col("level") == level).select("hog", F.explode("genes").alias("gene")).join(seqs.select("gene", "seq"), "gene")
    write_fasta(rows.select("hog", F.col("gene").alias("name"), "seq"), path, by="hog")
