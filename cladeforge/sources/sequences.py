"""FASTA, hit, cluster and group files as DataFrames, and back. Reading is Spark's text reader, so any store will do."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeforge.operators.alignments import checked

#: File name extensions of sequence files, letters no nucleotide sequence has, and fields of a hit row.
EXTENSIONS = ["fa", "faa", "fasta", "fas", "pep"]
PROTEIN_ONLY = "EFILPQ"
HIT_FIELDS = "qid string, hid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, hstart int, hend int, evalue double, bitscore double"


def read_fasta(spark: SparkSession, folder: str | list[str], least: int = 2, first_id: int = 0, only: list[str] | None = None) -> DataFrame:
    """(species_id, species, seq_idx, header, accession, residues, len) of the sequence files of a folder, or several, gzipped or not; of the species ``only`` (file
    names without their ending), if that is given, and other files aren't read. A species that is asked for and not there, or there twice, is an error.

    Species are numbered from ``first_id`` in order of file names, sequences in order within their file. Residues are upper-cased. The accession is the
    header's first word with ``: , ( )`` as ``_``; where that repeats within a species, all of the header is used. Records
    without a header, or a folder with fewer than ``least`` files, are errors.
    """
    glob = "{" + ",".join(f"*.{e}{z}" for e in EXTENSIONS for z in ("", ".gz")) + "}"
    raw = spark.read.option("lineSep", "\n>").option("pathGlobFilter", glob).text(folder).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    if only is not None:
        raw = raw.where(stem(F.col("file")).isin(only))
    raw = raw.where(~F.col("file").startswith("._") & (F.trim("value") != ""))
    text = F.regexp_replace("value", "^>", "")
    head = F.trim(F.regexp_extract(text, r"^([^\n]*)", 1))
    body = F.upper(F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"\s+", ""))
    rows = raw.select("file", "start", "at", F.when(head == "", F.raise_error(F.concat(F.lit("blank header in "), "file"))).otherwise(head).alias("header"), body.alias("residues"))
    there = [tuple(r) for r in raw.select("file", F.regexp_replace("path", "[^/]*$", "").alias("place")).distinct().collect()]  # a row a file
    names = [re.sub(r"\.[^.]*(\.gz)?$", "", file) for file, _ in there]
    if bad := sorted({n for n in names if names.count(n) > 1} | (set(only or ()) - set(names))):
        raise ValueError(f"species without a file, or with several, in {folder}: {', '.join(bad)}")
    files = rows.select("file").distinct().withColumn("species_id", F.row_number().over(Window.orderBy("file")) - 1 + first_id)  # a row a species
    if files.limit(least).count() < least:
        raise ValueError(f"fewer than {least} sequence files in {folder}")
    rows = rows.join(F.broadcast(files), "file").withColumn("seq_idx", F.row_number().over(Window.partitionBy("file").orderBy("start", "at")) - 1)
    first = clean(F.split("header", r"\s+")[0])
    rows = rows.withColumn("first", first).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("species_id", "first")))
    whole = F.max("n").over(Window.partitionBy("species_id")) > 1
    return rows.select("species_id", stem(F.col("file")).alias("species"), "seq_idx", "header", F.when(whole, clean(F.col("header"))).otherwise(F.col("first")).alias("accession"), "residues", F.length("residues").alias("len"))


def stem(file: Column) -> Column:
    """A sequence file's name without its ending."""
    return F.regexp_replace(file, r"\.[^.]*(\.gz)?$", "")


def record_keys(sequences: DataFrame, how: str = "first") -> DataFrame:
    """The records with ``key``: the header's first word ("first"), all of it ("line"), or the second part of its first word between signs | ("second"; a header
    without one has no key, and its record is left out). Of records of a file with one key the last stays."""
    word = F.split("header", r"\s+")[0]
    keys = {"first": word, "line": F.col("header"), "second": F.get(F.split(word, r"\|"), F.lit(1))}
    if how not in keys:
        raise ValueError(f"no such key: {how}")
    last = Window.partitionBy("species_id", "key").orderBy(F.desc("seq_idx"))  # records of one key
    return sequences.withColumn("key", keys[how]).where("key is not null").withColumn("cf_at", F.row_number().over(last)).where("cf_at = 1").drop("cf_at")


def clean(column: Column) -> Column:
    return F.regexp_replace(column, "[:,()]", "_")


def nucleotide_species(sequences: DataFrame) -> DataFrame:
    """Species none of whose sequences has a letter that only proteins have."""
    return sequences.groupBy("species_id", "species").agg(F.bool_or(F.col("residues").rlike(f"[{PROTEIN_ONLY}]")).alias("protein")).where("not protein").drop("protein")


def offsets(sequences: DataFrame) -> DataFrame:
    """(species_id, n, start): counts and exclusive running sums. One row a species meets in the window."""
    n = sequences.groupBy("species_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("start", F.sum("n").over(Window.orderBy("species_id")) - F.col("n"))


def longest_per_gene(sequences: DataFrame, gene: Column) -> DataFrame:
    """The longest record of each gene, the first among equals; records without a gene are kept."""
    rows = sequences.withColumn("gene_key", gene)
    best = rows.where("gene_key is not null").withColumn("rn", F.row_number().over(Window.partitionBy("species_id", "gene_key").orderBy(F.desc("len"), "seq_idx"))).where("rn = 1").drop("rn")
    return best.unionByName(rows.where("gene_key is null"))


def gene_of_header(header: Column) -> Column:
    """The one ``gene:``, ``gene=``, ``locus:`` or ``locus=`` token of a header, else null."""
    found = F.regexp_extract_all(header, F.lit(r"(?:gene|locus)[:=](\S+)"), 1)
    return F.when(F.size(found) == 1, found[0])


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """(q, h, score, evalue) of tab-separated hit rows; a row with other than twelve fields or without a score is an error."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"), "value").where(F.trim("value") != "")
    bad = F.raise_error(F.concat(F.lit("malformed hit row: "), "value"))
    score = F.expr("try_cast(f[11] as double)")
    ok = (F.size("f") == 12) & score.isNotNull()
    return rows.select(F.when(ok, F.col("f")[0]).otherwise(bad.cast("string")).alias("q"), F.col("f")[1].alias("h"), score.alias("score"), F.expr("try_cast(f[10] as double)").alias("evalue"))


def both_ways(hits: DataFrame) -> DataFrame:
    """Hits of searches made in one direction only, (q, h, ...), and each the other way; a hit of a gene with itself stays one."""
    return hits.union(hits.where("q <> h").select(*(F.col({"q": "h", "h": "q"}.get(c, c)).alias(c) for c in hits.columns)))


def unknown_ids(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """(id) of hits' ends that ``genes`` (gene) doesn't have."""
    return hits.select(F.explode(F.array("q", "h")).alias("id")).distinct().join(genes.select(F.col("gene").alias("id")), "id", "left_anti")


def read_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """(og, gene, aligned) of a folder's aligned sequence files, a file a group named by it, gzipped or not. Rows of unequal length are an error where they are read."""
    glob = "{" + ",".join(f"*.{e}{z}" for e in EXTENSIONS for z in ("", ".gz")) + "}"
    raw = spark.read.option("lineSep", "\n>").option("pathGlobFilter", glob).text(folder).select(stem(F.col("_metadata.file_name")).alias("og"), F.regexp_replace("value", "^>", "").alias("text"))
    rows = raw.where(F.trim("text") != "").select("og", F.trim(F.regexp_extract("text", r"^([^\n]*)", 1)).alias("gene"), F.regexp_replace(F.regexp_replace("text", r"^[^\n]*", ""), r"\s+", "").alias("aligned"))
    return checked(rows)


def read_species_info(spark: SparkSession, path: str, species: list[str]) -> DataFrame:
    """(sp, name, taxon, source, version) of tab-separated rows: sequence file, name, taxon number, source database and its file. Rows of other files are left out. A row
    with other than five fields, or a species of ``species`` without a row, is an error."""
    rows = spark.read.text(path).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"), "value").where(F.trim("value") != "")
    file = F.when(F.size("f") == 5, F.col("f")[0]).otherwise(F.raise_error(F.concat(F.lit("species information needs five fields: "), "value")).cast("string"))
    found = rows.select(F.regexp_replace(file, r"\.[^.]*$", "").alias("sp"), *(F.get("f", F.lit(k)).alias(c) for k, c in enumerate(("name", "taxon", "source", "version"), 1))).where(F.col("sp").isin(species))
    if missing := sorted(set(species) - {r[0] for r in found.select("sp").distinct().collect()}):  # a row a species
        raise ValueError(f"no species information for: {', '.join(missing)}")
    return found.dropDuplicates(["sp"])


def read_profile_hits(spark: SparkSession, path: str) -> DataFrame:
    """(gene, og, part, sp, hit, evalue) of tab-separated rows, gzipped or not, of a search against profile sequences named ``group_species_sequence``; the group may
    have a part after a point. Rows whose target isn't so named, or that lack the e-value in their last field but one, are errors."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"), "value").where(F.trim("value") != "")
    names, evalue = F.split(F.get("f", F.lit(1)), "_"), F.expr("try_cast(get(f, size(f) - 2) as double)")
    group = F.split(names[0], r"\.")
    ok = (F.size("f") >= 4) & (F.size(names) == 3) & group[0].rlike(r"^\d+$") & evalue.isNotNull()
    gene = F.when(ok, F.col("f")[0]).otherwise(F.raise_error(F.concat(F.lit("malformed profile hit: "), "value")).cast("string"))
    return rows.select(gene.alias("gene"), group[0].try_cast("long").alias("og"), F.get(group, F.lit(1)).alias("part"), F.get(names, F.lit(1)).alias("sp"), F.concat_ws("_", F.get(names, F.lit(1)), F.get(names, F.lit(2))).alias("hit"), evalue.alias("evalue"))


def read_locus_trees(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """((og, newick), (tree, name, species, event)) of a folder of ``<og>.locus.tree`` files, a tree each, and ``<og>.locus.recon`` files with a node, its species
    and its event a line. Lines with fewer fields are errors."""
    og = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    trees = spark.read.option("pathGlobFilter", "*.locus.tree").text(folder, wholetext=True).select(og.alias("og"), F.trim("value").alias("newick"))
    lines = spark.read.option("pathGlobFilter", "*.locus.recon").text(folder).select(og.alias("tree"), F.split(F.trim("value"), r"\s+").alias("f"), "value").where(F.trim("value") != "")
    name = F.when(F.size("f") >= 3, F.col("f")[0]).otherwise(F.raise_error(F.concat(F.lit("malformed reconciliation row: "), "value")).cast("string"))
    return trees, lines.select("tree", name.alias("name"), F.get("f", F.lit(1)).alias("species"), F.get("f", F.lit(2)).alias("event"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(og, gene) of a cluster file: ``<n> <ids> $`` records that may go on over lines; profile ids are left out."""
    records = spark.read.option("lineSep", "$").text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v"))
    body = F.trim(F.regexp_replace("v", r"^.*begin", ""))
    ids = F.split(body, " ")
    rows = records.where(body.rlike(r"^\d+ \S")).select(ids[0].cast("int").alias("og"), F.explode(F.slice(ids, 2, F.size(ids))).alias("gene"))
    return rows.where(~F.col("gene").startswith("Prof"))


def read_group_lists(spark: SparkSession, path: str, first: int = 3) -> DataFrame:
    """(group, species, genes): as ``read_groups``, a row for each species with its genes as an array, empty where it has none."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    cells = F.array(*(F.struct(F.lit(s).alias("species"), F.coalesce(F.col(f"`{s}`"), F.lit("")).alias("cell")) for s in wide.columns[first:]))
    return wide.select(F.col(f"`{wide.columns[0]}`").alias("group"), F.inline(cells)).select("group", "species", F.array_remove(F.split("cell", ", "), "").alias("genes"))


def read_groups(spark: SparkSession, path: str, first: int = 3) -> DataFrame:
    """(group, species, gene) of a group table whose columns from ``first`` on hold ``, ``-joined genes."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    species = wide.columns[first:]
    cells = F.array(*(F.struct(F.lit(s).alias("species"), F.col(f"`{s}`").alias("cell")) for s in species))
    return wide.select(F.col(f"`{wide.columns[0]}`").alias("group"), F.inline(cells)).where("cell is not null").select("group", "species", F.explode(F.split("cell", ", ")).alias("gene")).where("gene <> ''")
