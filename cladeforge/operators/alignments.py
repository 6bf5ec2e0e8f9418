"""Alignments as rows (og, gene, aligned): columns, trimming, names and formats.

A column is (og, pos), counted from partial sums over tasks, so that no task holds a group's grid; a row of an alignment is split into letters where it is read, and
put together again from the kept places only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Letters that stand for no residue.
GAPS = ["-", "*"]


def checked(aligned: DataFrame) -> DataFrame:
    """The rows; reading one of a group whose rows differ in length is an error."""
    width = aligned.groupBy("og").agg(F.min(F.length("aligned")).alias("cf_least"), F.max(F.length("aligned")).alias("cf_most"))
    whole = F.when(F.col("cf_least") == F.col("cf_most"), F.col("aligned")).otherwise(F.raise_error(F.concat(F.lit("rows of unequal length in "), F.col("og").cast("string"))).cast("string"))
    return aligned.join(width, "og").withColumn("aligned", whole).drop("cf_least", "cf_most")


def cells(aligned: DataFrame, gaps: bool = False) -> DataFrame:
    """(og, gene, pos, letter): residues with their columns, from 0 on; with ``gaps`` those too. A null or empty row has none."""
    rows = aligned.where("aligned <> ''").select("og", "gene", F.posexplode(F.split("aligned", "")).alias("pos", "letter"))
    return rows if gaps else rows.where(~F.col("letter").isin(GAPS))


def columns(aligned: DataFrame) -> DataFrame:
    """(og, pos, n_rows, n_letters, n_kinds, top, n_top): of each column its rows, residues, different residues, and the most frequent one (the first in order among
    equals; null in a column of gaps)."""
    per = cells(aligned, gaps=True).groupBy("og", "pos", "letter").agg(F.count(F.lit(1)).alias("n"))
    real = ~F.col("letter").isin(GAPS)
    best = F.min(F.when(real, F.struct((-F.col("n")).alias("n"), "letter")))
    out = per.groupBy("og", "pos").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("n_letters"), F.count_if(real).alias("n_kinds"), best.alias("best"))
    return out.select("og", "pos", "n_rows", "n_letters", "n_kinds", F.col("best.letter").alias("top"), (-F.col("best.n")).alias("n_top"))


def kept_columns(aligned: DataFrame, least_share: float = 0.1, least_columns: int = 500, least_letters: float = 0.75) -> DataFrame:
    """(og, pos) of the columns to keep: those with residues in ``least_share`` of the rows, or in as many rows as let ``least_columns`` columns and ``least_letters``
    of all residues stay. Groups of ``least_columns`` columns or fewer keep all."""
    counted = columns(aligned).select("og", "pos", "n_rows", "n_letters")
    steps = counted.groupBy("og", "n_letters").agg(F.count(F.lit(1)).alias("n"), F.max("n_rows").alias("n_rows"))  # at most a row a row
    down = Window.partitionBy("og").orderBy(F.desc("n_letters")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.col("n") * F.col("n_letters")).over(Window.partitionBy("og"))
    stay = steps.select("og", "n_letters", "n_rows", F.sum("n").over(down).alias("cols"), F.sum(F.col("n") * F.col("n_letters")).over(down).alias("letters"), total.alias("total"), F.sum("n").over(Window.partitionBy("og")).alias("width"))
    enough = (F.col("cols") >= least_columns) & (F.col("letters") >= least_letters * F.col("total"))
    least = stay.groupBy("og").agg(F.when(F.max("width") <= least_columns, F.lit(0.0)).otherwise(F.least(least_share * F.max("n_rows"), F.max(F.when(enough, F.col("n_letters"))))).alias("least"))
    return counted.join(least, "og").where("n_letters >= least").select("og", "pos")


def trimmed(aligned: DataFrame, **limits: float) -> DataFrame:
    """The rows with ``kept_columns`` only."""
    keep = kept_columns(aligned, **limits).groupBy("og").agg(F.array_sort(F.collect_list("pos")).alias("cf_keep"))  # at most an alignment's width
    letters = F.split("aligned", "")
    return aligned.join(keep, "og").withColumn("aligned", F.array_join(F.transform("cf_keep", lambda i: F.get(letters, i)), "")).drop("cf_keep")


def varied(aligned: DataFrame, least: int = 4) -> DataFrame:
    """Rows of the groups that have at least ``least`` different rows."""
    groups = aligned.select("og", "aligned").distinct().groupBy("og").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return aligned.join(groups, "og", "left_semi")


def renamed(aligned: DataFrame, names: DataFrame) -> DataFrame:
    """The rows with genes named by ``names`` (gene, name); those without a name keep theirs."""
    known = names.select("gene", F.col("name").alias("cf_name")).dropDuplicates(["gene"])
    return aligned.join(known, "gene", "left").withColumn("gene", F.coalesce("cf_name", F.col("gene").cast("string"))).drop("cf_name")


def stockholm(aligned: DataFrame) -> DataFrame:
    """(og, part, gene, line): each group as a Stockholm record, its lines in order of part and gene."""
    rows = checked(aligned.select("og", "gene", "aligned"))
    group = F.col("og").cast("string")
    body = rows.select("og", F.lit(1).alias("part"), F.col("gene").cast("string").alias("gene"), F.concat_ws(" ", F.col("gene").cast("string"), "aligned").alias("line"))
    groups, blank = rows.select("og").distinct(), F.lit("").alias("gene")
    head = groups.select("og", F.lit(0).alias("part"), blank, F.concat(F.lit("# STOCKHOLM 1.0\n#=GF AC "), group).alias("line"))
    return head.union(body).union(groups.select("og", F.lit(2).alias("part"), blank, F.lit("//").alias("line")))
