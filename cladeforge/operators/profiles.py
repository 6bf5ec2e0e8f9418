"""Profiles of groups: representatives of each, an index of their pieces, and the groups that new genes come closest to."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.functions import representatives
from cladeforge.operators import similarity
from cladeforge.operators.clustering import cut


def keyed_sample(members: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` genes of each group, by the MD5 of seed and gene: the same ones at every layout."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("gene").cast("string")))
    return members.withColumn("cf_rn", F.row_number().over(Window.partitionBy("og").orderBy(order, "gene"))).where(F.col("cf_rn") <= n).drop("cf_rn")


def from_alignments(aligned: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(og, gene) of at most ``n`` representatives of each aligned group (og, gene, aligned), by ``representatives.pick``. A group is worked on whole
    in one task, as its alignment was; repeated genes count once."""
    kinds = dict(aligned.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        text = pdf["gene"].astype(str)
        chosen = representatives.pick(list(text), list(pdf["aligned"]), n, seed)
        return pdf.loc[text.isin(chosen), ["og", "gene"]]

    rows = aligned.select("og", "gene", "aligned").dropDuplicates(["og", "gene"])
    return rows.groupBy("og").applyInPandas(one, f"og {kinds['og']}, gene {kinds['gene']}")


def from_pieces(genes: DataFrame, n: int, k: int = 3, seed: int = 0, dims: int = 1 << 15, rounds: int = 20, seq: str = "seq") -> DataFrame:
    """(gene, cluster, shared) of at most ``n`` representatives of one set of sequences (gene, seq) of any size, without an alignment.

    Sequences are sparse vectors of the k-letter pieces that they have, clustered by k-means over all tasks; each cluster's representative has the most
    pieces that more than half of the cluster has (the smallest gene among equals). Pieces are told apart by ``dims`` hash buckets; sequences of under
    ``k`` letters have none and are left out. What a task holds is n centres of ``dims`` numbers.
    """
    sets = genes.select("gene", F.array_distinct(similarity.kmers(F.col(seq), k)).alias("pieces")).where(F.size("pieces") > 0)
    if sets.isEmpty():
        return sets.select("gene", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("shared"))
    vectors = HashingTF(inputCol="pieces", outputCol="features", numFeatures=dims, binary=True).transform(sets)
    placed = KMeans(k=n, seed=seed, maxIter=rounds, predictionCol="cluster").fit(vectors).transform(vectors) if n > 1 else vectors.withColumn("cluster", F.lit(0))
    placed = cut(placed.select("gene", "cluster", F.unwrap_udt("features")["indices"].alias("buckets")))
    rows = placed.select("gene", "cluster", F.explode("buckets").alias("bucket"))
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    shared = rows.groupBy("cluster", "bucket").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(sizes), "cluster").where("2 * n > size").select("cluster", "bucket")  # a row a cluster
    common = shared.groupBy("cluster").agg(F.collect_list("bucket").alias("common"))  # n rows of at most ``dims`` buckets; most of a cluster's rows have them, so rows aren't dealt by them
    score = F.when(F.col("common").isNull(), 0).otherwise(F.size(F.array_intersect("buckets", "common")))
    every = placed.join(F.broadcast(common), "cluster", "left").groupBy("cluster", "gene").agg(F.sum(score).alias("shared"))
    best = every.groupBy("cluster").agg(F.min(F.struct((-F.col("shared")).alias("less"), "gene")).alias("m"))
    return best.select(F.col("m.gene").alias("gene"), "cluster", (-F.col("m.less")).alias("shared"))


def profiles(members: DataFrame, n: int = 20, selection: str = "kmeans", aligned: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(og, sp, gene) of each group's profile: ``all`` genes, at most ``n`` by keyed hash (``random``), or representatives of its alignment (``kmeans``; groups
    without aligned rows by hash)."""
    if selection == "all":
        return members.select("og", "sp", "gene")
    if selection not in ("kmeans", "random"):
        raise ValueError(f"no selection {selection!r}")
    if selection == "random" or aligned is None:
        return keyed_sample(members.select("og", "sp", "gene"), n, seed)
    chosen = members.select("og", "sp", "gene").join(from_alignments(aligned, n, seed), ["og", "gene"], "left_semi")
    others = members.join(aligned.select("og").distinct(), "og", "left_anti")
    return chosen.select("og", "sp", "gene").unionByName(keyed_sample(others.select("og", "sp", "gene"), n, seed))


def profile_names(profile: DataFrame, seqs: DataFrame) -> DataFrame:
    """(name, seq) of a profile's sequences for ``sinks.write_fasta``: group in seven digits, species, gene, joined by underscores."""
    return profile.join(seqs.select("gene", "seq"), "gene").select(F.concat_ws("_", F.lpad(F.col("og").cast("string"), 7, "0"), F.col("sp").cast("string"), F.col("gene").cast("string")).alias("name"), "seq")


def letter_pieces(k: int):
    """(gene, seq) -> (piece, gene) of distinct runs of ``k`` letters, as 64-bit hashes."""
    return lambda genes: genes.select("gene", F.explode(F.transform(F.array_distinct(similarity.kmers(F.col("seq"), k)), lambda x: F.xxhash64(x))).alias("piece")).select("piece", "gene")


def word_pieces(k: int):
    """The same of runs of ``k`` words."""
    return lambda genes: similarity.shingle_index(genes, k).select("piece", "gene")


def profile_index(profile: DataFrame, seqs: DataFrame, pieces) -> DataFrame:
    """(piece, og, sp, hit): which profile genes have a piece."""
    rows = pieces(profile.select("gene").distinct().join(seqs.select("gene", "seq"), "gene"))
    return rows.join(profile, "gene").select("piece", "og", "sp", F.col("gene").alias("hit"))


def profile_hits(genes: DataFrame, index: DataFrame, pieces, least: int = 3) -> DataFrame:
    """(gene, og, sp, hit, evalue) of profile genes that share ``least`` pieces and more with new genes (gene, seq); evalue is minus their number, as the
    logarithm of an expectation would be: the lower, the closer."""
    shared = pieces(genes).withColumnRenamed("gene", "new").join(index, "piece").groupBy("new", "og", "sp", "hit").agg(F.count(F.lit(1)).alias("n"))
    return shared.where(F.col("n") >= least).select(F.col("new").alias("gene"), "og", "sp", "hit", (-F.col("n")).cast("double").alias("evalue"))


def close_groups(hits: DataFrame, within: Column | float = 10.0) -> DataFrame:
    """(gene, og, evalue) of all groups whose best evalue (a logarithm) is less than ``within`` over the gene's best."""
    per = hits.groupBy("gene", "og").agg(F.min("evalue").alias("evalue"))
    best = per.groupBy("gene").agg(F.min("evalue").alias("cf_best"))
    return per.join(best, "gene").where(F.col("evalue") - F.col("cf_best") < within).select("gene", "og", "evalue")
