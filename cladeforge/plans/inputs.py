"""The driver's tables in the roles of genes, species, lengths, hits and groups, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_genes(spark, sf_dir) -> DataFrame:
    """Parts as genes, brands as species, sizes as lengths."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("sp"), F.col("p_size").alias("len"))


def part_hits(spark, sf_dir) -> DataFrame:
    """One row for each two lines of an order with different parts; the score is the lesser quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    a, b = li.alias("a"), li.alias("b")
    return a.join(b, F.expr("a.l_orderkey = b.l_orderkey and a.l_linenumber <> b.l_linenumber and a.l_partkey <> b.l_partkey")).select(
        F.col("a.l_partkey").alias("q"), F.col("b.l_partkey").alias("h"), F.least("a.l_quantity", "b.l_quantity").alias("score")
    )


PART_GENES = "genes as (select p_partkey as gene, p_brand as sp, p_size as len from part)"
PART_HITS = """raw as (select a.l_partkey as q, b.l_partkey as h, least(a.l_quantity, b.l_quantity) as score
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber <> b.l_linenumber and a.l_partkey <> b.l_partkey)"""


def supplier_members(spark, sf_dir) -> DataFrame:
    """Parts as groups, suppliers' nations as species, suppliers as genes: each (part, supplier) once."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").distinct()
    return li.select("l_partkey", "l_suppkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("og"), F.col("s_nationkey").alias("sp"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("gene"))


SUPPLIER_MEMBERS = """members as (select distinct l_partkey as og, s_nationkey as sp, l_partkey * 1000000 + l_suppkey as gene
  from lineitem join supplier on l_suppkey = s_suppkey)"""


def document_genes(spark, sf_dir) -> DataFrame:
    """Documents as genes, sources as species, texts as sequences."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("gene"), F.col("source").alias("sp"), F.col("n_chars").alias("len"), F.col("text").alias("seq"))


def heap_nodes(spark, sf_dir) -> DataFrame:
    """Parts from 1 on as the nodes of one binary tree, node k below k div 2; leaves' species are brands."""
    p = table(spark, sf_dir, "part").where("p_partkey >= 1")
    top = p.agg(F.max("p_partkey").alias("top"))
    return p.crossJoin(F.broadcast(top)).select(  # one row
        F.lit(0).cast("long").alias("tree"), F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2).cast("long")).alias("parent"),
        F.round(F.col("p_size") / 10.0, 1).alias("dist"), (F.col("p_partkey") * 2 > F.col("top")).alias("is_leaf"), F.when(F.col("p_partkey") * 2 > F.col("top"), F.col("p_brand")).alias("sp"),
    )


HEAP_NODES = """nodes as (select 0::bigint as tree, p_partkey as node, case when p_partkey > 1 then p_partkey // 2 end as parent, round(p_size / 10.0, 1) as dist,
  p_partkey * 2 > (select max(p_partkey) from part) as is_leaf, case when p_partkey * 2 > (select max(p_partkey) from part) then p_brand end as sp from part where p_partkey >= 1)"""
