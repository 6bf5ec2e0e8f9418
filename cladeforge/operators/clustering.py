"""Markov clustering and connected components as DataFrame loops; each round is a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.functions import flow


def shared_folder(df: DataFrame) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder will do for a session on one machine, on a cluster that is an error."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="cladeforge-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Spark's setting for deleting a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder, which is computed once and survives lost executors; what was shuffled for it is deleted."""
    path = f"{shared_folder(df)}/cladeforge/cut-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of ``cut`` that nothing will read again."""
    for file in table.inputFiles()[:1]:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(q, h) edges -> (gene, og) with og the smallest gene reachable. Labels of neighbours are taken until none changes,
    with a step to the label's own label in each round (pointer jumping), so that paths shorten by half."""
    both = cut(edges.select("q", "h").union(edges.select("h", "q")).where("q is not null and h is not null").distinct())
    labels = cut(both.groupBy("q").agg(F.least(F.col("q"), F.min("h")).alias("og")).withColumnRenamed("q", "gene"))
    while True:
        near = both.join(labels.select(F.col("gene").alias("h"), F.col("og").alias("near")), "h").groupBy("q").agg(F.min("near").alias("near"))
        step = labels.join(near, labels["gene"] == near["q"]).select("gene", "og", F.least("og", "near").alias("new"))
        jump = labels.select(F.col("gene").alias("new"), F.col("og").alias("far"))
        step = cut(step.join(jump, "new", "left").select("gene", "og", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = step.where("og <> new").limit(1).count()
        labels = step.select("gene", F.col("new").alias("og"))
        if not changed:
            return labels


#: Components of up to so many genes are clustered as one dense matrix each; larger ones by joins.
DENSE = 1000


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """(q, h, weight) -> (i, j, w), both directions with their larger weight; no loops, nulls or weights of 0."""
    e = edges.select(F.col("q").alias("j"), F.col("h").alias("i"), F.col("weight").cast("double").alias("w")).where("w > 0 and i is not null and j is not null and i <> j")
    return e.union(e.select(F.col("i").alias("j"), F.col("j").alias("i"), "w")).groupBy("i", "j").agg(F.max("w").alias("w"))


def markov(edges: DataFrame, inflation: float = 1.2, rounds: int = 30, keep: int = 500, floor: float = 1e-4, tolerance: float = 1e-4) -> DataFrame:
    """Markov clustering (van Dongen 2000) of (q, h, weight) -> (gene, og), og the smallest gene of the cluster.

    Self loops weigh a node's largest edge. The first matrix is pruned as later ones are. Each round squares the column-stochastic matrix, drops entries below ``floor`` and beyond the ``keep`` largest of a
    column, raises to ``inflation`` and renormalises, until no entry moves by ``tolerance``. Clusters are what the limit connects. No flow
    leaves a component, so components of up to ``DENSE`` genes are a matrix in one task each, and only larger ones are squared by joins.
    """
    both = cut(symmetric_edges(edges))
    parts = components(both.select(F.col("i").alias("q"), F.col("j").alias("h"))).withColumnRenamed("og", "part")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    whole = cut(both.join(parts.join(sizes, "part"), F.col("j") == F.col("gene")).select("part", "n", "i", "j", "w"))
    kind = dict(both.dtypes)["i"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return flow.clusters(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["w"].to_numpy(), inflation, rounds, keep, floor, tolerance)

    small = whole.where(F.col("n") <= DENSE).select("part", "i", "j", "w").groupBy("part").applyInPandas(one, f"gene {kind}, og {kind}")
    large = whole.where(F.col("n") > DENSE).select("i", "j", "w")
    if large.isEmpty():
        return small
    return small.unionByName(markov_by_joins(large, inflation, rounds, keep, floor, tolerance))


def stochastic(m: DataFrame) -> DataFrame:
    """Columns that sum to one; sums are combined before they are joined, so that a long column isn't one task's."""
    total = m.groupBy("j").agg(F.sum("w").alias("cf_total"))
    return m.join(total, "j").select("i", "j", F.round(F.col("w") / F.col("cf_total"), 9).alias("w"))


def pruned(m: DataFrame, keep: int, floor: float) -> DataFrame:
    """Entries of ``floor`` and more, the ``keep`` largest of each column."""
    ranked = m.where(F.col("w") >= floor).withColumn("rn", F.row_number().over(Window.partitionBy("j").orderBy(F.desc("w"), "i")))
    return ranked.where(F.col("rn") <= keep).drop("rn")


def flow_start(both: DataFrame, keep: int, floor: float) -> DataFrame:
    """The first matrix of symmetric (i, j, w): with self loops, stochastic, and pruned like all that follow, so that a hub's column has ``keep`` entries when it is squared."""
    loops = both.groupBy("j").agg(F.max("w").alias("w")).select(F.col("j").alias("i"), "j", "w")
    return stochastic(pruned(stochastic(both.select("i", "j", "w").union(loops)), keep, floor))


def flow_square(m: DataFrame) -> DataFrame:
    """The matrix times itself. Of the pairs that meet at a node one side is that node's column, at most ``keep`` entries: so there are at most ``keep`` times as many pairs as entries."""
    left = m.select("i", F.col("j").alias("k"), F.col("w").alias("wl"))
    right = m.select(F.col("i").alias("k"), "j", F.col("w").alias("wr"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("wl") * F.col("wr")).alias("w"))


def markov_by_joins(both: DataFrame, inflation: float, rounds: int, keep: int, floor: float, tolerance: float) -> DataFrame:
    """``markov`` of symmetric (i, j, w) as a loop of joins on the middle node; entries are rounded, so that the order of sums doesn't matter."""
    m = cut(flow_start(both, keep, floor))
    for _ in range(rounds):
        top = pruned(flow_square(m), keep, floor)
        new = cut(stochastic(top.withColumn("w", F.pow("w", F.lit(inflation)))).where(F.col("w") >= floor))
        moved = new.join(m.withColumnRenamed("w", "old"), ["i", "j"], "full").agg(F.max(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("d")).first()["d"]
        discard(m)
        m = new
        if moved is None or moved < tolerance:
            break
    return components(m.where("w > 0.01").select(F.col("i").alias("q"), F.col("j").alias("h")))
