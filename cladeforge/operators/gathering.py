"""From raw similarity hits to the weighted orthogroup graph.

Tables: ``genes`` (gene, sp, len), raw ``hits`` (q, h, score), scored hits (q, h, q_sp, h_sp, lq, lh, score), edges
(q, h, weight). All species are handled in one plan; the species pair is a grouping key, never a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.operators.clustering import cut
from cladeforge.operators.ranking import with_rank

#: Smallest group that is binned, and (largest group, bin size) steps above it.
BINNED_FROM, BIN_STEPS, LAST_BIN = 100, ((1000, 20), (5000, 200)), 1000
TOLERANCE = 1e-3
PAIR = ["q_sp", "h_sp"]


def best_per_pair(hits: DataFrame) -> DataFrame:
    """The largest positive score of each (q, h); hits of a gene with itself go. Rows are dealt by h, as the join with its gene wants them next."""
    return hits.where("score > 0 and q <> h").repartition("h").groupBy("q", "h").agg(F.max("score").alias("score"))


def one_way(hits: DataFrame) -> DataFrame:
    """Both directions of hits searched one way only."""
    return hits.select("q", "h", "score").union(hits.select("h", "q", "score")).groupBy("q", "h").agg(F.max("score").alias("score"))


def unknown_genes(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene ids of hits that no sequence has; a caller treats any row as a fatal input error."""
    return hits.select(F.explode(F.array("q", "h")).alias("gene")).distinct().join(genes, "gene", "left_anti")


def with_genes(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Species and lengths of both ends; q comes last, so that rows are dealt as windows and groups by query want them."""
    q = genes.select(F.col("gene").alias("q"), F.col("sp").alias("q_sp"), F.col("len").alias("lq"))
    h = genes.select(F.col("gene").alias("h"), F.col("sp").alias("h_sp"), F.col("len").alias("lh"))
    return hits.join(h, "h").join(q, "q").select("q", "h", "q_sp", "h_sp", "lq", "lh", "score")


def top_of_length_bins(scored: DataFrame, share: float = 0.95) -> DataFrame:
    """Hits at or above the percentile of their length bin, within each species pair; small pairs are kept whole, and the
    longest hits that fill no bin go. Hits are ranked by ranges of all, so that one species pair's are spread over tasks."""
    at = with_rank(scored, F.col("q_sp"), F.col("h_sp"), F.col("lq") * F.col("lh"), F.col("q"), F.col("h"), name="cf_at")
    sizes = at.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.min("cf_at").alias("first"))
    size = F.when(F.col("n") <= BIN_STEPS[0][0], BIN_STEPS[0][1]).when(F.col("n") <= BIN_STEPS[1][0], BIN_STEPS[1][1]).otherwise(LAST_BIN)
    rows = at.join(sizes, PAIR).withColumn("size", size).withColumn("bin", F.when(F.col("n") >= BINNED_FROM, F.floor((F.col("cf_at") - F.col("first")) / F.col("size"))))
    whole = rows.where(F.col("n") < BINNED_FROM)
    binned = rows.where((F.col("n") >= BINNED_FROM) & (F.col("bin") < F.floor(F.col("n") / F.col("size"))))
    bar = binned.groupBy(*PAIR, "bin").agg(F.percentile("score", F.lit(share)).alias("bar"))  # a bin's rows at a time
    return whole.select(*scored.columns).unionByName(binned.join(bar, [*PAIR, "bin"]).where("score >= bar").select(*scored.columns))


def length_fit(scored: DataFrame, share: float = 0.95) -> DataFrame:
    """Per species pair: slope and intercept of log10 score on log10 of the lengths' product; pairs of fewer than two
    points have none."""
    x, y = F.log10(F.col("lq") * F.col("lh").cast("double")), F.log10("score")
    top = top_of_length_bins(scored, share)
    return top.groupBy(*PAIR).agg(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def normalise_by_fit(scored: DataFrame, share: float = 0.95) -> DataFrame:
    """Scores divided by what their pair's fit expects for the lengths."""
    scored = cut(scored)
    joined = scored.join(length_fit(scored, share), PAIR)
    expected = F.pow(F.lit(10.0), -F.col("b")) * F.pow("lq", -F.col("a")) * F.pow("lh", -F.col("a"))
    return joined.withColumn("score", F.col("score") * expected).select(*scored.columns)


def normalise_by_length(scored: DataFrame) -> DataFrame:
    """Scores over the root of the lengths' product."""
    return scored.withColumn("score", F.col("score") / F.sqrt(F.col("lq") * F.col("lh").cast("double")))


def best_hits(scored: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Per query and other species, hits within ``tolerance`` of the best; in the own species, hits that reach the best
    hit elsewhere, or all where there is none."""
    cross = F.col("q_sp") != F.col("h_sp")
    # the wider window first: rows dealt by q serve both
    rows = scored.withColumn("away", F.max(F.when(cross, F.col("score"))).over(Window.partitionBy("q"))).withColumn("best", F.max("score").over(Window.partitionBy("q", "h_sp")))
    bar = F.when(cross, F.col("best")).otherwise(F.coalesce("away", F.lit(-1.0)))
    return rows.where(F.col("score") > bar - tolerance).select(*scored.columns)


def reciprocal(best: DataFrame) -> DataFrame:
    """Best hits whose reverse is a best hit too. They are written once, not found twice."""
    best = cut(best)
    back = best.select(F.col("h").alias("q"), F.col("q").alias("h"))
    return best.join(back, ["q", "h"], "left_semi")


def cutoffs(scored: DataFrame, rbh: DataFrame) -> DataFrame:
    """(q, cutoff): the least score of a reciprocal best hit elsewhere, else just above the best hit elsewhere (0 if none)."""
    away = F.col("q_sp") != F.col("h_sp")
    least = rbh.where(away).groupBy("q").agg(F.min("score").alias("least"))
    most = scored.groupBy("q").agg(F.coalesce(F.max(F.when(away, F.col("score"))), F.lit(0.0)).alias("most"))
    return most.join(least, "q", "left").select("q", F.coalesce("least", F.col("most") + 1e-6).alias("cutoff"))


def cutoffs_by_ratio(scored: DataFrame, rbh: DataFrame, share: float = 0.1) -> DataFrame:
    """(q, cutoff) from how reciprocal best hits in several species compare: per species pair (j, k) of the query species'
    hits the low percentile of the score ratio; a query's cutoff is the least over its hits of factor times score."""
    away = F.col("q_sp") != F.col("h_sp")
    single = rbh.where(away).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("q", "h_sp"))).where("n = 1")
    one = single.select("q", "q_sp", F.col("h_sp").alias("j"), F.col("score").alias("s_j"))
    two = single.select("q", F.col("h_sp").alias("k"), F.col("score").alias("s_k"))
    ratios = one.join(two, "q").where("j <> k").groupBy("q_sp", "j", "k").agg(F.percentile(F.col("s_k") / F.col("s_j"), F.lit(share)).alias("r"))
    factor = ratios.groupBy("q_sp", "j").agg(F.least(F.lit(1.0), F.min("r")).alias("f"))
    bars = rbh.where(away).join(factor, (F.col("h_sp") == F.col("j")) & (rbh["q_sp"] == factor["q_sp"]), "left").select("q", (F.coalesce("f", F.lit(1.0)) * F.col("score")).alias("bar"))
    least = bars.groupBy("q").agg(F.min("bar").alias("least"))
    most = scored.groupBy("q").agg(F.coalesce(F.max(F.when(away, F.col("score"))), F.lit(0.0)).alias("most"))
    return most.join(least, "q", "left").select("q", F.coalesce("least", F.col("most") + 1e-6).alias("cutoff"))


def connect(scored: DataFrame, bars: DataFrame) -> DataFrame:
    """Hits that reach their query's cutoff."""
    return scored.join(bars, "q").where("score >= cutoff").select(*scored.columns)


def graph(connected: DataFrame, scored: DataFrame, digits: int = 3) -> DataFrame:
    """(q, h, weight): every scored hit that is connected one way weighs its score, both ways twice that."""
    both = connected.select("q", "h").union(connected.select(F.col("h").alias("q"), F.col("q").alias("h"))).groupBy("q", "h").agg(F.count(F.lit(1)).alias("ways"))
    return both.join(scored.select("q", "h", "score"), ["q", "h"]).select("q", "h", F.round(F.col("ways") * F.col("score"), digits).alias("weight"))


def homology_graph(hits: DataFrame) -> DataFrame:
    """Every pair that hits either way, weight 1, both directions."""
    return hits.select("q", "h").union(hits.select(F.col("h").alias("q"), F.col("q").alias("h"))).distinct().withColumn("weight", F.lit(1.0))


def orthogroup_graph(hits: DataFrame, genes: DataFrame, normaliser=normalise_by_fit, cutoff=cutoffs) -> DataFrame:
    """Raw hits to edges: best per pair, normalise, best hits, reciprocal, cutoff, connect, weigh."""
    scored = cut(normaliser(with_genes(best_per_pair(hits), genes)))
    return graph(connect(scored, cutoff(scored, reciprocal(best_hits(scored)))), scored)
