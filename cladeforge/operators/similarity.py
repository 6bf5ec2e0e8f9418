"""Similarity joins on k-mers, and the assignment of new genes to known groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.operators.clustering import cut
from cladeforge.operators.ranking import with_rank


def kmers(seq: Column, k: int) -> Column:
    """All k-letter pieces, in order; none of a shorter sequence."""
    n = F.length(seq) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def words(seq: str) -> Column:
    return F.filter(F.split(F.lower(seq), r"\s+"), lambda x: x != "")


def shingled(genes: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Genes that have a row in ``shingle_index``: those of ``k`` words and more."""
    return genes.where(F.size(words(seq)) >= k).select("gene")


def piece_counts(genes: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, n, n_genes) of (gene, seq): how often each piece occurs, and in how many genes. A gene of one text has its distinct pieces there; only pieces of
    genes with several are told apart by a shuffle, so that no task holds genes times pieces."""
    texts = cut(genes.groupBy("gene", seq).agg(F.count(F.lit(1)).alias("rows")).withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("gene"))))
    pieces = kmers(F.col(seq), k)
    every = texts.select(F.explode(pieces).alias("kmer"), F.col("rows").alias("n"), F.lit(0).cast("long").alias("n_genes"))
    once = texts.where("texts = 1 and gene is not null").select(F.explode(F.array_distinct(pieces)).alias("kmer"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("n_genes"))
    several = texts.where("texts > 1 and gene is not null").select("gene", F.explode(pieces).alias("kmer")).distinct().select("kmer", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("n_genes"))
    rows = [x.groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("n_genes").alias("n_genes")) for x in (every, once, several)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("n_genes").alias("n_genes"))


def shingle_index(genes: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Inverted index (piece, gene, n_pieces) of each gene's distinct runs of k words, as 64-bit hashes. Words and runs are
    columns and generators of their own, so that the plan cuts each text once."""
    cut = genes.select("gene", words(seq).alias("w"))
    n = F.size("w") - k + 1
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("w", i, k)))
    distinct = F.array_distinct(F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>")))
    rows = cut.select("gene", F.inline(F.transform(F.array(distinct), lambda p: F.struct(p.alias("pieces"), F.size(p).alias("n_pieces")))))
    return rows.select("gene", "n_pieces", F.explode(F.transform("pieces", lambda p: p)).alias("piece")).select("piece", "gene", "n_pieces")


#: A piece's weight is the low bits of its code; no text has so many pieces.
WEIGHT_BITS = 31
#: Genes of one class that meet a share of another class's; larger classes are dealt by shares.
SHARE = 256


def _weight(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << WEIGHT_BITS) - 1))


def jaccard_join(idx: DataFrame, least: float, most_genes: int | None = None) -> DataFrame:
    """(q, h, score) both ways for genes whose distinct pieces overlap by ``least`` and more (Jaccard), exactly.

    Prefix filter: with pieces in one global order (rarest first), two sets that overlap enough have, from their first common piece on, as much left as
    they must share. Only pairs that meet at such a piece are written. Pieces of one gene alone are not, and those that the same genes share are one
    with a weight, so that sets are as long as the ways in which genes overlap, not as their texts. Genes of the same shared pieces (copies, texts
    with one and the same passage) are one class, and classes meet, not genes. A gene's texts of different sizes are sets of their own.
    ``most_genes`` leaves out pairs whose common pieces are all of more genes, where the caller defines the score so.
    """
    # what one gene alone has meets nobody: it only counts
    often = idx.where("gene is not null").select("piece", "gene", "n_pieces").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("piece"))).where("df > 1")
    often = cut(often.dropDuplicates(["piece", "gene", "n_pieces"]))
    # pieces of the same genes are one, which weighs as much as they are many; its code is its place in the order, then its weight
    marks = lambda *of: [F.bit_xor(F.xxhash64(F.lit(k), *of)).alias(f"mark{k}") for k in range(2)]
    same = often.groupBy("piece").agg(F.first("df").alias("df"), *marks("gene", "n_pieces")).groupBy("df", "mark0", "mark1").agg(F.min("piece").alias("piece"), F.count(F.lit(1)).alias("weight"))
    same = with_rank(cut(same.select("piece", "df", "weight")), F.col("df"), F.col("piece"), name="cf_at")
    code = F.shiftleft("cf_at", WEIGHT_BITS) + F.col("weight")
    rows = cut(often.drop("df").join(same.select("piece", "df", code.alias("code")), "piece").drop("piece"))
    enough = F.lit(least) * F.col("n_pieces") - 1e-6  # doubles must not lose what just suffices
    genes = cut(rows.groupBy("gene", "n_pieces").agg(*marks("code"), F.sum(_weight(F.col("code"))).alias("total")).where(F.col("total") >= enough))
    classes = genes.groupBy("mark0", "mark1").agg(F.min(F.struct("n_pieces", "gene")).alias("m"), F.first("total").alias("total"), F.count(F.lit(1)).alias("size"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cls"), "mark0", "mark1", "m.n_pieces", "m.gene", "total", "size"))
    sets = cut(rows.join(classes.select("gene", "n_pieces", "cls", "total"), ["gene", "n_pieces"]).select("cls", "n_pieces", "total", "df", "code"))
    rest = F.col("total") - F.sum(_weight(F.col("code"))).over(Window.partitionBy("cls").orderBy("code")) + _weight(F.col("code"))
    head = sets.withColumn("rest", rest).where(F.col("rest") >= enough)
    head = cut((head if most_genes is None else head.where(F.col("df") <= most_genes)).select("code", "cls", "n_pieces", "rest"))
    a, b = (head.select("code", F.col("cls").alias(x), F.col("n_pieces").alias(f"n{x}"), F.col("rest").alias(f"r{x}")) for x in "ab")
    shared = F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - 1e-6
    pairs = a.join(b, "code").where("a < b").where(F.least("ra", "rb") >= shared).select("a", "b", "na", "nb").distinct()
    lists = sets.groupBy("cls").agg(F.collect_list("code").alias("codes"))
    for x in "ab":
        pairs = pairs.join(lists.select(F.col("cls").alias(x), F.col("codes").alias(f"codes_{x}")), x)
    met = pairs.withColumn("same", F.aggregate(F.array_intersect("codes_a", "codes_b"), F.lit(0).cast("long"), lambda n, x: n + _weight(x))).where(F.col("same") >= shared)
    own = classes.where("size > 1").join(head.select("cls").distinct(), "cls", "left_semi").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.col("total").alias("same"))
    scored = cut(_expanded(met.select("a", "b", "same").unionByName(own), genes, classes, least))
    return scored.select(F.inline(F.array(F.struct("q", "h", "score"), F.struct(F.col("h").alias("q"), F.col("q").alias("h"), "score"))))


def _expanded(pairs: DataFrame, genes: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(q, h, score) once a pair of genes of classes (a, b) that have ``same`` pieces in common; the genes of a large class are dealt to many tasks."""
    of = genes.join(classes.select("mark0", "mark1", "cls", (F.floor(F.col("size") / SHARE) + 1).alias("shares")), ["mark0", "mark1"])
    q = of.select(F.col("cls").alias("a"), F.col("gene").alias("q"), F.col("n_pieces").alias("nq"))
    h = of.select(F.col("cls").alias("b"), F.col("gene").alias("h"), F.col("n_pieces").alias("nh"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    rows = pairs.join(classes.select(F.col("cls").alias("b"), (F.floor(F.col("size") / SHARE) + 1).alias("shares")), "b").join(q, "a")
    rows = rows.withColumn("share", F.pmod(F.xxhash64("q", "nq"), F.col("shares"))).join(h, ["b", "share"]).where("q <> h and (a <> b or q < h)")
    return rows.withColumn("score", F.col("same") / (F.col("nq") + F.col("nh") - F.col("same"))).where(F.col("score") >= least).select("q", "h", "score")


def assign(hits: DataFrame) -> DataFrame:
    """(gene, og, hit_sp) of the hit with the lowest e-value; ties go to the smallest (og, sp). ``hits``: gene, og, sp, evalue."""
    best = hits.groupBy("gene").agg(F.min(F.struct("evalue", "og", "sp")).alias("m"))
    return best.select("gene", F.col("m.og").alias("og"), F.col("m.sp").alias("hit_sp"))


def first_groups(hits: DataFrame, k: int) -> DataFrame:
    """The first k distinct groups of each gene in e-value order: (gene, og, rank)."""
    per = hits.groupBy("gene", "og").agg(F.min("evalue").alias("evalue"))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("gene").orderBy("evalue", "og")))
    return ranked.where(F.col("rank") <= k).select("gene", "og", "rank")


def closest_species(assigned: DataFrame, genes: DataFrame) -> DataFrame:
    """Per query species, the species that most of its genes hit (ties: the smallest)."""
    n = assigned.join(genes.select("gene", "sp"), "gene").groupBy("sp", "hit_sp").agg(F.count(F.lit(1)).alias("n"))
    ranked = n.withColumn("rn", F.row_number().over(Window.partitionBy("sp").orderBy(F.desc("n"), "hit_sp")))
    return ranked.where("rn = 1").select("sp", "hit_sp", "n")


def search_pairs(species: DataFrame, one_way: bool = False) -> DataFrame:
    """Species pairs to search: all ordered pairs, or i <= j one way; pairs of two old species were searched before. The
    table has a row a species: (species_id, is_new, n_genes)."""
    a = species.where("n_genes > 0").select(F.col("species_id").alias("i"), F.col("is_new").alias("new_i"), F.col("n_genes").alias("n_i"))
    b = species.where("n_genes > 0").select(F.col("species_id").alias("j"), F.col("is_new").alias("new_j"), F.col("n_genes").alias("n_j"))
    pairs = a.join(b, F.col("i") <= F.col("j") if one_way else F.col("i") >= F.lit(-1)).where("new_i or new_j")
    return pairs.select("i", "j", (F.col("n_i") * F.col("n_j")).alias("cost")).orderBy(F.desc("cost"), "i", "j")


def clade_pairs(clades: DataFrame) -> DataFrame:
    """Ordered species pairs within a clade; ``clades``: (clade, species_id)."""
    return clades.withColumnRenamed("species_id", "i").join(clades.withColumnRenamed("species_id", "j"), "clade").select("clade", "i", "j")
