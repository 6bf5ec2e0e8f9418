"""Trees as tables: (tree, node, parent, dist, is_leaf, sp), a row a node; the root's parent is null.

Nothing here lists all ancestors of all nodes, which is quadratic on a ladder. Each inner node's child with the most nodes below goes on its path, every other
child begins one, so that a way to the root meets log2(n) paths at most: ``routes`` has a row for each of them. What is asked of the nodes below is summed by the
place where a way enters a path and then along the path (``gathered``); what is asked of common ancestors is asked of common paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.operators.clustering import cut, discard


def lift(links: DataFrame) -> DataFrame:
    """(tree, node, up, dist) -> (tree, node, top, steps, dist, size): the last node on the way along ``up`` (null at the end), edges and length up to there, and
    how many nodes lead to this one, itself included. Ways double each round, which has a row a node."""
    now = cut(links.select("tree", "node", "up", F.coalesce("up", "node").alias("top"), F.col("up").isNotNull().cast("int").alias("steps"), F.when(F.col("up").isNotNull(), F.coalesce("dist", F.lit(0.0))).otherwise(0.0).alias("dist"), F.lit(1).cast("long").alias("size")))
    while not (alive := now.where("up is not null")).isEmpty():
        far = now.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("top").alias("over"), F.col("steps").alias("more"), F.col("dist").alias("far"))
        moved = alive.select("tree", "node", "up").join(far, ["tree", "up"]).select("tree", "node", "next", "over", "more", "far", F.lit(0).cast("long").alias("gain"))
        below = alive.groupBy("tree", F.col("up").alias("node")).agg(F.sum("size").alias("gain"))
        blank = [F.lit(None).cast(far.schema[c].dataType).alias(c) for c in ("next", "over", "more", "far")]
        change = moved.union(below.select("tree", "node", *blank, "gain")).groupBy("tree", "node").agg(*(F.max(c).alias(c) for c in ("next", "over", "more", "far")), F.sum("gain").alias("gain"))
        after = now.join(change, ["tree", "node"], "left").select(
            "tree", "node", F.col("next").alias("up"), F.coalesce("over", "top").alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            (F.col("dist") + F.coalesce("far", F.lit(0.0))).alias("dist"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))
        after = cut(after)
        discard(now)
        now = after
    return now.drop("up")


def routes(nodes: DataFrame) -> DataFrame:
    """(tree, node, head, pos, own, depth, height, size): a row for each path on a node's way to the root: the path's top node and how far below it the way enters.
    ``own`` marks the path that the node itself is on, at ``pos``. depth and height are the node's edges and length to the root, size counts the nodes
    at or below it. n log2(n) rows at most; two a leaf of a ladder."""
    up = lift(nodes.select("tree", "node", F.col("parent").alias("up"), "dist")).drop("top")
    links = cut(nodes.select("tree", "node", "parent").join(up, ["tree", "node"]))
    heavy = links.where("parent is not null").groupBy("tree", "parent").agg(F.max_by("node", F.struct("size", "node")).alias("node")).select("tree", "node", F.col("parent").alias("up"))
    path = lift(links.select("tree", "node").join(heavy, ["tree", "node"], "left").withColumn("dist", F.lit(0.0)))
    own = cut(links.join(path.select("tree", "node", F.col("top").alias("head"), F.col("steps").alias("pos")), ["tree", "node"]))
    place = own.select("tree", F.col("node").alias("parent"), F.col("head").alias("over"), F.col("pos").alias("over_pos"))
    step = cut(own.where("node = head and parent is not null").join(place, ["tree", "parent"]).select("tree", "head", "over", "over_pos"))
    over = step.select("tree", F.col("head").alias("over"), F.col("over").alias("top"), F.col("over_pos").alias("top_pos"))
    ways = [step]
    while not ways[-1].isEmpty():
        ways.append(cut(ways[-1].join(over, ["tree", "over"]).select("tree", "head", F.col("top").alias("over"), F.col("top_pos").alias("over_pos"))))
    carried = ["depth", "height", "size"]
    named = own.withColumnsRenamed({"steps": "depth", "dist": "height"})
    out = named.select("tree", "node", "head", "pos", F.lit(True).alias("own"), *carried)
    for way in ways:
        out = out.union(named.select("tree", "node", "head", *carried).join(way, ["tree", "head"]).select("tree", "node", F.col("over").alias("head"), F.col("over_pos").alias("pos"), F.lit(False), *carried))
    out = cut(out)
    for table in (up, path, links, own, *ways):
        discard(table)
    return out


def places(ways: DataFrame) -> DataFrame:
    """(tree, node, head, pos, depth, height, size): each node on its own path."""
    return ways.where("own").drop("own")


def closure(ways: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(tree, node, ancestor, steps, dist): every node, or those of ``only`` (tree, node), with itself and all above it, edges and branch lengths between; for
    results that are these rows."""
    some = ways if only is None else ways.join(only, ["tree", "node"], "left_semi")
    above = some.select("tree", "node", "head", F.explode(F.sequence(F.lit(0), "pos")).alias("pos"), "depth", "height")
    at = places(ways).select("tree", "head", "pos", F.col("node").alias("ancestor"), F.col("depth").alias("d"), F.col("height").alias("h"))
    return above.join(at, ["tree", "head", "pos"]).select("tree", "node", "ancestor", (F.col("depth") - F.col("d")).alias("steps"), (F.col("height") - F.col("h")).alias("dist"))


def gathered(ways: DataFrame, values: DataFrame, by: list[str], **aggs: tuple[str, str | Column]) -> DataFrame:
    """(tree, node, by..., aggs...) over the rows of ``values`` (tree, node, ...) at or below each node that has any. An aggregate is (function, column), the function one that
    can be applied again to its own results: sum, min, max, bit_xor. Values meet where their ways enter a path, then add up along it, so there are as many rows
    as in the result, and n log2(n) before."""
    enter = ways.select("tree", "node", "head", "pos").join(values, ["tree", "node"]).groupBy("tree", "head", *by, "pos")
    found = enter.agg(*(getattr(F, f)(c).alias(name) for name, (f, c) in aggs.items()))
    up = Window.partitionBy("tree", "head", *by).orderBy(F.desc("pos"))  # the entries of one path
    along = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = found.select("tree", "head", *by, F.sequence(F.coalesce(F.lead("pos").over(up) + 1, F.lit(0)), "pos").alias("span"), *(getattr(F, f)(name).over(along).alias(name) for name, (f, _) in aggs.items()))
    at = places(ways).select("tree", "node", "head", "pos")
    return spans.select("tree", "head", *by, F.explode("span").alias("pos"), *aggs).join(at, ["tree", "head", "pos"]).select("tree", "node", *by, *aggs)


def leaves_below(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, leaf, steps, dist) of every leaf at or below a node; for results that list leaves."""
    return closure(ways, nodes.where("is_leaf")).withColumnsRenamed({"node": "leaf", "ancestor": "node"})


def clades(nodes: DataFrame) -> DataFrame:
    """(tree, node, parent, dist, leaves): sorted names of the leaves at or below each node of ``genetrees.tree_nodes``. Leaves are found by their place in
    preorder: those at a node's are the next ones of its subtree, whose size is what postorder has before it less what preorder has, plus the depth."""
    span = nodes.select("tree", "node", "parent", "dist", "pre", (F.col("post") + F.col("depth")).alias("last"))
    leaf = nodes.where("is_leaf").select("tree", "name", F.col("pre").alias("at"))
    inside = span.join(leaf, "tree").where("at between pre and last")
    return inside.groupBy("tree", "node", "parent", "dist").agg(F.array_sort(F.collect_list("name")).alias("leaves"))


def depths(ways: DataFrame) -> DataFrame:
    """(tree, node, depth, height): edges and length to the root."""
    return places(ways).select("tree", "node", "depth", "height")


def leaf_counts(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    return gathered(ways, nodes.where("is_leaf").select("tree", "node"), [], n_leaves=("sum", F.lit(1)))


def extreme_leaves(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, closest, farthest) leaf below by length; ties (to nine places) go to the smaller leaf."""
    leaf = places(ways).join(nodes.where("is_leaf").select("tree", "node"), ["tree", "node"]).select("tree", "node", F.round("height", 9).alias("at"), F.col("node").alias("leaf"))
    ends = {"closest": ("min", F.struct("at", "leaf")), "farthest": ("min", F.struct((-F.col("at")).alias("at"), "leaf"))}
    inner = nodes.where("not is_leaf").select("tree", "node")
    return gathered(ways, leaf, [], **ends).join(inner, ["tree", "node"]).select("tree", "node", "closest.leaf", F.col("farthest.leaf").alias("far")).toDF("tree", "node", "closest", "farthest")


def leaf_species(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_leaf").select("tree", "node", "sp")


def species_counts(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, sp, n): leaves of each species at or below each node."""
    return gathered(ways, leaf_species(nodes), ["sp"], n=("sum", F.lit(1)))


def species_below(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, species) with the sorted distinct species at or below each node."""
    return species_counts(nodes, ways).groupBy("tree", "node").agg(F.array_sort(F.collect_list("sp")).alias("species"))


def species_above(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, species) with the species of the leaves that aren't below the node."""
    total = leaf_species(nodes).groupBy("tree", "sp").agg(F.count(F.lit(1)).alias("total"))
    every = total.groupBy("tree").agg(F.array_sort(F.collect_list("sp")).alias("every"))  # a tree's species, as in the result
    inside = species_counts(nodes, ways).join(total, ["tree", "sp"]).where("n >= total").groupBy("tree", "node").agg(F.collect_list("sp").alias("inside"))
    left = F.when(F.col("inside").isNull(), F.col("every")).otherwise(F.array_except("every", "inside"))
    return nodes.select("tree", "node").distinct().join(inside, ["tree", "node"], "left").join(every, "tree").select("tree", "node", left.alias("species"))


def mrca(ways: DataFrame, sets: DataFrame) -> DataFrame:
    """(tree, set, node): the lowest common ancestor of each set's nodes; ``sets``: (tree, set, node). It is on the lowest path that all ways meet, where the first enters."""
    members = sets.distinct()
    size = members.groupBy("tree", "set").agg(F.count(F.lit(1)).alias("size"))
    met = members.join(ways.select("tree", "node", "head", "pos"), ["tree", "node"]).groupBy("tree", "set", "head").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    at = places(ways).select("tree", "head", "pos", "node", "depth")
    common = met.join(size, ["tree", "set"]).where("n = size").join(at, ["tree", "head", "pos"])
    return common.groupBy("tree", "set").agg(F.max_by("node", "depth").alias("node"))


def distances(ways: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree, a, b, dist, steps) along the tree; ``pairs``: (tree, a, b)."""
    a, b = (ways.select("tree", F.col("node").alias(x), "head", F.col("pos").alias(f"p{x}"), F.col("depth").alias(f"s{x}"), F.col("height").alias(f"d{x}")) for x in "ab")
    met = pairs.join(a, ["tree", "a"]).join(b, ["tree", "b", "head"]).withColumn("pos", F.least("pa", "pb"))
    at = places(ways).select("tree", "head", "pos", "depth", "height")
    length = F.col("sa") + F.col("sb") - 2 * F.col("depth"), F.col("da") + F.col("db") - 2 * F.col("height")
    best = met.join(at, ["tree", "head", "pos"]).groupBy("tree", "a", "b").agg(F.min(F.struct(length[0].alias("steps"), length[1].alias("dist"))).alias("m"))
    return best.select("tree", "a", "b", F.round("m.dist", 6).alias("dist"), F.col("m.steps").alias("steps"))


def splits(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, side): sorted leaf names below each inner node but the root: one side of its split."""
    below = leaves_below(nodes, ways)
    inner = nodes.where("not is_leaf and parent is not null").select("tree", "node")
    return below.join(inner, ["tree", "node"]).groupBy("tree", "node").agg(F.array_sort(F.collect_list("leaf")).alias("side"))


def split_prints(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, side): as ``splits``, but the side is a 128-bit sum of its leaves' hashes, so that a ladder's sides aren't listed."""
    leaf = nodes.where("is_leaf").select("tree", "node", F.xxhash64(F.lit(1), "node").alias("u"), F.xxhash64(F.lit(2), "node").alias("v"))
    inner = nodes.where("not is_leaf and parent is not null").select("tree", "node")
    return gathered(ways, leaf, [], u=("bit_xor", "u"), v=("bit_xor", "v")).join(inner, ["tree", "node"]).select("tree", "node", F.struct("u", "v").alias("side"))


def robinson_foulds(splits_a: DataFrame, splits_b: DataFrame) -> DataFrame:
    """(tree, rf, n): splits in only one of the two trees of the same name, and all there are."""
    a, b = splits_a.select("tree", "side").distinct().withColumn("a", F.lit(1)), splits_b.select("tree", "side").distinct().withColumn("b", F.lit(1))
    return a.join(b, ["tree", "side"], "full").groupBy("tree").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("rf"), F.count(F.lit(1)).alias("n"))


def monophyly(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, sp, node, monophyletic): whether the lowest ancestor of a species' leaves has no other leaves."""
    sets = nodes.where("is_leaf").select("tree", F.col("sp").alias("set"), "node")
    top = mrca(ways, sets)
    n = sets.groupBy("tree", "set").agg(F.count(F.lit(1)).alias("size"))
    return top.join(leaf_counts(nodes, ways), ["tree", "node"]).join(n, ["tree", "set"]).select("tree", F.col("set").alias("sp"), "node", (F.col("n_leaves") == F.col("size")).alias("monophyletic"))


def child_species(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, sp, n): how many children of a node have the species at or below them."""
    kids = species_counts(nodes, ways).drop("n").join(nodes.where("parent is not null").select("tree", "node", "parent"), ["tree", "node"])
    return kids.groupBy("tree", F.col("parent").alias("node"), "sp").agg(F.count(F.lit(1)).alias("n"))


def overlap_labels(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, event): D where two children share a species, else S; inner nodes only."""
    return child_species(nodes, ways).groupBy("tree", "node").agg(F.when(F.max("n") > 1, "D").otherwise("S").alias("event"))


def overlap_sizes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, n_shared, n_all): species that several children have, and all below."""
    return child_species(nodes, ways).groupBy("tree", "node").agg(F.count_if(F.col("n") > 1).alias("n_shared"), F.count(F.lit(1)).alias("n_all"))


def ortholog_pairs(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, n_pairs): leaf pairs that meet at a speciation node, of different children."""
    events = overlap_labels(nodes, ways).where("event = 'S'").select("tree", "node")
    kids = nodes.where("parent is not null").select("tree", "node", "parent").join(leaf_counts(nodes, ways), ["tree", "node"])
    both = kids.groupBy("tree", F.col("parent").alias("node")).agg(((F.sum("n_leaves") * F.sum("n_leaves") - F.sum(F.col("n_leaves") * F.col("n_leaves"))) / 2).cast("long").alias("n_pairs"))
    return both.join(events, ["tree", "node"])


def comparable(ways: DataFrame) -> DataFrame:
    """(tree, node, above, below): how many nodes are above and below each."""
    return places(ways).select("tree", "node", F.col("depth").cast("long").alias("above"), (F.col("size") - 1).alias("below"))


def highest(ways: DataFrame, picked: DataFrame) -> DataFrame:
    """Of ``picked`` (tree, node), those with no other picked node above: none enters a path at or below the first picked one of it, but that one itself."""
    mine = ways.join(picked.select("tree", "node"), ["tree", "node"], "left_semi")
    first = mine.where("own").groupBy("tree", "head").agg(F.min("pos").alias("first"))
    under = mine.join(first, ["tree", "head"]).where("first < pos or first = pos and not own").select("tree", "node").distinct()
    return picked.join(under, ["tree", "node"], "left_anti")


def closest_pairs(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, sp_a, sp_b, dist): the least length between leaves of two species. Only a species' nearest leaf below each node
    matters where two species' ways meet, so that leaf pairs are never listed."""
    leaf = places(ways).join(leaf_species(nodes), ["tree", "node"]).select("tree", "node", "sp", "height")
    low = gathered(ways, leaf, ["sp"], low=("min", "height")).join(places(ways).select("tree", "node", "height"), ["tree", "node"])
    near = low.select("tree", "node", "sp", (F.col("low") - F.col("height")).alias("dist"))
    a, b = near.select("tree", "node", F.col("sp").alias("sp_a"), F.col("dist").alias("da")), near.select("tree", "node", F.col("sp").alias("sp_b"), F.col("dist").alias("db"))
    return a.join(b, ["tree", "node"]).where("sp_a < sp_b").groupBy("tree", "sp_a", "sp_b").agg(F.round(F.min(F.col("da") + F.col("db")), 6).alias("dist"))


def preorder_rank(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, rank) in level order: by depth, then by node."""
    d = depths(ways)
    return d.select("tree", "node", F.row_number().over(Window.partitionBy("tree").orderBy("depth", "node")).alias("rank"))


def small_clades(nodes: DataFrame, ways: DataFrame, core: DataFrame, most: int) -> DataFrame:
    """(tree, node, n): the highest nodes with ``most`` core leaves (leaf) or fewer below, and how many those are."""
    marked = nodes.where("is_leaf").select("tree", "node").join(core.select(F.col("leaf").alias("node"), F.lit(1).alias("one")), "node", "left").select("tree", "node", F.coalesce("one", F.lit(0)).alias("one"))
    n = gathered(ways, marked, [], n=("sum", "one"))
    above = n.where(F.col("n") <= most).select("tree", F.col("node").alias("parent"), F.lit(True).alias("small"))
    low = nodes.select("tree", "node", "parent").join(n.where(F.col("n") <= most), ["tree", "node"])
    return low.join(above, ["tree", "parent"], "left").where("small is null").select("tree", "node", "n")


def single_species_clades(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, node, sp): the highest nodes whose leaves are all of one species."""
    one = gathered(ways, leaf_species(nodes).withColumnRenamed("sp", "own"), [], sp=("min", "own"), last=("max", "own")).where("sp = last").drop("last")
    above = one.select("tree", F.col("node").alias("parent"), F.lit(True).alias("whole"))
    return nodes.select("tree", "node", "parent").join(one, ["tree", "node"]).join(above, ["tree", "parent"], "left").where("whole is null").select("tree", "node", "sp")


def mend_branches(nodes: DataFrame, length: str = "dist", share: float = 1e-6) -> DataFrame:
    """(tree, node, dist): negative branches get ``share`` of the tree's length."""
    total = nodes.where("parent is not null").groupBy("tree").agg(F.sum(length).alias("cf_total"))
    return nodes.join(F.broadcast(total), "tree").select("tree", "node", F.when(F.col("dist") < 0, share * F.col("cf_total")).otherwise(F.col("dist")).alias("dist"))  # a row a tree
