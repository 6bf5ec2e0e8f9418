"""Groups from bucketed candidates by stars, never by all pairs of a bucket.

Both near-duplicate operators use it. A star links a hub to every member of its bucket, so a bucket of m members costs
m - 1 pairs, and what the star links is one group from then on. Buckets that still hold several groups go on with hubs
from outside the bucket's largest group, sixteen times as many each round; a hub is tested against all members of other groups
and then leaves the bucket, until a bucket's rest is one group. So every pair of different groups in a bucket is tested
or settled by other links.

Where links are on sets, members that a first hub could be near to are its family, and a family is settled without rounds:
two members can be linked only if their differences from the hub share elements (``related``), so that they meet in a
prefix-filtered join on those, rarest first, and members times outsiders are not compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.llm.common import discard, is_empty, materialise, small

#: Each round has so many times the hubs a bucket of the round before.
GROWTH = 16
#: Members of a family's largest group that its other members meet, in two goes, before the rest is compared by differences.
HELPERS = (16, 64)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (id, label), label the smallest id reachable, for every id but those smallest ones. Alternates large-star and small-star steps
    (Kiveris et al. 2014) until they form stars; each step's edges are a table in the shared folder. The least neighbours are written
    before they are joined, so that a hub's edges can be split over tasks."""

    def stars(df: DataFrame) -> bool:
        """Whether every edge leads to a node that has no smaller neighbour, and no node has two."""
        return is_empty(df.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")) and is_empty(df.join(df.select(F.col("a").alias("b")), "b", "left_semi"))

    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not stars(now):
        both = now.union(now.select("b", "a"))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")), "least")
        large = both.join(least, "a").where("b > a and b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = materialise(large.distinct(), "large")
        lower = materialise(down.groupBy("a").agg(F.min("b").alias("least")), "lower")
        small = down.join(lower, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        after = materialise(small.union(lower.select("a", F.col("least").alias("b"))).distinct(), "edges")
        discard(now, least, down, lower)
        now = after
    return now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "id")


class Labels:
    """(id, label) of what links have connected so far; new links are contracted to edges of labels first."""

    def __init__(self) -> None:
        self.table: DataFrame | None = None

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the label of their ``id``."""
        if self.table is None:
            return rows.withColumn("label", F.col("id"))
        return rows.join(self.table, "id", "left").withColumn("label", F.coalesce("label", "id"))

    def add(self, links: DataFrame) -> None:
        """``links`` is a table of (a, b)."""
        if is_empty(links):
            return
        ends = self.of(self.of(links.select(F.col("a").alias("id"), "b")).select(F.col("label").alias("a"), F.col("b").alias("id"))).select("a", F.col("label").alias("b"))
        moved = materialise(connected_components(ends).withColumnRenamed("label", "to"), "moved")
        if self.table is None:
            self.table = materialise(moved.withColumnRenamed("to", "label"), "labels")
        else:
            old = self.table
            known = old.join(moved.select(F.col("id").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
            fresh = moved.join(old.select("id"), "id", "left_anti").select("id", F.col("to").alias("label"))
            self.table = materialise(known.unionByName(fresh), "labels")
            discard(old)
        discard(moved)


def related(deltas: DataFrame, percent: int) -> DataFrame:
    """(fam, id, label, n, elems) -> (a, b) pairs of a family with different labels that may be linked: sets of n and m
    elements that share ``percent`` of their union.

    ``elems`` are the elements in which a set differs from its family's hub. Linked sets differ from each other in
    (100 - percent) * (n + m) / (100 + percent) elements at most, and m <= n * 100 / percent, so in t at most for a given n. Of sets with x and y such elements,
    of which c are shared, x + y - 2c are between them, so c >= (x + y - t) / 2, and as y >= c, c >= x - t. One at
    least is shared, or the set were linked to the hub. So in any one order of the family's elements one of the first x - c + 1 <= t + 1 of each is
    shared, and from the first shared one on there must be c. Rare elements come first; those of one set alone meet nobody. Who meets is
    held to t by all elements of both, so that no other pair is written.
    """
    sets = materialise(deltas, "deltas")
    rows = sets.select("fam", "id", "label", "n", F.size("elems").alias("size"), F.explode("elems").alias("elem"))
    often = rows.groupBy("fam", "elem").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = rows.join(often, ["fam", "elem"])
    own = Window.partitionBy("fam", "id")  # one set's elements
    ranked = shared.withColumn("rank", F.row_number().over(own.orderBy("often", "elem"))).withColumn("rank", F.expr("rank + size") - F.count(F.lit(1)).over(own))
    first = materialise(ranked.where(f"rank <= floor({100 - percent} * n * {100 + percent} / {(100 + percent) * percent}) + 1").select("fam", "elem", "id", "label", "n", "size", "rank"), "prefixes")
    other = first.select("fam", "elem", *(F.col(c).alias(f"o_{c}") for c in ("id", "label", "n", "size", "rank")))
    apart = f"size + o_size - 2 * (1 + least(size - rank, o_size - o_rank)) <= {100 - percent} * (n + o_n) / {100 + percent}"
    met = first.join(other, ["fam", "elem"]).where("label < o_label").where(apart).select("id", "o_id", "n", "o_n").distinct()
    for end in ("id", "o_id"):
        met = met.join(sets.select(F.col("id").alias(end), F.col("elems").alias(f"{end}_elems")), end)
    near = f"size(id_elems) + size(o_id_elems) - 2 * size(array_intersect(id_elems, o_id_elems)) <= {100 - percent} * (n + o_n) / {100 + percent}"
    pairs = materialise(met.where(near).select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")), "related")
    discard(sets, first)
    return pairs


def unsettled(rows: DataFrame, kinds: list[str], key: str = "key") -> DataFrame:
    """Rows of buckets (``key``) with several groups of each kind (label, family), and whether a row is ``outside`` the bucket's
    largest group of any kind."""
    main = None
    for kind in kinds:
        parts = rows.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
        most = parts.groupBy(key).agg(F.max(F.struct("n", kind)).alias(f"m_{kind}"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
        main = most if main is None else main.join(most, key)
    main = materialise(main, "main")
    inside = [F.col(k) == F.col(f"m_{k}.{k}") for k in kinds]
    inside = inside[0] if len(kinds) == 1 else F.when(F.col("m_fam.n") > F.col("m_label.n"), inside[1]).otherwise(inside[0])
    return rows.join(main, key).withColumn("outside", ~inside).drop(*(f"m_{k}" for k in kinds))


def link(
    members: DataFrame, sketch: list[str], possible: Callable[[str, str], str], fetch: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame],
    delta: Callable[[DataFrame, DataFrame], DataFrame] | None = None, percent: int = 0, kindred: str = "true", sure: tuple[list[str], Callable[[str, str], str]] | None = None,
) -> DataFrame:
    """(id, keys array<long>, sketch...), a row an id -> (id, label) for ids that verified links connect; label is the group's
    smallest id, whose own row may be missing.

    ``possible(l, r)`` is an SQL condition on two rows' sketch columns that no true pair fails. ``fetch`` takes the ids
    that are in such pairs and returns what they are verified by (with their id), each once; ``verify`` takes distinct (a, b) pairs and
    that, and returns the pairs that are linked. The first hub of a bucket is the member that shares most buckets with most others.
    ``delta``, where links are on sets that share ``percent`` of their union, takes (id, fam, label) and bodies and returns what ``related`` wants; ``kindred`` is an SQL
    condition on sketch columns, and only rows that meet it are in families. ``sure`` names columns of bodies and is the part of ``verify`` that they settle: after
    the first round it stands beside ``possible``, so that pairs which fail it are not written.
    """
    rows = members.select(F.explode(F.array_distinct("keys")).alias("key"), "id")
    full = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "full")
    sized = materialise(rows.join(full, "key"), "sized")
    degree = materialise(sized.groupBy("id").agg(F.sum("size").alias("degree")), "degree")
    apart = materialise(sized.select("key", "id").join(members.select("id", *sketch).join(degree, "id"), "id"), "apart")
    discard(full, sized, degree)
    labels, tested, bodies = Labels(), [], []
    told = [*sketch, *(sure[0] if sure is not None else [])]
    families = None

    def body() -> DataFrame:
        out = bodies[0]
        for more in bodies[1:]:
            out = out.unionByName(more)
        return out

    def settle(pairs: DataFrame, known: bool = False) -> None:
        """Verify pairs that are new and take their links. ``known``: all have bodies."""
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        tested.append(pairs)
        if is_empty(pairs):
            return
        ids = materialise(pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct()).distinct(), "ends")
        if not known:
            gather(ids)
        found = materialise(verify(pairs, body().join(small(ids), "id", "left_semi")), "found")
        labels.add(found)
        discard(found, ids)

    def gather(ids: DataFrame) -> None:
        """Bodies of ids that have none yet."""
        for old in bodies:
            ids = ids.join(old.select("id"), "id", "left_anti")
        ids = materialise(ids, "ids")
        if not bodies or not is_empty(ids):
            bodies.append(materialise(fetch(ids), "bodies"))
        discard(ids)

    def with_bodies(rows: DataFrame) -> DataFrame:
        return rows if sure is None else rows.join(body().select("id", *sure[0]), "id")

    def passing(left: str, right: str) -> str:
        return possible(left, right) if sure is None else f"{possible(left, right)} and {sure[1](left, right)}"

    hubs = apart.withColumn("label", F.col("id")).groupBy("key").agg(F.max_by(F.struct("id", "label", "degree", *sketch), F.struct("degree", "id")).alias("h"))
    turn, carried = 0, ["id", "label", "degree", *sketch]
    while True:
        hubs = materialise(hubs.select("key", *(F.col(f"h.{c}").alias(f"h_{c}") for c in carried)), "hubs")
        if is_empty(hubs):
            break
        rows = apart.withColumn("label", F.col("id")) if turn == 0 else apart
        star = rows.join(hubs, "key").where("label <> h_label").where(possible("", "h_") if turn == 0 else passing("", "h_"))
        if families is not None:
            star = star.where("fam <> h_fam")
        if turn == 0 and delta is not None:
            near = star.groupBy("id", "h_id").agg(F.first("h_degree").alias("h_degree"), *(F.first(c).alias(c) for c in sketch))
            near = materialise(near, "near")
            kin = materialise(near.groupBy("id").agg(F.max_by("h_id", F.struct("h_degree", "h_id")).alias("fam"), *(F.first(c).alias(c) for c in sketch)), "kin")
            # each first meets its greatest hub, then the hubs that this has not connected with it
            settle(kin.select(F.least("id", "fam").alias("a"), F.greatest("id", "fam").alias("b")).distinct())
            own = labels.of(near.select("id", "h_id")).select(F.col("id").alias("a"), F.col("h_id").alias("id"), F.col("label").alias("l_a"))
            settle(labels.of(own).where("l_a <> label").select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b")).distinct())
            new = materialise(kin.where(kindred), "kin")
            discard(kin)
            kin = new
            for _ in range(2):
                # a hub that is near to a greater one takes its family there
                to = kin.select(F.col("id").alias("fam"), F.col("fam").alias("to"))
                new = materialise(kin.join(to, "fam", "left").withColumn("fam", F.when(F.col("to") != F.col("id"), F.col("to")).otherwise(F.col("fam"))).drop("to"), "kin")
                discard(kin)
                kin = new
            if bodies:
                gather(kin.select("id").union(kin.select("fam")).distinct())
            families = kin.select("id", "fam")
            settle(families.select(F.least("id", "fam").alias("a"), F.greatest("id", "fam").alias("b")).distinct())
            for more in HELPERS:
                # outsiders first meet some keyed members of their family's largest group, which leaves few of them
                if not bodies:
                    break
                rows = unsettled(labels.of(with_bodies(kin)), ["label"], "fam")
                salt = F.pmod(F.xxhash64(F.lit(more), "id"), F.lit(more)).alias("salt")
                picks = rows.where("not outside").groupBy("fam", salt).agg(F.max_by(F.struct("id", *told), F.struct(F.xxhash64(F.lit(more), "id"), "id")).alias("h"))
                picks = materialise(picks.select("fam", *(F.col(f"h.{c}").alias(f"h_{c}") for c in ["id", *told])), "picks")
                met = rows.where("outside").join(picks, "fam").where(passing("", "h_"))
                settle(met.select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b")).distinct(), known=True)
            if bodies:  # else no member is near to a hub, and there is no family
                settle(related(delta(unsettled(labels.of(families), ["label"], "fam").drop("outside"), body()), percent), known=True)
            discard(near)
        else:
            settle(star.select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b")).distinct(), known=turn > 0 and sure is not None)
        turn += 1

        # hubs have met all other groups of their buckets and leave; so do buckets whose rest is one group
        left = labels.of(apart.select("key", "id", *(sketch if turn == 1 else told), *(["fam"] if turn > 1 and families is not None else [])).join(hubs.select("key", F.col("h_id").alias("id")), ["key", "id"], "left_anti"))
        if turn == 1 and families is not None:
            left = left.join(families, "id", "left").withColumn("fam", F.coalesce("fam", "id"))
        left = materialise(left, "left")
        rest = unsettled(left, ["label"] if families is None else ["label", "fam"])
        if turn == 1 and sure is not None:
            rest = materialise(rest, "rest")
            gather(rest.select("id").distinct())
            new = materialise(with_bodies(rest), "apart")
            discard(rest)
        else:
            new = materialise(rest, "apart")
        discard(hubs, left, apart)
        apart = new
        carried = ["id", "label", *told, *(["fam"] if families is not None else [])]
        salt = F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(GROWTH**turn)).alias("salt")
        hubs = apart.where("outside").groupBy("key", salt).agg(F.max_by(F.struct(*carried), F.struct(F.xxhash64(F.lit(turn), "id"), "id")).alias("h"))
    discard(apart, hubs, *tested, *bodies, *([kin] if families is not None else []))
    return labels.table if labels.table is not None else members.select("id", F.col("id").alias("label")).where("false")
