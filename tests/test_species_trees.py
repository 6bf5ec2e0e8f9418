"""Species trees from gene trees against the driver-side consensus and hand-worked cases."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cladeforge.functions import consensus, newick
from cladeforge.operators import genetrees, results, species_trees
from cladeforge.sources import sequences, sinks


def random_tree(rng, taxa):
    parts = [f"{t}:{rng.randint(1, 9)}" for t in rng.sample(taxa, len(taxa))]
    while len(parts) > 3:
        a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
        parts.append(f"({a},{b}):{rng.randint(1, 9)}")
    return f"({','.join(parts)});"


def branches(tree, taxa):
    return {m: round(d, 5) for m, d in consensus.splits(tree, taxa).items()}


@pytest.mark.parametrize(("n_taxa", "at_once"), [(6, 1000), (9, 3), (70, 5)])
def test_consensus_equals_that_of_a_list(spark, n_taxa, at_once):
    rng = random.Random(n_taxa)
    taxa = sorted(f"s{k:02d}" for k in range(n_taxa))
    texts = [random_tree(rng, taxa) for _ in range(5)]
    texts = [t for k, t in enumerate(texts) for _ in range(5 - k)]
    frame = spark.createDataFrame([*enumerate(texts), (98, None), (99, "(("), (97, "(s00:1,s01:1,other:1);")], "og long, newick string")
    text, n = species_trees.consensus_tree(frame, taxa)
    want = consensus.consensus([newick.parse(t) for t in texts], taxa)
    assert n == len(texts) and branches(newick.parse(text), taxa) == pytest.approx(branches(want, taxa), abs=1e-3)
    counts = species_trees.split_counts(species_trees.tree_splits(frame, taxa))
    kept = species_trees.compatible_splits(counts, n_taxa, at_once)
    masks = {sum(w << species_trees.WORD * k for k, w in enumerate(s)) for s, _, _ in kept}
    assert masks == {m for m in consensus.splits(want, taxa) if 1 < m.bit_count() < n_taxa - 1}
    names = counts.select("split", species_trees.taxa_of(F.col("split"), taxa).alias("taxa"), species_trees.bits(F.col("split")).alias("k")).collect()
    for r in names:
        m = sum(w << species_trees.WORD * k for k, w in enumerate(r["split"]))
        assert r["taxa"] == [t for k, t in enumerate(taxa) if m >> k & 1] and r["k"] == m.bit_count()


def test_closest_distances_by_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        leaves = [f"{rng.choice('abcd')}|{k}" for k in range(rng.randint(2, 9))]
        tree = newick.parse(random_tree(rng, leaves))
        want = {}
        for x, y in combinations(tree.leaves(), 2):
            key = tuple(sorted((x.name[0], y.name[0])))
            if key[0] != key[1]:
                want[key] = min(want.get(key, 1e9), newick.distance(x, y))
        assert consensus.closest_distances(tree, lambda g: g[0]) == pytest.approx(want)


def test_species_trees_of_gene_trees(spark):
    texts = ["((a|1:1,b|1:1):1,((c|1:1,d|1:1):1,(c|2:5,d|2:5):1):1);", "(a|1:1,b|1:1,c|1:1);", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "og long, newick string")
    rows = species_trees.closest_species_trees(frame, "abcd").collect()
    assert [r["og"] for r in rows] == [0]
    text, n = species_trees.species_tree(frame, "abcd")
    assert n == 1 and {0b1100} <= set(branches(newick.parse(text), list("abcd")))
    assert species_trees.species_tree(frame.where("false"), "abcd") == (None, 0)
    assert species_trees.species_tree(frame, "ab") == ("(a:1,b:1);", 0)
    assert [tuple(r) for r in species_trees.topology_lines(frame).collect()] == []
    assert [tuple(r) for r in species_trees.topology_lines(frame, first=0).collect()] == [(0, "((a,b),((c,d),(c,d)));")]


def test_species_tree_of_distances(spark):
    tree = newick.parse("((a:1,b:2):3,c:4,(d:5,e:6):7);")
    rows = [(x.name, y.name, newick.distance(x, y)) for x, y in combinations(tree.leaves(), 2)]
    got = newick.parse(species_trees.distance_species_tree(spark.createDataFrame(rows, "sp_a string, sp_b string, d double")))
    assert branches(got, list("abcde")) == branches(tree, list("abcde"))


def test_species_alignment(spark):
    members = spark.createDataFrame([(1, "a", "a1"), (1, "b", "b1"), (1, "c", "c1"), (2, "a", "a2"), (2, "b", "b2"), (2, "c", "c2"), (2, "c", "c3"), (3, "a", "a4")], "og long, sp string, gene string")
    aligned = spark.createDataFrame([(1, "a1", "AC-*"), (1, "b1", "A--G"), (1, "c1", "A-TG"), (2, "a2", "TT"), (2, "b2", "T-"), (2, "c2", "GG")], "og long, gene string, aligned string")
    both = spark.createDataFrame([(1,), (2,), (3,)], "og long")
    got = {r["sp"]: r["row"] for r in genetrees.concatenated(aligned, members, both, share=2 / 3).collect()}
    # columns may lack (1 - 0.5 * 2 / 3) * 3 = 2 species
    assert got == {"a": "AC--TT", "b": "A--GT-", "c": "A-TG--"}
    got = {r["sp"]: r["row"] for r in genetrees.concatenated(aligned, members, both, share=1.0, max_gap=1.0).collect()}
    assert got == {"a": "A", "b": "A", "c": "A"}
    rows, k = genetrees.species_alignment(aligned, members)
    assert k == 2 and {r["sp"]: len(r["row"]) for r in rows.collect()} == {"a": 6, "b": 6, "c": 6}


def test_locus_tree_files(spark, tmp_path):
    (tmp_path / "OG1.locus.tree").write_text("((0_1:1,1_1:1)n2:1,(0_2:1,1_2:1)n3:1)n1;\n")
    (tmp_path / "OG1.locus.recon").write_text("n1\t3\tdup\nn2 3 spec\nabsent 3 spec\n")
    trees, events = sequences.read_locus_trees(spark, str(tmp_path))
    nodes = genetrees.tree_nodes(trees)
    genes = nodes.where("is_leaf").selectExpr("name as gene", "split(name, '_')[0] as sp")
    sides = results.locus_sides(nodes, events, genes)
    # an event of an absent node is the root's
    assert sorted((r["a"], r["b"]) for r in results.gene_pairs(sides).collect()) == [("0_1", "1_1"), ("0_1", "1_2"), ("1_1", "0_2")]
    (tmp_path / "OG2.locus.recon").write_text("n1 spec\n")
    with pytest.raises(Exception, match="malformed reconciliation"):
        sequences.read_locus_trees(spark, str(tmp_path))[1].collect()


def test_renaming_and_group_files(spark, tmp_path):
    trees = spark.createDataFrame([(1, "((0_1:1,0_2:2)0.9:3,1_1:4);"), (2, "(0_1:1,(1_1:1,9_9:1)n1:1);"), (3, None)], "og long, newick string")
    names = spark.createDataFrame([("0_1", "Aa_x"), ("0_2", "Aa_y"), ("1_1", "Bb_z"), ("n1", "wrong")], "gene string, name string")
    got = {r["og"]: r["newick"] for r in genetrees.renamed(trees, names).collect()}
    assert got == {1: "((Aa_x:1,Aa_y:2)0.9:3,Bb_z:4);", 2: "(Aa_x:1,(Bb_z:1,9_9:1)n1:1);"}
    hogs = spark.createDataFrame([("N0.HOG1", "N0", ["a", "b"]), ("N1.HOG1", "N1", ["a"])], "hog string, level string, genes array<string>")
    sinks.write_hog_fasta(hogs, spark.createDataFrame([("a", "AC"), ("b", "GT")], "gene string, seq string"), str(tmp_path / "hogs"))
    assert sorted(p.name for p in (tmp_path / "hogs").glob("hog=*")) == ["hog=N0.HOG1"]
    assert "".join(p.read_text() for p in (tmp_path / "hogs").rglob("part-*")) == ">a\nAC\n>b\nGT\n"
