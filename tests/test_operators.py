"""Gathering, clustering, statistics and sources on fixtures worked by hand."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cladeforge.operators import clustering, gathering, genetrees, orthogroups, ranking
from cladeforge.sources import sequences, sinks


def test_gathering_micro_fixture(spark):
    hits = [("a0", "b0", 10), ("a0", "b1", 6), ("a0", "a1", 11), ("a1", "b1", 8), ("a1", "a0", 7), ("b0", "a0", 9), ("b1", "a1", 7), ("b1", "a0", 7)]
    scored = spark.createDataFrame([(q, h, q[0], h[0], 1, 1, float(s)) for q, h, s in hits], "q string, h string, q_sp string, h_sp string, lq int, lh int, score double")
    best = gathering.best_hits(scored)
    assert sorted((r["q"], r["h"]) for r in best.collect()) == [("a0", "a1"), ("a0", "b0"), ("a1", "b1"), ("b0", "a0"), ("b1", "a0"), ("b1", "a1")]
    rbh = gathering.reciprocal(best)
    assert sorted((r["q"], r["h"]) for r in rbh.collect()) == [("a0", "b0"), ("a1", "b1"), ("b0", "a0"), ("b1", "a1")]
    bars = gathering.cutoffs(scored, rbh)
    assert {r["q"]: r["cutoff"] for r in bars.collect()} == {"a0": 10, "a1": 8, "b0": 9, "b1": 7}
    got = {(r["q"], r["h"]): r["weight"] for r in gathering.graph(gathering.connect(scored, bars), scored).collect()}
    assert got == {("a0", "b0"): 20, ("b0", "a0"): 18, ("a1", "b1"): 16, ("b1", "a1"): 14, ("a0", "a1"): 11, ("a1", "a0"): 7, ("b1", "a0"): 7, ("a0", "b1"): 6}


def test_markov_clustering_splits_two_cliques(spark):
    edges = [(i, j, 1.0) for g in (range(4), range(4, 8)) for i in g for j in g if i != j] + [(3, 4, 0.1), (4, 3, 0.1)]
    got = clustering.markov(spark.createDataFrame(edges, "q long, h long, weight double"), inflation=2.0).collect()
    assert {frozenset(r["gene"] for r in got if r["og"] == o) for o in {r["og"] for r in got}} == {frozenset(range(4)), frozenset(range(4, 8))}
    assert np.unique([r["gene"] for r in got]).size == 8


def test_g50(spark):
    members = spark.createDataFrame([(og, 0, 10 * og + k) for og, n in enumerate((5, 3, 2)) for k in range(n)], "og int, sp int, gene int")
    assert orthogroups.n50(members).first().asDict() == {"g50": 5, "o50": 1}


def test_fasta_clusters_and_hits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.fa").write_text(">x:1 first\nmkl\nEF\n>y two\nAC\n")
    (tmp_path / "in/a.faa").write_text(">dup a\nACGT\n>dup b\nacgt\n")
    got = sequences.read_fasta(spark, str(tmp_path / "in")).orderBy("species_id", "seq_idx").collect()
    assert [(r["species_id"], r["species"], r["seq_idx"], r["accession"], r["residues"], r["len"]) for r in got] == [(0, "a", 0, "dup a", "ACGT", 4), (0, "a", 1, "dup b", "ACGT", 4), (1, "b", 0, "x_1", "MKLEF", 5), (1, "b", 1, "y", "AC", 2)]
    assert [r["species"] for r in sequences.nucleotide_species(sequences.read_fasta(spark, str(tmp_path / "in"))).collect()] == ["a"]
    (tmp_path / "c.txt").write_text("(mclheader\nmcltype matrix\n)\n(mclmatrix\nbegin\n0    0_1 1_2\n     1_3 $\n1    2_0 Prof1 $\n)\n")
    assert sorted((r["og"], r["gene"]) for r in sequences.read_clusters(spark, str(tmp_path / "c.txt")).collect()) == [(0, "0_1"), (0, "1_2"), (0, "1_3"), (1, "2_0")]
    (tmp_path / "h.txt").write_text("\t".join(["0_0", "1_0", *["1"] * 8, "1e-5", "51.2"]) + "\n")
    assert sequences.read_hits(spark, str(tmp_path / "h.txt")).first()["score"] == 51.2


def test_group_files(spark, tmp_path):
    members = spark.createDataFrame([(0, "s1", "g2"), (0, "s1", "g1"), (0, "s2", "h1"), (1, "s2", "h2")], "og int, sp string, gene string")
    sinks.write_groups(members, ["s1", "s2"], str(tmp_path / "out"))
    read = lambda f: "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out" / f).glob("part-*")))
    assert read("Orthogroups.tsv") == "Orthogroup\ts1\ts2\r\nOG0000000\tg1, g2\th1\r\n"
    assert read("Orthogroups.GeneCount.tsv") == "Orthogroup\ts1\ts2\tTotal\r\nOG0000000\t2\t1\t3\r\n"
    assert read("Orthogroups_UnassignedGenes.tsv") == "Orthogroup\ts1\ts2\r\nOG0000001\t\th2\r\n"
    assert "OG0000000: g1 g2 h1" in read("Orthogroups.txt")


def test_flow_clusters_are_the_same_by_matrix_and_by_joins(spark, monkeypatch):
    rng = __import__("random").Random(2)
    edges = [(a, b, round(rng.uniform(0.5, 3), 3)) for k in range(4) for a in range(6 * k, 6 * k + 6) for b in range(a + 1, 6 * k + 6)]
    edges += [(5, 6, 0.1), (11, 12, 0.1), (17, 18, 0.05), (30, 31, 1.0), (32, None, 1.0), (33, 33, 1.0)]
    df = spark.createDataFrame(edges, "q long, h long, weight double")
    dense = sorted(map(tuple, clustering.markov(df, inflation=2.0).collect()))
    monkeypatch.setattr(clustering, "DENSE", 0)
    joins = sorted(map(tuple, clustering.markov(df, inflation=2.0).collect()))
    assert dense == joins and len({og for _, og in dense}) == 5


def test_flow_of_hubs_is_bounded(spark, monkeypatch):
    rng = __import__("random").Random(4)
    edges = [(0, k, round(rng.uniform(1, 2), 3)) for k in range(1, 120)] + [(a, a + 1, 3.0) for a in range(1, 119, 2)] + [(200 + a, 200 + b, 1.0) for a in range(5) for b in range(a)]
    df = spark.createDataFrame(edges, "q long, h long, weight double")
    both = clustering.cut(clustering.symmetric_edges(df))
    start = clustering.cut(clustering.flow_start(both, 10, 1e-4))
    assert start.groupBy("j").count().agg({"count": "max"}).first()[0] == 10
    columns, rows = (Counter(r[c] for r in start.collect()) for c in "ji")
    assert sum(columns[k] * rows[k] for k in columns) <= 10 * start.count()
    dense = sorted(map(tuple, clustering.markov(df, inflation=2.0, keep=10).collect()))
    monkeypatch.setattr(clustering, "DENSE", 0)
    assert dense == sorted(map(tuple, clustering.markov(df, inflation=2.0, keep=10).collect()))


def test_files_that_no_other_test_writes(spark, tmp_path):
    read = lambda f: "".join(p.read_bytes().decode() for p in sorted((tmp_path / f).rglob("part-*")))
    sinks.write_graph(spark.createDataFrame([(0, 1, 0.5), (0, 2, 1.25), (3, 0, 2.0)], "q long, h long, weight double"), str(tmp_path / "graph"))
    assert read("graph") == "0    1:0.500 2:1.250 $\n3    0:2.000 $\n"
    sinks.write_sorted(spark.createDataFrame([("b", 1), ("a", 2)], "x string, y int"), str(tmp_path / "sorted"), "x")
    assert "0\ta\t2" in read("sorted") and "1\tb\t1" in read("sorted")
    sinks.write_fasta(spark.createDataFrame([(1, "n1", "A" * 90), (2, "n2", "CC")], "og int, name string, seq string"), str(tmp_path / "fasta"))
    assert read("fasta/og=1") == f">n1\n{'A' * 80}\n{'A' * 10}\n" and read("fasta/og=2") == ">n2\nCC\n"
    lines = sinks.orthoxml(spark.createDataFrame([(0, 's"1', "g1"), (0, "s2", "h&1")], "og int, sp string, gene string")).orderBy("part", "at").collect()
    text = "\n".join(r["line"] for r in lines)
    assert text.startswith("<orthoXML") and 'species name="s&quot;1"' in text and text.count("<geneRef") == 2 and text.endswith("</orthoXML>")


def test_transcripts_offsets_and_ids(spark):
    from pyspark.sql import functions as F

    from cladeforge.operators import identifiers

    rows = [(0, 0, "t1 gene:A x", 5), (0, 1, "t2 gene:A", 9), (0, 2, "t3 locus=B", 3), (0, 3, "t4", 1), (1, 0, "t5 gene:A", 2), (1, 1, "t6 gene:A gene:B", 2)]
    seqs = spark.createDataFrame(rows, "species_id int, seq_idx int, header string, len int")
    kept = sequences.longest_per_gene(seqs, sequences.gene_of_header(F.col("header")))
    assert sorted((r["species_id"], r["seq_idx"]) for r in kept.collect()) == [(0, 1), (0, 2), (0, 3), (1, 0), (1, 1)]
    assert sorted((r["species_id"], r["n"], r["start"]) for r in sequences.offsets(seqs).collect()) == [(0, 4, 0), (1, 2, 4)]
    bad = identifiers.malformed_ids(spark.createDataFrame([("0: a",), ("#1: b c",), ("",), ("2 d",), ("3:",)], "value string"))
    assert {r[0] for r in bad.collect()} == {"2 d", "3:"}


def test_choosing_how_many_species():
    # all species do where there are enough groups; fewer only where that pays
    assert orthogroups.choose_occupancy([(4, 2000), (3, 9000), (2, 9000), (1, 9000)]) == 4
    assert orthogroups.choose_occupancy([(4, 10), (3, 120), (2, 130), (1, 500)]) == 3
    assert orthogroups.choose_occupancy([(4, 10), (3, 120), (2, 900), (1, 950)]) == 2


def test_closest_species_of_groups_without_their_pairs(spark):
    """Equal to the least over all pairs; two groups of 3,000 genes, which have 18 million, are done from 6,000 hits."""
    rng = random.Random(5)
    genes = [(g, f"s{g % 7}", g % 2) for g in range(60)]
    hits = {(q, h): rng.randint(1, 9) / 3 for q, h in (rng.sample(range(60), 2) for _ in range(400)) if q % 2 == h % 2}
    scored = spark.createDataFrame([(q, h, s) for (q, h), s in hits.items()], "q long, h long, score double")
    table = spark.createDataFrame(genes, "gene long, sp string, og long")
    whole = genetrees.closest_species_distances(genetrees.group_distances(table, scored), table)
    got = genetrees.closest_in_groups(table, scored, table)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) != []
    many = spark.range(6000).selectExpr("id as gene", "concat('s', id % 7) as sp", "id % 2 as og")
    ring = spark.range(6000).selectExpr("id as q", "(id + 2) % 6000 as h", "1.0 + id % 5 as score")
    found = genetrees.closest_in_groups(many, ring, many)
    assert found.count() == 2 * 21


def test_hits_are_dealt_twice_and_ranked_where_they_lie(spark):
    """From raw hits to best hits rows are dealt by h and by q only; ranks need no rows but the ranges'."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = spark.range(300).selectExpr("id % 17 as q", "(id * 7 + 1) % 19 as h", "1.0 + id % 5 as score")
        genes = spark.range(20).selectExpr("id as gene", "id % 3 as sp", "10 as len")
        best = gathering.best_hits(gathering.with_genes(gathering.best_per_pair(hits), genes))
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4, plan  # the hits twice, and the genes for either end
        ranked = ranking.with_rank(hits, F.col("score"), F.col("q"), F.col("h"))
        assert "cf_part" not in "".join(line for line in ranked._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in line and "row_number" in line)
        rows = sorted(ranked.collect(), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(300)) and [(r["score"], r["q"], r["h"]) for r in rows] == sorted((r["score"], r["q"], r["h"]) for r in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
