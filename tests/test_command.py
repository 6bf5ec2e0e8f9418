"""The command from sequence files to ortholog tables, end to end, and readers and writers against each other."""

import random

from cladeforge import __main__ as command
from cladeforge.functions import consensus, newick
from cladeforge.sources import sequences, sinks


def mutated(rng, seq, rate):
    return "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") if rng.random() < rate else c for c in seq)


def test_sequences_to_orthologs(spark, tmp_path):
    rng = random.Random(4)
    species, families = ["Aa", "Bb", "Cc", "Dd"], {}
    for f in range(6):
        base = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(240))
        left, right = mutated(rng, base, 0.06), mutated(rng, base, 0.06)
        for sp, parent in zip(species, (left, left, right, right), strict=True):
            families[(sp, f)] = mutated(rng, parent, 0.03)
    folder = tmp_path / "in"
    folder.mkdir()
    for sp in species:
        (folder / f"{sp}.fa").write_text("".join(f">g{sp}{f} text\n{families[(sp, f)]}\n" for f in range(6)))
    out = str(tmp_path / "out")
    members = command.run(spark, str(folder), out, k=3, components=True, scores_v2=True, species_tree="((Aa:1,Bb:1):1,(Cc:1,Dd:1):1);").collect()
    groups = {}
    for r in members:
        groups.setdefault(r["og"], set()).add(r["gene"])
    assert sorted(map(sorted, groups.values())) == sorted([sorted(f"g{sp}{f}" for sp in species) for f in range(6)])
    lines = [r[0] for r in spark.read.option("lineSep", "\r\n").text(f"{out}/Phylogenetic_Hierarchical_Orthogroups/level=N0").collect()]
    assert lines[0].split("\t") == ["HOG", "OG", "Gene Tree Parent Clade", *species] and len(lines) == 7
    assert [x.split("\t")[0] for x in lines[1:]] == [f"N0.HOG{k:07d}" for k in range(6)]
    table = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/Comparative_Genomics_Statistics/OrthologuesStats_one-to-one.tsv").collect()
    assert {r["Aa"] for r in table if r[0] != "Aa"} == {"6"}
    pairs = spark.read.text(f"{out}/Orthologues")
    assert pairs.where("sp_a = 'Aa' and sp_b = 'Dd'").count() == 6 and pairs.count() == 6 * 12


def test_an_unrooted_species_tree_gets_a_root(spark, tmp_path):
    rng = random.Random(5)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    base = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(200)) for _ in range(3)]
    for sp in ("Aa", "Bb", "Cc", "Dd"):
        (folder / f"{sp}.fa").write_text("".join(f">g{sp}{f}\n{mutated(rng, x, 0.03)}\n" for f, x in enumerate(base)))
    command.run(spark, str(folder), out, k=3, components=True, scores_v2=True, species_tree="(Aa:1,Bb:1,(Cc:1,Dd:1):1);", unrooted=True)
    rows = spark.read.json(f"{out}/Species_Tree").collect()
    assert len(rows) == 5 and abs(sum(r["probability"] for r in rows) - 1) < 1e-9 and len({r["species_tree"] for r in rows}) == 1
    assert spark.read.text(f"{out}/Orthologues").where("sp_a = 'Aa' and sp_b = 'Dd'").count() == 3


def test_a_species_tree_is_inferred(spark, tmp_path):
    rng = random.Random(11)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    seqs = {sp: [] for sp in ("Aa", "Bb", "Cc", "Dd", "Ee")}
    for _ in range(4):
        base = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(240))
        left, right = mutated(rng, base, 0.08), mutated(rng, base, 0.08)
        for sp, parent in (("Aa", left), ("Bb", left), ("Cc", base), ("Dd", right), ("Ee", right)):
            seqs[sp].append(mutated(rng, parent, 0.02))
    for sp, some in seqs.items():
        (folder / f"{sp}.fa").write_text("".join(f">g{f}\n{s}\n" for f, s in enumerate(some)))
    command.run(spark, str(folder), out, k=3, components=True, scores_v2=True, infer=True)
    made = spark.read.json(f"{out}/Unrooted_Species_Tree").first()
    got = set(consensus.splits(newick.parse(made["species_tree"]), sorted(seqs)))
    assert made["gene_trees"] == 4 and {0b11100, 0b11000} <= got
    assert spark.read.text(f"{out}/Orthologues").where("sp_a = 'Aa' and sp_b = 'Dd'").count() == 4


def test_clusters_and_groups_read_what_is_written(spark, tmp_path):
    rows = spark.createDataFrame([(0, "Aa", "a"), (0, "Bb", "b"), (1, "Aa", "c")], "og int, sp string, gene string")
    sinks.write_clusters(rows, str(tmp_path / "clusters"))
    assert sorted(map(tuple, sequences.read_clusters(spark, str(tmp_path / "clusters")).collect())) == [(0, "a"), (0, "b"), (1, "c")]
    sinks.write_groups(rows, ["Aa", "Bb"], str(tmp_path / "groups"))
    got = sequences.read_groups(spark, str(tmp_path / "groups/Orthogroups.tsv"), first=1).collect()
    assert sorted(map(tuple, got)) == [("OG0000000", "Aa", "a"), ("OG0000000", "Bb", "b")]


def test_some_species_and_their_document(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for sp, letters in {"Aa": "MKLVNPQRST", "Bb": "MKLVNPQRST", "Cc": "WYWYFFGHIK"}.items():
        (tmp_path / f"in/{sp}.fa").write_text(f">g1 {sp}\n{letters * 3}\n>only{sp}\n{'ACDE' * 3 + sp.upper() * 6}\n")
    (tmp_path / "info.tsv").write_text("Aa.fa\tFirst\t11\tdb\tv1\nBb.fa\tSecond\t22\tdb\tv2\n")
    out = tmp_path / "out"
    members = command.run(spark, str(tmp_path / "in"), str(out), k=3, components=True, scores_v2=True, stop="groups", only=["Aa", "Bb"], species_info=str(tmp_path / "info.tsv")).collect()
    assert {r["sp"] for r in members} == {"Aa", "Bb"} and len(members) == 4
    sizes = {}
    for r in members:
        sizes[r["og"]] = sizes.get(r["og"], 0) + 1
    read = lambda f: "".join(p.read_text() for p in sorted((out / f).rglob("part-*")))
    document = read("Orthogroups.orthoxml")
    assert document.count("<gene ") == document.count("<geneRef ") == 4 and 'name="Second" NCBITaxId="22"' in document and document.count("<orthologGroup ") == len(sizes)
    loose = sorted((r["sp"], r["gene"]) for r in members if sizes[r["og"]] == 1)
    assert sorted(x for x in read("Unassigned_Sequences").split("\n") if x.startswith(">")) == sorted(f">{g}" for _, g in loose)
