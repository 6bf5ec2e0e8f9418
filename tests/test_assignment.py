"""Representatives, profiles, and new species added to known groups, by batch, stream and command."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeforge import __main__ as command
from cladeforge.functions import representatives
from cladeforge.operators import profiles, similarity
from cladeforge.plans import assignment
from cladeforge.sources import sequences
from cladeforge.sources.stages import Stages
from cladeforge.streaming import assign as streaming

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def mutated(rng, seq, rate):
    return "".join(rng.choice(LETTERS) if rng.random() < rate else c for c in seq)


def families(rng, n, size, length=60, rate=0.03):
    base = ["".join(rng.choices(LETTERS, k=length)) for _ in range(n)]
    return {f"f{f}_{k}": mutated(rng, base[f], rate) for f in range(n) for k in range(size)}


def test_kmeans_finds_parted_clusters():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.05, (20, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    labels, centres = representatives.kmeans(x, 3, 1)
    assert len({tuple(labels[20 * k : 20 * k + 20]) for k in range(3)}) == 3 and all(len(set(labels[20 * k : 20 * k + 20])) == 1 for k in range(3))
    assert np.allclose(np.sort(centres.round(0), axis=0), np.sort([[0, 0], [5, 0], [0, 5]], axis=0))
    assert len(representatives.kmeans(np.zeros((5, 2)), 3)[0]) == 5


def test_embedding_and_picks():
    at = representatives.embed(["AX-", "VAR"])
    one = dict(zip(representatives.RESIDUES, zip(representatives.ACROSS, representatives.UP, strict=True), strict=True))
    assert np.allclose(at[0], [*one["A"], 0, 0, 0, 0]) and np.allclose(at[1], [*one["V"], *one["A"], *one["R"]])
    names = [f"g{k}" for k in range(9)]
    rows = ["AAAA"] * 3 + ["WWWW"] * 3 + ["----"] * 2 + ["AAAA"]
    got = representatives.pick(names, rows, 2)
    assert len(got) == 2 and {rows[names.index(g)] for g in got} == {"AAAA", "WWWW"} and got == representatives.pick(names[::-1], rows[::-1], 2)
    assert representatives.pick(names[:2], rows[:2], 2) == ["g0", "g1"]
    assert len(representatives.pick(names, ["AAAA"] * 9, 4)) == 4  # one cluster: filled up
    assert representatives.pick(names[:4], ["A---", "AA--", "----", "AAAA"], 3) == ["g0", "g1", "g3"]  # too many gaps


def test_a_clusters_member_by_brute_force():
    rng = random.Random(8)
    fam = families(rng, 3, 8, 40)
    names, rows = sorted(fam), [fam[n] for n in sorted(fam)]
    got = representatives.pick(names, rows, 3, seed=2)
    x = representatives.embed(rows)
    labels, centres = representatives.kmeans(x, 3, 2)
    want = sorted(max((i for i in range(len(rows)) if labels[i] == c), key=lambda i: (sum(v for v, m in zip(x[i], centres[c], strict=True) if m > 0.5), -i)) for c in range(3))
    assert got == [names[i] for i in want] and {n[:2] for n in got} == {"f0", "f1", "f2"}


def test_representatives_of_tables(spark):
    rng = random.Random(1)
    fam = families(rng, 4, 6)
    aligned = spark.createDataFrame([(og, n, s) for og in (1, 2) for n, s in fam.items()] + [(3, "alone", "ACD"), (1, "f0_0", fam["f0_0"])], "og long, gene string, aligned string")
    got = defaultdict(set)
    for r in profiles.from_alignments(aligned, 4).collect():
        got[r["og"]].add(r["gene"])
    assert got[3] == {"alone"} and got[1] == got[2] and {g[:2] for g in got[1]} == {"f0", "f1", "f2", "f3"}
    genes = spark.createDataFrame([*fam.items(), ("short", "AC"), ("none", None)], "gene string, seq string")
    picked = profiles.from_pieces(genes, 4, k=3, seed=5).collect()
    assert 1 < len(picked) <= 4 and len({r["cluster"] for r in picked}) == len(picked) and {r["gene"][:2] for r in picked} <= {"f0", "f1", "f2", "f3"}
    assert profiles.from_pieces(genes.where("false"), 4).count() == 0
    one = profiles.from_pieces(genes.where("gene like 'f0%'"), 1).collect()
    kmers = {n: {s[i : i + 3] for i in range(len(s) - 2)} for n, s in fam.items() if n.startswith("f0")}
    common = {k for k in set().union(*kmers.values()) if sum(k in v for v in kmers.values()) > 3}
    assert [(r["gene"], r["shared"]) for r in one] == [min(((n, len(v & common)) for n, v in kmers.items()), key=lambda x: (-x[1], x[0]))]


def test_selections(spark):
    members = spark.createDataFrame([(og, "s", f"g{og}_{k}") for og in (1, 2) for k in range(5)], "og long, sp string, gene string")
    assert profiles.profiles(members, 2, "all").count() == 10
    a = sorted(map(tuple, profiles.profiles(members, 2, "random").collect()))
    assert len(a) == 4 and a == sorted(map(tuple, profiles.profiles(members.repartition(3), 2, "random").collect()))
    aligned = spark.createDataFrame([(1, f"g1_{k}", "ACDE") for k in range(5)], "og long, gene string, aligned string")
    assert sorted(r["og"] for r in profiles.profiles(members, 2, "kmeans", aligned).collect()) == [1, 1, 2, 2]
    with pytest.raises(ValueError, match="selection"):
        profiles.profiles(members, 2, "best")


def test_profile_hit_files(spark, tmp_path):
    import gzip

    row = lambda q, t, e: "\t".join([q, t, "90", e, "50"]) + "\n"
    with gzip.open(tmp_path / "hits.txt.gz", "wt") as f:
        f.write(row("9_1", "0000012_3_44", "1e-30") + row("9_1", "0000007.2_1_5", "1e-25") + row("9_2", "0000007_1_5", "1e-3"))
    hits = sequences.read_profile_hits(spark, str(tmp_path / "hits.txt.gz"))
    assert sorted(map(tuple, hits.collect()), key=str) == [("9_1", 12, None, "3", "3_44", 1e-30), ("9_1", 7, "2", "1", "1_5", 1e-25), ("9_2", 7, None, "1", "1_5", 1e-3)]
    assert sorted(map(tuple, similarity.assign(hits).collect())) == [("9_1", 12, "3"), ("9_2", 7, "1")]
    logs = hits.withColumn("evalue", F.log10("evalue"))
    assert sorted((r["gene"], r["og"]) for r in profiles.close_groups(logs).collect()) == [("9_1", 7), ("9_1", 12), ("9_2", 7)]
    assert profiles.close_groups(logs, 5.0).where("gene = '9_1'").count() == 1
    (tmp_path / "bad.txt").write_text(row("9_1", "nogroup", "1"))
    with pytest.raises(Exception, match="malformed profile hit"):
        sequences.read_profile_hits(spark, str(tmp_path / "bad.txt")).collect()


def world(rng):
    """Six species, three of them core; families 0 to 3 are in all, 4 and 5 in the new ones alone."""
    base = ["".join(rng.choices(LETTERS, k=200)) for _ in range(6)]
    return {sp: {f"g{f}": mutated(rng, base[f], 0.02) for f in (range(4) if core else range(6))} for sp, core in (("Aa", True), ("Bb", True), ("Ff", True), ("Cc", False), ("Dd", False), ("Ee", False))}


def write(folder, seqs):
    folder.mkdir()
    for sp, genes in seqs.items():
        (folder / f"{sp}.fa").write_text("".join(f">{g}\n{s}\n" for g, s in genes.items()))


def grouping(members):
    out = defaultdict(set)
    for r in members.collect():
        out[r["og"]].add(r["gene"])
    return sorted(map(sorted, out.values()))


TREE = "((((Aa:1,Bb:1):1,Ff:1):1,Ee:1):1,(Cc:1,Dd:1):1);"


def test_clades_of_new_species(spark):
    got = defaultdict(set)
    for r in assignment.new_species_clades(spark, "((((Aa:1,Bb:1):1,Ff:1):1,(Ee:1,Gg:1):1):1,(Cc:1,Dd:1):1);", ["Aa", "Bb", "Ff", "Cc"]).collect():
        got[r["clade"]].add(r["sp"])
    assert sorted(map(sorted, got.values())) == [["Cc", "Dd"], ["Ee", "Gg"]]


def test_new_species_by_command_and_restart(spark, tmp_path, monkeypatch):
    seqs = world(random.Random(6))
    write(tmp_path / "core", {s: seqs[s] for s in ("Aa", "Bb", "Ff")})
    write(tmp_path / "new", {s: seqs[s] for s in ("Cc", "Dd", "Ee")})
    core = str(tmp_path / "core_out")
    command.run(spark, str(tmp_path / "core"), core, k=4, components=True, scores_v2=True)
    want = sorted([sorted(f"{sp}|g{f}" for sp in seqs) for f in range(4)] + [sorted(f"{sp}|g{f}" for sp in ("Cc", "Dd")) for f in (4, 5)] + [[f"Ee|g{f}"] for f in (4, 5)])
    # killed within the clades' groups, then started again
    killed, fresh = str(tmp_path / "killed"), str(tmp_path / "fresh")
    options = {"species_tree": TREE, "k": 4, "components": True}
    with monkeypatch.context() as m:
        m.setattr(assignment, "clade_hits", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            command.assign(spark, str(tmp_path / "new"), killed, core, **options)
    with monkeypatch.context() as m:
        m.setattr(profiles, "profile_hits", lambda *a: 1 / 0)  # made before: not made again
        resumed = grouping(command.assign(spark, str(tmp_path / "new"), killed, core, **options))
    assert resumed == grouping(command.assign(spark, str(tmp_path / "new"), fresh, core, **options)) == want
    lines = [r[0] for r in spark.read.text(f"{fresh}/Profile_Sequences").collect()]
    assert sum(x.startswith(">") for x in lines) == 12
    with pytest.raises(ValueError, match="made with"):
        command.assign(spark, str(tmp_path / "new"), fresh, core, species_tree=TREE, k=5)
    with pytest.raises(ValueError, match="already"):
        command.assign(spark, str(tmp_path / "core"), str(tmp_path / "clash"), core, k=4)
    # an addition to an addition; without a species tree what is left are groups of one
    write(tmp_path / "more", {"Hh": {"h": seqs["Cc"]["g4"], "odd": "ACDEF" * 9}})
    more = grouping(command.assign(spark, str(tmp_path / "more"), str(tmp_path / "third"), fresh, k=4, components=True))
    assert sorted(["Cc|g4", "Dd|g4", "Hh|h"]) in more and ["Hh|odd"] in more and sum(map(len, more)) == 4 * 3 + 6 * 3 + 2


def test_manifest_chain(spark, tmp_path):
    a = Stages(spark, f"{tmp_path}/a", {"x": 1})
    a.table("t", lambda: spark.range(3).toDF("n"))
    b = Stages(spark, f"{tmp_path}/b", {}, previous=f"{tmp_path}/a")
    c = Stages(spark, f"{tmp_path}/c", {}, previous=f"{tmp_path}/b")
    assert [s.folder for s in c.chain()] == [f"{tmp_path}/{x}" for x in "cba"] and c.find("t").count() == 3
    b.table("t", lambda: spark.range(5).toDF("n"))
    assert Stages(spark, f"{tmp_path}/c").find("t").count() == 5 and a.find("t").count() == 3
    with pytest.raises(FileNotFoundError):
        c.find("missing")
    with pytest.raises(ValueError, match="follows on"):
        Stages(spark, f"{tmp_path}/c", {}, previous=f"{tmp_path}/a")


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    fam = families(rng, 4, 4)
    members = spark.createDataFrame([(int(n[1]), "s", n) for n in fam if n.endswith(("_0", "_1"))], "og long, sp string, gene string")
    seqs = spark.createDataFrame([*fam.items(), ("odd", "ACACACACAC")], "gene string, seq string")
    pieces = profiles.letter_pieces(4)
    index = profiles.profile_index(profiles.profiles(members, selection="all"), seqs, pieces)
    new = seqs.join(members, "gene", "left_anti").select("gene", "seq")
    new.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("gene string, seq string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streaming.assign_stream(stream, index, pieces, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("gene", "og", "hit_sp").collect()))
    assert got == sorted(map(tuple, streaming.assign_batch(new, index, pieces).collect()))
    assert got == sorted((n, int(n[1]), "s") for n in fam if n.endswith(("_2", "_3")))


def test_resolving_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tre").write_text("((x_1:1,x_2:1):1,(u_1:1,(v_1:1,z_1:1,u_2:1):1):1);\n")
    (tmp_path / "in/b.tre").write_text("((x_1:1,")
    out = command.resolve(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [(r["og"], r["n_moves"]) for r in out.collect()] == [("a.tre", 1)]
    text = spark.read.text(f"{tmp_path}/out/Resolved_Gene_Trees").first()[0]
    assert "(u_1:1,u_2:0.9)D:0.1" in text
    assert "b.tre" in {r[0].split("\t")[0] for r in spark.read.text(f"{tmp_path}/out/Unreadable_Gene_Trees").collect()}
