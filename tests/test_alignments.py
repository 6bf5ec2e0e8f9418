"""Alignments as rows, and the files of alignments, species and orthologs."""

import gzip
import random
import xml.etree.ElementTree as ET

import pytest

from cladeforge.functions import align
from cladeforge.operators import alignments
from cladeforge.sources import sequences, sinks


def read(folder) -> str:
    return "".join(p.read_bytes().decode() for p in sorted(folder.rglob("part-*")))


def test_columns_and_trimming_equal_the_kernel(spark):
    rng = random.Random(1)
    groups = {og: ["".join(rng.choice("AC-*-" if k % 3 else "ACDE") for k in range(w)) for _ in range(n)] for og, (n, w) in enumerate([(1, 5), (9, 40), (30, 25), (4, 60), (12, 12)])}
    frame = spark.createDataFrame([(og, k, r) for og, rows in groups.items() for k, r in enumerate(rows)], "og int, gene int, aligned string")
    for r in alignments.columns(frame).collect():
        letters = [x[r["pos"]] for x in groups[r["og"]] if x[r["pos"]] not in "-*"]
        best = min(((-letters.count(x), x) for x in letters), default=(None, None))
        assert (r["n_rows"], r["n_letters"], r["n_kinds"], r["top"], r["n_top"]) == (len(groups[r["og"]]), len(letters), len(set(letters)), best[1], -best[0] if letters else None)
    for limits in ((0.1, 12, 0.75), (0.6, 12, 0.75), (0.9, 5, 0.9), (0.3, 500, 0.75)):
        got = {(r["og"], r["gene"]): r["aligned"] for r in alignments.trimmed(frame, **dict(zip(("least_share", "least_columns", "least_letters"), limits))).collect()}
        for og, rows in groups.items():
            keep = align.trim_columns(rows, *limits, tolerance=1e-9)
            assert [got[og, k] for k in range(len(rows))] == ["".join(x[c] for c in keep) for x in rows]


def test_empty_alignments(spark):
    frame = spark.createDataFrame([(0, "a", None), (0, "b", "")], "og int, gene string, aligned string")
    for rows in (frame, frame.where("false")):
        assert alignments.columns(rows).count() == alignments.trimmed(rows).count() == alignments.cells(rows).count() == alignments.varied(rows).count() == 0
    assert alignments.stockholm(frame.where("false")).count() == 0


def test_alignment_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/OG1.fa").write_text(">a\nAC-\nD\n>b x\nACCD\n")
    (tmp_path / "in/OG2.fa.gz").write_bytes(gzip.compress(b">c\nA\n"))
    rows = sequences.read_alignments(spark, str(tmp_path / "in"))
    assert sorted(map(tuple, rows.select("og", "gene", "aligned").collect())) == [("OG1", "a", "AC-D"), ("OG1", "b x", "ACCD"), ("OG2", "c", "A")]
    names = spark.createDataFrame([("a", "first")], "gene string, name string")
    assert sorted(r["gene"] for r in alignments.renamed(rows, names).collect()) == ["b x", "c", "first"]
    sinks.write_stockholm(rows, str(tmp_path / "sto"))
    text = read(tmp_path / "sto")
    assert "# STOCKHOLM 1.0\n#=GF AC OG1\na AC-D\nb x ACCD\n//\n" in text and text.count("//") == 2
    (tmp_path / "in/OG3.fa").write_text(">a\nAC\n>b\nA\n")
    with pytest.raises(Exception, match="unequal length in OG3"):
        sequences.read_alignments(spark, str(tmp_path / "in")).collect()


def test_species_of_several_folders_and_record_keys(spark, tmp_path):
    for folder, files in {"x": {"s1.fa": ">p|A1|q one\nMK\n>p|A2 two\nML\n>p|A1|z three\nMM\n", "s2.fa": ">g\nAA\n"}, "y": {"s3.faa": ">plain h\nCC\n"}}.items():
        (tmp_path / folder).mkdir()
        for name, text in files.items():
            (tmp_path / folder / name).write_text(text)
    folders = [str(tmp_path / "x"), str(tmp_path / "y")]
    got = sequences.read_fasta(spark, folders, only=["s1", "s3"])
    assert sorted(map(tuple, got.select("species_id", "species", "residues").collect())) == [(0, "s1", "MK"), (0, "s1", "ML"), (0, "s1", "MM"), (1, "s3", "CC")]
    keys = {how: sorted((r["key"], r["residues"]) for r in sequences.record_keys(got, how).collect()) for how in ("first", "line", "second")}
    assert keys["second"] == [("A1", "MM"), ("A2", "ML")]
    assert keys["first"] == [("plain", "CC"), ("p|A1|q", "MK"), ("p|A1|z", "MM"), ("p|A2", "ML")] and keys["line"][0] == ("plain h", "CC")
    with pytest.raises(ValueError, match="s9"):
        sequences.read_fasta(spark, folders, only=["s1", "s3", "s9"])
    (tmp_path / "y/s1.fa").write_text(">k\nA\n")
    with pytest.raises(ValueError, match="s1"):
        sequences.read_fasta(spark, folders)


def test_hits_of_one_direction(spark, tmp_path):
    lines = ["\t".join([q, h, *["1"] * 8, "1e-5", s]) for q, h, s in (("0_0", "1_0", "9"), ("0_0", "0_0", "20"), ("0_0", "1_7", "3"))]
    (tmp_path / "h.txt.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    both = sequences.both_ways(sequences.read_hits(spark, str(tmp_path / "h.txt.gz")))
    assert sorted((r["q"], r["h"], r["score"]) for r in both.collect()) == [("0_0", "0_0", 20), ("0_0", "1_0", 9), ("0_0", "1_7", 3), ("1_0", "0_0", 9), ("1_7", "0_0", 3)]
    genes = spark.createDataFrame([("0_0",), ("1_0",)], "gene string")
    assert [r["id"] for r in sequences.unknown_ids(both, genes).collect()] == ["1_7"]


def test_group_lists(spark, tmp_path):
    (tmp_path / "N0.tsv").write_text("HOG\tOG\tParent\ts1\ts2\r\nH1\tO1\tn0\ta, b\t\r\nH2\tO1\tn1\t\tc\r\n")
    got = sorted((r["group"], r["species"], r["genes"]) for r in sequences.read_group_lists(spark, str(tmp_path / "N0.tsv")).collect())
    assert got == [("H1", "s1", ["a", "b"]), ("H1", "s2", []), ("H2", "s1", []), ("H2", "s2", ["c"])]


def test_orthoxml_with_species_information(spark, tmp_path):
    (tmp_path / "info.tsv").write_text("s1.fa\tName & one\t9606\tdb\tf1\r\ns2.fa\tTwo\t10090\tdb\tf2\r\nother.fa\tx\t1\td\tf\r\n")
    info = sequences.read_species_info(spark, str(tmp_path / "info.tsv"), ["s1", "s2"])
    members = spark.createDataFrame([(0, "s1", "g<1"), (0, "s2", "h"), (11, "s1", "k")], "og int, sp string, gene string")
    sinks.write_orthoxml(members, str(tmp_path / "xml"), info)
    root = ET.fromstring(read(tmp_path / "xml"))
    at = {"": "{http://orthoXML.org/2011/}"}[""]
    species = {s.get("name"): (s.get("NCBITaxId"), s.find(f"{at}database").get("version"), {g.get("id"): g.get("geneId") for g in s.iter(f"{at}gene")}) for s in root.iter(f"{at}species")}
    assert species == {"Name & one": ("9606", "f1", {"0": "g<1", "1": "k"}), "Two": ("10090", "f2", {"2": "h"})}
    assert [(g.get("id"), [r.get("id") for r in g]) for g in root.iter(f"{at}orthologGroup")] == [("0", ["0", "2"]), ("11", ["1"])]
    with pytest.raises(ValueError, match="s3"):
        sequences.read_species_info(spark, str(tmp_path / "info.tsv"), ["s1", "s3"])
    (tmp_path / "bad.tsv").write_text("s1.fa\tOne\n")
    with pytest.raises(Exception, match="five fields"):
        sequences.read_species_info(spark, str(tmp_path / "bad.tsv"), ["s1"])


@pytest.mark.parametrize("compress", [False, True])
def test_species_tables_split_by_pairs(spark, tmp_path, compress):
    pairs = spark.createDataFrame([(0, "s1", ["a", "b"], "s2", ["x"]), (3, "s1", ["c"], "s2", ["y"]), (3, "s1", ["c"], "s3", ["z"])], "og int, sp_a string, genes_a array<string>, sp_b string, genes_b array<string>")
    sinks.write_species_orthologs(pairs, str(tmp_path / "by"), compress)
    sinks.split_orthologs(spark, str(tmp_path / "by"), str(tmp_path / "pairs"), compress)
    text = lambda p: (gzip.decompress(p.read_bytes()) if compress else p.read_bytes()).decode()
    got = {(p.parent.parent.name[5:], p.parent.name[5:]): text(p) for p in (tmp_path / "pairs").rglob("part-*")}
    assert set(got) == {("s1", "s2"), ("s1", "s3"), ("s2", "s1"), ("s3", "s1")}
    assert got["s1", "s2"] == "Orthogroup\ts1\ts2\r\nOG0000000\ta, b\tx\r\nOG0000003\tc\ty\r\n"


def test_named_and_unassigned_sequences(spark, tmp_path):
    genes = spark.createDataFrame([("a", "s1", "MK"), ("b", "s1", "ML"), ("c", "s2", "MM"), ("d", "s2", "MN"), ("a", "s3", "MP")], "gene string, sp string, seq string")
    members = spark.createDataFrame([(0, "s1", "a"), (0, "s2", "c"), (1, "s1", "b")], "og int, sp string, gene string")
    sinks.write_unassigned_fasta(genes, members, str(tmp_path / "loose"))
    assert read(tmp_path / "loose/sp=s1") == ">b\nML\n" and read(tmp_path / "loose/sp=s2") == ">d\nMN\n" and read(tmp_path / "loose/sp=s3") == ">a\nMP\n"
    names = spark.createDataFrame([("a", "A x"), ("d", "D")], "gene string, name string")
    sinks.write_named_fasta(genes.where("sp <> 's3'"), names, str(tmp_path / "named"), by=None)
    assert read(tmp_path / "named") == ">A x\nMK\n>D\nMN\n"
