"""Kernels of trees work on each text, or shape, once; counts of pieces hold no genes."""

import random
from collections import Counter

from pyspark.sql import functions as F

from cladeforge.functions import rooting
from cladeforge.operators import genetrees, similarity

SIX = "((A:1,B:1):1,((C:1,D:1):1,(E:1,F:1):1):1);"


def test_equal_texts_are_worked_on_once(spark):
    trees = spark.createDataFrame([(k, "(A|1:1,(A|2:1,B|3:1):1);" if k % 2 else "(A|1:1,B|2:1);") for k in range(40)] + [(40, None), (41, "(A|1")], "og long, newick string")
    sent = []

    def kernel(texts):
        sent.extend(r["newick"] for r in texts.collect())
        return texts.selectExpr("og", "newick as text")

    got = {r["og"]: r["text"] for r in genetrees.each_text_once(trees, kernel).collect()}
    assert got == {r["og"]: r["newick"] for r in trees.collect()}
    assert len(sent) == 4
    rows = Counter((r["og"], r["kind"]) for r in genetrees.reconciled(trees, "(A:1,B:1);").collect())
    assert rows[40, "unreadable"] == rows[41, "unreadable"] == 1 and all(rows[k, "ortholog"] for k in range(40))
    names = spark.createDataFrame([("A|1", "x"), ("B|2", "y")], "gene string, name string")
    new = {r["og"]: r["newick"] for r in genetrees.renamed(trees, names).collect()}
    assert new[0] == "(x:1,y:1);" and len(new) == 40


def test_rows_of_a_text_do_not_carry_it(spark):
    text = "(" + ",".join(f"A|{k}:1" for k in range(3000)) + ");"
    trees = spark.createDataFrame([(1, text), (2, text), (3, "")], "og long, newick string")
    keys = []

    def kernel(texts):
        keys.extend(r["og"] for r in texts.collect())
        return texts.selectExpr("og", "length(newick) as n")

    got = {r["og"]: r["n"] for r in genetrees.each_text_once(trees, kernel).collect()}
    assert got == {1: len(text), 2: len(text), 3: 0} and max(map(len, keys)) <= 32


def test_few_texts_are_dealt_to_several_tasks(spark):
    trees = spark.createDataFrame([(k, f"(A|{k}:1,B|1:1);") for k in range(40)], "og long, newick string")
    at = []

    def kernel(texts):
        at.extend(r[0] for r in texts.select(F.spark_partition_id(), "newick").collect())
        return texts.selectExpr("og", "newick as text")

    assert genetrees.each_text_once(trees, kernel).count() == 40 and len(at) == 40 and len(set(at)) > 1


def test_supported_duplications_of_numbered_leaves_have_their_own_names(spark):
    texts = {k: f"(A|1-{k},B|1-{k},(((C|1-{k},D|1-{k}),(E|1-{k},F|1-{k})),((C|2-{k},D|2-{k}),(E|2-{k},F|2-{k}))));" for k in range(5)}
    texts[5] = "('A|x y',B|1,(((C|1,D|1),(E|1,F|1)),((C|2,D|2),(E|2,F|2))));"
    texts[6] = "((A|1,A|2),B|1,C|1);"
    got = {r["og"]: (r["species"], r["genes"]) for r in genetrees.supported_duplications(spark.createDataFrame(list(texts.items()), "og long, newick string"), SIX).collect()}
    for k in range(5):
        assert got[k] == (list("CDEF"), sorted(f"{s}|{n}-{k}" for s in "CDEF" for n in (1, 2)))
    assert got[5] == (list("CDEF"), sorted(f"{s}|{n}" for s in "CDEF" for n in (1, 2)))
    assert got[6] == (["A"], None)


def test_a_shape_is_worked_on_once(spark, monkeypatch):
    calls, plain = [], rooting.supported_duplications
    monkeypatch.setattr(rooting, "supported_duplications", lambda *a: calls.append(1) or plain(*a))
    run = {}

    class Trees:
        dtypes = [("og", "bigint")]

        def mapInPandas(self, f, schema):
            run["f"] = f

    genetrees.supported_duplications(Trees(), SIX)
    import pandas as pd

    list(run["f"]([pd.DataFrame({"og": range(50), "newick": [f"((A|{k},A|0{k}),B|{k},C|{k});" for k in range(50)]})]))
    assert len(calls) == 1


def test_counts_of_pieces(spark):
    rows = [(1, "abab"), (1, "abab"), (1, "xab"), (2, "ab"), (None, "abc"), (3, None), (4, "a")]
    got = {r["kmer"]: (r["n"], r["n_genes"]) for r in similarity.piece_counts(spark.createDataFrame(rows, "gene long, seq string"), 2).collect()}
    assert got == {"ab": (7, 2), "ba": (2, 1), "xa": (1, 1), "bc": (1, 0)}


def test_overlap_join_writes_shared_pieces_alone(spark, monkeypatch):
    """Against all pairs, with families of near copies; of what is written nothing is as long as the texts."""
    rng = random.Random(3)
    sets = {}
    for g in range(12):
        base = {rng.randrange(10**9) for _ in range(120)}
        for m in range(4):
            sets[4 * g + m] = set(rng.sample(sorted(base), rng.choice((20, 60, 110)))) | {rng.randrange(10**9) for _ in range(rng.choice((0, 30, 200)))} | set(range(rng.choice((0, 5, 25))))
    written, plain = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df: written.append(plain(df)) or written[-1])
    idx = spark.createDataFrame([(p, g, len(s)) for g, s in sets.items() for p in s], "piece long, gene long, n_pieces int")
    for least in (0.1, 0.5):
        want = {(q, h): len(a & b) / len(a | b) for q, a in sets.items() for h, b in sets.items() if q != h and len(a & b) >= least * len(a | b) and a & b}
        assert {(r["q"], r["h"]): r["score"] for r in similarity.jaccard_join(idx, least).collect()} == want
    shared = sum(n for n in Counter(p for s in sets.values() for p in s).values() if n > 1)
    assert max(t.count() for t in written) <= shared < idx.count()


def test_overlap_join_lets_classes_of_copies_meet(spark, monkeypatch):
    """Against all pairs; genes of the same shared pieces are one in the join, also where a class is dealt by shares and sizes differ."""
    rng = random.Random(9)
    base, sets = rng.sample(range(10**6), 60), {}
    for g in range(120):
        sets[g] = set(base[10 * (g % 4) : 10 * (g % 4) + 30]) | {10**7 + 1000 * g + k for k in range((0, 3, 400)[g % 3])}
    written, plain = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df: written.append(plain(df)) or written[-1])
    if hasattr(similarity, "SHARE"):
        monkeypatch.setattr(similarity, "SHARE", 7)
    idx = spark.createDataFrame([(p, g, len(s)) for g, s in sets.items() for p in s], "piece long, gene long, n_pieces int")
    want = {(q, h): len(a & b) / len(a | b) for q, a in sets.items() for h, b in sets.items() if q != h and len(a & b) >= 0.1 * len(a | b)}
    got = [(r["q"], r["h"], r["score"]) for r in similarity.jaccard_join(idx, 0.1).collect()]
    assert {(q, h): x for q, h, x in got} == want and len(got) == len(want)
    head = written[-2]
    assert sum(n * n for n in Counter(r[0] for r in head.collect()).values()) < len(sets)


def test_parsimony_counts_sets_of_species_not_ids(spark):
    """Against brute force; lines are shuffled once, by id, and species' sets after that."""
    from cladeforge.operators import results

    rng = random.Random(5)
    seen = {k: (rng.randrange(1, 9), set(rng.sample(range(5), rng.randrange(1, 4)))) for k in range(60)}
    clades = {"c1": {0}, "c2": {0, 1}, "c3": {2, 3}, "c4": {7}}
    observed = spark.createDataFrame([(k, n, s) for k, (n, ss) in seen.items() for s in ss], "id long, n long, species long")
    table = spark.createDataFrame([(c, s) for c, ss in clades.items() for s in ss if c != "c4"], "clade string, species long")
    against = {c: sum(n for n, s in seen.values() if s & ss and s - ss) for c, ss in clades.items() if c != "c4"}
    found = results.parsimony_roots(table, observed)
    assert {(r["clade"], r["against"]) for r in found.collect()} == {(c, n) for c, n in against.items() if n == min(against.values())}
    assert "[clade#" not in "".join(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line and ", id#" in line)
