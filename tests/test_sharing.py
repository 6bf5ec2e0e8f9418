"""Genes that share an ortholog, and representatives by pieces: what is joined and what isn't."""

from cladeforge.operators import profiles, results


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_coorthologs_meet_once_and_both_ways_are_given(spark):
    rows = [(1, 7), (2, 7), (2, 7), (3, 7), (3, 8), (None, 8), (4, None), (5, 9)]
    found = results.coorthologs(spark.createDataFrame(rows, "a long, b long"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, c) for a, b in rows for c, d in rows if b == d and b is not None}
    assert any("Join" in s and "<" in s for s in plan(found).split("\n"))


def test_representatives_are_not_dealt_by_common_pieces(spark):
    """A bucket that most of a cluster has would gather most of its rows in one task."""
    genes = spark.createDataFrame([(k, "abcde" + "xyz"[k % 3] * 3) for k in range(12)], "gene long, seq string")
    found = profiles.from_pieces(genes, 3)
    assert found.count() <= 3 and "LeftSemi" not in plan(found)
