"""Joins of texts with few ids don't shuffle the texts; with many they do, with equal rows."""

import pytest

import corpus_pipeline
from cladeforge.llm import common, decontam, lines, linking

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def by_hint_only(spark):
    """Nothing is broadcast for its size alone, as where tables are large."""
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "-1")
    yield
    spark.conf.set(THRESHOLD, before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_decontamination_leaves_texts_where_they_are(spark, tmp_path, monkeypatch, by_hint_only):
    item = " ".join(f"item{k}x" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(k, f"before {item} after" if k % 3 == 0 else f"text {k}", "x", "y", 3) for k in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    found, leaks = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)), decontam.find_leaks(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    few = sorted(r["doc_id"] for r in found.collect())
    assert few == [1, 2, 4, 5, 7, 8]
    assert "SortMergeJoin" not in plan(found) and "LeftSemi" in plan(leaks) and not any("SortMergeJoin" in x and "LeftSemi" in x for x in plan(leaks).split("\n"))
    monkeypatch.setattr(common, "FEW", 0)
    found = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert "SortMergeJoin" in plan(found) and sorted(r["doc_id"] for r in found.collect()) == few


def test_lines_are_fetched_without_shuffling_texts(spark, monkeypatch, by_hint_only):
    base = [f"word{k}" for k in range(30)]
    docs = spark.createDataFrame([(k, " ".join([*base[:k], f"own{k}", *base[k + 1 :]]) + f"\nline of {k}") for k in range(12)], "doc_id long, text string")
    plans, write = [], linking.materialise
    monkeypatch.setattr(linking, "materialise", lambda df, tag: (plans.append(plan(df)) if tag == "bodies" else None) or write(df, tag))
    few = sorted(map(tuple, lines.line_verdicts(docs).collect()))
    assert few and plans and not any("SortMergeJoin" in p for p in plans)
    plans.clear()
    monkeypatch.setattr(lines, "FEW", 0)
    monkeypatch.setattr(common, "FEW", 0)
    assert sorted(map(tuple, lines.line_verdicts(docs).collect())) == few and any("SortMergeJoin" in p for p in plans)
