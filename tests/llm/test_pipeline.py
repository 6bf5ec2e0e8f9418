"""The pipeline's stages against plain Python, each on its own input, and the whole of it."""

import random

import corpus_pipeline
from cladeforge.llm import quality, spm
from test_groups import brute_lines, brute_minhash, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def test_quality_stage_keeps_scores_from_the_bar_on(spark, tmp_path):
    rows = [(k, " ".join(words(40, f"g{k}")) + "." if k % 2 else "BUY >> NOW || " * 8) for k in range(1, 60)] + [(None, "no id"), (70, None), (71, "")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = STAGES["quality"](spark, docs, str(tmp_path))
    scores = quality.score(docs, quality.train(docs, labels)).collect()
    assert ids(got) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in scores if r["score"] >= 0.3)
    assert all(k % 2 for n, k in ids(got) if not n and k < 60) and got.columns == docs.columns


def test_lines_stage_equals_brute_force(spark):
    base = words(30, "p")
    rows = [(1, " ".join(base) + "\nown line of one"), (2, " ".join(base[:10] + ["other"] + base[11:]) + "\nquite another line"), (3, " ".join(base)), (4, ""), (5, None), (6, "***"), (None, " ".join(base))]
    gone = brute_lines(rows)
    want = {}
    for i, t in rows:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if kept == t or (kept or "").strip():
            want[i] = kept
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in STAGES["lines"](spark, frame(spark, rows), "").collect()}
    assert {k: v[0] for k, v in got.items()} == want and 3 not in got
    assert all(n == (len(t) if t is not None else None) for t, n in got.values())


def test_near_duplicates_stage_equals_brute_force(spark):
    rng, base = random.Random(1), words(100, "n")
    rows = [(k, " ".join(w if rng.random() > 0.01 else "x%d" % rng.randrange(99) for w in base)) for k in range(20)]
    rows += [(50, "a b"), (51, "a b"), (52, None), (53, ""), (50, "a b"), (None, "a b"), (None, "a b")]
    groups = brute_minhash([(i, t) for i, t in rows if i is not None], 5, 80)
    want = sorted([(False, i) for i, (_, c) in groups.items() if i == c] + [(True, 0)] * 2)
    assert ids(STAGES["near_duplicates"](spark, frame(spark, rows), "")) == want


def test_decontamination_and_encoding_stages(spark, tmp_path):
    item = words(24, "item")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, " ".join(words(50, "a") + item + words(9, "b"))), (2, " ".join(words(60, "c"))), (None, " ".join(item)), (None, "clean"), (3, None), (4, "")]
    kept = STAGES["decontamination"](spark, frame(spark, rows), str(tmp_path))
    assert ids(kept) == [(False, 2), (False, 3), (False, 4), (True, 0)]
    path = spm.tokenizer_path()
    got = STAGES["encoding"](spark, kept, "").collect()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(r["lossless"] and spm.decode(path, r["ids"]) == texts[r["doc_id"]] for r in got) and len(got) == 4


def test_the_whole_on_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
