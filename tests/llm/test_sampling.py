"""Resampling, fill-in-the-middle and language identification against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeforge.llm import fim, langid, queries, resample

COLUMNS = "doc_id long, text string, id string, rank int, n int, form string, score string, lang string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 9, 9, "f", "s", lang) for i, t, lang in rows], COLUMNS)


def plain(spark, rows):
    return docs(spark, [(i, t, "en") for i, t in rows])


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(rows, target, width, buckets, seed, percent, least):
    def grams(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]

    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    s = Counter(bucket(g) for _, t in rows for g in grams(t)[1])
    t = Counter(bucket(g) for x in target for g in grams(x)[1])
    sa, ta = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, text in rows:
        n, g = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * sa / ((s[b] + 1) * ta))) for b in map(bucket, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


@pytest.mark.parametrize("width", [1, 2])
def test_resampling_equals_brute_force(spark, width):
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "éte", "x9", "don't", "日本", "\x00q", "ß-ß"]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 30])))) for k in range(60)]
    rows += [(None, "beta " * 9), (None, None), (61, None), (62, ""), (3, "Alpha beta " * 2000), (7, rows[7][1]), (63, "!!! ..."), (64, "z" * 100000)]
    target = ["beta éte beta", None, "", "Alpha 日本"]
    got = resample.resample(plain(spark, rows), plain(spark, [(k, t) for k, t in enumerate(target)]), width=width, buckets=97, percent=30, min_words=4)
    assert got.columns == ["id", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(tuple, got.collect()))) == brute_resample(rows, target, width, 97, 2024, 30, 4)


def test_resampling_of_empty_tables(spark):
    none = plain(spark, [])
    some = plain(spark, [(1, "a b c " * 9)])
    assert resample.resample(none, some).count() == 0
    assert resample.resample(some, none, percent=100).collect()[0]["rank"] == 1


def test_blocks_are_the_count_matrix(spark):
    rows = [(k, f"a b{k % 3} a") for k in range(25)] + [(25, None)]
    blocks = resample.csr_blocks(plain(spark, rows), buckets=50).collect()
    for b in blocks:
        ends, at, n = np.frombuffer(b["indptr"], np.int64), np.frombuffer(b["indices"], np.int32), np.frombuffer(b["counts"], np.int32)
        for k, i in enumerate(b["ids"]):
            want = Counter(zlib.crc32(w) % 50 for w in resample.fold_words(rows[int(i)][1]))
            assert dict(zip(at[ends[k] : ends[k + 1]].tolist(), n[ends[k] : ends[k + 1]].tolist(), strict=True)) == want
    assert sum(len(b["ids"]) for b in blocks) == len(rows)


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(text, key, seed=42, rate=50, spm=80):
    text = text or ""
    tok = TOKEN.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(tok), "plain", None, None, text
    a, b = sorted((h1 % (len(tok) + 1), h2 % (len(tok) + 1)))
    p, m, s = "".join(tok[:a]), "".join(tok[a:b]), "".join(tok[b:])
    if h4 % 100 < spm:
        return len(tok), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tok), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.text("ab é\t\n\x0b\x85　日<PSM>", max_size=80), st.integers(0, 99), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_cuts_equal_those_of_the_pattern(text, key, size):
    assert fim.transform_text(text, key, 42, 100, 50, size) == brute_fim(text, key, 42, 100, 50)
    chunks, at = fim.Chunks(text.encode(), size), 0
    for k, t in enumerate(TOKEN.findall(text)):
        assert chunks.start(k) == at
        at += len(t.encode())
    assert chunks.start(chunks.n) == at and sum(chunks.counts) == max(chunks.n - 1, 0)


def test_only_owning_chunks_are_searched(monkeypatch):
    chunks, seen = fim.Chunks(b"ab cd " * 1000, 64), []
    monkeypatch.setattr(fim.Chunks, "begins", lambda self, k, f=fim.Chunks.begins: (seen.append(k), f(self, k))[1])
    assert chunks.start(1500) == 1500 * 3 - 1 and seen == [(1500 * 3 - 1) // 64]


def test_middle_table(spark):
    rows = [(k, f"word{k}  and\tmore\n" * (k % 7) + "é日" * (k % 3)) for k in range(80)]
    rows += [(None, "a b c"), (80, None), (81, ""), (82, " \n"), (83, "x <P> y"), (84, "lots of text " * 40000), (84, "lots of text"), (84, "lots of text"), (85, "<S <M <P"), (86, "<" * 50 + " S> M> P>")]
    out = fim.transform(plain(spark, rows), rate=90, chunk=1000)
    got = out.withColumn("back", fim.restored(out["output"], out["form"])).collect()
    want = sorted(repr((i, *brute_fim(t, i, rate=90), t or "")) for i, t in rows)
    assert sorted(repr(tuple(r)) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(plain(spark, [])).count() == 0


NAMES = ["<unk>", "<s>", "▁", "▁a", "a", "b", "ab", "▁ab", "ba", "é", "<", "bab", *(f"<0x{b:02X}>" for b in range(256))]


def segmentations(word, ids):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in ids:
            for rest in segmentations(word[k:], ids):
                yield (ids[word[:k]], *rest)


def brute_ways(pieces, word):
    ids = {p.encode(): k for p, k in ((n, i) for i, n in enumerate(NAMES) if not n.startswith("<") or n == "<")}
    text = b"".join(c.encode() if c.encode() in ids else c.encode() for c in word)
    ways = {()}
    for c, known in ((c, c.encode() in ids) for c in word):
        if not known:
            for b in c.encode():
                ids.setdefault(("raw", b), pieces.bytes[b])
    # characters that aren't pieces stand as their bytes: split there
    out = [()]
    for known, run in itertools.groupby(word, lambda c: c.encode() in ids):
        run = "".join(run)
        got = list(segmentations(run.encode(), {k: v for k, v in ids.items() if isinstance(k, bytes)})) if known else [tuple(pieces.bytes[b] for b in run.encode())]
        out = [a + b for a in out for b in got]
    assert text == word.encode() and ways
    return out


@given(st.lists(st.text("abé日<", min_size=1, max_size=9), min_size=1, max_size=6), st.integers(0, 9))
@settings(max_examples=100, deadline=None)
def test_word_scores_sum_all_segmentations(words, seed):
    pieces = langid.Pieces(NAMES)
    logp = np.log(np.random.default_rng(seed).dirichlet(np.ones(len(NAMES)), 3).T)
    marked = ["▁" + w for w in words]
    got = langid.word_scores(pieces, [w.encode() for w in marked], logp)
    use = np.zeros(len(NAMES))
    for w, row in zip(marked, got, strict=True):
        ways = brute_ways(pieces, w)
        per = np.array([logp[list(x)].sum(axis=0) for x in ways])
        assert np.allclose(row, np.log(np.exp(per).sum(axis=0)))
        share = np.exp(per[:, 0] - row[0])
        for x, s in zip(ways, share, strict=True):
            np.add.at(use, list(x), 2 * s)
    counted = langid.expected(pieces, [w.encode() for w in marked], np.full(len(marked), 2), logp[:, 0]) / langid.PART
    assert np.allclose(counted, use, atol=1e-3)


def test_long_words_are_swept_in_blocks():
    pieces = langid.Pieces(NAMES)
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(len(NAMES)), 2).T)
    word = ("▁" + "ab日baé" * 300).encode()
    whole = langid.word_scores(pieces, [word], logp)[0]
    assert len(word) < langid.WINDOW
    for block in (7, 64, 1000):
        assert np.allclose(langid.long_score(pieces, word, logp, block), whole)
    assert b"".join(langid.parts(word, 50)) == word and all(p.decode() for p in langid.parts(word, 50))


def test_languages(spark):
    rng = random.Random(2)
    words = {"en": "the of and house water that with from".split(), "de": "der und nicht haus wasser daß über von".split(), "ja": ["日本語の文章", "これは水です", "家があります"]}
    rows = [(k, " ".join(rng.choices(words[x], k=12)), x) for k, x in enumerate(rng.choices(sorted(words), k=400))]
    learnt = docs(spark, rows + [(None, "und nicht", "en"), (1000, None, "fr"), (1001, "the", None)])
    model = langid.train(learnt)
    assert model.languages == ["de", "en", "ja"]
    odd = [(500, None, "en"), (501, "", "en"), (502, "123 !? ½", "en"), (None, "the house", "xx"), (503, "über das", "en"), (503, "über das", "en"), (504, "家があります" * 3000, None)]
    judged = docs(spark, rows + odd)
    got = langid.predict(judged, model).collect()
    by = {r["id"]: r for r in got}
    held = {r["doc_id"] for r in judged.where(langid.held_out("doc_id")).collect()}
    assert held == {i for i, *_ in rows + odd if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    right = [by[i]["lang_pred"] == x for i, _, x in rows if i in held]
    assert len(right) > 50 and all(right)
    assert [by[k]["lang_pred"] for k in (500, 501, 502, None, 503, 504)] == ["und", "und", "und", "en", "de", "ja"]
    assert by[500]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows) + len(odd)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["id"] == 503}) == 1
    again = langid.train(learnt.repartition(7))
    assert again.languages == model.languages and np.array_equal(again.logp, model.logp)


def test_languages_of_empty_tables(spark):
    model = langid.train(docs(spark, []))
    assert model.languages == [] and langid.predict(docs(spark, []), model).count() == 0
    assert [tuple(r) for r in langid.predict(docs(spark, [(1, "a", "en")]), model).collect()] == [(1, "und", 0.0)]


@pytest.mark.parametrize("name", ["op11_resampling", "op12_fim", "op13_langid"])
def test_queries_on_tables_with_odd_rows(spark, tmp_path, name):
    rows = [(None, None, None), (None, "a b", "en"), (1, "", "en"), (2, "the house " * 30, "en"), (2, "the house " * 30, "en"), (3, "der wald " * 30, "de")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs(spark, []).select("doc_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, *_ in rows)
