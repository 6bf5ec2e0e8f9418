"""The other corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
from base64 import b32encode

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeforge.llm import decontam, lm, quality, rules, spm, tokens, urls, warc

VOC, RANKS = spm.tokenizer_path(), spm.tokenizer_path("byte_bpe_50k.tiktoken")
TEXTS = ["", " ", "a", "Hello  world", "▁x ▁▁ y", "tabs\tand\nlines\n\n", "日本語 ﬁ é", "x" * 3000, "word, word. (word) 'tis 5km!!", "\u0000\x01", "  lead and trail  ", "\U0010fffd▁"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, id string, ids int")


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_pieces_decode_to_the_text(text):
    for enc in (spm.encoder(VOC, 0.3, 5, 2), spm.encoder(VOC, 0.0, 0, 1)):
        assert spm.decode(VOC, enc.encode(text, 3)) == text


@pytest.mark.parametrize("text", [t for t in TEXTS if "▁" not in t])
def test_without_dropout_ids_are_the_librarys(text):
    assert spm.encoder(VOC, 0.0, 0, 1).encode(text) == sentencepiece.SentencePieceProcessor(model_file=VOC).encode(text)


def test_dropout_is_seeded_and_both_agendas_agree():
    a, b = spm.Encoder(VOC, 0.2, 1), spm.Encoder(VOC, 0.2, 2)
    text = "internationalisation of the neighbourhood " * 5
    assert a.encode(text, 1) == spm.Encoder(VOC, 0.2, 1).encode(text, 1) != b.encode(text, 1)
    assert len(a.encode(text, 1)) > len(spm.Encoder(VOC).encode(text))
    for k in range(50):
        assert a.merged(text[:38], k) == a.merged_short(text[:38], k)


def test_encoding_tables(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (50, None), (1, " "), (1, " ")]
    enc = spm.encode_documents(docs(spark, rows), VOC)
    got = spm.decode_documents(enc, VOC, ["id", "text"]).collect()
    assert len(got) == len(rows) and all(r["text"] == r["decoded"] for r in got)
    assert spm.encode_documents(docs(spark, []), VOC).count() == 0


def apply(text, edits):
    for at, removed, added in edits:
        at = max(0, min(at, len(text)))
        text = text[:at] + added + text[at + max(0, min(removed, len(text) - at)) :]
    return text


@given(st.text("ab '’re1 .\n\té", max_size=300), st.lists(st.tuples(st.integers(-2, 320), st.integers(-1, 40), st.text("ab 're1\n ", max_size=9)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_edited_counts_equal_counts_from_scratch(text, edits):
    table = tokens.counts(RANKS)
    tree = tokens.CountTree(text, table)
    assert tree.tokens == len(table.encode(text))
    for e in edits:
        tree.edit(*e)
    assert tree.text == apply(text, edits) and tree.tokens == len(table.encode(tree.text))
    assert sum(int(x[0].sum()) for x in tree.leaves) == len(tree.text)


def test_token_table(spark):
    d = docs(spark, [(1, "some words here " * 400), (2, None), (None, ""), (3, "x")])
    d = d.withColumn("edits", tokens.keyed_edits())
    got = {r["id"]: r for r in tokens.count_edited(d, RANKS).collect()}
    assert got[2]["n_tokens"] == 0 and got[1]["n_reencoded"] < 100 < got[1]["n_pretokens"]


def judge_one(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


def test_url_verdicts_equal_brute_force(spark):
    cases = ["http://a.example.com/en/7", "https://EXAMPLE.com/en/70?x#y", "ftp://com/en/", "http://xcom/en/", "http://a.net/de/8", "http://example.net/de/8", "http://a.b.org/es/#f", "no url", "", None, "http://é.com/en/é", "://com/en/", "http://com?/en/", "http://a.com:80/en/", "a://b://com/en/", "http://x.com\n.com/en/", "http://.com/en/"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(cases)] + [(0, cases[0], "h", "r")], "page_id long, url string, host string, rule string")
    got = urls.judge(pages, urls.rule_table(spark), keep=["page_id"]).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge_one(cases[r["page_id"]]), cases[r["page_id"]]
    assert urls.judge(pages.limit(0), urls.rule_table(spark)).count() == 0


#: The rules as the contract lists them, and what it says of urls under them.
CONTRACT = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def test_url_rules_are_the_contract_s(spark):
    assert urls.RULES == CONTRACT
    want = {"http://a.net/de/8": "allow", "http://m.example.net/de/81": "block", "http://example.net/de/7": "allow", "http://example.com/en/7": "allow", "http://a.com/en/7": "block", "http://x.org/es/": "block"}
    got = urls.judge(spark.createDataFrame([(u,) for u in want], "url string"), urls.rule_table(spark), keep=["url"], default="none").collect()
    assert {r["url"]: r["verdict"] for r in got} == want


WARCS = ["", None, "<p>a</p>", "<p>a</p>", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "\r\n\r\nWARC/1.", "é\n\r\n", "end\r\n\r\n", "WARC/1.1"]


def test_warc_round_trip(spark):
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate(WARCS)] + [(None, None, "<p>a</p>"), (20, "u v", "big" * 50000), (21, "u", "big" * 50000), (2, "http://h/2", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_back(warc.write_archives(pages)).collect()
    last = {}
    for k, _, t in rows:
        last[t or ""] = max(last.get(t or "", -1), -1 if k is None else k)
    want = []
    for k, _, t in rows:
        b = (t or "").encode()
        visit = k != last[t or ""]
        want.append((k, len(b), b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if visit else "response", last[t or ""] if visit else None))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert warc.read_back(warc.write_archives(pages.limit(0)), spark).count() == 0


def brute_base(text):
    t = text or ""
    w = t.encode().split()
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_rules_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("ab cé d# e\n f".split(" ")) for _ in range(n))) for k, n in enumerate([0, 3, 9, 10, 11, 40, 200])]
    rows += [(20, None), (21, "Clean words make a sentence here, and then it ends.\n" * 3), (22, "a | b | c | d | e | f | g | h | i | j | k | l"), (23, "A fine line that has its words in order and a stop.\nHome | About | Contact | Log in")]
    got = {r["id"]: r for r in rules.judge(docs(spark, rows)).collect()}
    for k, t in rows:
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_base(t), t
        assert not (r["base_failed"] and r["kept"])
    assert not got[22]["kept"] and got[23]["kept"] and got[23]["n_lines_removed"] == 1
    assert rules.judge(docs(spark, [])).count() == 0


def test_quality_held_out_accuracy_and_edges(spark):
    sf = "/root/testdata/sf0.01"
    d, y = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(d, y)
    got = quality.score(d, model).select("doc_id", "score", quality.held_out("doc_id").alias("h")).join(y, "doc_id").where("h").collect()
    good, bad = [r["score"] for r in got if r["quality"]], [r["score"] for r in got if not r["quality"]]
    assert np.mean([a > b for a in good for b in bad]) > 0.8
    edge = quality.score(docs(spark, [(1, None), (2, ""), (None, "x")]), model).collect()
    assert len(edge) == 3 and all(0 <= r["score"] <= 1 for r in edge)
    assert quality.train(d, y.limit(0)) is None


def test_lm_prefers_what_it_has_seen(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(w for _ in range(60) for w in ("the", rng.choice(["cat", "dog"]), "sat", "down"))) for k in range(30)]
    rows += [(100, " ".join(rng.sample("the cat sat down dog the the down".split() * 20, 160))), (101, None), (102, " "), (None, "the cat")]
    net = lm.train(docs(spark, rows))
    got = {r["id"]: r for r in lm.score(docs(spark, rows), net).collect()}
    assert got[0]["mean_log_prob"] > got[100]["mean_log_prob"] and got[0]["n_tokens"] == 240
    assert got[101]["mean_log_prob"] is None and got[102]["log_prob"] == 0 and len(got) == len(rows)
    assert lm.train(docs(spark, [])) is None


def test_leaks_by_template(spark):
    item = "If Anna buys 12 apples and gives Anna's friend 5 of them, how many apples does she keep for the long trip home tomorrow"
    other = "if Berta buys 40 apples and gives Berta's friend 7 of them, how many apples does she keep for the long trip home tomorrow"
    mixed = "if Berta buys 40 apples and gives Carla's friend 7 of them, how many apples does she keep for the long trip home tomorrow"
    filler = " ".join(f"filler{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    rows = [(1, f"{filler} so {item} {filler}"), (2, f"so {other}"), (3, filler), (4, None), (5, ""), (None, item), (6, "short words here now"), (1, f"{filler} so {item} {filler}"), (7, "apples and gives a friend")]
    bench = spark.createDataFrame([(1, item, 3), (2, "short words here", 3), (3, None, 3), (None, item, 3), (4, "", 3)], "item_id long, text string, id int")
    got = {(r["id"], r["item_id"]) for r in decontam.find_leaks(docs(spark, rows), bench).collect()}
    assert got == {(1, 1), (2, 1), (6, 2)}
    assert mixed != other and decontam.find_leaks(docs(spark, []), bench).count() == 0


def test_leaks_wherever_the_runs_start(spark):
    item = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(18))
    rows = []
    for gap in (9, 10):  # runs of 8 and 9 words between edits
        for off in range(8):
            w = [x if (k + 1) % gap else f"zz{chr(97 + k)}" for k, x in enumerate(item.split())]
            rows.append((100 * gap + off, " ".join([f"pre{chr(97 + k)}" for k in range(off)] + w)))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["id"] for r in decontam.find_leaks(docs(spark, rows), bench).collect()} == {i for i, _ in rows}


def brute_leaks(doc, item, width=8, min_run=13, min_share=0.5):
    """(matched, run, item_words, n_slots) of the best alignment of two lists of (template word, word), all alignments tried; None where none counts."""
    best = None
    for shift in range(-len(item), len(doc)):
        at = [(k, k + shift) for k in range(len(item)) if 0 <= k + shift < len(doc)]
        same = {k for k, j in at if item[k][0] == doc[j][0]}
        blocks = [range(k, k + min(width, len(item))) for k in range(len(item) - min(width, len(item)) + 1)]
        if not any(all(k in same for k in b) and (any(item[k][0][0] != "‹" for k in b) or all(item[k] == doc[k + shift] for k in b)) for b in blocks):
            continue
        slots = [(k, item[k][1], doc[k + shift][1]) for k in sorted(same) if "‹" in item[k][1]]
        matched = len(same) - len(slots) + sum(max(sum(1 for _, i, d in slots if (i, d) == (v, e)) for e in {d for _, i, d in slots if i == v}) for v in {i for _, i, _ in slots})
        run = start = 0
        for k in range(len(item)):
            if k not in same:
                start = k + 1
            elif "‹" in item[k][1]:
                start = max([start, *(j + 1 for j, i, d in slots if j < k and i == item[k][1] and d != doc[k + shift][1])])
            run = max(run, k + 1 - start)
        if run >= min_run or matched >= min_share * len(item):
            best = max(best or (0,), (matched, run, len(item), len({(i, d) for _, i, d in slots})))
    return best


def test_leaks_equal_brute_force(spark):
    rng = random.Random(12)
    vocabulary = ["has", "then", "gave", "the", "box", "of", "with", "some", "7", "12", "12", "40", "Anna", "Bob", "Carl"]
    items = [" ".join(["so", *rng.choices(vocabulary, k=rng.choice([4, 7, 12, 25]))]) for _ in range(12)] + ["1 2 3 4 5 6 7 8 9 10 11 12"]
    rows = []
    for k in range(60):
        words = rng.choice(items).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)) + words + rng.choices(vocabulary, k=rng.randint(0, 9)))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["id"], r["item_id"]): (r["matched"], r["run"], r["item_words"], r["n_slots"]) for r in decontam.find_leaks(docs(spark, rows), bench).collect()}
    both = docs(spark, rows).selectExpr("doc_id as id", "text").unionByName(bench.selectExpr("item_id + 1000 as id", "text"))
    full = decontam.split_words(decontam.full_template(both["text"]))
    texts = {r["id"]: list(zip(r["t"], r["f"], strict=True)) for r in both.select("id", full.alias("f")).select("id", "f", decontam.F.transform("f", decontam.template).alias("t")).collect()}
    want = {(i, k): brute_leaks(texts[i], texts[1000 + k]) for i, _ in rows for k in range(len(items))}
    assert got == {p: b for p, b in want.items() if b is not None} and len(got) > 20


def test_leaks_of_number_tables_and_tiny_items(spark):
    table = " ".join(str(7 * k % 1000) for k in range(1500))
    items = [(1, " ".join(str(13 * k % 1000) for k in range(100))), (2, table[200:900]), (3, "the"), (4, " ".join(["0"] * 100))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, table), (2, "the word the and the"), (3, " ".join(["0"] * 300))]
    got = {(r["id"], r["item_id"]) for r in decontam.find_leaks(docs(spark, rows), bench).collect()}
    assert got == {(1, 2), (3, 4)}


def test_leaks_slots_reject_only_what_they_break(spark):
    item = "A farmer sold 12 crates of apples and 15 crates of pears at the local market, then drove home with Anna and paid Anna 40 dollars for all the help she gave"
    start = " ".join(item.split()[:22])
    merged = item.replace("12 crates", "20 crates").replace("15 crates", "20 crates")
    names = "we saw that Anna met Anna when Anna met Anna while Anna met Anna as Anna met Anna again"
    split = "we saw that Bob met Carl when Dora met Emil while Fred met Gina as Hugo met Ines again"
    rows = [(1, f"{start} met Bob 12 times after that"), (2, merged), (3, item), (4, split), (5, names)]
    bench = spark.createDataFrame([(1, item), (2, names)], "item_id long, text string")
    got = {(r["id"], r["item_id"]): (r["matched"], r["run"]) for r in decontam.find_leaks(docs(spark, rows), bench).collect()}
    n, m = len(item.split()), len(names.split())
    assert got[1, 1][1] >= 13 and got[2, 1] == got[3, 1] and got[3, 1][0] >= n and got[5, 2] == (m, m)
    # each Anna is another name: 8 words in a row at most, 10 + 1 of 18 words
    assert got.keys() - {(4, 2)} == {(1, 1), (2, 1), (3, 1), (5, 2)} and got.get((4, 2), (0, 0))[1] < 13


def test_dropout_is_drawn_for_every_occurrence():
    """Shares of a word's segmentations over its occurrences are those of independent skips, within and across documents."""
    word, rate, n = "▁internationalisation", 0.1, 4000
    rng, enc = random.Random(4), spm.Encoder(VOC, rate, 1)

    def one():
        bits = sum((rng.random() < rate) << k for k in range(3 * len(word)))
        return tuple(enc.merged_short(word, bits)[0])

    def seen(ids):
        found, now = [], []
        for i in ids:
            p = enc.voc.pieces[i]
            if p.startswith("▁") and now:
                found.append(tuple(now))
                now = []
            now.append(p)
        return [*found, tuple(now)]

    def shares(xs):
        return {x: xs.count(x) / len(xs) for x in set(xs)}

    want = shares([one() for _ in range(n)])
    text = " ".join([word[1:]] * n)
    across = [seen(enc.encode(word[1:], k))[0] for k in range(n)]
    for got in (shares(seen(enc.encode(text, 7))), shares(across), shares(seen(spm.Encoder(VOC, rate, 1, 1).encode(text, 8)))):
        assert len(got) > 20 and sum(abs(got.get(x, 0) - want.get(x, 0)) for x in got.keys() | want.keys()) < 0.35
        assert all(abs(got.get(x, 0) - want[x]) < 0.04 for x in want)
    assert enc.encode(text, 7) == spm.Encoder(VOC, rate, 1, 1).encode(text, 7) != enc.encode(text, 8)


def test_lm_tells_words_of_one_class_apart_by_context(spark):
    """Two words of one class, equally frequent: swapping them must cost, which only context can tell."""
    hashes = lm.WordHashes(21)
    first = {}
    for k in range(100000):
        b = int(lm.buckets(f"w{k}", hashes)[0])
        a = first.setdefault(b % lm.CLASSES, (b, f"w{k}"))
        if a[0] != b:
            x, y = a[1], f"w{k}"
            break
    lefts = [f"left{k}" for k in range(2)]
    train = [(k, " ".join(f"{lefts[0]} {x} end {lefts[1]} {y} end" for _ in range(100))) for k in range(60)]
    net = lm.train(docs(spark, train))
    test = [(1, f"{lefts[0]} {x} end {lefts[1]} {y} end"), (2, f"{lefts[0]} {y} end {lefts[1]} {x} end")]
    got = {r["id"]: r["log_prob"] for r in lm.score(docs(spark, test), net).collect()}
    around, target = lm.positions([lm.buckets(test[0][1], hashes)])
    swapped = target.copy()
    swapped[[1, 4]] = target[[4, 1]]
    assert got[1] > got[2]
    # the same contexts, only the words scored are swapped
    assert net.log_prob(around, target, net.prior()) > net.log_prob(around, swapped, net.prior()) + 1


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_text_decodes_to_itself_with_dropout(text):
    path = spm.tokenizer_path()
    enc = spm.encoder(path, 0.3, 5)
    for t in (text, text + "\0﷐" + spm.SPACE, spm.SPACE + " " + text):
        assert spm.decode(path, enc.encode(t, 3)) == t


def test_an_occurrence_draws_its_own_skips():
    path = spm.tokenizer_path()
    enc = spm.Encoder(path, 0.3, 1)
    assert len({tuple(enc.encode("international", k)) for k in range(300)}) > 20


def test_ftrl_equals_a_plain_version():
    """One weight at a time, as in the paper."""
    rng = np.random.default_rng(0)
    examples = [(np.unique(rng.integers(0, 16, 5)), None, int(rng.random() < 0.5)) for _ in range(40)]
    examples = [(at, rng.random(len(at)), y) for at, _, y in examples]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.2
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - l1 * np.sign(z[i])) / ((beta + n[i] ** 0.5) / alpha + l2)

    for turn in range(4):
        for k in np.random.default_rng(turn).permutation(len(examples)):
            at, v, y = examples[k]
            rows = [*zip(at.tolist(), v.tolist(), strict=True), (16, 1.0)]
            p = 1 / (1 + np.exp(-sum(weight(i) * x for i, x in rows)))
            for i, x in rows:
                g = (p - y) * x
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * weight(i)
                n[i] += g * g
    assert np.allclose(quality.fit(examples, bits=4), [weight(i) for i in range(17)], atol=1e-6)


def test_quality_with_clashing_columns(spark):
    d = docs(spark, [(k, f"some words of text {k}") for k in range(1, 40)]).selectExpr("doc_id", "text", "1 as y", "2 as k", "3 as id", "'a' as v")
    y = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, quality int")
    assert quality.train(d, y) is not None
    assert quality.score(d, None).columns == [*d.columns, "score"]


@given(st.lists(st.text(alphabet="abcinot é日▁\n", max_size=40), max_size=6), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
@settings(max_examples=80, deadline=None)
def test_matrices_equal_the_agenda_of_one_unit(texts, rate):
    """Ids of many texts at once are those of the agenda of every unit alone under the same draws."""
    enc = spm.Encoder(VOC, rate, 9)
    flat, ends = enc.encode_many(texts, list(range(len(texts))))
    for k, text in enumerate(texts):
        units, mark = enc.units(text) if text else ([], "")
        want = []
        for place, unit in enumerate(units):
            start = (place + xxhash.xxh64_intdigest(b"%d" % k, 9)) * spm.SPREAD_PLACE & spm.M64
            want += enc.unmemoised(unit, spm.mixed(start), mark) if rate else enc.merge(unit, 0, mark)[0]
        assert flat[ends[k] : ends[k + 1]].tolist() == want
