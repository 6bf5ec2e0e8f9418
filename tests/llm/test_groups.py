"""op1 and op10 against brute force, and their edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from cladeforge.llm import lines, linking, minhash

SCHEMA = "doc_id long, text string, rep string, label int, key int, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_minhash(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(ids, links).items()}


def words(n, salt=""):
    return [hashlib.md5(f"{salt}{i}".encode()).hexdigest()[: 3 + i % 5] for i in range(n)]


def near_rows():
    base = words(120)
    rows = [(0, " ".join(base)), (1, " ".join(base).upper()), (2, "  ".join(base) + "\n")]
    rows += [(1000 + k, " ".join(base[:k] + ["zz%d" % k] + base[k + 1 :])) for k in range(0, 120, 5)]  # one word off
    rows += [(2000 + k, " ".join(w if (j + k) % 11 else "q%d_%d" % (j, k) for j, w in enumerate(base))) for k in range(11)]  # far from each other
    rows += [(100, ""), (101, None), (102, " \t\n"), (103, "one"), (104, "ONE"), (105, "one two"), (106, "one two"), (200, " ".join(words(20000, "long")))]
    rows += [(201, " ".join(words(19990, "long")))]
    return rows


@pytest.mark.parametrize("width,percent,rows_", [(3, 85, 8), (5, 80, 6)])
def test_near_duplicates_equal_brute_force(spark, width, percent, rows_):
    rows = near_rows()
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows), width=width, percent=percent, rows=rows_).collect()}
    assert got == brute_minhash(rows, width, percent)


def test_a_large_group_goes_through_stars_and_families(spark, monkeypatch):
    """300 copies of one text with edits about the threshold: groups equal brute force, and the pairs verified are few."""
    rng, base, rows = random.Random(3), words(90, "big"), []
    for i in range(300):
        new = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            new[rng.randrange(len(new))] = "e%d" % rng.randrange(40)
        rows.append((i, " ".join(new)))
    tested = []
    verified = minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *a: tested.append(pairs.count()) or verified(pairs, *a))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows), width=3, percent=85, rows=8).collect()}
    assert got == brute_minhash(rows, 3, 85)
    assert sum(tested) < 300 * 299 / 8


def test_near_duplicates_null_ids_repeated_rows_empty_table(spark):
    t = " ".join(words(30))
    got = minhash.near_duplicates(frame(spark, [(None, t), (7, t), (7, t), (9, t), (None, None)]), width=3, percent=85, rows=8).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["component_id"], r["kept"]) for r in got if r["component_id"] is not None) == [(False, 7, 7, True), (False, 7, 7, True), (False, 9, 7, False)]
    assert [r["kept"] for r in got if r["id"] is None] == [True, True]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    got = {r["id"]: r["label"] for r in linking.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(list(range(41)) + list(range(100, 160)), edges)
    assert got == {k: v for k, v in want.items() if k != v}


def norm(line):
    return re.sub(r"[^\w]|_", " ", re.sub(r"[1-9]", "0", line.lower())).split()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows, percent=90):
    """Removed (doc, line) by edit similarity alone: all pairs of lines are compared."""
    at = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            n = " ".join(norm(line))
            if n and i is not None:
                at[(i, k)] = n
    keys = sorted(at)
    links = []
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            p, q = at[a], at[b]
            near = 100 * min(len(p), len(q)) >= percent * max(len(p), len(q))
            if p == q or (near and edit_distance(p, q) <= (100 - percent) * max(len(p), len(q)) // 100):
                links.append((a, b))
    first = components(keys, links)
    return {k for k in keys if first[k] != k}


def removed_lines(spark, rows):
    return {(r["doc"], r["line_no"]) for r in lines.line_verdicts(frame(spark, rows)).collect()}


def test_line_dedup_equals_brute_force(spark):
    base = words(60, "line")
    rows = [(1, "Top line here.\n" + " ".join(base) + "\nLast one 123"), (2, "last ONE 456!\n\n***\n" + " ".join(base[:30] + ["changed"] + base[31:])), (3, " ".join(base)), (4, "***\n\n***"), (5, None), (6, ""), (7, "own words only"), (8, "own words only\nown words only"), (9, " ".join(words(5000, "z")) + "\ntop line HERE")]
    rows += [(20 + k, " ".join(base[:k] + ["v%d" % k] + base[k + 1 :])) for k in range(12)]
    long = words(150, "long line")
    rows += [(40, " ".join(long)), (41, " ".join(long[:50] + ["q"] * 5 + long[58:])), (42, " ".join(w if k % 4 else "r%d" % k for k, w in enumerate(long)))]
    assert removed_lines(spark, rows) == brute_lines(rows)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got[5] is None and got[4] == "***\n\n***" and got[3] == "" and got[6] == "" and got[1].startswith("Top line here.")


def test_line_dedup_recall_by_edit_similarity_alone(spark):
    """Lines of 4 to 40 words with words changed, dropped and misspelt, against brute force that knows no fingerprints."""
    rng = random.Random(5)
    rows, k = [], 0
    for n in range(4, 41, 2):
        base = words(n, f"r{n}")
        rows.append((k, " ".join(base)))
        for _ in range(6):
            k += 1
            new = list(base)
            for _ in range(max(1, n // 14)):
                j, what = rng.randrange(len(new)), rng.random()
                new[j : j + 1] = [] if what < 0.2 else [new[j] + "x"] if what < 0.6 else ["w%d" % rng.randrange(999)]
            rows.append((k, " ".join(new)))
        k += 1
    got, want = removed_lines(spark, rows), brute_lines(rows)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_short_lines_near_one_hub_that_share_no_pair_with_each_other(spark):
    """Pairs of short lines a letter of two words apart, each over a tenth from the line that all resemble: none is lost for what it shares with that line."""
    rng, rows = random.Random(11), []
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(6)]
    rows.append((0, " ".join(base)))
    for k in range(40):
        other = list(base)
        other[k % 3 * 2] = "".join(rng.choice("qrstuvwxyz") for _ in range(7))
        for letter in "aq":
            i, j = (k % 3 * 2 + 1) % 6, (k % 3 * 2 + 4) % 6
            rows.append((len(rows), " ".join(w[:3] + letter + w[4:] if n == i or n == j else w for n, w in enumerate(other))))
    assert removed_lines(spark, rows) == brute_lines(rows)


def test_family_pairs_are_held_to_the_share_of_their_union(spark):
    """Sets that meet by a shared difference but share too little are not written; those that share enough are."""
    hub = list(range(100))
    sets = {1: hub[15:] + [-1], 2: hub[:15] + hub[30:] + [-1], 3: hub[30:] + [-2], 4: hub[30:] + [-3]}
    rows = [(0, i, i, len(s), sorted(set(s) ^ set(hub))) for i, s in sets.items()]
    got = {(r["a"], r["b"]) for r in linking.related(spark.createDataFrame(rows, "fam long, id long, label long, n int, elems array<int>"), 80).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))} and (1, 2) not in got


def test_line_dedup_columns_null_ids_and_empty_table(spark):
    docs = frame(spark, [(None, "same\nsame"), (1, "same\nsame")])
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(docs).collect()}
    assert got == {None: ("same\nsame", 2, 0), 1: ("same", 2, 1)}
    assert lines.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_removed"]
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    clash = docs.withColumnsRenamed({"rep": "cf_doc", "label": "cf_gone", "key": "doc"})
    assert lines.dedup_lines(clash).columns == [*clash.columns, "n_lines", "n_removed"]
    assert isinstance(lines.dedup_lines(docs).schema["n_removed"].dataType, T.LongType)


def test_buckets_without_a_possible_pair(spark):
    """Members that share keys, of which the sketch lets no pair through: nothing is fetched, verified or related, and nobody is linked."""

    def never(*_):
        raise AssertionError("called without a pair")

    members = spark.createDataFrame([(k, [1, 2, k], 7) for k in range(3, 9)], "id long, keys array<long>, n int")
    got = linking.link(members, ["n"], lambda a, b: "false", never, never, never, 80)
    assert got.columns == ["id", "label"] and got.count() == 0
