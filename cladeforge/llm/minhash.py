"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A document's set is its distinct word shingles. Sets are hashed once; equal sets are one node from then on, so
groups of exact copies cost nothing. Each node gets a one-permutation sketch (the smallest hash in each of k
equal ranges) whose empty bins borrow from a full one found by a keyed order of all bins (optimal densification:
the lender is a uniform draw that equal sets share). Bands of the sketch are buckets. ``linking.link`` then
verifies stars on full sets and finishes what stars leave apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.common import WordHashes, bounded, discard, materialise, mix64, window_hashes, words
from cladeforge.llm.linking import link

#: A sketch keeps four bits of each of its k bins. Of a pair at the threshold, the share of equal bins is short of its
#: mean by ``SPREAD / sqrt(k)`` with a probability under one in a million: some five standard deviations, measured over
#: unions of 7 to 6,000 shingles.
SPREAD = 2.3


def plan_bands(share: float, rows: int, miss: float = 1e-6) -> int:
    """Bands of ``rows`` bins so that a pair at the threshold is in no common bucket with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(share**rows)))


class Sketcher:
    """Text -> shingle set, digest, band keys and bits."""

    def __init__(self, width: int, bands: int, rows: int, seed: int = 1):
        self.width, self.bands, self.rows, self.k = width, bands, rows, bands * rows
        self.hashes = WordHashes(seed)
        edges = [(i << 64) // self.k for i in range(self.k)]
        self.edges = np.array(edges, np.uint64)
        order = np.arange(self.k * self.k, dtype=np.uint64).reshape(self.k, self.k)
        self.order = (mix64(order + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)).astype(np.uint32)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; empty without words."""
        return np.unique(window_hashes(self.hashes.array(words(text)), self.width))

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Densified one-permutation sketch of a sorted non-empty set."""
        at = np.searchsorted(values, self.edges)
        ends = np.append(at[1:], len(values))
        full = np.flatnonzero(at < ends)
        out = np.empty(self.k, np.uint64)
        out[full] = values[at[full]]
        if len(full) < self.k:
            empty = np.setdiff1d(np.arange(self.k), full, assume_unique=True)
            out[empty] = out[full[self.order[empty][:, full].argmin(axis=1)]]
        return mix64(out)

    def keys(self, bins: np.ndarray) -> np.ndarray:
        lanes = bins.reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + lanes[:, k])
        return out.view(np.int64)

    def bits(self, bins: np.ndarray) -> np.ndarray:
        """Four bits a bin, packed into 64-bit words; the last word's spare bits are 0."""
        flat = np.zeros(-(-self.k // 16) * 16, np.uint8)
        flat[: self.k] = (bins & np.uint64(15)).astype(np.uint8)
        return (flat[::2] * 16 + flat[1::2]).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n, digest, keys, bits), one row per input row; without words n is 0 and the rest null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sk = Sketcher(width, bands, rows)
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = sk.shingles(text)
                if len(s):
                    b = sk.bins(s)
                    out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), sk.keys(b), sk.bits(b)))
                else:
                    out.append((0, None, None, None))
            yield pd.DataFrame(out, columns=["n", "digest", "keys", "bits"]).assign(id=batch["id"].array)[["id", "n", "digest", "keys", "bits"]]

    return bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, n long, digest binary, keys array<long>, bits array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets meet ``100 * |a and b| >= percent * |a or b|``."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sk = Sketcher(width, 1, 1)
        for batch in batches:
            kept, held = {}, 0
            good = []
            for ta, tb in zip(batch["text_a"], batch["text_b"], strict=True):
                x, y = (kept[t] if t in kept else kept.setdefault(t, sk.shingles(t)) for t in (ta, tb))
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                good.append(same > 0 and 100 * same >= percent * (len(x) + len(y) - same))
                held += len(x) + len(y)
                if held > 2_000_000:
                    kept, held = {}, 0
            yield batch.loc[good, ["a", "b"]]

    return bounded(both).select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long").distinct()


def deltas(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(id, fam, label) -> (fam, id, label, n, elems): a set's size and in what it differs from its hub's, for ``linking.related``."""
    hubs = texts.select(F.col("id").alias("fam"), F.col("text").alias("hub_text"))
    both = members.join(texts.select("id", "text"), "id").join(hubs, "fam")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sk, last, hub = Sketcher(width, 1, 1), None, None
        for batch in batches:
            out = []
            for text, hub_text in zip(batch["text"], batch["hub_text"], strict=True):
                if hub is None or hub_text != last:
                    last, hub = hub_text, sk.shingles(hub_text)
                own = sk.shingles(text)
                out.append((len(own), np.setxor1d(own, hub, assume_unique=True).view(np.int64)))
            yield pd.DataFrame({"fam": batch["fam"], "id": batch["id"], "label": batch["label"], "n": [x[0] for x in out], "elems": [x[1] for x in out]})

    return bounded(both).select("fam", "id", "label", "text", "hub_text").mapInPandas(run, "fam long, id long, label long, n long, elems array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rows: int = 6, miss: float = 1e-6) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per input row.

    Two sets are linked from ``percent`` per cent of their union on. component_id is the smallest id reachable over
    links, kept is ``id = component_id``. Texts without words (null, empty, only spaces) have no shingles, are linked
    with nothing and kept. A null id can't name a group: such a row has a null component_id, is kept and never
    stands for others. Rows that repeat an id and a text get equal answers; of an id with several texts, copies of any are
    in its group, near copies of one or more. Other columns are ignored.
    """
    bands = plan_bands(percent / 100, rows)
    sk = materialise(sketches(docs, id_col, text_col, width, bands, rows), "sketches")
    named = sk.where("id is not null and n > 0")
    sets = materialise(named.groupBy("digest").agg(F.min("id").alias("rep")), "sets")
    # a row a node: equal sets have one, and an id with several texts has the one with the smallest digest
    own = sets.groupBy(F.col("rep").alias("id")).agg(F.min("digest").alias("digest"))
    nodes = materialise(named.select("id", "digest", "n", "keys", "bits").join(own, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]), "nodes")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    k = bands * rows
    words64 = -(-k // 16)
    share = percent / 100
    differ = math.ceil(k * (1 - (share + (1 - share) / 16 - SPREAD / math.sqrt(k))))

    def possible(left: str, right: str) -> str:
        """Set sizes fit, and at most ``differ`` four-bit bins differ."""
        bins = [f"({left}bits[{i}] ^ {right}bits[{i}])" for i in range(words64)]
        folded = [f"({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3))" for x in bins]
        off = " + ".join(f"bit_count({x} & {0x1111111111111111})" for x in folded)
        return f"100 * least({left}n, {right}n) >= {percent} * greatest({left}n, {right}n) and {off} <= {differ}"

    labels = link(nodes, ["n", "bits"], possible, lambda ids: texts.join(ids, "id"), lambda pairs, found: verified(pairs, found, width, percent), lambda rows, found: deltas(rows, found, width), percent)
    discard(nodes)
    out = sk.select("id", "n", "digest").join(sets, "digest", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "rep", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
