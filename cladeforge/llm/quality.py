"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Features are one- and two-word n-grams of the words and one- to three-word n-grams of their shapes (letters, digits and
signs as runs), hashed to 2^bits weights, with log counts scaled to length one. Only the text is read; labels, language,
source and id are never features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.common import WordHashes, bounded, materialise, mix64, window_hashes, words

#: Labelled rows learnt from at most: those with the smallest keyed hash of their id, so the same ones at every layout.
MAX_LABELLED = 6000
BITS = 18
_RUNS = re.compile(rb"[a-z\x80-\xff]+|[A-Z]+|[0-9]+")


class ShapeHashes(WordHashes):
    """word -> hash of its shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        shape = _RUNS.sub(lambda m: b"0" if m[0][:1].isdigit() else b"A" if b"A" <= m[0][:1] <= b"Z" else b"a", word)
        value = self[word] = xxhash.xxh64_intdigest(shape, self.seed)
        return value


class Featuriser:
    def __init__(self, bits: int = BITS):
        self.bits, self.lower, self.shape = np.uint64(64 - bits), WordHashes(11), ShapeHashes(13)

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values) of length one; none for a text without words."""
        raw = words(text, lower=False)
        if not raw:
            return np.empty(0, np.int64), np.empty(0)
        plain, shape = self.lower.array([w.lower() for w in raw]), self.shape.array(raw)
        grams = [mix64(plain), window_hashes(plain, 2), mix64(shape), window_hashes(shape, 2), window_hashes(shape, 3)]
        at, n = np.unique(np.concatenate(grams) >> self.bits, return_counts=True)
        v = np.log1p(n)
        return at.astype(np.int64), v / np.sqrt((v * v).sum())


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2) -> np.ndarray:
    """FTRL-proximal weights (McMahan et al. 2013); the last one is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for turn in range(epochs):
        for k in np.random.default_rng(turn).permutation(len(examples)):
            at, v, y = examples[k]
            at, v = np.append(at, size - 1), np.append(v, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - y) * v
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    return weights(np.arange(size)).astype(np.float32)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, bits: int = BITS) -> np.ndarray | None:
    """Weights from labelled rows that aren't held out, ``max_labelled`` ids at most; None without any.

    Conflicting labels of an id count as 1 where at least half of them are; null labels are left out. Rows that repeat an id are examples each; other
    columns are ignored.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    # only ids of documents count against the bound
    chosen = materialise(known.join(texts.select("id").distinct(), "id").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(max_labelled), "labelled")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Featuriser(bits)
        for batch in batches:
            got = [f.features(t) for t in batch["text"]]
            yield pd.DataFrame({"k": batch["k"], "y": batch["y"], "at": [a.astype(np.int32) for a, _ in got], "v": [v.astype(np.float32) for _, v in got]})

    picked = bounded(texts).join(F.broadcast(chosen), "id").select(F.xxhash64("id", F.lit(7)).alias("k"), "y", "text")
    found = materialise(picked.mapInPandas(run, "k long, y int, at array<int>, v array<float>"), "examples")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        examples = [(np.asarray(a, np.int64), np.asarray(v, float), int(y)) for b in batches for y, a, v in zip(b["y"], b["at"], b["v"], strict=True)]
        if examples:
            yield pd.DataFrame({"w": [fit(examples, bits).tobytes()]})

    # one task, over the bounded sample alone
    got = found.repartition(1).sortWithinPartitions("k", F.hash("at")).mapInPandas(learn, "w binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else None


def score(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text", out_col: str = "score", bits: int = BITS) -> DataFrame:
    """The input with ``out_col`` (0 to 1) appended: P(label 1). A text without words scores by the bias alone; without
    a model all score 0.5. Every row is scored; an input column of that name is replaced."""
    kept = [c for c in docs.columns if c != out_col]
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits floats

    def run(batches):
        f, w = Featuriser(bits), shared.value
        for batch in batches:
            out = []
            for text in batch:
                at, v = f.features(text)
                x = 0.0 if w is None else float(w[-1]) + float(w[at] @ v)
                out.append(1 / (1 + np.exp(-np.clip(x, -30, 30))))
            yield pd.Series(out, dtype="float64")

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    return bounded(docs).select(*kept, F.pandas_udf(scored, "double")(F.col(text_col)).alias(out_col))
