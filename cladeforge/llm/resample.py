"""Importance resampling towards a target: bucketed n-gram counts as sparse blocks, gains per bucket, keyed Gumbel draws.

The document-by-bucket matrix is written once as CSR blocks, a row a block. Its column sums give the two distributions,
and its product with the vector of gains gives each document's weight; texts are read once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.common import bounded, discard, materialise
from cladeforge.operators.ranking import with_rank

#: bytes -> themselves in words (digits, small letters, beyond ASCII), capitals as small letters, else a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))


class Buckets(dict):
    """feature -> bucket; emptied at ``limit`` entries so that a worker's memory is bounded."""

    def __init__(self, n: int, limit: int = 1 << 17):
        super().__init__()
        self.n, self.limit = n, limit

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[feature] = crc32(feature) % self.n
        return value


def fold_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def features(tokens: list[bytes], width: int) -> list[bytes]:
    """Runs of 1 to ``width`` consecutive words."""
    return tokens + [b" ".join(tokens[i : i + k]) for k in range(2, width + 1) for i in range(len(tokens) - k + 1)]


def csr_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1, buckets: int = 10000) -> DataFrame:
    """One row a block of documents: ids as text, n_words, n_features (arrays, an entry a document) and the block of the count
    matrix as indptr, indices, counts (little-endian int64, int32, int32). A block holds an Arrow batch: its rows and
    bytes are bounded, but for one document of any length, whose row has ``buckets`` entries at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = Buckets(buckets)
        for batch in batches:
            if not len(batch):
                continue
            n_words, n_features, at, counts, ends = [], [], [], [], [0]
            for text in batch["text"]:
                tokens = fold_words(text)
                found = features(tokens, width)
                where, n = np.unique(np.fromiter(map(lookup.__getitem__, found), np.int32, len(found)), return_counts=True)
                n_words.append(len(tokens))
                n_features.append(len(found))
                at.append(where)
                counts.append(n.astype(np.int32))
                ends.append(ends[-1] + len(where))
            yield pd.DataFrame(
                {"ids": [list(batch["id"])], "n_words": [n_words], "n_features": [n_features], "indptr": [np.array(ends, np.int64).tobytes()], "indices": [np.concatenate(at).tobytes()], "counts": [np.concatenate(counts).tobytes()]}
            )

    picked = bounded(docs).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(run, "ids array<string>, n_words array<long>, n_features array<long>, indptr binary, indices binary, counts binary")


def column_sums(blocks: DataFrame, buckets: int = 10000) -> np.ndarray:
    """Counts of each bucket over all blocks; a task sends one row a bucket at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, n in zip(batch["indices"], batch["counts"], strict=True):
                total += np.bincount(np.frombuffer(at, np.int32), np.frombuffer(n, np.int32), buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found, "n": total[found]})

    parts = blocks.select("indices", "counts").mapInPandas(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / raw share)) of each bucket, with one added to every count."""
    size = len(raw)
    all_raw, all_target = float(raw.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_raw / ((float(s) + 1) * all_target))) for s, t in zip(raw, target, strict=True)], np.int64)


def weigh(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id as text, n_words, n_features, weight): the matrix times the gains, divided by the features and rounded down."""
    shared = blocks.sparkSession.sparkContext.broadcast(gains)  # a number a bucket

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                ends, at, n = np.frombuffer(b.indptr, np.int64), np.frombuffer(b.indices, np.int32), np.frombuffer(b.counts, np.int32)
                upto = np.concatenate([[0], np.cumsum(shared.value[at] * n)]).astype(np.int64)
                sums, size = upto[ends[1:]] - upto[ends[:-1]], np.asarray(b.n_features, np.int64)
                yield pd.DataFrame({"id": b.ids, "n_words": b.n_words, "n_features": size, "weight": np.where(size > 0, sums // np.maximum(size, 1), 0)})

    return blocks.mapInPandas(run, "id string, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256("<seed>:<id>"); a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", width: int = 1, buckets: int = 10000, seed: int = 2024, percent: int = 10, min_words: int = 20) -> DataFrame:
    """(id, n_features, weight, score, rank), one row per row of ``docs``: a draw without replacement of ``percent`` per
    cent of the documents with ``min_words`` words, likelier the more their features are the target's.

    score is the weight plus keyed Gumbel noise; the highest scores are drawn, ties to the smaller id, and rank counts
    them from 1; others have rank null. Null and empty texts have no features and weight 0. Rows that repeat an id are
    scored each and may be drawn each; null ids come after all others among ties. Without rows in ``docs`` there is no
    row; without target texts every bucket has its smoothed share. Other columns are ignored.
    """
    blocks = materialise(csr_blocks(docs, id_col, text_col, width, buckets), "csr")
    gains = bucket_gains(column_sums(blocks, buckets), column_sums(csr_blocks(target.withColumn("cf_none", F.lit(0)), "cf_none", target_col, width, buckets), buckets))
    weighed = weigh(blocks, gains).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
    scored = materialise(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "weights")
    discard(blocks)
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    ranked = with_rank(fit, -F.col("score"), F.col("id").isNull(), F.col("id")).withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("id", "n_features", "weight", "score", "rank")
