"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

Words are hashed to ``VOCAB`` buckets. Each of the two words before and the two after has its own embedding table;
their sum goes through tanh to a softmax over ``CLASSES`` classes of buckets, and to one over the buckets of a class,
which starts from their corpus counts. So every bucket's probability depends on both sides; words of one bucket are not
told apart. A document's score is the sum of log P(bucket of a word | words around it) over its words.

Training reads every word of every document: each input partition runs Adagrad in numpy over its own documents from the
same start, and the partitions' networks and counts are summed, weighted by words, in two steps of bounded size. What is
gathered grows with the number of partitions, what is kept (a megabyte) doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.common import WordHashes, bounded, words

VOCAB, HIDDEN, CLASSES = 4096, 16, 64
#: Buckets of a class: bucket b is member b // CLASSES of class b % CLASSES.
MEMBERS = VOCAB // CLASSES
AROUND = (-2, -1, 1, 2)
BATCH = 4096
#: Logits are held within this of 0, so that no sum of their powers overflows or vanishes in float32.
FAR = 80
#: Words that are scored together.
TOGETHER = 1 << 15
#: Floats of the network in one row on the way to the sum.
BLOCK = 4096


class Network:
    """Parameters in one float32 vector; ``VOCAB`` itself stands for what lies beyond a text's ends."""

    shapes = [(len(AROUND), VOCAB + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, MEMBERS)]

    def __init__(self, flat: np.ndarray | None = None, counts: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for s in self.shapes]
        if flat is None:
            rng = np.random.default_rng(3)
            flat = np.zeros(sum(sizes), np.float32)
            flat[: sizes[0]] = rng.normal(0, 0.1, sizes[0])
            flat[sizes[0] + sizes[1] : sum(sizes[:3])] = rng.normal(0, 0.1, sizes[2])
        self.flat = flat
        self.table, self.b1, self.w2, self.b2, self.w3 = (x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), self.shapes, strict=True))
        self.counts = np.zeros(VOCAB) if counts is None else counts

    def prior(self) -> np.ndarray:
        """log(count + 1) of every class's members."""
        return np.log(self.counts.reshape(MEMBERS, CLASSES).T + 1).astype(np.float32)

    def forward(self, around: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(hidden, logits of classes)."""
        hidden = self.table[0].take(around[0], axis=0)
        hidden += self.b1
        for k in range(1, len(AROUND)):
            hidden += self.table[k].take(around[k], axis=0)
        np.tanh(hidden, out=hidden)
        logits = hidden @ self.w2
        logits += self.b2
        np.clip(logits, -FAR, FAR, out=logits)
        return hidden, logits

    def within(self, hidden: np.ndarray, target: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
        """Words in order of class: (that order, each class's range in it, hidden, logits of the class's members)."""
        group = (target % CLASSES).astype(np.int16)  # sixteen bits are sorted by counting
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=CLASSES)).tolist()
        ranges = list(zip([0, *ends[:-1]], ends, strict=True))
        h, logits = hidden.take(order, axis=0), prior.take(group[order], axis=0)
        for c, (lo, hi) in enumerate(ranges):
            if lo < hi:
                logits[lo:hi] += h[lo:hi] @ self.w3[c]
        np.clip(logits, -FAR, FAR, out=logits)
        return order, ranges, h, logits

    def word_log_probs(self, around: list[np.ndarray], target: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """log P(class) + log P(member of its class) of every word."""
        hidden, classes = self.forward(around)
        at = np.arange(len(target))
        own = classes[at, target % CLASSES]
        own -= np.log(np.exp(classes, out=classes) @ np.ones(CLASSES, np.float32))
        order, _, _, logits = self.within(hidden, target, prior)
        inside = logits[at, target[order] // CLASSES]
        inside -= np.log(np.exp(logits, out=logits) @ np.ones(MEMBERS, np.float32))
        own[order] += inside
        return own

    def log_prob(self, around: list[np.ndarray], target: np.ndarray, prior: np.ndarray) -> float:
        """Their sum."""
        return float(self.word_log_probs(around, target, prior).sum(dtype=np.float64))


class Trainer:
    def __init__(self, rate: float = 0.15):
        self.net, self.rate = Network(), rate
        self.squares = [np.full(s, 1e-4, np.float32) for s in Network.shapes]

    def step(self, around: list[np.ndarray], target: np.ndarray) -> None:
        net = self.net
        net.counts += np.bincount(target, minlength=VOCAB)
        hidden, out = net.forward(around)
        np.exp(out, out=out)
        out /= out @ np.ones((CLASSES, 1), np.float32)
        out[np.arange(len(target)), target % CLASSES] -= 1
        out /= len(target)
        back = out @ net.w2.T
        w3 = np.zeros_like(net.w3)  # of a class that has no word it stays so
        order, ranges, h, inner = net.within(hidden, target, net.prior())
        np.exp(inner, out=inner)
        inner /= inner @ np.ones((MEMBERS, 1), np.float32)
        inner[np.arange(len(target)), target[order] // CLASSES] -= 1
        inner /= len(target)
        inside = np.empty_like(h)
        for c, (lo, hi) in enumerate(ranges):
            if lo < hi:
                w3[c] = h[lo:hi].T @ inner[lo:hi]
                inside[lo:hi] = inner[lo:hi] @ net.w3[c].T
        back += inside.take(np.argsort(order), axis=0)
        back *= 1 - hidden * hidden
        for k, ids in enumerate(around):  # only rows that occur have a gradient: sums over the words of each
            by = np.argsort(ids.astype(np.int16), kind="stable")
            occurs = np.bincount(ids, minlength=VOCAB + 1)
            rows = np.flatnonzero(occurs)
            g = np.add.reduceat(back.take(by, axis=0), np.cumsum(occurs[rows]) - occurs[rows], axis=0)
            squares = self.squares[0][k].take(rows, axis=0)
            squares += g * g
            self.squares[0][k, rows] = squares
            g *= self.rate
            g /= np.sqrt(squares, out=squares)
            net.table[k, rows] = net.table[k].take(rows, axis=0) - g
        for p, s, g in zip((net.b1, net.w2, net.b2, net.w3), self.squares[1:], (back.sum(axis=0), hidden.T @ out, out.sum(axis=0), w3), strict=True):
            s += g * g
            p -= self.rate * g / np.sqrt(s)


def buckets(text: str | None, hashes: WordHashes) -> np.ndarray:
    return (hashes.array(words(text)) % np.uint64(VOCAB)).astype(np.int64)


def positions(texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(ids around each word, the words) of texts put one after another, apart."""
    gap = np.full(2, VOCAB, np.int64)
    line = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    at = np.flatnonzero(line != VOCAB)
    return [line[at + o] for o in AROUND], line[at]


def train(docs: DataFrame, text_col: str = "text") -> Network | None:
    """A network from every word of ``docs``; None where there is no word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, trainer, held, size, seen = WordHashes(21), Trainer(), [], 0, 0

        def flush():
            around, target = positions(held)
            for i in range(0, len(target), BATCH):
                trainer.step([a[i : i + BATCH] for a in around], target[i : i + BATCH])

        for batch in batches:
            for text in batch["text"]:
                ids = buckets(text, hashes)
                if len(ids):
                    held.append(ids)
                    size += len(ids)
                    seen += len(ids)
                if size >= 8 * BATCH:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        if seen:
            flat = trainer.net.flat.astype(np.float64) * seen
            flat = np.concatenate([flat, trainer.net.counts, [seen]])
            yield pd.DataFrame([(i // BLOCK, flat[i : i + BLOCK].astype(np.float32).tobytes()) for i in range(0, len(flat), BLOCK)], columns=["block", "sums"])

    def add(keys, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(frame["sums"].iat[0]) // 4)
        for x in frame["sums"]:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame([(keys[0], total.astype(np.float32).tobytes())], columns=["block", "sums"])

    own = bounded(docs).select(F.col(text_col).alias("text")).mapInPandas(run, "block int, sums binary").withColumn("salt", F.spark_partition_id() % 64)
    once = own.groupBy("block", "salt").applyInPandas(add, "block int, sums binary")
    total = once.groupBy("block").applyInPandas(add, "block int, sums binary").collect()  # one network
    if not total:
        return None
    flat = np.concatenate([np.frombuffer(x, np.float32).astype(np.float64) for _, x in sorted(total)])
    return Network((flat[: -VOCAB - 1] / flat[-1]).astype(np.float32), flat[-VOCAB - 1 : -1])


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob), one row per input row.

    A text without words (null, empty, spaces) has n_tokens 0, log_prob 0 and a null mean. Repeated rows get equal
    scores but for the rounding of float32 sums; other columns are ignored. Without a network every class is as likely as any other.
    """
    net = net or Network(np.zeros(sum(int(np.prod(s)) for s in Network.shapes), np.float32))
    shared = docs.sparkSession.sparkContext.broadcast((net.flat, net.counts))  # a megabyte

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, net = WordHashes(21), Network(*shared.value)
        prior = net.prior()

        def totals(texts: list[np.ndarray]) -> list[float]:
            """Sums of texts that are scored together."""
            around, target = positions(texts)
            got = [net.word_log_probs([a[i : i + TOGETHER] for a in around], target[i : i + TOGETHER], prior) for i in range(0, len(target), TOGETHER)]
            owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            return np.bincount(owner, np.concatenate([*got, np.empty(0, np.float32)]), len(texts)).tolist()

        for batch in batches:
            sums, sizes, held, size = [], [], [], 0
            for text in batch["text"]:
                ids = buckets(text, hashes)
                held.append(ids)
                sizes.append(len(ids))
                size += len(ids)
                if size >= TOGETHER:
                    sums += totals(held)
                    held, size = [], 0
            sums += totals(held)
            mean = [s / n if n else None for s, n in zip(sums, sizes, strict=True)]
            yield pd.DataFrame({"id": batch["id"].array, "n_tokens": sizes, "log_prob": sums, "mean_log_prob": pd.array(mean, "Float64")})

    picked = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(run, f"id {dict(picked.dtypes)['id']}, n_tokens long, log_prob double, mean_log_prob double")
