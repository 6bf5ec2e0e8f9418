"""Language identification by unigram piece models, summed over all segmentations.

The vocabulary is that of a public tokenizer and stays fixed; each language has probabilities of its pieces, learnt by
expectation maximisation over word counts. A text's probability in a language is the product over its words (runs of
other than white space, with a mark before) of the sum over every way to cut the word into pieces, which a forward
pass gives. Characters that aren't pieces are made of byte pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.common import bounded, discard, materialise
from cladeforge.llm.spm import tokenizer_path

#: Documents learnt from, about so many a language: those whose keyed hash lies below their language's threshold.
MAX_DOCUMENTS = 800
#: More distinct languages than this are an error: each has a column of probabilities.
MAX_LANGUAGES = 500
MARK = "▁".encode()
#: Expected counts are summed as whole numbers of this part, so that sums don't depend on their order.
PART = 1 << 16
#: Words beyond this many bytes are walked through with a bounded window instead of whole.
WINDOW = 4096


class Pieces:
    """The vocabulary as a trie over bytes in sorted arrays, and the byte pieces."""

    def __init__(self, names: list[str]):
        byte = {f"<0x{b:02X}>": b for b in range(256)}
        self.size, self.longest = len(names), 1
        self.bytes = np.zeros(256, np.int64)
        child: dict[int, int] = {}
        piece = [-1]
        for k, name in enumerate(names):
            raw = name.encode()
            if name in byte:
                self.bytes[byte[name]] = k
            elif not (name.startswith("<") and name.endswith(">") and len(name) > 2) and b"\n" not in raw:
                self.longest = max(self.longest, len(raw))
                state = 0
                for b in raw:
                    state = child.setdefault(state << 8 | b, len(piece))
                    if state == len(piece):
                        piece.append(-1)
                piece[state] = k
        #: state and byte -> next state; state -> piece that ends there.
        self.keys = np.array(sorted(child), np.int64)
        self.next = np.array([child[k] for k in sorted(child)], np.int64)
        self.piece = np.array(piece, np.int64)

    @staticmethod
    def names(path: str) -> list[str]:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [model.id_to_piece(k) for k in range(model.get_piece_size())]

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of all pieces in bytes, none over a line end: all characters walk the trie at once. The bytes of
        characters that aren't pieces are edges of their own."""
        begin = np.flatnonzero((data & 0xC0 != 0x80) & (data != 10))
        lead = data[begin]
        size = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        found, whole = [], np.zeros(len(begin), bool)
        walker, state, depth = np.arange(len(begin)), np.zeros(len(begin), np.int64), 0
        while len(walker):
            at = begin[walker] + depth
            inside = at < len(data)
            walker, state, at = walker[inside], state[inside], at[inside]
            key = state << 8 | data[at]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[where] == key
            walker, state, depth = walker[known], self.next[where[known]], depth + 1
            hit = self.piece[state] >= 0
            found.append((begin[walker[hit]], begin[walker[hit]] + depth, self.piece[state[hit]]))
            whole[walker[hit]] |= size[walker[hit]] == depth
        for k in range(4):
            at = begin[~whole & (size > k)] + k
            at = at[at < len(data)]
            at = at[data[at] != 10]
            found.append((at, at + 1, self.bytes[data[at]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def lattice(pieces: Pieces, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first node, last node) of each word and (from, to, word, piece) of each edge; a node is a place in the joined words."""
    data = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    last = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate([[0], last[:-1] + 1])
    at, to, piece = pieces.edges(data)
    return first, last, at, to, np.searchsorted(last, at), piece


def sweep(at: np.ndarray, to: np.ndarray, place: np.ndarray, weight: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Log sums of all paths from ``begin`` to each node; places are walked in order, all words at once."""
    value = np.full((n, weight.shape[1]), -np.inf)
    value[begin] = 0
    order = np.argsort(place * n + to, kind="stable")
    at, to, weight = at[order], to[order], weight[order]
    cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
        starts = np.flatnonzero(np.diff(to[lo:hi], prepend=-1))
        value[to[lo:hi][starts]] = np.logaddexp.reduceat(value[at[lo:hi]] + weight[lo:hi], starts, axis=0)
    return value


def word_scores(pieces: Pieces, words: list[bytes], logp: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """ln P(word) in every language, summed over segmentations; chunks of words with ``most`` numbers at once."""
    out = np.empty((len(words), logp.shape[1]))
    lo = 0
    while lo < len(words):
        hi, size = lo, 0
        while hi < len(words) and (hi == lo or size + 4 * len(words[hi]) * logp.shape[1] <= most):
            size += 4 * len(words[hi]) * logp.shape[1]
            hi += 1
        if len(words[lo]) > WINDOW:
            out[lo], hi = long_score(pieces, words[lo], logp), lo + 1
        else:
            hi = next((k for k in range(lo, hi) if len(words[k]) > WINDOW), hi)
            first, last, at, to, word, piece = lattice(pieces, words[lo:hi])
            out[lo:hi] = sweep(at, to, to - first[word], logp[piece], first, int(last[-1]) + 1)[last]
        lo = hi
    return out


def long_score(pieces: Pieces, word: bytes, logp: np.ndarray, block: int = WINDOW) -> np.ndarray:
    """The same for one long word: blocks of places are swept one after another, and only the values that a piece can
    still start from are carried on."""
    keep = pieces.longest
    carried, base = np.full((1, logp.shape[1]), 0.0), 0  # values of the places [base, done]
    for done in range(0, len(word), block):
        upto = min(len(word), done + block)
        edges = np.stack(pieces.edges(np.frombuffer(word, np.uint8, min(len(word), upto + keep) - base, base)), axis=1) + [base, base, 0]
        edges = edges[(edges[:, 1] > done) & (edges[:, 1] <= upto)]
        value = np.full((upto - base + 1, logp.shape[1]), -np.inf)
        value[: len(carried)] = carried
        order = np.lexsort((edges[:, 0], edges[:, 1]))
        edges = edges[order]
        weight = logp[edges[:, 2]]
        cuts = np.flatnonzero(np.diff(edges[:, 1], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(edges)], strict=True):
            value[edges[lo, 1] - base] = np.logaddexp.reduce(value[edges[lo:hi, 0] - base] + weight[lo:hi], axis=0)
        start = max(upto - keep, base)
        carried, base = value[start - base :], start
    return carried[-1]


def parts(word: bytes, most: int = WINDOW) -> Iterator[bytes]:
    """``word``, cut between characters into parts of about ``most`` bytes where it is longer: learning sees those."""
    lo = 0
    while lo < len(word):
        hi = min(lo + most, len(word))
        while hi < len(word) and word[hi] & 0xC0 == 0x80:
            hi += 1
        yield word[lo:hi]
        lo = hi


def expected(pieces: Pieces, words: list[bytes], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, in units of 1/PART, over all segmentations of counted words of one language."""
    total = np.zeros(pieces.size, np.int64)
    ends = np.cumsum([len(w) for w in words]) // (1 << 18)
    for block in np.unique(ends):
        lo, hi = np.searchsorted(ends, [block, block + 1])
        some, n = words[lo:hi], counts[lo:hi]
        first, last, at, to, word, piece = lattice(pieces, some)
        weight = logp[piece][:, None]
        ahead = sweep(at, to, to - first[word], weight, first, int(last[-1]) + 1)
        back = sweep(to, at, last[word] - at, weight, last, int(last[-1]) + 1)
        share = np.exp(ahead[at, 0] + weight[:, 0] + back[to, 0] - ahead[last[word], 0])
        np.add.at(total, piece, np.rint(share * n[word] * PART).astype(np.int64))
    return total


@dataclass
class Model:
    names: list[str]
    languages: list[str]
    #: ln P(piece) a row, a column a language.
    logp: np.ndarray
    #: ln of each language's share of the documents.
    prior: np.ndarray


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_documents: int = MAX_DOCUMENTS, rounds: int = 2, smoothing: float = 0.05) -> Model:
    """Piece probabilities of every language of ``docs`` rows with an id, text and language that aren't held out.

    Learns from about ``max_documents`` whole texts a language, picked by keyed hash of the id, so the same ones at every
    layout. Shares of languages come from all rows. Other columns are ignored; repeated rows count each.
    """
    spark = docs.sparkSession
    names = Pieces.names(path or tokenizer_path())
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    logp = np.full((len(names), len(languages)), -np.log(len(names)))
    prior = np.log(np.array([sizes[x] for x in languages], float) / max(sum(sizes.values()), 1))
    if not languages:
        return Model(names, languages, logp, prior)
    below = spark.createDataFrame([(k, x, min(1.0, max_documents / sizes[x])) for k, x in enumerate(languages)], "language int, lang string, share double")
    picked = known.join(F.broadcast(below), "lang").where((F.xxhash64("id", F.lit(17)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)) < F.col("share"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, t in zip(batch["language"], batch["text"], strict=True):
                if not (found := Counter(t.split())):
                    continue
                yield pd.DataFrame({"language": np.full(len(found), k, np.int32), "word": [*found], "n": [*found.values()]})

    counted = bounded(picked).select("language", "text").mapInPandas(count, "language int, word string, n long")
    words = materialise(counted.groupBy("language", "word").agg(F.sum("n").alias("n")), "words")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((names, logp))  # languages x vocabulary

        def step(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            pieces, p = Pieces(shared.value[0]), shared.value[1]
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, rows in batch.groupby("language"):
                    cut = [(part, n) for w, n in zip(rows["word"], rows["n"], strict=True) for part in parts(MARK + w.encode("utf-8", "surrogatepass"))]
                    got = expected(pieces, [w for w, _ in cut], np.array([n for _, n in cut]), p[:, k])
                    total[k] = total[k] + got if k in total else got
            for k, t in total.items():
                at = np.flatnonzero(t)
                yield pd.DataFrame({"language": np.full(len(at), k, np.int32), "piece": at, "n": t[at]})

        sums = words.repartition(spark.sparkContext.defaultParallelism, "word").mapInPandas(step, "language int, piece long, n long")
        n = np.zeros_like(logp)
        for r in sums.groupBy("language", "piece").agg(F.sum("n").alias("n")).collect():
            n[r["piece"], r["language"]] = r["n"] / PART
        logp = np.log((n + smoothing) / (n.sum(axis=0) + smoothing * len(names)))
    discard(words)
    return Model(names, languages, logp, prior)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row per input row: the likeliest language of the whole text and its share of the
    probability of all.

    Null texts, texts without a letter, and all texts where the model has no language are ``und`` with score 0. Ties go
    to the language that sorts first. Rows that repeat a text are judged alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        pieces, known, rows, held = Pieces(m.names), {}, np.empty((0, len(m.languages))), 0
        for batch in batches:
            out = []
            texts = [t.split() if t is not None and m.languages and any(map(str.isalpha, t)) else None for t in batch["text"]]
            if rows.size > 1 << 20 or held > 1 << 24:  # a worker's memory is bounded
                known, rows, held = {}, rows[:0], 0
            new = sorted({w for t in texts if t for w in t}.difference(known))
            held += sum(map(len, new))
            rows = np.concatenate([rows, word_scores(pieces, [MARK + w.encode("utf-8", "surrogatepass") for w in new], m.logp)])
            known.update(zip(new, range(len(known), len(rows)), strict=True))
            for t in texts:
                if not t:
                    out.append(("und", 0.0))
                    continue
                ll = rows[np.fromiter(map(known.__getitem__, t), np.int64, len(t))].sum(axis=0) + m.prior
                share = np.exp(ll - ll.max())
                best = int(ll.argmax())
                out.append((m.languages[best], float(share[best] / share.sum())))
            got = pd.DataFrame(out, columns=["lang_pred", "score"])
            got.insert(0, "id", batch["id"].array)
            yield got

    # numbers with nulls become floats in pandas: ids go as text
    picked = bounded(docs).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = picked.mapInPandas(run, "id string, lang_pred string, score double")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
