"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The vocabulary file is a parameter and never trained. Encoding is the agenda algorithm of SentencePiece's BPE:
adjacent symbols whose concatenation is a piece wait in a heap by score, then by place; the best one merges and
its new neighbours join the heap. With dropout, each candidate that reaches the head of the agenda is skipped with
the rate's probability, by draws keyed by seed, document and place, so that every occurrence gets its own skips and
the same inputs give the same segmentation on every executor and every retry. Without dropout the ids equal
SentencePiece's own.

Text is cut into units that no piece crosses (checked against the vocabulary at load). A draw says how many candidates
pass until the next skip. What a unit becomes without a skip is memoised, with the number of its candidates; occurrences
that skip one are merged together, a matrix of units at a time (``agenda.Pairs``).
A literal U+2581 in a text goes to bytes, so that decoding gives back every text exactly.
"""

from __future__ import annotations

import gc
import heapq
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.agenda import SPREAD_DRAW, WIDTHS, Pairs
from cladeforge.llm.common import bounded, mix64

SPACE = "▁"
#: Longer units are not memoised, nor merged by matrices.
MEMO_CHARS = WIDTHS[-1]
#: Units up to this length keep their agenda in a list.
SHORT_CHARS = 40
NONE = float("-inf")
M64 = (1 << 64) - 1
#: Odd multiplier of places.
SPREAD_PLACE = 0xD6E8FEB86659FD93
#: Letters that are encoded together; a longer text is on its own.
TOGETHER = 1 << 20


class Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        if not all(sp.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model has no byte fallback")
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.special = special - set(self.byte_ids)
        self.plain = np.ones(self.size, bool)
        self.plain[list(special)] = False
        self.pairs = Pairs(self.scores)
        long = [p for p in self.ids if len(p) > 1]
        whole = any(re.search(f"[^{SPACE}]{SPACE}|\\n", p) for p in long)
        self.unit = re.compile("(?s).+" if whole else f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def passes(dropout: float) -> np.ndarray:
    """Bars of a 64-bit draw: as many as it reaches, so many candidates pass until one is skipped (2^-64 lies beyond the last)."""
    n = 1 if dropout >= 1 else min(1 << 20, int(64 * np.log(2) / -np.log1p(-dropout)) + 1)
    bars, left = np.empty(n, np.uint64), 1.0
    for k in range(n):
        left *= 1 - dropout
        bars[k] = min(M64, int((1 - left) * 2.0**64))
    return bars


def mixed(x: int) -> int:
    """``mix64`` of one number."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


class Encoder:
    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0, memo: int = 400_000):
        self.voc, self.seed, self.limit = vocabulary(path), seed & M64, memo
        self.bars = passes(dropout) if dropout > 0 else None
        self.steps = self.bars.tolist() if dropout > 0 else []
        self.pairs = self.voc.pairs
        piece = [self.voc.ids.get(s, -1) for s in self.pairs.symbols]
        self.piece_ids, self.byte_ids = np.array([*piece, -1], np.int32), np.array(self.voc.byte_ids, np.int32)
        #: unit -> its column of ``known``: where its ids start in ``flat``, how many they are, how many candidates came up.
        self.memo: dict[str, int] = {}
        self.flat, self.known = np.empty(0, np.int32), np.empty((3, 0), np.int64)

    def units(self, text: str) -> tuple[list[str], str]:
        """Units of the marked text, and the stand-in for a literal U+2581 (empty without one)."""
        mark = ""
        if SPACE in text:
            mark = next(c for c in map(chr, range(0x10FFFD, 0xF0000, -1)) if c not in text and c not in self.voc.ids)
            text = text.replace(SPACE, mark)
        text = SPACE + text.replace(" ", SPACE)
        return self.voc.unit.findall(text), mark

    def merged_short(self, unit: str, skips: int = 0) -> tuple[list[str], int]:
        """The agenda algorithm with the agenda as a list of the adjacent pairs' scores, which is faster on short units: symbols, and
        how many candidates reached the head. Bit k of ``skips`` skips the k-th."""
        get, none, seen = self.voc.scores.get, NONE, 0
        symbols = list(unit)
        agenda = [get(unit[i : i + 2], none) for i in range(len(unit) - 1)]
        while agenda:
            best = max(agenda)
            if best == none:
                break
            i = agenda.index(best)
            seen += 1
            if skips:
                skip = skips & 1
                skips >>= 1
                if skip:
                    agenda[i] = none
                    continue
            merged = symbols[i] + symbols[i + 1]
            symbols[i] = merged
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = get(merged + symbols[i + 1], none)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + merged, none)
        return symbols, seen

    def merge(self, unit: str, skips: int, mark: str = "") -> tuple[tuple[int, ...], int]:
        """Ids of a unit under given skips, and how many candidates reached the head."""
        get, out = self.voc.ids.get, []
        symbols, seen = (self.merged_short if len(unit) <= SHORT_CHARS else self.merged)(unit, skips)
        for piece in symbols:
            found = get(piece)
            if found is not None:
                out.append(found)
            else:
                raw = SPACE if piece == mark else piece
                out.extend(self.voc.byte_ids[x] for x in raw.encode("utf-8", "surrogatepass"))
        return tuple(out), seen

    def merged(self, unit: str, skips: int = 0) -> tuple[list[str], int]:
        """The agenda algorithm with a heap."""
        scores, seen = self.voc.scores, 0
        n = len(unit)
        bits = skips.to_bytes(skips.bit_length() // 8 + 1, "little")
        most = 8 * len(bits)
        end = list(range(1, n + 1))  # of the symbol that starts here; 0 where none does
        before = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            s = scores.get(unit[i : i + 2])
            if s is not None:
                agenda.append((-s, i, i + 1, i + 2))
        heapq.heapify(agenda)
        while agenda:
            _, a, b, c = heapq.heappop(agenda)
            if end[a] != b or end[b] != c:
                continue
            at, seen = seen, seen + 1
            if at < most and bits[at >> 3] >> (at & 7) & 1:
                continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
                s = scores.get(unit[a : end[c]])
                if s is not None:
                    heapq.heappush(agenda, (-s, a, c, end[c]))
            p = before[a]
            if p >= 0:
                s = scores.get(unit[p:c])
                if s is not None:
                    heapq.heappush(agenda, (-s, p, a, c))
        return [unit[i : end[i]] for i in range(n) if end[i]], seen

    def unmemoised(self, unit: str, draw: int, mark: str) -> tuple[int, ...]:
        """Ids of a unit that is long or has the stand-in: all its skips are drawn first. At most 3 candidates a letter reach the head."""
        bits = bytearray(3 * len(unit) // 8 + 1)
        at, steps = 0, self.steps
        while steps:
            gap = bisect_right(steps, draw)
            at += gap
            if at >= 8 * len(bits):
                break
            if gap < len(steps):
                bits[at >> 3] |= 1 << (at & 7)
                at += 1
            draw = mixed((draw + SPREAD_DRAW) & M64)
        return self.merge(unit, int.from_bytes(bits, "little"), mark)[0]

    def results(self, units: list[str], *skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all units one after another, how many each has, how many candidates came up in each); ``skips``: their gaps and draws."""
        pairs, sizes, seen, parts = self.pairs, np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), []
        for which, codes, symbols in pairs.matrices(units):
            seen[which] = pairs.merge(symbols, *(s[which] for s in skips), *([self.bars] if skips else []))
            row, column = np.nonzero((symbols >= 0) & (codes >= 0))
            symbol = symbols[row, column]
            ids, many = self.piece_ids[symbol], np.ones(len(symbol), np.int64)
            odd = np.flatnonzero(ids < 0)
            if len(odd):
                raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[row[odd], column[odd]].tolist()]
                many[odd] = [len(x) for x in raw]
                ids = np.repeat(ids, many)
                ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            sizes[which] = np.bincount(row, many, len(which)).astype(np.int64)
            parts.append((which, ids))
        start = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        for which, ids in parts:
            out[spans(start[which], sizes[which])] = ids
        return out, sizes, seen

    def learn(self, units: list[str]) -> None:
        """Memoise units without a skip."""
        ids, sizes, seen = self.results(units)
        old = len(self.memo)
        self.memo.update(zip(units, range(old, old + len(units)), strict=True))
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, ids])
        self.known = np.hstack([self.known, [starts, sizes, seen]])

    def encode_many(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts); a null or empty text has none."""
        if len(self.memo) >= self.limit:
            self.memo, self.flat, self.known = {}, self.flat[:0], self.known[:, :0]
        units: list[str] = []
        ends, marked = [0], {}
        for text in texts:
            if text:
                found, mark = self.units(text)
                if mark:
                    marked |= {len(units) + k: mark for k, u in enumerate(found) if mark in u}
                units += found
            ends.append(len(units))
        n, edges = len(units), np.array(ends)
        get = self.memo.get
        at = np.array(list(map(get, units, repeat(-1))), np.int64)
        at[list(marked)] = -2
        new = [i for i in np.flatnonzero(at == -1).tolist() if len(units[i]) <= MEMO_CHARS]
        if new:
            self.learn(list(dict.fromkeys(units[i] for i in new)))
            at[new] = [self.memo[units[i]] for i in new]
        short = at >= 0
        starts, sizes, seen = self.known[:, np.where(short, at, 0)] if self.known.size else np.zeros((3, n), np.int64)
        sources = [self.flat]
        draws = np.zeros(n, np.uint64)
        if self.bars is not None:
            first = np.array([xxhash.xxh64_intdigest(b"%d" % k, self.seed) for k in keys], np.uint64)
            lengths = np.diff(edges)
            draws = mix64((np.arange(n, dtype=np.uint64) + np.repeat(first - edges[:-1].astype(np.uint64), lengths)) * np.uint64(SPREAD_PLACE))
            gaps = np.searchsorted(self.bars, draws, side="right")
            drop = np.flatnonzero(short & (gaps < seen))
            ids, sizes[drop], _ = self.results([units[i] for i in drop.tolist()], gaps[drop], draws[drop])
            starts[drop] = len(self.flat) + np.cumsum(sizes[drop]) - sizes[drop]
            sources.append(ids)
        long = np.flatnonzero(~short).tolist()
        if long:
            found = [self.unmemoised(units[i], int(draws[i]), marked.get(i, "")) for i in long]
            sizes[long] = [len(x) for x in found]
            starts[long] = sum(map(len, sources)) + np.cumsum(sizes[long]) - sizes[long]
            sources.append(np.fromiter((i for x in found for i in x), np.int32))
        out = np.concatenate(sources)[spans(starts, sizes)]
        return out, np.concatenate([[0], np.cumsum(sizes)])[edges]

    def encode(self, text: str | None, key: int = 0) -> list[int] | None:
        """Ids of a whole text; null stays null, an empty text has none. ``key`` names the document."""
        return None if text is None else self.encode_many([text], [key])[0].tolist()


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every span, one span after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


@lru_cache(maxsize=2)
def encoder(path: str, dropout: float, seed: int, memo: int = 400_000) -> Encoder:
    """One a worker process, so that its memo serves all the worker's tasks."""
    return Encoder(path, dropout, seed, memo)


def decode(path: str, ids: list[int] | np.ndarray | None) -> str | None:
    """Text of ids; control pieces give nothing, bytes that aren't UTF-8 give U+FFFD. U+2581 stands for a space in pieces alone, not in bytes."""
    if ids is None:
        return None
    voc = vocabulary(path)
    ids = np.asarray(ids, np.int64)
    if voc.plain[ids].all():
        text = "".join(map(voc.pieces.__getitem__, ids.tolist())).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text
    out = bytearray()
    pieces, byte_of, special = voc.pieces, voc.byte_of, voc.special
    for i in ids.tolist():
        b = byte_of.get(i)
        if b is not None:
            out.append(b)
        elif i not in special:
            out += pieces[i].replace(SPACE, " ").encode()
    first = next((i for i in ids.tolist() if i not in special), None)
    if first is not None and first not in byte_of and pieces[first].startswith(SPACE):
        del out[0]
    return out.decode("utf-8", "replace")


@contextmanager
def uncollected() -> Iterator[None]:
    """Without garbage collection: what an encoder holds has no cycles, and walking all of it again and again costs a third of the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """(id, text, ids array<int>), one row per input row.

    Null text gives null ids, an empty text an empty array. A null id draws as id 0 does. Repeated rows get equal
    ids. Other columns are ignored. Integer ids key the draw.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path, dropout, seed)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *np.flatnonzero(np.diff(size // TOGETHER)) + 1, batch.num_rows]
            for part in (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)):
                with uncollected():
                    ids, offsets = enc.encode_many(part.column(1).to_pylist(), [k or 0 for k in part.column(0).to_pylist()])
                out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=part.column(1).is_null())
                yield pa.record_batch([part.column(0), part.column(1), out], names=["id", "text", "ids"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, text string, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary_path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, ids, and ``decoded``; null ids give null."""
    fields = ", ".join(f"{c} {dict(encoded.dtypes)[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                ids = part.column(part.num_columns - 1)
                flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
                known = ids.is_valid().to_pylist()
                text = pa.array([decode(vocabulary_path, flat[a:b]) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], known, strict=True)], pa.string())
                yield pa.record_batch([*part.columns, text], names=[*keep, "ids", "decoded"])

    return encoded.select(*keep, "ids").mapInArrow(run, f"{fields}, ids array<int>, decoded string")


def tokenizer_path(name: str = "piece_bpe_32k.model", folder: str | None = None) -> str:
    """A vocabulary file's place: in ``folder``, or in $TOKENIZERS, or in /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("TOKENIZERS", "/opt/tokenizers"), name)
