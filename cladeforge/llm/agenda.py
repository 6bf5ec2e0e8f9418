"""The agenda algorithm over many short units at once, in numpy: one step takes the best candidate of every unit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from cladeforge.llm.common import mix64

#: Odd multiplier of an occurrence's further draws.
SPREAD_DRAW = 0x9E3779B97F4A7C15
#: Units go by length into matrices of these widths, of so many rows at most.
WIDTHS, ROWS = (6, 10, 16, 28, 48), 1 << 15


class Pairs:
    """Symbols (pieces first, then letters that are no piece), and which pairs of them merge into which piece."""

    def __init__(self, scores: dict[str, float]):
        letters = {c for p in scores for c in p}
        self.symbols = [*scores, *sorted(letters - scores.keys())]
        number = {s: k for k, s in enumerate(self.symbols)}
        rank = {s: k for k, s in enumerate(sorted(set(scores.values())))}
        #: What stands for any other letter and for a unit's two ends: no pair has it.
        self.none = len(self.symbols)
        self.letter = np.full(0x110000, self.none, np.int32)
        for s in self.symbols:
            if len(s) == 1:
                self.letter[ord(s)] = number[s]
        found = [(a * (self.none + 1) + b, number[p], rank[score]) for p, score in scores.items() for k in range(1, len(p)) if (a := number.get(p[:k])) is not None and (b := number.get(p[k:])) is not None]
        keys, into, ranks = np.array(found or np.empty((0, 3)), np.int64).T
        self.bits = max(4, int(4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        #: By slot; the last entry is that of a pair which doesn't merge.
        self.into, self.rank = np.full(size + 1, -1, np.int32), np.full(size + 1, -1, np.int32)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.into[slot[placed]], self.rank[slot[placed]] = keys[placed], into[placed], ranks[placed]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(SPREAD_DRAW)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of every pair, -1 where it doesn't merge."""
        keys = left.astype(np.int64) * (self.none + 1) + right
        slot = self.slot(keys)
        held = self.keys[slot]
        other = np.flatnonzero((held != keys) & (held != -1))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.keys) - 1)
            now = held[other] = self.keys[slot[other]]
            other = other[(now != keys[other]) & (now != -1)]
        slot[held == -1] = len(self.keys)
        return self.rank[slot], self.into[slot]

    def merge(self, symbols: np.ndarray, gaps: np.ndarray | None = None, draws: np.ndarray | None = None, bars: np.ndarray | None = None) -> np.ndarray:
        """Merge every row of ``symbols`` (ends on both sides) in place, -1 where no symbol starts any more; how many candidates came up by row.

        With ``gaps``, so many candidates pass before the first skip; ``draws`` gives the gaps that follow.
        """
        n, w = symbols.shape
        seen, rows, out = np.zeros(n, np.int64), np.arange(n), symbols
        rank, into = np.full((n, w), -1, np.int32), np.full((n, w), -1, np.int32)
        a, b = self.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
        rank[:, :-1], into[:, :-1] = a.reshape(n, w - 1), b.reshape(n, w - 1)
        after = np.tile(np.arange(1, w + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, w - 1, dtype=np.int32), (n, 1))
        if gaps is not None:
            gaps, draws = gaps.copy(), draws.copy()
        symbols = symbols.copy()
        while True:
            place = np.arange(0, len(rows) * w, w) + rank.argmax(axis=1)
            live = np.flatnonzero(rank.ravel()[place] >= 0)
            if 2 * len(live) < len(rows):
                out[rows] = symbols
                rows, place = rows[live], np.arange(0, len(live) * w, w) + place[live] % w
                symbols, rank, into, after, before = symbols[live], rank[live], into[live], after[live], before[live]
                if gaps is not None:
                    gaps, draws = gaps[live], draws[live]
                live = np.arange(len(rows))
            if not len(live):
                break
            flat, ranks, pieces, nexts, previous = symbols.ravel(), rank.ravel(), into.ravel(), after.ravel(), before.ravel()
            place = place[live]
            seen[rows[live]] += 1
            if gaps is not None:
                skip = gaps[live] == 0
                gaps[live] -= 1
                skipped = live[skip]
                if len(skipped):
                    ranks[place[skip]] = -1
                    draws[skipped] = mix64(draws[skipped] + np.uint64(SPREAD_DRAW))
                    gaps[skipped] = np.searchsorted(bars, draws[skipped], side="right")
                    live, place = live[~skip], place[~skip]
            base = live * w
            gone = base + nexts[place]
            beyond = nexts[gone]
            piece = pieces[place]
            flat[place], flat[gone], ranks[gone], nexts[place] = piece, -1, -1, beyond
            end = base + beyond
            previous[end] = place - base
            ranks[place], pieces[place] = self.find(piece, flat[end])
            ahead = base + previous[place]
            ranks[ahead], pieces[ahead] = self.find(flat[ahead], piece)
        out[rows] = symbols
        return seen

    def matrices(self, units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which units, their letters' code points, their symbols between two ends) of units of equal width."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        order, low = np.argsort(size, kind="stable"), 0
        ends = np.searchsorted(size[order], WIDTHS, side="right").tolist()
        for w, high in zip(WIDTHS, ends, strict=True):
            for lo in range(low, high, ROWS):
                which = order[lo : min(high, lo + ROWS)]
                codes = np.zeros((len(which), w + 2), np.int32)
                within = np.arange(1, w + 3) <= size[which, None]
                inside = np.hstack([np.zeros((len(which), 1), bool), within[:, :-1]])
                codes[inside] = np.frombuffer("".join([units[i] for i in which.tolist()]).encode("utf-32-le", "surrogatepass"), np.int32)
                symbols = np.where(inside, self.letter[codes], self.none).astype(np.int32)
                yield which, np.where(inside, codes, -1), symbols
            low = high
