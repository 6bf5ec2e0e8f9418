"""Pairwise and centre-star alignment, and column trimming, for per-group kernels."""

from __future__ import annotations

import numpy as np


def needleman_wunsch(a: str, b: str, match: float = 1, mismatch: float = -1, gap: float = -1) -> tuple[str, str]:
    """Global alignment with linear gaps; ties prefer a match, then a gap in b. Rows are filled as vectors."""
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    s = np.zeros((n + 1, m + 1))
    s[0] = np.arange(m + 1) * gap
    steps = np.arange(m + 1) * gap
    for i in range(1, n + 1):
        best = np.empty(m + 1)
        best[0] = i * gap
        best[1:] = np.maximum(s[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch), s[i - 1, 1:] + gap)
        s[i] = np.maximum.accumulate(best - steps) + steps
    out_a, out_b, i, j = [], [], n, m
    while i or j:
        if i and j and s[i, j] == s[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            out_a.append(a[i])
            out_b.append(b[j])
        elif i and s[i, j] == s[i - 1, j] + gap:
            i -= 1
            out_a.append(a[i])
            out_b.append("-")
        else:
            j -= 1
            out_a.append("-")
            out_b.append(b[j])
    return "".join(reversed(out_a)), "".join(reversed(out_b))


def centre_star(seqs: list[str]) -> list[str]:
    """Multiple alignment around the longest sequence (the first among equals)."""
    if len(seqs) < 2:
        return list(seqs)
    c = max(range(len(seqs)), key=lambda k: (len(seqs[k]), -k))
    pairs = [(seqs[c], seqs[c]) if k == c else needleman_wunsch(seqs[c], s) for k, s in enumerate(seqs)]
    gaps = [0] * (len(seqs[c]) + 1)  # gaps before each letter of the centre, and after the last
    for centre, _ in pairs:
        at, run = 0, 0
        for ch in centre + "\0":
            if ch == "-":
                run += 1
            else:
                gaps[at], run, at = max(gaps[at], run), 0, at + 1
    out = []
    for centre, other in pairs:
        row, at, run = [], 0, []
        for ch, o in zip(centre + "\0", other + "\0", strict=True):
            if ch == "-":
                run.append(o)
                continue
            row += run + ["-"] * (gaps[at] - len(run))
            if ch != "\0":
                row.append(o)
            run, at = [], at + 1
        out.append("".join(row))
    return out


def trim_columns(rows: list[str], least_share: float = 0.1, least_columns: int = 500, least_letters: float = 0.75, tolerance: float = 1e-3) -> list[int]:
    """Columns to keep: those with at least ``least_share`` letters, or a lower share (by bisection) so that ``least_columns`` columns and
    ``least_letters`` of all letters stay. Alignments of up to ``least_columns`` columns are kept whole."""
    if not rows or len(rows[0]) <= least_columns:
        return list(range(len(rows[0]) if rows else 0))
    m = np.array([[ch not in "-*" for ch in r] for r in rows])
    letters = m.sum(axis=0)

    def keep(share):
        return letters >= share * len(rows)

    def enough(k):
        return k.sum() >= least_columns and letters[k].sum() >= least_letters * letters.sum()

    low, high = 0.0, least_share
    if not enough(keep(high)):
        while high - low > tolerance:
            mid = (low + high) / 2
            low, high = (mid, high) if enough(keep(mid)) else (low, mid)
        high = low
    return np.flatnonzero(keep(high)).tolist()
