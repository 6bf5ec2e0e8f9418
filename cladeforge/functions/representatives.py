"""Representatives of one aligned group: residues as points of a plane, seeded k-means over rows, and the member of each cluster that its centre points at."""

from __future__ import annotations

from hashlib import md5

import numpy as np

#: Residues and their coordinates in a plane in which similar ones lie close; others lie at the origin.
RESIDUES = "ARNDBCEQZGHILKMFPSTWYV"
ACROSS = [0.7616408720368554, -0.8992027785852091, -0.07873679384886653, -0.14037322274105996, -0.3299593767217029, 0.8310546727955828, -0.5399033158394786, -0.4815946221391955, -0.593800866335506, 0.797220717024523, -0.579087697236552,
          0.6228711220468686, 0.35829799783893695, -0.7688731182964063, 0.20340513326201978, -0.2699133888307127, 0.487114705529672, 0.2494989007418178, 0.3971369000035997, -0.21447784861556976, -0.48582261696986334, 0.6735046248802461]
UP = [0.12031822087625436, -0.006548892920800078, 0.6148427092374856, 0.8999931109979885, 0.9159034615116097, -0.2248776341570619, 0.5640041523838193, 0.24951671883889143, 0.527451024374676, 0.6520120008417274, -0.229131082802156,
      -0.878416213428115, -1.002773729034362, 0.20934299312386676, -0.6733718616949979, -0.9829046315103517, 0.7726524237395054, 0.39518870263656747, 0.027351205616309555, -0.5587327809552116, -0.7044914945390158, -0.6873284031366291]


def embed(rows: list[str]) -> np.ndarray:
    """Two numbers a column for each row of an alignment."""
    plane = np.zeros((128, 2), np.float32)
    plane[[ord(c) for c in RESIDUES]] = np.array([ACROSS, UP]).T
    letters = np.frombuffer("".join(rows).encode("ascii", "replace"), np.uint8).reshape(len(rows), -1)
    return plane[letters].reshape(len(rows), -1)


def kmeans(x: np.ndarray, k: int, seed: int = 0, starts: int = 10, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(label of each row, centres) with the least squared distances of ``starts`` runs of Lloyd's rounds, from centres spread by squared distance
    (Arthur and Vassilvitskii 2007)."""
    rng = np.random.default_rng(seed)
    norms = (x.astype(float) ** 2).sum(axis=1)

    def squared(centres: np.ndarray) -> np.ndarray:
        return np.maximum(norms[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1), 0)

    best = None
    for _ in range(starts):
        chosen = [int(rng.integers(len(x)))]
        far = squared(x[chosen].astype(float))[:, 0]
        while len(chosen) < k:
            total = far.sum()
            chosen.append(int(rng.choice(len(x), p=far / total)) if total > 0 else int(rng.integers(len(x))))
            far = np.minimum(far, squared(x[chosen[-1:]].astype(float))[:, 0])
        centres, labels = x[chosen].astype(float), np.full(len(x), -1)
        for _ in range(rounds):
            away = squared(centres)
            new = away.argmin(axis=1)
            if (new == labels).all():
                break
            labels = new
            for c in range(k):
                if (labels == c).any():
                    centres[c] = x[labels == c].mean(axis=0)
        cost = round(float(squared(centres)[np.arange(len(x)), labels].sum()), 6)
        if best is None or cost < best[0]:
            best = (cost, labels, centres)
    return best[1], best[2]


def pick(names: list[str], rows: list[str], n: int, seed: int = 0, gaps: float = 75) -> list[str]:
    """At most ``n`` names of equally long aligned rows: all where there are no more; else, of rows with no more gaps than the ``gaps``-th percentile, the
    one of each cluster with the largest sum over what its centre has above a half (the first in order of names), and, up to ``n``, others by a keyed hash."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    names, rows = [names[i] for i in order], [rows[i] for i in order]
    if len(names) <= n:
        return names
    n_gaps = np.array([r.count("-") for r in rows])
    kept = np.flatnonzero(n_gaps <= np.percentile(n_gaps, gaps))
    if len(kept) <= n:
        return [names[i] for i in kept]
    x = embed([rows[i] for i in kept])
    labels, centres = kmeans(x, n, seed)
    found = []
    for c in range(n):
        inside = np.flatnonzero(labels == c)
        if len(inside):
            found.append(int(kept[inside[(x[inside] * (centres[c] > 0.5)).sum(axis=1).argmax()]]))
    rest = sorted(set(map(int, kept)) - set(found), key=lambda i: (md5(f"{seed}:{names[i]}".encode()).hexdigest(), names[i]))
    return sorted(names[i] for i in [*found, *rest[: n - len(found)]])
