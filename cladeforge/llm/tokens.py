"""Edit-aware token counts: a segment tree of pre-tokens per document.

A byte-level BPE counts a text as the sum of its pre-tokens' counts, and the pattern that cuts pre-tokens reads
left to right with a bounded look-ahead and no look-behind. So after an edit only pre-tokens near it can change:
cutting restarts at the last old boundary that the look-ahead can't reach from the edit, and stops at the first
new boundary that is an old one beyond the edit. Leaves of the tree are runs of pre-tokens; inner nodes hold the
sums of characters and tokens below them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.common import bounded

#: How far beyond its start or its end a pre-token's match can look (the longest contraction has three characters).
REACH = 3
LEAF = 64
#: The pattern that the rank files' tokenizer splits text by, before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counts(dict):
    """pre-token -> number of tokens; emptied at ``limit`` entries."""

    def __init__(self, path: str, limit: int = 1 << 19):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut, self.limit = regex.compile(PATTERN), limit

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(path)


class CountTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, table: Counts):
        self.text, self.table = text, table
        pieces = table.cut.findall(text)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = np.fromiter(map(table.__getitem__, pieces), np.int64, len(pieces))
        self.leaves = [(lens[i : i + LEAF], n[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [(lens, n)]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        starts = np.arange(0, len(pieces), LEAF)
        if len(pieces):
            self.sums[self.width : self.width + len(starts)] = np.stack([np.add.reduceat(lens, starts), np.add.reduceat(n, starts)], axis=1)
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2
        self.reencoded = 0

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character, and the leaf's first character."""
        node, start = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            if offset - start < left:
                node = 2 * node
            else:
                start, node = start + left, 2 * node + 1
        at = min(node - self.width, len(self.leaves) - 1)
        return at, start if at == node - self.width else int(self.sums[1, 0]) - int(self.sums[self.width + at, 0])

    def put(self, leaf: int, lens: np.ndarray, n: np.ndarray) -> None:
        self.leaves[leaf] = (lens, n)
        node = leaf + self.width
        change = np.array([lens.sum(), n.sum()], np.int64) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, at: int, removed: int, added: str) -> None:
        """Replace ``removed`` characters from ``at`` by ``added``; both are cut to the text."""
        at = max(0, min(at, len(self.text)))
        removed = max(0, min(removed, len(self.text) - at))
        shift, clear = len(added) - removed, at + removed
        old = self.text
        self.text = old[:at] + added + old[clear:]
        first, start = self.leaf_at(max(0, at - REACH - 1))
        lens, n = self.leaves[first]
        ends = start + np.cumsum(lens)
        kept = int(np.searchsorted(ends, at - REACH, side="right"))
        begin = int(ends[kept - 1]) if kept else start  # a leaf's start lies before the edit's reach
        new_lens, new_n = [], []
        last, skip = first, kept  # the old pre-tokens' walk: leaf, next in leaf
        edge = begin
        for m in self.table.cut.finditer(self.text, begin):
            piece = m.group()
            new_lens.append(len(piece))
            new_n.append(self.table[piece])
            goal = m.end() - shift
            if m.end() < at + len(added) or goal < clear:
                continue
            while edge < goal and last < len(self.leaves):
                if skip < len(self.leaves[last][0]):
                    edge += int(self.leaves[last][0][skip])
                    skip += 1
                else:
                    last, skip = last + 1, 0
            if edge == goal:
                break
        else:
            last, skip = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.reencoded += len(new_lens)
        tail = self.leaves[last] if last < len(self.leaves) else (lens[:0], n[:0])
        joined = [np.concatenate([x[:kept], np.array(y, np.int64), t[skip:]]) for x, y, t in ((lens, new_lens, tail[0]), (n, new_n, tail[1]))]
        self.put(first, *joined)
        for leaf in range(first + 1, min(last, len(self.leaves) - 1) + 1):
            self.put(leaf, lens[:0], n[:0])


def keyed_edits(id_col: str = "doc_id", text_col: str = "text", n: int = 3, seed: int = 17) -> Column:
    """Edits for a document by a hash of its id: array of (at, removed, added); a null id draws as 0 does."""

    def one(k: int) -> Column:
        h = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(seed + k))
        at = F.pmod(h, F.coalesce(F.length(text_col), F.lit(0)) + 1).cast("int")
        added = F.element_at(F.array(F.lit(""), F.lit(" and then"), F.lit("'re 42, "), F.lit("\n\n  x")), (F.pmod(F.shiftrightunsigned(h, 20), F.lit(4)) + 1).cast("int"))
        return F.struct(at.alias("at"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(30)).cast("int").alias("removed"), added.alias("added"))

    return F.array(*(one(k) for k in range(n)))


def count_edited(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(id, n_tokens, n_tokens_edited, n_chars_edited, n_pretokens, n_reencoded), one row per input row.

    ``edits_col`` holds an array of (at, removed, added), applied in order; offsets count code points of the text as
    it then is and are cut to it. A null text counts as empty, null edits as none, null fields as 0 or "". Repeated
    rows get equal answers; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = counts(ranks_path)
        for batch in batches:
            out = []
            for text, edits in zip(batch["text"], batch["edits"], strict=True):
                tree = CountTree(text or "", table)
                before, pieces = tree.tokens, sum(len(x[0]) for x in tree.leaves)
                for e in edits if edits is not None else ():
                    tree.edit(int(e["at"] or 0), int(e["removed"] or 0), e["added"] or "")
                out.append((before, tree.tokens, len(tree.text), pieces, tree.reencoded))
            yield pd.DataFrame(out, columns=["n_tokens", "n_tokens_edited", "n_chars_edited", "n_pretokens", "n_reencoded"]).assign(id=batch["id"].array)[["id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_pretokens", "n_reencoded"]]

    picked = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"))
    return picked.mapInPandas(run, f"id {dict(picked.dtypes)['id']}, n_tokens long, n_tokens_edited long, n_chars_edited long, n_pretokens long, n_reencoded long")
