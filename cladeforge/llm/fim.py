"""Fill-in-the-middle: texts cut at two keyed ranks of their units and put together anew.

A unit is a run of other than space and \\x09-\\x0D with the space before it, or the space that ends a text. A unit
begins at a byte of space behind a byte of none, so whether one begins can be told from two neighbouring bytes. A text
is cut into chunks that overlap by one byte; each chunk counts its beginnings on its own, prefix sums tell which chunk
holds a wanted rank, and only that chunk is searched for its place. In UTF-8 the six bytes of space stand for
themselves only, so bytes do as well as code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.common import bounded

SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
MARKERS = "<P>", "<S>", "<M>"


class Chunks:
    """A text's UTF-8 in chunks of ``size`` bytes and the number of units that begin in each, but for the first unit."""

    def __init__(self, data: bytes, size: int = 1 << 16):
        self.data, self.size = data, size
        self.counts = [int(np.count_nonzero(self.begins(k))) for k in range(-(-len(data) // size))]
        self.upto = np.array([*accumulate(self.counts, initial=0)], np.int64)
        self.n = int(self.upto[-1]) + (len(data) > 0)

    def begins(self, k: int) -> np.ndarray:
        """For each byte of chunk ``k`` (of the first: from its second on), whether a unit begins there."""
        at = max(k * self.size - 1, 0)
        space = SPACE[np.frombuffer(self.data, np.uint8, min(len(self.data), (k + 1) * self.size) - at, at)]
        return space[1:] & ~space[:-1]

    def start(self, rank: int) -> int:
        """The byte at which unit ``rank`` (from 0) begins; the end for ``n`` units and more."""
        if rank <= 0 or not self.data:
            return 0
        if rank >= self.n:
            return len(self.data)
        owner = int(np.searchsorted(self.upto, rank)) - 1
        return max(owner * self.size - 1, 0) + 1 + int(np.flatnonzero(self.begins(owner))[rank - 1 - self.upto[owner]])


def draws(key: object, seed: int) -> list[int]:
    """Four keyed 32-bit numbers."""
    digest = sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform_text(text: str | None, key: object, seed: int, rate: int, spm_rate: int, size: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    chunks = Chunks(text.encode("utf-8", "surrogatepass"), size)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKERS):
        return chunks.n, "plain", None, None, text
    a, b = (chunks.start(r) for r in sorted((h1 % (chunks.n + 1), h2 % (chunks.n + 1))))
    prefix, middle, suffix = (x.decode("utf-8", "surrogatepass") for x in (chunks.data[:a], chunks.data[a:b], chunks.data[b:]))
    if h4 % 100 < spm_rate:
        return chunks.n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return chunks.n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, chunk: int = 1 << 16) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row per input row.

    Of ``rate`` per cent of the texts, keyed by (seed, id), prefix, middle and suffix change places: suffix first
    (``spm``) for ``spm_rate`` per cent of those, else prefix first (``psm``); others stay as they are (``plain``), as do
    empty texts and those that hold a marker. Null counts as empty. A null id draws as an empty one; rows that repeat an
    id draw alike, each over its own text. Other columns are ignored. A worker holds a batch of texts and one chunk's
    flags.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [transform_text(t, k, seed, rate, spm_rate, chunk) for k, t in zip(batch["id"], batch["text"], strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
            out.insert(0, "id", batch["id"].array)
            yield out

    # numbers with nulls become floats in pandas: ids go as text
    picked = bounded(docs).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = picked.mapInPandas(run, "id string, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def restored(output: Column, form: Column) -> Column:
    """The text before ``transform``, from its output and form alone: the first marker of each kind is the one put in."""
    p, s, m = (F.locate(x, output) for x in MARKERS)
    tail = F.substring(output, m + 3, F.length(output))
    psm = F.concat(F.substring(output, F.lit(4), s - 4), tail, F.substring(output, s + 3, m - s - 3))
    spm = F.concat(F.substring(output, p + 3, m - p - 3), tail, F.substring(output, F.lit(4), p - 4))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
