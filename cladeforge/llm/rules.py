"""Quality rules, line first: rules judge each line, failing lines go, then documents that lose too much go.

A line fails if it is navigation (several separators or menu marks), boilerplate (a fixed phrase), lacks sentence
punctuation where it is long, or is mostly signs. The base figures count words of the whole text as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.common import WordHashes, bounded, window_hashes, words

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Phrases of lines that are boilerplate.
BOILERPLATE = re.compile(r"all rights reserved|terms of (?:use|service)|privacy policy|cookie|javascript|lorem ipsum|licensed under|click here|sign up|log in|copyright", re.I)
SEPARATOR = re.compile(r"[|»›•·]| > | / ")
PERIODS = re.compile(r"[.!?。]")
ENDS = re.compile(r"[.!?…:;,\"'”’)\]]\s*$")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]{3}")


def repeated_words(tokens: list[bytes], hashes: WordHashes, width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more in the text, first occurrences included."""
    if len(tokens) < width + 1:
        return 0
    grams = window_hashes(hashes.array(tokens), width)
    _, inverse, n = np.unique(grams, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[inverse] > 1)
    if not len(at):
        return 0
    edges = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def line_fails(line: str, n: int, max_symbols: float = 0.1, max_separators: float = 0.2, long_words: int = 30) -> str:
    """The rule that a line of ``n`` words fails, or ''."""
    if n >= 4 and len(SEPARATOR.findall(line)) > max_separators * n:
        return "navigation"
    if n <= 20 and BOILERPLATE.search(line):
        return "boilerplate"
    if len(SYMBOLS.findall(line)) > max_symbols * len(line):
        return "symbols"
    if n > long_words and not ENDS.search(line[-40:]) and not PERIODS.search(line):
        return "punctuation"
    if n >= 10 and CAPITALS.search(line):
        upper, lower = line.upper(), line.lower()
        letters = sum(map(ne, upper, lower)) if len(upper) == len(lower) == len(line) else len(line)
        if letters >= 20 and sum(map(ne, line, lower)) > 0.7 * letters:
            return "capitals"
    return ""


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, clean_text),
    one row per input row.

    Words are runs of other than space and \\x09-\\x0D. base_failed: under 10 words, or more than a fifth of them in
    five-word windows that occur again. kept: not base_failed, and at most ``max_lost`` of the words are in failing lines.
    Null counts as empty (base_failed, clean_text null). Repeated rows get equal answers; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(5)
        for batch in batches:
            out = []
            for text in batch["text"]:
                tokens = words(text, lower=False)
                n = len(tokens)
                seen, dup, removed, lost, good = set(), 0, 0, 0, []
                for line in (text or "").split("\n"):
                    size = len(words(line, lower=False))
                    if size:
                        dup += line in seen
                        seen.add(line)
                    if size and line_fails(line, size):
                        removed, lost = removed + 1, lost + size
                    else:
                        good.append(line)
                repeats = repeated_words(tokens, hashes)
                chars = len(b"".join(tokens).decode("utf-8", "surrogatepass")) if n else 0
                failed = n < 10 or 100 * repeats > 20 * n
                out.append((n, chars, len(SYMBOLS.findall(text or "")), dup, repeats, failed, not failed and lost <= max_lost * n, removed, None if text is None else "\n".join(good)))
            got = pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "clean_text"])
            got.insert(0, "id", batch["id"].array)
            yield got

    picked = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(run, f"id {dict(picked.dtypes)['id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, clean_text string")
