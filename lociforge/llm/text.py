"""Helpers for texts inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401

WORD = re.compile(r"[^\W_]+")
BRACKETED = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
BROKEN = re.compile(r"(?<=\w)-[ \t]*\r?\n\s*(?=\w)")
MARKS = re.compile("[̀-ͯ]+")


def plain(text: str) -> str:
    """Case-folded and without accents."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text.casefold()


def words(text: str) -> list[str]:
    """Runs of letters and digits; bracketed text is skipped, words broken by a hyphen at a line end are whole."""
    if "-" in text:
        text = BROKEN.sub("", text)
    if "(" in text or "[" in text:
        text = BRACKETED.sub(" ", text)
    return WORD.findall(plain(text))


def distinct_words(flat: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, words, hashes)``: each word's place among the distinct ones, these, and their 64-bit hashes."""
    codes, distinct = pd.factorize(np.array(flat, dtype=object)) if flat else (np.empty(0, np.int64), np.empty(0, object))
    return codes, distinct, pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False) if len(distinct) else np.empty(0, np.uint64)


def word_hashes(flat: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, hashes)`` of ``distinct_words``."""
    codes, _, hashes = distinct_words(flat)
    return codes, hashes


def slices(batches: Iterator[pa.RecordBatch], columns: str | tuple[str, ...], characters: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about so many bytes in the columns, so that memory does not follow the texts' length."""
    columns = (columns,) if isinstance(columns, str) else columns
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(sum(pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1 for c in columns))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + characters, "right")))
            yield batch.slice(at, to - at)
            at = to
