"""Batches in slices: what a worker makes of texts is handed on before it makes more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Characters of the texts of a slice, about; a row counts ROW at least.
SLICE_CHARS, ROW = 500_000, 100


def slices(texts: pd.Series, most: int = SLICE_CHARS) -> Iterator[pd.Series]:
    """The rows in turn, in runs of about ``most`` characters, one row at least; no row is left out or cut."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += max(ROW, len(t) if isinstance(t, str) else 0)
        if size >= most:
            yield texts.iloc[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield texts.iloc[begin:]
