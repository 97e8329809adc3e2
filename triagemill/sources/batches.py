"""Batches of rows cut by what they hold: Arrow hands over a number of rows, however large they are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Bytes or characters of a piece; one row may hold more.
PIECE = 1 << 20


def pieces(contents: pd.Series, most: int = PIECE) -> Iterator[slice]:
    """Ranges of rows that hold `most` together, or a single row that holds more."""
    start = size = 0
    for i, content in enumerate(contents):
        n = 0 if content is None else len(content)
        if i > start and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(contents):
        yield slice(start, len(contents))
