"""Word alignment of an extracted and a rendered text by longest common subsequence."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_WORD = re.compile(r"[^\W_]+")
PAIRS = ArrayType(StructType([StructField("e", StringType()), StructField("v", StringType())]))


def word_sequence(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def mismatches(extracted: str | None, visual: str | None) -> list[tuple[str, str]]:
    """Replaced words: those left over between two matches, paired in order.  Of equal choices a deletion goes first."""
    a, b = word_sequence(extracted), word_sequence(visual)
    if not a or not b:
        return []
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in a])
    y = np.array([ids.setdefault(w, len(ids)) for w in b])
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:  # a common prefix never changes the pairing
        start += 1
    x, y = x[start:], y[start:]
    n, m = len(x), len(y)
    # length[j]: of the subsequence of x[i:] and y[j:]; a row follows from the one below by a running maximum.  Only a bit for
    # each cell is kept: whether leaving out x[i] is as good as leaving out y[j]
    below = np.zeros(m + 1, np.uint32)
    skip = np.zeros((n, (m + 7) // 8), np.uint8)
    for i in range(n - 1, -1, -1):
        step = np.maximum(below[:m], np.where(y == x[i], below[1:] + 1, 0))
        row = np.zeros(m + 1, np.uint32)
        row[:m] = np.maximum.accumulate(step[::-1])[::-1]
        skip[i] = np.packbits(below[:m] >= row[1:])
        below = row
    out, gone, come = [], [], []
    i = j = 0
    a, b = a[start:], b[start:]

    def flush() -> None:
        out.extend(zip(gone, come))
        gone.clear()
        come.clear()

    while i < n and j < m:
        if x[i] == y[j]:
            flush()
            i, j = i + 1, j + 1
        elif skip[i, j >> 3] >> (7 - (j & 7)) & 1:
            gone.append(a[i])
            i += 1
        else:
            come.append(b[j])
            j += 1
    gone.extend(a[i:])
    come.extend(b[j:])
    flush()
    return out


@F.pandas_udf(PAIRS)
def word_mismatches(extracted: pd.Series, visual: pd.Series) -> pd.Series:
    return pd.Series([[{"e": e, "v": v} for e, v in mismatches(x, y)] for x, y in zip(extracted, visual)])
