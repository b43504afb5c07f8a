"""Complexity of signatures: Shannon entropy of their 1- to 5-mer spectra."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The longest words counted, the largest entropy of words of one to three letters, the threshold.
LONGEST, BASE_ENTROPY, THRESHOLD = 5, 12.0, 0.65


def max_entropy(k: int) -> float:
    """The entropy that normalises the score of a k-mer."""
    return BASE_ENTROPY + sum(math.log2(k - j + 1) for j in range(4, LONGEST + 1))


_CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i


def _entropies(rows: np.ndarray) -> np.ndarray:
    """Sums of the entropies of the word spectra; rows: base codes, one string a row."""
    n, length = rows.shape
    out, code = np.zeros(n), np.zeros((n, length), np.int64)
    for j in range(1, min(LONGEST, length) + 1):
        code = code[:, : length - j + 1] * 4 + rows[:, j - 1 :]
        size = 4**j
        c = np.bincount((np.arange(n)[:, None] * size + code).ravel(), minlength=n * size).reshape(n, size)
        p = c / (length - j + 1)
        out -= np.where(c > 0, p * np.log2(np.where(c > 0, p, 1)), 0).sum(1)
    return out


@F.pandas_udf(DoubleType())
def _score(s: pd.Series) -> pd.Series:
    out = np.full(len(s), np.nan)
    sizes = s.str.len().fillna(0).astype(int).to_numpy()
    for k in np.unique(sizes[sizes > LONGEST]):
        at = np.flatnonzero(sizes == k)
        for part in np.array_split(at, len(at) // 4096 + 1):
            raw = "".join(s.iloc[part]).encode("utf-8", "replace")
            if len(raw) != k * len(part):
                continue
            rows = _CODE[np.frombuffer(raw, np.uint8)].reshape(len(part), k).astype(np.int64)
            good = (rows < 4).all(1)
            out[part[good]] = _entropies(rows[good]) / max_entropy(int(k))
    return pd.Series(out)


def entropy_score(kmer: Column | str) -> Column:
    """The summed spectrum entropy over its maximum; 0 for strings of up to five letters, null where a letter is not a base."""
    kmer = F.col(kmer) if isinstance(kmer, str) else kmer
    return F.when(F.length(kmer) <= LONGEST, F.lit(0.0)).otherwise(F.nanvl(_score(kmer), F.lit(None).cast("double")))


def is_low_complexity(kmer: Column | str, threshold: float = THRESHOLD) -> Column:
    """Whether the score is at most the threshold; always, for strings of up to five letters."""
    kmer = F.col(kmer) if isinstance(kmer, str) else kmer
    return (F.length(kmer) <= LONGEST) | (entropy_score(kmer) <= threshold)
