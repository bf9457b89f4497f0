"""Overhang texts and low-complexity masking of sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def longest_overhang(text: Column) -> Column:
    """Length of the longest sequence in '>id:SEQ(n);...', a bar at its side counted."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r":([^(]*)\("), 1), lambda s: F.length(s))), F.lit(0))


def overhang_compensates(text: Column, read_length: int) -> Column:
    """Fewer than three sequences, the longest from a quarter to four fifths of a read."""
    r = longest_overhang(text) / F.lit(float(read_length))
    return (F.size(F.regexp_extract_all(text, F.lit(r":([^(]*)\("), 1)) < 3) & r.between(0.25, 0.8)


def mismatches(a: Column, b: Column, right: Column) -> Column:
    """Differing bases of two overhangs laid from the break, over the shorter; N matches everything."""
    n = F.least(F.length(a), F.length(b))
    side = lambda x: F.split(F.when(right, F.substring(x, F.lit(1), n)).otherwise(F.right(x, n)), "")
    differ = F.zip_with(side(a), side(b), lambda x, y: F.when((x != y) & (x != "N") & (y != "N"), 1).otherwise(0))
    return F.when(n == 0, 0).otherwise(F.aggregate(differ, F.lit(0), lambda s, x: s + x))


def masked_bases(bases: np.ndarray, window: int = 64, threshold: int = 20) -> np.ndarray:
    """Whether each base is masked by symmetric DUST; bases are 0 to 3, and 4 between pieces, which no interval crosses.

    An interval is masked if its triplets score above the threshold, ten times the pairs of equal triplets over their
    number less one, and no part of it scores more, within a window. All intervals of one length are scored at once, from
    those that are a triplet shorter: the pairs of one without its first triplet, and that triplet's equals.
    """
    n = len(bases)
    if n < 3:
        return np.zeros(n, bool)
    gaps = np.r_[np.flatnonzero(bases == 4), n]
    at = np.arange(n - 2)
    room = gaps[np.searchsorted(gaps, at)] - 2 - at  # triplets from here to the piece's end
    code = (bases[:-2].astype(np.int16) << 4) + (bases[1:-1].astype(np.int16) << 2) + bases[2:]
    equal = pairs = np.zeros(n - 2, np.int64)
    most = np.zeros(n - 2)
    edges = np.zeros(n + 1, np.int64)
    for more in range(1, min(window - 2, int(room.max()))):  # triplets beside the first
        m = n - 2 - more
        equal = equal[:m] + (code[:m] == code[more:])
        pairs = pairs[1 : m + 1] + equal
        score, inner = pairs / more, np.maximum(most[:m], most[1 : m + 1])
        hit = np.flatnonzero((10 * pairs > threshold * more) & (score >= inner) & (room[:m] > more))
        edges[hit] += 1
        edges[hit + more + 3] -= 1
        most = np.maximum(score, inner)
    return np.cumsum(edges[:n]) > 0


def masked_ratios(seqs: list[str], held: int = 1 << 20) -> np.ndarray:
    """Masked share of each sequence; pieces between N are masked each, other letters are skipped; NaN if nothing is left.

    Sequences are masked together, as many at once as have about `held` letters; a longer one goes by itself.
    """
    out = np.full(len(seqs), np.nan)
    upper = [s.upper() for s in seqs]
    sizes = np.array([len(s) + 1 for s in upper], np.int64)
    block = np.cumsum(sizes) // held
    for b in np.unique(block).tolist():
        lo, hi = np.searchsorted(block, b), np.searchsorted(block, b, "right")
        letters = np.frombuffer(("N".join(upper[lo:hi]) + "N").encode("ascii", "replace"), np.uint8)
        known = _LETTERS[letters]
        row, bases = np.repeat(np.arange(hi - lo), sizes[lo:hi])[known < 5], known[known < 5]
        real = bases < 4
        total = np.bincount(row[real], minlength=hi - lo)
        hit = np.bincount(row[real & masked_bases(bases)], minlength=hi - lo)
        out[lo:hi][total > 0] = hit[total > 0] / total[total > 0]
    return out


def masked_ratio(seq: str) -> float:
    return float(masked_ratios([seq])[0])


#: A, C, G, T are 0 to 3, N is 4, and what is skipped 5.
_LETTERS = np.full(256, 5, np.uint8)
_LETTERS[np.frombuffer(b"ACGTN", np.uint8)] = np.arange(5)


@F.pandas_udf(DoubleType())
def dust_ratio(seq: pd.Series) -> pd.Series:
    return pd.Series(masked_ratios([s or "" for s in seq]))
