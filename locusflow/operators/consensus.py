"""Sequential operators that group rows by growing consensus: greedy overhang clusters and de-fuzzied partner loci."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.sequence import masked_ratio
from .intervals import gap_sessions

#: Letters of the three pieces by which sequences are found that differ in at most two letters, by the least length they are for.
PIECES = {18: 6, 9: 3}
GROUPED = StructType([StructField("children", ArrayType(ArrayType(IntegerType()))), StructField("short", ArrayType(IntegerType())), StructField("repetitive", IntegerType())])


def _alike(a: str, b: str, most: int) -> bool:
    """Whether b and the start of a differ in no more than so many letters; N is like any."""
    return a.startswith(b) or sum(x != y and x != "N" and y != "N" for x, y in zip(a, b)) <= most


class Parents:
    """Sequences, read from the break, found by any that agrees with their start but for two letters.

    Of three pieces at the start at least one then agrees letter by letter. Where a piece holds an N, or a sequence is short, all are tried.
    """

    def __init__(self, most: int = 2) -> None:
        self.most, self.texts, self.by_piece, self.wild = most, [], defaultdict(list), []

    def add(self, text: str) -> None:
        k = len(self.texts)
        self.texts.append(text)
        for least, n in PIECES.items():
            if len(text) < least or "N" in text[: 3 * n]:
                self.wild.append(k)
            for i in range(3):
                self.by_piece[n, i, text[i * n : i * n + n]].append(k)

    def of(self, text: str) -> list[int]:
        """Numbers of those that text agrees with, in order."""
        n = next((n for least, n in PIECES.items() if len(text) >= least), 0)
        if self.most > 2 or not n or "N" in text[: 3 * n]:
            near = range(len(self.texts))
        else:
            near = sorted({k for i in range(3) for k in self.by_piece.get((n, i, text[i * n : i * n + n]), ())}.union(self.wild))
        return [k for k in near if _alike(self.texts[k], text, self.most)]


def grouped_overhangs(seqs: list[str], rights: list[bool], solid: list[bool] | None = None, least: int = 20, most: int = 2) -> tuple[list[list[int]], list[int], int]:
    """(numbers of the children of each parent, its own first; numbers of those too short to be one; how many are left out as repetitive).

    Longest first, of equals in order: a sequence goes to each parent of its side that it matches with at most `most` mismatches; else it is a parent
    if it has `least` letters. solid: sequences taken whatever their complexity; others are taken if at most half of their letters is masked.
    """
    parents, places, children, short, repetitive = {True: Parents(most), False: Parents(most)}, {True: [], False: []}, [], [], 0
    for i in sorted(range(len(seqs)), key=lambda i: (-len(seqs[i]), i)):
        right = bool(rights[i])
        text = seqs[i] if right else seqs[i][::-1]
        met = parents[right].of(text)
        for k in met:
            children[places[right][k]].append(i)
        if met:
            continue
        if solid is not None and not solid[i] and not masked_ratio(seqs[i]) <= 0.5:
            repetitive += 1
        elif len(text) >= least:
            places[right].append(len(children))
            children.append([i])
            parents[right].add(text)
        else:
            short.append(i)
    return children, short, repetitive


@F.pandas_udf(GROUPED)
def _grouped(seqs: pd.Series, rights: pd.Series, solid: pd.Series) -> pd.DataFrame:
    rows = [grouped_overhangs(list(s), list(r), list(d)) for s, r, d in zip(seqs, rights, solid)]
    return pd.DataFrame({"children": [r[0] for r in rows], "short": [r[1] for r in rows], "repetitive": [r[2] for r in rows]})


def overhang_groups(seqs: Column, rights: Column, solid: Column) -> Column:
    """struct(children, short, repetitive) of grouped_overhangs(), for arrays of a position's reads."""
    return _grouped(seqs, rights, solid)


def cluster_overhangs(df: DataFrame, keys: list[str], seq: str, right: str, order: str, least: int = 20, most: int = 2) -> DataFrame:
    """keys, right, parent sequence and children (itself counted), longest first.

    Every shorter sequence goes to each parent of its side that it matches with at most `most` mismatches; one that
    matches none and has `least` letters is a parent. A position's sequences are one group, so cap them first.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        children, _, _ = grouped_overhangs(rows[seq].tolist(), rows[right].tolist(), None, least, most)
        out = pd.DataFrame([(rows[seq][x[0]], bool(rows[right][x[0]]), len(x)) for x in children], columns=["parent", "right_side", "children"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "parent", "right_side", "children"]]

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    clean = df.where(F.col(seq).isNotNull())
    return clean.groupBy(*keys).applyInPandas(run, f"{kinds}, parent string, right_side boolean, children long")


def sweep(pdf: pd.DataFrame, reach: int, pad: int, samples: str | None = None) -> pd.DataFrame:
    """The rows of one segment that survive, see defuzz(). Rows that a sweep takes are unlinked, so later ones pass over them without a look."""
    pdf = pdf.sort_values(["pos", "lo", "hi", "support"], kind="stable").reset_index(drop=True)
    at = pdf["pos"].to_numpy()
    lo_, hi_, support, mates, expected = (pdf[k].tolist() for k in ("lo", "hi", "support", "mates", "expected"))
    ids = [frozenset(x) for x in pdf[samples]] if samples else []
    n = len(pdf)
    # places just beyond reach of each row, and the rows left on both sides of it
    first, last = (np.searchsorted(at, at - reach) - 1).tolist(), np.searchsorted(at, at + reach, "right").tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = np.zeros(n, bool)
    for k in range(n):
        exact_start = lo_[k] == hi_[k] and not (samples and support[k] < 3)
        if gone[k] or exact_start:
            continue
        lo, hi, met = lo_[k], hi_[k], [k]
        low, high = lo - pad, hi + pad
        beyond, i, j = last[k], k, after[k]
        while j < n and (j < beyond or j == max(i + 1, beyond)):  # beyond reach, a row that is gone ends the sweep as well
            if lo_[j] <= high and hi_[j] >= low:
                met.append(j)
                if lo_[j] != hi_[j]:
                    lo, hi = min(lo, lo_[j]), max(hi, hi_[j])
                    low, high = lo - pad, hi + pad
            elif j >= beyond:
                break
            i, j = j, after[j]
        beyond, i, j = first[k], k, before[k]
        while j >= 0 and (j > beyond or j == min(i - 1, beyond)):
            if lo_[j] <= high and hi_[j] >= low:
                met.append(j)
                if lo_[j] != hi_[j]:
                    lo, hi = min(lo, lo_[j]), max(hi, hi_[j])
                    low, high = lo - pad, hi + pad
            elif j <= beyond:
                break
            i, j = j, before[j]
        exact = [j for j in met if lo_[j] == hi_[j]]
        rank = (lambda j: (len(ids[j]), -j)) if samples else (lambda j: (support[j] if exact else mates[j], -j))
        best = max(exact or met, key=rank)
        mates[best], expected[best] = max(mates[j] for j in met), max(expected[j] for j in met)
        if samples:
            ids[best] = frozenset().union(*(ids[j] for j in met))
        if not exact:
            lo_[best], hi_[best] = lo, hi
        for j in met:
            if j != best:
                gone[j] = True
                a, b = before[j], after[j]
                if a >= 0:
                    after[a] = b
                if b < n:
                    before[b] = a
    out = pdf.assign(lo=lo_, hi=hi_, support=support, mates=mates, expected=expected)
    if samples:
        out[samples] = pd.Series([sorted(x) for x in ids], index=out.index, dtype=object)
    return out[~gone]


def merged_sessions(lo: list[int], hi: list[int], pad: int) -> list[int]:
    """Segment number of each session, in order: neighbours whose ranges touch within `pad` are one segment, whose range is that of both."""
    stack: list[list[int]] = []
    for k in range(len(lo)):
        stack.append([k, lo[k], hi[k]])
        while len(stack) > 1 and stack[-1][1] <= stack[-2][2] + pad and stack[-1][2] >= stack[-2][1] - pad:
            _, a, b = stack.pop()
            stack[-1][1:] = [min(a, stack[-1][1]), max(b, stack[-1][2])]
    first = np.zeros(len(lo), int)
    first[[s[0] for s in stack]] = 1
    return (np.cumsum(first) - 1).tolist()


def segments(df: DataFrame, keys: list[str], reach: int, pad: int) -> DataFrame:
    """df with segment: no sweep that starts in one segment of a key gets into another.

    A sweep passes on to a row that lies within `reach` of its start or touches the range it has gathered. So rows more than `reach` apart belong together
    only if what lies on one side may touch the other: sessions with such gaps are joined to their neighbours while their ranges touch. Sessions are made
    of positions with the range of their rows, so that rows are only dealt to their position. Only the sessions' ranges of a key are one task's work;
    there are no more of them than reaches in a contig.
    """
    spots = df.groupBy(*keys, "pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    parted = gap_sessions(spots, keys, "pos", reach, width=1 << 16)
    ranges = parted.groupBy(*keys, "session").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session")
        return pdf[[*keys, "session"]].assign(segment=merged_sessions(pdf["lo"].tolist(), pdf["hi"].tolist(), pad))

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    named = ranges.groupBy(*keys).applyInPandas(run, f"{kinds}, session long, segment long")
    of_spot = parted.join(named, [*keys, "session"]).select(*(F.col(k).alias(f"__{k}") for k in (*keys, "pos")), "segment")
    on = F.col("pos").eqNullSafe(F.col("__pos"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return df.join(of_spot, on).select(*df.columns, "segment")


def defuzz(df: DataFrame, keys: list[str], reach: int, pad: int, samples: str | None = None) -> DataFrame:
    """Partner loci at neighbouring positions that tell of one partner, reduced to one.

    Columns: keys (contig of the position, contig and side of the partner), pos, lo, hi (equal if exact), support, mates,
    expected. From each fuzzy locus, in order, the sweep goes outward while neighbours match the growing range or lie within
    `reach` of the start. The best exact locus survives, else the one with most mates with the range; it takes the largest
    mates and expected. A key's rows are split into segments that no sweep leaves; each is a group of its own.

    samples: a panel's array of sample numbers. Then loci with fewer than three splits are swept from too, the best is the one of most samples, and the survivor
    gets the samples of all that were met.
    """
    schema, columns = df.schema, df.columns
    return segments(df, keys, reach, pad).groupBy(*keys, "segment").applyInPandas(lambda pdf: sweep(pdf[columns], reach, pad, samples), schema)
