"""Flags, mapping quality, base quality and the class of a read, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Read classes (fixed values).
NORMAL, SOFT, HARD, INDEL, DISTANT, LOW = 0, 1, 2, 3, 4, 5


def flag(flags: Column, bit: int) -> Column:
    return F.getbit(flags, F.lit(bit)) == 1


def supplementary(flags: Column) -> Column:
    return flag(flags, 11)


def forward(flags: Column) -> Column:
    return ~flag(flags, 4)


def inverted_mate(flags: Column) -> Column:
    return flag(flags, 4) == flag(flags, 5)


def mapq_class(mapq: Column) -> Column:
    """2 none, 1 low (1 to 12), 0 normal."""
    return F.when(mapq == 0, 2).when(mapq < 13, 1).otherwise(0)


def median(values: Column) -> Column:
    """Mean of the two middle values of an array; null if empty."""
    s = F.array_sort(values)
    n = F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def quality_median(qualities: Column, low: int = 12, run: int = 6) -> Column:
    """Median of an array of base qualities, -1 where a run of low ones makes the stretch unusable or it is empty."""
    marks = F.array_join(F.transform(qualities, lambda q: F.when(q < low, "l").otherwise("h")), "")
    return F.when(marks.contains("l" * run), -1.0).otherwise(F.coalesce(median(qualities), F.lit(-1.0)))


def qualities(text: Column, offset: int = 33) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - offset)


def text_median(text: Column, low: int = 12, run: int = 6, offset: int = 33) -> Column:
    """quality_median() of base qualities as the text that stores them: characters are sorted as they are, and only the two in the middle are made numbers."""
    n = F.length(text)
    many = 2 - n % 2
    middle = F.slice(F.sort_array(F.split(text, "")), F.greatest(F.lit(1), F.floor((n + 1) / 2).cast("int")), many)
    poor = text.rlike(f"[\\x00-\\x{offset + low - 1:02x}]{{{run}}}")
    return F.when((n > 0) & ~poor, F.aggregate(middle, F.lit(0), lambda s, x: s + F.ascii(x)) / many - offset).otherwise(-1.0)


def median_from(text: Column, least: int, low: int = 12, run: int = 6, offset: int = 33) -> Column:
    """Whether text_median() is `least` or more. Nothing is sorted: characters below `least` are counted, and only where they are half of all is the median itself needed."""
    n, under = F.length(text), F.length(F.regexp_replace(text, f"[^\\x00-\\x{offset + least - 1:02x}]+", ""))
    poor = text.rlike(f"[\\x00-\\x{offset + low - 1:02x}]{{{run}}}")
    told = F.transform(F.array(2 * under - n), lambda k: F.when(k < 0, True).when(k > 0, False).otherwise(text_median(text, low, run, offset) >= least))[0]
    return F.when((n > 0) & ~poor, told).otherwise(F.lit(least <= -1))


def distant_mate(rnext: Column, tlen: Column, isize_max: Column | int) -> Column:
    return (rnext != "=") | (F.abs(tlen) > isize_max)


def read_class(supp: Column, mapq: Column, chunks: Column, clip_medians: Column, full_median: Column, read_len: Column, distant: Column, clip: int = 10, quality: int = 23, low_clip: int = 5, unique_ok: Column | None = None) -> Column:
    """Class of a read. clip_medians: one value for each soft clip, in order."""
    is_s, is_h = lambda c: c["op"] == "S", lambda c: c["op"] == "H"
    n_s, n_h = F.size(F.filter(chunks, is_s)), F.size(F.filter(chunks, is_h))
    cls = mapq_class(mapq)
    clips_ok = ~((n_h >= 2) | ((n_h > 0) & (n_s > 0)) | ((cls == 2) & (n_s + n_h > 1)))
    unique = F.lit(True) if unique_ok is None else unique_ok
    soft = F.arrays_zip(F.filter(chunks, is_s).alias("c"), clip_medians.alias("m"))
    bad = lambda x: (x["c"]["n"] >= low_clip) & (x["m"] < quality)
    rescued = F.exists(soft, lambda x: (2 * x["c"]["n"] > read_len) & (x["m"] >= quality)) & ~F.exists(soft, lambda x: (x["c"]["n"] > low_clip) & (x["m"] < quality))
    near = lambda kind: F.when(distant, DISTANT).otherwise(kind)  # noqa: E731 - within the branches, so that they are gone through once
    typed = F.when(F.exists(chunks, lambda c: is_s(c) & (c["n"] >= clip)), SOFT).when(F.exists(chunks, lambda c: is_h(c) & (c["n"] >= clip)), HARD).when(F.exists(chunks, lambda c: c["op"].isin("I", "D")), near(INDEL)).otherwise(near(NORMAL))
    candidate = F.size(chunks) > 0
    return (
        F.when(candidate & supp, F.when(full_median >= quality, HARD).otherwise(LOW))
        .when(candidate & (cls == 1), F.when(rescued, SOFT).otherwise(LOW))
        .when(candidate, F.when(~clips_ok | ~unique | F.exists(soft, bad), LOW).otherwise(typed))
        .when(cls == 1, LOW).otherwise(near(NORMAL))
    )
