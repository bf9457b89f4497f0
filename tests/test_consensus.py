"""Sweeps over vague loci: segments against whole keys, and the reduced loci of a table."""

import random
import sys

import pandas as pd
import pytest

from locusflow.operators import consensus


def rows(seed, n=160, samples=False):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        lo = r.choice([100, 400, 3000 * r.randrange(30)]) + r.randrange(r.choice([20, 400]))
        out.append((r.choice([1, 1, 2]), r.randrange(r.choice([400, 9000])), lo, lo + r.choice([0, 0, 30, 300]), r.randrange(5), r.randrange(9), r.randrange(9)) + (([r.randrange(6)],) if samples else ()))
    return out


@pytest.mark.parametrize("samples", [None, "samples"])
def test_segments_change_nothing(spark, samples):
    names = ["key", "pos", "lo", "hi", "support", "mates", "expected", *([samples] if samples else [])]
    kinds = "key int, pos int, lo int, hi int, support int, mates int, expected int" + (", samples array<int>" if samples else "")
    split = 0
    for seed in range(4):
        data = rows(seed, samples=bool(samples))
        df = spark.createDataFrame(data, kinds)
        got = consensus.defuzz(df, ["key"], 30, 15, samples)
        whole = pd.concat([consensus.sweep(g, 30, 15, samples) for _, g in pd.DataFrame(data, columns=names).groupby("key")])
        tidy = lambda x: tuple(sorted(map(int, x)) if not isinstance(x, int) and hasattr(x, "__len__") else int(x) for x in [x])[0]
        assert sorted(str([tidy(x) for x in r]) for r in got.collect()) == sorted(str([tidy(x) for x in r]) for r in whole[names].itertuples(index=False))
        split += consensus.segments(df, ["key"], 30, 15).select("key", "segment").distinct().count() - 2
        assert len(whole) < len(data)
    assert split > 8  # keys do fall apart


def test_sessions_that_touch_over_others():
    # the third touches the first only after it has been joined to the second
    assert consensus.merged_sessions([0, 100, 20, 500], [10, 120, 101, 501], 9) == [0, 1, 1, 2]
    assert consensus.merged_sessions([0, 100, 5, 500], [10, 120, 101, 501], 9) == [0, 0, 0, 1]
    assert consensus.merged_sessions([], [], 3) == []


def test_work_follows_rows_where_loci_are_dense():
    # 100 places of 40 loci each, all within reach of each other: rows that are taken are not looked at again
    data = [(1, k % 29, 1000 * (k // 40), 1000 * (k // 40) + 30, 1, k % 7, k % 5) for k in range(4000)]
    steps = 0

    def local(frame, event, arg):
        nonlocal steps
        steps += event == "line"
        return local

    df = pd.DataFrame(data, columns=["key", "pos", "lo", "hi", "support", "mates", "expected"])
    sys.settrace(lambda frame, event, arg: local if frame.f_code.co_name == "sweep" else None)
    try:
        out = consensus.sweep(df, 30, 15)
    finally:
        sys.settrace(None)
    assert len(out) == 100 and (out["mates"] == 6).all() and (out["expected"] == 4).all()
    assert steps < 400 * len(data)
