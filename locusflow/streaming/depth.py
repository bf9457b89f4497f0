"""Coverage of a stream of position-sorted reads: positions are given out once no later read can change them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

STATE = "pos array<bigint>, delta array<bigint>, depth bigint, mark bigint"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pos, delta, depth, mark = state.get if state.exists else ([], [], 0, None)
    change = dict(zip(pos, delta))
    ended, latest = False, mark
    for rows in batches:
        ended |= bool(rows["end"].isna().any())
        rows = rows.dropna()
        if mark is not None:
            rows = rows[rows["start"] >= mark]
        rows = rows[rows["end"] > rows["start"]].astype({"start": "int64", "end": "int64"})
        if len(rows):
            latest = int(rows["start"].max()) if latest is None else max(latest, int(rows["start"].max()))
            for column, sign in (("start", 1), ("end", -1)):
                for p, n in rows[column].value_counts().items():
                    change[int(p)] = change.get(int(p), 0) + sign * int(n)
    order = sorted(change)
    done = order if ended else [p for p in order if latest is not None and p < latest]
    out = []
    for p in done:
        depth += change[p]
        out.append((*key, p, depth))
    if ended:
        state.remove()
    else:
        rest = order[len(done) :]
        state.update((rest, [change[p] for p in rest], depth, latest))
    yield pd.DataFrame(out, columns=["contig", "pos", "depth"])


def stream_coverage(reads: DataFrame) -> DataFrame:
    """contig, pos, depth of a stream with contig, start and end; in append mode.

    A contig's watermark is the largest start seen in the batches before and in this one: positions below it are given out, and
    state keeps only the changes at and after it, so it is as large as the reads that are open there. Reads that begin below
    the watermark of an earlier batch are late and dropped. A row without an end closes its contig: all its positions are given
    out and its state goes. A contig without such a row keeps its last positions.
    """
    kind = reads.schema["contig"].dataType.simpleString()
    return reads.select("contig", "start", "end").groupBy("contig").applyInPandasWithState(_step, f"contig {kind}, pos bigint, depth bigint", STATE, "append", "NoTimeout")
