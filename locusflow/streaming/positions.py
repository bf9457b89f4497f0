"""Breakpoint positions of a stream of position-sorted reads, with counts, depth and mate pools; late reads come out beside them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import reads as rd
from ..functions.contigs import LAST_PARTNER

DEPTHS = ["coverage", "normal_spans", "low_spans_soft", "low_spans_hard"]
BREAKS = ["unpaired_soft", "unpaired_hard", "short_indel", "low_breaks_soft", "low_breaks_hard", "assigned"]
POOLS = ["left_coverage", "right_coverage", *DEPTHS[1:], *BREAKS[:-1], "left_pool", "right_pool"]
OUT = ", ".join(["chr_idx int", "pos long", *(f"{k} long" for k in POOLS), "late long"])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changes(kind: Column, poor: Column, start: Column, end: Column, breaks: Column) -> Column:
    """array of struct(pos, and a change for each of DEPTHS): what a read adds to the depths where it begins and takes off where it ends or breaks."""

    def at(pos: Column, sign: int, own: dict[str, Column]) -> Column:
        return F.struct(pos.cast("long").alias("pos"), *(F.when(own.get(k, F.lit(False)), sign).otherwise(0).cast("long").alias(k) for k in DEPTHS))

    good, hard = kind.isin(rd.NORMAL, rd.SOFT, rd.INDEL, rd.DISTANT), (kind == rd.HARD) & poor
    whole = {"coverage": good, "normal_spans": good, "low_spans_soft": kind == rd.LOW, "low_spans_hard": hard}
    less = {"normal_spans": kind.isin(rd.SOFT, rd.INDEL), "low_spans_soft": kind == rd.LOW, "low_spans_hard": hard}

    def lost(b: Column) -> Column:
        clipped = (b["type"] == "S") | ((b["type"] == "H") & kind.isin(rd.HARD, rd.LOW))
        n = F.when(clipped & (b["pos"] == start), 1).when(b["type"] == "D", b["size"]).otherwise(0)
        return F.when(n > 0, F.array(at(b["pos"], -1, less), at(b["pos"] + n, 1, less))).otherwise(F.array().cast("array<struct<pos:bigint," + ",".join(f"{k}:bigint" for k in DEPTHS) + ">>"))

    return F.concat(F.array(at(start, 1, whole), at(end, -1, whole)), F.flatten(F.transform(breaks, lost)))


def broken(kind: Column, poor: Column, breaks: Column) -> Column:
    """array of struct(pos, and 0 or 1 for each of BREAKS)."""

    def of(b: Column) -> Column:
        is_ = lambda *t: b["type"].isin(*t)
        soft, hard = (kind == rd.SOFT) & is_("S"), (kind == rd.HARD) & is_("H")
        rules = [soft, hard & ~poor, kind.isin(rd.SOFT, rd.INDEL) & is_("I", "D"), (kind == rd.LOW) & is_("S", "H", "I", "D"), (kind == rd.HARD) & poor & is_("S", "H", "I", "D"), soft | hard]
        return F.struct(b["pos"].cast("long").alias("pos"), *(r.cast("long").alias(k) for k, r in zip(BREAKS, rules)))

    return F.transform(breaks, of)


class Positions(StatefulProcessor):
    """State of a contig: changes of depth and breaks by position (maps), mates (list), and the depths and mark so far (value)."""

    def __init__(self, left: int, right: int) -> None:
        self.left, self.right = left, right

    def init(self, handle: StatefulProcessorHandle) -> None:
        long = lambda names: ", ".join(f"{k} bigint" for k in names)
        self.depth_at = handle.getMapState("depth_at", "pos bigint", long(DEPTHS))
        self.break_at = handle.getMapState("break_at", "pos bigint", long(BREAKS))
        self.mates = handle.getListState("mates", "start bigint, end bigint")
        self.past = handle.getValueState("past", long([*DEPTHS, "mark"]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past = self.past.get()
        base, mark = (list(past[:-1]), past[-1]) if past else ([0] * len(DEPTHS), None)
        depth_at = {k[0]: list(v) for k, v in self.depth_at.iterator()}
        break_at = {k[0]: list(v) for k, v in self.break_at.iterator()}
        mates = [tuple(m) for m in self.mates.get()]
        known, before, ended, late, last = (set(depth_at), set(break_at)), mark, False, [], mark
        for pdf in rows:
            ended |= bool(pdf["start"].isna().any())
            pdf = pdf[pdf["start"].notna()]
            old = pdf["start"] < before if before is not None else pd.Series(False, index=pdf.index)
            late += [int(x) for x in pdf["start"][old]]
            for r in pdf[~old].itertuples(index=False):
                last = int(r.start) if last is None else max(last, int(r.start))
                for store, found in ((depth_at, r.changes), (break_at, r.broken)):
                    for x in found:
                        x = list(x.values()) if isinstance(x, dict) else list(x)
                        own = store.setdefault(int(x[0]), [0] * (len(x) - 1))
                        for i, n in enumerate(x[1:]):
                            own[i] += int(n)
                if r.mate:
                    mates.append((int(r.start), int(r.end)))
        # positions that no later read can change, and the depths up to the place left of the first that one can
        open_from = (1 << 62) if ended else (last if last is not None else 0) - self.right
        done = sorted(p for p in break_at if p < open_from)
        yield pd.DataFrame(self._rows(key, done, break_at, depth_at, base, mates) + [(*key, None, *[None] * len(POOLS), x) for x in late], columns=[x.split()[0] for x in OUT.split(", ")])
        for name in ("depth_at", "break_at", "mates", "past") if ended else ():
            getattr(self, name).clear()
        if ended:
            return
        for p in done:
            break_at.pop(p)
        for p in [p for p in depth_at if p < open_from - 1]:
            base = [a + b for a, b in zip(base, depth_at.pop(p))]
        for state, values, were in ((self.depth_at, depth_at, known[0]), (self.break_at, break_at, known[1])):
            for p in were - set(values):
                state.removeKey((p,))
            for p, v in values.items():
                state.updateValue((p,), tuple(v))
        mates = [m for m in mates if m[0] >= open_from - self.left]
        self.mates.put(mates) if mates else self.mates.clear()
        if last is not None:
            self.past.update((*base, last))

    def _rows(self, key: tuple, done: list[int], break_at: dict, depth_at: dict, base: list[int], mates: list[tuple[int, int]]) -> list[tuple]:
        out, depth, order, at = [], list(base), sorted(depth_at), 0

        def upto(p: int) -> list[int]:
            nonlocal at
            while at < len(order) and order[at] <= p:
                for i, n in enumerate(depth_at[order[at]]):
                    depth[i] += n
                at += 1
            return list(depth)

        for p in done:
            *counts, assigned = break_at[p]
            if assigned:
                before, here = upto(p - 1), upto(p)
                near = [(s, e) for s, e in mates if p - self.left <= s <= p + self.right]
                pools = sum(s < p for s, _ in near), sum(s >= p or p < e for s, e in near)
                out.append((*key, p, before[0], *here, *counts, *pools, None))
        return out

    def close(self) -> None:
        pass


def stream_positions(reads: DataFrame, left: int = 303, right: int = 254) -> DataFrame:
    """Rows of OUT: positions where clipped reads break, with the counts of breakpoint_counters() and the pools of mate_pools(left, right), in append mode.

    reads: a stream of read_alignments(), sorted by position within a contig; one micro-batch's reads of a contig may come in any order. A position is given out
    once a read has begun more than `right` beyond it. State keeps what is open there: breaks and changes of depth from that place on and mates that
    may still be in a pool. A read that begins left of the last start of an earlier batch is late: it changes nothing and comes out as a row whose only value
    is late, its start. A row with a null start closes its contig: all that is left is given out, and its state goes. The state store must be
    RocksDB's (PROVIDER).
    """
    c = F.col
    poor = c("low_mapq") | c("null_mapq")
    mate = (c("read_type") == rd.DISTANT) & ~c("null_mapq") & (c("mate_chr_idx") <= LAST_PARTNER)
    rows = reads.select("chr_idx", "start", "end", changes(c("read_type"), poor, c("start"), c("end"), c("breaks")).alias("changes"), broken(c("read_type"), poor, c("breaks")).alias("broken"), F.coalesce(mate, F.lit(False)).alias("mate"))
    return rows.groupBy("chr_idx").transformWithStateInPandas(Positions(left, right), OUT, "Append", "None")
