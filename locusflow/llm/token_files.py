"""Token-id files with Re-Pair grammar compression.

Documents are sorted by identifier and written in shards. In each shard, round after round, frequent pairs of neighbouring
symbols, equal ones from left to right, are replaced by new symbols, until none comes 7 times or the symbols run out; no rule
crosses the end of a document. A round replaces all pairs that are frequent; where two of them overlap, the more frequent one
wins. Only pairs with a symbol of the round before can have become frequent, so that later rounds look at those alone, and a last
round looks at all. A shard's payload is

    b"RPF2", uint32: documents, rules, symbols, base, bytes a symbol; documents' identifiers (int64), whether they are null (uint8)
    and ids (uint32 counts, end ids included), documents' first symbols (uint32); rules (pairs), their expansion lengths (uint32); symbols

all little-endian. Symbols below base are ids, base is a document's end, and base + 1 + k is rule k, so that a document
is decoded from its own symbols alone, and lengths lead to any place within it. Symbols and the sides of rules take two bytes, or four
with vocabularies that leave too few for rules. Payloads are rows of a Parquet table in the shared folder, so that Spark commits
them and any executor reads them.

Null and empty texts are the end id alone. Null identifiers come first. Rows that repeat are kept, in any order among
themselves. A very long text is in one shard, which is then as long as it. Only identifier and text are read, whatever else the
other columns are named. An empty table gives no shards.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import library_encoder, ragged, slices, vocabulary
from .common import documents, new_path, partitions, released

SHARD_IDS = 1 << 20
SHARDS = "part int, shard int, n_ids long, payload binary"


def base_of(path: str) -> int:
    """The least number above all ids of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])


class Grammar:
    """Rules of a shard of symbols, of which those below base are ids and base is a document's end."""

    def __init__(self, base: int, least: tuple[int, ...] = (48, 7)):
        self.base, self.least = base, least
        narrow = base + 1 + 4096 <= 1 << 16
        self.kind, self.key, self.shift = (np.uint16, np.uint32, 16) if narrow else (np.uint32, np.uint64, 32)
        self.room = (1 << 16 if narrow else base + 1 + (1 << 20)) - base - 1
        self.left, self.right = np.zeros(0, self.kind), np.zeros(0, self.kind)

    def compress(self, x: np.ndarray) -> np.ndarray:
        """Symbols of x that no pair comes in often enough. A rule takes 12 bytes and saves two each time, so that it pays from 7."""
        x = x.astype(self.kind)
        for k, least in enumerate(self.least):
            since = 0  # all pairs, then those with a symbol of the round before
            while True:
                n = len(self.left)
                x = self._replaced(x, least, since)
                if len(self.left) > n:
                    since = self.base + 1 + n
                elif since and k + 1 == len(self.least):
                    since = 0
                else:
                    break
        return x

    def _replaced(self, x: np.ndarray, least: int, since: int) -> np.ndarray:
        a, b = x[:-1], x[1:]
        if since:
            at = np.flatnonzero((np.maximum(a, b) >= since) & (a != self.base) & (b != self.base))
        else:
            slot = _slots(a, b)
            at = np.flatnonzero((np.bincount(slot, minlength=1 << 20) >= least)[slot] & (a != self.base) & (b != self.base))
        if len(at) < least or len(self.left) == self.room:
            return x
        key = a[at].astype(self.key) << self.key(self.shift) | b[at]
        same = a[at] == b[at]
        if same.any():  # of a run of one symbol every other pair counts, from the left
            run = at[same]
            starts = np.flatnonzero(np.diff(run, prepend=-2) > 1)
            odd = (np.arange(len(run)) - np.repeat(starts, np.diff(starts, append=len(run)))) % 2 == 1
            stay = np.ones(len(at), bool)
            stay[np.flatnonzero(same)[odd]] = False
            at, key = at[stay], key[stay]
        pair, count = np.unique(key, return_counts=True)
        often = np.flatnonzero(count >= least)
        order = often[np.argsort(-count[often], kind="stable")][: self.room - len(self.left)]
        if not len(order):
            return x
        made = pair[order]
        table = np.full(1 << 20, len(made), np.int32)  # the rank of a pair by its slot; of pairs with one slot, the most frequent
        made_slots = _slots((made >> self.key(self.shift)).astype(self.kind), (made & self.key((1 << self.shift) - 1)).astype(self.kind))
        table[made_slots[::-1]] = np.arange(len(made), dtype=np.int32)[::-1]
        own = table[_slots(a[at], b[at])]
        met = np.append(made, self.key(0))[own] == key
        at, own = _apart(at[met], own[met])
        used = np.bincount(own, minlength=len(order))
        used[0] = max(used[0], least)  # wins wherever it is, so that each round goes on
        good = used >= least
        new = np.cumsum(good) - 1 + self.base + 1 + len(self.left)
        keep = good[own]
        at, own = at[keep], own[keep]
        out = x.copy()
        out[at] = new[own].astype(self.kind)
        made = made[good]
        self.left = np.append(self.left, (made >> self.key(self.shift)).astype(self.kind))
        self.right = np.append(self.right, (made & self.key((1 << self.shift) - 1)).astype(self.kind))
        stay = np.ones(len(x), bool)
        stay[at + 1] = False
        return out[stay]

    def expanded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return expanded(self.base, self.left, self.right)


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(2654435761) ^ b * np.uint32(40503)) >> np.uint32(12)


def _apart(at: np.ndarray, rank: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs, no two of them neighbours: of neighbours the lower rank stays. What long chains leave open after some rounds goes."""
    found, ranks = [], []
    for _ in range(rounds):
        if not len(at):
            break
        touch = np.diff(at) == 1
        lower = rank[:-1] < rank[1:]
        wins = np.ones(len(at), bool)
        wins[1:] &= ~(touch & lower)
        wins[:-1] &= ~(touch & ~lower)
        found.append(at[wins])
        ranks.append(rank[wins])
        gone = wins.copy()
        gone[1:] |= wins[:-1] & touch
        gone[:-1] |= wins[1:] & touch
        at, rank = at[~gone], rank[~gone]
    places = np.concatenate(found)
    order = np.argsort(places)
    return places[order], np.concatenate(ranks)[order]


def expanded(base: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start, size): symbol s stands for the ids from start[s], size[s] of them; the end of a document for id 0."""
    n = len(left)
    sides = np.stack([left, right]).astype(np.int64)
    size = np.concatenate([np.ones(base + 1, np.int64), np.zeros(n, np.int64)])
    layers, todo = [], np.arange(n)
    while len(todo):  # rules whose sides are known; as many rounds as rules lie in each other
        ready = (size[sides[:, todo]] > 0).all(0)
        now = todo[ready]
        size[base + 1 + now] = size[sides[:, now]].sum(0)
        layers.append(now)
        todo = todo[~ready]
    start = np.cumsum(size) - size
    ids = np.zeros(int(size.sum()), np.uint32)
    ids[:base] = np.arange(base)
    for now in layers:
        to = start[base + 1 + now]
        for side in sides[:, now]:
            m = size[side]
            ids[ragged(to, m)] = ids[ragged(start[side], m)]
            to = to + m
    return ids, start, size


def shard(doc_ids: list[int | None], docs: list[np.ndarray], base: int) -> bytes:
    """Payload of documents given as arrays of ids without the end id, 0."""
    own = Grammar(base)
    lengths = np.array([len(d) for d in docs], np.int64)
    whole = np.concatenate([np.concatenate(docs), np.zeros(1, np.uint32)]) if docs else np.zeros(1, np.uint32)
    if whole.max() >= base:
        raise ValueError(f"id {whole.max()} is not below {base}")
    x = np.full(int(lengths.sum()) + len(docs), base, np.uint32)
    x[ragged(np.cumsum(lengths + 1) - lengths - 1, lengths)] = whole[:-1]
    x = own.compress(x)
    size = own.expanded()[2][base + 1 :]
    ends = np.flatnonzero(x == base)
    first = np.concatenate([[0], ends[:-1] + 1]).astype("<u4")
    kind = "<u2" if own.kind is np.uint16 else "<u4"
    return b"RPF2" + struct.pack("<5I", len(docs), len(own.left), len(x), base, int(kind[2])) + b"".join([
        np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(), np.array([i is None for i in doc_ids], "u1").tobytes(), (lengths + 1).astype("<u4").tobytes(), first.tobytes(),
        np.stack([own.left, own.right], 1).astype(kind).tobytes(), size.astype("<u4").tobytes(), x.astype(kind).tobytes(),
    ])


class Shard:
    """Random access to the documents of a payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPF2":
            raise ValueError("not a shard")
        n, r, m, base, width = struct.unpack_from("<5I", payload, 4)
        at = 24

        def take(kind: str, many: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, many, at)
            at += out.nbytes
            return out

        kind = f"<u{width}"
        self.doc_ids, self.null, self.n_ids, self.first = take("<i8", n), take("u1", n).astype(bool), take("<u4", n), take("<u4", n)
        rules, lengths, self.symbols = take(kind, 2 * r).reshape(-1, 2), take("<u4", r), take(kind, m)
        self.flat, self.start, self.size = expanded(base, rules[:, 0], rules[:, 1])
        if not np.array_equal(self.size[base + 1 :], lengths):
            raise ValueError("a rule's length is not that of its expansion")

    def _own(self, k: int, k_end: int) -> np.ndarray:
        return self.symbols[self.first[k] : self.first[k_end] if k_end < len(self.first) else len(self.symbols)]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[symbols], self.size[symbols])]

    def ids(self, k: int, k_end: int | None = None) -> np.ndarray:
        """Ids of documents k to k_end, end ids included, from their own symbols."""
        return self._expand(self._own(k, k + 1 if k_end is None else k_end))

    def part(self, k: int, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of document k; lengths tell which symbols they are in, and only those are expanded."""
        own = self._own(k, k + 1)
        ends = np.cumsum(self.size[own])
        hi = min(hi, int(ends[-1]))
        if lo >= hi:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(ends, [lo, hi - 1], "right")
        skip = lo - int(ends[i] - self.size[own[i]])
        return self._expand(own[i : j + 1])[skip : skip + hi - lo]


def _encode(path: str, base: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(path, True), TaskContext.get().partitionId()
        names: list[int | None] = []
        docs: list[np.ndarray] = []
        held = number = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([shard(names, docs, base)], pa.binary())], names=["part", "shard", "n_ids", "payload"])

        for batch in batches:
            for own in slices(batch, 1, 8 << 20):
                for id_, ids in zip(own.column(0).to_pylist(), encoder.encode(own.column(1))):
                    names.append(id_)
                    docs.append(np.frombuffer(ids, "<u4"))
                    held += len(docs[-1]) + 1
                    if held >= SHARD_IDS:
                        yield out()
                        names, docs, held, number = [], [], 0, number + 1
        if docs:
            yield out()

    return run


def write_shards(docs: DataFrame, path: str, to: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs, in ascending order of id_col, as shards under to; file order is part, then shard."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(n, "id").sortWithinPartitions("id")
    ordered.mapInArrow(_encode(path, base_of(path)), SHARDS).write.option("compression", "none").parquet(to)


def read_shards(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as decoded from the shards under at."""
    shards = spark.read.schema(SHARDS).parquet(at)
    sizes = shards.select("part", "shard", "n_ids")
    per = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = per.select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("a"))
    within = sizes.select("part", "shard", F.expr("coalesce(sum(n_ids) over (partition by part order by shard rows between unbounded preceding and 1 preceding), 0)").alias("b"))
    begins = within.join(parts, "part").select("part", "shard", (F.col("a") + F.col("b")).alias("begin"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = Shard(payload)
                start = begin + np.cumsum(s.n_ids, dtype=np.int64) - s.n_ids
                crc = []
                for lo in range(0, len(s.n_ids), 256):
                    hi = min(lo + 256, len(s.n_ids))
                    got = memoryview(s.ids(lo, hi).astype("<u4").tobytes())
                    at = 0
                    for n in s.n_ids[lo:hi].tolist():
                        crc.append(zlib.crc32(got[at : at + 4 * n]))
                        at += 4 * n
                names = pa.array(s.doc_ids, pa.int64(), mask=s.null)
                yield pa.RecordBatch.from_arrays([names, pa.array(start, pa.int64()), pa.array(s.n_ids, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(begins, ["part", "shard"]).select("begin", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_path(spark, "token-ids")
    write_shards(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), to)
    return read_shards(spark, to)
