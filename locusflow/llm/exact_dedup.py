"""Exact deduplication by a log-structured merge index.

Each task holds a memtable from digest to text. A hit on a digest is compared byte for byte with the text held; a full
memtable is flushed as a run of rows sorted by digest, with a Bloom filter for each bucket of digests. Compaction merges the runs
of a bucket two by two, level by level: a digest that the filter of the other run does not have is new there, the others are
looked up, and the smallest identifier is kept. Digests found in several runs are hits
too: the texts that stand for them are read again and compared, and if they differ, the full SHA-256 takes the place of the key.

A hot text is one row per run before anything is shuffled. A row finds its result through its entry (a run's slot), so a
join key never has more rows than a memtable holds.

Null texts count as empty. Null identifiers sort last. Of rows that repeat identifier and text, one stays. A very long text fills a
memtable alone. Other columns are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, maybe_in, partitions, split_by, trimmed, written

RUN_SCHEMA = "id long, bucket int, run long, digest binary, text_sha256 binary, entry long, rep_id long, is_rep boolean, n long, filter binary"
COMPACTED = "entry long, digest binary, rep_id long, keep_entry long, keep_id long, group_size long, hit boolean"


def normalise(text: str | None) -> bytes:
    """Every run of white space as one space, in UTF-8."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return raw
    ws = b" \t\n\x0b\x0c\r"
    body = b" ".join(raw.split())
    if not body:
        return b" "
    return (b" " if raw[0] in ws else b"") + body + (b" " if raw[-1] in ws else b"")


def normalised(col):
    """normalise() as a column."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), SPACE, " ")


def _numbers(digests: list[bytes]) -> np.ndarray:
    """Digests as rows of two numbers that sort as they do."""
    return np.frombuffer(b"".join(d.ljust(16, b"\0") for d in digests), ">u8").astype(np.uint64).reshape(-1, 2)


class DigestFilter:
    """Bloom filter of digests: two probes into a bitmap of about ten bits a digest."""

    def __init__(self, digests: np.ndarray | None = None, packed: bytes | None = None):
        if packed is not None:
            self.bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
            return
        self.bits = np.zeros(1 << max(6, (10 * len(digests)).bit_length()), bool)
        for at in self._places(digests):
            self.bits[at] = True

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.uint64(len(self.bits))
        return digests[:, 0] % size, (digests[:, 1] ^ digests[:, 0] >> np.uint64(17)) % size

    def maybe(self, digests: np.ndarray) -> np.ndarray:
        a, b = self._places(digests)
        return self.bits[a] & self.bits[b]

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()


def _flush(digest_bytes: int, memtable_bytes: int, buckets: int):
    names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, number = part << 36, part << 24
        table: dict[bytes, list[int]] = {}
        texts, best, counts, rows, held = [], [], [], [], 0

        def flushed():
            bucket = [int.from_bytes(r[1][:8], "big") % buckets for r in rows]
            order = sorted(range(len(rows)), key=lambda i: (bucket[i], rows[i][1], rows[i][3]))
            out: list[tuple] = []
            own: dict[int, list[bytes]] = {}
            for i in order:
                id_, digest, sha, slot = rows[i]
                rep = best[slot] == i
                if rep:
                    own.setdefault(bucket[i], []).append(digest)
                out.append((id_, bucket[i], number, digest if rep else None, sha, first + slot, rows[best[slot]][0], rep, counts[slot] if rep else 0, None))
            out += [(None, k, number, None, None, None, None, False, 0, DigestFilter(_numbers(ds)).packed()) for k, ds in own.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                norm = normalise(text)
                sha = hashlib.sha256(norm).digest()
                digest = sha[:digest_bytes]
                slots = table.setdefault(digest, [])
                slot = next((s for s in slots if texts[s] == norm), None)
                if slot is None:
                    slot = len(texts)
                    slots.append(slot)
                    texts.append(norm)
                    best.append(len(rows))
                    counts.append(0)
                    held += len(norm) + 200
                elif id_ is not None and (rows[best[slot]][0] is None or id_ < rows[best[slot]][0]):
                    best[slot] = len(rows)
                counts[slot] += 1
                rows.append((id_, digest, sha, slot))
                held += 150
                if held > memtable_bytes:
                    yield flushed()
                    first, number = first + len(texts), number + 1
                    table, texts, best, counts, rows, held = {}, [], [], [], [], 0
        if rows:
            yield flushed()

    return run


class Run:
    """Sorted digests with the best entry, rows and entries of each, and a filter."""

    def __init__(self, digest: np.ndarray, last: np.ndarray, rep: np.ndarray, entry: np.ndarray, n: np.ndarray, entries: np.ndarray, filter_: DigestFilter | None = None):
        order = np.lexsort((entry, rep, last, digest[:, 1], digest[:, 0]))
        d = digest[order]
        at = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]).any(1)])
        best = order[at]  # a smaller identifier first, then the entry
        self.digest, self.last, self.rep, self.entry = d[at], last[best], rep[best], entry[best]
        self.n, self.entries = np.add.reduceat(n[order], at), np.add.reduceat(entries[order], at)
        self.filter = filter_ or DigestFilter(self.digest)

    def find(self, digest: np.ndarray) -> np.ndarray:
        """Place of each digest, -1 where it isn't."""
        at = np.searchsorted(self.digest[:, 0], digest[:, 0])
        out = np.full(len(digest), -1)
        open_ = np.arange(len(digest))
        while len(open_):  # more than once only where first halves agree
            k = at[open_]
            inside = k < len(self.digest)
            open_, k = open_[inside], k[inside]
            same = self.digest[k, 0] == digest[open_, 0]
            open_, k = open_[same], k[same]
            hit = self.digest[k, 1] == digest[open_, 1]
            out[open_[hit]] = k[hit]
            open_ = open_[~hit]
            at[open_] += 1
        return out

    def with_(self, other: Run) -> Run:
        """Both runs as one. Only digests that this run's filter may have are looked up."""
        maybe = np.flatnonzero(self.filter.maybe(other.digest))
        at = self.find(other.digest[maybe])
        mine, theirs = at[at >= 0], maybe[at >= 0]
        better = np.array([(a, b, c) > (d, e, f) for a, b, c, d, e, f in zip(self.last[mine], self.rep[mine], self.entry[mine], other.last[theirs], other.rep[theirs], other.entry[theirs])], bool)
        for name in ("last", "rep", "entry"):
            getattr(self, name)[mine[better]] = getattr(other, name)[theirs[better]]
        self.n[mine] += other.n[theirs]
        self.entries[mine] += other.entries[theirs]
        new = np.ones(len(other.digest), bool)
        new[theirs] = False
        join = lambda name: np.concatenate([getattr(self, name), getattr(other, name)[new]])
        return Run(*map(join, ("digest", "last", "rep", "entry", "n", "entries")))


def _compact(group: pa.Table) -> pa.Table:
    """Merge the runs of one digest bucket; a row for each entry."""
    filters = {r: f for r, f in zip(group.column("run").to_pylist(), group.column("filter").to_pylist()) if f is not None}
    rows = group.filter(group.column("filter").is_null()).sort_by("run")
    digests = rows.column("digest").to_pylist()
    digest, entry, n, number = _numbers(digests), *(rows.column(k).to_numpy() for k in ("entry", "n", "run"))
    last, rep = rows.column("rep_id").is_null().to_numpy(), rows.column("rep_id").fill_null(0).to_numpy()
    runs = []
    for k, lo, hi in zip(names := np.unique(number), np.searchsorted(number, names), np.searchsorted(number, names, "right")):
        runs.append(Run(digest[lo:hi], last[lo:hi], rep[lo:hi], entry[lo:hi], n[lo:hi], np.ones(hi - lo, np.int64), DigestFilter(packed=filters[k])))
    while len(runs) > 1:
        runs = [a.with_(b) for a, b in zip(runs[::2], runs[1::2])] + ([runs[-1]] if len(runs) % 2 else [])
    at = runs[0].find(digest)
    keep, of, many, hits = runs[0].entry[at], runs[0].rep[at], runs[0].n[at], runs[0].entries[at]
    return pa.table([pa.array(entry), pa.array(digests, pa.binary()), rows.column("rep_id").combine_chunks(), pa.array(keep), pa.array(of, mask=runs[0].last[at]), pa.array(many), pa.array(hits > 1)], names=["entry", "digest", "rep_id", "keep_entry", "keep_id", "group_size", "hit"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 16, memtable_bytes: int = 48 << 20) -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    digest_bytes is the length of the index key; a shorter one only means more byte comparisons.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = 4 * partitions(spark)
    made = written(plain.mapInArrow(_flush(digest_bytes, memtable_bytes, buckets), RUN_SCHEMA), "runs")
    runs = made.where("filter is null")
    reps = made.where("is_rep or filter is not null").select("bucket", "run", "digest", "entry", "rep_id", "n", "filter")
    index = written(reps.groupBy("bucket").applyInArrow(_compact, COMPACTED), "index")

    hits = index.where("hit")
    ids = hits.select(F.explode(F.array("rep_id")).alias("id")).where("id is not null")
    texts = maybe_in(plain, "id", ids, "id").select("id", normalised(F.col("text")).alias("norm"), F.substring(F.unhex(F.sha2(normalised(F.col("text")), 256)), 1, digest_bytes).alias("digest"))
    read = texts.join(hits.select(F.col("rep_id").alias("id"), "digest").distinct(), ["id", "digest"])
    differ = written(read.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("digest"), "differ")
    if not differ.isEmpty():
        index = written(_by_text(plain, runs, index, differ, digest_bytes), "index")
    found = index.select("entry", "keep_entry", "keep_id", "group_size")
    return runs.join(found, "entry").select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("is_rep") & (F.col("entry") == F.col("keep_entry"))).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))


def _by_text(plain: DataFrame, runs: DataFrame, index: DataFrame, differ: DataFrame, digest_bytes: int) -> DataFrame:
    """Where texts of one digest differ, entries are grouped by the full SHA-256 of their texts."""
    reps = runs.where("is_rep").select("entry", "text_sha256", "n", "rep_id").join(index.select("entry", "digest"), "entry").join(differ, "digest", "left_semi")
    first = F.min(F.struct(F.col("rep_id").isNull().alias("last"), "rep_id", "entry"))
    groups = reps.groupBy("digest", "text_sha256").agg(first.alias("f"), F.sum("n").alias("group_size"))
    again = reps.join(groups, ["digest", "text_sha256"]).select("entry", "digest", "rep_id", F.col("f.entry").alias("keep_entry"), F.col("f.rep_id").alias("keep_id"), "group_size", F.lit(True).alias("hit"))
    return index.join(differ, "digest", "left_anti").select(again.columns).unionByName(again)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without copies, with all its columns.

    Rows whose identifier is surely not among those of copies pass where they are; only the others are joined by identifier
    and text. Where copies are too many for a filter of bounded size, all rows are.
    """
    key = lambda id_, sha: F.concat_ws("/", id_, sha)
    found = written(exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("id"), "kept", F.col("text_sha256").alias("sha")), "kept")
    gone = found.where("not kept").select("id")
    # the documents go along as one column, so that theirs may have any names
    sure, rest = split_by(docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id")), "id", gone, "id")
    _, stay = split_by(found.where("kept").select("id", "sha"), "id", gone, "id")
    rest = rest.select("doc", key(F.col("id"), F.sha2(normalised(F.col("doc")[text_col]), 256)).alias("key")).dropDuplicates(["key"])
    rest = rest.join(stay.select(key(F.col("id"), F.col("sha")).alias("key")), "key", "left_semi").select("doc.*")
    return rest if sure is None else sure.select("doc.*").unionByName(rest)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
