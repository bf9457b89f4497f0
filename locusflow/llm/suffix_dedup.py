"""Removal of byte strings of a fixed length that occur more than once, by suffixes sorted with bucket-pointer refinement.

Every window of `length` bytes has one anchor: the q-gram in it with the least hash, the leftmost of equals. Equal windows
have the same anchor at the same place, so only suffixes that start at anchors need sorting.

1. Texts that are equal are one class. 2. Anchors go to q-gram buckets; buckets of one anchor end here. 3. Anchors in larger
buckets bring the bytes of their windows. Where a task has the same bytes twice, it notes the windows as repeated and
sends one of the two. 4. In a bucket, what stands right and left of the anchors is sorted: eight-byte words get bucket
identifiers, and buckets of 1, 2, 4, ... words are refined by sorting on the identifiers of the bucket some words later,
those of the last round serving all offsets. With the lengths that neighbours share, a window at distance d left of its
anchor is repeated if another suffix has the same d bytes on the left and the same length - d bytes on the right. Bytes
are compared, not hashes. 5. Windows of a class are merged into spans.

A text that has a copy is removed whole if it has one window at least. Null texts count as empty; texts shorter than a
window stay, very long ones are searched whole. Rows that repeat are copies of each other. Null identifiers are kept. Only identifier and
text are read, so that other columns may be named as they like. An empty table gives an empty result. A q-gram's contexts are sorted in one
task, 351 bytes each, after each task has sent equal ones once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import slices
from .common import documents, dropped, maybe_in, partitions, trimmed, written

_TABLE = np.frombuffer(hashlib.shake_256(b"bytes").digest(8 * 256), "<u8")
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class Anchors:
    """Anchors of a text and the windows each serves."""

    def __init__(self, length: int, q: int):
        self.length, self.q = length, q
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            m = 1 << n.bit_length()
            for name, b in (("powers", _BASE), ("inverses", _INVERSE)):
                x = np.full(m, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def of(self, raw: bytes) -> tuple[np.ndarray, ...]:
        """Place, hash, first and last window start of each anchor."""
        n, q = len(raw), self.q
        if n < self.length:
            return tuple(np.zeros(0, np.uint64 if k == 1 else np.int64) for k in range(4))
        self._grow(n + 1)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[np.frombuffer(raw, np.uint8)] * self.powers[:n], out=s[1:])
        h = (s[q:] - s[:-q]) * self.inverses[: n - q + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        packed = h >> np.uint64(32) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
        w = self.length - q + 1
        whole = -(-len(packed) // w) * w
        padded = np.full(whole, np.iinfo(np.uint64).max)
        padded[: len(packed)] = packed
        ahead = np.minimum.accumulate(padded.reshape(-1, w), axis=1).ravel()
        behind = np.minimum.accumulate(padded.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - self.length + 1
        at = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        place = at[first]
        return place, h[place], first, np.r_[first[1:] - 1, m - 1]


def bucket_refine(words: np.ndarray) -> np.ndarray:
    """Ranks of rows of big-endian words: how many rows come before a row's bucket.

    Buckets of 1, 2, 4, ... words; each round's identifiers serve all offsets, and only rows that share their bucket with others go on.
    """

    def named(*keys: np.ndarray) -> np.ndarray:
        flat = keys[0].ravel() if len(keys) == 1 else keys[0].astype(np.uint64).ravel() << np.uint64(32) | keys[1].astype(np.uint64).ravel()
        return np.unique(flat, return_inverse=True)[1].reshape(keys[0].shape)

    n, width = words.shape
    rank, rows, ids, h = np.zeros(n, np.int64), np.arange(n), named(words), 1
    while len(rows):
        order = np.lexsort((ids[:, 0], rank[rows]))
        old, new = rank[rows][order], ids[order, 0]
        bucket = np.r_[True, old[1:] != old[:-1]]
        part = bucket | np.r_[True, new[1:] != new[:-1]]
        at = np.arange(len(rows))
        start, first = np.maximum.accumulate(np.where(part, at, 0)), np.maximum.accumulate(np.where(bucket, at, 0))
        rank[rows[order]] = old + start - first
        size = np.bincount(start, minlength=len(rows))[start]
        open_ = np.sort(order[size > 1])
        rows, ids = rows[open_], ids[open_]
        if h == width or not len(rows):
            break
        step = min(h, width - h)  # the last round's halves overlap
        keep = 1 if step < h or 2 * h == width else width - 2 * h + 1
        ids, h = named(ids[:, :keep], ids[:, step : step + keep]), h + step
    return rank


def shared_depth(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes within their groups, and how many bytes each shares with the one before it, -1 at a group's start."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    order = np.lexsort((bucket_refine(padded.view(">u8").astype(np.uint64)), group))
    lcp = np.full(len(rows), -1, np.int64)
    for lo in range(1, len(rows), 4096):
        a, b = rows[order[lo - 1 : lo + 4095][: len(rows) - lo]], rows[order[lo : lo + 4096]]
        differ = a != b
        lcp[lo : lo + 4096] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    same = np.r_[False, group[order[1:]] == group[order[:-1]]]
    lcp[~same] = -1
    return order, lcp


def repeated(left: np.ndarray, right: np.ndarray, group: np.ndarray, near: np.ndarray, far: np.ndarray, sure: np.ndarray, length: int) -> np.ndarray:
    """rows x distances: whether the window that starts that far left of the anchor occurs in another row of its group.

    left: bytes before the anchor, nearest first; right: from it on; windows of a row lie near to far bytes left. sure:
    rows that stand for two occurrences.
    """
    n = len(group)
    lo, l_lcp = shared_depth(left, group)
    ro, r_lcp = shared_depth(right, group)
    out = np.zeros((n, left.shape[1] + 1), bool)
    back_l, back_r = np.empty(n, np.int64), np.empty(n, np.int64)
    back_l[lo] = back_r[ro] = np.arange(n)
    for d in range(int(near.min()), int(far.max()) + 1):
        at = np.flatnonzero((near <= d) & (d <= far))
        if not len(at):
            continue
        bl = np.cumsum(l_lcp < d)[back_l[at]]
        br = np.cumsum(r_lcp < length - d)[back_r[at]]
        _, inverse, count = np.unique(bl * (n + 1) + br, return_inverse=True, return_counts=True)
        out[at, d] = (count[inverse] > 1) | sure[at]
    return out


def _hashes(held: int = 500_000):
    """A row for each document. An entry stands for equal texts that a task has seen; their hash is in the first of its rows."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: dict[bytes, int] = {}
        first = TaskContext.get().partitionId() << 36
        for whole in batches:
            for b in slices(whole):
                rows = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    sha = hashlib.sha256(raw).digest()
                    entry = entries.get(sha)
                    new = entry is None
                    if new:
                        if len(entries) == held:
                            entries.clear()
                        entry = entries[sha] = first
                        first += 1
                    rows.append((i, entry, len(raw), sha if new else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["id", "entry", "n_bytes", "sha"])

    return run


def _post(length: int, q: int, parts: int):
    """Packed anchors by part of their hash: hash, class (as a number), place."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, held, size = Anchors(length, q), set(), [], 0

        def out():
            h, c, p = (np.concatenate(x) for x in zip(*held))
            part = (h % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            rows = np.split(by, np.flatnonzero(np.diff(part[by])) + 1)
            return pa.RecordBatch.from_arrays([pa.array([int(part[i[0]]) for i in rows], pa.int32()), pa.array([h[i].astype("<u8").tobytes() + c[i].tobytes() + p[i].astype("<i8").tobytes() for i in rows], pa.binary())], names=["part", "anchors"])

        for b in batches:
            for t in b.column(1).to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                sha = hashlib.sha256(raw).digest()
                if sha in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(sha)
                place, h, _, _ = own.of(raw)
                held.append((h, np.full(len(h), np.frombuffer(sha, "V32")[0], "V32"), place))
                size += len(h)
            if size > 400_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Places of the anchors whose q-gram has others, by class."""
    cols: list[list] = [[], [], []]
    for x in group.column("anchors").to_pylist():
        n = len(x) // 48
        for c, kind, at in zip(cols, ("<u8", "V32", "<i8"), (0, 8 * n, 40 * n)):
            c.append(np.frombuffer(x, kind, n, at))
    h, c, p = (np.concatenate(x) for x in cols)
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    c, p = c[at], p[at]
    key = np.frombuffer(c.tobytes(), ">u8").reshape(-1, 4)
    by = np.lexsort((p, key[:, 1], key[:, 0]))
    c, p, key = c[by], p[by], key[by]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(p) else np.zeros(0, int)
    pieces = np.split(p, new[1:]) if len(p) else []
    return pa.table([pa.array([c[i].tobytes() for i in new], pa.binary()), pa.array([np.unique(x).astype("<i8").tobytes() for x in pieces], pa.binary())], names=["sha", "places"])


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans."""
    by = np.argsort(starts, kind="stable")
    s, e = starts[by], np.maximum.accumulate(ends[by])
    new = np.r_[True, s[1:] > e[:-1]]
    first = np.flatnonzero(new)
    return s[first], e[np.r_[first[1:] - 1, len(s) - 1]]


def _packed_spans(s: np.ndarray, e: np.ndarray) -> bytes:
    return np.stack([s, e], 1).astype("<i8").tobytes()


def _contexts(length: int, q: int, parts: int):
    """kind 0: packed contexts by part; kind 1: spans of a class, from contexts that this task has twice."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unzip, zip_ = Anchors(length, q), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        names = ["kind", "part", "sha", "payload"]
        held: dict[tuple, list] = {}
        size, last, spans = 0, None, []

        def out():
            rows: dict[int, list] = {}
            for (h, ctx, back, lo_hi), (sha, start, sure) in held.items():
                rows.setdefault(h % parts, []).append((h, sha, start, back, lo_hi, sure, ctx))
            part, payload = [], []
            for k, xs in rows.items():
                head = np.array([(x[0], x[2], x[3], x[4], len(x[6]), x[5]) for x in xs], "u8,i8,i4,i4,i4,i4").tobytes()
                part.append(k)
                payload.append(zip_.compress(np.int64(len(xs)).tobytes() + head + b"".join(x[1] for x in xs) + b"".join(x[6] for x in xs)))
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(part, pa.int32()), pa.nulls(n, pa.binary()), pa.array(payload, pa.binary())], names=names)
            n = len(spans)
            yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.array([x[0] for x in spans], pa.binary()), pa.array([x[1] for x in spans], pa.binary())], names=names)

        for b in batches:
            for sha, text, places in zip(*(b.column(i).to_pylist() for i in range(3))):
                if sha == last:  # copies follow each other
                    continue
                last = sha
                raw = unzip.decompress(text)
                place, h, first, end = own.of(raw)
                lists = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in places]))
                at = np.flatnonzero(np.isin(place, lists))
                twice = []
                for p, k, s, e in zip(place[at].tolist(), h[at].tolist(), first[at].tolist(), end[at].tolist()):
                    ctx = raw[s : e + length]
                    key = (k, ctx, p - s, e - s)
                    old = held.get(key)
                    if old is None:
                        held[key] = [sha, s, 0]
                        size += len(ctx) + 150
                    else:
                        if not old[2]:
                            old[2] = 1
                            spans.append((old[0], _packed_spans(np.array([old[1]]), np.array([old[1] + len(ctx)]))))
                        twice.append((s, e + length))
                if twice:
                    x = np.array(twice)
                    spans.append((sha, _packed_spans(*_spans(x[:, 0], x[:, 1]))))
                if size > 48 << 20:
                    yield from out()
                    held, size, spans = {}, 0, []
        if held or spans:
            yield from out()

    return run


def _find(length: int, q: int):
    """Spans of repeated windows of one part, by class. Groups are taken in blocks of whole buckets."""

    def run(group: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        heads, shas, texts = [], [], []
        for x in group.column("payload").to_pylist():
            raw = unzip.decompress(x)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            head = np.frombuffer(raw, "u8,i8,i4,i4,i4,i4", n, 8)
            at = 8 + head.nbytes
            shas.append(np.frombuffer(raw, "V32", n, at))
            at += 32 * n
            ends = at + np.cumsum(head["f4"], dtype=np.int64)
            heads.append(head)
            texts += [raw[a:b] for a, b in zip((ends - head["f4"]).tolist(), ends.tolist())]
        head, sha = np.concatenate(heads), np.concatenate(shas)
        order = np.argsort(head["f0"], kind="stable")
        h = head["f0"][order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        bounds = np.r_[starts, len(h)]
        found_sha, found = [], []
        at = 0
        reach = length - q
        while at < len(starts):  # blocks of about 8192 contexts
            end = at + 1
            while end < len(starts) and bounds[end + 1] - bounds[at] <= 8192:
                end += 1
            idx = order[bounds[at] : bounds[end]]
            at = end
            n = len(idx)
            left, right = np.zeros((n, reach), np.uint8), np.zeros((n, length), np.uint8)
            for k, i in enumerate(idx.tolist()):
                t, back = texts[i], int(head["f2"][i])
                a, b = t[:back][::-1], t[back : back + length]
                left[k, : len(a)] = np.frombuffer(a, np.uint8)
                right[k, : len(b)] = np.frombuffer(b, np.uint8)
            bucket = np.unique(head["f0"][idx], return_inverse=True)[1]
            far = head["f2"][idx].astype(np.int64)  # the first window starts farthest left
            near = far - head["f3"][idx]
            hit = repeated(left, right, bucket, near, far, head["f5"][idx].astype(bool), length)
            row, d = np.nonzero(hit)
            if not len(row):
                continue
            s = head["f1"][idx][row] + far[row] - d
            cuts = np.flatnonzero(np.diff(row)) + 1
            for r, x in zip(np.r_[row[:1], row[cuts]].tolist(), np.split(s, cuts)):
                found_sha.append(sha[idx[r]].tobytes())
                found.append(_packed_spans(*_spans(x, x + length)))
        return pa.table([pa.array(found_sha, pa.binary()), pa.array(found, pa.binary())], names=["sha", "spans"])

    return run


@trimmed
def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for whole in batches:
        for b in slices(whole):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), pa.array([z.compress(x) for x in raw], pa.binary())], names=["sha", "text"])


@trimmed
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip, last = zstandard.ZstdDecompressor(), None
    for b in batches:
        rows = []
        for sha, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
            if sha == last:
                continue
            last = sha
            raw = unzip.decompress(text)
            x = np.concatenate([np.frombuffer(s, "<i8").reshape(-1, 2) for s in spans])
            s, e = _spans(x[:, 0], x[:, 1])
            kept, at = [], 0
            for i, j in zip(s.tolist(), e.tolist()):
                kept.append(raw[at:i])
                at = j
            kept.append(raw[at:])
            rows.append((sha, _packed_spans(s, e), int((e - s).sum()), len(s), hashlib.sha256(b"".join(kept)).hexdigest()))
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["sha", "spans", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = 200, q: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (packed int64 starts and ends; null where all or nothing goes): a row for each row of docs."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.col(text_col).alias("text"))
    rows = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_hashes(), "id long, entry long, n_bytes long, sha binary"), "hashes")
    seen = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("many"), F.min(F.coalesce("id", F.lit(-1))).alias("id"))
    entries = written(rows.where("sha is not null").select("entry", "sha", "n_bytes").join(seen, "entry"), "entries")
    classes = written(entries.groupBy("sha").agg(F.sum("many").alias("many"), F.min("id").alias("id"), F.max("n_bytes").alias("n_bytes")), "classes")
    single = maybe_in(plain, "id", classes.where(F.col("n_bytes") >= length), "id").select("id", "text")
    parts = 2 * partitions(spark)
    anchors = single.mapInArrow(_post(length, q, parts), "part int, anchors binary")
    shared = written(anchors.groupBy("part").applyInArrow(_shared, "sha binary, places binary"), "shared")
    places = shared.groupBy("sha").agg(F.collect_list("places").alias("places"))  # a text's own anchors
    places = written(places.join(classes.select("sha", "id"), "sha"), "places")
    texts = maybe_in(plain, "id", places, "id").select("id", "text").mapInArrow(_zipped, "sha binary, text binary")
    with_places = texts.join(places, "sha").select("sha", "text", "places")
    contexts = written(with_places.mapInArrow(_contexts(length, q, parts), "kind int, part int, sha binary, payload binary"), "contexts")
    found = contexts.where("kind = 0").groupBy("part").applyInArrow(_find(length, q), "sha binary, spans binary")
    both = found.unionByName(contexts.where("kind = 1").select("sha", F.col("payload").alias("spans")))
    whole = classes.where(F.col("many") > 1)
    spans = written(both.groupBy("sha").agg(F.collect_list("spans").alias("spans")).join(whole.where(F.col("n_bytes") >= length).select("sha"), "sha", "left_anti").join(classes.select("sha", "id"), "sha"), "spans")
    dropped(shared, contexts, places)
    needed = maybe_in(plain, "id", spans, "id").select("id", "text").mapInArrow(_zipped, "sha binary, text binary")
    cut = written(needed.join(spans, "sha").select("sha", "text", "spans").mapInArrow(_cut, "sha binary, spans binary, n_removed long, n_spans long, kept_sha256 string"), "cut")
    all_gone = whole.where(F.col("n_bytes") >= length).select("sha", F.lit(None).cast("binary").alias("spans"), F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    result = written(cut.unionByName(all_gone), "removed")
    of_entry = entries.select("entry", "sha").join(result, "sha", "left")  # a task's equal texts find their result through their entry
    out = rows.drop("sha").join(of_entry, "entry")
    return out.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"), "spans")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir)).drop("spans")
