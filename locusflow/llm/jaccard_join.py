"""Near duplicates by an n-gram Jaccard join over prefix trees.

A document's set is its distinct word n-grams as 64-bit hashes. Their global order puts rare ones first: by how many times
n-grams of the same hash slot occur in all documents (2**SLOTS counters, so the table that is broadcast has a fixed size),
then by hash. An element is its order class and 56 bits of hash.

1. Documents with equal sets are one class. 2. Each class posts the elements of its prefix: two sets of the required
similarity share an element among the first n - ceil(t n) + 1 of each. 3. In a group of postings of one element, every
document is paired with the one that has fewest rarer elements, among near copies the least edited, the hub. A task first does so
with its own postings and sends on the hub alone, so that a common element is one posting a task. 4. Links make components; of a
group whose documents lie in different ones, those pairs are compared next, but for documents that by size and place of the element
can't link with any of another component. What is left of a large group is dealt out as pairs of its blocks, with a bitmap of each set: a bit
that only one of two sets has is an element that the other lacks, so that pairs with too many of them are left out before their texts meet. No pair that
may be a link is left out, and within a group of near copies few pairs are made.

Pairs are compared by the prefix tree join: texts go to their hub, where their sets, in global order, are stored in one tree; runs that
begin alike are one branch. The hub's set walks the tree with the overlap of a branch so far, shared by all sets below it, and leaves a
branch when what remains of it or of the hub cannot reach the overlap required. A hub of many partners is dealt out over several trees.

With fewer words than n, the whole sequence is the one element; without words the set is empty, n_shingles is 0 and the
component is the document's own. Null texts count as empty; a very long text is one set like any other. Rows without identifier come back
with n_shingles and no component. Rows that repeat an identifier are one document: each has its own n_shingles, and the document is linked
where one of its texts is. Only identifier and text are read, so that other columns may be named as they like. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import slices, split_words
from .common import documents, dropped, maybe_in, partitions, split_by, trimmed, written
from .components import components

SLOTS = 20
#: Partners of a hub in one tree, and documents of an element's group in one block.
TREE, BLOCK = 256, 256
#: Bytes of a set's bitmap.
BITS = 256
_LOW = np.uint64((1 << 56) - 1)
_MIX = [np.uint64(int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "big") | 1) for k in range(64)]
_BYTES = np.frombuffer(hashlib.shake_256(b"words").digest(8 * 256), "<u8")
_BASE = int.from_bytes(hashlib.blake2b(b"base", digest_size=8).digest(), "big") & ~7 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX[0]
    x = (x ^ x >> np.uint64(29)) * _MIX[1]
    return x ^ x >> np.uint64(32)


class WordHashes:
    """64-bit hashes of words: a polynomial in random numbers of their bytes, long words by blake2b."""

    def __init__(self, longest: int = 64):
        self.longest, self.powers, self.inverses = longest, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, words: pa.Array) -> np.ndarray:
        words = words.cast(pa.binary())
        ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        at = ends - ends[0]
        if len(self.powers) <= len(raw):
            m = 1 << len(raw).bit_length()
            for name, b in (("powers", _BASE), ("inverses", _INVERSE)):
                x = np.full(m, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * self.powers[: len(raw)], out=sums[1:])
        h = _mixed((sums[at[1:]] - sums[at[:-1]]) * self.inverses[at[:-1]])
        for k in np.flatnonzero(np.diff(at) > self.longest).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(words[k].as_py(), digest_size=8).digest(), "little")
        return h


class Shingles:
    """Sets of n-gram hashes of texts; A-Z are lower-cased, words are runs without ASCII white space."""

    def __init__(self, n: int):
        self.n, self.hashes = n, WordHashes()

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """The distinct n-grams of each text, sorted."""
        named, codes, ends = split_words(texts)
        h = self.hashes.of(named)[codes]
        n, out = self.n, []
        m = max(0, len(h) - n + 1)
        total = np.zeros(m, np.uint64)
        for k in range(n):
            total = (total ^ h[k : k + m]) * _MIX[2 + k]
            total ^= total >> np.uint64(30)
        total = _mixed(total)
        for lo, hi in itertools.pairwise(ends.tolist()):
            if hi - lo >= n:
                out.append(np.unique(total[lo : hi - n + 1]))
            elif lo == hi:
                out.append(total[:0])
            else:
                one = np.array([hi - lo], np.uint64)
                for k in range(lo, hi):
                    one = _mixed(one ^ h[k : k + 1] * _MIX[2 + k - lo])
                out.append(one)
        return out


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOTS)).astype(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _packed_counts(at: np.ndarray, n: np.ndarray) -> bytes:
    steps = np.diff(at, prepend=0).astype("<u4")
    return zstandard.compress(np.stack([steps, n.astype("<u4")]).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked_counts(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = np.frombuffer(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T.tobytes(), "<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int64), n


_SETS = "id long, n long, entry long, d1 long, d2 long, counts binary"


def _sets(n: int, held: int = 500_000):
    """A row for each document, and at the end the slot counts of the task. An entry stands for equal sets that a task has seen;
    its digest is in the first of its rows. Empty sets have none."""
    names = [x.split()[0] for x in _SETS.split(", ")]
    types = (*[pa.int64()] * 5, pa.binary())

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = Shingles(n), np.zeros(1 << SLOTS, np.int64)
        entries: dict[bytes, int] = {}
        first = TaskContext.get().partitionId() << 36
        for whole in batches:
            for b in slices(whole, 1, 2 << 20):
                sets = own.of(b.column(1))
                rows = []
                for i, s in zip(b.column(0).to_pylist(), sets):
                    if not len(s):
                        rows.append((i, 0, None, None, None, None))
                        continue
                    digest = _digest(s)
                    entry = entries.get(digest)
                    if entry is None:
                        if len(entries) == held:
                            entries.clear()
                        entry = entries[digest] = first
                        first += 1
                        rows.append((i, len(s), entry, *np.frombuffer(digest, "<i8").tolist(), None))
                    else:
                        rows.append((i, len(s), entry, None, None, None))
                counts += np.bincount(_slots(np.concatenate(sets)), minlength=1 << SLOTS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        if counts.any():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, t) if k < 5 else pa.array([_packed_counts(at, np.minimum(counts[at], (1 << 32) - 1))], t) for k, t in enumerate(types)], names=names)

    return run


@trimmed
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SLOTS, np.int64)
    for b in batches:
        for x in b.column(0).to_pylist():
            at, n = _unpacked_counts(x)
            total[at] += n
    total = np.minimum(total, (1 << 32) - 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([_packed_counts(at, total[at])], pa.binary())], names=["counts"])


def order_classes(tables: DataFrame) -> np.ndarray:
    """Order class of each slot, 0 to 255: the logarithm of its count. Added up in streams, at last in one array."""
    width = max(1, partitions(tables.sparkSession) // 4)
    got = tables.repartition(width).mapInArrow(_summed, "counts binary").coalesce(1).mapInArrow(_summed, "counts binary").collect()
    total = np.zeros(1 << SLOTS)
    for r in got:  # one row of 2**SLOTS counters at most
        at, n = _unpacked_counts(r[0])
        total[at] += n
    return np.minimum(255, np.log2(total + 1) * 8).astype(np.uint8)


def elements(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set in global order."""
    return np.sort(classes[_slots(h)].astype(np.uint64) << np.uint64(56) | h & _LOW)


def required(n: np.ndarray, m: np.ndarray, t: int) -> np.ndarray:
    """Least overlap of sets of n and m elements that are similar to t hundredths."""
    return -(-t * (n + m) // (100 + t))


def _may_link(n, p, m, q, t: int) -> np.ndarray:
    """Whether sets of sizes n and m that share the elements at places p and q, as the first they share, may be similar."""
    need = required(n, m, t)
    short = np.minimum(n, m)
    return (100 * short >= t * np.maximum(n, m)) & (1 + np.minimum(n - p, m - q) - 1 >= need)


def _ranks(e: np.ndarray, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, size): postings by element, few rarer elements first, which is the least edited, so near most copies."""
    by = np.lexsort((_mixed(d.astype(np.uint64)), p, e))
    start = np.flatnonzero(np.r_[True, e[by][1:] != e[by][:-1]]) if len(e) else np.zeros(0, np.int64)
    return by, start, np.diff(np.r_[start, len(e)])


def _star(d: np.ndarray, n: np.ndarray, p: np.ndarray, start: np.ndarray, size: np.ndarray, t: int) -> np.ndarray:
    """Pairs of the documents of ordered groups with the first of their group."""
    hub = np.repeat(start, size)
    at = np.flatnonzero(hub != np.arange(len(d)))
    h = hub[at]
    ok = _may_link(n[at], p[at], n[h], p[h], t) & (d[at] != d[h])
    return np.unique(np.stack([d[h][ok], d[at][ok]], 1), axis=0)


def _pack(*columns: np.ndarray) -> bytes:
    """Numbers of one length, byte by byte of significance, compressed."""
    return zstandard.compress(np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns), 1)


def _unpack(payload: list[bytes], kinds: str) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds.split()]
    for x in payload:
        raw = zstandard.decompress(x)
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for c, kind in zip(out, kinds.split()):
            width = np.dtype(kind).itemsize
            c.append(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).ravel())
            at += n * width
    return [np.concatenate(c) for c in out]


#: element (as steps), document, set size, twice the place in order and whether the task kept others of the group to itself
_POSTED = "u8 i8 u4 u4"
_PAIRS = "i8 i8"
#: document, set size, element, place: the documents of groups of three and more
_GROUPED = "i8 u4 u8 u4"


def _postings(n: int, t: int, parts: int, classes, flush: int = 400_000):
    """Packed by part: postings by their element, and by document what the task could pair itself."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, order, seen = Shingles(n), classes.value, set()
        held: list[tuple] = []

        def dealt(kind: int, part: np.ndarray, columns: list[np.ndarray], rows: list[tuple]) -> None:
            by = np.argsort(part, kind="stable")
            part = part[by]
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for lo, hi in itertools.pairwise(cuts):
                if lo < hi:
                    cs = [c[by[lo:hi]] for c in columns]
                    if not kind:
                        cs[0] = np.diff(cs[0], prepend=np.uint64(0))
                    rows.append((int(part[lo]), kind, _pack(*cs)))

        def out():
            e, d, s, p = (np.concatenate(x) for x in zip(*held))
            by, start, size = _ranks(e, d, p)
            e, d, s, p = e[by], d[by], s[by], p[by]
            big = np.repeat(size, size) > 2
            first = np.zeros(len(e), bool)
            first[start] = True
            pairs = _star(d[big], s[big], p[big], np.flatnonzero(first[big]), size[size > 2], t)
            sent = first | ~big
            rows: list[tuple] = []
            dealt(0, (_mixed(e[sent]) % np.uint64(parts)).astype(np.int64), [e[sent], d[sent], s[sent].astype("u4"), (2 * p[sent] + big[sent]).astype("u4")], rows)
            of = lambda d: (_mixed(d.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            dealt(1, of(pairs[:, 1]), [pairs[:, 0].copy(), pairs[:, 1].copy()], rows)
            dealt(2, of(d[big]), [d[big], s[big].astype("u4"), e[big], p[big].astype("u4")], rows)
            for lo in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 500]), (pa.int32(), pa.int32(), pa.binary()))], names=["part", "kind", "payload"])

        size = 0
        for whole in batches:
            for b in slices(whole, 1, 2 << 20):
                for i, h in zip(b.column(0).to_pylist(), own.of(b.column(1))):
                    if not len(h):
                        continue
                    digest = _digest(h)
                    if digest in seen:  # the same set has been posted; its class has both
                        continue
                    if len(seen) < 500_000:
                        seen.add(digest)
                    e = elements(h, order)
                    k = len(e) + (-t * len(e)) // 100 + 1
                    held.append((e[:k].copy(), np.full(k, i, np.int64), np.full(k, len(e), np.int64), np.arange(k)))
                    size += k
                    if size > flush:
                        yield from out()
                        held, size = [], 0
        if held:
            yield from out()

    return run


def _first_pairs(t: int):
    """Pairs of a group's documents with its hub, and the groups of three or more."""

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        payload = group.column("payload").to_pylist()
        of = lambda k: [payload[i] for i in np.flatnonzero(kind == k).tolist()]
        steps, d, n, p = ([], [], [], [])
        for x in of(0):
            for to, c in zip((steps, d, n, p), _unpack([x], _POSTED)):
                to.append(np.cumsum(c, dtype=np.uint64) if to is steps else c.astype(np.int64))
        e, d, n, p = (np.concatenate([np.zeros(0, np.uint64 if c is steps else np.int64), *c]) for c in (steps, d, n, p))
        p, more = p >> 1, p & 1
        by, start, size = _ranks(e, d, p)
        e, d, n, p, more = e[by], d[by], n[by], p[by], more[by]
        pairs = _star(d, n, p, start, size, t)
        all_ = np.add.reduceat(more, start) if len(start) else start
        big = (np.repeat(size, size) > 2) | (np.repeat(all_, size) > 0)
        own = np.flatnonzero(big & (more == 0))
        gd, gn, ge, gp = _unpack(of(2), _GROUPED)
        pairs = np.unique(np.concatenate([pairs, np.stack(_unpack(of(1), _PAIRS), 1)]), axis=0)
        a, b = np.concatenate([pairs[:, 0], d[own], gd]), np.concatenate([pairs[:, 1], n[own], gn.astype(np.int64)])
        zero = np.zeros(len(pairs), np.int64)
        element = np.concatenate([zero, e[own].view(np.int64), ge.view(np.int64)])
        place = np.concatenate([zero, p[own], gp.astype(np.int64)])
        return pa.table([pa.array((np.arange(len(a)) >= len(pairs)).astype(np.int32)), pa.array(a), pa.array(b), pa.array(element), pa.array(place.astype(np.int32))], names=["kind", "a", "b", "element", "place"])

    return run


def bitmap(h: np.ndarray) -> np.ndarray:
    """A bit for each slot of a set's elements."""
    bits = np.zeros(8 * BITS, np.uint8)
    bits[(_mixed(h) % np.uint64(8 * BITS)).astype(np.int64)] = 1
    return np.packbits(bits)


def _bitmaps(n: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingles(n)
        for whole in batches:
            for b in slices(whole, 1, 2 << 20):
                made = [bitmap(h).tobytes() for h in own.of(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["id", "bits"])

    return run


def bits_allow(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, t: int) -> np.ndarray:
    """Whether sets of sizes n and m may be similar by their bitmaps, rows of x and y: neither has more bits of its own than elements that need no match."""
    need = required(n, m, t)
    return (np.bitwise_count(x & ~y).sum(1, dtype=np.int64) <= n - need) & (np.bitwise_count(y & ~x).sum(1, dtype=np.int64) <= m - need)


def _next_pairs(t: int):
    """Of the cells of one part, pairs that may link, also by their bitmaps, lie in different components and in the blocks of the cell."""

    def run(group: pa.Table) -> pa.Table:
        known = group.column("bits").is_valid().to_numpy()
        bits = np.frombuffer(b"".join(x or bytes(BITS) for x in group.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 8)
        e, lo, hi, block, d, n, p, c = (group.column(x).to_numpy() for x in ("element", "lo", "hi", "block", "a", "b", "place", "component"))
        by = np.lexsort((_mixed(d.astype(np.uint64)), n, hi, lo, e))
        e, lo, hi, block, d, n, p, c, bits, known = (x[by] for x in (e, lo, hi, block, d, n, p, c, bits, known))
        cell = np.cumsum(np.r_[False, (e[1:] != e[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        found = [np.zeros((0, 2), np.int64)]
        at, k = np.arange(len(e) - 1), 1
        while len(at):
            at = at[at + k < len(e)]
            at = at[(cell[at] == cell[at + k]) & (100 * n[at] >= t * n[at + k])]  # sizes rise, so that none farther on fits either
            j = at + k
            ok = at[(c[at] != c[j]) & ((lo[at] == hi[at]) | (block[at] != block[j])) & _may_link(n[at], p[at], n[j], p[j], t)]
            ok = ok[~(known[ok] & known[ok + k]) | bits_allow(bits[ok], bits[ok + k], n[ok], n[ok + k], t)]
            found.append(np.stack([np.minimum(d[ok], d[ok + k]), np.maximum(d[ok], d[ok + k])], 1))
            k += 1
            if k % 64 == 0:
                found = [np.unique(np.concatenate(found), axis=0)]
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


class PrefixTree:
    """Sets in global order, sorted: a branch is a run of sets that begin alike, so no node is stored."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
        self.sets = [sets[i] for i in self.order]

    def similar(self, probe: np.ndarray, t: int) -> list[int]:
        """Places, in the list given, of the sets that are similar to the probe."""
        found: list[int] = []
        stack = [(0, len(self.sets), 0, 0, 0)]  # run of sets, elements walked, overlap so far, place in the probe
        n = len(probe)
        while stack:
            lo, hi, depth, overlap, place = stack.pop()
            first, last = self.sets[lo], self.sets[hi - 1]
            shared = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:shared] != last[depth:shared])
            end = depth + int(differ[0]) if len(differ) else shared
            step = first[depth:end]
            spot = np.searchsorted(probe, step)
            overlap += int((probe[np.minimum(spot, n - 1)] == step).sum())
            place = int(np.searchsorted(probe, step[-1], "right")) if end > depth else place
            sizes = np.array([len(s) for s in self.sets[lo:hi]])
            reach = overlap + np.minimum(sizes - end, n - place)
            if not (reach >= required(sizes, n, t)).any():
                continue
            done = lo
            while done < hi and len(self.sets[done]) == end:  # sets that end here
                if 100 * overlap >= t * (n + end - overlap):
                    found.append(self.order[done])
                done += 1
            at = done
            while at < hi:
                head, a, b = self.sets[at][end], at, hi
                while b - a > 1:
                    mid = (a + b) // 2
                    a, b = (mid, b) if self.sets[mid][end] == head else (a, mid)
                stack.append((at, b, end, overlap, place))
                at = b
        return found


def _verify(n: int, t: int, classes, most: int = 32 << 20):
    """Rows that follow each other by hub, its own text first: the partners' sets make trees, which the hub's set walks."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, order, unzip = Shingles(n), classes.value, zstandard.ZstdDecompressor()
        key, probes, ids, sets, size = None, [], [], [], 0

        def walked() -> list[tuple[int, int]]:
            tree = PrefixTree(sets) if sets else None
            return list({(key[0], ids[k]) for p in probes for k in tree.similar(p, t)}) if tree else []

        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                texts = [unzip.decompress(x).decode("utf-8", "replace") for x in b.column(4).to_pylist()]
                found: list[tuple[int, int]] = []
                for hub, salt, role, id_, h in zip(*(b.column(k).to_pylist() for k in range(4)), own.of(pa.array(texts, pa.string()))):
                    if (hub, salt) != key:
                        found += walked()
                        key, probes, ids, sets, size = (hub, salt), [], [], [], 0
                    s = elements(h, order)
                    if not role:
                        probes.append(s)
                        continue
                    if len(sets) == TREE or size > most:
                        found += walked()
                        ids, sets, size = [], [], 0
                    ids.append(id_)
                    sets.append(s)
                    size += s.nbytes
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if found := walked():
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


@trimmed
def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed; of rows that repeat identifier and text a task sends one."""
    z, sent = zstandard.ZstdCompressor(level=1), set()
    for whole in batches:
        for b in slices(whole):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                mark = (i, hash(raw))
                if mark not in sent:
                    rows.append((i, z.compress(raw)))
                    if len(sent) < 500_000:
                        sent.add(mark)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "text"])


def _linked(plain: DataFrame, pairs: DataFrame, n: int, t: int, classes, name: str) -> DataFrame:
    """The pairs (a, b) that are similar. Each text goes once to its identifier's routes, and from there to each hub it is compared with.

    Texts are many whatever the size of the input, so the join is declared as one that shuffles both sides.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TREE).cast("int").alias("trees"))
    sizes = written(sizes, "hubs")
    crowded = sizes.where("trees > 1")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("trees", F.lit(1))).cast("int")
    to_hub = pairs.join(crowded, "a", "left").select(F.col("b").alias("id"), F.col("a").alias("hub"), salt.alias("salt"), F.lit(1).alias("role"))
    hubs = sizes.select(F.col("a").alias("id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("salt"), F.lit(0).alias("role"))
    routes = written(to_hub.unionByName(hubs), "routes")
    texts = maybe_in(plain, "id", routes.select("id").distinct(), "id").mapInArrow(_zipped, "id long, text binary")
    sent = texts.join(routes.hint("merge"), "id").select("hub", "salt", "role", "id", "text")
    rows = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "id")
    out = written(rows.mapInArrow(_verify(n, t, classes), "a long, b long").distinct(), name)
    dropped(sizes, routes)
    return out


def _partnered(postings: DataFrame, t: int) -> DataFrame:
    """Postings (element, a, b: set size, place, component) that some posting of their element in another component may link with.

    A set of b elements that meets the first shared one at its place can reach what is required with sets of up to `reach` elements only. Of
    an element's postings, those of like size are summed up to a row, which is less than 2% wide and exact below 92 elements; a posting stays if
    one of these rows has a fitting size, reaches back to it and has another component. So a common element of documents whose rarer parts
    are too long to be alike is left out before any pair is made.
    """
    rows = postings.withColumn("reach", F.expr(f"({100 + t} * (b - place)) div {t} - b"))
    sizes = rows.groupBy("element", F.floor(F.log2("b") * 64).alias("like")).agg(
        F.min("b").alias("least"), F.max("b").alias("most"), F.max("reach").alias("reach"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    one = F.struct("least", "most", "reach", "lo", "hi")
    of_element = sizes.groupBy("element").agg(F.collect_list(one).alias("sizes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("element", "sizes")
    fits = F.expr(
        f"exists(sizes, s -> s.least <= reach and s.reach >= b and 100 * s.most >= {t} * b and {t} * s.least <= 100 * b and (s.lo <> component or s.hi <> component))"
    )
    return rows.join(written(of_element, "sizes"), "element").where(fits).select(*postings.columns)


def jaccard_join(docs: DataFrame, n: int = 5, t: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, entries): id, n_shingles, entry for each row; pairs (a, b) of similar documents; entry, class, component.

    links are those that were needed to find the components; every other similar pair lies within one component. A class is the
    smallest identifier of equal sets; rows with an empty set have no entry.
    """
    spark = docs.sparkSession
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    plain = every.where("id is not null")
    sets = written(every.mapInArrow(_sets(n), _SETS), "sets")
    classes = spark.sparkContext.broadcast(order_classes(sets.where("counts is not null").select("counts")))
    members = sets.where("counts is null").select("id", F.col("n").alias("n_shingles"), "entry")
    entries = sets.where("entry is not null").groupBy("entry").agg(F.min("id").alias("id"), F.max("d1").alias("d1"), F.max("d2").alias("d2"))
    entries = written(entries, "entries")
    reps = entries.groupBy("d1", "d2").agg(F.min("id").alias("class"))
    of_entry = written(entries.join(reps, ["d1", "d2"]).select("entry", "class"), "classes")

    parts = 2 * partitions(spark)
    near = maybe_in(plain, "id", of_entry.select("class").distinct(), "class")
    postings = near.mapInArrow(_postings(n, t, parts, classes), "part int, kind int, payload binary")
    first = written(postings.groupBy("part").applyInArrow(_first_pairs(t), "kind int, a long, b long, element long, place int"), "groups")

    pairs = written(first.where("kind = 0").select("a", "b").distinct(), "pairs")
    posted = members.join(of_entry, "entry").where("id <> class").select(F.col("id").alias("a"), F.col("class").alias("b"))  # copies that tasks posted each, texts of one identifier
    links = _linked(plain, pairs, n, t, classes, "links").unionByName(posted)
    labels = written(components(links), "labels")
    groups = first.where("kind = 1").select("element", "a", "b", "place")
    split = groups.join(labels.select(F.col("id").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    split = written(split, "split")
    open_ = written(_partnered(split, t), "open")
    mixed = open_.groupBy("element").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("lo <> hi").select("element", "blocks")
    open_ = open_.join(written(mixed, "mixed"), "element").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    several = F.when(F.min("bits") == F.max("bits"), F.min("bits"))  # texts of one identifier have no bitmap in common
    open_ = written(open_, "open")
    signs = maybe_in(plain, "id", open_.select("a").distinct(), "a").mapInArrow(_bitmaps(n), "id long, bits binary").groupBy("id").agg(several.alias("bits"))
    open_ = open_.join(signs.withColumnRenamed("id", "a"), "a", "left")
    cells = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("element", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "a", "b", F.col("place").cast("long").alias("place"), "component", "bits")
    more = cells.groupBy(F.pmod(F.xxhash64("element", "lo", "hi"), F.lit(parts)).alias("part")).applyInArrow(_next_pairs(t), "a long, b long")
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(more.distinct().join(known, ["a", "b"], "left_anti"), "pairs")
    dropped(first, split)
    if not rest.isEmpty():
        late = _linked(plain, rest, n, t, classes, "links")
        if not late.isEmpty():
            links = links.unionByName(late)
            labels = written(components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(late)), "labels")
    found = of_entry.join(labels, of_entry["class"] == labels["id"], "left").select("entry", "class", F.coalesce("component", "class").alias("component"))
    return members, links, found


def near_duplicates(docs: DataFrame, n: int = 5, t: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id: one row for each row of docs."""
    members, _, found = jaccard_join(docs, n, t, id_col, text_col)
    own = F.when(members["id"].isNotNull(), F.coalesce("component", "id"))
    return members.join(found, "entry", "left").select(members["id"].alias(id_col), "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, t: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are in the component of a smaller identifier; rows without identifier stay.

    Rows whose identifier is surely not among those pass where they are; only the others are joined.
    """
    gone = written(near_duplicates(docs, n, t, id_col, text_col).where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("gone")), "gone")
    # the documents go along as one column, so that theirs may have any names
    sure, rest = split_by(docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id")), "id", gone, "gone")
    rest = rest.join(gone, F.col("id") == F.col("gone"), "left_anti")
    return (rest if sure is None else sure.unionByName(rest)).select("doc.*")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
