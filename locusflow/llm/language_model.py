"""A log-bilinear language model, trained in numpy by noise-contrastive estimation, and a word-count baseline.

The model's symbols are frequent words, TAIL classes of all other words (by their last two bytes) and the end of a text. Frequent
are words seen at least OFTEN times in the training texts, but no more of them than SPREAD times the root of the number of different words, so that
their number follows the corpus while the cost of normalising, the square of it, follows the corpus too. In the
model the vector of the symbol before, through a matrix, predicts the vector of the next: log p is their product and a
bias, up to a constant. There is one symbol of context, since the constant of each context is made exactly. Noise-contrastive estimation learns from every pair of
neighbouring symbols of every training text once; a small corpus is gone through more often, until LEAST_PAIRS are seen. How many tasks learn follows the
corpus, not how the table is split: each takes LEAST_PAIRS a round, for ROUNDS rounds at least, and more rounds where there are no more tasks to be had. After a
round the tasks' moves are averaged, each symbol's by how often a task met it, and so are the sums by which AdaGrad slows down, which the next round goes on
with. So the cost follows the corpus and no task sees it all. Matrix products over all symbols, shared out by row, then normalise. A
word of a tail class has the class's probability times its smoothed share of the class.

Word counts are a distributed table. The modelled words and others, KNOWN at most, go to every task; a text's other words are joined
with the table, and since they are rare no key of that join is hot.

Null and empty texts are the end token alone; a very long text is learned from and scored whole. Texts without identifier are scored and not learned from. Rows that repeat
are scored alike and learned from as often as they occur. Only identifier and text are read, so that other columns may be named as they like. Without training texts,
counts are zero and the model is flat. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import slices, split_words
from .common import documents, dropped, partitions, released, written
from .toxicity import in_fold

HEAD, OFTEN, SPREAD, TAIL, KNOWN = 1500, 50, 10, 500, 400_000
ROUNDS, LEAST_PAIRS = 2, 600 * 4096
END = TAIL
WORDS = TAIL + 1


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


def modelled(often: int, distinct: int) -> int:
    """How many words are modelled, of as many that come often and so many different ones."""
    return max(HEAD, min(often, SPREAD * math.isqrt(distinct)))


@released
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts, added up within the task while they fit; the end token is the null word."""
    held, size, ends = [], 0, 0
    kind = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def out():
        held.append(pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([ends], pa.int64())], schema=kind))
        total = pa.Table.from_batches(held, kind).group_by("word").aggregate([("c", "sum")])
        yield from pa.table([total.column("word"), total.column("c_sum")], schema=kind).to_batches(100_000)

    for whole in batches:
        for b in slices(whole, 0):
            named, codes, _ = split_words(b.column(0))
            n = np.bincount(codes, minlength=len(named))
            met = np.flatnonzero(n)
            held.append(pa.RecordBatch.from_arrays([named.take(pa.array(met)).cast(pa.binary()), pa.array(n[met])], schema=kind))
            size, ends = size + len(met), ends + b.num_rows
            if size > 1_500_000:
                yield from out()
                held, size, ends = [], 0, 0
    yield from out()


class Symbols:
    """Symbols of words given once each."""

    def __init__(self, head: pa.Array):
        self.head = head
        two = np.array([zlib.crc32(bytes([a, b])) % TAIL for a in range(256) for b in range(256)], np.int32)
        self.classes = two, np.array([zlib.crc32(bytes([a])) % TAIL for a in range(256)], np.int32)

    def of(self, words: pa.Array) -> np.ndarray:
        words = words.cast(pa.binary())
        ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
        raw = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8), np.uint8(0)).astype(np.int32)
        last, n = raw[np.maximum(ends[1:] - 1, 0)], np.diff(ends)
        tail = np.where(n > 1, self.classes[0][raw[np.maximum(ends[1:] - 2, 0)] * 256 + last], np.where(n > 0, self.classes[1][last], zlib.crc32(b"") % TAIL))
        at = pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy(zero_copy_only=False)
        return np.where(at >= 0, WORDS + at, tail).astype(np.int32)


def chained(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, after): the pairs of each text's symbols with an end at both sides, one text after the other."""
    n = len(ends) - 1
    at = np.arange(len(symbols)) + np.repeat(np.arange(n), np.diff(ends))
    before, after = np.full(len(symbols) + n, END, np.int32), np.full(len(symbols) + n, END, np.int32)
    after[at] = symbols
    before[at + 1] = symbols  # a text's last symbol comes before its end
    before[ends[:-1] + np.arange(n)] = END
    return before, after


class LogBilinear:
    """q = R[before] @ C; log p(next | before) = q . Q[next] + b[next] - log Z(before)."""

    def __init__(self, unigram: np.ndarray, arrays: tuple | None = None, width: int = 24, seed: int = 7, noise: int = 12):
        """unigram: how often each symbol occurs. arrays: R, C, Q, b as far as they are learned, else random ones."""
        n = len(unigram)
        p = (unigram + 0.5) / (unigram + 0.5).sum()
        self.log_kp, self.by_word = (math.log(noise) + np.log(p)).astype(np.float32), np.cumsum(p)
        if arrays is None:
            r = np.random.default_rng(seed)
            arrays = r.normal(0, 0.1, (n, width)), np.eye(width), r.normal(0, 0.1, (n, width)), np.log(p)
        self.R, self.C, self.Q, self.b = (np.array(x, np.float32) for x in arrays)

    def arrays(self) -> tuple:
        return self.R, self.C, self.Q, self.b

    def begin(self, seed: int, sums: list[np.ndarray] | None = None) -> None:
        """Before learning: the sums of AdaGrad, by row as they were left or small ones, and how often each symbol came before and after."""
        self.random, self.seen, self.aims = np.random.default_rng(seed), np.zeros(len(self.b), np.int64), np.zeros(len(self.b), np.int64)
        self.sums = [np.full_like(x, 1e-3) for x in self.arrays()]
        for own, left in zip(self.sums, sums or []):
            own[:] = left.reshape(-1, 1) if own.ndim > 1 else left

    def slowed(self) -> list[np.ndarray]:
        """The sums of AdaGrad by row."""
        return [x.reshape(len(x), -1).mean(1) for x in self.sums]

    def fit(self, before: np.ndarray, after: np.ndarray, batch: int = 2048, noise: int = 12, pool: int = 128, rate: float = 0.15) -> None:
        """Noise-contrastive estimation with AdaGrad: every pair is learned from once, in random order."""
        self.seen += np.bincount(before, minlength=len(self.seen))
        self.aims += np.bincount(after, minlength=len(self.aims))
        order = self.random.permutation(len(before))

        def step(k: int, rows, g: np.ndarray) -> None:
            x, total, g = self.arrays()[k], self.sums[k], g / 128
            t = total[rows] + g * g
            total[rows] = t
            x[rows] += rate * g / np.sqrt(t)

        def by_row(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            by = np.argsort(rows, kind="stable")
            at = np.flatnonzero(np.diff(rows[by], prepend=-1))
            return rows[by[at]], np.add.reduceat(g[by], at)

        for lo in range(0, len(order), batch):
            c, w = before[order[lo : lo + batch]], after[order[lo : lo + batch]]
            drawn = np.minimum(np.searchsorted(self.by_word, self.random.random(pool)), len(self.b) - 1)  # shared by the batch, weighted to noise for each pair
            own, to, apart = self.R[c], self.Q[w], self.Q[drawn]
            q = own @ self.C
            good = np.einsum("ij,ij->i", q, to) + self.b[w]
            bad = q @ apart.T + (self.b[drawn] - self.log_kp[drawn])
            g1 = 1 / (1 + np.exp(np.clip(good - self.log_kp[w], -60, 60)))
            g0 = np.float32(-noise / pool) / (1 + np.exp(np.clip(-bad, -60, 60)))
            gq = g1[:, None] * to + g0 @ apart
            both = np.concatenate([w, drawn])
            rows, g = by_row(both, np.column_stack([np.concatenate([g1[:, None] * q, g0.T @ q]), np.concatenate([g1, g0.sum(0)])]))
            gC = own.T @ gq
            step(2, rows, g[:, :-1])
            step(3, rows, g[:, -1])
            step(0, *by_row(c, gq @ self.C.T))
            step(1, slice(None), gC)

    def log_z(self, lo: int, hi: int) -> np.ndarray:
        """log Z of the symbols before from lo to hi, by matrix products over all symbols in batches of columns."""
        q, z = self.R[lo:hi] @ self.C, np.full(min(hi, len(self.b)) - lo, -np.inf)
        for k in range(0, len(self.b), 4096):
            x = q @ self.Q[k : k + 4096].T + self.b[k : k + 4096]
            top = x.max(1)
            z = np.logaddexp(z, top + np.log(np.exp(x - top[:, None]).sum(1)))
        return z.astype(np.float32)


BLOCK = 1024
_PART = "block long, pairs long, at binary, seen binary, aims binary, R binary, Q binary, b binary, slow binary"


def _learned(shared):
    """How far a task moves the model by its texts: the rows of R, Q and b that it changes, in blocks of symbols; C as block -1."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, unigram, arrays, sums, turn, passes = shared.value
        own, model, pairs = Symbols(head), LogBilinear(unigram, arrays), 0
        task = TaskContext.get()
        model.begin(1000 * (task.partitionId() if task else 0) + turn, sums)
        for whole in batches:
            for b in slices(whole, 0):
                named, codes, ends = split_words(b.column(0))
                before, after = chained(own.of(named)[codes], ends)
                for _ in range(passes):
                    model.fit(before, after)
                pairs += len(before)
        if not pairs:
            return
        old = LogBilinear(unigram, arrays)
        moved = [x - y for x, y in zip(model.arrays(), old.arrays())]
        slow = model.slowed()
        rows = [(-1, pairs, b"", b"", b"", moved[1].tobytes(), b"", b"", slow[1].astype("<f4").tobytes())]
        half = lambda x: np.clip(x, -6e4, 6e4).astype(np.float16).tobytes()
        count = lambda x: x.astype("<f4").tobytes()
        aims = model.aims / passes + unigram / max(1, unigram.sum()) * pairs  # as a target, and as often as noise
        for k in range(0, len(unigram), BLOCK):
            at = k + np.flatnonzero((model.seen[k : k + BLOCK] > 0) | (moved[2][k : k + BLOCK] != 0).any(1))
            if len(at):
                rows.append((k // BLOCK, pairs, (at - k).astype(np.int16).tobytes(), count(model.seen[at]), count(aims[at]), *(half(x[at]) for x in (moved[0], moved[2], moved[3])), count(np.concatenate([slow[i][at] for i in (0, 2, 3)]))))
        for lo in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 64]), (pa.int64(), pa.int64(), *[pa.binary()] * 7))], names=[x.split()[0] for x in _PART.split(", ")])

    return run


_MOVE = "block long, C binary, R binary, Q binary, b binary, slow binary"


@released
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean moves by block: of C by a task's pairs, of R by how often a symbol came before, of Q and b by how often it was to be told from others."""
    sums: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            n, k, slow = row["pairs"], row["block"], np.frombuffer(row["slow"], "<f4").astype(np.float64)
            if k < 0:
                C = np.frombuffer(row["R"], np.float32).astype(np.float64)
                own = sums.setdefault(k, [0, np.zeros(len(C)), np.zeros(len(slow))])
                own[0], own[1], own[2] = own[0] + n, own[1] + n * C, own[2] + n * slow
                continue
            R, Q, b = (np.frombuffer(row[x], np.float16).astype(np.float64) for x in ("R", "Q", "b"))
            at, seen, aims = np.frombuffer(row["at"], np.int16), *(np.frombuffer(row[x], "<f4").astype(np.float64) for x in ("seen", "aims"))
            width = len(R) // len(at)
            own = sums.setdefault(k, [np.zeros((BLOCK, width)), np.zeros((BLOCK, width)), np.zeros(BLOCK), np.zeros((3, BLOCK)), np.zeros(BLOCK), np.zeros(BLOCK)])
            own[0][at] += R.reshape(-1, width) * seen[:, None]
            own[1][at] += Q.reshape(-1, width) * aims[:, None]
            own[2][at] += b * aims
            own[3][:, at] += slow.reshape(3, -1) * np.array([seen, aims, aims])
            own[4][at] += seen
            own[5][at] += aims
    for k, own in sums.items():
        if k < 0:
            out = [own[1] / own[0], np.zeros(0), np.zeros(0), np.zeros(0), own[2] / own[0]]
        else:
            seen, aims = np.maximum(own[4], 1e-9), np.maximum(own[5], 1e-9)
            out = [np.zeros(0), own[0] / seen[:, None], own[1] / aims[:, None], own[2] / aims, own[3] / np.array([seen, aims, aims])]
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in out)], names=[x.split()[0] for x in _MOVE.split(", ")])


def tasks_and_rounds(pairs: int, most: int) -> tuple[int, int]:
    """How many tasks learn at once, `most` of them at most, and how many rounds: each task takes about LEAST_PAIRS a round."""
    tasks = max(1, min(most, math.ceil(pairs / (ROUNDS * LEAST_PAIRS))))
    return tasks, max(ROUNDS, math.ceil(pairs / (tasks * LEAST_PAIRS)))


def train_model(texts: DataFrame, head: pa.Array, unigram: np.ndarray) -> tuple:
    """R, C, Q, b; texts has one column. In each round every task learns from the pairs of its share of its texts, starting with the mean of the last round."""
    spark, model, (col,) = texts.sparkSession, LogBilinear(unigram), texts.columns
    pairs = int(unigram.sum())
    passes = max(1, math.ceil(LEAST_PAIRS / max(1, pairs)))  # more than one on a small corpus
    tasks, rounds = tasks_and_rounds(pairs, partitions(spark))
    dealt = texts.withColumn("turn", F.pmod(F.xxhash64(col), F.lit(rounds)).cast("int"))
    if rounds > ROUNDS:  # each round then reads its share only
        dealt = written(dealt, "turns", by="turn")
    sums = None
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((head, unigram, model.arrays() if turn else None, sums, turn, passes))
        share = dealt.where(F.col("turn") == turn).select(col).coalesce(tasks)
        moves = written(share.mapInArrow(_learned(shared), _PART).repartition(partitions(spark), "block").mapInArrow(_summed, _MOVE), "language-model")
        sums = sums or [np.full(len(x), 1e-3) for x in model.arrays()]
        for row in moves.toLocalIterator():
            C, R, Q, b, slow = (np.frombuffer(row[x]) for x in ("C", "R", "Q", "b", "slow"))
            if row["block"] < 0:
                model.C += C.reshape(model.C.shape)
                sums[1] = slow
            else:
                lo = row["block"] * BLOCK
                n = min(BLOCK, len(unigram) - lo)
                model.R[lo : lo + n] += R.reshape(BLOCK, -1)[:n]
                model.Q[lo : lo + n] += Q.reshape(BLOCK, -1)[:n]
                model.b[lo : lo + n] += b[:n]
                for i, x in zip((0, 2, 3), slow.reshape(3, BLOCK)):
                    sums[i][lo : lo + n] = np.maximum(x[:n], sums[i][lo : lo + n])
        shared.unpersist()
        dropped(moves)
    if rounds > ROUNDS:
        dropped(dealt)
    return model.arrays()


def normalisers(spark: SparkSession, unigram: np.ndarray, arrays: tuple) -> np.ndarray:
    """log Z of every symbol; the tasks share the symbols out."""
    shared, n = spark.sparkContext.broadcast((unigram, arrays)), len(unigram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LogBilinear(*shared.value)
        for b in batches:
            for k in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([model.log_z(256 * k, 256 * k + 256).tobytes()], pa.binary())], names=["k", "z"])

    blocks = -(-n // 256)
    rows = spark.range(0, blocks, 1, min(blocks, 4 * partitions(spark))).mapInArrow(run, "k long, z binary").collect()  # 4 bytes a symbol
    shared.unpersist()
    return np.concatenate([np.frombuffer(r["z"], np.float32) for r in sorted(rows, key=lambda r: r["k"])])


_SCORED = "key long, id long, word binary, n long, known long, base double, score double"


def _score(shared):
    """A row for each text with what its known words give, then a row for each other word of it."""
    names = [x.split()[0] for x in _SCORED.split(", ")]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_head, known, base, share, (q, Q, b, log_z), end_base = shared.value
        own = Symbols(known[:n_head])
        base, share = np.append(base, 0.0), np.append(share, 0.0)
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 36

        def log_p(before: np.ndarray, after: np.ndarray) -> np.ndarray:
            out = np.empty(len(before))
            for lo in range(0, len(before), 65_536):
                c, w = before[lo : lo + 65_536], after[lo : lo + 65_536]
                out[lo : lo + 65_536] = np.einsum("ij,ij->i", q[c], Q[w]) + b[w] - log_z[c]
            return out / math.log(10)

        for whole in batches:
            for x in slices(whole):
                named, codes, ends = split_words(x.column(1))
                n, docs = np.diff(ends), np.arange(x.num_rows)
                of_doc = np.repeat(docs, n)
                at = pc.fill_null(pc.index_in(named.cast(pa.binary()), value_set=known), len(known)).to_numpy(zero_copy_only=False)[codes]
                sums = lambda v: np.bincount(of_doc, v, len(docs))
                pairs = np.add.reduceat(log_p(*chained(own.of(named)[codes], ends)), ends[:-1] + docs) if len(docs) else np.zeros(0)
                met = at < len(known)
                cols = [first + docs, x.column(0), pa.nulls(len(docs), pa.binary()), n + 1, sums(met).astype(np.int64), sums(base[at]) + end_base, pairs + sums(share[at])]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], names=names)
                rare, many = np.unique(of_doc[~met].astype(np.int64) << 32 | codes[~met], return_counts=True)
                zero = np.zeros(len(rare))
                cols = [first + (rare >> 32), pa.nulls(len(rare), pa.int64()), named.take(pa.array(rare & 0xFFFFFFFF)).cast(pa.binary()), many, zero.astype(np.int64), zero, zero]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], names=names)
                first += len(docs)

    return run


def score_texts(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score for each row of docs; learn has the training rows."""
    spark = docs.sparkSession
    learned = learn.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sums = learned.mapInArrow(_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")
    counts = written(sums, "counts")
    in_words = F.col("word").isNotNull()
    all_ = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(~in_words, F.col("c"))), F.lit(0)).alias("ends")).first()
    total, distinct = all_["n"], all_["v"]
    below = math.log10(total + 0.5 * (distinct + 1))
    # how many words come so often, from the top: no more rows than KNOWN are looked at, since each has a word
    levels = counts.where(in_words).groupBy("c").count().orderBy(F.desc("c")).limit(KNOWN).collect()
    above = list(itertools.accumulate(r["count"] for r in levels))
    fit = sum(x <= KNOWN for x in above)
    least = levels[fit - 1]["c"] if fit else 1 << 62
    often = max([x for x, r in zip(above, levels) if r["c"] >= OFTEN], default=0)
    top = counts.where(in_words & (F.col("c") >= least)).toArrow().sort_by([("c", "descending"), ("word", "ascending")]).combine_chunks()  # KNOWN rows at most
    known, c = pa.concat_arrays(top.column("word").chunks) if top.num_rows else pa.array([], pa.binary()), top.column("c").to_numpy().astype(np.float64)
    n_head = min(len(known), modelled(often, distinct))

    class_of = F.pmod(F.crc32(F.expr("substring(word, greatest(length(word) - 1, 1), 2)")), F.lit(TAIL)).cast("int")
    tail = counts.where(in_words)
    if n_head:  # what comes after the last modelled word
        tail = tail.where((F.col("c") < int(c[n_head - 1])) | ((F.col("c") == int(c[n_head - 1])) & (F.col("word") > F.lit(bytearray(known[n_head - 1].as_py())))))
    mass, classes = np.zeros(TAIL), np.zeros(TAIL)
    for r in tail.groupBy(class_of.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # TAIL rows at most
        mass[r["k"]], classes[r["k"]] = r["c"] + 0.5 * (r["v"] + 1), r["c"]
    mass = np.where(mass > 0, mass, 0.5)
    unigram = np.concatenate([classes, [all_["ends"]], c[:n_head]])
    R, C, Q, b = model = train_model(learned, known[:n_head], unigram)
    log_z = normalisers(spark, unigram, model)
    base = np.log10(c + 0.5) - below
    of_class = Symbols(pa.array([], pa.binary())).of(known)
    share = np.where(np.arange(len(c)) < n_head, 0.0, np.log10((c + 0.5) / mass[of_class]))
    shared = spark.sparkContext.broadcast((n_head, known, base, share, (R @ C, Q, b, log_z), math.log10(all_["ends"] + 0.5) - below))

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(plain.mapInArrow(_score(shared), _SCORED), "scored")
    rare = rows.where("word is not null").select("key", "word", "n").join(counts.where(in_words), "word", "left")
    masses = F.array(*(F.lit(float(x)) for x in mass))
    log_mass = F.log10(F.element_at(masses, class_of + 1))
    found = F.coalesce("c", F.lit(0))
    parts = rare.groupBy("key").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * (F.log10(found + 0.5) - below)).alias("b"), F.sum(F.col("n") * (F.log10(found + 0.5) - log_mass)).alias("s"))
    whole = rows.where("word is null").join(parts, "key", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    ends_known = F.lit(1 if all_["ends"] else 0)
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + zero("k") + ends_known).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = in_fold(F.col("doc_id"), 5, 1)
    scores = score_texts(docs, docs.where(~held))
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
