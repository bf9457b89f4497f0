"""Ranked lexical search by the threshold algorithm: impact-sorted lists of each shard, read round-robin, with lookups in its forward index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, passing, written

#: A term is a maximal run of ASCII letters, digits and characters beyond ASCII; as bytes of UTF-8, all other bytes become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Terms of one block of queries, which tasks hold; postings of one shard; postings of each list read in one round.
TERMS, POSTINGS, DEPTH = 200_000, 1_000_000, 32
FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z in lower case."""
    return text.encode().translate(_TABLE).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight w adds to the score of a document of length class m that holds it tf times."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def length_class(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 10 + 90 * n * n_docs // n_terms


class Shard:
    """Documents with their forward index, rows of postings by document, and for each term a list of postings by impact."""

    def __init__(self, doc_ids: np.ndarray, counts: np.ndarray, terms: np.ndarray, impact: np.ndarray, depth: int = DEPTH) -> None:
        """doc_ids in any order; counts: postings of each document; terms and impact: the postings, by document; depth: postings of a list read in one round."""
        self.doc_ids, self.terms, self.impact, self.depth = doc_ids, terms, impact, depth
        self.start = np.append(0, np.cumsum(counts))
        doc = np.repeat(np.arange(len(doc_ids)), counts)
        order = np.lexsort((doc, -impact, terms))
        self.by_term, self.list_impact = doc[order], impact[order]
        self.known, first = np.unique(terms[order], return_index=True)
        self.first = np.append(first, len(order))

    def lookup(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of documents for the wanted terms, from the forward index."""
        n = self.start[docs + 1] - self.start[docs]
        at = np.repeat(self.start[docs] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return np.add.reduceat(np.where(wanted[self.terms[at]], self.impact[at], 0), np.append(0, np.cumsum(n)[:-1])) if len(docs) else np.zeros(0, np.int64)

    def top(self, query: np.ndarray, wanted: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The k best (-score, doc_id) among best and this shard's documents. query: numbers of its terms; wanted: the same as a mask.

        In each round the next `depth` postings of every list are read and their documents looked up. The threshold is the score of a document
        with the impacts read last in every list, above which no unseen document comes; once it falls strictly below the kth score, all others lie
        below that, and with it all that might tie. A list at its end adds nothing.
        """
        at = np.searchsorted(self.known, query)
        at = at[(at < len(self.known))]
        at = at[np.isin(self.known[at], query)]
        lo, hi = self.first[at], self.first[at + 1]
        seen, depth = np.zeros(len(self.doc_ids), bool), 0
        while True:
            here = np.minimum(hi - lo, depth + self.depth)
            read = np.concatenate([self.by_term[a + depth : a + h] for a, h in zip(lo, here) if h > depth] or [np.zeros(0, np.int64)])
            docs = np.unique(read)
            docs = docs[~seen[docs]]
            seen[docs] = True
            scores = self.lookup(docs, wanted)
            floor = -best[-1][0] if len(best) == k else 1
            good = np.flatnonzero(scores >= floor)
            if len(good):
                best = sorted(best + list(zip((-scores[good]).tolist(), self.doc_ids[docs[good]].tolist())))[:k]
            depth += self.depth
            threshold = int(self.list_impact[lo + here - 1][hi - lo > depth].sum())
            if not (hi - lo > depth).any() or (len(best) == k and threshold < -best[-1][0]):
                return best


def _forward(numbers: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of FORWARD: each document's terms in all, and the queries' terms among them with how often they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, counts, terms, tfs = [], [], [], []
            for text in b.column("text"):
                words = terms_of(text.as_py())
                got = [(numbers[t], c) for t, c in Counter(words).items() if t in numbers]
                n.append(len(words))
                counts.append(len(got))
                terms += [t for t, _ in got]
                tfs += [c for _, c in got]
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *(pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (terms, tfs))], names=["doc_id", "n", "terms", "tfs"])

    return run


NO_ID = np.iinfo(np.int64).max


def _searched(queries: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, cut: int, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """item, doc_id, score: the k best documents of a task for each query. Its shards are searched one after the other, each from the kth score so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {item: [] for item, _ in queries}
        held, postings = [], 0

        def search() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            col = lambda c: t.column(c).chunk(0)
            counts = col("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms, tf = col("terms").flatten().to_numpy(), col("tfs").flatten().to_numpy().astype(np.int64)
            m = length_class(col("n").to_numpy(), n_docs, n_terms)
            shard = Shard(col("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False), counts, terms, impacts(weights[terms], tf, np.repeat(m, counts)), depth)
            wanted = np.zeros(len(weights), bool)
            for item, query in queries:
                wanted[query] = True
                best[item] = shard.top(query, wanted, best[item], k)
                wanted[query] = False

        for b in batches:
            if b.num_rows:
                held.append(b)
                postings += len(b.column("terms").flatten())
            if postings >= cut:
                search()
                held, postings = [], 0
        if held:
            search()
        rows = [(item, d, -s) for item, found in best.items() for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item", "doc_id", "score"])

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("item"), pa.array([sorted(set(terms_of(t.as_py()))) for t in b.column("text")], pa.list_(pa.binary()))], names=["item_id", "item", "terms"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, terms: int = TERMS, postings: int = POSTINGS, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_col, rank, doc_id, score: the k documents of highest score above 0 for each row of items, ties to the smaller doc_id, null ones last.

    A term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))), a document's score the sum over the item's terms, once each, of the weight times
    (10^9 tf) div (1000 tf + 8 m), with m = 10 + (90 n N) div L. Null and empty texts have no terms: such a document is in no list, such an item
    has no rows. Repeated documents rank one by one; repeated items have rows each. Other columns aren't read. Without documents or items there are no rows.

    Items are taken in blocks of about so many terms, each of which is a pass over the documents: that bounds what a task and the driver
    hold. Each pass writes the forward index of the block's terms; its partitions are cut into shards of about so many postings.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).withColumn("item", F.monotonically_increasing_id())
    asked = written(named.mapInArrow(_terms, f"item_id {items.schema[item_col].dataType.simpleString()}, item long, terms array<binary>").where(F.size("terms") > 0), "asked")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / terms))
    found = None
    for block in range(blocks):
        with passing(spark) as made:
            got = written(_block(plain, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block), k, postings, depth), "found")
            made.remove(got.written_at)
        found = got if found is None else found.unionByName(got)
    # the few rows of a task for an item are merged in two steps, so that one item's rows of all tasks aren't one task's
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(16))).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    rank = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return rank.join(asked.select("item", "item_id"), "item").select(F.col("item_id").alias(item_col), "rank", "doc_id", "score")


def _block(plain: DataFrame, asked: DataFrame, k: int, postings: int, depth: int) -> DataFrame:
    """item, doc_id, score for the items of one block."""
    rows = asked.select("item", "terms").collect()
    numbers = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
    queries = [(r["item"], np.array(sorted(numbers[bytes(t)] for t in r["terms"]), np.int64)) for r in rows]
    forward = written(plain.mapInArrow(_forward(numbers), FORWARD), "forward")
    size = forward.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.sum("n").alias("n_terms")).first()
    df = {r["t"]: r["n"] for r in forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.array([weight(size["n_docs"], df.get(i, 0)) for i in range(len(numbers))], np.int64)
    hit = forward.where(F.size("terms") > 0)
    search = _searched(queries, weights, size["n_docs"], size["n_terms"] or 1, k, postings, depth)
    return hit.mapInArrow(search, "item long, doc_id long, score long").withColumn("doc_id", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT DISTINCT item_id, r, t FROM (SELECT item_id, row_number() OVER () AS r,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
s AS (SELECT count(*) AS n_docs, sum(len(ws)) AS n_terms FROM d WHERE len(ws) > 0),
p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, n_docs),
i AS (SELECT p.r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ws) * n_docs) // n_terms))) AS v FROM p JOIN w USING (t) JOIN d ON d.r = p.r, s),
c AS (SELECT q.item_id, q.r AS item, i.r, sum(v) AS score FROM q JOIN i USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM c JOIN d USING (r) WHERE score > 0 WINDOW w AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) QUALIFY rank <= 10
"""
