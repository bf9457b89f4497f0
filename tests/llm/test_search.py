"""Clustering and search on small tables with hard rows, against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from locusflow.llm import ball_tree
from locusflow.llm.ball_kmeans import ball_kmeans, nearest, within_balls
from locusflow.llm.ball_tree import NO_ID, NO_SCORE, BallTree, Search, top_products
from locusflow.llm.ranked_search import Shard, ranked_search, terms_of

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, x string, id string, distance string"


def vectors(n, dim=64, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, (np.round(r.normal(size=dim) * 6) / 64).tolist()) for i in range(n)]
    rows += [(i, rows[7][1]) for i in range(n, n + 40)]  # many copies of one vector
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(n + 50, None), (n + 100, [None] + [0.5] * (dim - 1)), (n + 101, [float("nan")] * dim), (n + 102, [float("inf")] + [0.0] * (dim - 1)), (n + 103, []), (0, [0.0] * dim), (50, [-0.001] * dim)]
    rows += [(50 * i, [0.25, -0.5, i / 8]) for i in range(9)]  # of another length
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 9, "x", "id", "d") for i, v in rows], VECTORS).repartition(parts)


def whole(v):
    return tuple(math.floor(256 * float(np.float32(c))) for c in v)


def finite(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def lloyd(rows, k, rounds, dim):
    kept = [(i, whole(v)) for i, v in rows if finite(v) and len(v) == dim]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [list(v) for _, v in seeds]
    x = np.array([v for _, v in kept])
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v.tolist(), c)), j) for j, c in enumerate(centroids)) for v in x]
    for _ in range(rounds):
        at = [j for _, j in assign()]
        for j in set(at):
            own = [v for v, a in zip(x.tolist(), at) if a == j]
            centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    got = assign()
    total = Counter()
    for d, j in got:
        total[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(map(str, ((i, j, d, total[j], sum(total.values()), sha[j]) for (i, _), (d, j) in zip(kept, got))))


@pytest.mark.parametrize("k, rounds", [(40, 5), (4, 2), (1000, 1)])
def test_kmeans(spark, k, rounds):
    rows = vectors(200)
    got = ball_kmeans(frame(spark, rows), k=k, rounds=rounds).collect()
    assert sorted(str(tuple(r)) for r in got) == lloyd(rows, k, rounds, 64)


def test_kmeans_does_not_depend_on_partitions(spark):
    rows = vectors(150)
    one, many = (sorted(map(str, ball_kmeans(frame(spark, rows, n), k=7).collect())) for n in (1, 13))
    assert one == many


def test_balls_with_ties():
    r = np.random.default_rng(1)
    for _ in range(200):  # few values, so that distances tie and centroids coincide
        x, c = r.integers(-2, 3, (60, 2)), r.integers(-2, 3, (r.integers(1, 9), 2))
        at, d = within_balls(x, r.integers(0, len(c), 60).astype(np.int32), c)
        want, least = nearest(x, c)
        assert at.tolist() == want.tolist() and d.tolist() == least.tolist()


def test_too_large_components_stop_the_run(spark):
    with pytest.raises(Exception, match="fit a long"):
        ball_kmeans(frame(spark, [(1, [1e6] * 64)])).collect()


def products(rows, k, every):
    kept = [(i, whole(v)) for i, v in rows if finite(v)]
    out = []
    for n, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            cand = sorted((-sum(a * b for a, b in zip(q, v)), NO_ID if j is None else j) for m, (j, v) in enumerate(kept) if m != n and len(v) == len(q))[:k]
            out += [(i, r + 1, None if j == NO_ID else j, -s) for r, (s, j) in enumerate(cand)]
    return sorted(map(str, out))


@pytest.mark.parametrize("shard, pack", [(4096, 1024), (40, 4)])
def test_top_products(spark, monkeypatch, shard, pack):
    monkeypatch.setattr(ball_tree, "SHARD", shard)
    monkeypatch.setattr(ball_tree, "PACK", pack)
    rows = vectors(700, dim=8)
    got = top_products(frame(spark, rows, 5))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == products(rows, 5, 50)


@pytest.mark.parametrize("spread", [3, 1 << 26])
def test_tree_search(spread):
    r = np.random.default_rng(2)
    x, q = r.integers(-spread, spread + 1, (500, 6)), r.integers(-spread, spread + 1, (30, 6))
    ids = r.permutation(500)
    s = Search(BallTree(x, ids, leaf=9), q, np.full((30, 4), NO_SCORE), np.full((30, 4), NO_ID)).run()
    for i, row in enumerate(q):
        want = sorted(zip((-(x @ row)).tolist(), ids.tolist()))[:4]
        assert list(zip((-s.scores[i]).tolist(), s.ids[i].tolist())) == want


def test_tree_leaves_nodes_alone():
    r = np.random.default_rng(4)
    x = np.concatenate([r.integers(-5, 6, (400, 4)) + c for c in ((900, 0, 0, 0), (-900, 0, 0, 0), (0, 900, 0, 0))])
    s = Search(BallTree(x, np.arange(1200)), np.array([[10, 0, 0, 0]]), np.full((1, 5), NO_SCORE), np.full((1, 5), NO_ID))
    met, leaf = [], s.leaf
    s.leaf = lambda node, rows: (met.append(node), leaf(node, rows))
    s.run()
    assert 0 < len(met) < 12


def bm(docs, items, k):
    """The contract, document by document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    tf = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in tf if c), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
    out = []
    for item, text in items:
        hits = []
        for i, c in tf:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            s = sum(w(t) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if s > 0:
                hits.append((-s, NO_ID if i is None else i))
        out += [(item, r + 1, None if i == NO_ID else i, -s) for r, (s, i) in enumerate(sorted(hits)[:k])]
    return sorted(map(str, out))


def corpus():
    r = np.random.default_rng(8)
    vocab = [f"w{i}" if i % 3 else f"Ünd{i}É" for i in range(60)]
    prose = lambda n: " ".join(r.choice(vocab, n, p=np.arange(60, 0, -1) / 1830))
    docs = [(int(i), prose(int(r.integers(1, 80)))) for i in range(400)]
    docs += [(i, docs[3][1]) for i in range(500, 560)]  # copies, which tie
    docs += [(5, docs[5][1]), (5, "w1 w1 W1"), (None, prose(30)), (900, None), (901, ""), (902, "-- \x00\t!"), (903, prose(30_000)), (904, "w1_w2\x00w4\xa0w5")]
    items = [(1, prose(20)), (2, docs[3][1]), (2, "w1 w1 w1 w2"), (3, None), (4, ""), (None, "W1, w1! w7"), (6, "nowhere"), (7, "w1_w2 Ünd3É"), (8, prose(3000))]
    return docs, items


@pytest.mark.parametrize("terms, postings, depth", [(200_000, 1_000_000, 32), (50, 300, 1), (7, 2000, 5)])
def test_ranked_search(spark, terms, postings, depth):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1, "n", "t") for i, t in docs], "doc_id long, text string, n int, terms string, tfs string").repartition(4)
    q = spark.createDataFrame([(i, t, "a", 0) for i, t in items], "item_id long, text string, item string, terms int").repartition(2)
    got = ranked_search(d, q, terms=terms, postings=postings, depth=depth)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == bm(docs, items, 10)


def test_terms():
    assert terms_of("Ab-c_D9\x7fÀÉ x{y}`z@[") == [b"ab", b"c", b"d9", "ÀÉ".encode(), b"x", b"y", b"z"] and terms_of(None) == terms_of("") == []


def test_threshold_stops_early():
    n = 20_000
    impact = np.concatenate([np.full(5, 10**6), np.arange(n - 5) % 1000])
    shard = Shard(np.arange(n), np.ones(n, np.int64), np.zeros(n, np.int64), impact)
    looked, lookup = [], shard.lookup
    shard.lookup = lambda docs, wanted: (looked.append(len(docs)), lookup(docs, wanted))[1]
    assert shard.top(np.array([0]), np.array([True]), [], 3) == [(-(10**6), 0), (-(10**6), 1), (-(10**6), 2)]
    assert sum(looked) < 100
