"""The pipeline against a plain version of its stages."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from locusflow.llm.chunks import tokenizer, vocabulary
from locusflow.llm.pii import SAMPLE_KEY, Pseudonyms
from tests.llm.test_operators import WS, make_rows, words


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipe"))
    rows = make_rows()
    rows += [(1000 + i, (t or "") + " ") for i, t in rows[:30]]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at, dict(rows)


def rejected(text):
    w = [x for x in WS.split(text) if x]
    n, chars = len(w), sum(map(len, w))
    tri = [tuple(w[k : k + 3]) for k in range(n - 2)]
    twice = {t for t in tri if tri.count(t) > 1} if n < 5000 else {t for t, c in __import__("collections").Counter(tri).items() if c > 1}
    covered = {k + j for k, t in enumerate(tri) if t in twice for j in range(3)}
    lines = [x for x in text.split("\n") if WS.sub("", x)]
    upper = sum(c.isupper() for c in text)
    return n < 50 or 100 * len(covered) > 50 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n or 2 * (len(lines) - len(set(lines))) > len(lines) or 2 * chars < 5 * n or chars > 14 * n or 2 * upper > chars


def test_pipeline(spark, sf):
    at, docs = sf
    left = {i: t for i, t in docs.items() if not rejected(t or "")}
    first = {}
    for i in sorted(left):
        first.setdefault(WS.sub(" ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in left.items() for w in [words(t)]}
    up = {i: i for i in left}
    for _ in range(len(left)):
        for a in left:
            for b in left:
                k = len(sets[a] & sets[b])
                if a < b and up[a] != up[b] and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    up[a] = up[b] = min(up[a], up[b])
        if all(up[up[i]] == up[i] for i in up):
            break
    p, t = Pseudonyms(SAMPLE_KEY), tokenizer(vocabulary("word_bpe_49k.json"))
    want = set()
    for i in left:
        if up[i] == i:
            ids = np.array(t.encode(p.text(left[i])[0], add_special_tokens=False).ids + [1], "<u4")
            want |= {(i, k, zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    got = corpus_pipeline.run(spark, at).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in got} == want and len(got) == len(want)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_hard_rows(spark, tmp_path):
    prose = " ".join(f"word{k * 7919 % 997}x" for k in range(120))
    rows = [(None, prose), (None, None), (1, prose), (1, prose), (2, prose + " "), (3, ""), (4, prose + " more words here")]
    spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [1]  # rows without identifier sort last
