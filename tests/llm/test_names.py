"""Columns of the input may have any names, also those that operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from locusflow.llm.common import maybe_in, split_by
from locusflow.llm.exact_dedup import kept_documents
from locusflow.llm.jaccard_join import one_of_each
from locusflow.llm.pii import pseudonymise
from locusflow.llm.quality import features, quality_filter
from locusflow.llm.registry import QUERIES

NAMES = ["__id", "__gone", "__key", "__h", "__w", "__in", "__b", "__words", "id", "row", "in", "h", "given", "doc", "gone", "key", "sha", "kept", "n_words", "words", "class", "entry", "digest", "component_id", "keep_id", "piece", "turn", "held_out", "score", "n", "number"]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i}" for i in range(80))
    texts = [long, long, long + " more", "short text", None, " ".join(f"other{i}" for i in range(90)) + " a.b@c.org"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{k}` int" for k in NAMES)
    return spark.createDataFrame([(i, t, "en", "s", 1, *range(100 * i, 100 * i + len(NAMES))) for i, t in enumerate(texts)], kinds)


def kept(df):
    """doc_id of each row; every other column must have come through with its own value."""
    for r in df.collect():
        assert [r[k] for k in NAMES] == list(range(100 * r.doc_id, 100 * r.doc_id + len(NAMES)))
    return sorted(r.doc_id for r in df.collect())


def test_stages_carry_columns_of_any_name(odd):
    assert kept(kept_documents(odd)) == [0, 2, 3, 4, 5]
    assert kept(one_of_each(odd)) == [0, 3, 4, 5]
    assert kept(quality_filter(odd)) == [0, 1, 2, 5]
    assert kept(pseudonymise(odd, "k")) == [0, 1, 2, 3, 4, 5]
    assert kept(maybe_in(odd, "doc_id", odd.where("doc_id < 2"), "doc_id").where("doc_id < 2")) == [0, 1]
    out, rest = split_by(odd, "doc_id", odd.where("doc_id < 2"), "doc_id")
    assert kept(out.unionByName(rest)) == [0, 1, 2, 3, 4, 5]


def test_features_beside_columns_of_any_name(odd):
    got = {r.doc_id: r for r in features(odd).collect()}
    assert got[0].n_words == 80 and got[4].n_words == 0 and got[3]["__words"] == 300 + NAMES.index("__words") and got[3]["words"] == 300 + NAMES.index("words")


def test_queries_beside_columns_of_any_name(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    odd.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"), *NAMES[:8]).write.parquet(f"{tmp_path}/labels.parquet")
    odd.select(F.col("doc_id").alias("item_id"), "text", *NAMES).write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.select(F.col("doc_id").alias("vec_id"), F.array_repeat(F.col("doc_id") / 8, 64).alias("embedding"), *NAMES).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, query in QUERIES.items():
        rows = query(spark, str(tmp_path)).count()
        assert rows == {"op12_ranked_search": rows, "op13_ball_tree": 5}.get(name, 6), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2
