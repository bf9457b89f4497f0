"""Quality rules as a short-circuit cascade, on DataFrame functions only.

Every rule is a condition on one document that rejects it. On a random sample each rule's share of rejected rows is counted and
its run timed, less the time of a condition that does nothing; rules are then put in order of rejections per second, and a document
is judged by the first that rejects it, so that dear rules run on what cheap ones leave. The order bears on time alone: a document
stays if no rule rejects it.

Null texts count as having no words. Empty texts, very long texts and repeated rows are rows like any other. No column but
the text is read, and extra columns come back as they are (features() prefixes nothing: call it on the columns you want).
An empty table gives an empty result.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, dropped, written

#: Characters counted as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Rows on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000


def clean(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long")


def lines(text: Column) -> Column:
    """\\n-split lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.octet_length(F.btrim(x, F.lit(WHITE))) > 0)


def duplicate_lines(text: Column) -> Column:
    return _bound(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def upper_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long")


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once though f uses it many times."""
    return F.transform(F.array(value), f)[0]


def repeated_words(found: Column) -> Column:
    """How many of an array of words lie in a three-word window found at least twice. Windows are compared by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])
            at = F.array_compact(F.transform(s, twin))
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_bound(placed, of_sorted))

    def windows(h: Column) -> Column:
        each = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return _bound(each, covered)

    return _bound(F.transform(found, lambda w: F.xxhash64(w)), windows).cast("long")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, in place of columns of those names; others may have any."""
    t = clean(F.col(text_col))
    of_words = _bound(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    named = docs.select(F.struct("*").alias("doc"), of_words.alias("words"), word_chars(t).alias("word_chars"), symbol_count(t).alias("n_symbols"), duplicate_lines(t).alias("n_dup_lines"))
    made = {"n_words": F.col("words.n"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"), "n_dup_lines": F.col("n_dup_lines"), "n_repeat_words": F.col("words.r")}
    return named.select(*(F.col("doc")[k].alias(k) for k in docs.columns if k not in made), *(v.alias(k) for k, v in made.items()))


def rules(text: Column, found: Column) -> dict[str, Column]:
    """Conditions that reject a document, by its text and the array of its words."""
    n = F.size(found)
    return {
        "few words": n < 50,
        "repeated windows": 100 * repeated_words(found) > 50 * n,
        "symbols": 10 * symbol_count(text) > n,
        "repeated lines": _bound(lines(text), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x)),
        "word length": _bound(word_chars(text), lambda k: (2 * k < 5 * n) | (k > 14 * n)),
        "capitals": 2 * upper_count(text) > word_chars(text),
    }


def conditions(text_col: str = "text") -> dict[str, Column]:
    """rules(), each for itself."""
    t = clean(F.col(text_col))
    alone = lambda name: _bound(words(t), lambda w: rules(t, w)[name])
    return {name: alone(name) for name in rules(t, words(t))}


def ordered(docs: DataFrame, made: dict[str, Column], sample_rows: int = SAMPLE_ROWS, runs: int = 3) -> list[tuple[str, float, float]]:
    """(name, share rejected, seconds) by rejections per second on about sample_rows rows of docs, drawn from all partitions, dearest last.

    The sample is one task's, so that a run's time is its work; of some runs, of which the first compiles, the fastest counts.
    """
    n = docs.count()
    sample = written(docs.sample(min(1.0, sample_rows / max(1, n)), seed=7).repartition(1), "quality-sample")
    found = sample.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f"r{k}") for k, c in enumerate(made.values()))).first()

    def seconds(condition: Column) -> float:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            sample.agg(F.count_if(condition)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    nothing = seconds(F.octet_length(F.col(sample.columns[0])) < 0)
    out = [(name, found[f"r{k}"] / max(1, found["n"]), max(1e-4, seconds(c) - nothing)) for k, (name, c) in enumerate(made.items())]
    dropped(sample)
    return sorted(out, key=lambda x: (-x[1] / x[2], x[2], x[0]))


def verdict(made: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated."""
    out = F.when(made[order[0]], order[0])
    for name in order[1:]:
        out = out.when(made[name], name)
    return out


def quality_filter(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects. A text is split into words once for all rules."""
    order = [name for name, _, _ in ordered(docs.select(text_col), conditions(text_col), sample_rows)]
    t = clean(F.col(text_col))
    return docs.where(_bound(words(t), lambda w: verdict(rules(t, w), order).isNull()))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    order = [name for name, _, _ in ordered(docs.select("text"), conditions())]
    n = F.col("n_words")
    cheap = {  # what features() has counted is not counted again
        "few words": n < 50,
        "repeated windows": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated lines": 2 * F.col("n_dup_lines") > F.size(lines(clean(F.col("text")))),
        "word length": (2 * F.col("word_chars") < 5 * n) | (F.col("word_chars") > 14 * n),
        "capitals": 2 * upper_count(clean(F.col("text"))) > F.col("word_chars"),
    }
    base = cheap["few words"] | cheap["repeated windows"]
    return features(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), verdict(cheap, order).isNull().alias("kept"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER v || ' ' || lead(x, 2) OVER v AS g FROM u WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT doc_id, i FROM (SELECT * FROM g WHERE g IS NOT NULL) QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
f AS (SELECT t.doc_id, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l.l) AS n_lines,
      length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_upper
      FROM t JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * word_chars < 5 * n_words
            OR word_chars > 14 * n_words OR 2 * n_upper > word_chars) AS kept
FROM b
"""
