"""The queries against SQL where there is one, and the pipeline stage by stage."""

import os
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hiersum.llm import queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tests.sqlcheck import assert_same  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert_same(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[0] > seen[1] > seen[2] > seen[3] == seen[4]
    assert docs.where(F.rlike("text", F.lit(r"[A-Za-z0-9]@[A-Za-z0-9]+\.[a-z]"))).count() == 0
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mix.count() == seen[-1] and mix.where("taken > 3 * size").count() == 0


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


def test_stages_on_awkward_rows(spark, docs, no_docs):
    everything = ids(docs)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0, name
    kept = corpus_pipeline.quality_filter(spark, docs, SF)
    assert kept.columns == no_docs.columns and set(ids(kept)) <= set(everything)
    assert ids(kept).count((False, 1)) in (0, 2)  # repeated rows share one fate
    clean = corpus_pipeline.decontamination(spark, docs, SF)
    assert ids(clean) == everything  # nothing here is in the benchmark
    private = corpus_pipeline.personal_data(spark, docs, SF)
    assert ids(private) == everything and private.columns == no_docs.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in private.collect()}
    assert texts[3] == (None, None) and texts[4] == ("", 0) and "<EMAIL>" in texts[8][0] and texts[8][1] == len(texts[8][0])
    mix = corpus_pipeline.mix_sources(spark, docs, SF)
    assert ids(mix) == everything and mix.where("size = 0 AND taken <> 0").count() == 0


def test_repeated_rows_leave_one(spark, docs):
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert ids(out) == [(False, k) for k in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)] + [(True, 0)]


def test_rows_without_an_id_are_judged_too(spark, no_docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(None, long, "en", "a", 1), (None, long + " end", "en", "a", 1), (None, item, "en", "a", 1), (None, "other text", "en", "a", 1), (5, long, "en", "a", 1), (7, item, "en", "a", 1), (7, "clean text of the same id", "en", "a", 1)]
    df = spark.createDataFrame(rows, no_docs.schema)
    texts = lambda out: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in out.collect())
    assert texts(corpus_pipeline.near_duplicates(spark, df.where("doc_id IS NULL OR doc_id = 5"), SF)) == sorted([(False, 5, long), (True, 0, item), (True, 0, "other text")])
    assert texts(corpus_pipeline.decontamination(spark, df, SF)) == sorted([(False, 5, long), (False, 7, "clean text of the same id"), (True, 0, long), (True, 0, long + " end"), (True, 0, "other text")])


def test_shingles_of_five_words(spark, no_docs):
    """Ten changed words in 100: a near copy by pairs of words, and none by runs of five."""
    words = [f"v{k}" for k in range(200)]
    other = [f"x{k}" if k % 20 == 10 else w for k, w in enumerate(words)]
    rows = [(k, " ".join(w), "en", "a", 1) for k, w in enumerate((words, other, words[:-2]))]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, no_docs.schema), SF)
    assert ids(out) == [(False, 0), (False, 1)]
