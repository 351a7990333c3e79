"""The corpus pipeline: stages that each work on all documents that the stage before kept.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns
of documents; the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hiersum.llm import decontaminate, mixing, neardup, pii, quality
from hiersum.llm.common import checkpoint, scratch, small, table
from hiersum.llm.q03_mixing import WITHIN
from hiersum.llm.q04_quality import trained

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle.
WORDS = 5
#: Keys of documents that go, at most, for them to be broadcast; beyond that the texts are shuffled.
BROADCAST = 500_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Every row is judged by its own text, so repeated rows share one fate; null
    and empty texts are judged by the all-zero features.  Other columns than
    those of documents are dropped.  An empty table gives an empty result.
    """
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, trained(spark, sf_dir, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Similarity is 0.8 or more on shingles of five words.  Rows that repeat a
    doc_id leave one row, the smallest.  A row without a doc_id is a document of
    its own, after all that have one.  Null, empty and wordless texts are no
    copies of anything and stay.  An empty table gives an empty result.
    """
    docs = docs.select(*COLUMNS)
    nameless = docs.where("doc_id IS NULL")
    keyed = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), *COLUMNS)
    if not nameless.isEmpty():
        top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        keyed = keyed.unionByName(checkpoint(nameless.select((F.lit(top + 1) + F.monotonically_increasing_id()).alias("key"), *COLUMNS)))
    groups = neardup.find(keyed.select(F.col("key").alias("doc_id"), "text"), words=WORDS, percent=80)
    gone = small(groups.where("NOT kept").select(F.col("doc_id").alias("key")).distinct(), BROADCAST)
    kept = keyed.join(gone, "key", "left_anti")
    repeats = checkpoint(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    if not repeats.isEmpty():
        one = kept.join(repeats, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("key", "row.*")
        kept = kept.join(repeats, "key", "left_anti").unionByName(one)
    return kept.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Every row is judged by its own text, with a doc_id or without; null and
    empty texts hold nothing and stay.  An empty table gives an empty result,
    and without benchmark items everything stays.
    """
    docs = docs.select(*COLUMNS)
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    hit = small(found.where("contaminated").select(F.col("doc_id").alias("hit_id"), "text_hash").distinct(), BROADCAST)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("text_hash"))
    return docs.join(hit, same, "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms taken out of their texts.

    n_chars follows where a text changes.  Null texts stay null.  Repeated rows
    stay, and rows that share a doc_id share what is flagged.  An empty table
    gives an empty result.
    """
    found = pii.find(docs.select(*COLUMNS))
    text = pii.sanitised(F.col("text"), F.col("base"), F.col("added"), F.col("flagged"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("base") + F.size("added") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how often each document is taken, and the words that makes.

    One row per row of ``docs``; null and empty texts are taken zero times, and
    a null source is a source.  An empty table gives an empty result.
    """
    return mixing.mix(docs, within=WITHIN).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
]

#: A trained model and random rounding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, with a cut of lineage between them.

    What a stage wrote on its way is deleted when its result is written, and
    the stages' results when the mix is, which is the one table that stays.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for k, (_, stage) in enumerate(STAGES):
            with scratch(spark):
                docs = checkpoint(stage(spark, docs, sf_dir), outer=1 if k + 1 < len(STAGES) else 2)
    return docs
