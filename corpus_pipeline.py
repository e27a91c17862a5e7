"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

=========  ==============================================================================================
toxicity   documents that the segment search holds for toxic (0.7 or more) go
quality    documents that the classifier holds for rather bad than good (less than 0.5) go
minhash    one document of each near-duplicate component stays (five-word shingles, similarity 0.8)
mixing     sources are repeated or cut to the temperature weights, at the token budget of what is left
byte_bpe   texts become token ids; the ids are decoded again for the digest
=========  ==============================================================================================

A stage sees what its predecessor kept and learns from the labels of those documents only. All but the last return
the columns of their input. Rows without id pass every filter but count in no training, and are no duplicates of
anything; rows that repeat an id are one document, so one of them stays after ``minhash``. Other nulls, empty
texts and empty tables are as defined by the operators. Stages lower the session's
``spark.sql.execution.arrow.maxRecordsPerBatch`` to ARROW_ROWS (results don't depend on it). Input columns other than ``doc_id, text, source`` may have any
name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import byte_bpe, lsh_forest, mixing, quality, toxicity
from refrain.llm.common import table
from refrain.llm.queries import BPE_RANKS, bpe_digests
from refrain.session import staged

#: Rows that cross to a Python worker at once. Five stages of kernels share the executors, and Spark's default of 10,000 whole
#: texts is held several times over (in the JVM's Arrow buffers, in the worker's, as Python strings).
ARROW_ROWS = 1000
GOOD_FROM = 0.5
TARGET_ENTROPY = 0.95


def modest(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ARROW_ROWS, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def whole(docs: DataFrame) -> DataFrame:
    """Rows as one column, so that no column of theirs can clash with an operator's."""
    return docs.select(F.struct(*docs.columns).alias("_doc"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scan(whole(docs), model, id_col="_doc.doc_id", text_col="_doc.text", keep=["_doc"])
    return found.filter(toxicity.probability(model, F.col("x")) < toxicity.THRESHOLD).select("_doc.*")


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest(spark)
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(whole(docs), weights, id_col="_doc.doc_id", text_col="_doc.text", keep=["_doc"])
    return scored.filter(F.col("score") >= GOOD_FROM).select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest(spark)
    found = lsh_forest.near_duplicates(docs)
    gone = staged(found.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti")
    again = staged(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left.select(*docs.columns)
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(docs, target_entropy=TARGET_ENTROPY)
    wrapped = docs.select("doc_id", "source", F.struct(*docs.columns).alias("_doc"))
    return mixing.mix(wrapped, plan).select("_doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest(spark)
    ranks = byte_bpe.load_ranks(public_tokenizers.path(BPE_RANKS))
    coded = byte_bpe.encode_decode(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", "ids", *bpe_digests(coded))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("minhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs


#: Trained models and signatures aren't SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None
