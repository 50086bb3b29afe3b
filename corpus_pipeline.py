"""The training-corpus pipeline: STAGES in order, each over all that its predecessor kept.

1. quality: documents that the quality classifier rejects go.
2. near duplicates: of documents linked by five-word shingles at a Jaccard
   similarity of 0.8 or more, one of each group stays.
3. pii: personal data become format-preserving pseudonyms.
4. mixture: sources are mixed to target weights; a document appears once for
   each pass over its source that takes any of it, in the order of the schedule.
5. packing: what is left is packed into sequences; one row per piece.

All but the last return the columns of documents, extra ones too, whatever their
names.

* Nulls: a null text counts as empty, a null source is a source, a null id is a
  document of its own; null labels and labels of unknown documents do nothing.
* Texts without words pass the quality stage unless their key is among the
  rejected, are never duplicates, and end in the mixture, which takes words.
* Ties: documents at the cut's key all stay; of linked documents the one with the
  least id stays (of rows equal in id and text, one).
* Very long texts are handled whole by every stage.
* Empty tables give an empty result; without labels of both kinds every document
  passes the quality stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seawake.llm.mixing import Mixture
from seawake.llm.ngram_join import without_near_duplicates
from seawake.llm.packing import pack
from seawake.llm.pii import pseudonymize_documents, session_key
from seawake.llm.quality import Resampler
from seawake.llm.storage import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return Resampler(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).resample(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs, k=5, num=80, den=100)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymize_documents(docs, session_key(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return Mixture(docs).mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("pii", pii),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL can express neither hashing nor packing; tests/llm compare run() with a brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; what passes from one to the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
