"""From raw documents to token ids: quality filter, near-duplicate removal, source mixing and byte-level BPE.

Each stage takes (spark, docs, sf_dir), where docs is the Parquet that the stage before it wrote, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.bpe import encode_checked
from millrace.llm.common import free_name, shared_folder, table, until_exit
from millrace.llm.mixing import mixed_documents
from millrace.llm.near_copies import one_of_each
from millrace.llm.queries import GOOD, held_out

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. A null or empty text is judged like any other."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    name = free_name(docs, "score")
    return quality.score(docs, model, score_col=name).filter(F.col(name) >= GOOD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id: equal texts, and such as share 0.8 of their five-word shingles."""
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and documents of small sources up to twice, as temperature mixing has it."""
    return mixed_documents(docs, repeat_limit=2.0)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and pass: doc_id, source, its token ids, and whether decoding them gives the text back."""
    done = encode_checked(docs.select(F.struct("doc_id", "source").alias("key"), "text"), id_col="key")
    return done.select("key.doc_id", "key.source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("same").alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", to_tokens),
]

#: A trained classifier and token merges have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        until_exit(spark, f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
