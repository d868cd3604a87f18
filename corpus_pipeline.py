"""A corpus from documents to token records: five stages, each written as Parquet and read again by the next.

Every stage takes the columns of documents, among them doc_id, text and source, which may hold nulls, repeats and ties;
other columns, whatever their names, go through as they are. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ripplemark.llm import contamination, langid, mixing, records, simhash
from ripplemark.llm.common import cut
from ripplemark.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    A null, empty or letterless text goes, and so does one whose best language has a score under 0.3; rows of equal
    texts are told alike. If no row has a language label, nothing is learned and every text with a letter stays.
    """
    return langid.keep_known(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, ids before null.

    Texts without a word, null ones too, are copies of each other; of repeated rows one stays. A row without an id is a
    near copy like any other.
    """
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated: under one in twenty of their words lie in a benchmark window, or none.

    Null and empty texts stay; repeated rows are judged alike; an empty benchmark takes nothing away. Texts are read whole.
    """
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most: equal rows that may repeat.

    A document without a word has no size and isn't taken. Null is a source of its own; rows that agree in id (which
    may be null), source and size are taken alike. Reruns agree.
    """
    return mixing.resample(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The records read back: doc_id, start, n_tokens, ids_crc32, one row for each row taken.

    A null text is an empty one: its record holds the end id alone. Null ids come first, repeated rows are records each.
    Columns other than doc_id and text are left behind.
    """
    return records.query(docs)


STAGES = [
    ("language_id", _shipped(known_language)),
    ("simhash_near_dedup", _shipped(without_near_copies)),
    ("decontamination", _shipped(without_benchmark)),
    ("source_mixing", _shipped(mixed)),
    ("token_records", _shipped(token_records)),
]
#: Language prediction, XXH64 fingerprints and tokens have no SQL; tests/llm holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
