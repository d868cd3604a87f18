"""Rule vectors stored under the signature of the rules: computed once for each content, read back while it agrees."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval

#: What reading lost or damaged files ends in.
UNREADABLE = (PySparkException, Py4JJavaError)
WEIGHTS, VECTORS = "term string, df long, idf double", "term string, weight double"
COMMIT = "signature string, attempt string, at timestamp, n_weights long, weights_sum long, n_vectors long, vectors_sum long"


@dataclass(frozen=True)
class Stored:
    """signature of the rules; reused: whether nothing had to be computed; weights: (term, df, idf); vectors: (key, term, weight)."""

    signature: str
    reused: bool
    weights: DataFrame
    vectors: DataFrame


def rule_vectors(rules: DataFrame, key: str, text: str, folder: str) -> Stored:
    """TF-IDF vectors of the rules (key, text), from a folder that all executors share.

    The folder holds a table for each content that was ever seen, named by the content's signature, and a row in commits
    for each table that was written whole, with its counts and the sums of its rows' hashes. A table is used if its
    rows still add up to that; otherwise (other rules, an attempt that was broken off, files lost or damaged) it is
    made again under a new name and committed. So a table is never changed, readers of an older one aren't disturbed,
    and of two writers at a time both are right.
    """
    spark = rules.sparkSession
    signature = retrieval.signature(rules, key, text).first()[0]
    kind = rules.schema[key].dataType.simpleString()
    for attempt, *want in _commits(spark, folder, signature):
        found = _whole(spark, f"{folder}/{signature}/{attempt}", kind, key, want)
        if found:
            return Stored(signature, True, *found)
    attempt = uuid.uuid4().hex
    at = f"{folder}/{signature}/{attempt}"
    counted = retrieval.terms(rules, key, F.col(text))
    retrieval.idf(counted, key).write.parquet(f"{at}/weights")
    weights = spark.read.schema(WEIGHTS).parquet(f"{at}/weights")
    retrieval.vectors(counted, weights, key).write.parquet(f"{at}/vectors")
    made = _tables(spark, at, kind, key)
    spark.createDataFrame([(signature, attempt)], "signature string, attempt string").select(
        "signature", "attempt", F.current_timestamp().alias("at"), *[F.lit(x).cast("long").alias(c) for x, c in zip(_sums(made), ("n_weights", "weights_sum", "n_vectors", "vectors_sum"))]
    ).coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return Stored(signature, False, *made)


def _tables(spark: SparkSession, at: str, kind: str, key: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(WEIGHTS).parquet(f"{at}/weights"), spark.read.schema(f"`{key}` {kind}, {VECTORS}").parquet(f"{at}/vectors")


def _commits(spark: SparkSession, folder: str, signature: str) -> list[list]:
    """Attempts at a content, the newest first, of those commits that can be read."""
    try:
        rows = spark.read.option("ignoreCorruptFiles", True).schema(COMMIT).parquet(f"{folder}/commits").where(F.col("signature") == signature)
        return [[r.attempt, r.n_weights, r.weights_sum, r.n_vectors, r.vectors_sum] for r in rows.orderBy(F.desc("at"), "attempt").collect()]
    except UNREADABLE:
        return []


def _whole(spark: SparkSession, at: str, kind: str, key: str, want: list[int]) -> tuple[DataFrame, DataFrame] | None:
    """The tables of an attempt if they can be read and add up."""
    try:
        found = _tables(spark, at, kind, key)
        return found if _sums(found) == want else None
    except UNREADABLE:
        return None


def _sums(tables: tuple[DataFrame, DataFrame]) -> list[int]:
    """Rows of each table and the sum of their hashes' lower halves."""
    return [x for t in tables for x in t.agg(F.count("*"), F.coalesce(F.sum(_hash(t).bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0))).first()]


def _hash(table: DataFrame) -> Column:
    return F.xxhash64(*table.columns)


def newest(folder: str, spark: SparkSession) -> DataFrame:
    """(signature, attempt, at, …): the newest commit of each content, for whoever clears a folder."""
    latest = F.max_by(F.struct(*[c.split()[0] for c in COMMIT.split(", ")]), "at").alias("c")
    return spark.read.schema(COMMIT).parquet(f"{folder}/commits").groupBy("signature").agg(latest).select("c.*")


def unioned(runs: list[tuple[str, Stored]]) -> DataFrame:
    """Vectors of several runs: run, reused, signature and the vectors' columns."""
    return reduce(DataFrame.unionByName, [s.vectors.select(F.lit(name).alias("run"), F.lit(s.reused).alias("reused"), F.lit(s.signature).alias("signature"), "*") for name, s in runs])
