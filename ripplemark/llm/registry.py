"""The corpus operators' queries over the driver tables, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contamination, divergence, langid, line_dedup, merkle, mixing, packing, records, sharding, simhash, url_filter, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": lambda s, d: langid.query(_table(s, d, "documents")),
        "op2_fuzzy_line_dedup": lambda s, d: line_dedup.query(_table(s, d, "documents")),
        "op3_url_filters": lambda s, d: url_filter.query(_table(s, d, "pages")),
        "op4_token_records": lambda s, d: records.query(_table(s, d, "documents")),
        "op5_decontamination": lambda s, d: contamination.query(_table(s, d, "documents"), _table(s, d, "benchmark")),
        "op6_simhash_near_dedup": lambda s, d: simhash.query(_table(s, d, "documents")),
        "op7_merkle_fingerprints": lambda s, d: merkle.query(_table(s, d, "documents")),
        "op8_warc": lambda s, d: warc.query(_table(s, d, "pages")),
        "op9_source_mixing": lambda s, d: mixing.query(_table(s, d, "documents")),
        "op10_histogram_sharding": lambda s, d: sharding.query(_table(s, d, "documents")),
        "op11_binary_packing": lambda s, d: packing.query(_table(s, d, "documents")),
        "op12_vector_codes": lambda s, d: vector_codes.query(_table(s, d, "embeddings")),
        "op13_source_divergence": lambda s, d: divergence.query(_table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": url_filter.ORACLE,
        "op5_decontamination": contamination.ORACLE,
        "op8_warc": warc.ORACLE,
        "op9_source_mixing": mixing.ORACLE,
        "op12_vector_codes": vector_codes.ORACLE,
        "op13_source_divergence": divergence.ORACLE,
    }
