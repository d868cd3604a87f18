"""The pipeline's stages, each against a brute-force version on its own input; and the queries that have SQL."""

import glob
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import brute_components, brute_contamination, brute_fingerprint
from pyspark.sql import functions as F

import corpus_pipeline
from ripplemark.llm import records, registry
from ripplemark.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9000, None, None, "src1", 0), (9001, "123 !!", "en", "src1", 6), (9002, "", None, None, 0), (9003, docs.first().text, "en", None, 1)], docs.schema)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    planted = spark.createDataFrame([(9004, items[0][1] + " and more " * 3, "en", "src2", 1)], docs.schema)
    now = cut(docs.unionByName(extra).unionByName(planted), "test")
    kept = []
    for (name, stage), columns in zip(corpus_pipeline.STAGES, [docs.columns] * 4 + [["doc_id", "start", "n_tokens", "ids_crc32"]], strict=True):
        after = cut(stage(spark, now, SF), "test")
        assert after.columns == columns, name
        kept.append((now.collect(), after.collect()))
        now = after
    before, after = kept[0]
    letters = {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in after} <= letters and len(after) >= 0.97 * len(letters)
    before, after = kept[1]
    ids, fps = [r.doc_id for r in before], [brute_fingerprint(r.text) for r in before]
    roots = brute_components(fps, 4)
    assert sorted(r.doc_id for r in after) == sorted({min(i for i, x in zip(ids, roots) if x == root) for root in roots})
    assert 9003 not in {r.doc_id for r in after}
    before, after = kept[2]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not brute_contamination(r.text, items)[-1])
    assert 9004 not in {r.doc_id for r in after}
    before, after = kept[3]
    own = {r.doc_id: r for r in before}
    assert all(r == own[r.doc_id] for r in after) and max(Counter(r.doc_id for r in after).values()) <= 3
    size = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(size(after) - size(before)) <= 0.1 * size(before)
    before, after = kept[4]
    tok = Tokenizer.from_file(records.tokenizer_path("word_bpe_49k.json"))
    want = Counter((r.doc_id, zlib.crc32(np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in before)
    assert Counter((r.doc_id, r.ids_crc32) for r in after) == want
    start = 0
    for r in sorted(after, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_tables(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = {c: F.lit(c) for c in ("row", "items", "spans", "hash", "id", "t", "size", "taken", "component", "start", "lang_pred", "score", "__id", "__key", "__t", "of", "nth", "words")}
    long = docs.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.expr("repeat(concat(text, ' longer '), 300)").alias("text"), *docs.columns[2:])
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (-2, "again and again", "en", None, 2), (-2, "again and again", "en", None, 2)], docs.schema)
    wide = cut(docs.limit(40).unionByName(long).unionByName(odd).withColumns(clash), "test")
    assert stage(spark, wide.limit(0), SF).count() == 0
    made = stage(spark, wide, SF)
    rows = made.collect()
    if name == "token_records":
        assert made.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and len(rows) == wide.count()
    else:
        assert made.columns == wide.columns and all(r[c] == c for r in rows for c in clash)
        assert {r.doc_id for r in rows} <= {r.doc_id for r in wide.select("doc_id").collect()}
        # the long text is most of its source, of which the mix takes less than half
        assert (-1 in {r.doc_id for r in rows}) == (name != "source_mixing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = duck.sql(registry.oracle_sql()[name])
    order = [df.columns.index(c) for c in got.columns]
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted([show(r[i]) for i in order] for r in df.collect()) == sorted([show(x) for x in r] for r in got.fetchall())
