"""Shards where most rows agree in text and id, against sums by hand."""

import random

import pytest

from ripplemark.llm import sharding


def checked(spark, rows, shards=8):
    df = spark.createDataFrame(rows, "doc_id long, text string, size int, shard string").repartition(5)
    made = sharding.shard(df, shards).collect()
    assert sorted((str(r.row.doc_id), str(r.row.text)) for r in made) == sorted((str(r[0]), str(r[1])) for r in rows)
    assert all(r.size == len((r.row.text or "").encode()) + 1 for r in made)
    held = [sum(r.size for r in made if r.shard == s) for s in range(shards)]
    for s in range(shards):
        slots = sorted(r.slot for r in made if r.shard == s)
        assert slots == list(range(len(slots)))
    largest = max(r.size for r in made)
    assert max(held) - min(held) <= 2 * (0.01 * sum(held) / shards + largest), held
    return made


@pytest.mark.parametrize("share", [0.3, 0.8, 1.0])
def test_most_rows_are_equal(spark, share):
    rng = random.Random(1)
    n = int(1000 * share)
    rows = [(7, "the same line of text", 1, "x")] * n + [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(1, 40))), 1, "x") for i in range(1000 - n)]
    made = checked(spark, rows)
    assert len({r.shard for r in made if r.row.doc_id == 7 and r.row.text.startswith("the same")}) >= min(8, round(8 * share))


def test_several_heavy_groups_and_nulls(spark):
    rng = random.Random(2)
    rows = [(None, None, 1, None)] * 900 + [(None, "", 1, "x")] * 300 + [(1, "a", 1, "x")] * 500 + [(2, "a", 1, "x")] * 500 + [(i, "a", 1, "x") for i in range(400)]
    rows += [(i, "".join(rng.choice("xyz") for _ in range(6)), 1, "x") for i in range(200)]
    checked(spark, rows)
    checked(spark, rows, 3)


def test_spans_cover_all_numbers():
    cuts = [sharding.Splitter(1, 5, 0, 0), sharding.Splitter(4, 9, 0, 0, 3), sharding.Splitter(4, 9, 0, 0, 3), sharding.Splitter(4, 9, 0, 0, 8), sharding.Splitter(6, 0, 0, 0)]
    assert sharding.spans(sharding.Copies(4, 9, 10, 100), cuts) == [(1, 0, 3), (3, 3, 8), (4, 8, 10)]
    assert sharding.spans(sharding.Copies(4, 9, 8, 80), cuts) == [(1, 0, 3), (3, 3, 8)]
    assert sharding.spans(sharding.Copies(9, 9, 2, 2), cuts) == [(5, 0, 2)]


def test_shards_are_written_whatever_the_names(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", i, "r") for i in range(40)], "doc_id long, text string, slot_no int, row string")
    sharding.write_shards(df, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {"doc_id", "text", "slot_no", "row", "slot_no_", "shard_no"} and back.count() == 40
    assert sorted((r.doc_id, r.slot_no) for r in back.collect()) == [(i, i) for i in range(40)]
