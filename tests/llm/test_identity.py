"""Rows whose ids are null or repeat: no clean text disappears with another row's lines or near copies."""

from collections import Counter

from ripplemark.llm import line_dedup, simhash


def test_lines_of_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "x\ny"), (None, "z\nx")], "doc_id long, text string")
    left = Counter(line for r in line_dedup.dedup_lines(docs).collect() for line in r.text.split("\n") if line)
    assert left == {"x": 1, "y": 1, "z": 1}


def test_lines_of_rows_that_share_an_id_and_of_copies(spark):
    rows = [(1, "same\none"), (1, "same\ntwo"), (2, "three\n\nfour"), (2, "three\n\nfour"), (2, "three\n\nfour")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(line for r in got for line in r.text.split("\n") if line) == Counter(["same", "one", "two", "three", "four"])
    assert sorted(tuple(r.cut) for r in got if r.doc_id == 2) == [(3, 0), (3, 2), (3, 2)]


def test_an_id_of_two_components_keeps_both(spark):
    rows = [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon"), (2, "quite another text that nobody copied"), (3, "first text of three"), (3, "second words under three")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == sorted([rows[0], *rows[2:]])
