"""What op2_fuzzy_line_dedup does for each word, block key and candidate pair, told from its plans; and that doing less of
it leaves the links as they are."""

import random

from pyspark.sql import functions as F
from test_line_recall import kept, line

from ripplemark.llm import line_dedup


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_dealt_to_groups_without_a_pass_for_each(spark):
    docs = spark.createDataFrame([(1, "gadobe limenu")], "doc_id long, text string")
    made = line_dedup.fingerprinted(line_dedup.lines(docs))
    assert "filter(" not in plan(made)
    # block keys need no lambda either, so that they are compiled
    assert "lambda" not in plan(line_dedup.filed(spark.createDataFrame([], "h long, c int, n int, x long, y long, load int, z long")))


def test_only_documents_with_candidates_are_split(spark):
    rng = random.Random(12)
    base = line(rng, 30)
    near = [*base[:7], "gadobegadobe", *base[8:]]
    texts = [" ".join(base), " ".join(near), *(" ".join(line(rng, 30)) for _ in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # another text under the same row would be told by its hash, so a document that isn't asked for need not be there
    distinct = line_dedup.fingerprinted(line_dedup.lines(docs)).withColumn("first", F.struct("doc_id", "t", "line_no")).withColumn("times", F.lit(1).cast("long"))
    a, b = (distinct.where(F.col("doc_id") == i).select(F.col("h").alias(f"{x}h"), F.col("c").alias(f"{x}c")) for i, x in enumerate("ab"))
    asked = []
    whole = line_dedup.words

    def watched(column):
        asked.append(column)
        return whole(column)

    line_dedup.words = watched
    try:
        found = line_dedup.verified(docs, distinct, a.crossJoin(b))
        assert found.count() == 1
    finally:
        line_dedup.words = whole
    assert len(asked) == 1 and "posexplode" not in plan(found)


def test_pairs_further_apart_than_their_words_say(spark):
    """Words that change places: the same words, so the small limit comes first and fails, and all allowed edits decide."""
    rng = random.Random(13)
    texts, stay = [], set()
    for i in range(10):
        base = line(rng, 40)
        moved = base[:5] + base[8:] + base[5:8]  # three taken out and put in: six edits of the eight that count
        turned = base[20:] + base[:20]  # forty
        texts += [" ".join(base), " ".join(moved), " ".join(turned)]
        stay |= {3 * i, 3 * i + 2}
    assert kept(spark, texts) == stay


def test_words_that_share_a_number_are_told_by_their_place(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "hashed", lambda w: F.pmod(w, F.lit(1)))
    rng = random.Random(14)
    base, other = line(rng, 20), line(rng, 20)
    texts = [" ".join(base), " ".join([*base[:19], "gadobegado"]), " ".join(base[::-1]), " ".join(other)]
    assert kept(spark, texts) == {0, 2, 3}
