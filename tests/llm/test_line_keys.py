"""op2_fuzzy_line_dedup tells lines by their normalised text, without a split into words, and by the same words as ever."""

from ripplemark.llm import line_dedup


def test_keys_need_no_words_and_one_look_for_digits(spark):
    made = line_dedup.lines(spark.createDataFrame([(1, "gadobe limenu")], "doc_id long, text string"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "words" not in made.columns
    # once where a character is a word and once where it isn't
    assert plan.lower().count("contains(") <= 2, plan


def test_lines_of_the_same_words_have_the_same_key(spark):
    same = [
        ["ab 12\tcd", "AB 99 cd", "  ab\f00 \x0Bcd\r", "ab 00 cd"],
        ["日日b", "日 日 b"],
        ["KK", "k k", "K  K"],  # Kelvin signs have three bytes, their lower case has one
        ["日本9語", "日本1語", "日 本 0 語"],
        ["x　y z", "X　Y\tZ"],
        ["abcd", "ABCD "],
        ["a b c d"],
        ["ab cd"],
        ["日本語"],
    ]
    rows = [(g, line) for g, lines in enumerate(same) for line in lines]
    found = line_dedup.lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    keys = {g: {(r.h, r.c) for r in found if r.doc_id == g} for g in range(len(same))}
    assert len(found) == len(rows)
    assert all(len(k) == 1 for k in keys.values()), keys
    assert len(set().union(*keys.values())) == len(same)


def test_word_counts_and_fingerprints_are_those_of_the_words(spark):
    texts = ["one", "a b", "gadobe limenu gadobe", "日本語の文", "ab 12  cd", "été gadobe limenu", " ".join(["gadobe"] * 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [["one"], ["a", "b"], ["gadobe", "limenu", "gadobe"], list("日本語の文"), ["ab", "00", "cd"], ["été", "gadobe", "limenu"], ["gadobe"] * 40]
    given = spark.createDataFrame(list(enumerate(want)), "doc_id long, words array<string>")
    columns = ["doc_id", "n", "x", "y", "load", "z"]
    got = line_dedup.fingerprinted(line_dedup.lines(docs)).select(columns).orderBy("doc_id").collect()
    assert got == line_dedup.fingerprinted(given).select(columns).orderBy("doc_id").collect()
    assert [r.n for r in got] == [len(w) for w in want]
