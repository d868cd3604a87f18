"""Decontamination of long texts, which are read in stretches, and of benchmarks of many items."""

import random
import re
from functools import cache

import pytest
from brute import brute_contamination
from pyspark.sql import functions as F

from ripplemark.llm import contamination


def prose(rng, n):
    return "".join("".join(rng.choice("abc\u00e9A9") for _ in range(rng.randint(1, 3))) + rng.choice([" ", ", ", "\n"]) for _ in range(n))


@pytest.mark.parametrize("stretch", [1, 7, 40, 1000])
def test_stretches_hold_every_window(monkeypatch, stretch):
    monkeypatch.setattr(contamination, "STRETCH", stretch)
    rng = random.Random(stretch)
    for n in (0, 1, 5, 12, 13, 14, 60):
        text = prose(rng, n) + "x" * rng.choice([0, 90])
        whole = contamination.words(contamination.pa.array([text.encode()]))
        want = [whole.text(i, 13) for i in range(len(whole.hash) - 12)]
        got = {}
        for first, at, w in contamination.stretches(text.encode(), 13):
            assert text.encode()[at:][int(w.start[0]) :].lower().startswith(w.text(0, 1)) if len(w.hash) else True
            for i in range(len(w.hash) - 12):
                assert got.setdefault(first + i, w.text(i, 13)) == w.text(i, 13)
        assert [got[i] for i in sorted(got)] == want
        assert contamination.counted([text.encode(), None]) == [len(whole.hash), 0]
        if n > 5:
            spans = [{"first": 0, "last": 1}, {"first": 4, "last": n - 2}]
            raw = text.encode()
            left = raw[: whole.start[0]] + raw[whole.end[1] : whole.start[4]] + raw[whole.end[n - 2] :]
            assert contamination.without(raw, spans) == left


def hits(text, grams):
    """n_words, n_hit and contaminated, by one set of windows of all items."""
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").replace("A", "a"))
    hit = {j for n in {len(g) for g in grams} for i in range(len(own) - n + 1) if tuple(own[i : i + n]) in grams for j in range(i, i + n)}
    return len(own), len(hit), bool(hit) and 20 * len(hit) >= len(own)


@cache
def case():
    """Benchmark items, rows of documents and what is to come out for each row."""
    rng = random.Random(5)
    shared = prose(rng, 30)
    items = [(i, prose(rng, rng.randint(9, 40)) + (shared if i % 3 == 0 else "")) for i in range(200)] + [(None, shared), (7, shared), (900, "")]
    long = prose(rng, 1_300_000)
    long = long[: len(long) // 2] + " " + items[4][1] + " " + shared + long[len(long) // 2 :] + shared
    assert len(long.encode()) > contamination.STRETCH
    texts = [long, *(prose(rng, 20) + (shared if i % 2 else "") + items[i][1] for i in range(60)), shared, shared, None, ""]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.replace("A", "a")) for _, t in items]
    grams = {tuple(w[i : i + 13]) for w in words for i in range(max(1, len(w) - 12))} - {()}
    return shared, items, rows, sorted(((i, *hits(t, grams)) for i, t in rows), key=str)


@pytest.mark.parametrize("size", [4 << 20, 0], ids=["broadcast", "joined"])
def test_long_text_and_many_items(spark, monkeypatch, size):
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", size)
    shared, items, rows, want = case()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    numbered = [(i, t) for i, t in items if i is not None]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in contamination.query(docs, bench).collect()), key=str)
    assert got == want
    short = docs.where("text is null or length(text) < 10000")
    got = sorted((tuple(r) for r in contamination.query(short, bench.where("item_id is not null")).collect()), key=str)
    assert got == sorted(((i, *brute_contamination(t, numbered)) for i, t in rows[1:]), key=str)
    cleaned = contamination.remove_spans(docs, bench)
    assert cleaned.columns == docs.columns and not [r for r in cleaned.collect() if r.text and shared.strip() in r.text]
