"""Lines whose fingerprints agree in two blocks and whose edit similarity is 0.8 at least end in one group; how many of those
that edit similarity alone would link are found."""

import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from ripplemark.llm import line_dedup

SYLLABLES = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
MARKS = [chr(0x4E00 + i) for i in range(2000)]


def line(rng, n, sounds=SYLLABLES):
    return ["".join(rng.choice(sounds) for _ in range(rng.randint(1, 5) if sounds is SYLLABLES else 1)) for _ in range(n)]


def edited(rng, words, edits, sounds=SYLLABLES, kinds=(0, 1, 2)):
    out = list(words)
    for at in sorted(rng.sample(range(len(out)), edits), reverse=True):
        kind = rng.choice(kinds)
        out[at : at + (kind != 1)] = [] if kind == 2 else line(rng, 1, sounds)
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    return distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)


def fingerprint(words):
    """The bits of each block, as a set, and its number of words."""
    code = lambda w, seed=42: xxhash.xxh64_intdigest(w.encode(), seed)
    told = {code(w) for w in words if len(w.encode()) >= 4}
    if len(told) < 2:
        told = {code(b, code(a)) for a, b in zip(words, words[1:])}
    blocks = [[w for w in told if (w >> 52) % 5 == g] for g in range(5)]
    places = [16 * part + i for part in range(4) for i in range(4)]
    return [(frozenset(p for p in places if 2 * sum(w >> p & 1 for w in b) > len(b)), len(b)) for b in blocks]


def linked(a, b):
    x, y = fingerprint(a), fingerprint(b)
    agree = lambda g: x[g][0] == y[g][0]
    held = lambda f, g: min(f[g][1], 2)
    shared = any(agree(g) and agree(k) and min(held(x, g) + held(x, k), held(y, g) + held(y, k)) >= 2 for g, k in combinations(range(5), 2))
    return a == b or (max(len(a), len(b)) >= 5 and min(len(a), len(b)) >= 5 and shared and similar(a, b))


def groups(lines, link):
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if root[i] != root[j] and link(lines[i], lines[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if not r.cut.n_dropped}


@pytest.mark.parametrize("small", [64, 2])
def test_groups_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL_BLOCK", small)
    monkeypatch.setattr(line_dedup, "CHUNK", 3)
    rng = random.Random(4)
    found = []
    for n in (5, 6, 10, 20, 40, 150):
        for edits in (1, max(1, n // 10), n // 5):
            base = line(rng, n)
            found += [base, *(edited(rng, base, edits) for _ in range(3))]
    # lines that share words and little else, so that large blocks stay apart
    found += [["gadobe", "limenu", *line(rng, 8)] for _ in range(12)]
    found += [["ba"] * 30, ["ba"] * 26 + line(rng, 4), ["ba", "ce"] * 15, line(rng, 1), line(rng, 4), ["gadobe"] * 9]
    texts = [" ".join(w) for w in found]
    for edits in (0, 1, 4):
        base = line(rng, 30, MARKS)
        found += [base, edited(rng, base, edits, MARKS)]
        texts += ["".join(w) for w in found[-2:]]
    root = groups(found, linked)
    assert kept(spark, texts) == {min(i for i, r in enumerate(root) if r == k) for k in set(root)}


def test_fingerprints_against_plain_ones(spark, monkeypatch):
    rng = random.Random(9)
    found = [line(rng, n) for n in (1, 2, 3, 5, 9, 30, 400)] + [["a", "b", "c", "a", "b"], line(rng, 50, MARKS)]
    rows = [(i, w) for i, w in enumerate(found)]
    for narrow in (line_dedup.NARROW, 0):
        monkeypatch.setattr(line_dedup, "NARROW", narrow)
        got = line_dedup.fingerprinted(spark.createDataFrame(rows, "i int, words array<string>")).orderBy("i").collect()
        for r, w in zip(got, found):
            want = fingerprint(w)
            bits = [frozenset(16 * part + i for part in range(4) for i in range(4) if (r.x >> (16 * part + i + 4 * g)) & 1) for g in range(4)]
            bits.append(frozenset(p for p in range(64) if r.y >> p & 1))
            assert bits == [b for b, _ in want]
            assert [r.load >> 2 * g & 3 for g in range(5)] == [min(n, 2) for _, n in want]


#: Share of lines with so many changed words that must be found, by the number of words and of changes.
RECALL = {(10, 1): 0.95, (20, 1): 1.0, (40, 1): 1.0, (80, 1): 1.0, (10, 2): 0.5, (20, 2): 0.8, (40, 2): 0.85, (80, 2): 0.9, (40, 4): 0.3, (80, 4): 0.4}


def test_recall_of_changed_words(spark):
    rng = random.Random(2)
    rows, texts = [], []
    for n, edits in RECALL:
        for _ in range(100):
            base = line(rng, n)
            rows.append((n, edits))
            texts += [" ".join(base), " ".join(edited(rng, base, edits, kinds=(0,)))]
    stay = kept(spark, texts)
    share = {key: sum(2 * i + 1 not in stay for i, k in enumerate(rows) if k == key) / 100 for key in RECALL}
    print(share)
    assert all(share[key] >= least for key, least in RECALL.items()), share


def test_lines_that_only_share_words_stay(spark):
    rng = random.Random(3)
    texts = [" ".join(["gadobe", "limenu", *line(rng, 20)]) for _ in range(150)]
    assert len(kept(spark, texts)) == 150


def test_repeated_letters_changed_in_few_words(spark):
    """Edits are counted in words: ten words with one changed letter in two of them are alike, in three they aren't."""
    rng = random.Random(6)
    texts = []
    for _ in range(20):
        base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(10)]
        texts += [" ".join(base), " ".join(["z" + w[1:] if i in (2, 5, 7) else w for i, w in enumerate(base)])]
    assert len(kept(spark, texts)) == 40


def test_spark_hashes_like_the_library(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("gadobe")), F.xxhash64(F.lit("ga"), F.lit("do"))).first()
    assert got[0] % 2**64 == xxhash.xxh64_intdigest(b"gadobe", 42)
    assert got[1] % 2**64 == xxhash.xxh64_intdigest(b"do", xxhash.xxh64_intdigest(b"ga", 42))


def test_sketches_part_lines_of_other_words_and_never_similar_ones(spark):
    """Unrelated lines of one length are told apart without their texts; lines within the edits that count never are."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    pairs = []
    for i in range(200):
        a = [word() for _ in range(rng.randint(5, 60))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 5)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        pairs.append((i, True, a, b))
        pairs.append((i, False, [word() + "long" + word() for _ in range(20)], [word() + "long" + word() for _ in range(20)]))
    sides = [line_dedup.fingerprinted(spark.createDataFrame([(i, near, p[x]) for i, near, *p in pairs], "i int, near boolean, words array<string>")) for x in (0, 1)]
    a, b = (d.select("i", "near", F.col("n").alias(f"{x}n"), F.col("z").alias(f"{x}z")) for d, x in zip(sides, "ab"))
    got = [(r.near, r.may) for r in a.join(b, ["i", "near"]).select("near", line_dedup.may_be_similar("a", "b").alias("may")).collect()]
    assert len(got) == 400 and all(may for near, may in got if near) and sum(may for near, may in got if not near) < 10
