"""Source divergence against a plain count; trees that share nodes; several blocks and tiles; odd tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ripplemark.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, listed=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = (text or "").translate(LOWER), lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall(text)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = Counter()
        for g in groups:
            if g[0] == lang:
                total.update({t: counts[g][t] for t in kept})

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        own, whole = share(counts[lang, source]), share(total)
        pairs = [(-sum(abs(own[t] - s[t]) for t in kept), o.encode(), o) for la, o in groups if la == lang and o != source for s in [share(counts[la, o])]]
        terms = [(whole[t] - own[t], t.encode(), t) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:listed])):
            out += [(lang, source, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def held(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, term int, n string").repartition(4)
    return sorted(tuple(r) for r in D.audit(df, **more).collect())


def corpus(seed, n, words, sources):
    rng = random.Random(seed)
    return [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(sources)) for _ in range(n)]


ODD = ["The", "the", "THE", "Größe", "größe", "GRÖSSE", "naïve", "x1y", "don't", "漢字", "a-b", "Ωmega", "zz", "É", "\x00q", "_u_"]


def test_audit_equals_a_plain_count(spark):
    rows = corpus(1, 400, ODD + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)], ["s0", "s1", "S2", None, "é"])
    rows += [(None, "en", "s0"), ("", "xx", "only"), ("the the", "xx", None), ("12 34", "empty", "a"), (None, "empty", "b"), rows[0], rows[0]]
    got = held(spark, rows)
    assert got == plain(rows) and {r[2] for r in got} == {"pair", "term"}
    assert held(spark, rows, least_docs=1, listed=3) == plain(rows, 1, 3)
    assert [r for r in got if r[0] == "empty"] == [("empty", "a", "pair", "b", 0, 1), ("empty", "b", "pair", "a", 0, 1)]


def test_many_blocks_tiles_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 50)
    monkeypatch.setattr(D, "STRETCH", 7)
    monkeypatch.setattr(D, "BLOCK", 8)
    monkeypatch.setattr(D, "TILE", 2)
    monkeypatch.setattr(D, "FRONTIER", 16)
    rows = corpus(2, 150, [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)] + ["averyverylongterm" * 3], [f"s{i}" for i in range(7)])
    # the changed sizes are those of this process; forests and texts are tested here, the plan below
    texts = [" ".join(w for r in rows for w in [r[0]]), "", "...", "Ab", "é" * 40 + " " + "b" * 30, " x" * 20]
    import pyarrow as pa

    for text in texts:
        assert [w.decode() for words in D._words(pa.scalar(text).cast(pa.binary())) for w in words] == TERM.findall(text.translate(LOWER))
    monkeypatch.undo()
    assert held(spark, rows, least_docs=2) == plain(rows, 2)


@pytest.mark.parametrize("seed", range(4))
def test_forest_prices_equal_sums(seed):
    rng = np.random.default_rng(seed)
    rows = rng.choice([0, 0, 0, 1, 2, 7], (9, 256)) * rng.integers(0, 2, (9, 1)) if seed else np.zeros((3, 16), int)
    rows[0] = rows[-1]
    below = rows.sum(axis=1) + 5 * rows.shape[1]
    forest = D.Forest(rows)
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))]))
    shares = [[1 + 10**9 * (int(c) + 5) // int(below[i]) for c in rows[i]] for i in range(len(rows))]
    zero = [1 + 10**9 * 5 // int(x) for x in below]
    want = [sum(abs(x - y) for x, y in zip(shares[i], shares[j])) - rows.shape[1] * abs(zero[i] - zero[j]) for i, j in zip(a, b)]
    assert forest.price(a, b, below).tolist() == want
    assert forest.roots[0] == forest.roots[-1]  # equal trees are one
    assert all(len(level) <= rows.size // 2 + 1 for level in forest.children)


def test_shares_are_exact():
    rng = random.Random(0)
    n = [0, 1, 5, 10**6, 10**12, 9 * 10**14] + [rng.randrange(10**13) for _ in range(50)]
    below = [5, 7, 11, 10**7 + 1, 10**13 + 3, 9 * 10**15 - 1] + [rng.randrange(1, 9 * 10**15) for _ in range(50)]
    pairs = [(c, m) for c, m in zip(n, below) if c + 5 <= m]
    assert D.shares(np.array([c for c, _ in pairs]), np.array([m for _, m in pairs])).tolist() == [1 + 10**9 * (c + 5) // m for c, m in pairs]


def test_wide_languages_go_over_blocks(spark):
    # more kept terms than a block has, more sources than a tile
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c for a in letters for b in letters for c in letters[:8]]
    rng = random.Random(3)
    rows = [(" ".join(rng.sample(words, 300)), "en", f"s{i % 70}") for i in range(140)]
    assert held(spark, rows, least_docs=1, listed=2) == plain(rows, 1, 2)


def test_no_documents(spark):
    assert held(spark, []) == []
