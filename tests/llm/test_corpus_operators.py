"""Each corpus operator against a brute-force version, over hard rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import brute_components, brute_contamination, brute_fingerprint, brute_likeness, brute_merkle
from pyspark.sql import functions as F

from ripplemark.llm import common, contamination, langid, line_dedup, merkle, mixing, records, sharding, simhash, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, row string, shard int, taken long"


def prose(rng, n, alphabet="abcde"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


def hard_texts():
    rng = random.Random(7)
    base = prose(rng, 60)
    near = base.split()
    near[10] = "zzzz"
    return [
        base, base, base.upper(), " ".join(near), None, None, "", " \t\n ", "x", "one two three", "ünï çödé " * 30, prose(rng, 4000),
        "a\n\nb\n a \nA\nb\n\n" + base, base + "\n" + prose(rng, 50), "word\n" * 500, "日本語の文章です。", "12345 !!!", *(prose(rng, rng.randint(1, 80), string.ascii_lowercase) for _ in range(25)),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], [None, "a", "B", "b"][i % 4], 0, 1, 0.5, "r", 9, 7) for i, t in enumerate(hard_texts())]
    rows += [rows[0], rows[0], (None, "no id", "en", "a", 0, 1, 0.5, "r", 9, 7), (None, None, None, None, 0, 1, 0.5, "r", 9, 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- components


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_total(spark):
    rows = [(g, i % 7, i, i) for g in ("a", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, chunk int, i int, v long")
    got = common.running_total(df, ["g"], "chunk", [F.col("i")], "v", "before").collect()
    for g in ("a", None):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.chunk, r.i)):
            assert r.before == total
            total += r.v
    assert len(got) == 100


# --- 1


def test_language_id(spark, docs, empty):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30, "abcdefg" if i % 2 else "nopqrst"), "xx" if i % 2 else "yy") for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.query(train).join(train.select("doc_id", "lang"), "doc_id").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [r for r in got.values() if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    got = langid.query(docs).collect()
    assert len(got) == docs.count()
    for r in langid.predict(docs, langid.fit(docs), F.col("doc_id")).collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.query(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.query(unlabelled).collect()} == {"und"}
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert langid.keep_known(unlabelled).count() == sum(any(c.isalpha() for c in t or "") for _, t in plain(docs))


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(500, 3)) * 5
    p = langid.softmax(z / 2.0)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert 1.5 < langid.calibrate(z, y) < 2.7


# --- 2


def test_line_dedup_exact_and_fuzzy(spark, docs, empty):
    got = {(r.doc_id, r.text): (r.cut.n_lines, r.cut.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert all(t is not None or n == (0, 0) for (_, t), n in got.items())
    assert line_dedup.query(docs).count() == docs.count()
    assert line_dedup.query(empty).count() == 0
    rng = random.Random(5)
    words = prose(rng, 400, string.ascii_lowercase).split()
    changed = list(words)
    changed[100] = "qqqq"
    other = prose(rng, 300, string.ascii_lowercase)
    rows = [(1, " ".join(words) + "\n" + other), (2, "  " + " ".join(words).upper() + " \nkeep 12"), (3, " ".join(changed) + "\nkeep 99\n\nnew line"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got[1] == rows[0][1] and got[2] == "keep 12" and got[4] is None
    assert got[3] == "\nnew line"


@pytest.mark.parametrize(("line", "want"), [(" A  b\t1c9 ", ["a", "b", "0c0"]), ("A b", ["a", "b"]), ("a b ", ["a", "b"]), ("\r", [""]), ("x\rY", ["x", "y"]), ("0", ["0"]), ("ÀÉ 5", ["àé", "0"])])
def test_normalised_words(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(line_dedup.words(F.col("x"))).first()[0] == want


# --- 3


def brute_verdict(url, rules):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if r.host is not None and ("." + low).endswith("." + r.host) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    if best:
        return low, path, best.name, best.action
    hit = [r for r in rules if low and r.host is None and re.search(".*".join(map(re.escape, r.path.split("*"))), low + rest[len(host) :], re.S)]
    return low, path, None, max(hit, key=lambda r: len(r.name)).action if hit else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://ORG/", "http://a.Org/x", "https://example.org/es/1", "https://www.EXAMPLE.org/en/17?x#y", "http://example.org/en/2", "http://notexample.org/es/", "http://fr.com/fr/", "http://x.com/fr",
    "http://x.com/fr/?utm_source=feed", "http://x.com/de/a?b=://c", "http://y.net/fr/login/x", "http://y.net/a/archive/?utm_source=feed", "http://y.net?utm_source=feed", "http://y.net/A/archive/ads/b", "ftp://com/de/x", "http://xcom/de/", "http://org", "a\nb://org/\nx", "http://com/DE/", "HTTP://.org/",
]


@pytest.mark.parametrize("limit", [20_000, 0])
def test_url_filters(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, __host string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.query(df).collect()}
    for i, u in enumerate(URLS + URLS[:3]):
        assert got[i] == brute_verdict(u, url_filter.HOST_RULES + url_filter.PATTERN_RULES), u
    assert url_filter.query(df.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("com.fr",), ("com.de",), ("com.de",)], "u string").select(url_filter.tokens(F.col("u")).alias("tokens"))
    got = {r.name: r.token for r in url_filter.filed(spark, [url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de"), url_filter.Rule("block", None, "&x=")], urls).collect()}
    assert got == {"com/fr/": "fr", "com/de": "com", "&x=": "x"}


# --- 4


def test_token_records(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(records.tokenizer_path("word_bpe_49k.json"))
    got = records.query(docs).collect()
    ids = {t: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for _, t in plain(docs)}
    left = sorted(((i is not None, i or 0), len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in plain(docs))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in got) == left
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    in_order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order)
    assert records.query(empty).count() == 0
    index = records.write_records(docs, common.scratch(spark, "t"), "word_bpe_49k.json")
    fetched = sorted((r.doc_id or -1, bytes(r.ids)) for r in records.read_shuffled(index, 3).collect())
    assert fetched == sorted((i or -1, np.array(ids[t], "<u4").tobytes()) for i, t in plain(docs))


@pytest.mark.parametrize("text", ["", "it's İstanbul's 12½ don't!! <|endoftext|> x", "a\x85b c\x1cd", "é ﬁ ǅ ­", "日本 ΑΣ Σ", "''s 's'S", "ª º µ ſ ŉ"])
def test_encoder_equals_the_library(text):
    from tokenizers import Tokenizer

    path = records.tokenizer_path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(records._encoder(path, 2)(text), "<u2").tolist() == want


def test_damage_is_found():
    good = records.frame(records.payload(5, b"\1\0\2\0", 2))
    assert records.unframe(good)[0] == 5 and records.unframe(good)[1].tolist() == [1, 2]
    for i in range(len(good)):
        with pytest.raises(ValueError, match="record at 0"):
            records.unframe(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :])
    with pytest.raises(ValueError, match="record at 0"):
        records.unframe(good[:-1])


# --- 5


@pytest.mark.parametrize("size", [4 << 20, 0], ids=["broadcast", "joined"])
def test_decontamination(spark, docs, empty, monkeypatch, size):
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", size)
    base = hard_texts()[0]
    items = [(1, " ".join(base.split()[5:25])), (10, "X!"), (2, None), (3, "..."), (4, base.upper()), (5, "ünï çödé ünï"), (6, base[:40]), (1, base[:40])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in contamination.query(docs, bench).collect()), key=str)
    assert got == sorted(((i, *brute_contamination(t, items)) for i, t in plain(docs)), key=str)
    assert contamination.query(empty, bench).count() == 0
    assert not any(r.n_hit for r in contamination.query(docs, bench.limit(0)).collect())
    kept = contamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(plain(kept), key=str) == sorted(((i, t) for i, t in plain(docs) if not brute_contamination(t, items)[-1]), key=str)
    cleaned = contamination.remove_spans(docs, bench)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert (9, "one two three") in plain(cleaned) and (0, base) not in plain(cleaned)


# --- 6


def test_simhash_near_dedup(spark, docs, empty):
    rows = plain(docs)
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps, 4)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    want = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots)), key=str)
    assert sorted((tuple(r) for r in simhash.query(docs).collect()), key=str) == want
    assert simhash.query(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    best = lambda own: min(own, key=lambda r: (r[0] is None, r[0] or 0))[0]
    left = {r: best([x for x, root in zip(rows, roots) if root == r]) for r in set(roots)}
    assert sorted((i for i, _ in plain(kept)), key=str) == sorted(left.values(), key=str)
    assert all((i, t) in rows for i, t in plain(kept))


@pytest.mark.parametrize("small", [64, 2])
def test_links_connect_what_is_close(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_BLOCK", small)
    monkeypatch.setattr(simhash, "CHUNK", 5)
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(15)]
    for _ in range(100):
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)
    got = {r.node: r.root for r in common.components(found).collect()}
    roots = brute_components([f % (1 << 64) for f in fps], 4)
    assert [got.get(f, f) for f in fps] == [min(fps[j] for j in range(len(fps)) if roots[j] == r) for r in roots]


@pytest.mark.parametrize("hot", [1000, 2])
def test_keys_with_many_rows_are_joined_alike(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3, None])], "k long, v long")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).where("k is null or k < 3")
    got = common.join_counted(rows, table, ["k"], "n", 55).collect()
    assert sorted((r.k, r.v, r.n) for r in got) == [(1, i, 50) for i in range(50)] + [(2, i, 3) for i in range(50, 53)]


@pytest.mark.parametrize("count", [10, 10**5, 10**9])
def test_blocks_lose_no_pair(count):
    k = simhash.blocks_for(count, 4)
    masks = simhash.block_masks(k, 4)
    rng = random.Random(count)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), 4):
            b ^= 1 << i
        assert any((a & m) == (b & m) for m in (x % (1 << 64) for x in masks))


# --- 7


def test_merkle(spark, docs, empty):
    rows = sorted(plain(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    got = merkle.query(docs).collect()
    assert len(got) == len(rows)
    unique = [(i, t or "") for i, t in rows]
    ids = [i for i, _ in unique]
    for r in got:
        if ids.count(r.doc_id) > 1 or r.doc_id is None:
            continue
        at = ids.index(r.doc_id)
        text, after = unique[at][1], unique[(at + 1) % len(unique)]
        n = len(text) // 2
        assert r.n_chars == len(text)
        if ids.count(after[0]) == 1:
            changed = text[: len(text) - n] + after[1][:n]
            assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert r.edited_fingerprint == brute_merkle(changed)[0]
            assert r.near_edited == pytest.approx(brute_likeness(text, changed))
            assert r.near_next == pytest.approx(brute_likeness(text, after[1]))
        assert r.fingerprint == brute_merkle(text)[0]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert merkle.query(empty).count() == 0
    assert merkle.query(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first().near_next == 1.0
    texts = ["", " ", "\n", "\n\n", "a", "a ", "a\nb", "a\n\nb", "a b", "a b c d e", "a b c d\ne"]
    assert len({merkle.tree(t).root for t in texts}) == len(texts)


def test_edits_are_located(spark):
    old = spark.createDataFrame([(1, "a\nb\n\nc\nd"), (2, "same"), (3, None), (None, "x"), (4, "only old")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a\nB\n\nc\nd\ne"), (2, "same"), (3, None), (None, "y")], "doc_id long, text string")
    want = [(1, 0, 1, "modified"), (1, 1, 2, "added"), (4, 0, 0, "deleted"), (None, 0, 0, "modified")]
    assert sorted((tuple(r) for r in merkle.locate_edits(old, new).collect()), key=str) == sorted(want, key=str)
    assert merkle.locate_edits(old.limit(0), new.limit(0)).count() == 0


# --- 8


def test_warc(spark):
    html = "<p>" + "x" * 2000
    rows = [(1, "http://a/", html, "q"), (2, "http://b/\r\nInjected: 1", html, "q"), (3, None, html + "y", "q"), (4, "http://d/", "", "q"), (5, "http://e/", None, "q"), (6, "u", "short", "q"), (7, "u", "short", "q"), (9, "u", html, "q"), (None, "u", html, "q"), (8, "ü", "é" * 600, "q"), (8, "ü", "é" * 600, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((tuple(r) for r in warc.query(pages).collect()), key=str)
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        same = max((j for j, _, x, _ in rows if x == h and j is not None), default=None)
        revisit = len(data) >= 1000 and i != same
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", same if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.query(pages.limit(0)).count() == 0
    files = warc.write_warc(pages, common.scratch(spark, "t"))
    for split in (1, 57, 400, 1 << 20):
        found = warc.read_warc(files, split).collect()
        assert len(found) == len(rows) and len({(r.path, r.offset) for r in found}) == len(rows)
        assert sorted(r.payload for r in found if r.record_type == "response") == sorted((h or "").encode() for i, (_, _, h, _) in enumerate(rows) if i not in (0, 1, 8))


def test_damaged_archive_is_read_past_the_damage(tmp_path):
    from pyarrow import fs

    made = [warc.record(i, "http://x/", bytes([65 + i]) * 3000, "00" * 20, None, False) for i in range(5)]
    broken = bytearray(b"".join(made))
    broken[len(made[0]) + 30 : len(made[0]) + 40] = b"\xff" * 10
    (tmp_path / "x.warc.gz").write_bytes(bytes(broken))
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x.warc.gz")) as f:
        assert [r.payload[:1] for r in warc.records(f, 0, len(broken), len(broken))] == [b"A", b"C", b"D", b"E"]


# --- 9


def test_mixing(spark, docs, empty):
    got = mixing.query(docs).collect()
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, size(t)) for i, t, _ in rows)
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    total, target, weight = sum(own.values()), {}, {s: i % 3 + 1 for i, s in enumerate(sources)}
    free = set(sources)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * own[s]}
        if not over:
            break
        target.update({s: 3.0 * own[s] for s in over})
        free -= over
    target.update({s: level * weight[s] for s in free})
    plan = mixing.mix(docs).plan.collect()
    for s in sources:
        mine = [r for r in plan if r.source == s]
        assert {round(r.target, 6) for r in mine} == {round(target[s], 6)}
        assert abs(sum(r.taken * r.copies for r in mine) - target[s]) <= 0.02 * total
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.query(docs.repartition(5)).collect()), key=str)
    assert mixing.query(empty).count() == 0
    mixed = mixing.resample(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()}


def test_van_der_corput(spark):
    got = [r.u for r in spark.range(9).select(mixing.van_der_corput(F.col("id")).alias("u")).collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875, 0.0625]


# --- 10


def check_shards(made, rows, shards, tolerance):
    bytes_of = [0] * shards
    for s in range(shards):
        slots = sorted(r.slot for r in made if r.shard == s)
        assert slots == list(range(len(slots)))
        bytes_of[s] = sum(r.size for r in made if r.shard == s)
    largest = max((len((t or "").encode()) + 1 for _, t in rows), default=0)
    assert max(bytes_of) - min(bytes_of) <= 2 * (largest + tolerance * sum(bytes_of) / shards)
    assert len(made) == len(rows)


def test_sharding(spark, docs, empty):
    got = sharding.query(docs).collect()
    rows = plain(docs)
    check_shards(got, rows, 8, 0.01)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sharding.query(empty).count() == 0
    rng = random.Random(2)
    many = [(i, prose(rng, 20)) for i in range(400)] + [(1000 + i, prose(rng, 5)) for i in range(30) for _ in range(1)]
    hot = [(5000 + i, "copy " * 10) for i in range(400)]
    df = spark.createDataFrame(many + hot, "doc_id long, text string").repartition(5)
    made = sharding.shard(df, 4).collect()
    check_shards(made, many + hot, 4, 0.01)
    few = spark.createDataFrame(many + many[:50], "doc_id long, text string")
    made = sharding.shard(few, 4).collect()
    by_text = {}
    for r in made:
        by_text.setdefault(r.row.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


# --- shared


def test_slices_hold_bounded_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (1, 5, 100, 2, 3)] + [None])], names=["t"])
    got = [b.column(0).to_pylist() for b in common.by_bytes(batch, 0, 10)]
    assert [x for b in got for x in b] == batch.column(0).to_pylist()
    assert all(len(b) == 1 or sum(len(x or "") for x in b) <= 10 for b in got)
