"""Benchmark decontamination: a broadcast set of hashed benchmark n-grams, scanned over every document's words; for a
benchmark too large for that, broadcast marks of a fixed size and a join.

Words are found on UTF-8 bytes: ASCII letters (lower-cased) and digits and every byte of a non-ASCII character. Word
and window hashes come from prefix sums of polynomials modulo 2^64, for a whole batch of texts at once; each window
whose hash is in the set is then compared word by word, so hashes never decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, join_counted, slices

#: A text is read in stretches of so many bytes, so that a long one takes no more memory than a batch of short ones.
STRETCH = 4 << 20
#: Bytes of benchmark text up to which the benchmark's windows are broadcast (some ten bytes a byte); windows of a larger
#: benchmark are joined.
BROADCAST_BYTES = 4 << 20
#: Bits of a window's hash that the broadcast marks of a larger benchmark tell apart: 8 MB, whatever the benchmark's size.
MARK_BITS = 26
#: Rows of an Arrow batch of windows.
ROWS = 20_000
APART = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
STEP, WORD_STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@dataclass(frozen=True)
class Words:
    """Words of a buffer of texts: byte bounds, hashes, and for each text the bounds of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def window_hashes(self, size: int) -> np.ndarray:
        """Hash of the words i to i + size - 1, for every i that has so many after it in the buffer."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash * _powers(WORD_STEP, n), dtype=np.uint64)))
        return (sums[size:] - sums[:-size]) * _powers(_inverse(WORD_STEP), n)[: n - size + 1]

    def text(self, i: int, size: int) -> bytes:
        return b" ".join(self.data[self.start[j] : self.end[j]].tobytes() for j in range(i, i + size))


def words(texts: pa.Array) -> Words:
    """Words of all texts (binary or null), lower-cased."""
    parts = [t.as_py() or b"" for t in texts]
    # a zero byte after each text parts it from the next
    data = np.frombuffer(b"\0".join([*parts, b""]).lower(), np.uint8)
    code = np.zeros(256, bool)
    code[0x30:0x3A] = code[0x61:0x7B] = code[0x80:] = True
    inside = np.concatenate(([False], code[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(STEP, len(data)), dtype=np.uint64)))
    hashes = (sums[end] - sums[start]) * _powers(_inverse(STEP), len(data) + 1)[start]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return Words(data, start, end, hashes, np.searchsorted(start, bounds))


def stretches(data: bytes, size: int) -> Iterator[tuple[int, int, Words]]:
    """(number of the first word, place of the first byte, words) of a text's stretches, cut between words; size - 1 words are read again, so that
    every window of size words lies in one stretch."""
    at = first = end = 0
    while True:
        found = APART.search(data, max(at + STRETCH, end + 1)) if len(data) - at > STRETCH else None
        end = found.start() if found else len(data)
        w = words(pa.array([data[at:end]], pa.binary()))
        yield first, at, w
        if end == len(data):
            return
        n = len(w.hash)
        again = min(size - 1, n)
        first += n - again
        at = at + int(w.start[n - again]) if again else end


def pieces(texts: list[bytes | None], size: int) -> Iterator[tuple[list[int], int, Words]]:
    """(places among texts, number of the first word, words): the short texts together, each long one in stretches."""
    short = [i for i, t in enumerate(texts) if len(t or b"") <= STRETCH]
    if short:
        yield short, 0, words(pa.array([texts[i] for i in short], pa.binary()))
    for i, t in enumerate(texts):
        if len(t or b"") > STRETCH:
            for first, _, w in stretches(t, size):
                yield [i], first, w


def counted(texts: list[bytes | None]) -> list[int]:
    """Number of words of every text."""
    n = np.zeros(len(texts), np.int64)
    for places, base, w in pieces(texts, 1):
        n[places] = base + np.diff(w.first)
    return n.tolist()


def placed(w: Words, size: int, where: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text of the buffer, first word in it, first word in the buffer) of the windows at which where holds; a window
    never spans two texts."""
    at = np.flatnonzero(where)
    text = np.searchsorted(w.first, at, side="right") - 1
    inside = at + size <= w.first[text + 1]
    at, text = at[inside], text[inside]
    return zip(text.tolist(), (at - w.first[text]).tolist(), at.tolist())


@dataclass(frozen=True)
class Group:
    """Windows of one size: hashes (sorted), the place of each one's words in the index's buffer, and its items, as
    bounds in items (numbers of ids)."""

    size: int
    hashes: np.ndarray
    first: np.ndarray
    bounds: np.ndarray
    items: np.ndarray


@dataclass(frozen=True)
class Index:
    """A benchmark's windows: words of all items, parted by blanks, the items' ids and the windows by size."""

    words: Words
    ids: list[int | None]
    groups: list[Group]

    def occurrences(self, w: Words) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(text of the buffer, first word in it, size, item numbers) of every occurrence, compared word by word."""
        for g in self.groups:
            hashes = w.window_hashes(g.size)
            low = np.searchsorted(g.hashes, hashes)
            here = g.hashes[np.minimum(low, len(g.hashes) - 1)] == hashes
            for text, first, at in placed(w, g.size, here):
                said = w.text(at, g.size)
                for j in range(int(low[at]), len(g.hashes)):
                    if g.hashes[j] != hashes[at]:
                        break
                    if self.words.text(int(g.first[j]), g.size) == said:
                        yield text, first, g.size, g.items[g.bounds[j] : g.bounds[j + 1]]
                        break


def index_items(items: list[tuple[int | None, bytes]], size: int) -> Index:
    """Windows of benchmark items; an item of fewer words is one window of its own size. Ids may be null or repeat."""
    w = words(pa.array([t for _, t in items], pa.binary()))
    ids = sorted({i for i, _ in items}, key=lambda x: (x is not None, x or 0))
    number = {x: i for i, x in enumerate(ids)}
    found: dict[int, dict[bytes, tuple[int, set[int]]]] = {}
    for i, (item, _) in enumerate(items):
        low, high = int(w.first[i]), int(w.first[i + 1])
        own = min(size, high - low)
        for at in range(low, high - own + 1) if own else ():
            found.setdefault(own, {}).setdefault(w.text(at, own), (at, set()))[1].add(number[item])
    groups = []
    for own, windows in sorted(found.items()):
        hashes = w.window_hashes(own)
        order = sorted(windows.values(), key=lambda x: int(hashes[x[0]]))
        first = np.array([at for at, _ in order])
        bounds = np.cumsum([0, *(len(s) for _, s in order)])
        groups.append(Group(own, hashes[first], first, bounds, np.array([x for _, s in order for x in sorted(s)])))
    return Index(w, ids, groups)


def merged(spans: Iterable[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans (first word, last word) with those that overlap made one, in order."""
    out: list[dict[str, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1]["last"]:
            out[-1]["last"] = max(last, out[-1]["last"])
        else:
            out.append({"first": first, "last": last})
    return out


SPANS = "array<struct<first:long,last:long>>"
ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def scan(docs: DataFrame, benchmark: DataFrame, carry: list[Column], size: int = 13) -> DataFrame:
    """row (a struct of carry columns), text (binary), n_words, spans (hit words as disjoint spans of positions from 0,
    last included, in order) and items (distinct ids of items that occur).

    Windows of a benchmark of BROADCAST_BYTES at most are broadcast, so this is one map over the documents. Those of a
    larger one are joined: see joined().
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    if (items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) > BROADCAST_BYTES:
        return joined(docs, items, carry, size)
    held = docs.sparkSession.sparkContext.broadcast(index_items([(r.item_id, bytes(r.text)) for r in items.collect()], size))
    rows = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            spans, items, n_words = [set() for _ in texts], [set() for _ in texts], np.zeros(len(texts), np.int64)
            for places, base, w in pieces(texts, size):
                n_words[places] = base + np.diff(w.first)
                for text, first, n, found in held.value.occurrences(w):
                    spans[places[text]].add((base + first, base + first + n - 1))
                    items[places[text]].update(found.tolist())
            yield _scanned(batch, n_words, [merged(s) for s in spans], [[held.value.ids[x] for x in sorted(i)] for i in items])

    return rows.mapInArrow(run, _schema(rows))


def _schema(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields[:2], *StructType.fromDDL(f"n_words long, spans {SPANS}, items array<long>").fields])


def _scanned(batch: pa.RecordBatch, n_words: list[int] | np.ndarray, spans: list, items: list) -> pa.RecordBatch:
    columns = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, ARROW_SPANS), pa.array(items, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_words", "spans", "items"])


def _batched(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some), kinds.values())], names=list(kinds))


WINDOW = {"size": pa.int32(), "hash": pa.int64(), "words": pa.binary()}


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """size, hash, words and item_id of every window of items (item_id, binary text)."""

    def windows(item: int | None, text: bytes) -> Iterator[tuple]:
        own = min(size, *counted([text]))
        for _, _, w in stretches(text, own) if own else ():
            hashes = w.window_hashes(own).view(np.int64)
            for at in range(len(hashes)):
                yield own, int(hashes[at]), w.text(at, own), item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _batched(windows(item, text), WINDOW | {"item_id": pa.int64()})

    return items.mapInArrow(run, "size int, hash long, words binary, item_id long")


def joined(docs: DataFrame, items: DataFrame, carry: list[Column], size: int) -> DataFrame:
    """scan() for a benchmark of any size: items (item_id, binary text).

    Broadcast marks, of one size whatever the benchmark's, pass over most windows that no item has. The others are
    joined with the items' by hash and words, and what a document hits comes back to it by id and text hash. Windows
    that many documents share are joined by broadcast.
    """
    spark, key = docs.sparkSession, ["size", "hash", "words"]
    windows = cut(benchmark_windows(items, size), "benchmark-windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    bit = F.shiftrightunsigned("hash", 64 - MARK_BITS)
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    found = windows.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(F.bit_or(set_bit).alias("bits")).toArrow()
    marks = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    marks[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(marks)

    def marked(hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - MARK_BITS)
        return (held.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def candidates(ids: list, hashed: list, texts: list) -> Iterator[tuple]:
        for places, base, w in pieces(texts, size):
            for n in sizes:
                hashes = w.window_hashes(n)
                signed = hashes.view(np.int64)
                for text, first, at in placed(w, n, marked(hashes)):
                    yield n, int(signed[at]), w.text(at, n), ids[places[text]], hashed[places[text]], base + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            yield from _batched(candidates(*(c.to_pylist() for c in batch.columns)), WINDOW | {"id": pa.int64(), "t": pa.int64(), "first": pa.int64()})

    # a null id is told from -1 by the hash
    identity = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("t")]
    text = F.col("text").cast("string").cast("binary").alias("text")
    seen = cut(docs.select(*identity, text).mapInArrow(run, "size int, hash long, words binary, id long, t long, first long"), "document-windows")
    owners = windows.groupBy(*key).agg(F.collect_set(F.struct("item_id")).alias("items"))
    met = cut(seen.groupBy(*key).agg(F.count("*").alias("times")).join(owners, key), "met-windows")
    hits = join_counted(seen, met, key, "times", seen.count())
    own = hits.groupBy("id", "t").agg(F.collect_set(F.struct("first", "size")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    rows = docs.select(F.struct(*carry).alias("row"), text, *identity).join(own, ["id", "t"], "left").select("row", "text", "hits", F.col("items.item_id").alias("items"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            spans = [merged((h["first"], h["first"] + h["size"] - 1) for h in hit or ()) for hit in batch.column(2).to_pylist()]
            yield _scanned(batch, counted(batch.column(1).to_pylist()), spans, [x or [] for x in batch.column(3).to_pylist()])

    return rows.mapInArrow(gathered, _schema(rows))


def judge(docs: DataFrame, benchmark: DataFrame, carry: list[Column], size: int = 13) -> DataFrame:
    """scan()'s columns, n_hit and contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    counts = scan(docs, benchmark, carry, size).withColumn("n_hit", hit)
    return counts.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words; with no benchmark nothing is hit; items with a null or wordless text have no window;
    repeated rows are judged each.
    """
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return judge(docs, benchmark, [F.col("doc_id")]).select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def _columns(docs: DataFrame) -> list[Column]:
    """docs' columns again, of a row without its text and a binary text."""
    return [F.col("text").cast("string").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (all columns) without the contaminated ones; the others stay as they are, null and empty texts among them.

    Repeated rows go or stay together; an empty benchmark drops nothing; no docs give no rows.
    """
    return judge(docs, benchmark, [F.col(c) for c in docs.columns if c != "text"]).where("not contaminated").select(*_columns(docs))


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (all rows and columns) with the hit words cut out of every text: each span goes, from its first word's start
    to its last one's end. A null text stays null; a text without a hit stays as it is."""
    found = scan(docs, benchmark, [F.col(c) for c in docs.columns if c != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            out = [t if not spans else without(t, spans) for t, spans in zip(texts, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["row", "text"])

    return found.mapInArrow(run, found.select("row", "text").schema).select(*_columns(docs))


def without(text: bytes, spans: list[dict[str, int]]) -> bytes:
    """text less the words of spans (disjoint, in order)."""
    firsts, lasts = np.array([[x["first"], x["last"]] for x in spans]).T
    starts, ends = [], []
    for base, offset, w in stretches(text, 1):
        n = len(w.hash)
        starts.append(offset + w.start[firsts[(firsts >= base) & (firsts < base + n)] - base])
        ends.append(offset + w.end[lasts[(lasts >= base) & (lasts < base + n)] - base])
    keep = np.ones(len(text), bool)
    for start, end in zip(np.concatenate(starts), np.concatenate(ends)):
        keep[start:end] = False
    return np.frombuffer(text, np.uint8)[keep].tobytes()


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS t
       FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
p AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS q FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN s USING (rid)
"""
