"""How far sources of a language are apart: segment trees over term ids, alike subtrees shared, pairs of trees priced.

A group (language, source) is the list of its counts by term id. Ids are dealt to blocks; over a block each group has a
segment tree whose nodes are hash-consed: a leaf is a count, a node the pair of its children, and whatever is equal is one
node, within a tree and among trees. Two groups are compared by going down their trees together; pairs of nodes that meet
more than once on a level are priced once and counted. Sums of blocks are added up by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_counted, running_total, slices

#: Documents of a language that a kept term is in at least; rank up to which a group's terms are listed.
LEAST_DOCS, LISTED = 30, 50
#: What is added to counts, and what shares are given in.
SMOOTHING, UNIT = 5, 1_000_000_000
#: Term ids of a block, and sources of a tile: a task holds BLOCK x 2 TILE counts at most.
BLOCK, TILE = 4096, 64
#: Pairs of nodes that are on a level at most when a task prices pairs of trees together.
FRONTIER = 1 << 20
#: Terms and groups whose counts a task holds before it hands them on, and bytes of a text that are cut into terms at a time.
HELD, STRETCH = 300_000, 1 << 20
COUNTED = "lang string, source string, term binary, n long, docs long"
#: Bytes by which terms are found: letters and what isn't ASCII stay, A-Z as a-z, all else is a blank.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _words(text: pa.Scalar) -> Iterator[list[bytes]]:
    """The terms of a text, in stretches that end between terms."""
    data = memoryview(text.as_buffer() or b"")
    at = 0
    while at < len(data):
        end = min(at + STRETCH, len(data))
        piece = bytes(data[at:end]).translate(LOWER)
        if end < len(data):
            last = piece.rfind(b" ", 1)
            while last < 0 and end < len(data):  # one term fills the stretch
                more = bytes(data[end : end + STRETCH]).translate(LOWER)
                found = more.find(b" ")
                piece, end = piece + (more if found < 0 else more[:found]), end + (len(more) if found < 0 else found)
                last = len(piece) if found >= 0 else -1
            if 0 <= last < len(piece):
                piece, end = piece[:last], at + last
        yield piece.split()
        at = end


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and documents that have it; a row with a null term
    for each group. Null text, lang and source count as ''. Repeated rows are documents each. Tasks add up what they read, in
    dictionaries of bounded size, before rows are exchanged; of a single text the different terms are held."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in groups.items():
                m = len(n) + 1
                columns = [pa.array([lang] * m), pa.array([source] * m), pa.array([None, *n], pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(held[t] for t in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        size = 0
        for batch in slices(batches, 0):
            for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (lang, source) not in groups:
                    groups[lang, source] = (Counter(), Counter())
                    size += 1
                n, held = groups[lang, source]
                before, seen = len(n), set()
                for words in _words(text):
                    n.update(words)
                    seen.update(words)
                held.update(seen)
                size += len(n) - before
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    each = rows.mapInArrow(run, COUNTED)
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + 5) / (total + 5 terms)), exact; null without terms."""
    scaled = (count.cast("decimal(20,0)") + SMOOTHING) * F.lit(UNIT).cast("decimal(10,0)")
    below = total.cast("decimal(20,0)") + SMOOTHING * terms.cast("decimal(12,0)")
    # what is left of the division is taken off first, so that the quotient is whole
    return F.when(terms > 0, 1 + ((scaled - scaled % below) / below).cast("long"))


def shares(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """share() of int64 arrays: UNIT is 1000 x 1000 x 1000, so long division by digits of 1000 stays within 64 bits (as long
    as a group has under 9 x 10^15 terms)."""
    whole, rest = np.divmod(counts + SMOOTHING, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return 1 + whole


class Forest:
    """Hash-consed segment trees of several groups over one block. Node 0 of each level has no count below it."""

    def __init__(self, rows: np.ndarray) -> None:
        """rows: a row of counts for each group; a power of two of them."""
        self.counts, ids = np.unique(np.append(rows.ravel(), 0), return_inverse=True)  # no count is below 0, so 0 is first
        ids = ids[:-1].reshape(rows.shape)
        self.children: list[np.ndarray] = []  # of each level, the leaves' parents first: (left, right) of each node
        while ids.shape[1] > 1:
            size = int(ids.max(initial=0)) + 1
            pairs, inverse = np.unique(np.append((ids[:, ::2] * size + ids[:, 1::2]).ravel(), 0), return_inverse=True)
            self.children.append(np.stack([pairs // size, pairs % size], axis=1))
            ids = inverse[:-1].reshape(len(rows), -1)
        self.roots = ids[:, 0]

    def price(self, a: np.ndarray, b: np.ndarray, below: np.ndarray) -> np.ndarray:
        """For pairs of groups a[i], b[i]: the sum over the block of |share in a - share in b|, less what that sum would be
        if neither had a count. below: the groups' denominators."""
        pair, left, right, times = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), np.int64)
        for children in [*self.children[::-1], None]:
            counted = (left > 0) | (right > 0)  # two empty subtrees have no price
            pair, left, right, times = pair[counted], left[counted], right[counted], times[counted]
            if children is None:
                break
            pair, times = np.repeat(pair, 2), np.repeat(times, 2)
            left, right = children[left].ravel(), children[right].ravel()
            # a pair of nodes that pair i has met before on this level is priced with it
            wide = max(int(left.max(initial=0)), int(right.max(initial=0))) + 1
            met, inverse = np.unique((pair * wide + left) * wide + right, return_inverse=True)
            sums = np.zeros(len(met), np.int64)
            np.add.at(sums, inverse, times)
            pair, left, right, times = met // (wide * wide), met // wide % wide, met % wide, sums
        one, other = below[a[pair]], below[b[pair]]
        zero = np.zeros(len(pair), np.int64)
        apart = np.abs(shares(self.counts[left], one) - shares(self.counts[right], other)) - np.abs(shares(zero, one) - shares(zero, other))
        out = np.zeros(len(a), np.int64)
        np.add.at(out, pair, apart * times)
        return out


def _priced(table: pa.Table) -> pa.Table:
    """A block's part of the distances of a tile pair: (lang, a, b, part) for groups a < b, one from each tile."""
    no, slot, n, below = (table.column(c).to_numpy() for c in ("no", "slot", "n", "below"))
    first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
    groups, at = np.unique(no, return_inverse=True)
    rows, denominators = np.zeros((len(groups), BLOCK), np.int64), np.zeros(len(groups), np.int64)
    np.add.at(rows, (at, slot), n)  # a group's mark and a count of its may have the same slot
    denominators[at] = below
    forest = Forest(rows)
    one, two = np.flatnonzero(groups // TILE == first), np.flatnonzero(groups // TILE == second)
    a, b = np.repeat(one, len(two)), np.tile(two, len(one))
    a, b = a[groups[a] < groups[b]], b[groups[a] < groups[b]]
    step = max(1, FRONTIER // BLOCK)
    parts = [forest.price(a[i : i + step], b[i : i + step], denominators) for i in range(0, len(a), step)]
    sums = np.concatenate([np.zeros(0, np.int64), *parts])
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(a), pa.string()), "a": groups[a], "b": groups[b], "part": sums})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, listed: int = LISTED) -> DataFrame:
    """(lang, source, part, item, value, rank): for every group the other sources of its language by their distance from
    it (part `pair`), and up to `listed` terms that it has more of than its language (part `term`).

    docs: text, lang, source, nulls counting as ''; more columns, whatever their names, are ignored. A language keeps terms
    that at least least_docs of its documents have. Without any, pairs are 0 apart and there are no terms. Equal values are
    ranked by item. A group without terms is a group; no documents give no rows.

    A language of any size is many tasks: a task has a block of term ids and two tiles of sources.
    """
    counted = cut(counts(docs), "term-counts")
    groups = counted.where("term is null").select("lang", "source")
    terms = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count("*").alias("groups"))
    # frequent terms come first, so that what small sources lack is together; ranks are told by bands of frequency and hash
    chunk = F.lit(64) - F.floor(F.log2(F.col("total"))).cast("long")
    ranked = terms.where(F.col("docs") >= least_docs).select("lang", "term", "total", (chunk * 4096 + F.pmod(F.xxhash64("term"), F.lit(4096))).alias("chunk"), F.lit(1).cast("long").alias("one"))
    terms = cut(running_total(ranked, ["lang"], "chunk", [F.col("term")], "one", "id").select("lang", "term", "total", "id"), "kept-terms")
    langs = terms.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("v"))

    kept = counted.where("term is not null").select("lang", "source", "term", "n").join(terms, ["lang", "term"])
    kept = cut(kept, "kept-counts")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"), F.count("*").alias("rows"))
    zero = F.lit(0).cast("long")
    known = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("group_total", zero).alias("group_total"), F.coalesce("lang_total", zero).alias("lang_total"), F.coalesce("v", zero).alias("v"), F.coalesce("rows", zero).alias("rows"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("no"),
    )
    known = cut(known.withColumn("tiles", F.floor(F.max("no").over(Window.partitionBy("lang")) / TILE) + 1), "term-groups")

    total = known.agg(F.sum("rows")).first()[0] or 0
    placed = join_counted(kept, known, ["lang", "source"], "rows", total)
    distances = _distances(placed, known)
    one = distances.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), "value")
    both = one.unionByName(distances.select("lang", F.col("b_source").alias("source"), F.col("a_source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    p, q = share(F.col("n"), F.col("group_total"), F.col("v")), share(F.col("total"), F.col("lang_total"), F.col("v"))
    over = placed.where("n > 0").select("lang", "source", F.col("term").cast("string").alias("item"), (p - q).alias("value")).where("value > 0")
    top = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= listed)
    return pairs.unionByName(top.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _distances(placed: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, a_source, b_source, value) of the groups of a language, each pair once."""
    below = (F.col("group_total") + SMOOTHING * F.col("v")).alias("below")
    cells = placed.select("lang", "no", "tiles", F.shiftright("id", BLOCK.bit_length() - 1).alias("block"), F.col("id").bitwiseAND(F.lit(BLOCK - 1)).alias("slot"), "n", below)
    # a mark for each group and block, as a group without a count in a block still has a distance there
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / BLOCK))).alias("block")
    marks = known.where("v > 0").select("lang", "no", "tiles", blocks, F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("n"), below)
    own = F.floor(F.col("no") / TILE)
    dealt = cells.unionByName(marks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("lang", "block", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), F.col("no").cast("long").alias("no"), "slot", "n", "below")
    parts = dealt.groupBy("lang", "block", "first", "second").applyInArrow(_priced, "lang string, a long, b long, part long")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    zero = share(F.lit(0), F.col("group_total"), F.col("v"))
    tile = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile")
    a = known.select("lang", F.col("no").cast("long").alias("a"), F.col("source").alias("a_source"), "v", zero.alias("a_zero"), tile)
    b = known.select("lang", F.col("no").cast("long").alias("b"), F.col("source").alias("b_source"), zero.alias("b_zero"), own.alias("tile"))
    # every pair is a result, and has the distance of two groups without any count to begin with
    every = a.join(b, ["lang", "tile"]).where("a < b").join(summed, ["lang", "a", "b"], "left")
    return every.select("lang", "a_source", "b_source", F.coalesce(F.col("v") * F.abs(F.col("a_zero") - F.col("b_zero")) + F.coalesce("part", F.lit(0)), F.lit(0)).cast("long").alias("value"))


def query(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank."""
    return audit(docs)


_SHARE = "(1 + (1000000000::HUGEINT * ({0} + 5)) // ({1} + 5 * v))"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
dt AS MATERIALIZED (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
kt AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM dt GROUP BY lang, term HAVING count(*) >= {LEAST_DOCS}),
lt AS (SELECT lang, CAST(sum(total) AS BIGINT) AS lang_total, count(*) AS v FROM kt GROUP BY lang),
gt AS (SELECT g.lang, g.source, kt.term, kt.total, coalesce(CAST(x.n AS BIGINT), 0) AS n FROM g JOIN kt USING (lang)
       LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM dt GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = kt.term),
gn AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS group_total FROM gt GROUP BY ALL),
p AS MATERIALIZED (SELECT gt.lang, gt.source, term, n, {_SHARE.format('n', 'group_total')} AS p, {_SHARE.format('total', 'lang_total')} AS q FROM gt JOIN gn USING (lang, source) JOIN lt USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C") AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
WHERE part = 'pair' OR rank <= {LISTED}"""
