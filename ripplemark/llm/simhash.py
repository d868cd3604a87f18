"""Near-duplicate documents by SimHash: fingerprints, pigeonhole blocks, Hamming check, components.

Fingerprints are made in Arrow batches (one pass over the texts); everything after that is on 8-byte numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_counted, slices

#: Expected chance partners of a fingerprint over all block tables, above which finer blocks are used.
CHANCE_PARTNERS = 8.0
#: Members of a block up to which pairs are joined; larger blocks go through spanning forests of chunk pairs.
SMALL_BLOCK = 64
#: Rows of a chunk of a large block; a task sees two chunks.
CHUNK = 2000


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text, unsigned. No words: 0."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, t, fp) of every row; t is a hash of the text, fp the fingerprint as a signed long. A null text is an
    empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = batch.column(1).cast(pa.binary())
            made = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), dtype="<u8", count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made.view("<i8"))], names=["doc_id", "t", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(run, "doc_id long, t long, fp long")


def blocks_for(count: int, distance: int, bits: int = 64) -> int:
    """Blocks to cut fingerprints into: with k of them, close pairs agree on k - distance at least."""
    for k in range(distance + 1, 4 * distance + 2):
        shared = k - distance
        if count * comb(k, shared) / 2 ** (bits * shared / k) <= CHANCE_PARTNERS:
            break
    return k


def block_masks(k: int, distance: int, bits: int = 64) -> list[int]:
    """Signed masks of every choice of k - distance blocks out of k."""
    edge = [bits * i // k for i in range(k + 1)]
    block = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(k)]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(k), k - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among fps."""
    left, found = np.unique(fps), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            found += [(int(at), int(x)) for x in left[near]]
            queue += list(left[near])
            left = left[~near]
    return found


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect whatever lies within distance.

    Pairs of small blocks are joined and checked. A larger block links its members to its smallest one; if that leaves
    it in several components, it is cut into chunks, and each pair of chunks is a group that returns a spanning forest
    of its links. So no block becomes one task, a block of near copies costs a row for each, and no pairs are written
    out. Every link's ends are connected, none is lost.
    """
    count = fps.count()
    masks = block_masks(blocks_for(count, distance), distance)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lead")).where("n > 1")
    shared = cut(keyed.join(sizes, ["t", "key"]), "blocks")
    x = shared.where(f"n <= {SMALL_BLOCK}").select("t", "key", F.col("fp").alias("a"))
    y = shared.where(f"n <= {SMALL_BLOCK}").select("t", "key", F.col("fp").alias("b"))
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    small = x.join(y, (x.t == y.t) & (x.key == y.key) & (F.col("a") < F.col("b")) & close("a", "b")).select("a", "b")
    rest = shared.where(f"n > {SMALL_BLOCK}")
    if rest.isEmpty():
        return small.distinct()

    stars = cut(rest.where((F.col("lead") < F.col("fp")) & close("lead", "fp")).select(F.col("lead").alias("a"), F.col("fp").alias("b")).distinct(), "stars")
    roots = components(stars).withColumnRenamed("node", "fp")
    rooted = cut(rest.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    apart = rooted.groupBy("t", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("t", "key")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = rooted.join(apart, ["t", "key"], "left_semi").select("t", "key", "fp", chunks.alias("c"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("i"))
    large = own.select("t", "key", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("j")).select(
        "t", "key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "fp"
    )

    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(pdf["fp"].to_numpy(np.int64), distance), columns=["a", "b"], dtype="int64")

    found = large.groupBy("t", "key", "p", "q").applyInPandas(span, "a long, b long")
    return small.unionByName(stars).unionByName(found).distinct()


def classed(docs: DataFrame, shingle: int, distance: int) -> tuple[DataFrame, DataFrame, int]:
    """own: (doc_id, t, fp) for every row of docs; classes: fp, n (its rows), first (the component's first doc_id, null
    only if it has none, and of its texts the one with the smallest hash) and rows, the number of rows."""
    own = cut(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("first")
    reps = cut(own.groupBy("fp").agg(first, F.count("*").alias("n")), "reps")
    roots = components(links(reps.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a component has fewer fingerprints than a copied text has rows; those without a partner are their own first
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    classes = cut(rooted.join(least, "root").select("fp", "n", F.col("least").alias("first")), "classes")
    return own, classes, reps.agg(F.sum("n")).first()[0] or 0


def key() -> Column:
    """doc_id as a key that null ids have as well."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Documents whose fingerprints differ in at most distance bits are linked; component_id is the smallest doc_id
    reachable. Null and empty texts have fingerprint 0 and link like any other. Rows repeat as given; a null doc_id
    keeps its row and gets its component's smallest id (null if it has none). Other columns are ignored. Empty in,
    empty out.
    """
    own, classes, rows = classed(docs, shingle, distance)
    return join_counted(own, classes, ["fp"], "n", rows).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """docs without near copies: of each component one row stays, with the smallest doc_id.

    A row is told by doc_id and text. Of an id's texts in one component the one with the smallest hash stays, of equal
    rows any; an id's texts in other components stay. Rows without an id come after those with one, so they stay only
    where a component has no id. Texts without a word are near copies of each other. The texts are shuffled once, by
    doc_id and hash, or not at all if few rows go.
    """
    own, classes, rows = classed(docs, shingle, distance)
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    told = join_counted(own, classes, ["fp"], "n", rows).select(key().alias("__key"), F.col("t").alias("__t"), kept.alias("kept"))
    marked = cut(told.groupBy("__key", "__t").agg(F.first("kept").alias("kept"), F.count("*").alias("copies")).where("not kept or copies > 1"), "near-copies")
    # the row goes as one column, so that its columns may have any names
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key().alias("__key"), F.xxhash64(F.col("text").cast("string")).alias("__t"))
    columns = [F.col("row")[c].alias(c) for c in docs.columns]
    left = keyed.join(marked.select("__key", "__t"), ["__key", "__t"], "left_anti").select(*columns)
    twice = marked.where("kept").select("__key", "__t")
    if twice.isEmpty():
        return left
    once = keyed.join(twice, ["__key", "__t"]).groupBy("__key", "__t").agg(F.first("row").alias("row"))
    return left.unionByName(once.select(*columns))
