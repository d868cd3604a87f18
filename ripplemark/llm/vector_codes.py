"""Vector codes: each of four parts of a vector becomes the index of its nearest codebook entry, found through a GNAT.

Components are integers, so distances, means and ties are exact. The codebooks are trained by rounds of assignment and
integer means over all vectors; what goes through the driver is a codebook, whose size doesn't depend on the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import cut, join_counted

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a tree's node, and entries up to which a subset isn't split.
ARITY, LEAF = 16, 16
#: Vectors that a task searches for at a time.
SLICE = 8192
#: More than what conversion, root, sum and product of doubles can be off by, relatively.
ROUNDING = 2.0**-48
SUMS = "part int, entry int, sums array<long>"


@dataclass
class _Node:
    """Entries at a node, ascending; for a split node also a child (or None) for each of them, and the least and greatest
    distance from split point j to the entries below child i, rounded outwards."""

    ids: np.ndarray
    children: list[_Node | None]
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class Gnat:
    """A geometric near-neighbour access tree over integer points: nearest point by squared distance, ties to the lower index.

    A node's split points are points themselves; every other point lies below the nearest of them. A subtree is passed
    over only if, for some split point, the triangle inequality puts all its points strictly farther off than the best
    point found, with bounds rounded so that doubles can't decide a tie. What is left is compared in integers.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.points = points.astype(np.int64)
        largest = int(np.abs(self.points).max(initial=0))
        self.largest, self.norms = largest, (self.points * self.points).sum(axis=1)
        self.root = self._node(np.arange(len(points)))

    def _node(self, ids: np.ndarray) -> _Node:
        if len(ids) <= LEAF:
            return _Node(ids, [])
        # each split point is that farthest from those before it
        splits, nearest = [0], self._between(ids, ids[:1])[:, 0]
        while len(splits) < ARITY and nearest.max() > 0:
            splits.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, self._between(ids, ids[splits[-1:]])[:, 0])
        if len(splits) == 1:  # all points are equal: the first is the answer for all
            return _Node(ids[:1], [])
        splits = np.sort(splits)
        rest = np.delete(np.arange(len(ids)), splits)
        apart = self._between(ids[rest], ids[splits])
        home = apart.argmin(axis=1)
        m = len(splits)
        low, high, children = np.zeros((m, m)), np.zeros((m, m)), []
        for i in range(m):
            below = home == i
            children.append(self._node(ids[rest[below]]) if below.any() else None)
            if below.any():
                low[:, i] = np.sqrt(apart[below].min(axis=0)) * (1 - ROUNDING)
                high[:, i] = np.sqrt(apart[below].max(axis=0)) * (1 + ROUNDING)
        return _Node(ids[splits], children, low, high)

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._squared(self.points[a], b, self.largest)

    def _squared(self, queries: np.ndarray, ids: np.ndarray, largest: int) -> np.ndarray:
        """Exact squared distances; products of doubles are used where they are integers that doubles hold."""
        points = self.points[ids]
        if 4 * max(1, points.shape[1]) * max(largest, self.largest) ** 2 < 1 << 53:
            q = queries.astype(np.float64)
            return ((q * q).sum(axis=1)[:, None] - 2 * (q @ points.T.astype(np.float64)) + self.norms[ids]).astype(np.int64)
        out = np.zeros((len(queries), len(ids)), np.int64)
        for k in range(points.shape[1]):
            away = queries[:, k, None] - points[None, :, k]
            out += away * away
        return out

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest point of each query (int64 rows)."""
        best = np.full(len(queries), -1, np.int64)
        least = np.full(len(queries), np.iinfo(np.int64).max)
        if len(queries):
            self._visit(self.root, np.arange(len(queries)), queries, int(np.abs(queries).max(initial=0)), best, least)
        return best, least

    def _visit(self, node: _Node, rows: np.ndarray, queries: np.ndarray, largest: int, best: np.ndarray, least: np.ndarray) -> None:
        away = self._squared(queries[rows], node.ids, largest)
        first = away.argmin(axis=1)  # ids ascend, so the first of a tie is the lower index
        found, ids = away[np.arange(len(rows)), first], node.ids[first]
        better = (found < least[rows]) | ((found == least[rows]) & (ids < best[rows]))
        least[rows[better]], best[rows[better]] = found[better], ids[better]
        if not node.children:
            return
        root = np.sqrt(away.astype(np.float64))
        near, far = root * (1 - ROUNDING), root * (1 + ROUNDING)

        def reached(i: int, some: np.ndarray) -> np.ndarray:
            """Of some rows, those for which child i may hold a point as near as the best."""
            radius = np.sqrt(least[rows[some]].astype(np.float64)) * (1 + ROUNDING)
            off = (near[some] > (node.high[:, i] + radius[:, None]) * (1 + ROUNDING)) | (node.low[:, i] > (far[some] + radius[:, None]) * (1 + ROUNDING))
            return some[~off.any(axis=1)]

        everything = np.arange(len(rows))
        for nearest_first in (True, False):
            for i, child in enumerate(node.children):
                if child is not None and len(some := reached(i, everything[(first == i) == nearest_first])):
                    self._visit(child, rows[some], queries, largest, best, least)


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and all its components are there and finite."""
    # NaN compares as larger than infinity
    return F.coalesce(F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 x) of a batch's vectors (usable ones), filled up with zeros to width. Values are held to what squared
    distances of that width may be in 64 bits (some 2^27 for 64 components)."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = isqrt((1 << 63) // (16 * max(1, width)))
    scaled = np.clip(np.floor(SCALE * flat), -most, most).astype(np.int64)
    if (sizes == width).all():
        return scaled.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    begins = np.cumsum(sizes) - sizes
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - begins[rows]] = scaled
    return out


@dataclass(frozen=True)
class Codec:
    """codebooks: a matrix for each part, its entries as rows; width: components of a vector, parts together."""

    codebooks: list[np.ndarray]
    width: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.codebooks for x in book.ravel().tolist()).encode()).hexdigest()

    def assign(self, trees: list[Gnat], column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The integer vectors of a batch; and their parts' entries and squared distances (rows are parts)."""
        whole, part = integers(column, self.width), self.width // len(self.codebooks)
        found = [tree.nearest(whole[:, i * part : (i + 1) * part]) for i, tree in enumerate(trees)]
        return whole, np.array([f[0] for f in found]), np.array([f[1] for f in found])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def train(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codec:
    """Codebooks of usable vectors, from the parts of those of the smallest keys (nulls last, ties by vector; all vectors
    if there are fewer than entries) by rounds of assignment and componentwise floored means; an unused entry stays.

    All vectors are read in every round; a task hands on sums of its own vectors by entry, which Spark adds up. Vectors of
    different lengths count as filled up with zeros to the longest, rounded up to a multiple of parts. Without vectors
    there are no entries.
    """
    kept = vectors.where(usable(vector)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = kept.orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()
    seeds = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), width)
    part = width // parts
    codec = Codec([seeds[:, i * part : (i + 1) * part] for i in range(parts)], width)
    for _ in range(rounds if first else 0):
        codec = _moved(kept, codec)
    return codec


def _moved(kept: DataFrame, codec: Codec) -> Codec:
    """Each entry replaced by the floored mean of the parts that it is nearest to."""
    size, part = len(codec.codebooks[0]), codec.width // len(codec.codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in codec.codebooks]
        sums = np.zeros((len(trees), size, 1 + part), np.int64)  # a count and the sums of components
        for batch in _slices(batches):
            whole, codes, _ = codec.assign(trees, batch.column(0))
            for i in range(len(trees)):
                # rows in the order of their entries, so that each entry's rows are a run
                order = np.argsort(codes[i], kind="stable")
                used, begins, counts = np.unique(codes[i][order], return_index=True, return_counts=True)
                sums[i, used, 0] += counts
                if part:
                    sums[i, used, 1:] += np.add.reduceat(whole[order, i * part : (i + 1) * part], begins, axis=0)
        at, entry = np.nonzero(sums[:, :, 0])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(entry, pa.int32()), pa.array(list(sums[at, entry]), pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    each = kept.select("vector").mapInArrow(run, SUMS).select("part", "entry", F.posexplode("sums").alias("place", "x"))
    made = [book.copy() for book in codec.codebooks]
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in each.groupBy("part", "entry", "place").agg(F.sum("x").alias("x")).collect():  # a codebook's numbers
        found.setdefault((r.part, r.entry), {})[r.place] = r.x
    for (i, entry), x in found.items():
        made[i][entry] = [x[place] // x[0] for place in range(1, 1 + part)]
    return Codec(made, codec.width)


def encode(vectors: DataFrame, codec: Codec, vector: str = "embedding") -> DataFrame:
    """Usable vectors' rows as `row` (all columns given, whatever their names), with codes (array of an entry's index for
    each part) and error (squared distances summed). Vectors longer than the codec's are an error; shorter ones count
    as filled up with zeros. Without entries there are no rows."""
    kept = vectors.where(usable(vector)).select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"), F.col(vector).cast("array<double>").alias("vector"))
    if not len(codec.codebooks[0]):
        kept = kept.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in codec.codebooks]
        for batch in _slices(batches):
            _, codes, errors = codec.assign(trees, batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(codes.T), pa.list_(pa.int64())), pa.array(errors.sum(axis=0), pa.int64())], names=["row", "codes", "error"])

    made = [StructField("codes", ArrayType(LongType())), StructField("error", LongType())]
    return kept.select("vector", "row").mapInArrow(run, StructType([*kept.select("row").schema.fields, *made]))


def query(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256. Without a usable vector there are no rows; label_error is null if
    it passes a long."""
    codec = train(embeddings)
    coded = encode(embeddings.select("vec_id", "embedding", "label"), codec)
    hexes = F.array_join(F.transform("codes", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    # a label as text that no null has
    label = F.coalesce(F.concat(F.lit("="), F.col("row.label").cast("string")), F.lit("")).alias("label")
    rows = cut(coded.select(F.col("row.vec_id").alias("vec_id"), label, hexes.alias("code"), "error"), "vector-codes")
    sums = cut(rows.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    total = sums.agg(F.sum("n")).first()[0] or 0
    found = join_counted(rows, sums, ["label"], "n", total)
    return found.select("vec_id", "code", "error", "label_error", F.lit(codec.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    """Rounds as steps of one statement; a least distance and its lower index are one number, distance x 256 + index."""
    steps = [
        """kept AS (SELECT row_number() OVER () AS id, vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS MATERIALIZED (SELECT id, pos // d AS part, pos % d AS pos, CAST(floor(1024 * CAST(e[pos + 1] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT id, e, len(e) // 4 AS d, unnest(range(len(e))) AS pos FROM kept)),
seeds AS (SELECT id, row_number() OVER (ORDER BY vec_id, e) - 1 AS entry FROM kept ORDER BY vec_id, e LIMIT 256),
b0 AS MATERIALIZED (SELECT part, entry, pos, x FROM comps JOIN seeds USING (id))"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""d{i} AS (SELECT c.id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS away FROM comps c JOIN b{i} b ON c.part = b.part AND c.pos = b.pos GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT id, part, CAST(min(away * 256 + entry) % 256 AS BIGINT) AS entry, CAST(min(away * 256 + entry) // 256 AS BIGINT) AS away FROM d{i} GROUP BY ALL)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT part, entry, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM comps JOIN a{i} USING (id, part) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CAST(coalesce(m.x, b.x) AS BIGINT) AS x FROM b{i} b LEFT JOIN m{i} m USING (part, entry, pos))""")
    last = ROUNDS
    return "WITH " + ",\n".join(steps) + f""",
v AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM a{last} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{last}) AS codebooks_sha256
FROM v JOIN kept USING (id)"""


ORACLE = _oracle()
