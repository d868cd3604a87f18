"""What several corpus operators share: running totals, components, slices of batches; and the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import cut, discard, scratch, shared_dir

#: A key that more than one row in HOT has is joined by broadcast.
HOT = 1000

__all__ = ["HOT", "by_bytes", "components", "cut", "discard", "join_counted", "parts_for", "remember", "running_total", "scratch", "shared_dir", "slices"]


def running_total(df: DataFrame, group: list[str], chunk: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Exclusive running sum of value in each group, ordered by (chunk, *order).

    Two levels, so that no task holds a whole group: sums of the chunks come first (one row a chunk), their
    running total is joined back, and only a chunk's own rows are sorted together. chunk must ascend with order.
    """
    keys = [*group, chunk]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return (
        df.withColumn("__own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(bases, same)
        .withColumn(out, F.col("__base") + F.col("__own"))
        .drop("__own", "__base", *[f"__k{i}" for i in range(len(keys))])
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node reachable.

    Alternates two star contractions: each node hands its larger neighbours to its smallest one, then its smaller
    neighbours and itself. Edges never grow in number and each round is written to the shared folder. Minima are
    aggregated before they are joined back, so a hub is no group in one task. Nodes without an edge don't appear.
    """
    now = cut(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct(), "edges"
    )
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(hi, lo))").alias("x")).first()
        if (seen.n, seen.x) == mark or not seen.n:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        mark = (seen.n, seen.x)
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = (
            both.where("lo > hi").join(least, F.col("hi") == F.col("v")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        large = cut(large, "edges")
        least = large.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("m"))
        small = large.join(least, F.col("hi") == F.col("v")).select(
            F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")
        )
        after = cut(small.select("e.hi", "e.lo").where("hi > lo").distinct(), "edges")
        discard(now)
        discard(large)
        now = after


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows.join(table, keys), where table has one row for each value of keys and count, how many of the rows have it.

    Values that more than a HOT-th of all total rows have are joined by broadcast (there are HOT at most, as the counts
    add up to total), so that none of them is one task; the others by shuffle. Null keys match nothing.
    """
    hot = table.where(F.col(count) * HOT > total)
    if not total or hot.isEmpty():
        return rows.join(table, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(count) * HOT <= total), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def parts_for(texts: DataFrame, text: str = "text", size: int = 128 << 20) -> int:
    """Partitions for an exchange of whole texts: the session's number, or more if they would pass size bytes."""
    held = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), held // size + 1)


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of a text column each, one row at least: what a task holds at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        below = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, below + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


#: What a Python worker remembers from task to task, by the kind of task, as functions that let it go.
_remembered: dict[str, Callable[[], None]] = {}


def remember(kind: str, forget: Callable[[], None]) -> None:
    """Keep something in this worker for the next tasks of a kind; slices() of any other kind calls forget."""
    _remembered[kind] = forget


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20, kind: str = "") -> Iterator[pa.RecordBatch]:
    """by_bytes() of every batch of a task; at its end the worker, which lives on, gives Arrow's memory back."""
    for other in [k for k in _remembered if k != kind]:
        _remembered.pop(other)()
    try:
        for batch in batches:
            yield from by_bytes(batch, column, limit)
    finally:
        pa.default_memory_pool().release_unused()
