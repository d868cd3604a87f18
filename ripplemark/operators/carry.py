"""What lines carry along, in two levels: sums and last values of chunks first, then the lines of a chunk.

A window over all lines of a key puts the key into one task. Here a key's lines are dealt to chunks of neighbouring lines;
the few rows that chunks leave are ordered by key, and their results joined back. A key of any size is many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a chunk.
CHUNK = 4096


def _chunked(lines: DataFrame, order: str, size: int) -> DataFrame:
    return lines.withColumn("__chunk", F.floor(F.col(order) / size).cast("long"))


def _within(keys: list[str], order: str):
    return Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)


def _joined(lines: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """lines with the columns that bases has for its key and chunk; null keys match each other."""
    names = [*keys, "__chunk"]
    renamed = bases.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(names)], *[c for c in bases.columns if c not in names])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(names)])
    return lines.join(renamed, same).drop(*[f"__k{i}" for i in range(len(names))])


def last_value(lines: DataFrame, value: Column, keys: list[str], order: str, out: str, size: int = CHUNK) -> DataFrame:
    """Adds out: the last value that isn't null at or before a line of its key, in the order of a number; null where there is
    none. Of lines with the same number it is undefined which comes first."""
    own = _chunked(lines, order, size).withColumn("__own", F.last(value, ignorenulls=True).over(_within(keys, order)))
    bases = own.groupBy(*keys, "__chunk").agg(F.max_by("__own", F.when(F.col("__own").isNotNull(), F.col(order))).alias("__last"))
    bases = bases.withColumn("__base", F.last("__last", ignorenulls=True).over(_before(keys))).drop("__last")
    return _joined(own, bases, keys).withColumn(out, F.coalesce("__own", "__base")).drop("__own", "__base", "__chunk")


def sections(lines: DataFrame, opens: Column, counts: Column, keys: list[str], order: str, section: str, nth: str, size: int = CHUNK) -> DataFrame:
    """Adds section: how many lines of its key up to a line open one; and nth: how many lines of the section up to it count.
    Lines before the first that opens a section are section 0. opens and counts are boolean, null is false; a line that opens
    a section isn't counted."""
    opened, counted = F.coalesce(opens, F.lit(False)), F.coalesce(counts, F.lit(False))
    marked = _chunked(lines, order, size).withColumn("__opens", opened).withColumn("__counts", counted & ~opened)
    w = _within(keys, order)
    own = marked.withColumn("__sections", F.sum(F.col("__opens").cast("long")).over(w)).withColumn("__n", F.sum(F.col("__counts").cast("long")).over(w))
    # what had been counted in the chunk when its last section began
    own = own.withColumn("__mark", F.last(F.when(F.col("__opens"), F.col("__n")), ignorenulls=True).over(w))
    sums = own.groupBy(*keys, "__chunk").agg(F.max("__sections").alias("__s"), F.max("__n").alias("__c"), F.max("__mark").alias("__m"))
    before = _before(keys)
    total = F.coalesce(F.sum("__c").over(before), F.lit(0))
    bases = sums.withColumn("__s0", F.coalesce(F.sum("__s").over(before), F.lit(0))).withColumn("__c0", total)
    bases = bases.withColumn("__m0", F.coalesce(F.last(F.col("__c0") + F.col("__m"), ignorenulls=True).over(before), F.lit(0))).drop("__s", "__c", "__m")
    number = F.when(F.col("__mark").isNotNull(), F.col("__n") - F.col("__mark")).otherwise(F.col("__c0") + F.col("__n") - F.col("__m0"))
    made = _joined(own, bases, keys).withColumn(section, F.col("__s0") + F.col("__sections")).withColumn(nth, number)
    return made.drop("__opens", "__counts", "__sections", "__n", "__mark", "__s0", "__c0", "__m0", "__chunk")
