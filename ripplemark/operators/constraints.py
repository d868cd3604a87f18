"""Constraints as data: what a table's rows must find in other tables, all judged in one pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a value needs: a row of the other table that has it, exactly one such row, or (null being no value) to be known there.
KINDS = ("exists", "one", "known")
#: Rows of counts up to which they are broadcast, some 100 bytes each.
BROADCAST_COUNTS = 100_000


@dataclass(frozen=True)
class Constraint:
    """problem: its name. column: of the judged rows, a value or an array of values. table, key: where it is looked up."""

    problem: str
    kind: str
    column: str
    table: str
    key: str

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"{self.problem}: {self.kind} is none of {', '.join(KINDS)}")


def broken(rows: DataFrame, key: str, constraints: list[Constraint], tables: dict[str, DataFrame]) -> DataFrame:
    """(key, problem, value, n): each constraint that a row breaks, with the value (as text) and how many rows have it.

    A value of null breaks `exists` and `one`, and is passed over by `known`; an empty array breaks nothing. Values are
    compared as text. Rows go through once, whatever the number of constraints, as do the tables that they name, which
    are counted by value before anything is joined. Equal rows break the same constraints once.
    """
    if twice := {c.problem for c in constraints if sum(x.problem == c.problem for x in constraints) > 1}:
        raise ValueError(f"named twice: {', '.join(sorted(twice))}")
    if missing := {c.table for c in constraints} - set(tables):
        raise ValueError(f"no table {', '.join(sorted(missing))}")

    def asked(c: Constraint) -> Column:
        listed = rows.schema[c.column].dataType.typeName() == "array"
        values = F.col(c.column).cast("array<string>") if listed else F.array(F.col(c.column).cast("string"))
        made = F.transform(values, lambda v: F.struct(F.lit(c.problem).alias("problem"), F.lit(c.kind).alias("kind"), F.lit(f"{c.table}.{c.key}").alias("where"), v.alias("value")))
        return F.coalesce(made, F.array().cast("array<struct<problem:string,kind:string,where:string,value:string>>"))

    each = rows.select(key, F.explode(F.concat(*[asked(c) for c in constraints])).alias("a")).select(key, "a.*").distinct()
    places = sorted({(c.table, c.key) for c in constraints})
    held = [tables[table].select(F.lit(f"{table}.{column}").alias("where"), F.col(column).cast("string").alias("value")) for table, column in places]
    counts = reduce(DataFrame.unionByName, held).where("value is not null").groupBy("where", "value").agg(F.count("*").alias("n"))
    found = each.join(F.broadcast(counts) if counts.count() <= BROADCAST_COUNTS else counts, ["where", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    breaks = F.when(F.col("kind") == "one", F.col("n") != 1).when(F.col("kind") == "known", F.col("value").isNotNull() & (F.col("n") == 0)).otherwise(F.col("n") == 0)
    return found.where(breaks).select(key, "problem", "value", "n")
