"""Reports and summaries of change sets: ranked first and gathered then, so that a row holds a bounded number of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import flat
from .changes import net_delta

#: Findings and rules that a report shows, and characters of a line of it.
SHOWN, RULES, WIDTH = 40, 6, 60


def report(findings: DataFrame, line: Column, order: list[Column], by: str = "pr", shown: int = SHOWN, rules: int = RULES, width: int = WIDTH) -> DataFrame:
    """(by, n, hidden, report, preview): of each change set the number of its findings, how many of them the report leaves
    out, the first `shown` in the given order as lines (white space flattened, cut to width), and the first rules by
    name with how many more there are. findings: by, rule_id and what line and order need. A null change set is one.

    Findings are ranked, and cut to what is shown, before they are gathered, in every task and again after the exchange.
    """
    ranked = findings.withColumn("__line", flat(line, width)).withColumn("__nth", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    top = ranked.where(F.col("__nth") <= shown).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__nth", "__line"))), lambda x: x["__line"]), "\n").alias("report"))
    counted = findings.groupBy(by, "rule_id").agg(F.count("*").alias("__n"))
    named = counted.withColumn("__nth", F.row_number().over(Window.partitionBy(by).orderBy("rule_id")))
    sums = named.groupBy(by).agg(
        F.sum("__n").alias("n"), F.count("*").alias("__rules"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__nth") <= rules, F.struct("__nth", "rule_id")))), lambda x: x["rule_id"]), ", ").alias("__named"),
    )
    more = F.when(F.col("__rules") > rules, F.concat(F.lit(" +"), (F.col("__rules") - rules).cast("string"), F.lit(" more"))).otherwise("")
    joined = sums.withColumnRenamed(by, "__by").join(top, F.col("__by").eqNullSafe(F.col(by)))
    return joined.select(by, "n", F.greatest(F.col("n") - shown, F.lit(0)).alias("hidden"), "report", F.concat("__named", more).alias("preview"))


def column_changes(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """(key, added, removed): sorted names that one side has and the other lacks."""
    return net_delta(before, after, key, column)


def summaries(changes: DataFrame, columns: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, summary): the text that rules are looked up by: what happened, to which columns, and the changed lines, added
    ones first; empty if nothing semantic changed. What a node is on every change (its path, its access) isn't in it.

    changes: (key, change_type, kind, is_semantic), a row for each key; columns: as column_changes(), may lack keys; lines:
    (key, op, line_no, text), of which + and - count. A key's lines are one row: they are those of one file's change.
    """
    none = F.array().cast("array<string>")
    text = F.collect_list(F.struct((F.col("op") != "+").alias("second"), "line_no", "text"))
    gathered = lines.where(F.col("op").isin("+", "-")).groupBy(key).agg(F.transform(F.array_sort(text), lambda x: x["text"]).alias("texts"))
    names = [F.coalesce(F.transform(c, lambda x: x.cast("string")), none).alias(c) for c in ("added", "removed")]
    known = changes.join(columns, key, "left").join(gathered, key, "left").select(key, "change_type", "kind", "is_semantic", *names, F.coalesce("texts", none).alias("texts"))
    part = lambda when, *words: F.when(when, F.array(*map(F.lit, words))).otherwise(none)
    words = F.concat(
        F.array(F.col("change_type")),
        F.when(F.size("removed") > 0, F.concat(F.array(F.lit("removed column"), F.lit("dropped column")), F.col("removed"))).otherwise(none),
        F.when(F.size("added") > 0, F.concat(F.array(F.lit("added column")), F.col("added"))).otherwise(none),
        part(F.col("change_type").isin("deleted", "renamed"), "deleted model", "renamed", "rename"),
        part(F.col("kind") == "exposure", "exposure", "owner"),
        F.col("texts"),
    )
    return known.select(key, F.when(F.col("is_semantic"), F.array_join(words, " ")).otherwise("").alias("summary"))
