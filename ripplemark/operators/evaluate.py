"""How good verdicts are: confusion matrices, set metrics, retrieval metrics, failures, cost, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import rate

# US dollars for a million tokens in and out.
PRICE_IN, PRICE_OUT = 2.50, 10.00
FLAG = 1  # medium
MOST_FINDINGS = 25


def outcomes(labels: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Labels with the verdict on them; a label without one stays and is errored."""
    joined = labels.join(actual, key, "left")
    return joined.withColumn("errored", F.col("actual").isNull() | F.coalesce("errored", F.lit(False)))


def _four(expected: Column, actual: Column) -> list[Column]:
    e, a = expected >= FLAG, actual >= FLAG
    return [F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"), F.count_if(~e & ~a).alias("tn")]


def _rates(counted: DataFrame) -> DataFrame:
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 3)
    return counted.withColumns({"precision": F.round(F.coalesce(p, F.lit(0.0)), 3), "recall": F.round(F.coalesce(r, F.lit(0.0)), 3), "f1": f1})


def confusion(rows: DataFrame, should_pass: str, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, and fpr over the should_pass category. rows: category, expected and
    actual severity ranks, errored; errored rows don't count."""
    block = F.col("category") == should_pass
    counted = rows.where("not errored").groupBy(*by).agg(*_four(F.col("expected"), F.col("actual")), F.count_if(block & (F.col("actual") >= FLAG)).alias("wrong"), F.count_if(block).alias("block"))
    return _rates(counted).withColumn("fpr", rate(F.col("wrong"), F.col("block"))).drop("wrong", "block")


def rollup(rows: DataFrame) -> DataFrame:
    """For each category and overall: n, errored, exact and its rate over rows that ran."""
    ran = ~F.col("errored")
    summed = rows.rollup("category").agg(F.count("*").alias("n"), F.count_if("errored").alias("errored"), F.count_if(ran & (F.col("expected") == F.col("actual"))).alias("exact"), F.grouping("category").alias("g"))
    return summed.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("category")).alias("category"), "n", "errored", "exact", rate(F.col("exact"), F.col("n") - F.col("errored")).alias("exact_rate"))


def set_metrics(rows: DataFrame) -> DataFrame:
    """tp, fp, fn over sets, precision, recall, exact matches and the near-miss rate. rows: arrays expected and got."""
    both, more, less = F.size(F.array_intersect("expected", "got")), F.size(F.array_except("got", "expected")), F.size(F.array_except("expected", "got"))
    silent = F.size("expected") == 0
    counted = rows.agg(F.sum(both).alias("tp"), F.sum(more).alias("fp"), F.sum(less).alias("fn"), F.count_if((more == 0) & (less == 0)).alias("exact"), F.count_if(silent & (F.size("got") > 0)).alias("loud"), F.count_if(silent).alias("near"))
    return counted.select("tp", "fp", "fn", "exact", rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), rate(F.col("loud"), F.col("near")).alias("near_miss_fpr"))


def retrieval_metrics(rows: DataFrame) -> DataFrame:
    """precision, recall and hit rate over rows that expect rules, correct silence over those that don't."""
    wants = F.size("expected") > 0
    both = F.size(F.array_intersect("expected", "got"))
    counted = rows.agg(
        F.sum(F.when(wants, both).otherwise(0)).alias("both"), F.sum(F.when(wants, F.size("got")).otherwise(0)).alias("given"), F.sum(F.size("expected")).alias("wanted"),
        F.count_if(wants & (both > 0)).alias("hits"), F.count_if(wants).alias("n"), F.count_if(~wants & (F.size("got") == 0)).alias("silent"), F.count_if(~wants).alias("m"),
    )
    return counted.select(rate(F.col("both"), F.col("given")).alias("precision"), rate(F.col("both"), F.col("wanted")).alias("recall"), rate(F.col("hits"), F.col("n")).alias("hit"), rate(F.col("silent"), F.col("m")).alias("silence"))


def failure(rows: DataFrame) -> Column:
    """Why a row is wrong; null if it is right or didn't run. The first that fits."""
    missed = (F.size("expected_rules") > 0) & (F.size(F.array_intersect("expected_rules", "retrieved")) == 0)
    return (
        F.when(F.col("errored") | (F.col("expected") == F.col("actual")), F.lit(None).cast("string"))
        .when(F.col("degraded"), "schema_violation")
        .when(missed, "retrieval_miss")
        .when((F.col("category") == "subtle") & (F.abs(F.col("expected") - F.col("actual")) == 1), "label_ambiguity")
        .otherwise("reasoning_error")
    )


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * PRICE_IN + tokens_out / 1e6 * PRICE_OUT


def cost_summary(runs: DataFrame) -> DataFrame:
    """Totals, mean cost over runs that spent, mean and largest latency over those above zero. runs: tokens_in,
    tokens_out, latency."""
    spent = F.col("tokens_in") + F.col("tokens_out") > 0
    each, late = cost(F.col("tokens_in"), F.col("tokens_out")), F.when(F.col("latency") > 0, F.col("latency"))
    return runs.agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum(each), 6).alias("cost"), F.round(F.avg(F.when(spent, each)), 6).alias("mean_cost"), F.round(F.avg(late), 3).alias("mean_latency"), F.max(late).alias("max_latency"))


def wipeout(runs: DataFrame, by: str) -> DataFrame:
    """For each run whether any row spent tokens (else it can't be published), and the first row's detail if not."""
    spent = F.bool_or(F.col("tokens_in") + F.col("tokens_out") > 0)
    return runs.groupBy(by).agg(spent.alias("publishable"), F.min_by("detail", "row").alias("detail")).select(by, "publishable", F.when(~F.col("publishable"), F.col("detail")).alias("cause"))


def silence(rows: DataFrame, findings: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """rows without a finding, and findings that no exception declares. findings, allowed: (key, rule_id)."""
    found = findings.select(key).distinct().withColumn("loud", F.lit(1))
    quiet = rows.join(found, key, "left").agg(F.count("*").alias("n"), F.count_if(F.col("loud").isNull()).alias("silent"))
    undeclared = findings.join(allowed, [key, "rule_id"], "left_anti").agg(F.count("*"))
    return quiet.withColumn("undeclared", undeclared.scalar()).select("n", "silent", "undeclared", rate(F.col("silent"), F.col("n")).alias("silence_rate"))


def floored_citations(cited: DataFrame, rules: DataFrame, by: str) -> DataFrame:
    """(by, rules): distinct rules cited at the lesser of the rule's severity and medium, or above. cited: (by,
    rule_id, severity_rank); rules: (rule_id, rule_rank)."""
    kept = cited.join(rules, "rule_id").where(F.col("severity_rank") >= F.least("rule_rank", F.lit(FLAG)))
    return kept.groupBy(by).agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


def uncited(cited: DataFrame, pack: DataFrame, by: str) -> DataFrame:
    """(by, unknown): cited ids that the pack doesn't have, sorted. `structural` is always known."""
    unknown = cited.where("rule_id <> 'structural'").join(pack.select("rule_id").distinct(), "rule_id", "left_anti")
    return unknown.groupBy(by).agg(F.array_sort(F.collect_set("rule_id")).alias("unknown"))


def valid_findings(findings: DataFrame, by: str, order: str) -> DataFrame:
    """findings with problem, null if valid: lengths, severities, forbidden signs, and at most MOST_FINDINGS for each.
    findings: rule_id, node, explanation, severity."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    sized = lambda c, most: F.length(c).between(1, most)
    problem = (
        F.when(~sized("rule_id", 64), "rule_id").when(~sized("node", 128), "node").when(~sized("explanation", 1200), "explanation")
        .when(~F.col("severity").isin("low", "medium", "high"), "severity").when(F.col("node").rlike(r"[`|\n]") | F.col("rule_id").rlike(r"[`|\n]"), "sign").when(nth > MOST_FINDINGS, "too many")
    )
    return findings.withColumn("problem", problem)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
