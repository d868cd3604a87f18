"""Queries on the quality of verdicts: labels are what is expected, document lengths the verdict, languages categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import constraints, sink
from ..operators import evaluate as E
from ..operators.constraints import Constraint
from ..shared import scratch
from .tables import Tables


def _outcomes(t: Tables) -> DataFrame:
    labels = t.labels.select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("expected"))
    length = F.col("n_chars")
    actual = F.when(length < 800, 0).when(length < 3000, 1).otherwise(2)
    category = F.when(F.col("lang") == "es", "should-pass").when(F.col("lang") == "de", "subtle").otherwise("breaking")
    verdicts = t.documents.where("doc_id % 19 <> 0").select("doc_id", actual.alias("actual"), (F.col("doc_id") % 17 == 0).alias("errored"))
    named = labels.join(t.documents.select("doc_id", category.alias("category"), "n_chars"), "doc_id")
    return E.outcomes(named, verdicts, "doc_id")


def eval_outcomes(t: Tables) -> DataFrame:
    return _outcomes(t).select("doc_id", "category", "expected", "actual", "errored")


def confusion_metrics(t: Tables) -> DataFrame:
    return E.confusion(_outcomes(t), "should-pass")


def two_arm_metrics(t: Tables) -> DataFrame:
    rows = _outcomes(t)
    other = rows.withColumn("actual", F.when(F.col("n_chars") % 3 == 0, 0).otherwise(F.col("actual")))
    return E.confusion(rows.withColumn("arm", F.lit("rules")).unionByName(other.withColumn("arm", F.lit("model"))), "should-pass", ["arm"])


def metrics_rollup(t: Tables) -> DataFrame:
    return E.rollup(_outcomes(t))


def _sets(t: Tables) -> DataFrame:
    some = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(x)) for x, c in pairs]))
    expected = some(("toxic", F.col("toxic") == 1), ("poor", F.col("quality") == 0))
    got = some(("toxic", F.col("text").contains("trash")), ("poor", F.col("n_chars") % 2 == 0), ("long", F.col("n_chars") > 9000))
    return t.labels.join(t.documents, "doc_id").select("doc_id", expected.alias("expected"), got.alias("got"))


def set_metrics(t: Tables) -> DataFrame:
    return E.set_metrics(_sets(t))


def retrieval_metrics(t: Tables) -> DataFrame:
    return E.retrieval_metrics(_sets(t))


def failure_taxonomy(t: Tables) -> DataFrame:
    rows = _outcomes(t).join(_sets(t).withColumnsRenamed({"expected": "expected_rules", "got": "retrieved"}), "doc_id").withColumn("degraded", F.col("doc_id") % 11 == 0)
    return rows.select(E.failure(rows).alias("failure")).where("failure is not null").groupBy("failure").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "failure")


def _runs(t: Tables) -> DataFrame:
    size = lambda role: F.sum(F.when(F.col("role") == role, F.length("text")).otherwise(0))
    free = F.col("conv_id") % 7 == 0
    runs = t.conversations.groupBy("conv_id").agg(size("user").alias("i"), size("assistant").alias("o"), F.count("*").alias("turns"))
    return runs.select("conv_id", F.when(free, 0).otherwise(F.col("i")).alias("tokens_in"), F.when(free, 0).otherwise(F.col("o")).alias("tokens_out"), F.when(free, 0.0).otherwise(F.col("turns") / 4).alias("latency"))


def cost_summary(t: Tables) -> DataFrame:
    return E.cost_summary(_runs(t))


def wipeout_guard(t: Tables) -> DataFrame:
    runs = _runs(t).select((F.col("conv_id") % 7).alias("run"), F.col("conv_id").alias("row"), "tokens_in", "tokens_out", F.concat(F.lit("row "), F.col("conv_id").cast("string")).alias("detail"))
    return E.wipeout(runs, "run")


def silence_rate(t: Tables) -> DataFrame:
    found = t.documents.where("contains(text, 'token = ')").select("doc_id", F.lit("secret").alias("rule_id")).unionByName(t.documents.where("n_chars > 9000").select("doc_id", F.lit("long").alias("rule_id")))
    return E.silence(t.documents.select("doc_id"), found, found.where("doc_id % 2 = 0"), "doc_id")


def _cited(t: Tables) -> DataFrame:
    # two in five documents cite an id that the pack may not have
    rule = F.when(F.col("doc_id") % 10 == 3, "structural").otherwise((F.col("doc_id") % 50 * (1 + F.col("doc_id") % 5)).cast("string"))
    return t.documents.select("source", rule.alias("rule_id"), (F.col("doc_id") % 3).cast("int").alias("severity_rank"))


def floored_citations(t: Tables) -> DataFrame:
    rules = t.benchmark.select(F.col("item_id").cast("string").alias("rule_id"), (F.col("item_id") % 3).cast("int").alias("rule_rank"))
    return E.floored_citations(_cited(t), rules, "source").select("source", F.array_join("rules", ",").alias("rules"))


def uncited_rules(t: Tables) -> DataFrame:
    return E.uncited(_cited(t), t.benchmark.select(F.col("item_id").cast("string").alias("rule_id")), "source").select("source", F.array_join("unknown", ",").alias("unknown"))


CONSTRAINTS = [
    Constraint("no document", "exists", "doc_id", "documents", "doc_id"),
    Constraint("more than one", "one", "digest", "texts", "digest"),
    Constraint("unknown rule", "known", "rules", "pack", "rule"),
]


def fixture_problems(t: Tables) -> DataFrame:
    """Fixtures are labels: without a document, with a text that others share, or expecting rules that the pack lacks."""
    docs = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    rules = F.array(F.col("doc_id") % 60, F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 500)).alias("rules")
    fixtures = t.labels.select("doc_id", rules).join(docs, "doc_id")
    tables = {"documents": docs.where("doc_id % 23 <> 0"), "texts": docs, "pack": t.benchmark.select(F.col("item_id").alias("rule"))}
    return constraints.broken(fixtures, "doc_id", CONSTRAINTS, tables).select("doc_id", "problem", F.when(F.col("problem") == "unknown rule", F.col("value")).alias("value"), "n")


def stored_runs(t: Tables) -> DataFrame:
    """Two runs of outcomes written to a folder, one of them twice: read back, with their metrics."""
    at, rows = scratch(t.spark, "runs"), _outcomes(t).select("doc_id", "expected", "actual", "errored")
    model = rows.withColumn("actual", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("actual")))
    for run, given in (("rules", rows.where("not errored")), ("model", model), ("rules", rows)):
        sink.write_run(given, given.agg(F.count("*").alias("n"), F.count_if("errored").alias("n_errored")), at, run)
    return sink.read_runs(t.spark, at).join(sink.commits(t.spark, at).select("run", "n", "n_errored"), "run")


def _reviews(t: Tables) -> DataFrame:
    severity = F.when(F.col("role") == "user", "low").when(F.col("role") == "assistant", "medium").otherwise(F.col("role"))
    node = F.when(F.col("turn") % 9 == 0, "a|b").otherwise(F.concat(F.lit("n"), F.col("turn").cast("string")))
    return t.conversations.select((F.col("conv_id") % 20).alias("response"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "conv_id", "turn", F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("rule_id"), node.alias("node"), F.col("text").alias("explanation"), severity.alias("severity"))


def valid_findings(t: Tables) -> DataFrame:
    return E.valid_findings(_reviews(t), "response", "at").select("conv_id", "turn", F.coalesce("problem", F.lit("valid")).alias("problem"))


def duplicate_ids(t: Tables) -> DataFrame:
    return E.duplicate_keys(t.lineitem, "l_orderkey", "l_linenumber")


def rule_source(t: Tables) -> DataFrame:
    """Rules with defaults; a row whose kind of use or id is wrong is refused."""
    use = F.when(F.col("doc_id") % 4 == 0, "checklist").when(F.col("doc_id") % 31 == 0, "sometimes")
    rows = t.documents.select((F.col("doc_id") - F.col("doc_id") % 37 % 2).alias("rule_id"), F.coalesce(use, F.lit("retrieved")).alias("applies_as"), F.coalesce(F.when(F.col("doc_id") % 3 == 0, "high"), F.lit("medium")).alias("severity"))
    twice = E.duplicate_keys(rows, "rule_id").select("rule_id")
    problem = F.when(~F.col("applies_as").isin("retrieved", "checklist"), "applies_as").when(F.col("again"), "duplicate id").otherwise("")
    return rows.join(twice.withColumn("again", F.lit(True)), "rule_id", "left").select("rule_id", "applies_as", "severity", problem.alias("problem"))


QUERIES = {f.__name__: f for f in (
    eval_outcomes, confusion_metrics, two_arm_metrics, metrics_rollup, set_metrics, retrieval_metrics, failure_taxonomy, cost_summary, wipeout_guard, silence_rate, floored_citations,
    fixture_problems, stored_runs, uncited_rules, valid_findings, duplicate_ids, rule_source,
)}
_OUT = """o AS (SELECT l.doc_id, CASE lang WHEN 'es' THEN 'should-pass' WHEN 'de' THEN 'subtle' ELSE 'breaking' END AS category, n_chars,
  CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS expected, CASE WHEN l.doc_id % 19 = 0 THEN NULL WHEN n_chars < 800 THEN 0 WHEN n_chars < 3000 THEN 1 ELSE 2 END AS actual,
  l.doc_id % 19 = 0 OR l.doc_id % 17 = 0 AS errored FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
_CONF = """SELECT {by} tp, fp, fn, tn, coalesce(round(tp / nullif(tp + fp, 0), 3), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 3), 0) AS recall,
  coalesce(round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 3), 0) AS f1, coalesce(round(wrong / nullif(block, 0), 3), 0) AS fpr
FROM (SELECT {by} count(*) FILTER (expected >= 1 AND actual >= 1) AS tp, count(*) FILTER (expected < 1 AND actual >= 1) AS fp, count(*) FILTER (expected >= 1 AND actual < 1) AS fn, count(*) FILTER (expected < 1 AND actual < 1) AS tn,
  count(*) FILTER (category = 'should-pass' AND actual >= 1) AS wrong, count(*) FILTER (category = 'should-pass') AS block FROM {rows} WHERE NOT errored {group})"""
_SETS = """s AS (SELECT d.doc_id, list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'poor' END], lambda x: x IS NOT NULL) AS expected,
  list_filter([CASE WHEN contains(text, 'trash') THEN 'toxic' END, CASE WHEN n_chars % 2 = 0 THEN 'poor' END, CASE WHEN n_chars > 9000 THEN 'long' END], lambda x: x IS NOT NULL) AS got FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
z AS (SELECT *, len(list_intersect(expected, got)) AS b, len(expected) AS e, len(got) AS g FROM s)"""
_RUNS = """r AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) END AS i, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) END AS o,
  CASE WHEN conv_id % 7 = 0 THEN 0.0 ELSE count(*) / 4 END AS latency FROM conversations GROUP BY conv_id)"""
_CITED = "c AS (SELECT source, CASE WHEN doc_id % 10 = 3 THEN 'structural' ELSE CAST(doc_id % 50 * (1 + doc_id % 5) AS VARCHAR) END AS rule_id, doc_id % 3 AS rank FROM documents)"
ORACLES = {
    "eval_outcomes": f"WITH {_OUT} SELECT doc_id, category, expected, actual, errored FROM o",
    "confusion_metrics": f"WITH {_OUT} {_CONF.format(by='', rows='o', group='')}",
    "two_arm_metrics": f"WITH {_OUT}, a AS (SELECT 'rules' AS arm, * FROM o UNION ALL SELECT 'model', * REPLACE (CASE WHEN n_chars % 3 = 0 THEN 0 ELSE actual END AS actual) FROM o) {_CONF.format(by='arm,', rows='a', group='GROUP BY arm')}",
    "metrics_rollup": f"WITH {_OUT} SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category, count(*) AS n, count(*) FILTER (errored) AS errored, count(*) FILTER (NOT errored AND expected = actual) AS exact, coalesce(round(count(*) FILTER (NOT errored AND expected = actual) / nullif(count(*) FILTER (NOT errored), 0), 3), 0) AS exact_rate FROM o GROUP BY ROLLUP (category)",
    "set_metrics": f"WITH {_SETS} SELECT CAST(sum(b) AS BIGINT) AS tp, CAST(sum(g - b) AS BIGINT) AS fp, CAST(sum(e - b) AS BIGINT) AS fn, count(*) FILTER (b = e AND b = g) AS exact, round(sum(b) / sum(g), 3) AS precision, round(sum(b) / sum(e), 3) AS recall, round(count(*) FILTER (e = 0 AND g > 0) / count(*) FILTER (e = 0), 3) AS near_miss_fpr FROM z",
    "retrieval_metrics": f"WITH {_SETS} SELECT round(sum(b) FILTER (e > 0) / sum(g) FILTER (e > 0), 3) AS precision, round(sum(b) / sum(e), 3) AS recall, round(count(*) FILTER (b > 0) / count(*) FILTER (e > 0), 3) AS hit, round(count(*) FILTER (e = 0 AND g = 0) / count(*) FILTER (e = 0), 3) AS silence FROM z",
    "failure_taxonomy": f"""WITH {_OUT}, {_SETS}, f AS (SELECT CASE WHEN errored OR o.expected = actual THEN NULL WHEN doc_id % 11 = 0 THEN 'schema_violation' WHEN e > 0 AND b = 0 THEN 'retrieval_miss'
WHEN category = 'subtle' AND abs(o.expected - actual) = 1 THEN 'label_ambiguity' ELSE 'reasoning_error' END AS failure FROM o JOIN z USING (doc_id)) SELECT failure, count(*) AS n FROM f WHERE failure IS NOT NULL GROUP BY failure""",
    "cost_summary": f"WITH {_RUNS} SELECT CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round(sum(i / 1e6 * 2.5 + o / 1e6 * 10), 6) AS cost, round(avg(i / 1e6 * 2.5 + o / 1e6 * 10) FILTER (i + o > 0), 6) AS mean_cost, round(avg(latency) FILTER (latency > 0), 3) AS mean_latency, max(latency) FILTER (latency > 0) AS max_latency FROM r",
    "wipeout_guard": f"WITH {_RUNS} SELECT conv_id % 7 AS run, bool_or(i + o > 0) AS publishable, CASE WHEN NOT bool_or(i + o > 0) THEN concat('row ', min(conv_id)) END AS cause FROM r GROUP BY 1",
    "silence_rate": """WITH f AS (SELECT doc_id, 'secret' AS rule FROM documents WHERE contains(text, 'token = ') UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars > 9000)
SELECT count(*) AS n, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM f)) AS silent, (SELECT count(*) FROM f WHERE doc_id % 2 <> 0) AS undeclared, round(count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM f)) / count(*), 3) AS silence_rate FROM documents""",
    "floored_citations": f"WITH {_CITED} SELECT source, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM c JOIN benchmark ON CAST(item_id AS VARCHAR) = rule_id WHERE rank >= least(item_id % 3, 1) GROUP BY source",
    "fixture_problems": """WITH f AS (SELECT DISTINCT l.doc_id, text FROM labels l JOIN documents d ON d.doc_id = l.doc_id), c AS (SELECT text, count(*) AS n FROM documents GROUP BY text)
SELECT doc_id, 'no document' AS problem, NULL::VARCHAR AS value, CAST(0 AS BIGINT) AS n FROM f WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 23 <> 0)
UNION ALL SELECT doc_id, 'more than one', NULL, n FROM f JOIN c USING (text) WHERE n > 1
UNION ALL SELECT DISTINCT doc_id, 'unknown rule', CAST(r AS VARCHAR), 0 FROM (SELECT doc_id, unnest([doc_id % 60, CASE WHEN doc_id % 3 = 0 THEN doc_id % 500 END]) AS r FROM f) WHERE r IS NOT NULL AND r NOT IN (SELECT item_id FROM benchmark)""",
    "stored_runs": f"""WITH {_OUT}, r AS (SELECT 'rules' AS run, doc_id, expected, actual, errored FROM o UNION ALL SELECT 'model', doc_id, expected, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE actual END, errored FROM o)
SELECT *, count(*) OVER (PARTITION BY run) AS n, count(*) FILTER (errored) OVER (PARTITION BY run) AS n_errored FROM r""",
    "uncited_rules": f"WITH {_CITED} SELECT source, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS unknown FROM c WHERE rule_id <> 'structural' AND rule_id NOT IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark) GROUP BY source",
    "valid_findings": """SELECT conv_id, turn, CASE WHEN length(text) NOT BETWEEN 1 AND 1200 THEN 'explanation' WHEN role NOT IN ('user', 'assistant') THEN 'severity' WHEN turn % 9 = 0 THEN 'sign'
WHEN row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id * 1000 + turn) > 25 THEN 'too many' ELSE 'valid' END AS problem FROM conversations""",
    "duplicate_ids": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "rule_source": """WITH r AS (SELECT doc_id - doc_id % 37 % 2 AS rule_id, CASE WHEN doc_id % 4 = 0 THEN 'checklist' WHEN doc_id % 31 = 0 THEN 'sometimes' ELSE 'retrieved' END AS applies_as, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'medium' END AS severity FROM documents)
SELECT *, CASE WHEN applies_as = 'sometimes' THEN 'applies_as' WHEN count(*) OVER (PARTITION BY rule_id) > 1 THEN 'duplicate id' ELSE '' END AS problem FROM r""",
}
