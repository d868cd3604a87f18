"""Queries on rules: benchmark items are the rules, documents the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import searchable, tokens
from ..operators import retrieval as R
from ..operators import rules as P
from ..operators import stored
from ..shared import cut, scratch
from .scanning import TOKENS_SQL
from .tables import NODES, Tables, label, label_sql, nodes

RULES = [
    {"rule_id": "c1", "kinds": ["model"], "requires": {"access": "public"}},
    {"rule_id": "c2", "kinds": ["model", "seed"], "globs": ["s/*", "p/?"]},
    {"rule_id": "c3", "requires": {"contracted": "true"}},
    {"rule_id": "c4", "globs": ["*/1*"], "requires": {"materialization": "incremental"}},
    {"rule_id": "k1", "applies_as": "checklist", "kinds": ["exposure"]},
    {"rule_id": "k2", "applies_as": "checklist", "globs": ["c/*"], "requires": {"access": "public"}},
]


def _rules(t: Tables) -> DataFrame:
    """rule_id, text and keywords: the text's tokens of twelve letters and more."""
    long = F.array_distinct(F.filter(tokens(F.col("text")), lambda x: F.length(x) >= 12))
    return t.benchmark.select(F.col("item_id").alias("rule_id"), "text", long.alias("keywords"))


def _rule_terms(t: Tables) -> DataFrame:
    return R.terms(_rules(t), "rule_id", searchable(F.col("text"), F.col("keywords")))


def _query_terms(t: Tables) -> DataFrame:
    return R.terms(t.documents.select(F.col("doc_id").alias("query_id"), "text"), "query_id", F.col("text"))


def _keywords(t: Tables) -> DataFrame:
    return _rules(t).select("rule_id", F.explode("keywords").alias("keyword")).withColumn("term", F.col("keyword"))


def idf_table(t: Tables) -> DataFrame:
    return R.idf(_rule_terms(t), "rule_id").select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_vectors(t: Tables) -> DataFrame:
    counted = _rule_terms(t)
    return R.vectors(counted, R.idf(counted, "rule_id"), "rule_id").select("rule_id", "term", F.round("weight", 6).alias("weight"))


def _matches(t: Tables, *by: str) -> tuple[DataFrame, DataFrame]:
    rules = cut(_rule_terms(t), "rule-terms")
    weights = cut(R.idf(rules, "rule_id"), "rule-weights")
    queries = t.documents.select(F.col("doc_id").alias("query_id"), "text", *by)
    return R.matches(queries, "text", cut(R.vectors(rules, weights, "rule_id"), "rule-vectors"), weights, _keywords(t), *by)


def keyword_matches(t: Tables) -> DataFrame:
    return R.keyword_hits(_query_terms(t), _keywords(t))


def tfidf_topk(t: Tables) -> DataFrame:
    return R.top_rules(*_matches(t)).select("query_id", "rule_id", "rank", "score", "has_keyword")


def union_topk(t: Tables) -> DataFrame:
    """Rules of a change set (a source): each rule's best score over its documents, ranked anew."""
    return R.top_rules(*_matches(t, "source"), "source").select("source", "rule_id", "rank", "score")


def _changed(t: Tables) -> DataFrame:
    path = F.concat(F.substring(label("id"), 1, 1), F.lit("/"), F.substring(label("id"), 2, 20))
    return nodes(t).select(label("id").alias("node"), "kind", "access", "contracted", "materialization", path.alias("path"))


ATTRIBUTES = ("access", "contracted", "materialization")


def _rule_rows(t: Tables) -> DataFrame:
    """The rules as a table of rows, loaded and checked."""
    return P.load(t.spark.createDataFrame([(r["rule_id"], r.get("applies_as"), r.get("kinds"), r.get("globs"), r.get("requires")) for r in RULES], P.RULE))


def rule_eligibility(t: Tables) -> DataFrame:
    return P.reasons(_changed(t), _rule_rows(t), ATTRIBUTES).select("node", "rule_id", F.coalesce("reason", F.lit("")).alias("reason"))


def checklist_rules(t: Tables) -> DataFrame:
    return P.eligible(_changed(t), _rule_rows(t), ATTRIBUTES, "checklist").select("node", "rule_id")


def _order_rules(t: Tables) -> DataFrame:
    """A rule for each order, whose key is part of its globs: of four forms, some without a glob."""
    key = F.col("o_orderkey").cast("string")
    form, none = F.col("o_orderkey") % 4, F.lit(None).cast("array<string>")
    bare = F.col("o_orderkey") % 400 == 3
    kinds = F.when(form == 0, F.array(F.lit("model"))).when(form == 2, F.array(F.lit("exposure"), F.lit("model"))).when(bare, F.array(F.lit("source"))).otherwise(none)
    globs = F.when(form == 0, F.array(F.concat(F.lit("c/"), key))).when(form == 1, F.array(F.concat(F.lit("?/"), key, F.lit("[0-4]")))).when(form == 2, F.array(F.concat(F.lit("*/"), key), F.concat(F.lit("zz/"), key, F.lit("*")))).when(~bare, F.array(F.concat(F.lit("o/"), key, F.lit("?")))).otherwise(none)
    requires = F.when((form == 1) | ((form == 3) & ~bare), F.create_map(F.lit("access"), F.lit("protected")))
    return t.orders.select(F.concat(F.lit("r"), key).alias("rule_id"), kinds.alias("kinds"), globs.alias("globs"), requires.alias("requires"))


def rule_index(t: Tables) -> DataFrame:
    """As many rules as there are orders, over all nodes."""
    return P.eligible(_changed(t), P.load(_order_rules(t)), ATTRIBUTES).select("node", "rule_id")


def stored_rule_vectors(t: Tables) -> DataFrame:
    """Vectors of the rules asked for four times: new, unchanged, with some rules reworded, and as they were at first."""
    folder = scratch(t.spark, "rule-vectors")
    rules = _rules(t).select("rule_id", searchable(F.col("text"), F.array_sort("keywords")).alias("text"))
    changed = rules.withColumn("text", F.when(F.col("rule_id") % 7 == 0, F.concat("text", F.lit(" reworded"))).otherwise(F.col("text")))
    runs = [(name, stored.rule_vectors(given, "rule_id", "text", folder)) for name, given in (("new", rules), ("same", rules), ("changed", changed), ("back", rules))]
    return stored.unioned(runs).withColumn("weight", F.round("weight", 6))


def content_signature(t: Tables) -> DataFrame:
    return R.signature(t.benchmark, "item_id", "text")


QUERIES = {f.__name__: f for f in (idf_table, tfidf_vectors, keyword_matches, tfidf_topk, union_topk, rule_eligibility, checklist_rules, rule_index, stored_rule_vectors, content_signature)}
_RULES = f"""rk AS (SELECT item_id, text, list_distinct(list_filter({TOKENS_SQL.format('text')}, lambda k: length(k) >= 12)) AS kws FROM benchmark),
rs AS (SELECT item_id, concat_ws(' ', text, array_to_string(list_concat(kws, kws, kws), ' ')) AS text FROM rk),
rt AS (SELECT item_id AS rule_id, term, count(*) AS tf FROM (SELECT item_id, unnest({TOKENS_SQL.format('text')}) AS term FROM rs) GROUP BY ALL),
w AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(DISTINCT rule_id) FROM rt)) / (1 + count(*))) + 1 AS idf FROM rt GROUP BY term),
rv AS (SELECT rule_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY rule_id)) AS weight FROM rt JOIN w USING (term)),
kw AS (SELECT item_id AS rule_id, unnest(kws) AS term FROM rk)"""
_SCORES = f"""{_RULES},
qt AS (SELECT doc_id AS query_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM documents) GROUP BY ALL),
qw AS (SELECT query_id, term, tf * coalesce(idf, 1.0) AS x FROM qt LEFT JOIN w USING (term)),
qv AS (SELECT query_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS weight FROM qw),
sc AS (SELECT query_id, rule_id, round(sum(qv.weight * rv.weight), 6) AS score FROM qv JOIN rv USING (term) GROUP BY ALL),
hits AS (SELECT query_id, rule_id, count(*) AS hits FROM qt JOIN kw USING (term) GROUP BY ALL)"""


def _top(by: str, scored: str, hits: str) -> str:
    return f"""SELECT {by}, rule_id, CAST(rank AS INTEGER) AS rank, score, has_keyword FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY has_keyword DESC, score DESC, rule_id) AS rank
FROM (SELECT coalesce(s.{by}, h.{by}) AS {by}, coalesce(s.rule_id, h.rule_id) AS rule_id, coalesce(score, 0.0) AS score, coalesce(hits, 0) > 0 AS has_keyword FROM {scored} s FULL JOIN {hits} h ON s.{by} = h.{by} AND s.rule_id = h.rule_id)
WHERE has_keyword OR score >= 0.15) WHERE rank <= 3"""


def _vectors_sql(name: str, rules: str) -> str:
    """CTEs that end in <name>(rule_id, term, weight, signature) of a relation of rules (rule_id, text)."""
    words = ", ".join(f"CAST(sum(CAST('0x' || substr(d, {i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(1, 65, 8))
    return f"""{name}_t AS (SELECT rule_id, term, count(*) AS tf FROM (SELECT rule_id, unnest({TOKENS_SQL.format('text')}) AS term FROM {rules}) GROUP BY ALL),
{name}_w AS (SELECT term, ln((1 + (SELECT count(DISTINCT rule_id) FROM {name}_t)) / (1 + count(*))) + 1 AS idf FROM {name}_t GROUP BY term),
{name}_s AS (SELECT substr(sha256(concat_ws(',', {words})), 1, 16) AS signature FROM (SELECT sha256(concat_ws(chr(10), CAST(rule_id AS VARCHAR), text)) AS d FROM {rules})),
{name} AS (SELECT signature, rule_id, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY rule_id)), 6) AS weight FROM {name}_t JOIN {name}_w USING (term), {name}_s)"""


_CHANGED = f"""{NODES}, ch AS (SELECT {label_sql('id')} AS node, kind, access, contracted, materialization, concat(substr({label_sql('id')}, 1, 1), '/', substr({label_sql('id')}, 2)) AS path FROM nodes)"""
ORACLES = {
    "idf_table": f"WITH {_RULES} SELECT term, df, round(idf, 6) AS idf FROM w",
    "tfidf_vectors": f"WITH {_RULES} SELECT rule_id, term, round(weight, 6) AS weight FROM rv",
    "keyword_matches": f"WITH {_SCORES} SELECT * FROM hits",
    "tfidf_topk": f"WITH {_SCORES} {_top('query_id', 'sc', 'hits')}",
    "union_topk": f"""WITH {_SCORES}, ss AS (SELECT source, rule_id, max(score) AS score FROM sc JOIN documents ON doc_id = query_id GROUP BY ALL), sh AS (SELECT source, rule_id, sum(hits) AS hits FROM hits JOIN documents ON doc_id = query_id GROUP BY ALL)
SELECT source, rule_id, rank, score FROM ({_top('source', 'ss', 'sh')})""",
    "rule_eligibility": f"""WITH {_CHANGED}
SELECT node, 'c1' AS rule_id, CASE WHEN kind <> 'model' THEN concat('kind ', kind, ' is not covered') WHEN access <> 'public' THEN 'requires access=public' ELSE '' END AS reason FROM ch
UNION ALL SELECT node, 'c2', CASE WHEN kind NOT IN ('model', 'seed') THEN concat('kind ', kind, ' is not covered') WHEN NOT (path LIKE 's/%' OR path LIKE 'p/_') THEN 'path matches no glob' ELSE '' END FROM ch
UNION ALL SELECT node, 'c3', CASE WHEN NOT contracted THEN 'requires contracted=true' ELSE '' END FROM ch
UNION ALL SELECT node, 'c4', CASE WHEN NOT path LIKE '%/1%' THEN 'path matches no glob' WHEN materialization <> 'incremental' THEN 'requires materialization=incremental' ELSE '' END FROM ch""",
    "checklist_rules": f"WITH {_CHANGED} SELECT node, 'k1' AS rule_id FROM ch WHERE kind = 'exposure' UNION ALL SELECT node, 'k2' FROM ch WHERE path LIKE 'c/%' AND access = 'public'",
    "rule_index": f"""WITH {_CHANGED}, x AS (SELECT *, substr(path, 1, 1) AS p, substr(path, 3) AS k, substr(path, 3, length(path) - 3) AS cut, substr(path, length(path)) AS d FROM ch),
r AS (SELECT o_orderkey AS n, CAST(o_orderkey AS VARCHAR) AS key FROM orders)
SELECT node, concat('r', key) AS rule_id FROM x JOIN r ON x.k = r.key WHERE n % 4 = 0 AND p = 'c' AND kind = 'model' OR n % 4 = 2 AND kind IN ('exposure', 'model')
UNION ALL SELECT node, concat('r', key) FROM x JOIN r ON x.cut = r.key WHERE n % 4 = 1 AND d IN ('0', '1', '2', '3', '4') AND access = 'protected' OR n % 4 = 3 AND n % 400 <> 3 AND p = 'o' AND access = 'protected'
UNION ALL SELECT node, concat('r', key) FROM x, r WHERE n % 400 = 3 AND kind = 'source'""",
    "stored_rule_vectors": f"""WITH rk AS (SELECT item_id, text, list_sort(list_distinct(list_filter({TOKENS_SQL.format('text')}, lambda k: length(k) >= 12))) AS kws FROM benchmark),
ra AS (SELECT item_id AS rule_id, concat_ws(' ', text, array_to_string(list_concat(kws, kws, kws), ' ')) AS text FROM rk),
rb AS (SELECT rule_id, CASE WHEN rule_id % 7 = 0 THEN concat(text, ' reworded') ELSE text END AS text FROM ra),
{_vectors_sql('va', 'ra')},
{_vectors_sql('vb', 'rb')}
SELECT run, run IN ('same', 'back') AS reused, va.* FROM va, (SELECT unnest(['new', 'same', 'back']) AS run) UNION ALL SELECT 'changed', false, * FROM vb""",
    "content_signature": f"""SELECT substr(sha256(concat_ws(',', {', '.join(f"CAST(sum(CAST('0x' || substr(d, {i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(1, 65, 8))})), 1, 16) AS signature
FROM (SELECT sha256(concat_ws(chr(10), CAST(item_id AS VARCHAR), text)) AS d FROM benchmark)""",
}
