"""Queries on catalogs (JSON documents made from customers) and on events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import scratch
from ..sources import catalog as C
from ..streaming import events as S
from .tables import Tables


#: Keys that a project spans.
RUN = 1000


def catalogs(t: Tables) -> DataFrame:
    """A project is up to RUN customers of a nation with neighbouring keys, so that documents stay small and grow in number.
    Customers are models, with a test each (every third on a pair of columns, every fourth without attached_node);
    BUILDING customers have exposures. Even nations have a child map."""
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey").cast("string")
    model = F.concat(F.lit("model.p.c"), key)
    source = F.concat(F.lit("source.p.n"), F.col("n_nationkey").cast("string"))
    # the next customer is seldom of this nation; such edges lead nowhere and are dropped
    parents = F.when(F.col("c_custkey") % 4 == 0, F.array(source, F.concat(F.lit("model.p.c"), (F.col("c_custkey") + 1).cast("string")))).otherwise(F.array(source))
    typed = F.when(F.col("c_custkey") % 2 == 0, F.lit("bigint"))
    columns = F.create_map(F.lit("id"), F.struct(typed.alias("data_type")), F.lit("name"), F.struct(F.lit(None).cast("string").alias("data_type")))
    node = F.struct(
        F.col("c_name").alias("name"), F.concat(F.lit("models\\c"), key, F.lit(".sql")).alias("original_file_path"), F.concat(F.lit("p://models/c"), key, F.lit(".yml")).alias("patch_path"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "public").otherwise("protected").alias("access"), F.struct(F.when(F.col("c_acctbal") > 5000, "incremental").otherwise("table").alias("materialized")).alias("config"),
        F.struct((F.col("c_acctbal") < 0).alias("enforced")).alias("contract"), F.struct(parents.alias("nodes")).alias("depends_on"), columns.alias("columns"),
    )
    pair = F.col("c_custkey") % 3 == 0
    test = F.struct(
        F.when(F.col("c_custkey") % 4 != 1, model).alias("attached_node"), F.when(~pair, F.lit("id")).alias("column_name"), F.struct(F.array(model).alias("nodes")).alias("depends_on"),
        F.struct(F.when(pair, "unique_pair").otherwise("unique").alias("name"), F.when(F.col("c_custkey") % 5 == 0, "lib").alias("namespace"), F.struct(F.when(pair, F.array(F.lit("id"), F.lit("name"))).alias("combination_of_columns")).alias("kwargs")).alias("test_metadata"),
    )
    exposure = F.when(F.col("c_mktsegment") == "BUILDING", F.struct(F.concat(F.lit("exposure.p.e"), key).alias("k"), F.struct(F.concat(F.lit("e"), key).alias("name"), F.struct(F.col("c_name").alias("name")).alias("owner"), F.struct(F.array(model).alias("nodes")).alias("depends_on")).alias("v")))
    run = (F.col("n_nationkey") + 100 * F.floor(F.col("c_custkey") / RUN)).cast("long").alias("project")
    grouped = c.groupBy(run, "n_nationkey", "n_name").agg(
        F.collect_list(F.struct(model.alias("k"), node.alias("v"))).alias("models"), F.collect_list(F.struct(F.concat(F.lit("test.p.t"), key).alias("k"), test.alias("v"))).alias("tests"),
        F.collect_list(exposure).alias("exposures"), F.collect_list(model).alias("ids"),
    )
    named = F.concat(F.lit("source.p.n"), F.col("n_nationkey").cast("string"))
    doc = F.struct(
        F.struct(F.concat(F.lit("https://x/manifest/v"), (F.col("n_nationkey") % 12 + 5).cast("string"), F.lit(".json")).alias("dbt_schema_version"), F.concat(F.lit("2024-01-"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("generated_at")).alias("metadata"),
        F.map_from_entries("models").alias("nodes"), F.create_map(named, F.struct(F.col("n_name").alias("name"))).alias("sources"), F.map_from_entries("exposures").alias("exposures"),
        F.when(F.col("n_nationkey") % 2 == 0, F.create_map(named, F.concat("ids", F.array(F.lit("model.p.gone"))))).alias("child_map"), F.map_from_entries("tests").alias("tests"),
    )
    text = F.to_json(doc)
    # tests are nodes too: the two maps of the text become one
    merged = F.regexp_replace(F.regexp_replace(text, r',"tests":\{', r',"tests":{'), r'^(.*?"nodes":\{)(.*),"tests":\{(.*)\}\}$', "$1$3,$2}")
    return C.parse(grouped.select("project", merged.alias("value")), "value")


def catalog_scan(t: Tables) -> DataFrame:
    size = lambda part: F.coalesce(F.size(f"doc.{part}"), F.lit(0)).cast("long").alias(part)
    return catalogs(t).select("project", C.version(F.col("doc")).alias("version"), C.generated_at(F.col("doc")).alias("generated_at"), size("nodes"), size("sources"), size("exposures"))


def version_gate(t: Tables) -> DataFrame:
    return catalogs(t).select("project", C.version(F.col("doc")).alias("version"), C.accepted(F.col("doc")).alias("accepted"))


def node_table(t: Tables) -> DataFrame:
    return C.node_table(catalogs(t)).select("project", "id", "name", "kind", "path", "patch_path", "materialization", "contracted", "access", "owner")


def edge_table(t: Tables) -> DataFrame:
    return C.edge_table(catalogs(t))


def column_test_index(t: Tables) -> DataFrame:
    return C.column_tests(catalogs(t)).select("project", "node", "column", F.array_join("tests", ";").alias("tests"))


def column_evidence(t: Tables) -> DataFrame:
    return C.column_evidence(catalogs(t)).select("project", "node", "position", "column", "type", F.array_join("tests", ";").alias("tests"), F.array_join("node_tests", ";").alias("node_tests"))


def head_or_base_text(t: Tables) -> DataFrame:
    head = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.concat(F.lit("-- head "), "text").alias("text")).where("doc_id % 2 = 0")
    return C.head_or_base(t.documents, head, "doc_id").select("doc_id", "version", F.length("text").cast("long").alias("n_chars"))


PRIORITY = {"signup": 0, "purchase": 1, "click": 2, "view": 3, "error": 4}


def first_usable_source(t: Tables) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p])[F.col("event_type")]
    # the best of each type stands for it
    cause = F.when(F.col("value") < 10, "it is empty").when(F.col("value") < 60, F.concat(F.floor("value").cast("string"), F.lit(" of 60 nodes")))
    rows = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return C.first_usable(rows.select("user_id", F.col("event_type").alias("source"), rank.alias("priority"), (F.col("value") >= 60).alias("usable"), cause.alias("cause")), "user_id").withColumn("warnings", F.array_join("warnings", "; "))


def latest_artifact_asof(t: Tables) -> DataFrame:
    """Each change's newest unexpired artifact: a purchase's latest signup of the user with a value of 1 and more."""
    rows = t.events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("row_id"), F.col("ts").alias("at"))
    facts = t.events.where("event_type = 'signup' and value >= 1").select("user_id", F.col("event_id").alias("fact_id"), F.col("ts").alias("fact_at"))
    return C.latest_asof(rows, facts, "user_id").select("user_id", F.col("row_id").alias("change_id"), F.col("fact_id").alias("artifact_id"))


def stale_catalogs(t: Tables) -> DataFrame:
    """Each user's first catalog (signup) against each change (purchase)."""
    built = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("generated_at"))
    rows = t.events.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("changed_at")).join(built, "user_id", "left")
    return rows.select("user_id", "event_id", C.staleness(rows).alias("warning")).where("warning is not null")


def asof_catalog(t: Tables) -> DataFrame:
    rows = t.events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("row_id"), F.col("ts").alias("at"))
    facts = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("fact_id"), F.col("ts").alias("fact_at"))
    return C.latest_asof(rows, facts, "user_id").select("user_id", F.col("row_id").alias("change_id"), F.col("fact_id").alias("catalog_id"), F.col("fact_at").alias("generated_at"))


def _reviews(t: Tables) -> DataFrame:
    return t.events.where("event_type <> 'view'").select(F.col("event_id").alias("delivery_id"), "ts", F.col("user_id").alias("key"), (F.col("event_type") == "error").alias("failed"), (F.col("value") < 20).alias("nothing_to_report"))


def event_routing(t: Tables) -> DataFrame:
    action = F.when(F.col("event_type") == "signup", "opened").when(F.col("event_type") == "click", "synchronize").when(F.col("event_type") == "purchase", "reopened").otherwise("closed")
    event = F.when(F.col("event_type") == "view", "ping").when(F.col("event_id") % 13 == 0, "push").otherwise("pull_request")
    return S.routed(t.events.select("event_id", event.alias("event"), action.alias("action"))).select("event_id", "route")


def latest_review_per_key(t: Tables) -> DataFrame:
    return S.live(_reviews(t)).select("key", "delivery_id", "ts")


def retracted_reviews(t: Tables) -> DataFrame:
    return S.retracted(_reviews(t)).select("key", "delivery_id")


def review_feed(t: Tables) -> DataFrame:
    """The feed of a stream of reviews that arrive in files, each of which is a batch, summed up: what is live, what was taken back."""
    at = scratch(t.spark, "reviews")
    _reviews(t).repartitionByRange(4, "delivery_id").write.parquet(f"{at}/in")
    stream = t.spark.readStream.schema(t.spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    S.maintain_feed(stream, f"{at}/live", f"{at}/feed", f"{at}/checkpoint", buckets=8).awaitTermination()
    return S.feed_state(t.spark, f"{at}/feed").select("key", "op", F.when(F.col("op") == "upsert", F.col("delivery_id")).alias("delivery_id"))


def dedupe_events(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("delivery_id"), "ts", "event_type")
    return S.deduped(rows.unionByName(rows.where("delivery_id % 10 = 0")))


QUERIES = {f.__name__: f for f in (
    catalog_scan, version_gate, node_table, edge_table, column_test_index, column_evidence, head_or_base_text, first_usable_source, latest_artifact_asof, stale_catalogs, asof_catalog,
    event_routing, latest_review_per_key, retracted_reviews, review_feed, dedupe_events,
)}
_C = "c AS (SELECT *, CAST(c_custkey AS VARCHAR) AS k, c_nationkey + 100 * (c_custkey // 1000) AS project FROM customer)"
_ASOF = """r AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup' {more}),
j AS (SELECT r.user_id, r.event_id AS change_id, arg_max(f.event_id, (f.ts, f.event_id)) AS fact_id, max(f.ts) AS fact_at FROM r LEFT JOIN f ON f.user_id = r.user_id AND f.ts <= r.ts GROUP BY ALL)"""
_REV = "r AS (SELECT event_id AS delivery_id, ts, user_id AS key, value < 20 AS nothing FROM events WHERE event_type NOT IN ('view', 'error')), l AS (SELECT key, arg_max(delivery_id, (ts, delivery_id)) AS delivery_id, max(ts) AS ts, arg_max(nothing, (ts, delivery_id)) AS nothing FROM r GROUP BY key)"
ORACLES = {
    "catalog_scan": f"WITH {_C} SELECT project, CAST(c_nationkey % 12 + 5 AS INTEGER) AS version, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * c_nationkey AS generated_at, 2 * count(*) AS nodes, CAST(1 AS BIGINT) AS sources, count(*) FILTER (c_mktsegment = 'BUILDING') AS exposures FROM c GROUP BY project, c_nationkey",
    "version_gate": f"WITH {_C} SELECT DISTINCT project, CAST(c_nationkey % 12 + 5 AS INTEGER) AS version, c_nationkey % 12 + 5 BETWEEN 7 AND 14 AS accepted FROM c",
    "node_table": f"""WITH {_C} SELECT project, concat('model.p.c', k) AS id, c_name AS name, 'model' AS kind, concat('models\\c', k, '.sql') AS path, concat('models/c', k, '.yml') AS patch_path,
  CASE WHEN c_acctbal > 5000 THEN 'incremental' ELSE 'table' END AS materialization, c_acctbal < 0 AS contracted, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'public' ELSE 'protected' END AS access, NULL::VARCHAR AS owner FROM c
UNION ALL SELECT project, concat('exposure.p.e', k), concat('e', k), 'exposure', NULL, NULL, NULL, false, NULL, c_name FROM c WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT DISTINCT project, concat('source.p.n', c_nationkey), n_name, 'source', NULL, NULL, NULL, false, NULL, NULL FROM c JOIN nation ON n_nationkey = c_nationkey""",
    "edge_table": f"""WITH {_C} SELECT project, concat('source.p.n', c_nationkey) AS parent, concat('model.p.c', k) AS child FROM c
UNION ALL SELECT project, concat('model.p.c', k), concat('exposure.p.e', k) FROM c WHERE c_nationkey % 2 = 1 AND c_mktsegment = 'BUILDING'
UNION ALL SELECT c.project, concat('model.p.c', p.k), concat('model.p.c', c.k) FROM c JOIN c p ON p.c_custkey = c.c_custkey + 1 AND p.project = c.project WHERE c.c_nationkey % 2 = 1 AND c.c_custkey % 4 = 0""",
    "column_test_index": f"WITH {_C} SELECT project, concat('model.p.c', k) AS node, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'id' END AS column, concat(CASE WHEN c_custkey % 5 = 0 THEN 'lib.' ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN 'unique_pair(id, name)' ELSE 'unique' END) AS tests FROM c",
    "column_evidence": f"""WITH {_C}, x AS (SELECT *, concat(CASE WHEN c_custkey % 5 = 0 THEN 'lib.' ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN 'unique_pair(id, name)' ELSE 'unique' END) AS t FROM c)
SELECT project, concat('model.p.c', k) AS node, CAST(0 AS INTEGER) AS position, 'id' AS column, CASE WHEN c_custkey % 2 = 0 THEN 'bigint' END AS type, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE t END AS tests, CASE WHEN c_custkey % 3 = 0 THEN t ELSE '' END AS node_tests FROM x
UNION ALL SELECT project, concat('model.p.c', k), 1, 'name', NULL, '', CASE WHEN c_custkey % 3 = 0 THEN t ELSE '' END FROM x""",
    "head_or_base_text": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels) THEN 'head' ELSE 'base' END AS version, CAST(length(CASE WHEN doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels) THEN concat('-- head ', text) ELSE text END) AS BIGINT) AS n_chars FROM documents",
    "first_usable_source": """WITH e AS (SELECT user_id, event_type AS source, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS p, max(value) >= 60 AS usable, CASE WHEN max(value) < 10 THEN 'it is empty' ELSE concat(CAST(floor(max(value)) AS BIGINT), ' of 60 nodes') END AS cause FROM events GROUP BY ALL),
b AS (SELECT user_id, min(p) FILTER (usable) AS best, arg_min(source, p) FILTER (usable) AS source FROM e GROUP BY user_id)
SELECT b.user_id, b.source, count(*) FILTER (NOT usable AND (best IS NULL OR p < best)) AS refused,
  coalesce(string_agg(concat(e.source, ' isn''t usable: ', cause), '; ' ORDER BY p) FILTER (NOT usable AND (best IS NULL OR p < best)), '') AS warnings FROM b JOIN e USING (user_id) GROUP BY ALL""",
    "latest_artifact_asof": f"WITH {_ASOF.format(more='AND value >= 1')} SELECT user_id, change_id, fact_id AS artifact_id FROM j",
    "asof_catalog": f"WITH {_ASOF.format(more='')} SELECT user_id, change_id, fact_id AS catalog_id, fact_at AS generated_at FROM j",
    "stale_catalogs": """WITH b AS (SELECT user_id, min(ts) AS g FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT user_id, event_id, CASE WHEN g IS NULL THEN 'no timestamp' ELSE concat(round((epoch_us(ts) - epoch_us(g)) / 3.6e9, 1), 'h before the change') END AS warning
FROM events LEFT JOIN b USING (user_id) WHERE event_type = 'purchase' AND (g IS NULL OR g < ts)""",
    "event_routing": "SELECT event_id, CASE WHEN event_type = 'view' THEN 'ping' WHEN event_id % 13 = 0 THEN 'unhandled' WHEN event_type IN ('signup', 'click', 'purchase') THEN 'actionable' ELSE 'ignored' END AS route FROM events",
    "latest_review_per_key": f"WITH {_REV} SELECT key, delivery_id, ts FROM l WHERE NOT nothing",
    "retracted_reviews": f"WITH {_REV} SELECT key, delivery_id FROM l WHERE nothing AND key IN (SELECT key FROM r WHERE NOT nothing)",
    "review_feed": f"WITH {_REV} SELECT key, CASE WHEN nothing THEN 'retract' ELSE 'upsert' END AS op, CASE WHEN NOT nothing THEN delivery_id END AS delivery_id FROM l WHERE NOT nothing OR key IN (SELECT key FROM r WHERE NOT nothing)",
    "dedupe_events": "SELECT event_id AS delivery_id, ts, event_type FROM events",
}
