"""Queries on the impact graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_id
from ..operators import graph
from ..shared import cut
from .tables import BASE, CHANGES, EDGES, NODES, Tables, changes, edges, label, label_sql, nodes


def _nations(t: Tables) -> DataFrame:
    return t.nation.select((F.col("n_nationkey").cast("long") + BASE).alias("root"))


def blast_radius(t: Tables, max_depth: int | None = None) -> DataFrame:
    return graph.reach(_nations(t), edges(t), max_depth).select(label("root").alias("root"), label("node").alias("node"), "depth")


def direct_children(t: Tables) -> DataFrame:
    roots = t.supplier.select((F.col("s_suppkey") + 3 * BASE).alias("node"))
    return graph.children(roots, edges(t)).select(label("node").alias("node"), label("child").alias("child"))


def reach_summary(t: Tables) -> DataFrame:
    found = graph.reach_summary(graph.reach_sets(_nations(t), edges(t)), nodes(t))
    return found.select(label("root").alias("root"), "size", "exposures", "contracted", "public", "owners", "depths", "names")


def induced_subgraph(t: Tables) -> DataFrame:
    """Node rows (child null) and edge rows of each nation's shown subgraph, of which hidden counts the whole reach's rest. Ids
    are letters, digits and underscores."""
    e, plain = edges(t), lambda node: plain_id(F.concat(F.lit("model."), label(node)))
    shown = cut(graph.shown_nodes(graph.reach_sets(_nations(t), e)), "shown")
    style = F.when(F.col("kind") == "exposure", "exposure").when(F.col("contracted"), "contracted").otherwise("plain")
    about = nodes(t).select("id", style.alias("style"))
    a = shown.join(about, shown["node"] == about["id"]).select(plain("root").alias("root"), plain("node").alias("node"), F.lit(None).cast("string").alias("child"), "hidden", "style")
    b = graph.induced_edges(shown, e).select(plain("root").alias("root"), plain("parent").alias("node"), plain("child").alias("child"), F.lit(None).cast("long").alias("hidden"), F.lit(None).cast("string").alias("style"))
    return a.unionByName(b)


def assessed(t: Tables) -> DataFrame:
    """Every change with its reach and severity. Reach is found once for each distinct changed node, and only for
    nodes whose change is semantic."""
    c = changes(t)
    found = graph.reach_sets(c.where("is_semantic").select(F.col("node").alias("root")), edges(t))
    sums = graph.reach_counts(found, nodes(t)).withColumnRenamed("root", "node")
    about = nodes(t).select(F.col("id").alias("node"), "materialization")
    counts = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("size", "exposures", "contracted", "public")]
    removed = F.when(F.col("pr_id") % 5 == 0, F.col("pr_id") % 3).otherwise(0)
    unattributed = F.when(F.col("pr_id") % 7 == 0, F.col("pr_id") % 2).otherwise(0)
    joined = c.join(about, "node", "left").join(sums, "node", "left").select("pr_id", "node", "change_type", "is_semantic", "materialization", *counts, removed.alias("removed"), unattributed.alias("unattributed"))
    return graph.severity(joined)


def severity_score(t: Tables) -> DataFrame:
    return assessed(t).select("pr_id", label("node").alias("node"), "severity", "severity_rank", "size", F.array_join("reasons", "; ").alias("reasons")).orderBy(F.desc("severity_rank"), F.desc("size"), "pr_id")


def worst_per_change(t: Tables) -> DataFrame:
    """Change sets are ten events each: the highest severity, and the earliest change that has it."""
    a = assessed(t).withColumn("set_id", F.floor(F.col("pr_id") / 10))
    best = F.max_by(F.struct("pr_id", "severity"), F.struct("severity_rank", -F.col("pr_id"))).alias("best")
    return a.groupBy("set_id").agg(best).select("set_id", "best.severity", F.col("best.pr_id").alias("pr_id"))


def gate_decision(t: Tables) -> DataFrame:
    a = assessed(t).withColumn("pr_id", F.floor(F.col("pr_id") / 10))
    secrets = t.events.where("event_type = 'error' and value < 1").select(F.floor(F.col("event_id") / 10).alias("pr_id"))
    return graph.gate(a.select("pr_id", "node", "severity_rank"), secrets)


def _reach(roots: str, cap: str = "") -> str:
    return f"""WITH RECURSIVE {EDGES}, {NODES}, {CHANGES},
roots AS ({roots}),
walk(root, node, depth) AS (SELECT CAST(root AS BIGINT), CAST(root AS BIGINT), 0 FROM roots UNION SELECT w.root, e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node {cap}),
reach AS (SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE node <> root GROUP BY ALL)
"""


_FROM_NATIONS = f"SELECT {BASE} + n_nationkey AS root FROM nation"
_ASSESSED = _reach("SELECT DISTINCT node AS root FROM changes WHERE is_semantic") + """,
sums AS (SELECT root, count(*) AS size, count(*) FILTER (kind = 'exposure') AS exposures, count(*) FILTER (contracted) AS contracted, count(*) FILTER (access = 'public') AS public
         FROM reach JOIN nodes ON node = id GROUP BY root),
joined AS (SELECT pr_id, c.node, change_type, is_semantic, n.materialization, coalesce(size, 0) AS size, coalesce(exposures, 0) AS exposures, coalesce(s.contracted, 0) AS contracted, coalesce(public, 0) AS public,
             CASE WHEN pr_id % 5 = 0 THEN pr_id % 3 ELSE 0 END AS removed, CASE WHEN pr_id % 7 = 0 THEN pr_id % 2 ELSE 0 END AS unattributed
           FROM changes c LEFT JOIN nodes n ON c.node = n.id LEFT JOIN sums s ON s.root = c.node),
flagged AS (SELECT *, removed > 0 OR change_type IN ('deleted', 'renamed') AS structural FROM joined),
assessed AS (SELECT *,
  CASE WHEN NOT is_semantic THEN 0
       WHEN removed > 0 AND size > 0 OR change_type = 'deleted' AND size > 0 OR structural AND (contracted > 0 OR exposures > 0) THEN 2
       WHEN removed > 0 OR unattributed > 0 OR structural AND public > 0 AND contracted = 0 OR materialization IS NOT DISTINCT FROM 'incremental' THEN 1 ELSE 0 END AS severity_rank,
  CASE WHEN NOT is_semantic THEN 'no semantic change' ELSE coalesce(nullif(concat_ws('; ',
    CASE WHEN removed > 0 THEN concat('removes ', removed, ' columns read by ', size) END,
    CASE WHEN unattributed > 0 THEN concat('removes ', unattributed, ' columns of unknown owner') END,
    CASE WHEN change_type = 'deleted' AND size > 0 THEN concat('deletes what ', size, ' depend on') END,
    CASE WHEN contracted > 0 THEN concat('reaches ', contracted, ' contracted') END,
    CASE WHEN exposures > 0 THEN concat('reaches ', exposures, ' exposures') END,
    CASE WHEN public > 0 AND contracted = 0 THEN concat('reaches ', public, ' public') END,
    CASE WHEN materialization = 'incremental' THEN 'is incremental' END), ''), concat('logic change with ', size, ' downstream')) END AS reasons
  FROM flagged),
scored AS (SELECT *, CASE severity_rank WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM assessed)
"""

QUERIES = {
    "blast_radius": blast_radius,
    "blast_radius_depth_capped": lambda t: blast_radius(t, 2),
    "direct_children": direct_children,
    "reach_summary": reach_summary,
    "induced_subgraph": induced_subgraph,
    "severity_score": severity_score,
    "worst_per_change": worst_per_change,
    "gate_decision": gate_decision,
}
ORACLES = {
    "blast_radius": _reach(_FROM_NATIONS) + f"SELECT {label_sql('root')} AS root, {label_sql('node')} AS node, depth FROM reach",
    "blast_radius_depth_capped": _reach(_FROM_NATIONS, "WHERE w.depth < 2") + f"SELECT {label_sql('root')} AS root, {label_sql('node')} AS node, depth FROM reach",
    "direct_children": f"WITH {EDGES} SELECT {label_sql('parent')} AS node, {label_sql('child')} AS child FROM (SELECT DISTINCT * FROM edges) JOIN supplier ON parent = {3 * BASE} + s_suppkey",
    "reach_summary": _reach(_FROM_NATIONS) + f""",
about AS (SELECT * FROM reach JOIN nodes ON node = id),
d AS (SELECT root, string_agg(concat(depth, ':', n), ' ' ORDER BY depth) AS depths FROM (SELECT root, depth, count(*) AS n FROM about GROUP BY ALL) GROUP BY root),
k AS (SELECT root, string_agg(name, ', ' ORDER BY depth, name, node) AS names FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, name, node) AS k FROM about) WHERE k <= 3 GROUP BY root)
SELECT {label_sql('root')} AS root, count(*) AS size, count(*) FILTER (kind = 'exposure') AS exposures, count(*) FILTER (contracted) AS contracted, count(*) FILTER (access = 'public') AS public,
       coalesce(string_agg(DISTINCT owner, ', ' ORDER BY owner), '') AS owners, any_value(depths) AS depths, any_value(names) AS names
FROM about JOIN d USING (root) JOIN k USING (root) GROUP BY root""",
    "induced_subgraph": _reach(_FROM_NATIONS) + f""",
shown AS (SELECT root, node, greatest(size - 25, 0) AS hidden FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS k, count(*) OVER (PARTITION BY root) AS size FROM reach) WHERE k <= 25),
own AS (SELECT root, node FROM shown UNION SELECT root, root FROM shown)
SELECT concat('model_d', {label_sql('root')}) AS root, concat('model_d', {label_sql('node')}) AS node, NULL::VARCHAR AS child, hidden, CASE WHEN kind = 'exposure' THEN 'exposure' WHEN contracted THEN 'contracted' ELSE 'plain' END AS style FROM shown JOIN nodes ON node = id
UNION ALL SELECT concat('model_d', {label_sql('a.root')}), concat('model_d', {label_sql('parent')}), concat('model_d', {label_sql('child')}), NULL, NULL
FROM own a JOIN (SELECT DISTINCT * FROM edges) ON a.node = parent JOIN own b ON b.root = a.root AND b.node = child""",
    "severity_score": _ASSESSED + f"SELECT pr_id, {label_sql('node')} AS node, severity, CAST(severity_rank AS INTEGER) AS severity_rank, size, reasons FROM scored",
    "worst_per_change": _ASSESSED + "SELECT pr_id // 10 AS set_id, arg_max(severity, (severity_rank, -pr_id)) AS severity, arg_max(pr_id, (severity_rank, -pr_id)) AS pr_id FROM scored GROUP BY 1",
    "gate_decision": _ASSESSED + """,
b AS (SELECT pr_id // 10 AS pr_id, max(severity_rank) AS worst, count(node) AS nodes, count(*) FILTER (severity_rank = 2) AS high FROM scored GROUP BY 1),
x AS (SELECT event_id // 10 AS pr_id, count(*) AS secrets FROM events WHERE event_type = 'error' AND value < 1 GROUP BY 1)
SELECT pr_id, CAST(worst AS INTEGER) AS worst, nodes, coalesce(secrets, 0) AS secrets, worst >= 2 OR coalesce(secrets, 0) > 0 AS failed, nodes = 0 AND coalesce(secrets, 0) = 0 AS nothing_to_report,
       CASE WHEN coalesce(secrets, 0) > 0 THEN concat(secrets, ' exposed secrets') WHEN high > 0 THEN concat(high, ' high severity changes') WHEN nodes = 0 THEN 'no known node changes' ELSE concat(nodes, ' nodes change') END AS status
FROM b LEFT JOIN x USING (pr_id)""",
}
