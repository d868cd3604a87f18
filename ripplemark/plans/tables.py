"""The driver's tables as the relations that the operators read, in Spark and as SQL.

Node ids are bigints, kind x 10^9 + key; kinds: 0 region, 1 nation, 2 customer, 3 supplier, 4 part, 5 order. Results
name nodes by a letter and the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 1_000_000_000
LETTERS = "rncspo"


class Tables:
    """Tables of one directory, read when asked for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def node_id(kind: str, key: str) -> Column:
    return F.col(key).cast("long") + LETTERS.index(kind) * BASE


def label(node: str) -> Column:
    letter = F.substring(F.lit(LETTERS), (F.floor(F.col(node) / BASE) + 1).cast("int"), F.lit(1))
    return F.concat(letter, F.pmod(F.col(node), F.lit(BASE)).cast("string"))


def edges(t: Tables) -> DataFrame:
    """(parent, child). Line items repeat edges; who needs different ones drops the others where few are left."""

    def pairs(df: DataFrame, a: str, x: str, b: str, y: str) -> DataFrame:
        return df.select(node_id(a, x).alias("parent"), node_id(b, y).alias("child"))

    lines = t.lineitem
    return reduce(DataFrame.unionByName, [
        pairs(t.nation, "r", "n_regionkey", "n", "n_nationkey"),
        pairs(t.customer, "n", "c_nationkey", "c", "c_custkey"),
        pairs(t.supplier, "n", "s_nationkey", "s", "s_suppkey"),
        pairs(t.orders, "c", "o_custkey", "o", "o_orderkey"),
        pairs(lines, "s", "l_suppkey", "p", "l_partkey"),
        pairs(lines, "p", "l_partkey", "o", "l_orderkey"),
    ])


def nodes(t: Tables) -> DataFrame:
    def made(df: DataFrame, letter: str, key: str, name: str, **more: Column) -> DataFrame:
        plain = {"kind": F.lit("model"), "contracted": F.lit(False), "access": F.lit("protected"), "owner": F.lit(None).cast("string"), "materialization": F.lit("table")}
        return df.select(node_id(letter, key).alias("id"), F.expr(name).alias("name"), *[v.alias(k) for k, v in (plain | more).items()])

    urgent = F.col("o_orderpriority").startswith("1-")
    return reduce(DataFrame.unionByName, [
        made(t.region, "r", "r_regionkey", "r_name", kind=F.lit("source")),
        made(t.nation, "n", "n_nationkey", "n_name", kind=F.lit("seed")),
        made(t.customer, "c", "c_custkey", "c_name", access=F.when(F.col("c_mktsegment") == "BUILDING", "public").otherwise("protected")),
        made(t.supplier, "s", "s_suppkey", "s_name", contracted=F.col("s_acctbal") < 0),
        made(t.part, "p", "p_partkey", "p_name", materialization=F.when(F.col("p_size") > 40, "incremental").otherwise("table")),
        made(t.orders, "o", "o_orderkey", "concat('Order#', o_orderkey)", kind=F.when(urgent, "exposure").otherwise("model"), owner=F.when(urgent, F.col("o_orderpriority"))),
    ])


def changes(t: Tables) -> DataFrame:
    """(pr_id, node, change_type, is_semantic): an event changes its user's customer."""
    kind = F.create_map(*[F.lit(x) for pair in (("signup", "added"), ("click", "modified"), ("purchase", "renamed"), ("error", "deleted"), ("view", "modified")) for x in pair])
    return t.events.select(F.col("event_id").alias("pr_id"), node_id("c", "user_id").alias("node"), kind[F.col("event_type")].alias("change_type"), (F.col("event_type") != "view").alias("is_semantic"), "ts", "value", "event_type")


def lines(t: Tables) -> DataFrame:
    """(file, line_no, text): the lines of documents."""
    return t.documents.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


EDGES = f"""edges AS (
  SELECT n_regionkey::BIGINT AS parent, {BASE} + n_nationkey AS child FROM nation
  UNION ALL SELECT {BASE} + c_nationkey, {2 * BASE} + c_custkey FROM customer
  UNION ALL SELECT {BASE} + s_nationkey, {3 * BASE} + s_suppkey FROM supplier
  UNION ALL SELECT {2 * BASE} + o_custkey, {5 * BASE} + o_orderkey FROM orders
  UNION ALL SELECT DISTINCT {3 * BASE} + l_suppkey, {4 * BASE} + l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT {4 * BASE} + l_partkey, {5 * BASE} + l_orderkey FROM lineitem)"""
NODES = f"""nodes AS (
  SELECT r_regionkey::BIGINT AS id, r_name AS name, 'source' AS kind, false AS contracted, 'protected' AS access, NULL::VARCHAR AS owner, 'table' AS materialization FROM region
  UNION ALL SELECT {BASE} + n_nationkey, n_name, 'seed', false, 'protected', NULL, 'table' FROM nation
  UNION ALL SELECT {2 * BASE} + c_custkey, c_name, 'model', false, CASE WHEN c_mktsegment = 'BUILDING' THEN 'public' ELSE 'protected' END, NULL, 'table' FROM customer
  UNION ALL SELECT {3 * BASE} + s_suppkey, s_name, 'model', s_acctbal < 0, 'protected', NULL, 'table' FROM supplier
  UNION ALL SELECT {4 * BASE} + p_partkey, p_name, 'model', false, 'protected', NULL, CASE WHEN p_size > 40 THEN 'incremental' ELSE 'table' END FROM part
  UNION ALL SELECT {5 * BASE} + o_orderkey, concat('Order#', o_orderkey), CASE WHEN o_orderpriority LIKE '1-%' THEN 'exposure' ELSE 'model' END, false, 'protected', CASE WHEN o_orderpriority LIKE '1-%' THEN o_orderpriority END, 'table' FROM orders)"""
CHANGES = f"""changes AS (
  SELECT event_id AS pr_id, {2 * BASE} + user_id AS node,
         CASE event_type WHEN 'signup' THEN 'added' WHEN 'purchase' THEN 'renamed' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type,
         event_type <> 'view' AS is_semantic, ts, value, event_type FROM events)"""
LINES = "lines AS (SELECT doc_id AS file, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents)"


def label_sql(x: str) -> str:
    return f"concat(substr('{LETTERS}', CAST({x} // {BASE} + 1 AS BIGINT), 1), {x} % {BASE})"
