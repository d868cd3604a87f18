"""JSON catalogs as relations: one document a project, many projects a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The range of schema versions that are read, and the kinds of nodes.
OLDEST, NEWEST = 7, 14
KINDS = ("model", "seed", "snapshot", "source", "exposure", "test")

_NODE = (
    "struct<name:string,original_file_path:string,patch_path:string,access:string,raw_code:string,config:struct<materialized:string>,contract:struct<enforced:boolean>,"
    "depends_on:struct<nodes:array<string>>,columns:map<string,struct<data_type:string>>,owner:struct<name:string,email:string>,"
    "attached_node:string,column_name:string,test_metadata:struct<name:string,namespace:string,kwargs:struct<combination_of_columns:array<string>>>>"
)
SCHEMA = f"struct<metadata:struct<dbt_schema_version:string,generated_at:string,project_name:string>,nodes:map<string,{_NODE}>,sources:map<string,{_NODE}>,exposures:map<string,{_NODE}>,child_map:map<string,array<string>>>"
NONE = "array<string>"


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """(project, doc) of a folder of JSON files; the project is the file's name without its ending."""
    texts = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    return parse(texts.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("project"), "value"), "value")


def parse(documents: DataFrame, text: str) -> DataFrame:
    """documents with doc, the parsed catalog; null where it isn't JSON."""
    return documents.withColumn("doc", F.from_json(text, SCHEMA)).drop(text)


def version(doc: Column) -> Column:
    return F.regexp_extract(doc["metadata"]["dbt_schema_version"], r"/v(\d+)[^/]*$", 1).try_cast("int")


def accepted(doc: Column) -> Column:
    """Versions in the tested range, and those that can't be read."""
    return F.coalesce(version(doc).between(OLDEST, NEWEST), F.lit(True))


def generated_at(doc: Column) -> Column:
    return F.try_to_timestamp(doc["metadata"]["generated_at"])


def kind(node_id: Column) -> Column:
    prefix = F.substring_index(node_id, ".", 1)
    return F.when(prefix.isin(*KINDS), prefix).otherwise("other")


def _entries(catalogs: DataFrame, part: str) -> DataFrame:
    return catalogs.select("project", F.explode(f"doc.{part}").alias("id", "n"))


def node_table(catalogs: DataFrame) -> DataFrame:
    """Nodes, sources and exposures as one relation, tests left out."""
    patch = F.element_at(F.split("n.patch_path", "://"), -1)
    own = _entries(catalogs, "nodes").withColumn("kind", kind(F.col("id"))).where("kind <> 'test'")
    every = own.unionByName(_entries(catalogs, "sources").withColumn("kind", F.lit("source"))).unionByName(_entries(catalogs, "exposures").withColumn("kind", F.lit("exposure")))
    return every.select(
        "project", "id", F.coalesce("n.name", F.lit("")).alias("name"), "kind", F.col("n.original_file_path").alias("path"), patch.alias("patch_path"), F.col("n.config.materialized").alias("materialization"),
        F.coalesce("n.contract.enforced", F.lit(False)).alias("contracted"), F.col("n.access").alias("access"), F.coalesce("n.owner.name", "n.owner.email").alias("owner"),
        F.coalesce("n.depends_on.nodes", F.array().cast(NONE)).alias("depends_on"), F.coalesce(F.map_keys("n.columns"), F.array().cast(NONE)).alias("columns"),
        F.map_filter(F.transform_values("n.columns", lambda k, v: v["data_type"]), lambda k, v: v.isNotNull()).alias("column_types"), F.col("n.raw_code").alias("raw_code"),
    )


def edge_table(catalogs: DataFrame) -> DataFrame:
    """(project, parent, child) among known nodes: the document's own child map, or, for projects without one, the
    nodes' dependencies inverted."""
    nodes = node_table(catalogs)
    mapped = catalogs.where("size(doc.child_map) > 0").select("project", F.explode("doc.child_map").alias("parent", "children")).select("project", "parent", F.explode("children").alias("child"))
    bare = catalogs.where("doc.child_map is null or size(doc.child_map) = 0").select("project")
    built = nodes.join(bare, "project", "left_semi").select("project", F.explode("depends_on").alias("parent"), F.col("id").alias("child"))
    ids = nodes.select("project", "id")
    known = mapped.unionByName(built).join(ids.withColumnRenamed("id", "parent"), ["project", "parent"], "left_semi")
    return known.join(ids.withColumnRenamed("id", "child"), ["project", "child"], "left_semi").select("project", "parent", "child")


def column_tests(catalogs: DataFrame) -> DataFrame:
    """(project, node, column, tests): sorted test names; column '' holds tests of the whole node. A test without
    attached_node counts only if it depends on one node."""
    tests = _entries(catalogs, "nodes").where(kind(F.col("id")) == "test").where("n.test_metadata.name is not null")
    parents = F.col("n.depends_on.nodes")
    node = F.coalesce("n.attached_node", F.when(F.size(parents) == 1, F.get(parents, F.lit(0))))
    combo = F.col("n.test_metadata.kwargs.combination_of_columns")
    column = F.coalesce("n.column_name", F.lit(""))
    name = F.concat_ws(".", "n.test_metadata.namespace", "n.test_metadata.name")
    named = F.when((column == "") & (F.size(combo) > 0), F.concat(name, F.lit("("), F.array_join(combo, ", "), F.lit(")"))).otherwise(name)
    rows = tests.select("project", node.alias("node"), column.alias("column"), named.alias("test")).where("node is not null")
    return rows.groupBy("project", "node", "column").agg(F.array_sort(F.collect_list("test")).alias("tests"))


def column_evidence(catalogs: DataFrame) -> DataFrame:
    """(project, node, position, column, type, tests, node_tests) of every column of every node."""
    columns = node_table(catalogs).select("project", F.col("id").alias("node"), "column_types", F.posexplode("columns").alias("position", "column"))
    tests = column_tests(catalogs)
    whole = tests.where("column = ''").select("project", "node", F.col("tests").alias("node_tests"))
    joined = columns.join(tests.where("column <> ''"), ["project", "node", "column"], "left").join(whole, ["project", "node"], "left")
    none = F.array().cast(NONE)
    return joined.select("project", "node", "position", "column", F.try_element_at("column_types", F.col("column")).alias("type"), F.coalesce("tests", none).alias("tests"), F.coalesce("node_tests", none).alias("node_tests"))


def head_or_base(base: DataFrame, head: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """(key, version, text): the head's text where there is one, else the base's; cut to limit characters if one is given."""
    new = head.select(key, F.col("text").alias("head"))
    return base.join(new, key, "left").select(key, F.when(F.col("head").isNotNull(), "head").otherwise("base").alias("version"), (F.coalesce("head", "text") if limit is None else F.substring(F.coalesce("head", "text"), 1, limit)).alias("text"))


def first_usable(candidates: DataFrame, key: str) -> DataFrame:
    """(key, source, refused, warnings): the usable candidate of the smallest priority, how many better ones were refused,
    and a warning for each of them, in order, with its cause where one is given. candidates: (key, source, priority, usable,
    and cause if known), few for each key."""
    cause = F.concat(F.lit(": "), "cause") if "cause" in candidates.columns else F.lit("")
    chosen = candidates.groupBy(key).agg(F.min(F.when(F.col("usable"), F.col("priority"))).alias("p"), F.min_by("source", F.when(F.col("usable"), F.col("priority"))).alias("source"))
    refused = candidates.where("not usable").join(chosen.select(key, "p"), key).where("p is null or priority < p").groupBy(key).agg(
        F.count("*").alias("refused"), F.array_sort(F.collect_list(F.struct("priority", F.concat("source", F.lit(" isn't usable"), F.coalesce(cause, F.lit(""))).alias("said")))).alias("each")
    )
    warnings = F.coalesce(F.col("each.said"), F.array().cast(NONE)).alias("warnings")
    return chosen.join(refused, key, "left").select(key, "source", F.coalesce("refused", F.lit(0)).alias("refused"), warnings)


def latest_asof(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """For each row (key, row_id, at) the latest fact (key, fact_id, fact_at) at or before it; null without one. Of facts
    of one time that of the largest fact_id counts.

    Rows and facts are put on one line for each key and day, along which a running last value carries the fact; the last
    fact of the days before comes from one row a day. So a key with a third of all rows is as many tasks as it has days.
    """
    b = facts.select(key, F.col("fact_at").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("row_id"), F.struct(F.col("fact_id").cast("long").alias("fact_id"), "fact_at").alias("fact"))
    a = rows.select(key, F.col("at").alias("t"), F.lit(1).alias("side"), "row_id", F.lit(None).cast(b.schema["fact"].dataType).alias("fact"))
    both = a.unionByName(b).withColumn("day", F.date_trunc("day", F.col("t").cast("timestamp")))
    days = both.groupBy(F.col(key).alias("k"), F.col("day").alias("d")).agg(F.max(F.when(F.col("side") == 0, F.struct("t", "fact.fact_id", "fact"))).alias("best"))
    earlier = Window.partitionBy("k").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("k", "d", F.last("best.fact", ignorenulls=True).over(earlier).alias("before"))
    line = Window.partitionBy(key, "day").orderBy("t", "side", "fact.fact_id").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("own", F.last("fact", ignorenulls=True).over(line)).where("side = 1")
    carried = own.join(before, F.col(key).eqNullSafe(F.col("k")) & F.col("day").eqNullSafe(F.col("d"))).withColumn("last", F.coalesce("own", "before"))
    return carried.select(key, "row_id", F.col("t").alias("at"), "last.fact_id", "last.fact_at")


def staleness(rows: DataFrame) -> Column:
    """Warning of a catalog older than the change (generated_at, changed_at); null if it is fresh or nothing is compared."""
    hours = F.round((F.unix_micros(F.col("changed_at").cast("timestamp")) - F.unix_micros(F.col("generated_at").cast("timestamp"))) / 3.6e9, 1)
    return F.when(F.col("generated_at").isNull(), "no timestamp").when(F.col("generated_at") < F.col("changed_at"), F.concat(hours.cast("string"), F.lit("h before the change")))
