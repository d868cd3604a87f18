"""From change lines and snapshots to what changed, and whose it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LIST_NAME, basename, is_semantic, line_class, normal_path
from . import carry


def segment(lines: DataFrame, key: str = "pr", chunk: int = carry.CHUNK) -> DataFrame:
    """Adds class, file_no and hunk_no: running counts of file headers, and of hunks in a file, in line order. A change
    set of any size is many tasks: see carry."""
    classed = lines.withColumn("class", line_class(F.col("text")))
    return carry.sections(classed, F.col("class") == "header", F.col("class") == "hunk", [key], "line_no", "file_no", "hunk_no", chunk)


def file_lines(lines: DataFrame) -> DataFrame:
    """Those lines of a diff that tell its files, their paths and their change types. To segment() them alone spares the
    exchange of all others; counts of lines and what is semantic need those."""
    return lines.where(line_class(F.col("text")).isin("header", "new", "deleted", "renamed"))


def changed_lines(segmented: DataFrame, key: str = "pr", most: int = 40) -> DataFrame:
    """(key, file_no, line_no, text, nth): the added and removed lines of each file without their sign, most at most; a
    report shows no more."""
    changed = segmented.where(F.col("class").isin("added", "removed") & (F.col("file_no") > 0))
    nth = F.row_number().over(Window.partitionBy(key, "file_no").orderBy("line_no"))
    return changed.select(key, "file_no", "line_no", F.substring(F.col("text"), 2, 1 << 30).alias("text"), nth.alias("nth")).where(F.col("nth") <= most)


def changed_files(segmented: DataFrame, key: str = "pr") -> DataFrame:
    """A row for each file of a diff: path, previous_path, change_type, counts of lines, is_semantic."""
    header = r"^diff --git a/(.+?) b/(.+?)$"
    path = F.max(F.when(F.col("class") == "header", F.regexp_extract("text", header, 2)))
    rows = segmented.where("file_no > 0").withColumn("changed", F.col("class").isin("added", "removed"))
    found = rows.withColumn("body", F.substring(F.col("text"), 2, 1 << 30)).groupBy(key, "file_no").agg(
        path.alias("path"),
        F.max(F.when(F.col("class") == "renamed", F.substring(F.col("text"), 13, 1 << 30))).alias("previous_path"),
        F.when(F.bool_or(F.col("class") == "renamed"), "renamed").when(F.bool_or(F.col("class") == "deleted"), "deleted").when(F.bool_or(F.col("class") == "new"), "added").otherwise("modified").alias("change_type"),
        F.count_if(F.col("class") == "added").alias("n_added"),
        F.count_if(F.col("class") == "removed").alias("n_removed"),
        F.bool_or(F.col("changed") & is_semantic(F.col("body"), F.lit(False))).alias("sql_semantic"),
        F.bool_or(F.col("changed") & is_semantic(F.col("body"), F.lit(True))).alias("yaml_semantic"),
    )
    yaml = F.col("path").rlike(r"\.ya?ml$")
    return found.withColumn("is_semantic", F.when(yaml, F.col("yaml_semantic")).otherwise(F.col("sql_semantic"))).drop("sql_semantic", "yaml_semantic")


def attribute(lines: DataFrame, heading: Column, keys: list[str], order: str, chunk: int = carry.CHUNK) -> DataFrame:
    """Adds owner: the nearest heading at or before the line, by a number; null where there is none."""
    return carry.last_value(lines, heading, keys, order, "owner", chunk)


def list_name(text: Column) -> Column:
    name = F.regexp_extract(text, LIST_NAME, 1)
    return F.when(name != "", name)


def owners(files: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """(file, node, columns): columns go to the node that names them. A file that names any owner keeps only named
    nodes; one that names none keeps all its nodes, without columns; a sole node takes the columns without an owner.

    files: (file, node) candidates; nodes: (node, name); named: (file, owner or null, column).
    """
    sole = files.groupBy("file").agg(F.count("*").alias("n"))
    per = named.where("owner is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_set("column")).alias("own"))
    orphans = named.where("owner is null").groupBy("file").agg(F.array_sort(F.collect_set("column")).alias("orphans"))
    heads = per.select("file").distinct().withColumn("has_heading", F.lit(True))
    joined = files.join(nodes, "node").join(sole, "file").join(heads, "file", "left").join(orphans, "file", "left").join(per.withColumnRenamed("owner", "name"), ["file", "name"], "left")
    takes = (F.col("n") == 1) & F.col("orphans").isNotNull()
    kept = joined.where(F.col("has_heading").isNull() | F.col("own").isNotNull() | takes)
    none = F.array().cast("array<string>")
    columns = F.array_sort(F.array_distinct(F.concat(F.coalesce("own", none), F.when(takes, F.col("orphans")).otherwise(none))))
    return kept.select("file", "node", columns.alias("columns"))


def net_delta(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """(key, added, removed): sorted sets of column values that one side has and the other lacks; rows without any
    difference are left out."""
    old = before.groupBy(key).agg(F.collect_set(column).alias("old"))
    new = after.groupBy(key).agg(F.collect_set(column).alias("new"))
    none = F.array().cast(old.schema["old"].dataType)
    both = old.join(new, key, "full").select(key, F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
    made = both.select(key, F.array_sort(F.array_except("new", "old")).alias("added"), F.array_sort(F.array_except("old", "new")).alias("removed"))
    return made.where((F.size("added") > 0) | (F.size("removed") > 0))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, deleted or modified, of two versions of a keyed table with the same columns. Keys must be
    unique in each."""
    payload = [c for c in before.columns if c != key]

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(f"{name}_key"), F.struct(*payload).alias(name))

    both = hashed(before, "old").join(hashed(after, "new"), F.col("old_key") == F.col("new_key"), "full")
    change = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select(F.coalesce("old_key", "new_key").alias(key), change.alias("change")).where("change is not null")


def renames(deleted: DataFrame, added: DataFrame, key: str, payload: str) -> DataFrame:
    """(previous, key): a deleted and an added key with the same payload; among several, the k-th of each in order."""
    nth = Window.partitionBy(payload).orderBy(key)
    a = deleted.select(F.col(key).alias("previous"), payload, F.row_number().over(nth).alias("k"))
    b = added.select(key, payload, F.row_number().over(nth).alias("k"))
    return a.join(b, [payload, "k"]).select("previous", key)


def resolve_paths(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, id, role, rank): nodes whose path or patch path ends with a file's path, or the other way round.

    Either string may be a suffix of the other, character by character. If both hold a slash such paths share their
    last segment, so the join is on that, with the suffix test left over; paths without a slash are matched against the
    distinct segments' ends instead. rank orders definitions before patches, then names. files: (file, path);
    nodes: (id, name, path, patch_path).
    """
    f = files.select("file", normal_path(F.col("path")).alias("path"))
    roles = nodes.select("id", "name", F.explode(F.array(F.struct(F.lit("path").alias("role"), normal_path(F.col("path")).alias("own")), F.struct(F.lit("patch_path").alias("role"), normal_path(F.col("patch_path")).alias("own")))).alias("r"))
    n = roles.select("id", "name", "r.role", "r.own").where("own is not null and own <> ''")
    suffix = F.endswith(F.col("path"), F.col("own")) | F.endswith(F.col("own"), F.col("path"))
    slashed = F.contains(F.col("path"), F.lit("/"))
    other = F.contains(F.col("own"), F.lit("/"))
    by_name = f.where(slashed).withColumn("base", basename(F.col("path"))).join(n.where(other).withColumn("base", basename(F.col("own"))), "base").where(suffix)
    # without a slash on one side that side is a suffix of a last segment, or has one: ends of the segment are the key
    ends = lambda x: F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.substring(x, i, F.lit(1 << 30))))
    bare_f, bare_n = f.where(~slashed & (F.col("path") != "")), n.where(~other)
    nodes_end = n.withColumn("base", ends(basename(F.col("own"))))
    files_end = f.withColumn("base", ends(basename(F.col("path"))))
    short_file = bare_f.withColumn("base", F.col("path")).join(nodes_end, "base")
    short_node = files_end.join(bare_n.withColumn("base", F.col("own")), "base")
    columns = ["file", "id", "name", "role", "own", "path"]
    every = by_name.select(*columns).unionByName(short_file.select(*columns)).unionByName(short_node.select(*columns)).where(suffix).distinct()
    order = Window.partitionBy("file").orderBy(F.col("role") != "path", "name", "id")
    first = Window.partitionBy("file", "id").orderBy(F.col("role") != "path")
    return every.withColumn("k", F.row_number().over(first)).where("k = 1").withColumn("rank", F.row_number().over(order)).select("file", "id", "role", "rank")


def resolve_with_fallback(files: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """resolve_paths() of each file's path, then, for those without a node, of its previous_path; and what is left.

    files: (file, path, previous_path). Returns (file, id, by) and the unresolved (file, path)."""
    direct = resolve_paths(files.select("file", "path"), nodes).select("file", "id", F.lit("path").alias("by"))
    rest = files.join(direct.select("file").distinct(), "file", "left_anti")
    moved = resolve_paths(rest.where("previous_path is not null").select("file", F.col("previous_path").alias("path")), nodes).select("file", "id", F.lit("previous_path").alias("by"))
    found = direct.unionByName(moved)
    return found, files.join(found.select("file").distinct(), "file", "left_anti").select("file", "path")


def first_wins(evidence: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The earliest row for each key."""
    return evidence.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")
