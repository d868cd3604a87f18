"""What a change reaches: bounded breadth-first search from many roots at once, summaries and severity."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import cut

LOW, MEDIUM, HIGH = 0, 1, 2
SEVERITIES = ("low", "medium", "high")
SHOWN = 25
#: Roots of a block, a bit each; and roots that a task numbers.
BITS, ROOTS = 63, 1_000_000
#: Rows of a task that drops repeated ones.
ROWS = 500_000


@dataclass(frozen=True)
class Reached:
    """What roots reach, by nodes. sets: (block, node, depth, mask), a bit of mask for each root of the block that is depth
    hops from node at least; roots: (root, block, bit)."""

    sets: DataFrame
    roots: DataFrame

    def expanded(self, sets: DataFrame) -> DataFrame:
        """Rows of sets (or of what was joined to them) for each root: root in place of block and mask."""
        r = self.roots.select("root", F.col("block").alias("__block"), "bit")
        held = F.col("mask").bitwiseAND(_bit()) != 0
        return sets.join(r, (F.col("block") == F.col("__block")) & held).select("root", *[c for c in sets.columns if c not in ("block", "mask")])

    def rows(self) -> DataFrame:
        """(root, node, depth)"""
        return self.expanded(self.sets)


def _numbered(roots: DataFrame) -> DataFrame:
    """(root, block, bit) of distinct roots, BITS of them in a block."""
    distinct = cut(roots.select("root").where("root is not null").distinct(), "roots")
    # numbers of a task's rows are consecutive, so few tasks leave few blocks unfilled
    made = distinct.repartition(max(1, -(-distinct.count() // ROOTS))).select("root", F.monotonically_increasing_id().alias("id"))
    return cut(made.select("root", F.floor(F.col("id") / BITS).cast("long").alias("block"), (F.col("id") % BITS).cast("int").alias("bit")), "root-numbers")


def _bit() -> Column:
    """The mask of a root alone, from bit."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))


def _ends(df: DataFrame, column: str) -> tuple:
    """The least and the greatest value of a column."""
    return tuple(df.agg(F.min(column), F.max(column)).first())


def reach_sets(roots: DataFrame, edges: DataFrame, max_depth: int | None = None) -> Reached:
    """Every node downstream of each root (column root), at its smallest number of hops.

    edges: (parent, child). A root isn't part of its own reach, cycles end, repeated roots and edges change nothing.
    Roots go in blocks, and a node has one row for all roots of a block that reach it at a level: an edge is followed once
    for a block, not once for each root. Each level is a join of the last level's rows with the edges between its least and
    greatest node, less what has been seen; levels are written to the shared folder, so plans stay short. Ids should be
    bigints: every level compares them.
    """
    numbered = _numbered(roots)
    level = cut(numbered.select("block", F.col("root").alias("node"), F.lit(0).alias("depth"), _bit().alias("mask")), "reach")
    levels, depth = [level], 0
    while max_depth is None or depth < max_depth:
        least, greatest = _ends(level, "node")
        if least is None:
            break
        depth += 1
        near = edges.where(F.col("parent").between(least, greatest))
        none = F.lit(0).cast("long")
        hop = level.join(near, level["node"] == near["parent"]).select("block", F.col("child").alias("node"), F.col("mask").alias("now"), none.alias("seen"))
        seen = reduce(DataFrame.unionByName, levels).select("block", "node", none.alias("now"), F.col("mask").alias("seen"))
        met = hop.unionByName(seen).groupBy("block", "node").agg(F.bit_or("now").alias("now"), F.bit_or("seen").alias("seen"))
        new = met.select("block", "node", F.lit(depth).alias("depth"), F.col("now").bitwiseAND(F.bitwise_not("seen")).alias("mask"))
        level = cut(new.where("mask <> 0 and node is not null"), "reach")
        levels.append(level)
    return Reached(reduce(DataFrame.unionByName, levels).where("depth > 0"), numbered)


def reach(roots: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) of reach_sets(), a row for each root and node."""
    return reach_sets(roots, edges, max_depth).rows()


def children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, child): one hop from the given nodes. Repeated nodes and edges change nothing.

    Edges are parted before repeated ones are dropped, ROWS of them a task: a task that reads files would hold all that
    differ among its rows, which grow with the files."""
    least, greatest = _ends(nodes, "node")
    near = edges.where(F.col("parent").between(least, greatest))
    own = nodes.select(F.col("node").alias("__node"))
    found = near.join(own, F.col("parent") == F.col("__node"), "left_semi").select(F.col("parent").alias("node"), "child")
    return found.repartition(max(1, -(-near.count() // ROWS)), "node", "child").distinct()


def first_names(reached: DataFrame, n: int = 3) -> DataFrame:
    """(root, names): the first n names in (depth, name) order. The rank limit applies before the shuffle, so no
    root's whole reach is gathered."""
    order = Window.partitionBy("root").orderBy("depth", "name", "node")
    top = reached.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    return top.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ", ").alias("names"))


def _about(reached: DataFrame | Reached, nodes: DataFrame, *columns: str) -> DataFrame:
    """root, node, depth and columns of the node. Nodes are looked up once for all roots of a block."""
    sets = reached.sets if isinstance(reached, Reached) else reached
    known = sets.join(nodes.select("id", *columns), F.col("node") == F.col("id")).drop("id")
    return reached.expanded(known) if isinstance(reached, Reached) else known


def _depths_of_first(by_depth: DataFrame, n: int) -> DataFrame:
    """(root, depth): the depths in which the first n nodes of a root lie. by_depth: (root, depth, size)."""
    before = F.sum("size").over(Window.partitionBy("root").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    return by_depth.select("root", "depth", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < n).select("root", "depth")


def _at(reached: DataFrame | Reached, depths: DataFrame) -> DataFrame:
    """(root, node, depth) of some depths (root, depth) of each root."""
    if not isinstance(reached, Reached):
        return reached.join(depths, ["root", "depth"], "left_semi").select("root", "node", "depth")
    # the mask of what is wanted of a block at a depth
    wanted = depths.join(reached.roots, "root").groupBy("block", "depth").agg(F.bit_or(_bit()).alias("wanted"))
    kept = reached.sets.join(wanted, ["block", "depth"]).select("block", "node", "depth", F.col("mask").bitwiseAND(F.col("wanted")).alias("mask"))
    return reached.expanded(kept.where("mask <> 0"))


def _counts() -> list[Column]:
    return [
        F.count("*").alias("size"),
        F.count_if(F.col("kind") == "exposure").alias("exposures"),
        F.count_if("contracted").alias("contracted"),
        F.count_if(F.col("access") == "public").alias("public"),
    ]


def reach_counts(reached: DataFrame | Reached, nodes: DataFrame) -> DataFrame:
    """For each root: size, exposures, contracted, public. nodes: (id, kind, contracted, access)."""
    return _about(reached, nodes, "kind", "contracted", "access").groupBy("root").agg(*_counts())


def reach_summary(reached: DataFrame | Reached, nodes: DataFrame, n_names: int = 3) -> DataFrame:
    """For each root: size, exposures, contracted, public (counts), owners (distinct, sorted), depths (count by
    depth), names (the first three). nodes: (id, name, kind, contracted, access, owner).

    The reach is aggregated once, by root, depth and owner; the rest rolls that small table up. Names are looked up only for
    the depths that the first n_names lie in.
    """
    sums = ("size", "exposures", "contracted", "public")
    known = _about(reached, nodes, "kind", "contracted", "access", "owner").groupBy("root", "depth", "owner").agg(*_counts())
    by_depth = cut(known.groupBy("root", "depth").agg(*[F.sum(c).alias(c) for c in sums], F.collect_set("owner").alias("owners")), "reach-depths")
    line = F.transform(F.array_sort(F.collect_list(F.struct("depth", "size"))), lambda x: F.concat_ws(":", x["depth"].cast("string"), x["size"].cast("string")))
    rolled = by_depth.groupBy("root").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("owners")))), ", ").alias("owners"),
        F.array_join(line, " ").alias("depths"),
    )
    named = _about(_at(reached, _depths_of_first(by_depth, n_names)), nodes, "name")
    return rolled.join(first_names(named, n_names), "root")


def shown_nodes(reached: DataFrame | Reached, limit: int = SHOWN) -> DataFrame:
    """Of each root the first nodes in (depth, node) order, and how many are hidden. The reach is counted by depth; only
    the depths in which the first nodes lie are put in order."""
    rows = reached.rows() if isinstance(reached, Reached) else reached
    by_depth = cut(rows.groupBy("root", "depth").agg(F.count("*").alias("size")), "shown-depths")
    sizes = by_depth.groupBy("root").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("root").orderBy("depth", "node")
    top = _at(reached, _depths_of_first(by_depth, limit)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit)
    return top.join(sizes, "root").select("root", "node", "depth", F.greatest(F.col("size") - limit, F.lit(0)).alias("hidden"))


def induced_edges(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, parent, child): edges both of whose ends a root shows, itself included. Repeated edges are dropped last, of
    what is left."""
    own = cut(shown.select("root", "node").unionByName(shown.select("root", F.col("root").alias("node")).distinct()), "shown-nodes")
    starts = own.join(edges, own["node"] == edges["parent"]).select("root", "parent", "child")
    ends = own.select(F.col("root").alias("r"), F.col("node").alias("n"))
    return starts.join(ends, (F.col("root") == F.col("r")) & (F.col("child") == F.col("n")), "left_semi").distinct()


def severity(changed: DataFrame) -> DataFrame:
    """Severity of changes joined to their reach: adds severity_rank, severity and reasons.

    changed has is_semantic, change_type, removed, unattributed (counts of columns), materialization, size,
    exposures, contracted, public. Conditions only raise the severity; one without effect on structure still gives
    its reason.
    """
    semantic = F.col("is_semantic")
    structural = (F.col("removed") > 0) | F.col("change_type").isin("deleted", "renamed")
    downstream = F.col("size").cast("string")

    def rule(when: Column, rank: Column | int, reason: Column) -> tuple[Column, Column, Column]:
        return when, F.lit(rank) if isinstance(rank, int) else rank, reason

    rules = [
        rule(F.col("removed") > 0, F.when(F.col("size") > 0, HIGH).otherwise(MEDIUM), F.concat(F.lit("removes "), F.col("removed").cast("string"), F.lit(" columns read by "), downstream)),
        rule(F.col("unattributed") > 0, MEDIUM, F.concat(F.lit("removes "), F.col("unattributed").cast("string"), F.lit(" columns of unknown owner"))),
        rule((F.col("change_type") == "deleted") & (F.col("size") > 0), HIGH, F.concat(F.lit("deletes what "), downstream, F.lit(" depend on"))),
        rule(F.col("contracted") > 0, F.when(structural, HIGH).otherwise(LOW), F.concat(F.lit("reaches "), F.col("contracted").cast("string"), F.lit(" contracted"))),
        rule(F.col("exposures") > 0, F.when(structural, HIGH).otherwise(LOW), F.concat(F.lit("reaches "), F.col("exposures").cast("string"), F.lit(" exposures"))),
        rule((F.col("public") > 0) & (F.col("contracted") == 0), F.when(structural, MEDIUM).otherwise(LOW), F.concat(F.lit("reaches "), F.col("public").cast("string"), F.lit(" public"))),
        rule(F.col("materialization") == "incremental", MEDIUM, F.lit("is incremental")),
    ]
    rank = F.greatest(F.lit(LOW), *[F.when(when, r).otherwise(LOW) for when, r, _ in rules])
    given = F.array_compact(F.array(*[F.when(when, reason) for when, _, reason in rules]))
    reasons = F.when(F.size(given) > 0, given).otherwise(F.array(F.concat(F.lit("logic change with "), downstream, F.lit(" downstream"))))
    ranked = changed.withColumn("severity_rank", F.when(semantic, rank).otherwise(LOW).cast("int"))
    ranked = ranked.withColumn("reasons", F.when(semantic, reasons).otherwise(F.array(F.lit("no semantic change"))))
    return ranked.withColumn("severity", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("severity_rank") + 1))


def gate(assessed: DataFrame, secrets: DataFrame, fail_on: int = HIGH) -> DataFrame:
    """For each pr_id of assessed: worst, nodes, secrets, failed, nothing_to_report, status.

    A change set fails if its worst severity reaches fail_on or it exposes a secret, whatever the threshold.
    assessed: (pr_id, severity_rank, node or null if unresolved); secrets: (pr_id) per finding.
    """
    by_pr = assessed.groupBy("pr_id").agg(F.max("severity_rank").alias("worst"), F.count("node").alias("nodes"), F.count_if(F.col("node").isNull()).alias("unresolved"), F.count_if(F.col("severity_rank") == HIGH).alias("high"))
    found = secrets.groupBy("pr_id").agg(F.count("*").alias("secrets"))
    all_of = by_pr.join(found, "pr_id", "left").withColumn("secrets", F.coalesce("secrets", F.lit(0)).cast("long"))
    text = (
        F.when(F.col("secrets") > 0, F.concat(F.col("secrets").cast("string"), F.lit(" exposed secrets")))
        .when(F.col("high") > 0, F.concat(F.col("high").cast("string"), F.lit(" high severity changes")))
        .when(F.col("nodes") == 0, F.lit("no known node changes"))
        .otherwise(F.concat(F.col("nodes").cast("string"), F.lit(" nodes change")))
    )
    return all_of.select(
        "pr_id", "worst", "nodes", "secrets",
        ((F.col("worst") >= fail_on) | (F.col("secrets") > 0)).alias("failed"),
        ((F.col("nodes") == 0) & (F.col("unresolved") == 0) & (F.col("secrets") == 0)).alias("nothing_to_report"),
        F.substring(text, 1, 140).alias("status"),
    )
