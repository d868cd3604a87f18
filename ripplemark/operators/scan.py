"""Rules over line tables: a registry of column functions, applied in one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.text import ENTRY_NAME, basename, glob_regex, layer

SEVERITY_RANK = {"low": 0, "medium": 1}


@dataclass(frozen=True)
class LineRule:
    """find(text, path): an array of strings, one for each thing found in the line."""

    rule_id: str
    severity: str
    globs: tuple[str, ...]
    find: Callable[[Column, Column], Column]
    category: str = "lint"


#: What a finding belongs to. Lines without a change set are all of one.
KEYS = ("pr", "path")


def keys_of(lines: DataFrame) -> list[str]:
    return [c for c in KEYS if c in lines.columns]


class Registry:
    """Rules with unique ids and a severity of medium at most."""

    def __init__(self, rules: list[LineRule] = ()) -> None:
        self.rules: list[LineRule] = []
        for rule in rules:
            self.add(rule)

    def add(self, rule: LineRule) -> None:
        if any(r.rule_id == rule.rule_id for r in self.rules):
            raise ValueError(f"{rule.rule_id} is registered twice")
        if rule.severity not in SEVERITY_RANK:
            raise ValueError(f"{rule.rule_id}: {rule.severity} is over medium")
        self.rules.append(rule)

    def findings(self, lines: DataFrame) -> DataFrame:
        """(pr, path, line_no, category, rule_id, severity, what) of lines (pr, path, line_no, text), all rules in one pass."""

        def found(rule: LineRule) -> Column:
            fits = F.lit(False)
            for glob in rule.globs:
                fits = fits | F.translate("path", "\\", "/").rlike(glob_regex(glob))
            each = F.transform(rule.find(F.col("text"), F.col("path")), lambda x: F.struct(F.lit(rule.category).alias("category"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), x.alias("what")))
            return F.when(fits, each).otherwise(F.array().cast("array<struct<category:string,rule_id:string,severity:string,what:string>>"))

        every = F.concat(*[found(r) for r in self.rules])
        keys = keys_of(lines)
        return lines.select(*keys, "line_no", F.explode(every).alias("f")).select(*keys, "line_no", "f.*")


def one(value: Column) -> Column:
    """An array of a value, empty for null."""
    return F.array_compact(F.array(value))


SQL, YAML = ("*.sql",), ("*.yml", "*.yaml")
LINT = [
    LineRule("hardcoded-relation", "medium", SQL, lambda text, path: patterns.hardcoded(text)),
    LineRule("null-comparison", "medium", SQL, lambda text, path: one(patterns.null_comparison(text))),
    LineRule("deprecated-tests-key", "low", YAML, lambda text, path: one(F.when(patterns.deprecated_key(text, path), F.lit("tests:")))),
]


def secret_findings(lines: DataFrame) -> DataFrame:
    """(pr, path, kind, preview, line_no): the first line of each kind in a file of a change set."""
    keys = keys_of(lines)
    found = lines.select(*keys, "line_no", patterns.secret(F.col("text"), F.col("path")).alias("s")).where("s is not null")
    return found.groupBy(*keys, F.col("s.kind").alias("kind")).agg(F.min_by("s.preview", "line_no").alias("preview"), F.min("line_no").alias("line_no"))


def lint_findings(lines: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Lint findings, one for each change set, file, rule and thing found (null comparisons and keys: one for each file)."""
    every = (registry or Registry(LINT)).findings(lines)
    thing = F.when(F.col("rule_id") == "hardcoded-relation", F.lower("what")).otherwise("")
    return every.groupBy(*keys_of(lines), "category", "rule_id", "severity", thing.alias("thing")).agg(F.min_by("what", "line_no").alias("what"), F.min("line_no").alias("line_no")).drop("thing")


def cross_layer_findings(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """A finding for each file of a change set and node that it refers to in a higher layer. lines: pr, path, line_no, text;
    nodes: (name, path). Where both have a project, a name means that project's node."""
    keys = keys_of(lines)
    scope = ["project"] if "project" in lines.columns and "project" in nodes.columns else []
    used = lines.where(basename(F.col("path")).endswith(".sql")).select(*keys, *scope, "line_no", layer(F.col("path")).alias("own_layer"), F.explode(patterns.references(F.col("text"))).alias("name"))
    ranked = nodes.select(*scope, "name", layer(F.col("path")).alias("target_layer")).where("target_layer is not null")
    found = used.where("own_layer is not null").join(ranked, [*scope, "name"]).where("target_layer > own_layer")
    first = found.groupBy(*keys, F.col("name").alias("what")).agg(F.min("line_no").alias("line_no"))
    return first.select(*keys, F.lit("lint").alias("category"), F.lit("cross-layer-reference").alias("rule_id"), F.lit("medium").alias("severity"), "what", "line_no")


def missing_entry_findings(lines: DataFrame, documented: DataFrame, files: DataFrame) -> DataFrame:
    """A finding for each added SQL file whose name neither a list entry of its change set nor documented (name) has.
    lines: pr, path, line_no, text; files: (pr, path, change_type), as of changed_files()."""
    name = F.regexp_replace(basename(F.translate("path", "\\", "/")), r"\.sql$", "")
    added = files.where((F.col("change_type") == "added") & F.endswith(F.col("path"), F.lit(".sql"))).select("pr", "path").distinct().withColumn("name", name)
    entry = F.regexp_extract(F.col("text"), ENTRY_NAME, 1)
    here = lines.where(F.col("path").rlike(r"\.ya?ml$")).select("pr", entry.alias("name")).where("name <> ''")
    found = missing_entries(added, here, documented).join(lines.groupBy("pr", "path").agg(F.min("line_no").alias("line_no")), ["pr", "path"], "left")
    return found.select("pr", "path", F.lit("lint").alias("category"), F.lit("missing-schema-entry").alias("rule_id"), F.lit("medium").alias("severity"), F.col("name").alias("what"), "line_no")


def all_findings(lines: DataFrame, scope: str = "models/**", nodes: DataFrame | None = None, documented: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Lint findings of files in scope and secrets of every file, by change set and path; with nodes (name, path) also
    references to higher layers, with files (pr, path, change_type) and documented (name) also added files without an entry."""
    inside = F.translate("path", "\\", "/").rlike(glob_regex(scope))
    keys = keys_of(lines)
    lint = lint_findings(lines.where(inside)).select(*keys, "category", "rule_id", "severity", "what", "line_no")
    secrets = secret_findings(lines).select(*keys, F.lit("secret").alias("category"), F.col("kind").alias("rule_id"), F.lit("medium").alias("severity"), F.col("preview").alias("what"), "line_no")
    if nodes is not None:
        lint = lint.unionByName(cross_layer_findings(lines.where(inside), nodes))
    if files is not None and documented is not None:
        lint = lint.unionByName(missing_entry_findings(lines.where(inside), documented, files.where(inside)))
    return lint.unionByName(secrets)


def by_severity(severity: str = "severity") -> Column:
    """Rank to sort findings by, the worst first."""
    rank = F.lit(-1)
    for name, n in SEVERITY_RANK.items():
        rank = F.when(F.col(severity) == name, F.lit(n)).otherwise(rank)
    return F.desc(F.when(F.col(severity) == "high", F.lit(len(SEVERITY_RANK))).otherwise(rank))


def layer_breaks(references: DataFrame, ranks: DataFrame) -> DataFrame:
    """Distinct (source, target) of references to a higher layer. references: (source, target); ranks: (id, layer)."""
    own = ranks.select(F.col("id").alias("source"), F.col("layer").alias("own_layer"))
    other = ranks.select(F.col("id").alias("target"), F.col("layer").alias("target_layer"))
    return references.join(own, "source").join(other, "target").where("target_layer > own_layer").select("source", "target").distinct()


def missing_entries(added: DataFrame, documented_here: DataFrame, documented: DataFrame) -> DataFrame:
    """Rows of added (pr, name and more) that neither the same change set nor the catalog documents."""
    return added.join(documented_here.select("pr", "name").distinct(), ["pr", "name"], "left_anti").join(documented.select("name").distinct(), "name", "left_anti")
