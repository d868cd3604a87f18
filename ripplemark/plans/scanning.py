"""Queries on change lines, findings, and changed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.text import ALIAS, ENTRY_NAME, LIST_NAME, STOPWORDS, TEMPLATE, TOKEN, aliases, has_extension, line_class, normal_path, tokens
from ..operators import blocks, changes, reports, scan
from ..shared import scratch
from ..sources import diffs as diff_files
from ..streaming import events
from .tables import EDGES, LINES, Tables, edges, label, label_sql, lines

# Lines that hold what documents don't: made from a digest of each document's text, chosen by its id.
PLANTED = [
    "'key = AKIA' || upper(substr(m, 1, 16))",
    "'token: ghp_' || m || '0000'",
    "'xoxb-' || m",
    "'sk_live_' || m",
    "'sk-ant-' || m",
    "'sk-proj-' || m",
    "'AIza' || m || 'abc'",
    "'-----BEGIN RSA PRIVATE KEY-----'",
    "'url: postgres://user:' || substr(m, 1, 8) || '@host/db'",
    "'url: postgres://user:$' || '{PGPASSWORD}@host/db'",
    "'db_password: \"' || substr(m, 1, 8) || '\"'",
    "'password_path: /run/' || m",
    "'password = os.environ[KEY]'",
    "'select * from ' || lang || '.orders o join {{ ref(x) }} y'",
    "'where a != null and b >= 1'",
    "'  tests:'",
    "'  amount as Total_' || lang || ','",
    "'update t set a = null'",
    "'where x = null -- or y <> null'",
    "'join {{ ref(\"d' || (doc_id + 2) || '\", v=1) }} on a = b'",
    "'  - name: d' || (doc_id + 3)",
]
BLOCKS = ["'columns:'", "'tests:'", "'data_type: int'", "'note: x'", "''"] + ["'- name: N' || (line_no % 7)"] * 4
PATHS = [
    "'models/staging/' || lang || '/d' || doc_id || '.sql'",
    "'models/marts/' || lang || '/d' || doc_id || '.yml'",
    "'models\\intermediate\\' || lang || '\\d' || doc_id || '.sql'",
    "lang || '/d' || doc_id || '.env'",
    "'models/marts/' || lang || '/d' || doc_id || '.sql'",
]


def _case(of: str, options: list[str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options)) + " END"


_PATH = _case("doc_id % 5", PATHS)


def code(t: Tables) -> DataFrame:
    """(pr, path, line_no, text): the lines of documents, and a planted one before the first of each; a change set is a language."""
    docs = t.documents.selectExpr("doc_id", "lang", "lang as pr", "text", "md5(cast(text as binary)) as m")
    path = F.expr(_PATH.replace("\\", "\\\\")).alias("path")
    own = docs.select("pr", path, F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    planted = docs.select("pr", path, F.lit(-1).alias("line_no"), F.expr(_case(f"(doc_id div 5) % {len(PLANTED)}", PLANTED)).alias("text"))
    return own.unionByName(planted)


CODE = f"""docs AS (SELECT doc_id, lang, text, md5(text) AS m FROM documents),
code AS (SELECT lang AS pr, {_PATH} AS path, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS text FROM docs
         UNION ALL SELECT lang, {_PATH}, -1, {_case(f"(doc_id // 5) % {len(PLANTED)}", PLANTED)} FROM docs)"""


def files(t: Tables) -> DataFrame:
    """(pr, path, change_type): the files of code(), read from a diff of each change set, in which every third one is new."""
    docs = t.documents.selectExpr("doc_id", "lang", "lang as pr", "text").withColumn("path", F.expr(_PATH.replace("\\", "\\\\")))
    head = F.array_compact(F.array(F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path"), F.when(F.col("doc_id") % 3 == 0, F.lit("new file mode 100644")), F.lit("@@ -1 +1 @@")))
    body = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("+"), x))
    found = docs.select("pr", "doc_id", F.posexplode(F.concat(head, body)).alias("at", "text"))
    told = changes.file_lines(found.withColumn("line_no", F.col("doc_id") * 2**24 + F.col("at")))
    return changes.changed_files(changes.segment(told)).select("pr", "path", "change_type")


def diffs(t: Tables) -> DataFrame:
    """(pr, line_no, text): each document as a diff; every ninth line opens a file and the next a hunk."""
    at = F.col("line_no") % 9
    text = (
        F.when(at == 0, F.concat(F.lit("diff --git a/f"), "line_no", F.lit(" b/f"), "line_no", F.when(F.col("line_no") % 2 == 0, ".sql").otherwise(".yml")))
        .when((at == 1) & (F.col("file") % 4 == 0), F.lit("new file mode 100644"))
        .when((at == 1) & (F.col("file") % 4 == 1), F.concat(F.lit("rename from old/f"), "line_no"))
        .when(at == 2, F.lit("@@ -1,3 +1,3 @@"))
        .when(at == 3, F.lit("+-- a comment"))
        .when(F.col("line_no") % 2 == 0, F.concat(F.lit("+"), "text"))
        .otherwise(F.concat(F.lit("-"), "text"))
    )
    return lines(t).select(F.col("file").alias("pr"), "line_no", text.alias("text"))


DIFFS = LINES + """,
diffs AS (SELECT file AS pr, line_no, CASE
  WHEN line_no % 9 = 0 THEN concat('diff --git a/f', line_no, ' b/f', line_no, CASE WHEN line_no % 2 = 0 THEN '.sql' ELSE '.yml' END)
  WHEN line_no % 9 = 1 AND file % 4 = 0 THEN 'new file mode 100644' WHEN line_no % 9 = 1 AND file % 4 = 1 THEN concat('rename from old/f', line_no)
  WHEN line_no % 9 = 2 THEN '@@ -1,3 +1,3 @@' WHEN line_no % 9 = 3 THEN '+-- a comment'
  WHEN line_no % 2 = 0 THEN concat('+', text) ELSE concat('-', text) END AS text FROM lines),
classed AS (SELECT *, CASE WHEN regexp_matches(text, '^diff --git a/.+ b/.+$') THEN 'header' WHEN starts_with(text, 'new file mode') THEN 'new' WHEN starts_with(text, 'deleted file mode') THEN 'deleted'
  WHEN starts_with(text, 'rename from ') THEN 'renamed' WHEN starts_with(text, '@@ ') THEN 'hunk' WHEN starts_with(text, '+++') OR starts_with(text, '---') THEN 'mark'
  WHEN starts_with(text, '+') THEN 'added' WHEN starts_with(text, '-') THEN 'removed' ELSE 'context' END AS class FROM diffs),
filed AS (SELECT *, CAST(sum(CAST(class = 'header' AS INTEGER)) OVER (PARTITION BY pr ORDER BY line_no) AS BIGINT) AS file_no FROM classed),
seg AS (SELECT *, CAST(sum(CAST(class = 'hunk' AS INTEGER)) OVER (PARTITION BY pr, file_no ORDER BY line_no) AS BIGINT) AS hunk_no FROM filed),
bodies AS (SELECT *, class IN ('added', 'removed') AS changed, trim(substr(text, 2), chr(32) || chr(9) || chr(10) || chr(13)) AS bare FROM seg),
files AS (SELECT pr, file_no, max(CASE WHEN class = 'header' THEN regexp_extract(text, '^diff --git a/(.+?) b/(.+?)$', 2) END) AS path,
  max(CASE WHEN class = 'renamed' THEN substr(text, 13) END) AS previous_path,
  CASE WHEN bool_or(class = 'renamed') THEN 'renamed' WHEN bool_or(class = 'deleted') THEN 'deleted' WHEN bool_or(class = 'new') THEN 'added' ELSE 'modified' END AS change_type,
  count(*) FILTER (class = 'added') AS n_added, count(*) FILTER (class = 'removed') AS n_removed,
  bool_or(changed AND bare <> '' AND NOT starts_with(bare, '--') AND NOT starts_with(bare, '#') AND NOT starts_with(bare, '{#')) AS sql_semantic,
  bool_or(changed AND bare <> '' AND NOT starts_with(bare, '#')) AS yaml_semantic
  FROM bodies WHERE file_no > 0 GROUP BY ALL)
"""


def diff_lines(t: Tables) -> DataFrame:
    files = changes.changed_files(changes.segment(diffs(t)))
    return files.where(has_extension(F.col("path"))).select("pr", "file_no", "path", "previous_path", "change_type", "n_added", "n_removed")


def shown_lines(t: Tables) -> DataFrame:
    """What a report shows of each file, of diffs written as whole texts and read again."""
    whole = diffs(t).groupBy("pr", F.floor(F.col("line_no") / 900).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("diff"))
    read = diff_files.lines(whole.withColumn("pr", F.concat_ws("/", "pr", "part")))
    return changes.changed_lines(changes.segment(read), most=3).select("pr", "file_no", "line_no", "nth")


def line_classes(t: Tables) -> DataFrame:
    return diffs(t).groupBy("pr", line_class(F.col("text")).alias("class")).agg(F.count("*").alias("n"))


def segment_lines(t: Tables) -> DataFrame:
    return changes.segment(diffs(t)).select("pr", "line_no", "class", "file_no", "hunk_no")


def scanned_lines(t: Tables) -> DataFrame:
    """Diffs of sources, written as text files (a source's in as many as its lines take) and read in splits."""
    at = scratch(t.spark, "diff-files")
    write_sources(t.documents, at)
    read = diff_files.read_lines(t.spark, at, F.col("pr"), line_sep="\n")
    return read.select(F.substring("pr", 3, 1 << 30).alias("pr"), "line_no", F.md5(F.col("text").cast("binary")).alias("digest"))


def write_sources(docs: DataFrame, at: str) -> None:
    """Lines of docs as text files of a folder for each source, in the order of doc_id (null last) and line. Folders are
    named s- and the source; n- is that of none. Rows are sorted by the very column that the writer parts them by: where
    it has to sort them itself, it keeps no other order."""
    folder = F.coalesce(F.concat(F.lit("s-"), "source"), F.lit("n-")).alias("pr")
    rows = docs.select(folder, "doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    order = [F.col("pr"), F.col("doc_id").asc_nulls_last(), F.col("nth")]
    made = rows.select("pr", "doc_id", "nth", F.concat(F.lit("+"), "line").alias("value")).repartitionByRange(*order).sortWithinPartitions(*order)
    made.select("pr", "value").write.partitionBy("pr").option("lineSep", "\n").text(at)


def nested_block_scan(t: Tables) -> DataFrame:
    """Lines of documents, as many as make a hunk of 30, stand for entries of blocks by their lengths."""
    rows = lines(t).select("file", F.floor(F.col("line_no") / 30).alias("hunk"), "line_no", F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.length("text") % 3 + 1).cast("int")).alias("op"), F.expr(_case("(length(text) div 3) % 9", BLOCKS)).alias("body"), (F.length("text") % 4 * 2).cast("int").alias("depth"))
    return blocks.nested_columns(rows.withColumn("text", F.concat(F.repeat(F.lit(" "), F.col("depth")), "body")), ["file", "hunk"])


def semantic_flag(t: Tables) -> DataFrame:
    return changes.changed_files(changes.segment(diffs(t))).select("pr", "file_no", "is_semantic")


def _turns(t: Tables) -> DataFrame:
    heading = F.when(F.col("role") == "system", F.concat(F.lit("m"), F.col("turn").cast("string")))
    return changes.attribute(t.conversations, heading, ["conv_id"], "turn").where("role <> 'system'")


def heading_attribution(t: Tables) -> DataFrame:
    return _turns(t).select("conv_id", "turn", "owner", F.col("owner").isNull().alias("orphan"))


def owner_attribution(t: Tables) -> DataFrame:
    """Files are conversations; candidate nodes are their users' turns' numbers, and the first turn of all."""
    named = _turns(t).where("role = 'assistant'").select(F.col("conv_id").alias("file"), "owner", F.concat(F.lit("c"), F.col("turn") % 5).alias("column"))
    candidates = t.conversations.where("role <> 'assistant'").select(F.col("conv_id").alias("file"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("node")).distinct()
    nodes = candidates.select("node", F.col("node").alias("name")).distinct()
    return changes.owners(candidates, nodes, named).select("file", "node", F.array_join("columns", ",").alias("columns"))


def first_wins(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("node"), F.col("event_id").alias("file_no"), "event_type")
    return changes.first_wins(rows, "node", ["file_no"])


def _parts(t: Tables, flags: tuple[str, str]) -> DataFrame:
    return t.lineitem.where(F.col("l_returnflag").isin(*flags)).select("l_orderkey", "l_partkey").distinct()


def net_column_delta(t: Tables) -> DataFrame:
    found = changes.net_delta(_parts(t, ("A", "N")), _parts(t, ("N", "R")), "l_orderkey", "l_partkey")
    return found.select("l_orderkey", F.concat_ws(",", F.transform("added", lambda x: x.cast("string"))).alias("added"), F.concat_ws(",", F.transform("removed", lambda x: x.cast("string"))).alias("removed"))


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers before and after: every 7th goes and comes back as a later key, every 5th changes segment, every 11th is new."""
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    before = c.where("c_custkey % 11 <> 0")
    kept = c.where("c_custkey % 7 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    moved = before.where("c_custkey % 7 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return before, kept.unionByName(moved)


def snapshot_diff(t: Tables) -> DataFrame:
    return changes.snapshot_diff(*_snapshots(t), "c_custkey")


def rename_detection(t: Tables) -> DataFrame:
    before, after = _snapshots(t)
    gone, new = before.join(after, "c_custkey", "left_anti"), after.join(before, "c_custkey", "left_anti")
    return changes.renames(gone, new, "c_custkey", "c_name").select(F.col("previous"), F.col("c_custkey").alias("current"))


_SNAPSHOTS = """before AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0),
after AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0
          UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_mktsegment FROM before WHERE c_custkey % 7 = 0)"""


def alias_extract(t: Tables) -> DataFrame:
    found = code(t).select("path", "line_no", F.explode(aliases(F.col("text"))).alias("alias"))
    return found.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))


def path_normalise(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", normal_path(F.expr(_PATH.replace("\\", "\\\\"))).alias("path"))


_NORMAL = "regexp_replace(list_last(string_split(translate({0}, '\\', '/'), '://')), '^[./]+', '')"


def _page_files(t: Tables) -> DataFrame:
    at = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    odd = F.col("page_id") % 3 == 0
    # every third file has moved: its path is new and its previous path is the old one; every tenth has no folder
    path = F.when(odd, F.concat(F.lit("new/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 10 == 1, F.substring_index(at, "/", -1)).otherwise(at)
    return t.pages.select(F.col("page_id").alias("file"), path.alias("path"), F.when(odd, at).alias("previous_path"))


def _doc_nodes(t: Tables) -> DataFrame:
    path = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    return t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), path.alias("path"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("docs://x/"), path)).alias("patch_path"))


def path_suffix_join(t: Tables) -> DataFrame:
    return changes.resolve_paths(_page_files(t).select("file", "path"), _doc_nodes(t)).select("file", "id", "role", "rank")


def rename_fallback_join(t: Tables) -> DataFrame:
    return changes.resolve_with_fallback(_page_files(t), _doc_nodes(t))[0]


def unresolved_anti(t: Tables) -> DataFrame:
    return changes.resolve_with_fallback(_page_files(t), _doc_nodes(t))[1]


_FILES = f"""pf AS (SELECT page_id AS file, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS p, page_id % 3 = 0 AS odd FROM pages),
files AS (SELECT file, CASE WHEN odd THEN concat('new/', file) WHEN file % 10 = 1 THEN list_last(string_split(p, '/')) ELSE p END AS path, CASE WHEN odd THEN p END AS previous_path FROM pf),
dn AS (SELECT doc_id AS id, concat('d', doc_id) AS name, concat(lang, '/', doc_id) AS path FROM documents),
roles AS (SELECT id, name, 'path' AS role, {_NORMAL.format('path')} AS own FROM dn UNION ALL SELECT id, name, 'patch_path', {_NORMAL.format("concat('docs://x/', path)")} FROM dn WHERE id % 4 = 0),
hits AS (SELECT file, id, name, role, w.which FROM (SELECT file, 'path' AS which, {_NORMAL.format('path')} AS f FROM files UNION ALL SELECT file, 'previous_path', {_NORMAL.format('previous_path')} FROM files WHERE previous_path IS NOT NULL) w
         JOIN roles ON own <> '' AND f <> '' AND (ends_with(f, own) OR ends_with(own, f))),
one AS (SELECT *, row_number() OVER (PARTITION BY which, file, id ORDER BY role <> 'path') AS k FROM hits),
direct AS (SELECT file, id, role, row_number() OVER (PARTITION BY file ORDER BY role <> 'path', name, id) AS rank FROM one WHERE k = 1 AND which = 'path'),
found AS (SELECT file, id, 'path' AS by FROM direct UNION ALL SELECT file, id, 'previous_path' FROM one WHERE k = 1 AND which = 'previous_path' AND file NOT IN (SELECT file FROM direct))"""


def findings_with_owner(t: Tables) -> DataFrame:
    """Secrets with the document at their path, if it has a label (so, in the graph)."""
    nodes = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select(F.expr(_PATH.replace("\\", "\\\\")).alias("path"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node"))
    return scan.secret_findings(code(t)).join(nodes, "path", "left").select("path", "kind", "node")


def secret_formats(t: Tables) -> DataFrame:
    return code(t).select("path", "line_no", patterns.provider(F.col("text")).alias("kind")).where("kind is not null")


def secret_urls(t: Tables) -> DataFrame:
    url = patterns.url_password(F.col("text"))
    return code(t).where((url != "") & patterns.literal(url, F.lit(True)).isNotNull()).select("path", "line_no")


def secret_assignments(t: Tables) -> DataFrame:
    value = patterns.assigned_literal(F.col("text"), F.col("path"))
    return code(t).where(value.isNotNull()).select("path", "line_no", patterns.assigned_key(F.col("text")).alias("key"))


def secret_findings(t: Tables) -> DataFrame:
    return scan.secret_findings(code(t))


BATCHES = 3


def incremental_findings(t: Tables) -> DataFrame:
    """The same from a stream: lines arrive in BATCHES batches of files, as many as their bytes take, and the first finding of
    a kind is kept."""
    at = scratch(t.spark, "arriving")
    code(t).repartitionByRange("line_no", "pr", "path").write.parquet(f"{at}/lines")
    written = t.spark.read.parquet(f"{at}/lines")
    stream = t.spark.readStream.schema(written.schema).option("maxFilesPerTrigger", max(1, -(-len(written.inputFiles()) // BATCHES))).parquet(f"{at}/lines")
    events.maintain_findings(stream, f"{at}/kept", f"{at}/checkpoint", buckets=8).awaitTermination()
    return events.live_state(t.spark, f"{at}/kept").select("pr", "path", "kind", "preview", "line_no")


def hardcoded_relations(t: Tables) -> DataFrame:
    return _lint(t, "hardcoded-relation")


def null_comparisons(t: Tables) -> DataFrame:
    return _lint(t, "null-comparison").withColumn("fix", patterns.null_fix(F.col("what")))


def deprecated_keys(t: Tables) -> DataFrame:
    return _lint(t, "deprecated-tests-key")


def _lint(t: Tables, rule: str) -> DataFrame:
    found = scan.Registry([r for r in scan.LINT if r.rule_id == rule])
    return scan.lint_findings(code(t), found).select("path", "what", "line_no")


def all_findings(t: Tables) -> DataFrame:
    return _findings(t).orderBy(scan.by_severity(), "path", "rule_id")


def _findings(t: Tables) -> DataFrame:
    """All checks; documents are the nodes, those with a label are documented."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name")
    return scan.all_findings(code(t), nodes=t.documents.select(name, F.expr(_PATH.replace("\\", "\\\\")).alias("path")), documented=t.labels.select(name).distinct(), files=files(t))


def line_references(t: Tables) -> DataFrame:
    """References to higher layers, read from lines."""
    return _findings(t).where("rule_id = 'cross-layer-reference'").select("path", "what", "line_no")


def missing_entry_lines(t: Tables) -> DataFrame:
    """Added SQL files without an entry, read from lines."""
    return _findings(t).where("rule_id = 'missing-schema-entry'").select("pr", "path", "what", "line_no")


def cross_layer_refs(t: Tables) -> DataFrame:
    """Edges both ways as references; layer = kind's rank."""
    e = edges(t)
    both = e.select(F.col("child").alias("source"), F.col("parent").alias("target")).unionByName(e.where(f"parent >= {4 * 10**9}").select(F.col("parent").alias("source"), F.col("child").alias("target")))
    ids = both.select(F.col("source").alias("id")).union(both.select("target")).distinct()
    return scan.layer_breaks(both, ids.withColumn("layer", F.floor(F.col("id") / 10**9))).select(label("source").alias("source"), label("target").alias("target"))


def missing_entry_anti(t: Tables) -> DataFrame:
    added = t.documents.select(F.col("source").alias("pr"), F.col("doc_id").alias("name"))
    here = t.documents.where("doc_id % 13 = 0").select(F.col("source").alias("pr"), F.col("doc_id").alias("name"))
    return scan.missing_entries(added, here, t.labels.select(F.col("doc_id").alias("name"))).select("pr", "name")


def report_rows(t: Tables) -> DataFrame:
    """For each change set its worst findings as lines, flattened and cut, how many more there are, and a preview of rules."""
    line = F.concat_ws(" ", "rule_id", F.lit("in"), "path", F.lit("on   line"), "line_no")
    return reports.report(_findings(t), line, [scan.by_severity(), F.col("path"), F.col("rule_id"), F.col("line_no"), F.col("what")])


def change_summary(t: Tables) -> DataFrame:
    """Query text of each change: orders are changes, their parts columns and their line items changed lines, those that
    were returned removed and the others added; empty if nothing semantic changed."""
    key = F.col("l_orderkey").alias("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("added", "modified", "deleted", "renamed"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    made = t.orders.select("o_orderkey", kind.alias("change_type"), F.when(F.col("o_orderpriority").startswith("1-"), "exposure").otherwise("model").alias("kind"), (F.col("o_orderkey") % 5 != 0).alias("is_semantic"))
    items = t.lineitem.select(key, F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("op"), F.col("l_linenumber").alias("line_no"), F.concat(F.lit("c"), "l_partkey").alias("column"))
    columns = reports.column_changes(items.where("op = '-'"), items.where("op = '+'"), "o_orderkey", "column")
    lines = items.withColumn("text", F.concat_ws(" ", F.lit("select"), "column", F.lit("from line"), "line_no"))
    found = reports.summaries(made, columns, lines, "o_orderkey")
    return found.select("o_orderkey", F.sha2("summary", 256).alias("summary_sha256"), F.length("summary").cast("long").alias("n_chars"))


def tokens_query(t: Tables) -> DataFrame:
    """Tokens of benchmark items with an underscore between their first words."""
    text = F.regexp_replace(F.col("text"), r"^(\w+) (\w+)", "$1_$2")
    found = t.benchmark.select("item_id", F.explode(tokens(text)).alias("token"))
    return found.groupBy("item_id", "token").agg(F.count("*").alias("n"))


def _q(x: str) -> str:
    return x.replace("'", "''")


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
TOKENS_SQL = f"list_concat(list_filter(regexp_extract_all(lower({{0}}), '{TOKEN}'), lambda x: NOT list_contains({_STOP}, x)), list_filter(flatten(list_transform(list_filter(regexp_extract_all(lower({{0}}), '{TOKEN}'), lambda x: NOT list_contains({_STOP}, x) AND contains(x, '_')), lambda x: string_split(x, '_'))), lambda x: x <> '' AND NOT list_contains({_STOP}, x)))"
_PROVIDER = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in patterns.FORMATS) + " END"
_PREVIEW = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN concat(substr(regexp_extract(text, '{p}'), 1, 4), '…****')" for _, p in patterns.FORMATS) + " ELSE '****' END"
_CONFIG = "(" + " OR ".join(f"ends_with(lower(path), '{s}')" for s in patterns.CONFIG_SUFFIXES) + " OR starts_with(list_last(string_split(lower(translate(path, '\\', '/')), '/')), '.env'))"


def _literal_sql(raw: str, config: str) -> str:
    bare = f"regexp_replace(trim(regexp_replace({raw}, '{TEMPLATE}', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13)), '[,;]+$', '')"
    value = f"CASE WHEN {bare} LIKE '''%' THEN regexp_extract({bare}, '^''([^'']*)', 1) WHEN {bare} LIKE '\"%' THEN regexp_extract({bare}, '^\"([^\"]*)', 1) WHEN {config} THEN trim(string_split({bare}, ' #')[1]) END"
    return f"(SELECT CASE WHEN v <> '' AND NOT contains(v, '${{') AND NOT starts_with(v, '$') AND NOT regexp_matches(v, '{_q(patterns.PLACEHOLDER)}') THEN v END FROM (SELECT {value} AS v))"


_URL = f"regexp_extract(text, '{_q(patterns.URL_CREDENTIALS)}', 1)"
_KEY, _VALUE = (f"regexp_extract(text, '{_q(patterns.ASSIGNMENT)}', {i})" for i in (1, 2))
_SECRETS = f"""{CODE},
parsed AS (SELECT *, {_PROVIDER} AS provider, {_URL} AS url, {_KEY} AS key, {_VALUE} AS value, {_CONFIG} AS config FROM code),
told AS (SELECT *, provider IS NULL AND url <> '' AND {_literal_sql('url', 'true')} IS NOT NULL AS by_url, key <> '' AND NOT regexp_matches(key, '{patterns.DESCRIPTIVE_KEY}') AND {_literal_sql('value', 'config')} IS NOT NULL AS by_key FROM parsed),
secrets AS (SELECT pr, path, line_no, coalesce(provider, CASE WHEN by_url THEN '{patterns.URL_KIND}' WHEN by_key THEN concat('literal value for `', key, '`') END) AS kind, {_PREVIEW} AS preview FROM told),
secret_rows AS (SELECT pr, path, kind, arg_min(preview, line_no) AS preview, CAST(min(line_no) AS INTEGER) AS line_no FROM secrets WHERE kind IS NOT NULL GROUP BY pr, path, kind)
"""
_BLANK = f"regexp_replace(text, '{TEMPLATE}', ' ', 'g')"
_CODE_PART = f"regexp_replace(string_split(text, '--')[1], '{TEMPLATE}', ' ', 'g')"
_LINT = f""",
sqlf AS (SELECT * FROM code WHERE ends_with(path, '.sql') AND NOT starts_with(ltrim(text), '--')),
hc AS (SELECT pr, path, 'lint' AS category, 'hardcoded-relation' AS rule_id, 'medium' AS severity, arg_min(w, line_no) AS what, CAST(min(line_no) AS INTEGER) AS line_no
       FROM (SELECT pr, path, line_no, unnest(regexp_extract_all({_BLANK}, '{patterns.HARDCODED}', 1)) AS w FROM sqlf) GROUP BY pr, path, lower(w)),
nc AS (SELECT pr, path, 'lint' AS category, 'null-comparison' AS rule_id, 'medium' AS severity, arg_min(CASE WHEN op IN ('!=', '<>') THEN op ELSE '=' END, line_no) AS what, CAST(min(line_no) AS INTEGER) AS line_no
       FROM (SELECT pr, path, line_no, c, regexp_extract(c, '{patterns.NULL_COMPARISON}', 1) AS op, regexp_extract(c, '{patterns.NULL_COMPARISON}') AS hit FROM (SELECT *, {_CODE_PART} AS c FROM sqlf))
       WHERE op <> '' AND NOT regexp_matches(string_split(c, hit)[1], '(?i)\\bset\\b') GROUP BY pr, path),
dk AS (SELECT pr, path, 'lint' AS category, 'deprecated-tests-key' AS rule_id, 'low' AS severity, 'tests:' AS what, CAST(min(line_no) AS INTEGER) AS line_no FROM code
       WHERE regexp_matches(path, '\\.ya?ml$') AND regexp_matches(text, '^\\s*tests:\\s*$') GROUP BY pr, path),
layers AS (SELECT path, translate(path, '\\', '/') AS p, CASE WHEN contains(p, 'models/staging/') THEN 0 WHEN contains(p, 'models/intermediate/') THEN 1 WHEN contains(p, 'models/marts/') THEN 2 END AS layer, concat('d', doc_id) AS name FROM (SELECT doc_id, {_PATH} AS path FROM docs)),
used AS (SELECT pr, path, line_no, unnest(regexp_extract_all(text, '{_q(patterns.REFERENCE)}', 1)) AS name FROM sqlf),
cl AS (SELECT u.pr, u.path, 'lint' AS category, 'cross-layer-reference' AS rule_id, 'medium' AS severity, u.name AS what, CAST(min(line_no) AS INTEGER) AS line_no
       FROM used u JOIN (SELECT DISTINCT path, layer FROM layers) o ON o.path = u.path JOIN layers x ON x.name = u.name WHERE x.layer > o.layer GROUP BY u.pr, u.path, u.name),
added AS (SELECT pr, path, regexp_replace(list_last(string_split(translate(path, '\\', '/'), '/')), '\\.sql$', '') AS name, CAST(min(line_no) AS INTEGER) AS line_no FROM code WHERE ends_with(path, '.sql') AND starts_with(translate(path, '\\', '/'), 'models/')
          AND path IN (SELECT {_PATH} FROM docs WHERE doc_id % 3 = 0) GROUP BY ALL),
here AS (SELECT DISTINCT pr, regexp_extract(text, '{_q(ENTRY_NAME)}', 1) AS name FROM code WHERE regexp_matches(path, '\\.ya?ml$') AND starts_with(translate(path, '\\', '/'), 'models/')),
me AS (SELECT pr, path, 'lint' AS category, 'missing-schema-entry' AS rule_id, 'medium' AS severity, name AS what, line_no FROM added a
       WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h.pr = a.pr AND h.name = a.name) AND name NOT IN (SELECT concat('d', doc_id) FROM labels)),
lint AS (SELECT * FROM hc UNION ALL SELECT * FROM nc UNION ALL SELECT * FROM dk UNION ALL SELECT * FROM cl UNION ALL SELECT * FROM me),
findings AS (SELECT * FROM lint WHERE starts_with(translate(path, '\\', '/'), 'models/') UNION ALL SELECT pr, path, 'secret', kind, 'medium', preview, line_no FROM secret_rows)
"""

QUERIES = {f.__name__: f for f in (
    diff_lines, shown_lines, scanned_lines, nested_block_scan, incremental_findings, line_classes, segment_lines, semantic_flag, heading_attribution, owner_attribution, first_wins, net_column_delta, snapshot_diff, rename_detection, alias_extract, path_normalise,
    path_suffix_join, rename_fallback_join, unresolved_anti, findings_with_owner, secret_formats, secret_urls, secret_assignments, secret_findings, hardcoded_relations, null_comparisons,
    deprecated_keys, all_findings, line_references, missing_entry_lines, cross_layer_refs, missing_entry_anti, report_rows, change_summary,
)} | {"tokens": tokens_query}

# RE2's word boundary knows ASCII only
_ALIAS_SQL = ALIAS.replace(r"\bas", r"(?:^|[^\pL\pN_])as")
_TURNS = """turns AS (SELECT *, last_value(CASE WHEN role = 'system' THEN concat('m', turn) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS owner FROM conversations),
members AS (SELECT * FROM turns WHERE role <> 'system')"""
# the fold as a recursive query: a step reads the next entry of every hunk; none is -2, no heading -1
_NESTED = f"""WITH RECURSIVE {LINES},
raw AS (SELECT file, line_no // 30 AS hunk, line_no, ['+', '-', ' '][length(text) % 3 + 1] AS op, concat(repeat(' ', CAST(length(text) % 4 * 2 AS BIGINT)), {_case("(length(text) // 3) % 9", BLOCKS)}) AS text FROM lines),
entry AS MATERIALIZED (SELECT file, hunk, op, row_number() OVER (PARTITION BY file, hunk ORDER BY line_no) AS nth, CAST(length(text) - length(ltrim(text)) AS BIGINT) AS depth, regexp_extract(text, '{_q(LIST_NAME)}', 1) AS name,
  CASE WHEN starts_with(ltrim(text), 'tests:') THEN 'tests' WHEN starts_with(ltrim(text), 'columns:') THEN 'columns' WHEN starts_with(ltrim(text), 'data_type:') THEN 'key' WHEN name <> '' THEN 'item' ELSE 'other' END AS kind FROM raw WHERE ltrim(text) <> ''),
step AS (
  SELECT DISTINCT file, hunk, 0::BIGINT AS nth, -2::BIGINT AS t, -2::BIGINT AS c, -1::BIGINT AS h, -2::BIGINT AS hd, CAST([] AS STRUCT(h BIGINT, i BIGINT, op VARCHAR, name VARCHAR)[]) AS items FROM entry
  UNION ALL
  SELECT file, hunk, nth, CASE WHEN kind = 'tests' THEN depth ELSE t2 END,
    CASE WHEN kind = 'columns' THEN depth WHEN opens OR closed THEN -2 WHEN bares THEN CASE WHEN h >= 0 THEN hd - 1 ELSE -1 END ELSE c END,
    CASE WHEN opens THEN n WHEN bares THEN -1 ELSE h END, CASE WHEN opens THEN depth ELSE hd END,
    CASE WHEN placed THEN list_append(items, struct_pack(h := CASE WHEN opens THEN n ELSE h END, i := n, op := op, name := name))
         WHEN bares AND h >= 0 THEN list_transform(items, lambda x: struct_pack(h := CASE WHEN x.h = h THEN -1 ELSE x.h END, i := x.i, op := x.op, name := x.name)) ELSE items END
  FROM (SELECT *, placed AND NOT (c <> -2 AND depth > c) AS opens FROM (
    SELECT s.file, s.hunk, e.nth, e.op, e.name, e.kind, e.depth, s.c, s.h, s.hd, s.items, CAST(len(s.items) AS BIGINT) AS n, CASE WHEN e.depth <= s.t THEN -2 ELSE s.t END AS t2,
      e.kind = 'item' AND (s.t = -2 OR e.depth <= s.t) AS placed, e.kind = 'key' AND s.c = -2 AS bares, e.kind = 'other' AND s.h >= 0 AND e.depth <= s.hd AS closed
    FROM step s JOIN entry e ON e.file = s.file AND e.hunk = s.hunk AND e.nth = s.nth + 1))),
ended AS (SELECT file, hunk, items, unnest(items) AS x FROM (SELECT file, hunk, arg_max(items, nth) AS items FROM step GROUP BY ALL))
SELECT DISTINCT file, hunk, CASE WHEN x.h >= 0 THEN items[x.h + 1].name END AS owner, x.op AS op, lower(x.name) AS column FROM ended WHERE x.h <> x.i AND x.op IN ('+', '-')"""
ORACLES = {
    "diff_lines": f"WITH {DIFFS} SELECT pr, file_no, path, previous_path, change_type, n_added, n_removed FROM files WHERE regexp_matches(path, '\\.(sql|yml|yaml|csv|py)$')",
    "shown_lines": f"""WITH {DIFFS}, sl AS (SELECT concat(pr, '/', line_no // 900) AS pr, line_no % 900 AS line_no, class FROM seg),
sf AS (SELECT *, CAST(sum(CAST(class = 'header' AS INTEGER)) OVER (PARTITION BY pr ORDER BY line_no) AS BIGINT) AS file_no FROM sl)
SELECT * FROM (SELECT pr, file_no, CAST(line_no AS INTEGER) AS line_no, CAST(row_number() OVER (PARTITION BY pr, file_no ORDER BY line_no) AS INTEGER) AS nth FROM sf WHERE class IN ('added', 'removed') AND file_no > 0) WHERE nth <= 3""",
    "line_classes": f"WITH {DIFFS} SELECT pr, class, count(*) AS n FROM classed GROUP BY ALL",
    "segment_lines": f"WITH {DIFFS} SELECT pr, CAST(line_no AS INTEGER) AS line_no, class, file_no, hunk_no FROM seg",
    "semantic_flag": f"WITH {DIFFS} SELECT pr, file_no, CASE WHEN regexp_matches(path, '\\.ya?ml$') THEN yaml_semantic ELSE sql_semantic END AS is_semantic FROM files",
    "heading_attribution": f"WITH {_TURNS} SELECT conv_id, turn, owner, owner IS NULL AS orphan FROM members",
    "owner_attribution": f"""WITH {_TURNS},
named AS (SELECT conv_id AS file, owner, concat('c', turn % 5) AS col FROM members WHERE role = 'assistant'),
cand AS (SELECT DISTINCT conv_id AS file, concat('m', turn) AS node FROM conversations WHERE role <> 'assistant'),
sole AS (SELECT file, count(*) AS n FROM cand GROUP BY file),
per AS (SELECT file, owner, list_sort(list(DISTINCT col)) AS own FROM named WHERE owner IS NOT NULL GROUP BY ALL),
orph AS (SELECT file, list_sort(list(DISTINCT col)) AS orphans FROM named WHERE owner IS NULL GROUP BY ALL),
heads AS (SELECT DISTINCT file, true AS has_heading FROM per)
SELECT file, node, array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), CASE WHEN n = 1 THEN coalesce(orphans, []) ELSE [] END))), ',') AS columns
FROM cand JOIN sole USING (file) LEFT JOIN heads USING (file) LEFT JOIN orph USING (file) LEFT JOIN per ON per.file = cand.file AND per.owner = cand.node
WHERE has_heading IS NULL OR own IS NOT NULL OR (n = 1 AND orphans IS NOT NULL)""",
    "first_wins": "SELECT user_id AS node, min(event_id) AS file_no, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "net_column_delta": """WITH o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'N')), n AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag IN ('N', 'R')),
x AS (SELECT coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey, o.l_partkey AS a, n.l_partkey AS b FROM o FULL JOIN n ON o.l_orderkey = n.l_orderkey AND o.l_partkey = n.l_partkey)
SELECT l_orderkey, coalesce(string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FILTER (a IS NULL), '') AS added, coalesce(string_agg(CAST(a AS VARCHAR), ',' ORDER BY a) FILTER (b IS NULL), '') AS removed
FROM x WHERE a IS NULL OR b IS NULL GROUP BY l_orderkey""",
    "snapshot_diff": f"""WITH {_SNAPSHOTS} SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM before b FULL JOIN after a ON a.c_custkey = b.c_custkey WHERE b.c_custkey IS NULL OR a.c_custkey IS NULL OR (a.c_name, a.c_nationkey, a.c_mktsegment) IS DISTINCT FROM (b.c_name, b.c_nationkey, b.c_mktsegment)""",
    "rename_detection": f"""WITH {_SNAPSHOTS} SELECT g.c_custkey AS previous, n.c_custkey AS current FROM (SELECT * FROM before WHERE c_custkey NOT IN (SELECT c_custkey FROM after)) g
JOIN (SELECT * FROM after WHERE c_custkey NOT IN (SELECT c_custkey FROM before)) n ON g.c_name = n.c_name""",
    "alias_extract": f"WITH {CODE}, x AS (SELECT path, lower(unnest(regexp_extract_all(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '{_ALIAS_SQL}', 1))) AS alias FROM code) SELECT path, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM x GROUP BY path",
    "path_normalise": f"SELECT doc_id, {_NORMAL.format('(' + _PATH + ')')} AS path FROM documents",
    "path_suffix_join": f"WITH {_FILES} SELECT file, id, role, CAST(rank AS INTEGER) AS rank FROM direct",
    "rename_fallback_join": f"WITH {_FILES} SELECT * FROM found",
    "unresolved_anti": f"WITH {_FILES} SELECT file, path FROM files WHERE file NOT IN (SELECT file FROM found)",
    "findings_with_owner": f"WITH {_SECRETS} SELECT s.path, kind, node FROM secret_rows s LEFT JOIN (SELECT {_PATH} AS path, concat('d', doc_id) AS node FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) n ON n.path = s.path",
    "secret_formats": f"WITH {CODE} SELECT path, CAST(line_no AS INTEGER) AS line_no, {_PROVIDER} AS kind FROM code WHERE kind IS NOT NULL",
    "secret_urls": f"WITH {CODE}, u AS (SELECT *, {_URL} AS url FROM code) SELECT path, CAST(line_no AS INTEGER) AS line_no FROM u WHERE url <> '' AND {_literal_sql('url', 'true')} IS NOT NULL",
    "secret_assignments": f"WITH {_SECRETS} SELECT path, CAST(line_no AS INTEGER) AS line_no, key FROM told WHERE by_key",
    "secret_findings": f"WITH {_SECRETS} SELECT * FROM secret_rows",
    "incremental_findings": f"WITH {_SECRETS} SELECT * FROM secret_rows",
    "scanned_lines": """SELECT coalesce(source, '') AS pr, row_number() OVER (PARTITION BY source ORDER BY doc_id, nth) - 1 AS line_no, md5(concat('+', line)) AS digest
FROM (SELECT source, doc_id, unnest(range(len(string_split(text, chr(10))))) AS nth, unnest(string_split(text, chr(10))) AS line FROM documents)""",
    "nested_block_scan": _NESTED,
    "hardcoded_relations": f"WITH {_SECRETS}{_LINT} SELECT path, what, line_no FROM hc",
    "null_comparisons": f"WITH {_SECRETS}{_LINT} SELECT path, what, line_no, CASE WHEN what = '=' THEN 'is null' ELSE 'is not null' END AS fix FROM nc",
    "deprecated_keys": f"WITH {_SECRETS}{_LINT} SELECT path, what, line_no FROM dk",
    "line_references": f"WITH {_SECRETS}{_LINT} SELECT path, what, line_no FROM cl",
    "missing_entry_lines": f"WITH {_SECRETS}{_LINT} SELECT pr, path, what, line_no FROM me",
    "all_findings": f"WITH {_SECRETS}{_LINT} SELECT * FROM findings",
    "cross_layer_refs": f"WITH {EDGES}, r AS (SELECT child AS s, parent AS t FROM edges UNION SELECT parent, child FROM edges WHERE parent >= 4000000000) SELECT {label_sql('s')} AS source, {label_sql('t')} AS target FROM r WHERE t // 1000000000 > s // 1000000000",
    "missing_entry_anti": "SELECT source AS pr, doc_id AS name FROM documents WHERE doc_id % 13 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "report_rows": f"""WITH {_SECRETS}{_LINT},
f AS (SELECT *, trim(regexp_replace(concat_ws(' ', rule_id, 'in', path, 'on   line', line_no), '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY pr ORDER BY severity DESC, path, rule_id, line_no, what) AS nth FROM findings),
c AS (SELECT *, CASE WHEN length(t) > 60 THEN concat(substr(t, 1, 59), '…') ELSE t END AS text FROM f)
SELECT pr, count(*) AS n, greatest(count(*) - 40, 0) AS hidden, string_agg(text, chr(10) ORDER BY nth) FILTER (nth <= 40) AS report,
  concat(array_to_string(list_sort(list(DISTINCT rule_id))[1:6], ', '), CASE WHEN count(DISTINCT rule_id) > 6 THEN concat(' +', count(DISTINCT rule_id) - 6, ' more') ELSE '' END) AS preview FROM c GROUP BY pr""",
    "change_summary": """WITH i AS (SELECT l_orderkey AS k, l_returnflag = 'R' AS gone, l_linenumber AS n, concat('c', l_partkey) AS col FROM lineitem),
d AS (SELECT k, list_sort(list(DISTINCT col) FILTER (gone)) AS o, list_sort(list(DISTINCT col) FILTER (NOT gone)) AS a, string_agg(concat('select ', col, ' from line ', n), ' ' ORDER BY gone, n, col) AS lines FROM i GROUP BY k),
x AS (SELECT k, lines, list_filter(coalesce(o, []), lambda c: NOT list_contains(coalesce(a, []), c)) AS removed, list_filter(coalesce(a, []), lambda c: NOT list_contains(coalesce(o, []), c)) AS added FROM d),
s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat_ws(' ', ['added', 'modified', 'deleted', 'renamed'][o_orderkey % 4 + 1], CASE WHEN len(removed) > 0 THEN concat('removed column dropped column ', array_to_string(removed, ' ')) END,
  CASE WHEN len(added) > 0 THEN concat('added column ', array_to_string(added, ' ')) END, CASE WHEN o_orderkey % 4 >= 2 THEN 'deleted model renamed rename' END, CASE WHEN o_orderpriority LIKE '1-%' THEN 'exposure owner' END, lines) END AS text FROM orders LEFT JOIN x ON k = o_orderkey)
SELECT o_orderkey, sha256(text) AS summary_sha256, length(text) AS n_chars FROM s""",
    "tokens": f"WITH b AS (SELECT item_id, regexp_replace(text, '^(\\w+) (\\w+)', '\\1_\\2') AS text FROM benchmark) SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest({TOKENS_SQL.format('text')}) AS token FROM b) GROUP BY ALL",
}
