"""Faults of the third review: order of written lines, reach of many roots, memory of one task."""

import fnmatch
import random

import duckdb
from pyspark.sql import functions as F

from ripplemark.functions import patterns
from ripplemark.operators import changes, graph, retrieval, rules
from ripplemark.plans import retrieving, scanning
from ripplemark.plans.tables import Tables


def test_lines_are_written_in_their_order(spark, tmp_path):
    """Rows come in no order; a null source and an empty one are two, and a null doc_id is last."""
    rows = [(i, "\n".join(f"{i} {n}" for n in range(3)), f"s{i % 3}") for i in range(199, -1, -1)]
    rows = rows[::2] + rows[1::2] + [(8, "e", ""), (7, "n", None), (None, "last", "s0"), (3, None, "s0"), (5, "d", "")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in scanning.scanned_lines(Tables(spark, str(tmp_path))).collect():
        got.setdefault(r.pr, []).append((r.line_no, r.digest))
    digest = {text: spark.range(1).select(F.md5(F.lit("+" + text).cast("binary"))).first()[0] for text in ("e", "n", "d", "last", "0 0", "198 2")}
    assert sorted(got[""]) == sorted([(0, digest["d"]), (1, digest["e"]), (0, digest["n"])])
    s0 = dict(got["s0"])
    assert len(s0) == len(got["s0"]) == 67 * 3 + 1 and (s0[0], s0[200], s0[201]) == (digest["0 0"], digest["198 2"], digest["last"])


def brute_reach(edges, root):
    found, level, depth = {}, {root}, 0
    while level:
        depth += 1
        level = {b for a, b in edges if a in level} - set(found) - {root}
        found |= {n: depth for n in level}
    return found


def test_roots_of_a_block_share_the_rows_of_a_node(spark):
    """An edge is followed once for a block of roots; what is told of the sets equals what is told of the rows."""
    rng = random.Random(3)
    n = 150  # three blocks
    edges = [(rng.randrange(n), 1000 + rng.randrange(20)) for _ in range(300)] + [(1000 + rng.randrange(20), 2000 + rng.randrange(30)) for _ in range(60)] + [(2000, 5), (5, 5)]
    roots = spark.createDataFrame([(r,) for r in range(n)] * 2 + [(None,)], "root long").repartition(3)
    frame = spark.createDataFrame(edges * 2, "parent long, child long").repartition(4)
    found = graph.reach_sets(roots, frame)
    want = sorted((r, x, d) for r in range(n) for x, d in brute_reach(edges, r).items())
    assert sorted(map(tuple, found.rows().collect())) == want
    depths = max(d for _, _, d in want)
    assert found.sets.count() <= 3 * depths * len({x for _, x, _ in want}) < len(want)
    nodes = spark.createDataFrame([(i, f"n{i % 7}", "exposure" if i % 2 else "model", i % 3 == 0, "public", f"o{i % 4}" if i % 4 else None) for i in {x for _, x, _ in want}], "id long, name string, kind string, contracted boolean, access string, owner string")
    for told in (lambda r: graph.reach_summary(r, nodes), lambda r: graph.reach_counts(r, nodes), lambda r: graph.shown_nodes(r, 3)):
        a, b = (sorted(map(tuple, told(r).collect())) for r in (found, found.rows()))
        assert a == b and a
    shown = graph.shown_nodes(found, 3)
    first = {r: sorted((d, x) for q, x, d in want if q == r)[:3] for r in {q for q, _, _ in want}}
    assert sorted((r.root, r.depth, r.node) for r in shown.collect()) == sorted((r, d, x) for r, top in first.items() for d, x in top)
    own = {r: {r, *[x for _, x in top]} for r, top in first.items()}
    assert sorted(map(tuple, graph.induced_edges(shown, frame).collect())) == sorted((r, a, b) for r, held in own.items() for a, b in set(edges) if a in held and b in held)


def test_children_are_told_apart_after_the_exchange(spark):
    frame = spark.createDataFrame([(i % 5, i % 7) for i in range(100)] + [(9, 1)], "parent long, child long")
    found = graph.children(spark.createDataFrame([(1,), (4,), (4,), (30,)], "node long"), frame)
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in (1, 4) for b in range(7)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # nothing is aggregated below the exchange, in the tasks that read files
    assert "HashAggregate" not in plan[plan.rindex("REPARTITION_BY_NUM"):]


def test_arriving_lines_take_as_many_files_as_exchange_parts(spark, tmp_path, monkeypatch):
    """A batch has several files, so no task reads a third of all lines; the number of batches stays."""
    rows = [(i, "\n".join(f"TOKEN{n % 3}=abc{n}" for n in range(20)), f"l{i % 2}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(scanning, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    for name, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "7")):
        spark.conf.set(name, value)
    try:
        t = Tables(spark, str(tmp_path))
        got = sorted(map(tuple, scanning.incremental_findings(t).collect()))
        assert got == sorted(map(tuple, scanning.secret_findings(t).select("pr", "path", "kind", "preview", "line_no").collect())) and got
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = [f for f in (tmp_path / "arriving" / "lines").iterdir() if f.suffix == ".parquet"]
    assert len(files) == 7
    assert sum(f.name.isdigit() for f in (tmp_path / "arriving" / "checkpoint" / "commits").iterdir()) == 3


def test_files_are_told_from_their_own_lines(spark, tmp_path):
    """Only lines that tell files are segmented; paths and change types are those of whole diffs."""
    rows = [(i, "\n".join(["", "++ x", "diff --git a/y b/y", "new file mode", "@@ z"][: i % 6]), f"l{i % 2}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    real = changes.segment
    changes.segment = lambda lines: seen.append(lines.count()) or real(lines)
    try:
        got = sorted((r.path.replace("\\", "/").rsplit("/d", 1)[1].split(".")[0], r.change_type) for r in scanning.files(Tables(spark, str(tmp_path))).collect())
    finally:
        changes.segment = real
    assert got == sorted((str(i), "added" if i % 3 == 0 else "modified") for i in range(60))
    assert seen == [60 + 20]


def test_signs_drop_no_line_that_a_pattern_finds(spark):
    """Lines without the parts that a pattern needs never reach it; those with them are judged as before."""
    lines = ["", "plain prose about light and keys", "PassWord : \"abcdef\"", "API-Key='zz9'", "a secret told", "x xoxb-0123456789ab", "ghp_" + "a" * 36, "github_pat_" + "b" * 22, "sk-" + "c" * 20, "rk_live_" + "d" * 16,
             "JOIN a.b on c", "from {{ x }} a.b", "from a", "{{ ref('m1') }} -- x", "-- {{ ref('m1') }}", "a <> NULL", "b != null", "c = null", "set c = null", "null"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, text string")
    text = F.col("text")
    provider, key = (F.coalesce(text.rlike(p), F.lit(False)) for p in (patterns.PROVIDER_SIGN, patterns.ASSIGNMENT))
    got = df.select("i", (F.size(patterns.hardcoded(text)) > 0).alias("h"), (F.size(patterns.references(text)) > 0).alias("r"), patterns.null_comparison(text).alias("n"), patterns.provider(text).isNotNull().alias("p"), (patterns.assigned_key(text) != "").alias("k"), provider.alias("wp"), key.alias("wk")).orderBy("i").collect()
    assert [r.i for r in got if r.h] == [10, 11] and [r.i for r in got if r.r] == [13]
    assert {r.i: r.n for r in got if r.n} == {15: "<>", 16: "!=", 17: "="}
    assert [(r.i, r.p, r.wp, r.k, r.wk) for r in got if (r.p, r.k) != (r.wp, r.wk)] == []
    assert [r.i for r in got if r.k] == [2, 3]
    assert "Contains" in df.select(patterns.references(text))._jdf.queryExecution().optimizedPlan().toString()


def test_globs_of_a_shape_are_met_by_one_key_of_a_path(spark, monkeypatch):
    """Rules and changes join on whole keys: a path has at most one for each shape, and few of them."""
    changed = spark.createDataFrame([(i, f"{'cos'[i % 3]}/{i}", "model") for i in range(3000)] + [(-1, "c/é😀1", "model"), (-2, "c/1\n", "model"), (-3, "c/1\n", "model")], "node long, path string, kind string")
    made = [(f"r{i}", [[f"c/{i}"], [f"?/{i}[0-4]"], [f"*/{i}", f"zz/{i}*", f"?/{i}"], [f"o/{i}?", f"o/{i}[5-9]", f"*{i}*7"]][i % 4]) for i in range(400)] + [("u", ["c/??1", "c/é*"]), ("n", ["c/1?"]), ("all", ["**"])]
    loaded = rules.load(spark.createDataFrame(made, "rule_id string, globs array<string>"))
    paths = [(r.node, r.path) for r in changed.collect()]
    want = sorted((n, r) for r, globs in made for n, p in paths if any(fnmatch.fnmatchcase(p, g) for g in globs))
    counts = []
    kept = rules._keys_of_paths
    monkeypatch.setattr(rules, "_keys_of_paths", lambda shapes: counts.append((shapes, kept(shapes))) or counts[-1][1])
    assert sorted((r.node, r.rule_id) for r in rules.eligible(changed, loaded).collect()) == want
    shapes, keys = counts[0]
    held = rules._held(changed, ()).withColumn("__length", F.length("__path"))
    assert held.select(F.explode(keys)).count() < 6 * len(paths)
    monkeypatch.setattr(rules, "SHAPES", 3)  # the other shapes are filed by grams
    assert sorted((r.node, r.rule_id) for r in rules.eligible(changed, loaded).collect()) == want and len(counts[1][0]) == 3


def test_scored_slices_equal_the_sql_on_odd_ids(spark, tmp_path, monkeypatch):
    """Ids that repeat or are null are one query, null sources none; terms of documents are not rows where ids are unique."""
    rng = random.Random(5)
    words = ["model", "contract_breaking", "ci", "n", "materialization", "incremental_model", "table", "the", "_", "x_y", "governance_policy", "naïve", "9abc"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "_id"]) for _ in range(n))
    spark.createDataFrame([(i, text(rng.randint(1, 12))) for i in range(15)] + [(15, ""), (16, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, text(rng.randint(0, 25)), rng.choice(["a", "b", None])) for i in range(120)] + [(500, None, "a"), (501, "", None), (502, "é ß", "b")]

    def compared(given):
        spark.createDataFrame(given, "doc_id long, text string, source string").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for name in ("tfidf_topk", "union_topk"):
            with duckdb.connect() as con:
                for t in ("documents", "benchmark"):
                    con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
                want = con.execute(retrieving.ORACLES[name]).fetchall()
            got = [tuple(r) for r in retrieving.QUERIES[name](Tables(spark, str(tmp_path))).collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr), name

    compared([*rows, *[(i % 4, text(9), "c") for i in range(10)], *[(None, text(8), s) for s in ("a", "b", None)]])
    monkeypatch.setattr(retrieval, "SLICE_TOKENS", 30)
    compared([*rows, (0, text(5), None)])
    asked, kept = [], retrieval.terms
    monkeypatch.setattr(retrieval, "terms", lambda docs, *more: asked.append(docs.columns) or kept(docs, *more))
    compared(rows)
    assert {tuple(c) for c in asked} == {("rule_id", "text", "keywords")}
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)  # terms are joined
    compared([*rows, (0, text(5), None), (None, text(8), "a")])
