"""Forms that hold for groups and files of any size, against plain versions: carry scans, split reads, rule index, stored vectors."""

import fnmatch
import random
from pathlib import Path

from pyspark.sql import functions as F

from ripplemark.operators import carry, changes, rules, scan, stored
from ripplemark.sources import diffs

# --- carry


def plain_sections(lines):
    out, at = {}, {}
    for pr, no, text in sorted(lines, key=lambda r: (str(r[0]), r[1])):
        files, hunks, owner = at.get(pr, (0, 0, None))
        if text.startswith("diff"):
            files, hunks = files + 1, 0
        elif text.startswith("@@"):
            hunks += 1
        owner = text if text.startswith("@@") else owner
        at[pr] = files, hunks, owner
        out[pr, no] = files, hunks, owner
    return out


def test_one_change_set_holds_most_lines(spark):
    rng = random.Random(5)
    texts = ["diff --git a/x.sql b/x.sql", "@@ -1 +1 @@", "+a", "-b", "c", "d", "e"]
    lines = [("hot", i, rng.choice(texts)) for i in range(3000)] + [("cold", i, rng.choice(texts)) for i in range(40)] + [(None, i, "@@ x") for i in range(3)] + [("late", -9, "@@ y"), ("late", 10**9, "+z")]
    df = spark.createDataFrame(lines, "pr string, line_no long, text string").repartition(7)
    want = plain_sections(lines)
    for size in (1, 16, 4096):
        got = changes.segment(df, chunk=size).collect()
        assert {(r.pr, r.line_no): (r.file_no, r.hunk_no) for r in got} == {k: v[:2] for k, v in want.items()}
        owned = changes.attribute(df, F.when(F.col("text").startswith("@@"), F.col("text")), ["pr"], "line_no", chunk=size).collect()
        assert {(r.pr, r.line_no): r.owner for r in owned} == {k: v[2] for k, v in want.items()}
    assert len(got) == len(owned) == len(lines)


def test_a_hot_change_set_is_many_groups(spark):
    df = spark.range(10_000).select(F.lit("p").alias("pr"), F.col("id").alias("line_no"), F.lit("+x").alias("text"))
    own = carry._chunked(df, "line_no", 100).groupBy("pr", "__chunk").count()
    assert own.count() == 100 and own.agg(F.max("count")).first()[0] == 100
    assert carry.last_value(df.limit(0), F.col("text"), ["pr"], "line_no", "owner").count() == 0


# --- diffs


def test_a_diff_larger_than_a_split_has_the_same_lines(spark, tmp_path):
    rng = random.Random(2)
    texts = {name: ["+" + "x" * rng.randint(0, 90) + str(i) for i in range(n)] for name, n in (("a", 4000), ("b", 3), ("c", 1))}
    for name, held in texts.items():
        (tmp_path / f"{name}.diff").write_text("\n".join(held) + "\n" * (name != "c"))
    (tmp_path / "empty.diff").write_text("")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        rows = diffs.read_diffs(spark, f"file://{tmp_path}")
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 8
        assert {(r.pr, r.line_no): r.text for r in rows.collect()} == {(n, i): t for n, held in texts.items() for i, t in enumerate(held)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


# --- rules

GLOBS = ["*", "?", "s/*", "*.sql", "*/1*", "a[bc]d", "a[!bc]d", "a[b", "[!]", "x]y", "*[0-9]*", "a.b+c", "", "models/**/x?.yml", "[]]a", "**", "p/?", "*models/staging/long_name*"]
FILES = ["", "s/1", "a/1b", "abd", "acd", "axd", "a[b", "!", "[!]", "x]y", "q7q", "a.b+c", "models/m/xy.yml", "models/xy.yml", "]a", "p/1", "p/12", "f.sql", "p\nq.sql", "a\\b\\x", "z/models/staging/long_name.sql", None]


def test_rules_through_the_index_equal_all_pairs(spark):
    rng = random.Random(3)
    made = [(f"r{i}", rng.choice([None, "", "checklist"]), rng.choice([None, [], ["model"], ["model", "seed"]]), rng.choice([None, [], [rng.choice(GLOBS)], rng.sample(GLOBS, 3)]), rng.choice([None, {}, {"acc": "pub"}, {"n": "1", "acc": "priv"}, {"nothing": "x"}])) for i in range(80)]
    nodes = [(i % 40, p, rng.choice(["model", "seed", "x", None]), rng.choice(["pub", "priv", None]), rng.choice([1, 2])) for i, p in enumerate(FILES * 3)]

    def admits(rule, node):
        _, _, kinds, globs, requires = rule
        held = {"acc": node[3], "n": str(node[4])}
        path = (node[1] or "").replace("\\", "/")
        return (not kinds or node[2] in kinds) and (not globs or any(fnmatch.fnmatchcase(path, g) for g in globs)) and all(held.get(k) == v for k, v in (requires or {}).items())

    changed, loaded = spark.createDataFrame(nodes, "node long, path string, kind string, acc string, n int"), rules.load(spark.createDataFrame(made, rules.RULE))
    for kind in rules.APPLIES:
        some = [r for r in made if (r[1] or "retrieved") == kind]
        want = sorted((n[0], r[0]) for n in nodes for r in some if admits(r, n))
        assert sorted((r.node, r.rule_id) for r in rules.eligible(changed, loaded, ("acc", "n"), kind).collect()) == want
        every = rules.reasons(changed, loaded, ("acc", "n"), kind)
        assert sorted((r.node, r.rule_id) for r in every.where("reason is null").collect()) == want and every.count() == len(nodes) * len(some)
    none = rules.load(spark.createDataFrame([], rules.RULE))
    assert rules.eligible(changed, none).count() == rules.reasons(changed, none).count() == rules.eligible(changed.limit(0), loaded, ("acc", "n")).count() == 0


# --- stored vectors


def test_stored_vectors_follow_the_content(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    given = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "rule_id int, text string")
    ask = lambda *texts: stored.rule_vectors(given(*texts), "rule_id", "text", folder)
    rows = lambda s: sorted(map(tuple, s.vectors.collect()))
    first = ask("joins need grain", "pii email grain")
    again = ask("joins need grain", "pii email grain")
    assert (first.reused, again.reused) == (False, True) and rows(first) == rows(again) and first.signature == again.signature
    assert {r.term for r in again.weights.collect()} == {"joins", "need", "grain", "pii", "email"}
    other = ask("joins need grain", "pii email")
    assert not other.reused and other.signature != first.signature and not any(r.term == "grain" and r.rule_id == 1 for r in other.vectors.collect())
    assert ask("joins need grain", "pii email grain").reused  # the older content is still there
    # damage: a file emptied, a file removed, commits gone
    held = sorted(Path(tmp_path / "v" / first.signature).glob("*/vectors/*.parquet"))
    held[0].write_bytes(b"")
    for c in held[0].parent.glob(".*.crc"):
        c.unlink()
    mended = ask("joins need grain", "pii email grain")
    assert not mended.reused and rows(mended) == rows(ask("joins need grain", "pii email grain"))
    for f in Path(tmp_path / "v" / first.signature).glob("*/vectors/*.parquet"):
        f.unlink()
    assert not ask("joins need grain", "pii email grain").reused
    for f in Path(tmp_path / "v" / "commits").glob("*"):
        f.write_bytes(b"no parquet") if f.suffix == ".parquet" else f.unlink()
    assert not ask("joins need grain", "pii email grain").reused
    assert ask().vectors.count() == 0 and ask().reused


# --- findings by change set


def test_equal_paths_of_two_change_sets_stay_apart(spark):
    rows = [(pr, "models/staging/a.sql", n, t) for pr in ("p", "q") for n, t in enumerate(["from raw.t", "where x = null", "join {{ ref('m') }}", "token = 'abc'"])]
    rows += [("p", "models/a.yml", 0, "  - name: a"), ("p", "models/b.sql", 0, "x"), ("q", "models/x.y.sql", 0, "x"), ("q", "models/d.yml", 0, "- name: 'x.y'")]
    lines = spark.createDataFrame(rows, "pr string, path string, line_no int, text string")
    files = spark.createDataFrame([("p", "models/staging/a.sql", "added"), ("q", "models/staging/a.sql", "added"), ("p", "models/b.sql", "modified"), ("q", "models/x.y.sql", "added"), ("q", "models/c.sql", "added")], "pr string, path string, change_type string")
    nodes = spark.createDataFrame([("m", "models/marts/m.sql")], "name string, path string")
    got = sorted((r.pr, r.path, r.rule_id, r.what) for r in scan.all_findings(lines, nodes=nodes, documented=nodes.select("name"), files=files).collect())
    each = [("cross-layer-reference", "m"), ("hardcoded-relation", "raw.t"), ("literal value for `token`", "****"), ("null-comparison", "=")]
    want = [(pr, "models/staging/a.sql", *f) for pr in ("p", "q") for f in each] + [("q", "models/staging/a.sql", "missing-schema-entry", "a"), ("q", "models/c.sql", "missing-schema-entry", "c")]
    assert got == sorted(want)


def test_a_name_is_a_node_of_its_own_project(spark):
    lines = spark.createDataFrame([("p", "one", "models/staging/a.sql", 0, "{{ ref('m') }} {{ref( \"n\" , v=2)}} ref('o')"), ("p", "two", "models/staging/b.sql", 0, "{{ ref('m') }}")], "pr string, project string, path string, line_no int, text string")
    nodes = spark.createDataFrame([("one", "m", "models/marts/m.sql"), ("one", "n", "models/marts/n.sql"), ("one", "o", "models/marts/o.sql"), ("two", "m", "models/staging/m.sql")], "project string, name string, path string")
    assert sorted((r.path, r.what) for r in scan.cross_layer_findings(lines, nodes).collect()) == [("models/staging/a.sql", "m"), ("models/staging/a.sql", "n")]
