"""Reports, constraints, the results sink, ids, refusals and the retraction feed on inline tables."""

import random

import pytest
from pyspark.sql import functions as F

from ripplemark.functions import text
from ripplemark.operators import constraints, reports, sink
from ripplemark.operators.constraints import Constraint
from ripplemark.sources import catalog
from ripplemark.streaming import events


def test_a_report_shows_a_bounded_number(spark):
    rows = [("hot", f"r{i % 9}", i) for i in range(500)] + [("cold", "r1", 1), (None, "r2", 2)]
    df = spark.createDataFrame(rows, "pr string, rule_id string, n int").repartition(5)
    got = {r.pr: r for r in reports.report(df, F.concat_ws("  ", "rule_id", "n"), [F.col("n")], shown=3, rules=2, width=5).collect()}
    assert (got["hot"].n, got["hot"].hidden, got["hot"].report, got["hot"].preview) == (500, 497, "r0 0\nr1 1\nr2 2", "r0, r1 +7 more")
    assert (got["cold"].n, got["cold"].hidden, got["cold"].report, got["cold"].preview) == (1, 0, "r1 1", "r1")
    assert got[None].report == "r2 2" and reports.report(df.limit(0), F.col("rule_id"), [F.col("n")]).count() == 0


def test_summaries_name_what_changed(spark):
    changes = spark.createDataFrame([(1, "renamed", "exposure", True), (2, "modified", "model", True), (3, "modified", "model", False)], "k int, change_type string, kind string, is_semantic boolean")
    before, after = (spark.createDataFrame(r, "k int, c string") for r in ([(1, "a"), (1, "b"), (2, "x")], [(1, "b"), (1, "z"), (2, "x")]))
    lines = spark.createDataFrame([(1, "-", 1, "old"), (1, "+", 2, "new"), (1, " ", 3, "same"), (3, "+", 1, "-- note")], "k int, op string, line_no int, text string")
    got = {r.k: r.summary for r in reports.summaries(changes, reports.column_changes(before, after, "k", "c"), lines, "k").collect()}
    assert got == {1: "renamed removed column dropped column a added column z deleted model renamed rename exposure owner new old", 2: "modified", 3: ""}


def test_constraints_of_a_table_are_judged_together(spark):
    rows = spark.createDataFrame([(1, "a", ["r1", "r9"]), (2, "b", []), (3, None, ["r1", None]), (4, "c", None), (1, "a", ["r9"])], "id int, diff string, rules array<string>")
    tables = {"diffs": spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string"), "pack": spark.createDataFrame([("r1",)], "rule string")}
    given = [Constraint("no diff", "exists", "diff", "diffs", "name"), Constraint("not one diff", "one", "diff", "diffs", "name"), Constraint("unknown rule", "known", "rules", "pack", "rule")]
    got = sorted(map(tuple, constraints.broken(rows, "id", given, tables).collect()), key=str)
    assert got == sorted([(1, "unknown rule", "r9", 0), (2, "not one diff", "b", 2), (3, "no diff", None, 0), (3, "not one diff", None, 0), (4, "no diff", "c", 0), (4, "not one diff", "c", 0)], key=str)
    with pytest.raises(ValueError, match="none of"):
        Constraint("x", "some", "diff", "diffs", "name")
    with pytest.raises(ValueError, match="twice"):
        constraints.broken(rows, "id", [given[0], given[0]], tables)
    with pytest.raises(ValueError, match="no table pack"):
        constraints.broken(rows, "id", given, {"diffs": tables["diffs"]})


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    metrics = lambda f1: spark.createDataFrame([(f1,)], "f1 double")
    seen = lambda: (sorted((r.run, r.id) for r in sink.read_runs(spark, folder).collect()), {r.run: r.f1 for r in sink.commits(spark, folder).collect()})
    sink.write_run(rows(1, 2), metrics(0.5), folder, "007")
    sink.write_run(rows(3), metrics(0.7), folder, "1e5")
    assert seen() == ([("007", 1), ("007", 2), ("1e5", 3)], {"007": 0.5, "1e5": 0.7})
    sink.write_run(rows(9), metrics(0.6), folder, "007")
    assert seen() == ([("007", 9), ("1e5", 3)], {"007": 0.6, "1e5": 0.7})
    # a run that breaks between rows and metrics leaves what was there
    with pytest.raises(ValueError, match="no row"):
        sink.write_run(rows(4, 5), metrics(0.1).limit(0), folder, "1e5")
    assert seen() == ([("007", 9), ("1e5", 3)], {"007": 0.6, "1e5": 0.7})
    sink.write_run(rows(4), metrics(0.2), folder, "1e5")
    assert seen() == ([("007", 9), ("1e5", 4)], {"007": 0.6, "1e5": 0.2})
    assert len(list((tmp_path / "runs" / "rows" / "007").iterdir())) == 1


def test_different_ids_stay_different(spark):
    ids = ["a.b", "a_b", "a-b", "a_db", "a b", "ab", "", "é.1", "a__b", "a_x20_b", "model.x.y-z"]
    got = [r.p for r in spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").select("i", text.plain_id(F.col("x")).alias("p")).orderBy("i").collect()]
    assert len(set(got)) == len(ids) and all(not p or p.replace("_", "a").isalnum() and p.isascii() for p in got)
    assert got[0] == "a_db" and got[5] == "ab"


def test_refusals_have_their_cause(spark):
    rows = spark.createDataFrame([("k", "local", 0, False, "no such file"), ("k", "ci", 1, False, None), ("k", "target", 2, True, None)], "key string, source string, priority int, usable boolean, cause string")
    r = catalog.first_usable(rows, "key").first()
    assert (r.source, r.warnings) == ("target", ["local isn't usable: no such file", "ci isn't usable"])


@pytest.mark.parametrize("seed", [1, 2])
def test_the_feed_summed_up_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(40), rng.randrange(12), rng.random() < 0.2, rng.random() < 0.5) for i in range(120)]
    made = lambda df: df.withColumn("ts", (F.lit(1_700_000_000) + F.col("at")).cast("timestamp")).drop("at")
    raw = spark.createDataFrame(rows, "delivery_id long, at int, key int, failed boolean, nothing_to_report boolean")
    for part in range(3):  # late, and every sixth twice
        raw.where(f"delivery_id % 3 = {part} or (delivery_id % 6 = 1 and {part} = 2)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: made(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    table, feed, checkpoint = (str(tmp_path / x) for x in ("live", "feed", "ck"))
    run = lambda: events.maintain_feed(stream(), table, feed, checkpoint, buckets=3).awaitTermination()
    run()
    rows_of = lambda: sorted((r.batch, r.key, r.op, r.delivery_id) for r in spark.read.parquet(feed).collect())
    once = rows_of()
    # the last batch runs again, as after a driver that was lost before it had committed
    last = max((int(p.name) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit()))
    for p in (tmp_path / "ck" / "commits").iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    run()
    assert rows_of() == once
    state = {r.key: (r.op, r.delivery_id) for r in events.feed_state(spark, feed).collect()}
    live = {r.key: r.delivery_id for r in events.live(made(raw)).collect()}
    assert {k: d for k, (op, d) in state.items() if op == "upsert"} == live
    assert {k for k, (op, _) in state.items() if op == "retract"} == {r.key for r in events.retracted(made(raw)).collect()}
    # no reader is told twice of the same
    for key in state:
        ops = [(op, d) for _, k, op, d in once if k == key]
        assert all(a != b for a, b in zip(ops, ops[1:])) and ops[0][0] in ("upsert", "retract")


def test_findings_of_a_stream_are_kept_once(spark, tmp_path):
    rows = [(f"p{i % 2}", "a.env", i, f"TOKEN{i % 3}=abc{i}") for i in range(30)]
    raw = spark.createDataFrame(rows, "pr string, path string, line_no int, text string")
    for part in (2, 0, 1, 0):
        raw.where(f"line_no % 3 = {part} or line_no = 7").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
        events.maintain_findings(stream, str(tmp_path / "kept"), str(tmp_path / "ck"), buckets=2).awaitTermination()
    got = sorted((r.pr, r.kind, r.line_no) for r in events.live_state(spark, str(tmp_path / "kept")).collect())
    assert got == sorted((f"p{i % 2}", f"literal value for `TOKEN{i % 3}`", i) for i in range(6))
