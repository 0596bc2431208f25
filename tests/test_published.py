"""Published versions, audited writes, folded stream state, and run states."""

import json
import os

import pytest
from pyspark.sql import functions as F

from docketlens.operators import run_state as R
from docketlens.operators.survival import collapse_dockets
from docketlens.sources.publication import Publication, Refused
from docketlens.streaming.lifecycle_stream import LifecycleStream
from docketlens.streaming.state import BucketedState

ITEM = "id string, n int"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def test_versions_are_named_once_and_read_back(spark, tmp_path):
    catalog = Publication(str(tmp_path), ITEM, "id string")
    assert catalog.read(spark).collect() == [] and catalog.history(spark).collect() == []
    event = spark.createDataFrame([("a",)], "id string")
    assert catalog.publish(items(spark, ("a", 1)), "first", event) == 1
    # The same run again adds neither a version nor events; rows of a run that was never named are not seen.
    assert catalog.publish(items(spark, ("a", 9)), "first", event) == 1
    catalog.stage(items(spark, ("z", 7)), 2)
    catalog.append_history(event, "lost")
    assert [tuple(r) for r in catalog.read(spark).collect()] == [("a", 1)] and catalog.history(spark).count() == 1
    assert catalog.publish(items(spark, ("a", 2), ("b", 3)), "second", event) == 2
    assert catalog.read(spark).count() == 2 and [tuple(r) for r in catalog.read(spark, 1).collect()] == [("a", 1)]
    assert sorted(r["run"] for r in catalog.history(spark).collect()) == ["first", "second"] and catalog.history(spark, 1).count() == 1
    told = json.loads(next(open(tmp_path / "manifests" / f).read() for f in os.listdir(tmp_path / "manifests") if f.startswith("v00000002") and f.endswith("json")))
    assert (told["rows"], told["run"]) == (2, "second")
    with pytest.raises(ValueError, match="not published"):
        catalog.read(spark, 3)
    with pytest.raises(ValueError, match="published by run"):
        catalog.name(spark, 2, "other", {})
    with pytest.raises(Exception, match="unsupported schema version"):
        Publication(str(tmp_path), ITEM, schema_version=2).read(spark).collect()


def test_a_refused_write_changes_nothing(spark, tmp_path):
    catalog = Publication(str(tmp_path), ITEM)
    rules = {"no_negative": lambda m: m["negative"] == 0, "some_rows": lambda m: m["rows"] > 0}
    metrics = {"negative": F.count_if(F.col("n") < 0)}
    catalog.publish(items(spark, ("a", 1)), "good", metrics=metrics, rules=rules)
    with pytest.raises(Refused, match="no_negative") as refused:
        catalog.publish(items(spark, ("a", -1), ("b", 1)), "bad", metrics=metrics, rules=rules)
    assert refused.value.metrics == {"rows": 2, "negative": 1}
    with pytest.raises(Refused, match="some_rows"):
        catalog.publish(items(spark).limit(0), "empty", metrics=metrics, rules=rules)
    assert catalog.latest(spark) == 1 and [tuple(r) for r in catalog.read(spark).collect()] == [("a", 1)]


def test_audited_lifecycles_refuse_lost_pending_rows(spark, tmp_path):
    from docketlens.operators.audited import publish_lifecycles
    from docketlens.plans import docket_survival
    from docketlens.plans.published import LIFE

    rows = docket_survival.classified(spark, "/root/testdata/sf0.001")
    catalog = Publication(str(tmp_path), LIFE)
    unpending = lambda df, *how: collapse_dockets(df, *how).withColumn("pending", F.lit(False)).withColumn("final_terminated_at", F.col("filed_at"))
    with pytest.raises(Refused, match="pending_rows_are_censored"):
        publish_lifecycles(rows, catalog, "run", docket_survival.ORDER, docket_survival.SNAPSHOT, unpending)
    assert catalog.latest(spark) is None
    assert publish_lifecycles(rows, catalog, "run", docket_survival.ORDER, docket_survival.SNAPSHOT) == 1


def size_of(paths):
    files = [os.path.join(folder, f) for p in paths for folder, _, names in os.walk(p.removeprefix("file:")) for f in names if f.endswith(".parquet")]
    return sum(map(os.path.getsize, files)), len(files)


def test_state_reads_stay_flat_over_many_batches(spark, tmp_path):
    state = BucketedState(str(tmp_path / "state"), "k long, v string", ["k"], buckets=4, fold_every=5)
    want, read = {}, []
    for batch in range(50):
        rows = [(k, f"{batch}-{k}") for k in range(batch % 3, 30, 3)]
        want |= dict(rows)
        read.append(size_of(state.paths(spark, batch)))
        state.write(spark.createDataFrame(rows, "k long, v string").coalesce(1), batch)
    assert {r["k"]: r["v"] for r in state.current(spark).collect()} == want
    # From the first fold on no batch reads more than any other stretch of batches did.
    early, late = read[10:20], read[40:50]
    assert max(late)[0] <= 1.1 * max(early)[0] and max(n for _, n in late) <= max(n for _, n in early)
    # What is left on disk does not grow either: two folds and the deltas since.
    assert len(os.listdir(tmp_path / "state" / "base")) <= 50 and len([p for p in state.paths(spark)]) <= 4 * (5 + 1)
    only = state.current(spark, only=spark.createDataFrame([(3,), (99,)], "k int"))
    assert [(r["k"], r["v"]) for r in only.collect()] == [(3, want[3])]


def test_a_repeated_batch_folds_once(spark, tmp_path):
    state = BucketedState(str(tmp_path), "k long, v string", ["k"], buckets=2, fold_every=2)
    put = lambda batch, *rows: state.write(spark.createDataFrame(list(rows), "k long, v string"), batch)
    shown = lambda **how: sorted((r["k"], r["v"], r["batch"]) for r in state.current(spark, **how).collect())
    for batch in range(6):
        put(batch, (batch % 2, f"b{batch}"), (7, f"b{batch}"), (7, f"b{batch} too"))
    before = shown(before=5)
    assert before == [(0, "b4", 4), (1, "b3", 3), (7, "b4", 4), (7, "b4 too", 4)]
    # Batch 5 made a fold; its retry reads what came before it and replaces delta and fold.
    assert shown(before=5) == before
    put(5, (1, "again"))
    assert shown() == [(0, "b4", 4), (1, "again", 5), (7, "b4", 4), (7, "b4 too", 4)]
    put(6, (0, "new"))
    assert shown()[:2] == [(0, "new", 6), (1, "again", 5)]


def source(source_id, raw, parsed):
    return {"source_id": source_id, "required": True, "minimum_records": 1, "raw_rows": raw, "parsed_rows": parsed}


def test_a_check_meets_the_known_records_once(spark, tmp_path):
    stream = LifecycleStream(str(tmp_path / "state"), ["title"])
    tracker, ran = spark.sparkContext.statusTracker(), []
    # An id that moves to another source is compared with what it was last told as.
    for number, rows in enumerate([[("a", "x", "A"), ("b", "y", "B")], [("b", "y", "B")], [("b", "x", "A"), ("b", "y", "C")]]):
        path = str(tmp_path / f"rows-{number}")
        spark.createDataFrame(rows, "source_id string, record_id string, title string").write.parquet(path)
        spark.sparkContext.setJobGroup(f"check-{number}", "")
        stream.check(spark, {"checked_at": f"t{number}", "path": path, "sources": [source("a", 1, 1), source("b", 1, 1)]}, number)
        ran.append(len(tracker.getJobIdsForGroup(f"check-{number}")))
    spark.sparkContext.setJobGroup("after", "")
    got = {(r["source_id"], r["record_id"]): (r["transition"], r["title"], r["first_seen_at"]) for r in stream.records(spark).collect()}
    assert got == {("b", "x"): ("reactivated", "A", "t0"), ("b", "y"): ("changed", "C", "t0")}
    # The known records are not read, joined and labelled again for those that a check leaves alone.
    assert ran[2] <= 18, ran


def test_a_failed_source_keeps_its_records_and_a_dropped_one_loses_them(spark, tmp_path):
    stream = LifecycleStream(str(tmp_path / "state"), ["title"])
    checks = tmp_path / "checks"
    checks.mkdir()

    def arrive(number, rows, *sources):
        path = str(tmp_path / f"rows-{number}")
        spark.createDataFrame(rows, "source_id string, record_id string, title string").write.parquet(path)
        (checks / f"c{number}.json").write_text(json.dumps({"checked_at": f"t{number}", "path": path, "sources": list(sources)}))
        stream.run(spark, str(checks))
        return {r["record_id"]: (r["transition"], r["title"], r["freshness"], r["first_seen_at"]) for r in stream.records(spark).collect()}

    both = [("a", "a1", "A"), ("a", "a2", "B"), ("b", "b1", "C")]
    assert {k: v[0] for k, v in arrive(0, both, source("a", 2, 2), source("b", 1, 1)).items()} == dict.fromkeys(("a1", "a2", "b1"), "discovered")
    got = arrive(1, [("a", "a1", "A"), ("b", "b9", "lost")], source("a", 1, 1), source("b", 9, 1))
    assert got == {"a1": ("unchanged", "A", "current", "t0"), "b1": ("retained", "C", "stale", "t0")}
    got = arrive(2, [("a", "a2", "B")], source("a", 1, 1))
    assert got == {"a2": ("reactivated", "B", "current", "t0")}
    got = arrive(3, [("a", "a2", "B2"), ("b", "b1", "C")], source("a", 1, 1), source("b", 1, 1))
    assert got == {"a2": ("changed", "B2", "current", "t0"), "b1": ("reactivated", "C", "current", "t0")}
    log = [(r["occurred_at"], r["record_id"], r["type"]) for r in stream.history(spark).collect()]
    assert sorted(log) == sorted([
        ("t0", "a1", "discovered"), ("t0", "a2", "discovered"), ("t0", "b1", "discovered"), ("t1", "a2", "deactivated"),
        ("t2", "a1", "deactivated"), ("t2", "a2", "reactivated"), ("t3", "a2", "changed"), ("t3", "b1", "reactivated"),
    ])
    # A retried check reads the version before its own.
    stream.check(spark, json.loads((checks / "c3.json").read_text()), 3)
    assert stream.history(spark).count() == 8 and stream.records(spark).count() == 2 and stream.records(spark, 0).count() == 3
    times = {(r["batch"], r["last_complete_at"], r["overall_status"]) for r in stream.coverage.deltas(spark).collect()}
    assert times == {(0, "t0", "complete"), (1, "t0", "degraded"), (2, "t2", "complete"), (3, "t3", "complete")}


def run(spark, states, *attempts):
    return R.advance(states, spark.createDataFrame(list(attempts), R.ATTEMPT))


def test_run_states_carry_over_and_repeat_safely(spark):
    states = spark.createDataFrame([], R.STATE)
    first = run(spark, states, ("full", "r1", "t1", "3y", False, False, "p2", 5, 100, 80))
    again = run(spark, first, ("full", "r1", "t1", "3y", False, False, "p2", 5, 100, 80))
    assert [r.asDict(True) for r in again.collect()] == [r.asDict(True) for r in first.collect()]
    second = run(spark, first, ("full", "r2", "t2", "3y", False, False, None, 1, 20, 10), ("recent", "r2", "t2", "14d", False, True, None, 0, 0, 0))
    rows = {r["state_key"]: r for r in second.collect()}
    assert (rows["full"]["status"], rows["full"]["resumed"], rows["full"]["raw_results_seen_total"], rows["full"]["last_completed_at"]) == ("complete", True, 120, "t2")
    assert (rows["recent"]["status"], rows["recent"]["last_completed_at"], rows["recent"]["last_successful_at"]) == ("degraded", None, None)
    # Complete searches, restarts and other windows begin anew and keep the time of the last completion.
    third = run(spark, second, ("full", "r3", "t3", "3y", False, True, "p2", 1, 7, 7)).where("state_key = 'full'").first()
    assert (third["status"], third["run_status"], third["resumed"], third["pages_fetched_total"], third["last_completed_at"]) == ("in_progress", "degraded", False, 1, "t2")
    for window, restart in (("5y", False), ("3y", True)):
        fresh = run(spark, first, ("full", "r9", "t9", window, restart, False, None, 1, 3, 2)).first()
        assert (fresh["resumed"], fresh["accepted_results_total"]) == (False, 2)
