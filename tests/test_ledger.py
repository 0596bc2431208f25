import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketlens.operators import expectations as E
from docketlens.operators import ledger as L
from docketlens.sources.schemas import CLAIM, PROFILE
from docketlens.sources.snapshots import read_json_catalog, read_snapshot, version_path, write_snapshot
from docketlens.streaming.activity_stream import VERSION, ActivityStream

OPERATION = (
    "claim_id string, user_id string, case_id string, seq bigint, at timestamp_ntz, operation string, status string, provenance string, "
    "confirmation string, submitted_on timestamp_ntz, occurred_on timestamp_ntz, approved_cents bigint, received_cents bigint, source string, note string"
)


def at(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


def operations(spark, *steps):
    names = [c.split()[0] for c in OPERATION.split(", ")]
    rows = []
    for seq, step in enumerate(steps):
        row = dict.fromkeys(names) | {"claim_id": "k", "user_id": "u", "case_id": "c", "seq": seq, "at": at(seq)} | step
        rows.append(tuple(row[n] for n in names))
    return spark.createDataFrame(rows, OPERATION)


def versions(spark, *steps):
    return L.apply_operations(operations(spark, *steps), [F.col("seq")], F.date_trunc("DAY", F.col("at")))


def events(df):
    return L.claim_activity(df, [F.col("seq")], F.date_trunc("HOUR", F.col("at"))).orderBy("occurred_at").collect()


def test_operations_and_activity(spark):
    log = versions(
        spark, {"operation": "status", "status": "started"}, {"operation": "submission", "confirmation": " A-1 "},
        {"operation": "approval", "approved_cents": 900, "source": "user_reported"},
        {"operation": "outcome", "status": "paid", "confirmation": "A-1", "submitted_on": at(1), "approved_cents": 900, "received_cents": 850, "source": "payment_record"},
        {"operation": "outcome", "status": "paid", "confirmation": "A-1", "submitted_on": at(1), "approved_cents": 900, "received_cents": 850, "source": "user_reported"},
        {"operation": "note", "note": " hello "}, {"operation": "denial"},
    )
    rows = log.orderBy("seq").collect()
    assert rows[1]["personal_status"] == "confirmation_recorded" and rows[1]["confirmation_number"] == "A-1"
    assert rows[3]["approved_at"] == at(2) and rows[3]["paid_at"] == at(3)
    # The first payment time stays; the note is trimmed.
    assert rows[4]["paid_at"] == at(3) and rows[5]["private_note"] == "hello"
    found = [(e["event_type"], e["amount_cents"], e["amount_kind"]) for e in events(log)]
    # A changed amount source alone, and a note alone, are no events.
    assert found == [
        ("claim_created", None, None), ("submission_recorded", None, None), ("approval_recorded", 900, "approved"),
        ("payment_recorded", 850, "received"), ("denial_recorded", None, None),
    ]


def test_outcome_rules(spark):
    rows = versions(
        spark, {"operation": "outcome", "status": "approved", "source": "user_reported"}, {"operation": "outcome", "status": "approved", "approved_cents": 0, "source": "user_reported"},
        {"operation": "approval", "occurred_on": at(30)}, {"operation": "outcome", "status": "closed"},
    ).orderBy("seq").collect()
    assert [r["approved_at"] for r in rows] == [at(0), at(0), at(30), at(30)]
    assert [r["amount_source"] for r in rows] == [None, "user_reported", None, None]


def test_activity_stream_equals_the_batch(spark, tmp_path):
    log = versions(
        spark, {"operation": "status", "status": "started"}, {"operation": "submission"}, {"operation": "payment", "received_cents": 5},
        {"operation": "status", "status": "closed"}, {"operation": "denial"},
    ).select(*[c.split()[0] for c in VERSION.split(", ")])
    stream, files = ActivityStream(str(tmp_path / "state")), str(tmp_path / "versions")
    for low, high in ((0, 2), (2, 3), (3, 5)):
        log.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(files)
        query = stream.run(spark, files)
        # One row of state for the one claim, however many batches there were.
        assert [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]][-1] == 1
    streamed = sorted(tuple(r) for r in stream.events(spark).select("event_type", "occurred_at").collect())
    assert streamed == sorted((e["event_type"], e["occurred_at"]) for e in events(log))


def test_activity_stream_keeps_claims_by_buckets(spark, tmp_path, monkeypatch):
    from docketlens.streaming import activity_stream

    monkeypatch.setattr(activity_stream, "BUCKETS", 2)
    log = versions(
        spark, *[{"claim_id": f"k{i % 5}", "operation": "payment" if i % 3 else "status", "status": "started", "received_cents": i} for i in range(40)]
    ).select(*[c.split()[0] for c in VERSION.split(", ")])
    stream, files = ActivityStream(str(tmp_path / "state")), str(tmp_path / "versions")
    for low, high in ((0, 3), (3, 25), (25, 40)):
        log.filter((F.col("seq") >= low) & (F.col("seq") < high)).repartition(3).write.mode("append").parquet(files)
        query = stream.run(spark, files)
    assert [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]][-1] == 2
    shown = ["claim_id", "event_type", "amount_cents", "occurred_at"]
    batch = L.claim_activity(log, [F.col("seq")], F.lit(0)).select(*shown)
    assert sorted(map(repr, stream.events(spark).select(*shown).collect())) == sorted(map(repr, batch.collect()))


def test_a_claim_is_few_blocks(spark):
    from docketlens.plans import claim_ledger

    operated = claim_ledger.operations(spark, "/root/testdata/sf0.001").select("claim_id", claim_ledger._block().alias("block"))
    assert operated.distinct().count() == operated.select("claim_id").distinct().count()


@pytest.mark.parametrize("text, cents", [("12.5", 1250), (" 3 ", 300), ("", None), ("abc", None), ("-1", None), ("1e2", 10000), ("0.005", 1), (None, None), ("12.5d", None)])
def test_cents(spark, text, cents):
    assert spark.createDataFrame([(text,)], "t string").select(L.to_cents(F.col("t"))).first()[0] == cents


def test_starting_an_existing_claim_changes_nothing(spark):
    old = spark.createDataFrame([("u", "c", "paid", 900)], "user_id string, case_id string, personal_status string, received bigint")
    new = spark.createDataFrame([("u", "c", "started", None, 1), ("u", "d", "started", None, 2), ("u", "d", "later", None, 3)], "user_id string, case_id string, personal_status string, received bigint, n int")
    rows = {r["case_id"]: r["personal_status"] for r in L.insert_if_absent(old, new, ["user_id", "case_id"], [F.col("n")]).collect()}
    assert rows == {"c": "paid", "d": "started"}
    assert {r["case_id"]: r["personal_status"] for r in L.upsert_latest(old, new, ["user_id", "case_id"], [F.col("n")]).collect()} == {"c": "started", "d": "later"}


def test_purge_and_delete(spark):
    claims = spark.createDataFrame([("k1", "u1"), ("k2", "u2")], "claim_id string, user_id string")
    log = spark.createDataFrame([(1, "k1", "u1"), (2, "k1", "u2"), (3, "k2", "u2")], "event_id int, claim_id string, user_id string")
    kept = L.purge_subjects({"claims": claims, "claim_events": log}, spark.createDataFrame([("u1",)], "user_id string"))
    assert [r["claim_id"] for r in kept["claims"].collect()] == ["k2"] and [r["event_id"] for r in kept["claim_events"].collect()] == [3]
    assert [r["event_id"] for r in L.orphan_events(log, claims).collect()] == [2]
    assert L.admitted_events(log, claims).count() == 2
    foreign = spark.createDataFrame([("k1", "u2")], "claim_id string, user_id string")
    assert L.delete_owned(claims, foreign, ["claim_id"]).count() == 2


def test_event_limit(spark):
    log = spark.createDataFrame([(i, "k", "u", at(i)) for i in range(9)], "event_id int, claim_id string, user_id string, occurred_at timestamp_ntz")
    assert sorted(r["event_id"] for r in L.newest_events(log, 3).collect()) == [6, 7, 8]
    for bad in (0, 501, 2.5):
        with pytest.raises(ValueError, match="1 through 500"):
            L.newest_events(log, bad)


def test_profile_seed(spark):
    users = spark.createDataFrame(
        [("1", "A@x.org", '{"full_name": " Ann "}'), ("2", "id@Accounts.Example.invalid", '{"full_name": " ", "name": "Bo"}'), ("3", None, None)], "user_id string, email string, metadata string"
    )
    rows = {r["user_id"]: (r["full_name"], r["contact_email"]) for r in L.seed_profiles(users, "@accounts.example.invalid").collect()}
    assert rows == {"1": ("Ann", "A@x.org"), "2": ("Bo", ""), "3": ("", "")}


def test_quality_rules(spark):
    names = [c.split()[0] for c in CLAIM.split(", ")]
    good = dict.fromkeys(names) | {"claim_id": "1", "user_id": "u", "case_id": "c", "personal_status": "started", "status_provenance": "user_reported"}
    bad = [
        good | {"personal_status": "paid"}, good | {"personal_status": "other"}, good | {"approved_amount_cents": -1}, good | {"case_id": ""},
        good | {"paid_at": at(0), "submitted_at": at(1)}, good | {"amount_source": "rumour"},
    ]
    rows = spark.createDataFrame([tuple(r[n] for n in names) for r in [good, *bad]], CLAIM)
    accepted, rejected = E.split_quarantine(rows, E.claim_rules())
    assert accepted.count() == 1
    assert sorted(r["broken_rules"][0] for r in rejected.collect()) == [
        "amount_source_check", "approved_amount_nonnegative", "case_id_length", "paid_after_submission", "paid_status_has_date", "personal_status_check"
    ]
    counts = {r["rule"]: r["violations"] for r in E.violation_counts(rows, E.claim_rules(), "t").collect()}
    assert sum(counts.values()) == 6 and counts["note_length"] == 0
    profile = dict.fromkeys([c.split()[0] for c in PROFILE.split(", ")], "") | {"user_id": "3f2504e0-4f89-41d3-9a0c-0305e82c3301", "country_code": "us"}
    people = spark.createDataFrame([tuple(profile.values())], PROFILE)
    assert [r["broken_rules"] for r in E.split_quarantine(people, E.profile_rules())[1].collect()] == [["country_code_format"]]


def test_snapshots(spark, tmp_path):
    schema, path = "id string, n int", version_path(str(tmp_path), 1)
    assert read_snapshot(spark, path, schema).count() == 0
    write_snapshot(spark.createDataFrame([("a", 1)], schema), path)
    assert [tuple(r) for r in read_snapshot(spark, path, schema).collect()] == [("a", 1)]
    with pytest.raises(Exception, match="unsupported schema version"):
        read_snapshot(spark, path, schema, schema_version=2).collect()
    catalog = tmp_path / "catalog.json"
    assert read_json_catalog(spark, str(catalog), "id string, n int").count() == 0
    catalog.write_text('{"schemaVersion": 1, "records": [{"id": "a", "n": 3}]}')
    assert [tuple(r) for r in read_json_catalog(spark, str(catalog), "id string, n int").collect()] == [("a", 3)]
    catalog.write_text('{"schemaVersion": 7, "records": [{"id": "a", "n": 3}]}')
    with pytest.raises(Exception, match="unsupported schema version"):
        read_json_catalog(spark, str(catalog), "id string, n int").collect()


def test_refused_amounts_and_confirmations(spark):
    amounts = spark.createDataFrame([("1e300",), ("90071992547409.5",), ("90071992547500",), ("\u00a05\t",), ("",)], "a string")
    got = [(r["c"], r["bad"]) for r in amounts.select(L.to_cents(F.col("a")).alias("c"), L.invalid_amount(F.col("a")).alias("bad")).collect()]
    assert got == [(None, True), (9007199254740950, False), (None, True), (500, False), (None, False)]
    ops = spark.createDataFrame([("confirmation", " \u00a0"), ("confirmation", None), ("submission", ""), ("confirmation", "A-1"), ("outcome", "x" * 251)], "operation string, confirmation string")
    assert [r[0] for r in ops.select(L.refusal(F.lit(False))).collect()] == ["confirmation_required", "confirmation_required", None, None, "confirmation_too_long"]


def test_listings_are_newest_first_and_notes_are_checked(spark):
    rows = [("u", "a", "2024-01-01 10:00:00"), ("u", "c", "2024-01-02 09:00:00"), ("u", "b", "2024-01-02 09:00:00"), ("u", "d", None), ("v", "e", "2023-01-01 00:00:00")]
    claims = spark.createDataFrame(rows, "user_id string, claim_id string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    listed = L.newest_first(claims, "at", "claim_id").orderBy("user_id", "position").collect()
    assert [(r["claim_id"], r["position"]) for r in listed] == [("b", 1), ("c", 2), ("a", 3), ("d", 4), ("e", 1)]
    notes = spark.createDataFrame([(1, " kept\n"), (2, " \u00a0"), (3, None), (4, "x" * 5001), (5, "x" * 5000)], "claim_id int, note string")
    found = {r["claim_id"]: (r["event_type"], r["refusal"], len(r["note"] or "")) for r in L.note_events(notes).collect()}
    assert found == {
        1: ("note_added", None, 4), 2: (None, "note_required", 0), 3: (None, "note_required", 0),
        4: (None, "note_too_long", 0), 5: ("note_added", None, 5000),
    }


def test_operations_are_parsed_once_a_scan(spark):
    """Props and amounts are parsed in one place of the plan for each of two scans, and claims are joined with nothing but their blocks."""
    from docketlens.plans import claim_ledger

    plan = claim_ledger.ledger_apply(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(") == 2 and plan.count("try_cast") + plan.count("double") < 30
    assert plan.count("Join ") == 1


def test_first_outcome_offers_its_time_across_blocks(spark):
    days = [{"operation": "outcome", "status": "approved", "approved_cents": 1, "source": "user_reported"}, *[{"operation": "note", "note": "n"}] * 30]
    log = versions(spark, *days, {"operation": "outcome", "status": "approved"}, {"operation": "outcome", "status": "paid"}).orderBy("seq").collect()
    assert {r["approved_at"] for r in log} == {at(0)}
    assert [r["paid_at"] for r in log[-2:]] == [None, at(32)]
