import json

import pytest
from pyspark.sql import functions as F

from docketlens.operators import dockets as D
from docketlens.sources.schemas import DOCKET, DOCKET_FILING, HIT_PAGE
from docketlens.sources.search_hits import hits_of, read_hits
from docketlens.streaming.docket_stream import DocketStream


def hit(docket_id, filed="2026-08-03", ended=None, description="Class Action Complaint", name="Gamma v. Bank", **extra):
    return {
        "docket_id": docket_id, "caseName": name, "docketNumber": f"3:26-cv-{docket_id}", "court": "District Court", "court_id": "exd",
        "dateFiled": filed, "dateTerminated": ended, "cause": "28:1332 Diversity", "suitNature": None,
        "docket_absolute_url": f"/docket/{docket_id}/x/",
        "recap_documents": [{
            "id": docket_id * 10, "docket_entry_id": docket_id * 100, "document_number": 1, "entry_date_filed": filed,
            "description": description, "document_type": "PACER Document", "is_available": True, "absolute_url": f"/docket/{docket_id}/1/",
        }],
    } | extra


def page(*hits):
    return json.dumps({"count": len(hits), "next": None, "previous": None, "results": list(hits)})


def normalized(spark, *hits, at="t1"):
    pages = spark.read.schema(HIT_PAGE).json(spark.sparkContext.parallelize([page(*hits)], 1))
    return D.normalize_hits(hits_of(pages), at)


@pytest.mark.parametrize("description, accepted", [
    ("Class Action Complaint", True),
    ("CLASS AND COLLECTIVE ACTION COMPLAINT for damages", True),
    ("Second Amended  Class Action Complaint", True),
    ("Complaint over rent; a class of tenants is named elsewhere", False),
    ("COMPLAINT by a Customer. (CLASS ACTION) (Attachments: # 1 Summons)", True),
    ("Complaint (Attachments: # 1 class action exhibit)", False),
    ("First amended complaint, collective and R. 23 class action", True),
    ("Answer mentioning a class action", False),
    ("Complaint about a subclass action", False),
    (None, False),
])
def test_complaint_classifier(spark, description, accepted):
    row = spark.createDataFrame([(description,)], "d string")
    assert row.select(D.is_class_complaint(F.col("d"))).first()[0] is accepted


def test_normalization_and_rejection(spark):
    rows = normalized(
        spark, hit(1), hit(0), hit(-4), hit(2**53), hit(2, description="Motion"), hit(3, ended="2026-02-30"),
        hit(4, docket_absolute_url="https://elsewhere.example/x", name=" "),
    ).collect()
    found = {r["docket_id"]: r for r in rows}
    assert sorted(found) == [1, 3, 4]
    assert found[1]["termination_state"] == "termination_not_reported" and found[1]["active"]
    assert found[3]["date_terminated"] is None
    assert found[4]["docket_url"] == "https://www.courtlistener.com/docket/4/"
    assert found[4]["case_name"] == "Unnamed federal matter"
    assert found[1]["matched_filings"][0]["url"] == "https://www.courtlistener.com/docket/1/1/"


def test_batch_dedupe_keeps_a_known_termination(spark):
    batch = normalized(spark, hit(1, ended="2026-08-05"), hit(1, name="Later v. Name"))
    row = D.dedupe_dockets(batch).first()
    assert row["case_name"] == "Later v. Name" and str(row["date_terminated"]) == "2026-08-05"
    # The state is the later hit's, unless asked to follow the date.
    assert row["active"] is True
    assert D.dedupe_dockets(batch, recompute_active=True).first()["active"] is False
    assert D.filings_of(batch).count() == 1


def merge(spark, previous, observed, at, degraded=False):
    old, old_filings = previous
    return D.merge_dockets(old, old_filings, D.dedupe_dockets(observed), D.filings_of(observed), at, degraded)


def test_three_runs(spark):
    empty = spark.createDataFrame([], DOCKET), spark.createDataFrame([], DOCKET_FILING)
    first = merge(spark, empty, normalized(spark, hit(301), at="t1"), "t1")
    second = merge(spark, first, normalized(spark, hit(301, ended="2026-08-09"), hit(302), at="t2"), "t2")
    rows = {r["docket_id"]: r for r in second[0].collect()}
    assert len(rows) == 2 and str(rows[301]["date_terminated"]) == "2026-08-09" and rows[301]["active"] is False
    assert (rows[301]["first_seen_at"], rows[301]["last_seen_at"], rows[301]["last_changed_at"]) == ("t1", "t2", "t2")
    # A run that reports no termination keeps the known one; nothing else changed.
    third = merge(spark, second, normalized(spark, hit(301), at="t3"), "t3")
    row = third[0].filter("docket_id = 301").first()
    assert row["active"] is False and row["last_changed_at"] == "t2" and row["last_seen_at"] == "t3"
    failed = merge(spark, third, normalized(spark, hit(0), at="t4"), "t4", degraded=True)
    assert {r["freshness"] for r in failed[0].collect()} == {"stale"} and failed[0].count() == 2
    # A healthy run leaves unseen records as they are, stale ones too.
    healthy = merge(spark, failed, normalized(spark, hit(302), at="t5"), "t5")
    assert {r["docket_id"]: r["freshness"] for r in healthy[0].collect()} == {301: "stale", 302: "current"}


def test_changed_filings_count_as_a_change(spark):
    empty = spark.createDataFrame([], DOCKET), spark.createDataFrame([], DOCKET_FILING)
    first = merge(spark, empty, normalized(spark, hit(1), at="t1"), "t1")
    changed = hit(1)
    changed["recap_documents"][0]["description"] = "Amended Class Action Complaint"
    second = merge(spark, first, normalized(spark, changed, at="t2"), "t2")
    assert second[0].first()["last_changed_at"] == "t2"
    assert [r["description"] for r in second[1].collect()] == ["Amended Class Action Complaint"]


def test_malformed_page_fails(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"count": 1, "next": null}')
    with pytest.raises(Exception, match="unexpected response shape"):
        read_hits(spark, str(tmp_path)).collect()


def test_stream_resumes_and_repeated_batches_take_effect_once(spark, tmp_path):
    pages, state = tmp_path / "pages", str(tmp_path / "state")
    pages.mkdir()
    stamps = ["t1", "t2", "t3"]
    stream = DocketStream(state)
    (pages / "a.json").write_text(page(hit(301)))
    stream.run(spark, str(pages), lambda b: stamps[b])
    (pages / "b.json").write_text(page(hit(301, ended="2026-08-09"), hit(302)))
    DocketStream(state).run(spark, str(pages), lambda b: stamps[b])
    rows = {r["docket_id"]: r for r in stream.current(spark).collect()}
    assert rows[301]["first_seen_at"] == "t1" and rows[301]["active"] is False and rows[302]["first_seen_at"] == "t2"
    totals = stream.totals(spark).first()
    assert (totals["runs"], totals["raw_results_seen_total"], totals["accepted_results_total"]) == (2, 3, 3)
    # The same batch again, as after a lost driver.
    again = spark.read.schema(HIT_PAGE).json(str(pages / "b.json"))
    stream.merge_batch(again, 1, "t2")
    assert stream.totals(spark).first()["runs"] == 2
    assert sorted(map(str, stream.current(spark).collect())) == sorted(map(str, rows.values()))
    # A degraded run without results turns every record stale.
    (pages / "c.json").write_text(page())
    stream.run(spark, str(pages), lambda b: stamps[b], degraded=lambda b: b == 2)
    assert {r["freshness"] for r in stream.current(spark).collect()} == {"stale"}


def test_descriptions_are_read_as_they_are(spark):
    """Only a header is cleaned, however much white space it has; no whole text is folded or cleaned to be judged."""
    assert "lower(" not in str(D.is_class_complaint(F.col("d")))
    far = "Complaint" + " \t\n" * 3000 + "for a class  \taction"
    cut = "Complaint " + "x" * 585 + " class action"
    rows = spark.createDataFrame([(far,), (cut,), (" Third\n Amended  complaint, class action",), ("so a CLASS \t and\ncollective  Action　complaint",), ("subclass action complaint",), (None,)], "d string")
    assert [r[0] for r in rows.select(D.is_class_complaint(F.col("d"))).collect()] == [True, False, True, True, False, False]
