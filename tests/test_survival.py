import os

import pytest
from pyspark.sql import functions as F

from docketlens.functions.dates import extract_date
from docketlens.operators import survival as S
from docketlens.sources.court_extract import ROW_ORDER, read_court_extract

# DOCKET, ORIGIN, FILEDATE, CLASSACT, MDLDOCK, TERMDATE, TRCLACT, DISP, STATUSCD, TAPEYEAR
ROWS = [
    ("2000001", "1", "01/01/2020", "1", "-8", "01/11/2020", "3", "13", "L", "2020"),
    ("2000001", "4", "01/12/2020", "1", "-8", "01/16/2020", "-8", "6", "L", "2020"),
    ("2000002", "2", "01/01/2020", "1", "-8", "01/21/2020", "2", "6", "L", "2020"),
    ("2000003", "1", "01/01/2020", "1", "-8", "01/01/1900", "-8", "-8", "S", "2099"),
    ("2000004", "6", "01/01/2020", "1", "1234", "01/06/2020", "3", "13", "L", "2020"),
    ("2000005", "13", "01/01/2020", "1", "1234", "01/01/1900", "-8", "-8", "S", "2099"),
    ("2000006", "1", "01/01/2020", "-8", "-8", "01/03/2020", "-8", "13", "L", "2020"),
]
SNAPSHOT = "2020-01-31"
ALL, REST, MDL, GRANTED, GRANTED_REST = [name for name, _ in [
    ("class_alleged_all_origins", 0), ("class_alleged_excluding_mdl_transfer_origins", 0),
    ("class_alleged_mdl_transfer_origins", 0), ("class_certification_granted_all_origins", 0),
    ("class_certification_granted_excluding_mdl_transfer_origins", 0),
]]
# (cohort, clock): n, events, censored, p25, median, p75, survival at the end
EXPECTED = {
    (ALL, "lifecycle"): (5, 3, 2, 15, 20, None, 0.4),
    (ALL, "settlement"): (5, 2, 3, 10, None, None, 0.6),
    (REST, "lifecycle"): (3, 2, 1, 15, 20, None, 0.333333),
    (REST, "settlement"): (3, 1, 2, 10, None, None, 0.666667),
    (MDL, "lifecycle"): (2, 1, 1, 5, 5, None, 0.5),
    (MDL, "settlement"): (2, 1, 1, 5, 5, None, 0.5),
    (GRANTED, "lifecycle"): (2, 2, 0, 5, 5, 15, 0.0),
    (GRANTED, "settlement"): (2, 2, 0, 5, 5, 10, 0.0),
    (GRANTED_REST, "lifecycle"): (1, 1, 0, 15, 15, 15, 0.0),
    (GRANTED_REST, "settlement"): (1, 1, 0, 10, 10, 10, 0.0),
}


def write_extract(folder, rows, blank_lines=True):
    lines = ["﻿" + "\t".join(S.REQUIRED_COLUMNS)]
    for docket, origin, filed, cls, mdl, term, tr, disp, status, tape in rows:
        cells = ["1", "01", "1", docket, origin, filed, "1", "190", cls, mdl, term, tr, disp, status, tape]
        lines.append("\t".join(cells))
        if blank_lines:
            lines.append("   ")
    path = os.path.join(folder, "extract.tsv")
    with open(path, "w", encoding="utf-8") as out:
        out.write("\r\n".join(lines))
    return str(path)


def analysed(spark, path, certified=True):
    rows = S.classify_rows(read_court_extract(spark, path), SNAPSHOT)
    lives = S.collapse_dockets(rows, ROW_ORDER, SNAPSHOT)
    cohorts = S.cohort_definitions(certified)
    members = S.with_cohorts(lives, cohorts)
    return rows, lives, members, cohorts


def test_extract_to_all_cohorts(spark, tmp_path):
    rows, _, members, cohorts = analysed(spark, write_extract(tmp_path, ROWS))
    got = S.complete_cohorts(S.kaplan_meier(S.observations(members), ["cohort", "clock"]), cohorts).collect()
    found = {
        (r["cohort"], r["clock"]): (
            r["n"], r["events"], r["censored"], r["p25_days"], r["median_days"], r["p75_days"], r["survival_at_end"]
        )
        for r in got
    }
    assert found == EXPECTED
    counters = S.row_accounting(rows)
    row = counters.first()
    assert (row["rows_read"], row["class_rows"], row["explicit_pending_rows"], row["sentinel_rows"]) == (7, 6, 2, 2)
    assert row["repeated_rows_collapsed"] == 1 and row["unreconciled_rows"] == 0
    S.check_accounting(counters)


def test_three_cohorts_without_the_certified_option(spark, tmp_path):
    _, _, members, cohorts = analysed(spark, write_extract(tmp_path, ROWS), certified=False)
    assert len(cohorts) == 3
    counts = {r["cohort"]: r["mdl_docket_present"] for r in S.cohort_counts(members).collect()}
    assert counts == {ALL: 2, REST: 0, MDL: 2}


def test_user_cohorts_are_predicates(spark, tmp_path):
    _, lives, _, _ = analysed(spark, write_extract(tmp_path, ROWS))
    own = S.with_cohorts(lives, [("long", F.col("lifecycle_days") > 10)])
    assert own.count() == 4


def test_row_order_does_not_matter_except_for_ties(spark, tmp_path):
    expected = None
    for n in (1, 3):
        rows, _, members, _ = analysed(spark, write_extract(tmp_path, ROWS))
        shuffled = S.kaplan_meier(S.observations(members.repartition(n)), ["cohort", "clock"])
        found = sorted(map(tuple, shuffled.collect()), key=str)
        assert expected is None or found == expected
        expected = found


def test_earliest_row_wins_a_tied_termination(spark, tmp_path):
    tied = [list(ROWS[2]), list(ROWS[2])]
    tied[0][7], tied[1][7] = "12", "6"
    _, lives, _, _ = analysed(spark, write_extract(tmp_path, tied))
    assert [r["final_disposition"] for r in lives.collect()] == ["12"]


def test_ragged_rows_and_missing_columns(spark, tmp_path):
    path = os.path.join(tmp_path, "ragged.tsv")
    with open(path, "w") as out:
        out.write("\t".join(S.REQUIRED_COLUMNS) + "\n1\t01\t1\t5\t1\t01/01/2020\t1\t190\t1\n")
    rows = S.classify_rows(read_court_extract(spark, path), SNAPSHOT)
    assert [r["row_status"] for r in rows.collect()] == ["ambiguous_endpoint"]
    with open(path, "w") as out:
        out.write("CIRCUIT\tDOCKET\n1\t2\n")
    with pytest.raises(ValueError, match="lacks required columns: DISTRICT"):
        read_court_extract(spark, path)


@pytest.mark.parametrize("filed, term, status", [
    ("02/31/2020", "01/05/2020", "invalid_filing_date"),
    ("01/01/2020", "13/45/2000", "invalid_termination_date"),
    ("01/01/2020", "-8", "ambiguous_endpoint"),
    ("01/01/2020", "", "ambiguous_endpoint"),
    ("01/01/2020", "01/01/1900", "negative_or_post_snapshot"),
    ("01/01/2020", "02/01/2020", "negative_or_post_snapshot"),
    ("01/01/2020", "01/01/2020", "valid"),
    ("02/01/2020", None, "negative_or_post_snapshot"),
])
def test_row_cascade(spark, filed, term, status):
    values = {c: "1" for c in S.REQUIRED_COLUMNS} | {"FILEDATE": filed, "TERMDATE": term, "STATUSCD": "L" if term is not None else "S", "TAPEYEAR": "2020"}
    row = spark.createDataFrame([tuple(values[c] for c in S.REQUIRED_COLUMNS)], ", ".join(f"{c} string" for c in S.REQUIRED_COLUMNS))
    assert S.classify_rows(row, SNAPSHOT).first()["row_status"] == status


def test_curve_with_censoring(spark):
    seen = spark.createDataFrame([(10, True), (15, False), (20, True), (30, False)], "days int, event boolean").withColumn("g", F.lit(1))
    curve = S.survival_curve(S.survival_buckets(seen, ["g"]), ["g"]).orderBy("days").collect()
    assert [r["survival"] for r in curve] == [0.75, 0.75, 0.375, 0.375]
    assert [r["at_risk"] for r in curve] == [4, 3, 2, 1]
    summary = S.kaplan_meier(seen, ["g"]).first()
    assert (summary["n"], summary["events"], summary["censored"]) == (4, 2, 2)
    assert (summary["p25_days"], summary["median_days"], summary["p75_days"], summary["survival_at_end"]) == (10, 20, None, 0.375)


def test_bad_durations_raise(spark):
    for days in (-1.0, 1.5):
        seen = spark.createDataFrame([(days, True)], "days double, event boolean").withColumn("g", F.lit(1))
        with pytest.raises(Exception, match="non-negative integers"):
            S.survival_buckets(seen, ["g"]).collect()


def test_unreconciled_rows_raise(spark):
    bad = spark.createDataFrame([(1, 0, 0)], "unreconciled_rows int, explicit_pending_rows int, pending_dockets int")
    with pytest.raises(ValueError, match="differs by 1"):
        S.check_accounting(bad)
    lost = spark.createDataFrame([(0, 2, 0)], "unreconciled_rows int, explicit_pending_rows int, pending_dockets int")
    with pytest.raises(ValueError, match="no censored"):
        S.check_accounting(lost)


@pytest.mark.parametrize("text, expected", [
    ("03/31/2026", "2026-03-31"), ("2026-03-31", "2026-03-31"), ("02/31/2026", None), ("-8", None), ("", None),
    ("2/1/2026", None), ("0050-01-01", None), (" 01/02/2024 ", "2024-01-02"), (None, None),
])
def test_extract_dates(spark, text, expected):
    date = spark.createDataFrame([(text,)], "t string").select(extract_date(F.col("t")).cast("string")).first()[0]
    assert date == expected


def test_a_docket_that_is_not_pending_must_have_an_end(spark):
    lives = spark.createDataFrame([("a", False, "2020-01-01"), ("b", True, None)], "docket_key string, pending boolean, final_terminated_at string")
    S.check_lifecycles(lives)
    with pytest.raises(ValueError, match="has no end"):
        S.check_lifecycles(lives.withColumn("pending", F.lit(False)))


def test_rows_are_parsed_once(spark):
    """Each raw cell is stripped once for all that is derived from it, and three audited runs join the extract once."""
    from docketlens.plans import docket_survival, published

    plan = docket_survival.lifecycles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    generators = [line for line in plan.splitlines() if "Generate inline" in line]
    assert len(generators) == 2 and all(line.count("btrim") + line.count("trim(both") <= 5 for line in generators)
    told = published.audited_lifecycles(spark, "/root/testdata/sf0.001")
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString() and told.count() == 3
