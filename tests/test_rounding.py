"""Figures that lie half-way between two shown values."""

import datetime as dt

from worktide.operators import flows, hours


def test_load_of_a_tie_is_rounded_up(spark):
    rows = spark.createDataFrame([("o", dt.date(2024, 1, 2 + i), h) for i, h in enumerate((7.45, 7.45, 7.45, 7.45, 7.46))], "owner string, day date, hours double")
    got = hours.monthly_load(rows, "2024-01-01", "2024-01-31").first()
    assert (got["workdays"], got["mm"], got["load_pct"]) == (23, 0.203, 20.3)  # 37.26 of 184 hours


def test_share_of_a_tie_is_rounded_up(spark):
    rows = [(1, 0, "a", "p", "holder design", "", ["draw"], 4.05, 1.0), (2, 0, "b", "p", "holder design", "", ["draw"], 4.59, 0.0)]
    schema = "id long, source int, owner string, project string, detail string, role string, steps array<string>, mm double, ax double"
    got = flows.flow_summary(spark.createDataFrame(rows, schema)).collect()
    assert [(r["mm"], r["ax"]) for r in got] == [(8.64, 0.4688)]  # 15 of 32
