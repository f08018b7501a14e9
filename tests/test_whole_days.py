"""Whole days and solver nights: known cases worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from worktide.operators import solver_nights as N, whole_days as D
from worktide.plans.days import whole_day_hours

WED, SAT = dt.date(2024, 1, 10), dt.date(2024, 1, 13)
SCHEMAS = {
    "sessions": "owner string, day date, a double, b double", "meetings": "owner string, day date, a double, b double, block boolean, away boolean, accepted boolean, carried boolean", "sampler": "owner string, day date, kind string, a double, b double",
    "machine": "owner string, day date, a double, b double, measured boolean", "machine_days": "owner string, day date, on_h double, night_h double, first_min double, last_min double", "points": "owner string, day date, minute int, productive boolean, solver boolean",
    "solver": "owner string, day date, a double, b double", "offsite": "owner string, day date", "manual": "owner string, day date, hours double", "absence": "owner string, day date, frac double", "leave": "owner string, day date, a double, b double",
}


@pytest.fixture(scope="module")
def cases(spark):
    """Each case is an owner of its own; all run in one table."""
    rows = {k: [] for k in SCHEMAS}

    def add(owner, day, **inputs):
        for k, values in inputs.items():
            rows[k] += [(owner, day, *v) for v in values]

    add("meetings", WED, meetings=[(540.0 + 90 * i, 600.0 + 90 * i, False, False, True, False) for i in range(4)])
    add("floor", WED, points=[(600, True, False)], sessions=[(590.0, 610.0)], machine=[(540.0, 1020.0, True)], machine_days=[(8.0, 0.0, 540.0, 1020.0)])
    add("passive", WED, points=[(600, False, False)], sessions=[(590.0, 610.0)], machine=[(540.0, 1020.0, True)], machine_days=[(8.0, 0.0, 540.0, 1020.0)])
    add("sleep", WED, points=[(600, True, False)], sessions=[(590.0, 610.0)], machine=[(540.0, 1020.0, False)], machine_days=[(5.0, 0.0, 540.0, 1020.0)])
    add("evening", WED, points=[(600, True, False), (1260, True, False)], sessions=[(590.0, 610.0), (1255.0, 1265.0)], machine=[(540.0, 1300.0, True)], machine_days=[(12.67, 2.67, 540.0, 1300.0)])
    add("carried", SAT, meetings=[(0.0, 60.0, False, False, False, True)], sessions=[(600.0, 620.0)])
    add("saturday", SAT, points=[(600, True, False), (660, True, False)], machine=[(540.0, 900.0, True)], machine_days=[(6.0, 0.0, 540.0, 900.0)])
    add("bridge", WED, sampler=[("active", 540.0, 600.0), ("active", 640.0, 700.0), ("cover", 540.0, 700.0)])
    add("offsite", WED, offsite=[()])
    add("manual", WED, manual=[(3.5,)])
    add("leave", WED, absence=[(1.0,)], points=[(600, True, False)], sessions=[(590.0, 620.0)])
    add("half", WED, absence=[(0.5,)], leave=[(780.0, 1020.0)], points=[(600, True, False)], sessions=[(590.0, 610.0)], machine=[(540.0, 1020.0, True)], machine_days=[(8.0, 0.0, 540.0, 1020.0)])
    add("solver", WED, solver=[(0.0, 240.0)])
    add("always", WED, points=[(600, True, False), (900, True, False)], sessions=[(590.0, 610.0), (890.0, 910.0)], machine=[(0.0, 1440.0, True)], machine_days=[(24.0, 13.0, 0.0, 1440.0)])
    frames = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}
    return {r["owner"]: r for r in D.whole_days(**frames).collect()}, len(rows)


def test_known_days(cases):
    found, _ = cases
    hours = {k: r["hours"] for k, r in found.items()}
    assert hours["meetings"] - found["meetings"]["floor_h"] == 4.0 and hours["meetings"] == 6.5 and found["meetings"]["basis"] == "trace"  # no record: 8:30 to 15:00, lunch met
    assert hours["floor"] == round((480 - 10 - 10 - 60) / 60, 2)  # both idle edges trimmed, untouched lunch off
    assert hours["passive"] == round(20 / 60, 2) and found["passive"]["floor_h"] == 0
    assert hours["sleep"] == 5.0 and found["sleep"]["basis"] == "window"  # 7.67 h less 2.67 h asleep, of which lunch explains one
    assert found["evening"]["credit_h"] == round(140 / 60, 2) and found["evening"]["night_h"] == 2.5
    assert hours["carried"] == 1.0 and not found["carried"]["active"]
    assert hours["saturday"] == round((690 - 570) / 60, 2) and found["saturday"]["weekend_h"] == hours["saturday"]
    assert found["bridge"]["bridge_h"] == round(40 / 60, 2) and hours["bridge"] == round(160 / 60, 2)
    assert hours["offsite"] == 8.0 and found["offsite"]["least_h"] == 8.0
    assert hours["manual"] == 3.5
    assert found["leave"]["anomalies"] == "work on a day of absence" and hours["leave"] == 0.5
    assert hours["half"] == round((780 - 550 - 60) / 60, 2)  # leave from 13:00 on
    assert found["solver"]["solver_h"] == 4.0 and hours["solver"] == 4.0 and found["solver"]["floor_h"] == 0
    assert found["always"]["basis"] == "always_on" and hours["always"] == round((930 - 570 - 60) / 60, 2)


def night(spark, outputs=(), people=(), views=(), spans=(), **how):
    frame = lambda rows: spark.createDataFrame([("o", *r) for r in rows], "owner string, day date, a double, b double")
    return sorted((str(r["day"]), r["a"], r["b"]) for r in N.by_day(N.solver_nights(*map(frame, (outputs, people, views, spans)), **how)).collect())


def test_nights(spark):
    thu = dt.date(2024, 1, 11)
    late, early = (WED, 1200.0, 1200.0), (thu, 120.0, 120.0)
    assert night(spark, [early], [late]) == [("2024-01-10", 1320.0, 1440.0), ("2024-01-11", 0.0, 120.0)]  # 6 h held to the last 4
    assert night(spark, [early], [late], [(thu, 300.0, 300.0)]) == [("2024-01-10", 1200.0, 1440.0), ("2024-01-11", 0.0, 120.0)]  # looked at afterwards
    assert night(spark, [early], [late], unlock=False, cap_h=0.0) == [("2024-01-10", 1200.0, 1440.0), ("2024-01-11", 0.0, 120.0)]
    assert night(spark, [early]) == []  # one output and nobody before it
    assert night(spark, [(WED, 600.0, 700.0)], [(WED, 590.0, 590.0)]) == []  # by day
    assert night(spark, [early], [late], mode="anchor") == [("2024-01-11", 120.0, 150.0)]
    machine = spark.createDataFrame([("o", WED, 1380.0, 1440.0)], "owner string, day date, a double, b double")
    assert night(spark, [early], [late], machine=machine) == [("2024-01-10", 1380.0, 1440.0)]
    two = [(WED, 300.0, 300.0), (WED, 1410.0, 1410.0)]
    assert night(spark, two, [(WED, 120.0, 120.0), (WED, 1170.0, 1170.0)]) == [("2024-01-10", 1170.0, 1410.0)]  # two nights of one date: four hours in all, the later kept


def test_day_of_just_16_hours_is_not_long(spark, tmp_path):
    """7.75 h by day and 8.25 h at night, whose pieces' sum is 16.000000000000004 in doubles."""
    rows = [
        (140477, "2024-01-08 00:34:50", 779, "click"), (147558, "2024-01-08 09:03:18", 779, "click"), (160005, "2024-01-08 23:47:06", 779, "signup"), (161365, "2024-01-09 01:22:35", 779, "click"), (180027, "2024-01-09 23:53:25", 779, "error"), (195423, "2024-01-10 18:19:37", 779, "purchase"),
        (561744, "2024-01-29 02:07:37", 6910, "purchase"), (566413, "2024-01-29 07:40:37", 6910, "view"), (573408, "2024-01-29 15:55:25", 6910, "error"), (579963, "2024-01-29 23:53:48", 6910, "signup"),
    ]
    events = spark.createDataFrame([(*r, 0.0, "{}") for r in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    days = {(r["owner"], str(r["day"])): r for r in whole_day_hours(spark, str(tmp_path)).collect()}
    for key in ((779, "2024-01-09"), (6910, "2024-01-29")):
        assert (days[key]["hours"], days[key]["day_h"], days[key]["night_h"], days[key]["long_day"]) == (16.0, 7.75, 8.25, False)
