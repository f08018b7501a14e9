"""Queries and operators over inputs on which a part of the job would show."""

import datetime as dt
import random
from collections import Counter

from worktide.operators import sessions
from worktide.plans import registry

EVENTS = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string"


def events(spark, path, rows):
    """A folder whose events are (user_id, ts, event_type)."""
    table = [(i, u, ts, kind, 1.0, None) for i, (u, ts, kind) in enumerate(rows)]
    spark.createDataFrame(table, EVENTS).write.mode("overwrite").parquet(f"{path}/events.parquet")
    return str(path)


def test_program_usage_counts_every_click_and_error(spark, tmp_path):
    kinds = ["click", "click", "error", "view", "error", "click", "error"]
    rows = [(i % 5, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), kinds[i % 7]) for i in range(60)] + [(9, dt.datetime(2024, 1, 9), "click"), (8, dt.datetime(2024, 1, 9), "error")]
    want = {u: tuple(Counter(k for v, _, k in rows if v == u)[k] for k in ("click", "error")) for u in (0, 1, 2, 3, 4, 8, 9)}
    got = registry.QUERIES["program_usage_full_outer"](spark, events(spark, tmp_path, rows)).collect()
    assert {r["user_id"]: (r["front"], r["back"]) for r in got} == want


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def paired(rows):
    """The spans of one owner's (time, kind) rows, by the rules of power_spans."""
    out, opened = [], None
    for t, kind in sorted(rows):
        if opened is not None and (kind == "off" or (kind == "boot" and (t - opened) // dt.timedelta(seconds=1) > 1800)):
            out.append((opened, min(t, opened + dt.timedelta(hours=20))))
            opened = None
        if kind != "off" and opened is None:
            opened = t
    return sorted(x for x in out if x[0] < x[1])


def test_power_spans_hold_no_owner_in_one_row(spark):
    r, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(o, start + dt.timedelta(seconds=r.randrange(40_000_000)), r.choice(kinds)) for o, kinds, n in (("all", ["on", "off", "boot"], 30_000), ("boots", ["boot"], 5_000), (None, ["on", "off"], 50)) for _ in range(n)]
    frame = spark.createDataFrame(rows, "owner string, ts timestamp_ntz, kind string").repartition(5)
    found = sessions.power_spans(frame, ["owner"], "ts", "kind")
    assert "collect_list" not in plan(found) and "collect_set" not in plan(found)
    got = found.collect()
    for owner in ("all", "boots", None):
        assert sorted((x["start"], x["end"]) for x in got if x["owner"] == owner) == paired([(t, k) for o, t, k in rows if o == owner])


def test_repeated_signals_are_held_once(spark):
    rows = [("o", dt.date(2024, 1, 2), 540 + 5 * (i % 60), ("click", "view")[i % 2], 20.0, i % 2 == 0, i % 2 == 0) for i in range(60)]
    signals = spark.createDataFrame(rows, "owner string, day date, minute int, source string, width double, active boolean, productive boolean")
    many = signals.join(spark.range(300), how="cross")
    found = sessions.signal_sessions(many)
    assert "collect_list" not in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sessions.signal_sessions(signals).collect()))


def test_name_clusters_are_found_in_every_group_of_linked_names(spark, tmp_path):
    groups = [[chr(0x4E00 + 8 * g + i) for i in range(8)] for g in range(9)]
    names = [x for c in groups for x in ("".join(c[:6]), "".join(c[:4] + c[6:]))] + ["lone"]
    spark.createDataFrame([(i, n, f"t{i}") for i, n in enumerate(names)], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    canon = {r["name"]: r["canon"] for r in registry.QUERIES["name_clusters"](spark, str(tmp_path)).collect()}
    assert sorted(canon) == sorted(names) and canon["lone"] == "lone"
    assert len(set(canon.values())) == len(groups) + 1
    assert all(canon[a] == canon[b] for a, b in zip(names[0:18:2], names[1:18:2]))


def test_periods_cover_all_events(spark, tmp_path):
    at = lambda *d: dt.datetime(*d, 10)
    seen = [d for d in (dt.date(2022, 11, 14) + dt.timedelta(days=i) for i in range(150)) if d.weekday() < 5 and d not in (dt.date(2023, 1, 18), dt.date(2023, 2, 7), dt.date(2023, 2, 8), dt.date(2023, 2, 9))]
    path = events(spark, tmp_path, [(1, at(d.year, d.month, d.day), "purchase") for d in seen])
    load = registry.QUERIES["monthly_load"](spark, path).collect()
    assert sorted(r["month"] for r in load) == sorted({f"{d:%Y-%m}" for d in seen})
    assert all(r["avail_mm"] == 1.0 for r in load)
    away = {r["day"] for r in registry.QUERIES["absence_inference"](spark, path).collect()}
    assert {dt.date(2023, 1, 18), dt.date(2023, 2, 7)} <= away
    gaps = registry.QUERIES["evidence_gaps"](spark, path).collect()
    assert [(r["from_day"], r["to_day"], r["days"]) for r in gaps] == [(dt.date(2023, 2, 7), dt.date(2023, 2, 9), 3)]
    empty = events(spark, tmp_path / "none", [])
    assert all(registry.QUERIES[q](spark, empty).count() == 0 for q in ("monthly_load", "absence_inference", "evidence_gaps"))
