import datetime as dt

from pyspark.sql import functions as F

from worktide.functions import predicates, replies, text
from worktide.functions.config import Settings, settings_from
from worktide.operators import hours, intervals, sessions
from worktide.sources import sinks, traces
from worktide.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def spans(spark, rows):
    return spark.createDataFrame([("o", dt.date(2024, 1, 2), a, b) for a, b in rows], "owner string, day date, a double, b double")


def test_union_intersect_subtract(spark):
    a, b = spans(spark, [(0.0, 60.0), (30.0, 90.0), (120.0, 150.0)]), spans(spark, [(50.0, 130.0)])
    pieces = lambda df: sorted((r["a"], r["b"]) for r in df.collect())
    assert pieces(intervals.union(a)) == [(0, 90), (120, 150)]
    assert pieces(intervals.intersect(a, b)) == [(50, 90), (120, 130)]
    assert pieces(intervals.subtract(a, b)) == [(0, 50), (130, 150)]
    assert pieces(intervals.last_minutes(intervals.union(a), 50.0)) == [(70, 90), (120, 150)]


def test_four_meetings_are_four_hours(spark):
    day = intervals.union_hours(spans(spark, [(540.0 + 90 * i, 600.0 + 90 * i) for i in range(4)])).first()
    assert (day["hours"], day["islands"]) == (4.0, 4)


def test_midnight_split(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-05 22:00:00' AS s, timestamp_ntz'2024-01-07 00:00:00' AS e")
    got = sorted((str(r["day"]), r["a"], r["b"]) for r in intervals.midnight_split(rows, "s", "e").collect())
    assert got == [("2024-01-05", 1320.0, 1440.0), ("2024-01-06", 0.0, 1440.0)]


def test_passive_signals_do_not_bridge_and_are_capped(spark):
    rows = [("o", dt.date(2024, 1, 2), 540 + 40 * i, "view", 20.0, False, False) for i in range(8)]
    signals = spark.createDataFrame(rows, "owner string, day date, minute int, source string, width double, active boolean, productive boolean")
    found = sessions.signal_sessions(signals)
    assert found.count() == 8
    capped = sessions.cap_passive(found, 60.0).agg(F.sum(F.col("b") - F.col("a"))).first()[0]
    assert capped == 60.0


def test_active_signals_bridge_the_gap(spark):
    rows = [("o", dt.date(2024, 1, 2), m, "click", 20.0, True, True) for m in (540, 600, 720)]
    signals = spark.createDataFrame(rows, "owner string, day date, minute int, source string, width double, active boolean, productive boolean")
    assert sorted((r["a"], r["b"]) for r in sessions.signal_sessions(signals).collect()) == [(530, 610), (710, 730)]


def test_power_spans(spark):
    rows = [("o", f"2024-01-02 {t}", k) for t, k in (("08:00:00", "on"), ("08:10:00", "boot"), ("12:00:00", "off"), ("13:00:00", "off"), ("14:00:00", "on"), ("16:00:00", "boot"), ("17:00:00", "off"))]
    events = spark.createDataFrame(rows, "owner string, t string, kind string").withColumn("at", F.col("t").cast("timestamp_ntz"))
    got = sorted((r["start"].hour, r["end"].hour) for r in sessions.power_spans(events, ["owner"], "at", "kind").collect())
    assert got == [(8, 12), (14, 16), (16, 17)]


def test_month_uses_the_whole_month(spark):
    rows = spark.createDataFrame([("o", dt.date(2024, 1, d), 8.0) for d in (2, 3)], "owner string, day date, hours double")
    got = hours.monthly_load(rows, "2024-01-01", "2024-01-12", Settings()).first()
    assert (got["workdays"], got["mm"], got["avail_mm"], got["load_pct"]) == (23, round(16 / 184, 3), round(10 / 23, 3), 20.0)


def test_text_functions(spark):
    assert one(spark, text.minutes_of(F.lit("24:00"))) == 1440
    assert one(spark, text.minutes_of(F.lit("24:01"))) is None
    assert one(spark, text.strict_timestamp(F.lit("2024-01-02 26:00:00"))) is None
    assert one(spark, text.strict_timestamp(F.lit("2024-01-02 06:00"))) == dt.datetime(2024, 1, 2, 6)
    assert one(spark, text.note(F.lit("Frame (left)"))) == "left"
    assert one(spark, text.extension(F.lit("a.prt.3"))) == "prt"
    assert one(spark, text.extension(F.lit("run.cas.h5"))) == "cas.h5"
    assert one(spark, text.dice(text.bigrams(F.lit("night")), text.bigrams(F.lit("nacht")))) == 0.25


def test_keywords_need_borders(spark):
    assert one(spark, predicates.keyword_hit(F.lit("a template"), ["temp"])) is None
    assert one(spark, predicates.keyword_hit(F.lit("in /temp/x"), ["temp"])) == "temp"
    assert one(spark, predicates.has_token_suffix(F.lit("2year plan"), ["year"])) is False
    assert one(spark, predicates.is_absence(F.lit("leave statistics"), ["leave"], ["statistics"])) is False


def test_settings_refuse_bad_values():
    got, warnings = settings_from({"burst_n": "x", "std_day_h": 7.5, "nothing": 1, "trim_edges_min": 999})
    assert got.std_day_h == 7.5 and got.burst_n == Settings().burst_n
    assert sorted(n for n, _ in warnings) == ["burst_n", "nothing", "trim_edges_min"]


def test_json_is_repaired():
    assert replies.parse_one('see {"rows": [1]} end', "rows") == ('{"rows": [1]}', "strict")
    assert replies.parse_one('{"rows": [{"a": 1}, {"a": 2', "rows") == ('{"rows": [{"a": 1}]}', "salvaged")
    assert replies.parse_one(None, "rows") == (None, "none")


def test_csv_is_tolerant(spark, tmp_path):
    for root, body in (("one", "start,end,src\n2024-01-02 08:00:00,2024-01-02 09:00:00,event\n2024-01-02 10:00:00\n2024-01-02 12:00:00,2024-01-02 11:00:00,live\n"), ("two", "start,end,src\n2024-01-03 26:00:00,2024-01-03 09:00:00, \n")):
        (tmp_path / root).mkdir()
        (tmp_path / root / "pc_spans.csv").write_text(body)
    rows = traces.multi_root(spark, [str(tmp_path / r) for r in ("one", "two", "three")], "pc_spans")
    assert rows.count() == 3 and {r["_root"] for r in rows.collect()} == {"one", "two"}
    assert rows.where("src IS NULL").count() == 1
    assert traces.power_spans(rows).count() == 1
    assert {r["column"]: r["n"] for r in traces.format_errors(rows, "pc_spans").collect()} == {"start": 1, "end": 0}
    assert traces.read_csv(spark, [str(tmp_path / "none.csv")], "mail").count() == 0


def test_one_broken_member_costs_one_person(spark, tmp_path):
    for name, body in (("a", '{"owner": "a", "total_mm": 2.5}'), ("b", '{"owner": "b", ')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "member.json").write_text(body)
    good, bad = traces.member_json(spark, str(tmp_path), "owner string, total_mm double")
    assert [tuple(r) for r in good.collect()] == [("a", "a", 2.5)] and [r["folder"] for r in bad.collect()] == ["b"]


def test_refined_rows_win_unless_older(spark):
    plain = spark.createDataFrame([("x", 5, "plain"), ("y", 5, "plain"), ("z", 1, "plain")], "tag string, at int, v string")
    refined = spark.createDataFrame([("x", 5, "refined"), ("y", 4, "refined")], "tag string, at int, v string")
    got = {r["tag"]: r["v"] for r in traces.refined_or_plain(plain, refined, "tag", "at").collect()}
    assert got == {"x": "refined", "y": "plain", "z": "plain"}


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, tag string"), path, ["tag"])
    sinks.write_partitions(spark.createDataFrame([(3, "b")], "v int, tag string"), path, ["tag"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 3]


def test_live_visits_equal_batch_visits(spark, tmp_path):
    rows = [("o", f"2024-01-02 {t}") for t in ("08:00:00", "08:20:00", "09:30:00")] + [("z", "2024-02-02 00:00:00")]
    events = spark.createDataFrame(rows, "owner string, t string").select("owner", F.col("t").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = live.visits(stream, ["owner"], "ts").writeStream.format("memory").queryName("visits").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
    query.awaitTermination()
    key = lambda rows: sorted((r["owner"], str(r["start"]), str(r["end"]), r["points"]) for r in rows)
    got = key(spark.table("visits").collect())
    assert got == key(sessions.visit_sessions(events, ["owner"], "ts", 30.0, 5.0).collect())
    assert [g[3] for g in got] == [2, 1, 1]


def test_one_folder_of_a_colleague_is_one_vote(spark):
    from worktide.operators import team

    day = lambda d: f"2024-03-{d:02d} 10:00:00"
    rows = [(1, "CORP\\bob", "shared", day(1))] * 50 + [(1, "Ann.Lee@x.com", f"f{d}", day(d)) for d in (1, 2, 3)] + [(2, "ann", "f", day(d)) for d in (1, 2)] + [(3, "cy", "f", day(d)) for d in (1, 2, 3)] + [(4, None, None, None)]
    files = spark.createDataFrame(rows, "owner int, author string, folder string, at string")
    known = spark.createDataFrame([(3, "Dee (lead)"), (1, "x"), (1, None)], "owner int, name string")
    got = {(r["owner"], r["name"], r["votes"], r["of"]) for r in team.self_names(files, known).collect()}
    assert got == {(1, "annlee", 3, 4), (3, "dee", None, None)}
    assert team.self_names(files.limit(0), known.limit(0)).count() == 0
