"""Flows, series, task loads and scoped axes: small cases by hand."""

from pyspark.sql import functions as F

from worktide.operators import agentic, flows, grouping, resolve

FLOWS = "id long, source int, owner string, project string, detail string, role string, steps array<string>, mm double, ax double"


def test_flows_told_twice_count_once_and_coarse_ones_go(spark):
    rows = [
        (1, 1, "ann", "Lens", "holder design", "", ["Draw", "Check"], 1.0, 0.5), (2, 0, "ann", "lens", "holder", "", ["check", "draw"], 2.0, 0.5), (3, 0, "bob", "Lens", "holder design", "", ["draw", "check"], 1.0, 1.0),
        (4, 0, "ann", "Lens", "", "", ["plan"], 9.0, 0.0), (5, 0, "cy", "Lens", None, "", ["plan"], 3.0, 0.0), (6, 0, "bob", "Mount", "holder design", "", [], 1.0, 0.0),
    ]
    table = spark.createDataFrame(rows, FLOWS)
    assert sorted(r["id"] for r in flows.once(table).collect()) == [2, 3, 5, 6]  # 1 repeats 2, 4 is coarse beside 2, 5 is all that cy tells
    found = {r["cluster"]: r for r in flows.flow_summary(table).collect()}
    assert set(found) == {2, 3, 6} and found[2]["label"] == "holder" and found[6]["steps"] == []
    assert flows.flow_summary(spark.createDataFrame([], FLOWS)).count() == 0


def test_alike_details_and_alike_steps_join(spark):
    steps = ["draw", "check", "send"]
    rows = [(1, 0, "a", "p", "holder design", "", steps, 1.0, 1.0), (2, 0, "b", "p", "holder designs", "", ["other"], 3.0, 0.0), (3, 0, "c", "p", "holder plan", "", [*steps, "file"], 0.0, 0.0), (4, 0, "d", "p", "holder plan (old)", "", steps, 0.0, 0.0)]
    found = {r["cluster"]: r for r in flows.flow_summary(spark.createDataFrame(rows, FLOWS)).collect()}
    assert found[1]["people"] >= 2 and found[1]["label"] == "holder designs" and found[1]["ax"] == 0.25
    assert 4 in found  # another note is another kind of work


def test_series_labels(spark):
    groups = spark.createDataFrame([("Lens A 1", "x", 1.0), ("lens A 2", "y", 2.0), ("Motor", "x", 1.0), ("Drive", "x", 0.5)], "name string, who string, mm double")
    aliases = spark.createDataFrame([("Lens A 1", "lens A 2"), ("Drive", "Motor")], "alias string, canon string")
    assert {(r["label"], r["persons"], r["mm"]) for r in grouping.series(groups, aliases).collect()} == {("Lens A series", 2, 3.0), ("Drive", 1, 1.5)}


def test_task_loads_sum_to_the_whole(spark):
    rows = spark.createDataFrame([("o", i, f"detail number {i:02d}", i / 7.0) for i in range(30)] + [("p", 0, "detail number 01", 5.0)], "owner string, row long, name string, mm double")
    tasks = [("o", m, f"t{m}", [f"detail number {(m * 5 + j) % 40:02d}" for j in range(8)], m != 3) for m in range(5)]
    found = agentic.recalculated(spark.createDataFrame(tasks, "owner string, match long, task string, works array<string>, fit boolean"), rows, [F.col("name")]).collect()
    assert len(found) == 5 + 2  # a residue each
    for owner, whole in (("o", sum(i / 7.0 for i in range(30))), ("p", 5.0)):
        assert abs(sum(r["split_mm"] for r in found if r["owner"] == owner) - whole) < 1e-9
    by = {r["match"]: r for r in found if r["owner"] == "o"}
    assert by[3]["rows"] == 0 and by[0]["shared"] == ["t1"] and by[0]["load_mm"] > by[0]["split_mm"]


def test_axes_take_only_what_is_one_entrys_alone(spark):
    pool = spark.createDataFrame([("s", "Lens/check (new)", "check (new)"), ("s", "Lens/check (old)", "check (old)"), ("s", "Mount frame plan", "plan"), ("t", "lens/check (new)", "check (new)")], "s string, e string, d string")
    said = ["lens check (new)", "Lens/check", "lens/check (new)", "Lens/check (test)", "mount frame", "PLAN", "Mount frame plan - soon", "mount fr", None]
    rows = spark.createDataFrame([("s", x) for x in said], "s string, raw string")
    found = {r["raw"]: (r["resolved"], r["axis"]) for r in resolve.resolve_scoped(rows, "raw", pool, "e", "s", "d").collect()}
    assert found["lens check (new)"] == ("Lens/check (new)", "fold") and found["lens/check (new)"] == ("Lens/check (new)", "lower")
    assert found["Lens/check"] == (None, None) == found["Lens/check (test)"] == found["mount fr"] == found[None]
    assert found["mount frame"] == ("Mount frame plan", "prefix") and found["PLAN"] == ("Mount frame plan", "detail") and found["Mount frame plan - soon"] == ("Mount frame plan", "dashless")
