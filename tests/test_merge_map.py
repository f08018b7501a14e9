"""The merge map against its rules, and greedy groupings against a plain pass."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from worktide.operators import grouping, merge_map, resolve
from worktide.plans import names as N

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    i = {k: f.persist() for k, f in N.project_inputs(spark, SF).items()}
    scored = merge_map.pairs(i["known"], i["never"], i["refined"]).persist()
    return i, scored, merge_map.merge_map(scored, i["known"], i["old"]).collect()


def test_clusters_of_the_map_keep_vetoes_size_and_direction(run):
    i, scored, found = run
    score = {(r["owner"], *sorted((r["a"], r["b"]))): r["score"] for r in scored.collect()}
    mm = {(r["owner"], r["name"]): r["mm"] for r in i["known"].collect()}
    old = {(r["owner"], r["alias"]): r["canon"] for r in i["old"].collect()}
    to = {(r["owner"], r["alias"]): r["canon"] for r in found}
    assert all(to[k] == v for k, v in old.items())  # directions chosen before stay
    assert all((o, c) not in to for (o, _), c in to.items())  # flat: no representative is an alias
    groups = {}
    for o, n in mm:
        groups.setdefault((o, to.get((o, n), n)), set()).add(n)
    before = {(o, c) for (o, _), c in old.items()}
    for (o, c), group in groups.items():
        new = {n for n in group if (o, n) not in old}
        assert len(new) <= merge_map.CAP + sum((o, n) in before for n in new)
        if not any((o, n) in old for n in group) and len(group) > 1:
            assert all(score.get((o, *sorted(p)), 0.0) != resolve.VETO for p in combinations(group, 2))
            assert c == max(group, key=lambda n: ((o, n) in before, mm[o, n], len(" ".join(n.split())), -len(n), n))
            assert any(score.get((o, *sorted((n, c))), 0.0) > 0 or any(score.get((o, *sorted((n, m))), 0.0) > 0 for m in group) for n in group)
    kinds = {r["kind"] for r in found}
    assert "kept" in kinds and {"rule", "evidence"} & kinds


def test_a_rerun_with_the_new_map_flips_nothing(run):
    i, scored, found = run
    again = merge_map.merge_map(scored, i["known"], i["known"].sparkSession.createDataFrame([(r["owner"], r["alias"], r["canon"]) for r in found], i["old"].schema)).collect()
    one, two = ({(r["owner"], r["alias"]): r["canon"] for r in rows} for rows in (found, again))
    assert all(two[k] == v for k, v in one.items())


def likes(spark_words, a, b):
    wa, na = spark_words[a]
    wb, nb = spark_words[b]
    both = wa & wb
    return bool(wa and wb and na == nb and (len(both) >= 2 or both == wa or both == wb))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_details_equal_a_plain_pass(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(3), " ".join(r.sample(["aa", "bb", "cc", "dd", "ee", "task"], r.randrange(1, 4))) + r.choice(["", "", " (x)"]), float(r.randrange(9))) for _ in range(150)]
    fixed = [(0, rows[0][1]), (rows[5][0], rows[5][1])]
    found = {(x["s"], x["n"]): x["canon"] for x in grouping.merged_details(spark.createDataFrame(rows, "s int, n string, w double"), "s", "n", "w", spark.createDataFrame(fixed, "s int, n string")).collect()}
    sums = {}
    for s, n, w in rows:
        sums[s, n] = sums.get((s, n), 0.0) + w
    words = {n: ({t for t in n.replace("(", " ").replace(")", " ").split() if t != "task" and len(t) >= 2}, "x" if n.endswith("(x)") else "") for _, n in sums}
    want, reps = {}, {}
    for s, n in sorted(sums, key=lambda k: (k not in fixed, -sums[k], k[1])):
        hit = None if (s, n) in fixed else next((x for x in reps.get(s, []) if likes(words, n, x)), None)
        want[s, n] = hit or n
        if hit is None:
            reps.setdefault(s, []).append(n)
    assert found == want


def test_a_word_that_all_details_share_makes_no_pairs(spark):
    rows = spark.range(20000).select(F.lit(1).alias("s"), F.concat(F.lit("lens holder "), F.col("id").cast("string"), F.lit("x")).alias("n"), F.col("id").cast("double").alias("w"))
    found = grouping.merged_details(rows, "s", "n", "w")
    assert found.select("canon").distinct().collect()[0]["canon"] == "lens holder 19999x" and found.count() == 20000


def test_containment_equals_all_comparisons(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    inner, outer = {word(r.randrange(4, 7)) for _ in range(150)}, {word(r.randrange(4, 30)) for _ in range(150)}
    frames = [spark.createDataFrame([(t,) for t in texts], "text string") for texts in (inner, outer)]
    assert {(x["inner"], x["outer"]) for x in grouping.contained(*frames).collect()} == {(a, b) for a in inner for b in outer if a in b}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "s int, n string, w double")
    assert grouping.merged_details(none, "s", "n", "w").count() == 0
    assert grouping.similar_groups(none, "n", "w").count() == 0
    assert grouping.evidence(none, "n", none, "s", [F.col("n")]).count() == 0
