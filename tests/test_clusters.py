"""Correlation clustering against the rules it must keep, read off every cluster."""

from itertools import combinations

from worktide.operators import resolve
from worktide.plans import registry

SF = "/root/testdata/sf0.001"


def test_clusters_keep_vetoes_and_size_and_no_single_move_helps(spark):
    import random

    r = random.Random(8)
    names = [f"n{i:02d}" for i in range(30)]
    scores = {(a, b): r.choice([2.0, 1.2, 0.4, -0.5, -0.8, resolve.VETO]) for a, b in combinations(names, 2) if r.random() < 0.35}
    own = spark.createDataFrame([(1, n, float(r.randrange(5))) for n in names], "scope int, name string, weight double")
    pairs = spark.createDataFrame([(1, a, b, s) for (a, b), s in scores.items()], "scope int, a string, b string, score double")
    canon = {row["name"]: row["canon"] for row in resolve.clusters(pairs, own, cap=5).collect()}
    assert set(canon) == set(names)
    groups = {}
    for n, c in canon.items():
        groups.setdefault(c, set()).add(n)
    w = lambda x, y: scores.get((min(x, y), max(x, y)), 0.0)
    weight = {row["name"]: row["weight"] for row in own.collect()}
    for c, group in groups.items():
        assert len(group) <= 5 and c == min(group, key=lambda n: (-weight[n], n))
        assert all(w(x, y) != resolve.VETO for x, y in combinations(group, 2))
    gain = lambda x, group: sum(w(x, y) for y in group if y != x)
    better = [x for x in names for c, g in groups.items() if x not in g and len(g) < 5 and all(w(x, y) != resolve.VETO for y in g) and gain(x, g) > gain(x, groups[canon[x]]) + 1e-9]
    assert not better


def test_the_query_clusters_whole_components(spark):
    """Brute force over the query's own pairs: clusters never cross components of
    positive scores, and names without a merge partner stay alone."""
    found = {row["name"]: row["canon"] for row in registry.QUERIES["name_clusters"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/part.parquet").select("p_name", "p_type").distinct().collect()
    types = {}
    for row in rows:
        types.setdefault(row["p_name"], set()).add(row["p_type"])
    assert set(found) == set(types)

    def grams(n):
        k = n.replace(" ", "")
        return {k[i : i + 2] for i in range(len(k) - 1)}

    def score(a, b):
        dice = 2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b)))
        common, every = len(types[a] & types[b]), len(types[a] | types[b])
        out = 2.4 * (dice - 0.45) if dice > 0.45 else 0.0
        return out + (2.0 * common / every if common else -0.8 if min(len(types[a]), len(types[b])) >= 2 else 0.0)

    parent = {n: n for n in types}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(types), 2):
        if grams(a) & grams(b) and score(a, b) > 1e-9:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    groups = {}
    for n, c in found.items():
        groups.setdefault(c, set()).add(n)
        assert root(n) == root(c)
    assert all(len(g) <= 6 for g in groups.values())
    alone = {n for n in types if not any(n != m and grams(n) & grams(m) and score(n, m) > 1e-9 for m in types)}
    assert all(found[n] == n and groups[n] == {n} for n in alone)


def test_pairs_refined_together_score_one_more(spark):
    import datetime as dt

    day = dt.date(2024, 1, 1)
    rows = [(n, ["x"], day, day, False, None) for n in ("lens holder", "lens holdr", "mount", "mount (old)")]
    profiles = spark.createDataFrame(rows, "name string, details array<string>, first_day date, last_day date, pinned boolean, product string")
    pairs = spark.createDataFrame([("lens holder", "lens holdr"), ("lens holder", "mount"), ("mount", "mount (old)")], "a string, b string")
    refined = spark.createDataFrame([("mount", "lens holder"), ("mount (old)", "mount")], "a string, b string")
    plain = {(r["a"], r["b"]): r["score"] for r in resolve.pair_scores(pairs, profiles).collect()}
    more = {(r["a"], r["b"]): r["score"] for r in resolve.pair_scores(pairs, profiles, refined=refined).collect()}
    assert more["lens holder", "lens holdr"] == plain["lens holder", "lens holdr"]
    assert abs(more["lens holder", "mount"] - plain["lens holder", "mount"] - 1.0) < 1e-9
    assert more["mount", "mount (old)"] == resolve.VETO
