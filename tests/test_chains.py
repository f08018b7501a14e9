"""Alias chains and as-of joins: probes, random graphs and one very large key."""

import random
import time

from pyspark.sql import functions as F

from worktide.operators import resolve, sessions


def followed(edges):
    """Each alias of {(scope, alias): canon} to the end of its chain, one at a time."""
    out = {}
    for (scope, alias), to in edges.items():
        seen, at = [alias], to
        while (scope, at) in edges and at not in seen:
            seen.append(at)
            at = edges[scope, at]
        if at in seen:
            at = min(seen[seen.index(at) :], key=lambda x: (len(" ".join(x.split())), len(x), x))
        if at != alias:
            out[scope, alias] = at
    return out


def closed(spark, edges):
    table = spark.createDataFrame([(s, a, c) for (s, a), c in edges.items()], "scope string, alias string, canon string")
    return {(r["scope"], r["alias"]): r["canon"] for r in resolve.close_aliases(table, scope=["scope"]).collect()}


def test_a_name_that_leads_into_a_cycle_keeps_its_canon(spark):
    edges = {("s", "a"): "x", ("s", "x"): "y", ("s", "y"): "x"}
    assert closed(spark, edges) == {("s", "a"): "x", ("s", "y"): "x"} == followed(edges)


def test_long_chains_and_long_cycles(spark):
    edges = {("s", f"n{i}"): f"n{i + 1}" for i in range(100)} | {("t", f"n{i}"): f"n{(i + 1) % 50}" for i in range(50)} | {("t", "tail"): "n49"}
    found = closed(spark, edges)
    assert found == followed(edges)
    assert len([k for k in found if k[0] == "s"]) == 100 and found["t", "tail"] == "n0"


def test_random_graphs(spark):
    r = random.Random(3)
    edges = {}
    for scope in "abc":
        n = r.randrange(20, 60)
        for i in range(n):
            if r.random() < 0.9:
                edges[scope, f"p{'  ' * (i % 2)} {i}"] = (lambda j: f"p{'  ' * (j % 2)} {j}")(r.randrange(n))
    edges = {k: v for k, v in edges.items() if k[1] != v}
    assert closed(spark, edges) == followed(edges)


def test_no_edges_and_own_canon(spark):
    assert closed(spark, {}) == {} and closed(spark, {("s", "a"): "a"}) == {}


def test_a_million_rows_of_one_key(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("at"), (F.col("id") % 1000 == 999).alias("done"), F.array(F.lit("w")).alias("words"))
    began = time.perf_counter()
    found = sessions.next_matching(rows, ["k"], ["at"], F.col("done"), F.col("at"), "next")
    assert found.where("next IS NOT NULL").count() == 999_999
    pairs = sessions.order_to_shared_done(rows, ["k"], "at", "words", ~F.col("done"), F.col("done"), 14).collect()
    assert len(pairs) == 1000 and {p["lead_h"] for p in pairs} == {0.0}
    assert time.perf_counter() - began < 60
