import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.texts import frame, words
from worktide.llm import queries, toxicity, url_rules, voronoi_knn


def brute(rows, k=5, scale=256):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, []).append([int(np.floor(scale * float(np.float32(x)))) for x in v])
    out = []
    for q in ok:
        if q % 50 == 0:
            best = []
            for d, vectors in ok.items():
                scores = [sum(a * b for a, b in zip(w, v)) for w in ok[q] for v in vectors if d != q and len(v) == len(w)]
                if scores:
                    best.append((-max(scores), d))
            out += [(q, n + 1, d, -s) for n, (s, d) in enumerate(sorted(best)[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(voronoi_knn, "BLOCK_LEAST", 16)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in (r.normal(size=8) + 3 * (i % 4)).astype(np.float32)], 1) for i in range(300)]
    rows += [(i, rows[7][1], 1) for i in range(300, 360)]  # ties
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] * 8, 1), (None, rows[0][1], 1), (404, [], 1)]
    rows += [(450, [1.0, 2.0], 1), (451, [0.5, 2.0], 1), (9, rows[9][1], 1)]  # another length, a repeat
    rows += [(100, rows[3][1], 1), (100, [-x for x in rows[4][1]], 1)]  # a query of three vectors
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"cell": F.lit(1), "v": F.lit("x")})
    got = voronoi_knn.top_k(vectors, F.col("vec_id") % 50 == 0, n_pivots=12).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows)
    assert voronoi_knn.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_rule_out_other_clusters(spark, monkeypatch):
    monkeypatch.setattr(voronoi_knn, "BLOCK_LEAST", 16)
    r = np.random.default_rng(3)
    centres = 4 * np.eye(8)
    rows = [(i, [float(x) for x in (centres[i % 8] + r.normal(scale=0.03, size=8)).astype(np.float32)], 1) for i in range(1600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = voronoi_knn.copies(vectors, F.col("vec_id") % 50 == 0).collect()
    assert len(found) == 32 and all(r["copies"] <= r["blocks"] // 6 for r in found)  # its own cluster of eight
    got = voronoi_knn.top_k(vectors, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows)


def test_products_stay_exact_beyond_doubles():
    a = np.array([[1 << 29, 3]], np.int64)
    b = np.array([[(1 << 29) + 1, 7], [1, 1]], np.int64)
    assert voronoi_knn.products(a, b).tolist() == [[(1 << 29) * ((1 << 29) + 1) + 21, (1 << 29) + 3]]


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("example.com", "/en/a/b/c/d/e/f/", "block"), ("EXAMPLE.org", "", "block"), (None, "/", "block"), ("", "/", "block")]
URLS = [
    "http://example.com/en/x", "http://www.example.com/en/x", "http://a.www.example.com/en/", "http://example.com/de", "http://EXAMPLE.com/en/?q", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/es", "https://com/", "http://com",
    "http://sub.example.com/en/a/b/c/d/e/f/g", "http://www.example.com/en/a/b/c/d/e/f/g", "no scheme", None, "", "://", "http://example.org", "http://example.org?x#y", "http://ex,ample.org/", "http://a://example.com/en/",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for h, p, v in RULES:
        h = h and h.lower()
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or (len(h) + len(p), len(h)) > (len(best[0]) + len(best[1]), len(best[0])):
                best = (h, p, v)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_extra_columns_of_any_type_pass_through(spark):
    pages = spark.sql("SELECT id AS page_id, 'http://a.net/es/' AS url, map('k', id) AS m, array(map(1, id)) AS n, named_struct('x', map('y', 'z')) AS s, parse_json('{\"v\": 1}') AS v FROM range(5)")
    rows = url_rules.judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()
    assert sorted((r["page_id"], r["m"]["k"], r["s"]["x"]["y"], r["rule"]) for r in rows) == [(i, i, "z", judged("http://a.net/es/")[2]) for i in range(5)]


def test_very_many_rules_of_one_host():
    import time

    level, began = url_rules.Open("com/", "com"), time.perf_counter()
    for i in range(100_000):
        level.add(f"/{i}/" + "x" * (i % 300), "block")
    assert level.longest("/7/" + "x" * 7 + "/more") == "/7/xxxxxxx" and level.longest("/none") is None
    assert time.perf_counter() - began < 5


def test_urls_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 40)], "page_id long, url string").withColumns({"key": F.lit("k"), "host": F.lit("h"), "salt": F.lit(1)})
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_rules.judge_urls(pages, rules).collect()
    assert len(got) == 40 * len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"])
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = ([r["score"] for r in scored if r["toxic"] == y] for y in (1, 0))
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean)
    assert wins / (len(toxic) * len(clean)) > 0.85
    assert np.mean([s >= 0.7 for s in clean]) < 0.05
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in scored)


def test_few_labels_lean_on_the_prior_and_many_outweigh_it(spark):
    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = queries.fit_toxicity(docs, labels)
    assert model.trees is not None and 0 < model.taught < 40
    rule, alone = toxicity.Model(toxicity.Lexicon(())), toxicity.Model(model.lexicon, model.trees, model.calibration, 1e9)
    a, b, c = ([r["score"] for r in m.score(docs.select("doc_id", "text")).orderBy("doc_id").collect()] for m in (model, rule, alone))
    share = toxicity.PRIOR / (model.taught + toxicity.PRIOR)
    assert all(abs(x - (z + share * max(0.0, y - z))) < 1e-5 for x, y, z in zip(a, b, c))


def test_lexicon_and_calibration_equal_counts_by_hand(spark):
    import math
    import random
    import re

    r, rows = random.Random(1), []
    for i in range(400):
        label = int(i % 4 == 0)
        rows.append((i, " ".join(r.choice(["vile", "vilest", "calm", "blue"] if label else ["calm", "blue", "green"]) for _ in range(6)), float(label)))
    every = [(*row, row[0] % toxicity.FOLDS) for row in rows] + [(1000 + i, "vile calm", 0.0, 1) for i in range(50)]
    counts = toxicity.term_counts(spark.createDataFrame(every, "doc_id long, text string, label double, fold int"))
    sizes = [(sum(y for *_, y, k in every if k == f), sum(1 - y for *_, y, k in every if k == f)) for f in range(toxicity.FOLDS)]
    found = dict(toxicity.learn_lexicon(counts, sizes, 1).terms)
    rows = [row[:3] for row in every if row[3] != 1]
    n, toxic = len(rows), sum(y for *_, y in rows)
    for term in ("vile", "vilest", "calm", "blue", "green", "vile*"):
        held = [(term in t.split() if not term.endswith("*") else bool(re.search(r"\bvile\w", t)), y) for _, t, y in rows]
        a, b = sum(y for h, y in held if h), sum(1 - y for h, y in held if h)
        part = lambda seen, expected: seen * math.log(seen / expected) if seen else 0.0
        ratio = 2 * (part(a, (a + b) * toxic / n) + part(b, (a + b) * (n - toxic) / n) + part(toxic - a, (n - a - b) * toxic / n) + part(n - toxic - b, (n - a - b) * (n - toxic) / n))
        odds = math.log((a + 0.5) / (toxic - a + 0.5)) - math.log((b + 0.5) / (n - toxic - b + 0.5))
        if a >= 3 and ratio >= toxicity.LEAST_RATIO and odds >= toxicity.LEAST_ODDS:
            assert found[term] == round(odds, 6)
        else:
            assert term not in found
    judged = [(r.random(), float(r.random() < 0.5)) for _ in range(60)]
    model = toxicity.calibrate(spark.createDataFrame(judged, "chance double, label double"))
    blocks = []  # pooled adjacent violators
    for x, y in sorted(judged):
        blocks.append([y, 1, [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    want = {x: s / k for s, k, xs in blocks for x in xs}
    got = model.transform(spark.createDataFrame([(x,) for x in want], "chance double")).collect()
    assert all(abs(g["calibrated"] - want[g["chance"]]) < 1e-9 for g in got)


def test_toxicity_handles_odd_rows_and_missing_labels(spark):
    docs = frame(spark)
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, label int"))
    assert model.trees is None
    rows = model.score(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert model.score(spark.createDataFrame([("you stupid idiot",), (words(1, 50),)], "text string")).orderBy("score").collect()[1]["text"].startswith("you")
    assert model.score(frame(spark, [])).count() == 0


def test_labels_of_the_held_out_third_teach_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(queries.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (queries.fit_toxicity(docs, x).score(docs.select("doc_id", "text")).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("text,hidden", [("you st*pid 1d1ot", True), ("plain words only", False)])
def test_obfuscation_is_seen(text, hidden):
    row = dict(zip(toxicity.FEATURES, toxicity.features_of(text, ())))
    assert (row["obfuscated_rate"] > 0) is hidden


def test_features_of_a_text_worked_out_by_hand():
    import math

    text = "You are an idiot! STUPID id1ot aaargh"
    got = dict(zip(toxicity.FEATURES, toxicity.features_of(text, (("argh*", 2.0),))))
    n, chars = 7, len(text)
    want = {
        "words": math.log1p(n), "hits": 2, "hit_rate": 2 / n, "distinct_hits": 2, "weight": 0.0, "insults": 2, "insult_rate": 2 / n, "strongest": 0.0, "close_hits": 2, "close_rate": 2 / n, "second_person_rate": 1 / n,
        "capital_rate": 7 / chars, "shouted_rate": 1 / n, "punctuation_rate": 1 / chars, "emphasis_rate": 0.0, "obfuscated_rate": 1 / n, "obfuscated_hits": 1, "stretched_rate": 1 / n,
    }
    assert {k: got[k] for k in want} == pytest.approx(want)
    hidden = toxicity.features_of("a b1rk", tuple((f"t{i:03d}", 1.0) for i in range(80)) + (("birk", 1.0),))
    assert dict(zip(toxicity.FEATURES, hidden))["obfuscated_hits"] == 1  # terms far down the lexicon count too
    assert toxicity.features_of("", ())[0] == 0.0
