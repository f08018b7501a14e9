import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.texts import SCHEMA, documents, frame, word_list, words
from worktide.llm import components, fingerprints, ngram_join, queries, source_mix, substring_dedup


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_text(b, seed=42):
    return xxhash.xxh64_intdigest(b, seed=seed & (1 << 64) - 1)


def hash_pair(a, b):
    return hash_text((b & (1 << 64) - 1).to_bytes(8, "little"), hash_text((a & (1 << 64) - 1).to_bytes(8, "little")))


def marks(text, k=3, window=4):
    h = [hash_text(w) for w in word_list(text)]
    if not h:
        return []
    two = [hash_pair(a, b) for a, b in zip(h, h[1:])]
    three = [hash_pair(a, b) for a, b in zip(two, two[1:])]
    if len(h) == 1:
        grams = [hash_text(b"")] and None
        return None
    grams = three if len(h) >= 3 else None
    if grams is None:
        return None
    out = []
    for i in range(max(1, len(grams) - window + 1)):
        near = [(grams[j] & 0xFFFFFFFF, -j) for j in range(i, min(i + window, len(grams)))]
        low = min(near)
        mark = (low[0], -low[1])
        if mark not in out:
            out.append(mark)
    return out


def test_marks_equal_brute_force(spark):
    rows = fingerprints.fingerprint(frame(spark, clash=False)).select("text", "marks", fingerprints.places(F.col("marks")).alias("places"), fingerprints.hashes(F.col("marks")).alias("hashes")).collect()
    for r in rows:
        want = marks(r["text"])
        if want is None:  # fewer than three words: one gram
            assert len(r["marks"]) == 1
            continue
        assert [(m >> 31, p) for m, p in zip(r["marks"], r["places"])] == want
        assert set(r["hashes"]) == {h for h, _ in want}


def test_shared_run_shares_a_mark(spark):
    run = words(9, 6)
    rows = [(i, words(90 + i, 40) + " " + run + " " + words(70 + i, 40), "en", "a", 0) for i in range(6)]
    got = fingerprints.fingerprint(frame(spark, rows, clash=False)).select(fingerprints.hashes(F.col("marks")).alias("h")).collect()
    sets = [set(r["h"]) for r in got]
    assert all(a & b for a in sets for b in sets)


def edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(hash_text((r[1] or "").encode()))))
    out = []
    for a, b in zip(order, order[1:] + order[:1]):
        text, nxt = a[1] or "", b[1] or ""
        half = len(text) // 2
        out.append((a[0], len(text), hashlib.sha256((text[: len(text) - half] + nxt[:half]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("rows", [None, [], [(7, "only one here", "en", "a", 1)]])
def test_edited_texts_equal_brute_force(spark, rows):
    got = fingerprints.fingerprint_edits(frame(spark, rows)).select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("h"), "near_edited", "near_next").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r[0], r[1], r[2]) for r in got), key=key) == sorted(edits(documents() if rows is None else rows), key=key)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_fingerprint_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op3_fingerprints(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(edits(rows))
    texts, prints = dict(rows), defaultdict(set)
    for r in got:
        prints[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([r["near_edited"] for r in got]) > 0.25 > np.mean([r["near_next"] for r in got])


# -- mixing


def shares(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def check_mix(rows, got):
    """The whole mix made again: shares, finish times, one global sort, the cut."""
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(word_list(text))
    target, budget, by_source, copies = shares(sizes), sum(sizes.values()), {}, []
    for r in got:
        by_source.setdefault(None if r["mix_source"] == "n" else r["mix_source"][1:], []).append(r)
    identity = lambda r: (r["mix_id"], r["mix_text"], r["mix_source"], r["mix_row"])
    for s, own in by_source.items():
        own.sort(key=lambda r: ((r["draw"] & (1 << 64) - 1) >> 54, r["draw"], identity(r)))
        reach = 0
        for r in own:
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
            assert r["taken"] == r["copies"] * r["size"]
            reach += r["size"]
            for k in range(3 if r["size"] else 1):
                copies.append(((reach + k * sizes[s]) / r["target"] if r["target"] else 0.0, r["draw"], identity(r), reach, r["size"]))
    copies.sort()
    total, took = 0, Counter()
    for _, _, who, _, size in copies:
        total += size
        if total > budget:
            break
        took[who] += 1
    assert took == +sum((Counter({identity(r): r["copies"]}) for r in got), Counter())
    largest = Counter()
    for s, own in by_source.items():
        largest[s] = max(r["size"] for r in own)
    for s, own in by_source.items():  # late documents of the others can hold a source back or push it
        assert abs(sum(r["taken"] for r in own) - target[s]) <= sum(largest.values())
    assert sum(r["taken"] for r in got) <= budget


def test_mix_equals_brute_force(spark):
    got = source_mix.weighted_fair_mix(frame(spark)).collect()
    assert len(got) == len(documents())
    check_mix(documents(), got)
    again = source_mix.weighted_fair_mix(frame(spark).repartition(5)).collect()
    key = lambda r: (r["mix_id"], r["mix_text"], r["mix_source"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_caps_are_reshared(spark):
    rows = [(i, words(i, 50), "en", "a" if i < 2 else "b" if i < 40 else None, 0) for i in range(80)]
    check_mix(rows, source_mix.weighted_fair_mix(frame(spark, rows)).collect())


def test_materialised_mix(spark):
    docs = frame(spark)
    mix = source_mix.weighted_fair_mix(docs)
    out = source_mix.materialise(docs, mix)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in mix.collect())
    assert source_mix.weighted_fair_mix(frame(spark, [])).count() == 0


# -- repeated passages


def removed(rows, window):
    first = {}
    for i, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = word_list(text)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = []
    for i, text, *_ in rows:
        w = word_list(text)
        gone = set()
        for j in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize("window,k", [(50, 10), (12, 4), (6, 2)])
def test_removed_words_equal_brute_force(spark, window, k):
    got = substring_dedup.remove_repeats(frame(spark), window, k).select("doc_id", "n_words", "n_removed", "kept").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(removed(documents(), window), key=key)


@pytest.mark.parametrize("times", [2, 3])
@pytest.mark.parametrize("length", [50, 55, 400])
def test_repeated_rows_lose_what_an_earlier_document_has(spark, times, length):
    text = words(61, length)
    rows = [(1, text, "en", "a", 0)] * times + [(2, text, "en", "a", 0), (3, words(62, 30) + " " + text, "en", "a", 0)] * (times - 1) + [(1, text + " more", "en", "a", 0)]
    got = substring_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(removed(rows, 50))
    assert {r["n_removed"] for r in got if r["doc_id"] == 2} == {length} and {r["n_removed"] for r in got if r["doc_id"] == 1} == {0}


def test_many_overlapping_passages(spark):
    import random

    r = random.Random(3)
    parts = [words(200 + i, 15, 12) for i in range(6)]
    rows = [(i, " ".join(r.choice(parts) for _ in range(8)) + " " + words(i, 5), "en", "a", 0) for i in range(60)]
    got = substring_dedup.remove_repeats(frame(spark, rows), 20, 5).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(removed(rows, 20))
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_long_passages_are_one_span(spark):
    passage, loop = words(77, 3000, 5000), " ".join(["la", "le", "lu"] * 700)
    rows = [(i, f"{words(300 + i, 60)} {passage} {words(400 + i, 60)} {loop}", "en", "a", 0) for i in range(6)]
    held = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "xxhash64(text) AS tie", "text")
    spans = substring_dedup.repeated_spans(held, held).collect()
    long = [s for s in spans if s["to"] - s["from"] >= 2900]
    assert {s["doc_id"] for s in long} == set(range(1, 6)) and all(len(s["digest"]) == 16 for s in long)
    assert len([s for s in spans if s["from"] < 3000]) <= 15  # a path, and where it branches at its ends
    got = substring_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(removed(rows, 50))


def test_spans_that_differ_from_the_earlier_words_stay():
    text, other = b"a b c d e f".split(), b"a b x d e f".split()
    spans = [{"from": 0, "to": 3, "digest": substring_dedup.digest(other, 0, 3)}, {"from": 3, "to": 5, "digest": substring_dedup.digest(other, 3, 5)}]
    assert substring_dedup.without_spans(b" ".join(text), spans) == (6, 2, b"a b c f")


# -- near duplicates


def near(rows, n=5, percent=80):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets, parent = [], {}
    for i, text, *_ in rows:
        w = word_list((text or "").translate(lower))
        sets.append((i, frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()))
        parent.setdefault(i, i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


def test_components_equal_brute_force(spark):
    got = ngram_join.near_duplicates(frame(spark)).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(near(documents()), key=key)


def test_family_of_near_copies_in_tiles(spark, monkeypatch):
    import random

    monkeypatch.setattr(ngram_join, "TILE", 8)
    r, base = random.Random(4), words(11, 150, 5000).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((i * 3 % 91, " ".join(w[: r.randrange(120, 150)]), "en", "a", 0))
    got = ngram_join.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(near(rows))
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0


def test_bitmaps_never_exclude_a_link():
    r = np.random.default_rng(1)
    for n in (3, 40, 700):
        base = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        other = np.unique(np.concatenate([base[max(1, n // 10) :], r.integers(0, 1 << 63, n // 12).astype(np.uint64)]))
        far = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        sets = [base, other, far]
        link = ngram_join.linked(sets, 80)
        np.fill_diagonal(link, False)  # a set's link with itself is not one
        stays = ngram_join.may_link(np.array([len(s) for s in sets]), [ngram_join.bitmap(s) for s in sets], 80)
        assert stays[link.any(axis=1)].all()


def test_long_chains_have_one_root(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (5, 5)], "a long, b long")
    roots = dict(components.components(edges, "a", "b").collect())
    assert roots == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}


def test_schema_is_small():
    assert SCHEMA.count(",") == 4
