"""Periodic runs, decontamination and the manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.texts import SCHEMA, documents, frame, word_list, words
from worktide.llm import decontaminate, merkle_manifest, periodic_runs, queries

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The odd documents, and a benchmark whose passages some of them hold."""
    path = str(tmp_path_factory.mktemp("tables"))
    frame(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def items():
    split = words(2, 70).split()
    return [
        (1, " ".join(split[5:40])), (2, " ".join(split[30:42])), (2, words(5, 10).upper()), (10, "One"), (11, "never seen " + words(7, 12)),
        (12, "é中\U0001f600 endoftext"), (13, None), (14, " .,; "), (15, "a " * 12), (None, words(55, 15)), (3, words(7, 900)), (16, words(7, 11)), (16, words(7, 11)),
    ]


def brute_runs(ws):
    n, found = len(ws), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, q, m) for (s, m), q in found.items())


def collapsed(ws, runs):
    gone = {i for s, q, m in runs for i in range(s + q, s + m)}
    return b" ".join(w for i, w in enumerate(ws) if i not in gone)


def runny(seed, n):
    """Few words, so that runs of many periods touch and overlap."""
    r, out = random.Random(seed), []
    while len(out) < n:
        unit = [r.choice("ab") + str(r.randrange(3)) for _ in range(r.randrange(1, 14))]
        out += unit * r.randrange(1, 12)
        out += [f"x{r.randrange(50)}" for _ in range(r.randrange(0, 9))]
    return " ".join(out[:n])


def test_runs_equal_brute_force(spark):
    texts = [t for _, t, *_ in documents()] + [runny(i, 30 + 17 * i) for i in range(30)] + ["a b " * 30, "a " * 23, "a " * 24, "a b c d e f g h " * 3, ("a b c d e f g h i " * 3)[:-2], "\x0b".join("ab" * 40)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    for long_bytes in (1 << 20, 150):  # 150: nearly all are dealt out by ranges of lags
        found = {r["doc_id"]: r for r in periodic_runs.periodic_runs(frame(spark, rows), long_bytes).collect()}
        assert len(found) == len(rows) and found[0]["bucket"] == 5
        for i, t in enumerate(texts):
            ws = word_list(t)
            want = brute_runs(ws)
            assert found[i]["n_words"] == len(ws)
            assert [(r["start"], r["period"], r["length"]) for r in found[i]["runs"]] == want
            assert found[i]["kept"].encode() == collapsed(ws, want)


def test_ranges_of_lags_meet_again(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "LAGS", 7)
    text = words(3, 200) + " " + (words(4, 50) + " ") * 5
    row = periodic_runs.periodic_runs(frame(spark, [(1, text, "en", "a", 1)] * 2), 10).collect()
    assert [(r["runs"][0]["start"], r["runs"][0]["period"], len(r["runs"])) for r in row] == [(200, 50, 1)] * 2


def test_long_text_of_one_word(spark):
    row = periodic_runs.periodic_runs(frame(spark, [(1, "w " * 30000, "en", "a", 1)])).first()
    assert row["kept"] == "w" and [tuple(r) for r in row["runs"]] == [(0, 30000, 1)]


def test_op11_equals_brute_force(spark, folder):
    rows = queries.op11_periodic_runs(spark, folder).collect()
    got = sorted((str(r["doc_id"]), tuple(r)[1:]) for r in rows)
    want = []
    for doc_id, text, *_ in documents():
        ws, h = word_list(text), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n, g = len(ws), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        runs = brute_runs(ws)
        best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
        four = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        want.append((str(doc_id), (len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, q, m in runs)), sha(collapsed(ws, runs)))))
    assert got == sorted(want, key=lambda x: (x[0], str(x[1]))) or sorted(map(str, got)) == sorted(map(str, want))
    assert any(r["n_runs"] and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows)


def test_no_rows_no_runs(spark):
    assert periodic_runs.periodic_runs(frame(spark, [])).count() == 0


def leak_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_leaks(docs, benchmark):
    out = []
    windows = []
    for item_id, text in benchmark:
        ws = leak_words(text)
        windows += [(item_id, tuple(ws[i : i + 10])) for i in range(max(1, len(ws) - 9))] if ws else []
    for doc_id, text in docs:
        ws, hit, ids = leak_words(text), set(), set()
        places = defaultdict(list)
        for i, w in enumerate(ws):
            places[w].append(i)
        for item_id, window in windows:
            for i in places[window[0]]:
                if tuple(ws[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    ids |= {str(item_id)} if item_id is not None else set()
        out.append((str(doc_id), len(ws), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return sorted(out)


def test_op12_equals_brute_force(spark, folder):
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in queries.op12_decontaminate(spark, folder).collect())
    assert got == brute_leaks([d[:2] for d in documents()], items())
    assert sum(r[5] for r in got) > 5


def test_blocks_and_shards_change_nothing(spark, folder, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 600)
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.createDataFrame(items(), "item_id long, text string")
    index = decontaminate.build_index(docs, 600)
    assert index.select("shard").distinct().count() > 10
    named = decontaminate.item_words(bench)
    small = decontaminate.phrase_matches(index, named).join(decontaminate.directory(index), ["shard", "begin"]).select("doc_id", "start", "end").distinct()
    monkeypatch.undo()
    whole = decontaminate.build_index(docs)
    large = decontaminate.phrase_matches(whole, decontaminate.item_words(bench)).join(decontaminate.directory(whole), ["shard", "begin"]).select("doc_id", "start", "end").distinct()
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_random_words_of_a_small_vocabulary(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(0, 400)))) for i in range(40)]
    bench = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(1, 16)))) for i in range(60)]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    got = sorted((str(x["doc_id"]), x["n_words"], x["n_hit"], len(x["items"]), sha(",".join(x["items"])), x["n_hit"] > 0) for x in found.collect())
    assert got == brute_leaks(docs, bench)


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "p q c x b a r s"), (2, "a x x x x b c"), (3, "a b"), (4, "c"), (5, "b a c a b")], "doc_id long, text string").repartition(1)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    found = decontaminate.near_matches(index, decontaminate.item_words(bench), 4).join(decontaminate.directory(index), ["shard", "begin"])
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in found.collect()) == [(1, 2, 6), (5, 0, 3), (5, 2, 5)]


def test_no_rows_no_leaks(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, spark.createDataFrame(items(), "item_id long, text string")).count() == 0
    assert [tuple(r) for r in decontaminate.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench).collect()] == [(1, 2, 0, [])]


def part(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """Root and, for each leaf, its siblings left and right at every level."""
    at, level = [[i] for i in range(len(leaves))], list(leaves)
    paths = [[] for _ in leaves]
    while len(level) > 1:
        runs = [range(i, min(i + 16, len(level))) for i in range(0, len(level), 16)]
        for run in runs:
            for node in run:
                for i in at[node]:
                    paths[i].append(("".join(level[x] for x in run if x < node), "".join(level[x] for x in run if x > node)))
        at, level = [sum((at[x] for x in run), []) for run in runs], [sha("".join(level[x] for x in run)) for run in runs]
    return level[0], paths


def brute_manifest(docs):
    by = defaultdict(list)
    for doc_id, text, lang, source, n_chars in docs:
        leaf = lambda t: sha("".join(map(part, (doc_id, source, lang, n_chars, t))))  # noqa: B023, E731
        small = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        by[source].append((doc_id is not None, doc_id or 0, leaf(text), leaf(small if tampered else text)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (known, doc_id, leaf, changed), path in zip(sorted(by[s]), trees[s][1]):
            fold = changed
            for left, right in path + top:
                fold = sha(left + fold + right)
            out.append((str(doc_id if known else None), leaf, trees[s][0], root, sha("".join(a + b for a, b in path + top)), fold, fold == root))
    return sorted(out)


def manifest_rows(df):
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect())


def test_op13_equals_brute_force(spark, folder):
    got = manifest_rows(queries.op13_merkle_manifest(spark, folder))
    assert got == brute_manifest(documents())
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_op13_of_many_rows_and_sources(spark, tmp_path):
    rows = [(i, f"Text {i}", "en", "hot" if i % 2 else f"s{i % 700}", i) for i in range(11000)]
    frame(spark, rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest_rows(queries.op13_merkle_manifest(spark, str(tmp_path))) == brute_manifest(rows)


def test_paths_of_every_small_size():
    for n in [*range(1, 40), 255, 256, 257, 600, 4095, 4096]:
        leaves = [sha(str(i)) for i in range(n)]
        root, paths = tree(leaves)
        levels = merkle_manifest.levels_of(n)
        assert merkle_manifest.root_of(leaves, levels) == root
        assert list(merkle_manifest.paths_of(leaves, levels)) == paths


def test_traversal_keeps_two_runs_a_level():
    leaves = [sha(str(i)) for i in range(1000)]
    desired = merkle_manifest.Desired(leaves, 1)
    for _ in leaves:
        desired.step()
        assert sum(map(len, desired.builder.open)) + len(desired.run) <= 16 * 3


def test_no_rows_no_manifest(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, node string")
    assert merkle_manifest.manifest(empty, "source", "doc_id", "node", []).count() == 0


def test_forged_path_is_not_the_root(spark):
    docs = spark.createDataFrame([(i, "s", sha(str(i))) for i in range(40)], "doc_id long, source string, node string")
    rows = merkle_manifest.manifest(docs, "source", "doc_id", "node", ["doc_id"])
    ok = rows.select((merkle_manifest.folded(F.col("node"), F.col("path")) == F.col("root")).alias("ok"), (merkle_manifest.folded(F.sha2("node", 256), F.col("path")) == F.col("root")).alias("forged"))
    assert {tuple(r) for r in ok.collect()} == {(True, False)}
    assert SCHEMA
