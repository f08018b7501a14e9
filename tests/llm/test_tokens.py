import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.texts import documents, frame
from worktide.llm import bpe_codec, queries, token_counts, token_shards
from worktide.llm._bpe import parsed

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, library):
    got = token_counts.count_tokens(frame(spark), PATH).select("doc_id", "text", "n_tokens", "score").collect()
    assert len(got) == len(documents())
    for r in got:
        assert r["n_tokens"] == len(expected(library, r["text"]))
        assert r["score"] == "s"


def test_splitter_equals_the_pattern_on_random_texts():
    import random

    import regex

    r = random.Random(5)
    texts = ["".join(r.choice(" '  \n\tsrvlemdtabz09.,!?é中 ") for _ in range(r.randrange(80))) for _ in range(3000)]
    got, counts = token_counts.split_words(texts)
    want = [regex.findall(bpe_codec.SPLIT, t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert got == [x for w in want for x in w]


def test_state_maps_compose_over_long_texts():
    text = "ab'll  cd 12\n\n" * 5000 + "x" * 3000
    assert token_counts.split_words([text])[0] == __import__("regex").findall(bpe_codec.SPLIT, text)


def test_codec_round_trip(spark, library):
    coded = bpe_codec.decode(bpe_codec.encode(frame(spark), PATH), PATH).select("text", "ids", "decoded").collect()
    for r in coded:
        assert np.frombuffer(r["ids"], "<u4").tolist() == expected(library, r["text"])
        assert r["decoded"] == (r["text"] or "")


def test_merges_of_repeated_letters(library):
    encoder = bpe_codec.Encoder(parsed(open(PATH).read()))
    for text in ("a" * 5000, "aaa aaaa aaaaa", "ababababab" * 50):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == expected(library, text)


def test_queries_on_the_small_tables(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_token_counts(spark, sf).collect():
        n = len(expected(library, texts[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 1024)
    for r in queries.op9_bpe_codec(spark, sf).collect():
        ids = np.array(expected(library, texts[r["doc_id"]]), "<u4")
        assert r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(token_shards.slots(np.arange(n), n).tolist()) == list(range(n))
    assert token_shards.slots(np.arange(1000), 1000).tolist() != token_shards.slots(np.arange(1000), 1000, key=7).tolist()


def test_shards_hold_every_sequence_at_its_slot(spark, tmp_path):
    import tiktoken

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = frame(spark)
    ordered, total = token_shards.training_order(docs, path, public_tokenizers.PATTERN, stride=16, per_shard=100)
    folder = str(tmp_path / "shards")
    written = token_shards.write_shards(ordered, folder, 16, 100)
    assert token_shards.read_manifest(folder) == {"sequences": total, "shards": -(-total // 100), "per_shard": 100, "stride": 16, "key": token_shards.KEY}
    assert len(written.limit(5).collect()) == 5 and len(list((tmp_path / "shards").glob("shard-*.bin"))) == -(-total // 100)  # reading part of the rows takes nothing away
    rows = written.collect()
    assert sorted(r["slot"] for r in rows) == list(range(total))
    records = list(token_shards.read_records(folder, 0, total))
    for r in rows:
        assert r["record_sha256"] == hashlib.sha256(records[r["slot"]].tobytes()).hexdigest()
        assert r["offset"] == (r["slot"] % 100) * 32 and r["shard"] == r["slot"] // 100
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_shards_ranks(path), special_tokens={})
    want = sorted(tuple(encoding.encode_ordinary(t or "")) for _, t, *_ in documents())
    runs = {}
    for r in rows:
        runs.setdefault(r["doc_id"], []).append((r["piece"], records[r["slot"]].tolist()))
    single = {i for i, *_ in documents() if i is not None and [d[0] for d in documents()].count(i) == 1}
    texts = {i: t for i, t, *_ in documents()}
    for i in single:
        ids = [x for _, piece in sorted(runs[i]) for x in piece]
        own = encoding.encode_ordinary(texts[i] or "")
        assert ids[: len(own)] == own and set(ids[len(own) :]) == {50256}
    assert len(want) == len(documents())
    assert [x.tolist() for x in token_shards.read_records(folder, 150, 3)] == [x.tolist() for x in records[150:153]]


def test_shards_without_a_manifest_are_not_whole(tmp_path):
    (tmp_path / "shard-00000000.bin").write_bytes(b"\0" * 64)
    with pytest.raises(FileNotFoundError):
        next(token_shards.read_records(str(tmp_path), 0, 1))


def test_cut_texts_encode_like_whole_ones():
    import random

    import tiktoken

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = token_shards.Encoder(open(path, "rb").read(), public_tokenizers.PATTERN)
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_shards_ranks(path), special_tokens={}).encode_ordinary
    r = random.Random(6)
    for _ in range(5000):
        text = "".join(r.choice(" \n\t\xa0\u3000\x1c\x85ab'sé1!") for _ in range(r.randrange(30)))
        assert own.ids(text) == whole(text), repr(text)


def token_shards_ranks(path):
    import base64

    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert token_counts.count_tokens(empty, PATH).count() == 0
    assert bpe_codec.decode(bpe_codec.encode(empty, PATH), PATH).count() == 0
    ordered, total = token_shards.training_order(empty, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    assert total == 0 and ordered.count() == 0
