"""BPE encoding by batched numpy merge rounds, and decoding.

The distinct pre-tokens of a slice of texts that the worker has not met yet are
laid end to end in one flat symbol array. A round looks up every adjacent pair
of symbols by binary search in the sorted pair keys, takes the lowest rank in
each word, merges all its places at once (left to right, not overlapping) and
closes the gaps; words without a known pair leave the array. Merging every
place of a pair at once equals merging one at a time, as a pair that holds the
new token always ranks later.

Encoded texts are binary: token ids as little-endian unsigned 32-bit integers.
Null text counts as empty; a special string inside a text is its one token.
Repeated rows encode alike. Other columns pass through; one named as the result
is replaced. Ids outside the vocabulary are an error when decoding; bytes that
are no UTF-8 decode to U+FFFD, null ids to null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from worktide.llm import _bpe
from worktide.llm._common import in_small_batches

SLICE_CHARS = 1 << 20
#: Words of a generation of the cache; the one before it is kept beside it.
MAX_WORDS = 100_000
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Pre-token -> packed ids, for the pre-tokens met so far."""

    def __init__(self, vocabulary: _bpe.Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self.find = regex.compile(SPLIT).findall
        keys = np.array([a << 32 | b for a, b, _ in vocabulary.merges], np.int64)
        self.order = np.argsort(keys, kind="stable")  # place in key order -> rank
        self.keys = keys[self.order]
        self.product = np.array([c for _, _, c in vocabulary.merges], np.int64)
        self.single = np.array([vocabulary.id_of[bytes((b,))] for b in range(256)], np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ranks(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each symbol; the number of merges if none."""
        none = len(self.keys)
        out = np.full(len(symbols), none, np.int64)
        if none and len(symbols) > 1:
            pairs = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pairs), none - 1)
            hit = (self.keys[at] == pairs) & (word[:-1] == word[1:])
            out[:-1][hit] = self.order[at[hit]]
        return out

    def learn(self, words: list[str]) -> None:
        """Encode new words together and keep their packed ids."""
        if not words:
            return
        raw = [w.encode() for w in words]
        symbols = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        while len(symbols):
            rank = self.ranks(symbols, word)
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(rank, begins)
            length = np.diff(np.append(begins, len(word)))
            done = np.repeat(lowest == len(self.keys), length)
            if done.any():
                packed, of = symbols[done].astype("<u4").tobytes(), word[done]
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                for a, b, w in zip(cuts.tolist(), np.append(cuts[1:], len(of)).tolist(), of[cuts].tolist()):
                    self.known[words[w]] = packed[4 * a : 4 * b]
                symbols, word, rank = symbols[~done], word[~done], rank[~done]
                lowest, length = lowest[lowest < len(self.keys)], length[lowest < len(self.keys)]
                if not len(symbols):
                    break
            chosen = rank == np.repeat(lowest, length)
            place = np.arange(len(symbols))
            run = np.maximum.accumulate(np.where(chosen & ~np.append(False, chosen[:-1]), place, 0))
            chosen &= (place - run) % 2 == 0
            symbols[chosen] = self.product[rank[chosen]]
            stay = ~np.append(False, chosen[:-1])
            symbols, word = symbols[stay], word[stay]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.vocabulary.pieces(t) for t in texts]
        found = [[self.find(p) if i % 2 == 0 else None for i, p in enumerate(parts)] for parts in split]
        if len(self.known) > MAX_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = {w for text in found for words in text if words for w in words if w not in known}
        if new:
            known.update((w, older[w]) for w in new if w in older)
            self.learn([w for w in new if w not in older])
        get, out = self.known.__getitem__, []
        for parts, text in zip(split, found):
            out.append(b"".join(b"".join(map(get, w)) if w is not None else self.vocabulary.special[p].to_bytes(4, "little") for p, w in zip(parts, text)))
        return out


@lru_cache(maxsize=1)
def encoder(vocabulary_file: str) -> Encoder:
    return Encoder(_bpe.parsed(vocabulary_file))


def runs(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, as lists of about SLICE_CHARS characters; null as empty."""
    run, size = [], 0
    for text in texts:
        value = text.as_py() or ""
        if run and size + len(value) > SLICE_CHARS:
            yield run
            run, size = [], 0
        run.append(value)
        size += len(value) + 1
    if run:
        yield run


def with_column(df: DataFrame, result: str, kind: str, values) -> DataFrame:
    """``df`` with a column made from record batches, slice by slice.

    values: batch -> iterator of lists, in order. Slices keep the Python
    worker's memory to a few megabytes of text whatever Spark's batch size.
    """
    own = [f for f in df.schema.fields if f.name.lower() != result.lower()]
    arrow, sql = {"binary": (pa.binary(), T.BinaryType()), "string": (pa.string(), T.StringType())}[kind]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, at = batch.select([f.name for f in own]), 0
            for out in values(batch):
                part = kept.slice(at, len(out))
                at += len(out)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, arrow)], names=[*part.schema.names, result])
        encoder.cache_clear()  # a worker that waits for other work holds no vocabulary
        _bpe.parsed.cache_clear()

    return in_small_batches(df).mapInArrow(fill, T.StructType([*own, T.StructField(result, sql)]))


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", result: str = "ids") -> DataFrame:
    """``docs`` with each whole text's token ids, packed. No shuffle."""
    held = _bpe.broadcast_vocabulary(docs.sparkSession, tokenizer_path)

    def packed(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
        return map(encoder(held.value).encode, runs(batch[text]))

    return with_column(docs, result, "binary", packed)


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", result: str = "decoded") -> DataFrame:
    """``encoded`` with the text that each row's packed ids stand for. No shuffle."""
    held = _bpe.broadcast_vocabulary(encoded.sparkSession, tokenizer_path)

    def texts(batch: pa.RecordBatch) -> Iterator[list[str | None]]:
        get = _bpe.parsed(held.value).bytes_of.__getitem__
        for at in range(0, len(batch), 256):
            packed = batch[ids].slice(at, 256).to_pylist()
            yield [None if b is None else b"".join(map(get, np.frombuffer(b, "<u4").tolist())).decode("utf-8", "replace") for b in packed]

    return with_column(encoded, result, "string", texts)
