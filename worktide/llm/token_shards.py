"""Training-order materialisation of token ids as fixed-stride binary shards.

Each text's token ids, and END after them, are cut into sequences of STRIDE ids;
the last is filled up with END. Sequences are numbered 0 to N - 1 in the order of
the input's partitions, and a keyed Feistel permutation of the least even number
of bits that holds N, walked along its cycle until it falls below N, gives every
sequence its slot in training order: no sort key is drawn or stored, and any
slot's sequence, or any sequence's slot, can be computed from the key alone.

Slots are cut into shards of PER_SHARD; a shard is one partition, placed by its
number, sorted by slot, and written as one file of unsigned 16-bit little-endian
ids. Record i of shard s is slot s * PER_SHARD + i at byte i * 2 * STRIDE, so a
reader can seek to where it stopped. Since slots are a permutation, shards are
equal in size whatever the input's skew.

Two passes: the first only counts the sequences of each partition (a number each
to the driver), the second makes them. Both encode: keeping the first pass's ids
would put a third copy of the corpus on disk beside shuffle and shards. Both must
see the same partitions, as reads of one table do (save any other frame first); a
partition whose count differs fails the job. A shard is written under an
attempt's name and then moved into place, so a repeated task leaves one whole
file. All shards are written by one action; then MANIFEST is published, with the
number of sequences and shards, stride and key. Without it the set is not whole, and
readers refuse it; the rows that ``write_shards`` returns are read from what that
action wrote. The shards' folder must be one that all executors share.

A splitting pattern that looks ahead for the end of white space steps back over
whole runs of it. Such texts are cut there first and split by the rest of the
pattern, which needs no stepping back: the same ids, in a time that does not
depend on the runs. Texts reach Python in batches bounded by bytes.

Null text counts as empty and gives one sequence of END. Repeated rows give their
own sequences. Extra columns are not read. No rows give no shards.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from worktide.llm._common import in_small_batches, saved

STRIDE, PER_SHARD, KEY, ROUNDS = 256, 1 << 16, 0x5DEECE66D1234567, 6
# White space as the splitting pattern's \\s has it, and its look-ahead.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
MANIFEST = "manifest.json"
LOOK_AHEAD, REST = r"\s+(?!\S)|", r"\s+"
RUN = re.compile(f"{WHITE}{{2,}}")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slots(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of sequences ``index`` under the permutation of range(n)."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * (2 * r + 1) + r) & 0xFFFFFFFFFFFFFFFF) for r in range(rounds)]
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[walking] = left << np.uint64(half) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


class Encoder:
    """Ids of whole texts under a file of byte tokens by rank."""

    def __init__(self, file: bytes, pattern: str):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.looks = pattern.endswith(LOOK_AHEAD + REST)
        plain = pattern.replace(LOOK_AHEAD, "") if self.looks else pattern
        self.plain = tiktoken.Encoding("file", pat_str=plain, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        """A run of white space is one piece, but for its last character where more
        text follows: that goes with what follows or is a piece by itself."""
        out, at = [], 0
        for run in RUN.finditer(text) if self.looks else ():
            if run.end() < len(text):
                out += self.plain(text[at : run.end() - 1])
                at = run.end() - 1
        return out + self.plain(text[at:]) if at else self.plain(text)


@lru_cache(maxsize=2)
def encoder(file: bytes, pattern: str) -> Encoder:
    return Encoder(file, pattern)


class Tokens:
    """Sequences of a text under the vocabulary that the driver read."""

    def __init__(self, spark, path: str, pattern: str, stride: int):
        with open(path, "rb") as f:
            self.file = spark.sparkContext.broadcast(f.read())  # a fixed vocabulary file
        self.end = self.file.value.count(b"\n")  # the first id that no token has
        self.pattern, self.stride = pattern, stride
        if self.end >= 1 << 16:
            raise ValueError("ids must fit 16 bits")

    def sequences(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """A matrix of ids for each text, STRIDE to a row."""
        ids_of = encoder(self.file.value, self.pattern).ids
        for text in texts:
            ids = ids_of(text.as_py() or "")
            n = len(ids) // self.stride + 1
            out = np.full(n * self.stride, self.end, "<u2")
            out[: len(ids)] = ids
            yield out.reshape(n, self.stride)

    def counts(self, docs: DataFrame) -> list[int]:
        """How many sequences each partition has."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids_of, n = encoder(self.file.value, self.pattern).ids, 0
            for batch in batches:
                n += sum(len(ids_of(text.as_py() or "")) // self.stride + 1 for text in batch["text"])
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64())], names=["part", "n"])

        found = {r["part"]: r["n"] for r in docs.mapInArrow(count, "part int, n long").collect()}
        return [found.get(p, 0) for p in range(max(found, default=-1) + 1)]


def training_order(docs: DataFrame, tokenizer_path: str, pattern: str, stride: int = STRIDE, per_shard: int = PER_SHARD, key: int = KEY) -> tuple[DataFrame, int]:
    """(slot, shard, doc_id, piece, record) in shards, and the number of sequences."""
    docs = in_small_batches(docs.select("doc_id", "text"))
    tokens = Tokens(docs.sparkSession, tokenizer_path, pattern, stride)
    counts = tokens.counts(docs)
    total, first = sum(counts), np.concatenate([[0], np.cumsum(counts)]).tolist()
    names = ["slot", "shard", "doc_id", "piece", "record"]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at = first[part] if part < len(counts) else total
        stop = first[part + 1] if part < len(counts) else total
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            held, owners, pieces = [], [], []
            for i, rows in enumerate(tokens.sequences(batch["text"])):
                held.append(rows)
                owners += [ids[i]] * len(rows)
                pieces += range(len(rows))
                if len(owners) >= 4096 or i == len(ids) - 1:
                    slot = slots(np.arange(at, at + len(owners)), total, key)
                    at += len(owners)
                    if at > stop:
                        raise RuntimeError(f"partition {part} has more sequences than were counted")
                    record = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * stride), len(owners), [None, pa.py_buffer(np.concatenate(held).tobytes())]).cast(pa.binary())
                    columns = [pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), pa.array(owners, batch["doc_id"].type), pa.array(pieces, pa.int32()), record]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    held, owners, pieces = [], [], []
        if at != stop:
            raise RuntimeError(f"partition {part} has fewer sequences than were counted")

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(order, f"slot long, shard int, doc_id {kind}, piece int, record binary")
    shards = max(1, -(-total // per_shard))
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot"), total


def place(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_shards(ordered: DataFrame, folder: str, stride: int = STRIDE, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Write all shards, then the manifest; a row for each sequence: slot, shard, offset
    (bytes), doc_id, piece and the record's SHA-256."""
    names = ["slot", "shard", "offset", "doc_id", "piece", "record_sha256"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = files = shard = None
        temporary = final = ""
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                shard = batch["shard"][0].as_py()
                files, top = place(folder)
                final, temporary = f"{top}/shard-{shard:08d}.bin", f"{top}/.shard-{shard:08d}.{uuid.uuid4().hex}"
                files.create_dir(top, recursive=True)
                out = files.open_output_stream(temporary)
            records = batch["record"].to_pylist()
            out.write(b"".join(records))
            slot = batch["slot"].to_numpy()
            offset = (slot - shard * per_shard) * len(records[0])
            digest = [hashlib.sha256(r).hexdigest() for r in records]
            yield pa.RecordBatch.from_arrays([batch["slot"], batch["shard"], pa.array(offset), batch["doc_id"], batch["piece"], pa.array(digest)], names=names)
        if out is not None:
            out.close()
            files.move(temporary, final)

    kind = ordered.schema["doc_id"].dataType.simpleString()
    done = saved(ordered.mapInArrow(write, f"slot long, shard int, offset long, doc_id {kind}, piece int, record_sha256 string"))
    total, shards = done.agg(F.count(F.lit(1)), F.count_distinct("shard")).first()
    files, top = place(folder)
    files.create_dir(top, recursive=True)
    temporary = f"{top}/.{MANIFEST}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        out.write(json.dumps({"sequences": total, "shards": shards, "per_shard": per_shard, "stride": stride, "key": key}).encode())
    files.move(temporary, f"{top}/{MANIFEST}")
    return done


def read_manifest(folder: str) -> dict:
    """What a whole set of shards holds; FileNotFoundError if it is not whole."""
    files, top = place(folder)
    with files.open_input_file(f"{top}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_records(folder: str, start: int, count: int) -> Iterator[np.ndarray]:
    """Sequences in training order from slot ``start`` on, by seeking."""
    known, (files, top) = read_manifest(folder), place(folder)
    stride, per_shard = known["stride"], known["per_shard"]
    count = min(count, known["sequences"] - start)
    while count > 0:
        shard, at = divmod(start, per_shard)
        with files.open_input_file(f"{top}/shard-{shard:08d}.bin") as f:
            f.seek(at * 2 * stride)
            data = f.read(2 * stride * min(count, per_shard - at))
        rows = np.frombuffer(data, "<u2").reshape(-1, stride)
        if not len(rows):
            raise EOFError(f"shard {shard} is shorter than the manifest says")
        yield from rows
        start, count = start + len(rows), count - len(rows)
