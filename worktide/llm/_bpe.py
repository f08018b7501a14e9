"""Byte-level BPE vocabulary files: read once, shipped as one broadcast.

The file is a fixed input of about a megabyte, whatever the corpus, so it may
be broadcast. Executors parse it once per Python worker.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=4)
def _file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=4)
def _broadcast(session_key: str, path: str, context) -> object:
    return context.broadcast(_file(path))


def broadcast_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file at ``path`` (on the driver) as a Spark broadcast."""
    context = spark.sparkContext
    return _broadcast(context.applicationId, path, context)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable
    Latin-1 stands for itself, the other bytes for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges in order of rank, and the added special strings."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        self.raw = lambda token: bytes(letters[c] for c in token)
        self.id_of = {self.raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s in self.special:
            self.id_of.pop(s.encode(), None)
        self.bytes_of = {i: t for t, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        strings = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        self._text = text

    @cached_property
    def merges(self) -> list[tuple[int, int, int]]:
        """(left id, right id, merged id) by rank."""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in json.loads(self._text)["model"]["merges"])
        return [(self.id_of[x], self.id_of[y], self.id_of[x + y]) for x, y in ((self.raw(a), self.raw(b)) for a, b in pairs)]

    def pieces(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        return self._special.split(text) if self._special else [text]


@lru_cache(maxsize=2)
def parsed(text: str) -> Vocabulary:
    return Vocabulary(text)
