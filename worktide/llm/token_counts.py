"""Token counts by finite-state transducers.

Two machines are compiled from a byte-level BPE vocabulary.

*The splitter* is a deterministic transducer over character classes that marks
where a pre-token begins. A slice of text is cut into chunks of fixed length;
every chunk is run from all entry states at once, which gives its state map
(entry state -> exit state). The maps compose, and a parallel prefix scan over
the chunks gives each chunk's true entry state; a second run from that state
marks the boundaries. All chunks advance in step, as numpy columns.

*The counter* is a deterministic transducer over the bytes of a pre-token whose
transitions carry the change in the number of emitted tokens. Its state is the
longest suffix that a token can still extend, with the last token and the
relative count at every position inside that suffix; nothing before it can
change what follows. A state's successor needs no merge simulation of the whole
word: of the tokens that end here, exactly one is compatible with the last
token in front of it. States are built when first reached and the table is
dropped when it is full, so memory is bounded.

Null text counts as empty. A special string inside a text is one token. Repeated
rows get equal counts; other columns pass through untouched, whatever they are
called, except that a column named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from worktide.llm import _bpe
from worktide.llm._common import in_small_batches

SLICE_CHARS = 1 << 20
CHUNK = 512
MAX_STATES = 400_000
MAX_WORDS = 400_000

# Character classes of the splitter.
(OTHER, LETTER, STMD, R, V, L, E, NUMBER, SPACE, BLANK, QUOTE, END) = range(12)
# Its states: at a token's start, in a run of letters, numbers or others, in
# white space (one or several, the last a space or not), after a quote that may
# begin a contraction, and after a quote and r, v or l.
(START, LET, NUM, OTH, SP1, BL1, SPN, BLN, APO, AR, AV, AL) = range(12)
HERE, BEFORE = 1, 2


@lru_cache(maxsize=1)
def class_of_code_point() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    codes = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    place = np.zeros(0x110000, bool)
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", BLANK)):
        place[:] = False
        for m in regex.finditer(pattern + "+", every):
            table[codes[m.start() : m.end()]] = cls
    for chars, cls in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), (" ", SPACE), ("'", QUOTE)):
        for c in chars:
            table[ord(c)] = cls
    return table


@lru_cache(maxsize=1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, boundary marks), both indexed by state * 12 + class."""
    letters = (LETTER, STMD, R, V, L, E)
    fresh = {**dict.fromkeys(letters, LET), NUMBER: NUM, OTHER: OTH, QUOTE: APO, SPACE: SP1, BLANK: BL1, END: START}
    after_space = fresh | {QUOTE: OTH}
    step, mark = np.zeros(144, np.uint8), np.zeros(144, np.uint8)

    def put(state: int, cls: int, to: int, marks: int) -> None:
        step[state * 12 + cls], mark[state * 12 + cls] = to, marks

    for cls in range(12):
        kind = fresh[cls]
        put(START, cls, kind, HERE)
        run = {LET: LET, NUM: NUM, OTH: OTH, APO: OTH}.get(kind)
        for state in (LET, NUM, OTH):
            put(state, cls, *((state, 0) if run == state else (kind, HERE)))
        for state, last_is_space, several in ((SP1, True, False), (BL1, False, False), (SPN, True, True), (BLN, False, True)):
            if cls in (SPACE, BLANK):
                put(state, cls, SPN if cls == SPACE else BLN, 0)
            elif cls == END:
                put(state, cls, START, HERE)
            else:
                put(state, cls, after_space[cls] if last_is_space else kind, BEFORE * several | HERE * (not last_is_space))
        # A quote at a token's start: a contraction, or else the start of a run of others.
        if cls in (OTHER, QUOTE):
            put(APO, cls, OTH, 0)
        elif cls == STMD:
            put(APO, cls, START, 0)
        else:
            put(APO, cls, {R: AR, V: AV, L: AL}.get(cls, kind), 0 if cls in (R, V, L) else HERE)
        for state, done in ((AR, E), (AV, E), (AL, L)):
            if cls == done:
                put(state, cls, START, 0)
            else:
                to = step[LET * 12 + cls]
                put(state, cls, to, BEFORE | mark[LET * 12 + cls])
    return step, mark


def entry_states(columns: np.ndarray) -> np.ndarray:
    """Each chunk's entry state, by composing the chunks' state maps.

    columns: character classes, one column of CHUNK rows for each chunk.
    """
    step, n = splitter()[0], columns.shape[1]
    maps = np.tile(np.arange(12, dtype=np.uint8)[:, None], (1, n))
    live, settled = np.arange(n), np.zeros(0, np.intp)
    wide, narrow = maps.copy(), np.zeros(0, np.uint8)
    for j in range(columns.shape[0]):
        if live.size:
            wide = step[wide * np.uint8(12) + columns[j, live]]
        if settled.size:
            narrow = step[narrow * np.uint8(12) + columns[j, settled]]
        if live.size and j % 16 == 15:
            same = (wide == wide[0]).all(axis=0)  # all entry states have met
            settled, narrow = np.concatenate([settled, live[same]]), np.concatenate([narrow, wide[0, same]])
            live, wide = live[~same], wide[:, ~same]
    maps[:, live] = wide
    maps[:, settled] = narrow
    width = 1
    while width < n:  # Hillis-Steele scan under composition
        maps[:, width:] = np.take_along_axis(maps[:, width:], maps[:, :-width].astype(np.intp), axis=0)
        width *= 2
    return np.concatenate([np.zeros(1, np.uint8), maps[START, :-1]])


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. The last class must be END."""
    step, mark = splitter()
    n = len(classes)
    padded = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(-1, CHUNK).T)
    state = entry_states(columns)
    marks = np.empty_like(columns)
    for j in range(CHUNK):
        at = state * np.uint8(12) + columns[j]
        marks[j], state = mark[at], step[at]
    flat = marks.T.reshape(-1)[:n]
    begins = (flat & HERE) > 0
    begins[:-1] |= (flat[1:] & BEFORE) > 0
    return np.flatnonzero(begins)


def split_words(pieces: list[str]) -> tuple[list[str], np.ndarray]:
    """Pre-tokens of all pieces in order, and how many each piece has."""
    joined = "\n".join(pieces) + "\n"
    classes = class_of_code_point()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    classes[ends] = END
    begins = boundaries(classes)
    stops = np.append(begins[1:], len(joined))
    inside = classes[begins] != END
    begins, stops = begins[inside], stops[inside]
    count = np.diff(np.searchsorted(begins, ends, "left"), prepend=0)
    return [joined[a:b] for a, b in zip(begins.tolist(), stops.tolist())], count


class Counter(dict):
    """Pre-token -> number of tokens; a missing one is run through the transducer."""

    def __init__(self, vocabulary: _bpe.Vocabulary):
        super().__init__()
        self.id_of, self.bytes_of = vocabulary.id_of, vocabulary.bytes_of
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(vocabulary.merges)}
        self.prefixes = {t[:i] for t in self.id_of for i in range(len(t))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear_states()

    def clear_states(self) -> None:
        root = (b"", (-1,), (0,))
        self.states, self.number, self.step = [root], {root: 0}, {}

    def merged(self, symbols: list[int]) -> list[int]:
        """Plain merging, for the few pairs of tokens that are looked at."""
        while len(symbols) > 1:
            (rank, token), i = min(((self.rank.get(p, (1 << 60, 0))), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[i : i + 2] = [token]
        return symbols

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            text = self.bytes_of[a] + self.bytes_of[b]
            known = self.fits[a, b] = self.merged([self.id_of[text[i : i + 1]] for i in range(len(text))]) == [a, b]
        return known

    def build(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of ``state`` on ``byte``: next state, tokens emitted."""
        suffix, last, counts = self.states[state]
        text = suffix + bytes((byte,))
        for i in range(len(text)):
            token = self.id_of.get(text[i:])
            if token is not None and (last[i] < 0 or self.compatible(last[i], token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        emitted = counts[i] + 1
        keep = next(k for k in range(len(text) + 1) if text[k:] in self.prefixes)
        key = (text[keep:], (*last, token)[keep:], tuple(c - emitted for c in (*counts, emitted)[keep:]))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        self.step[state << 8 | byte] = to, emitted
        return to, emitted

    def __missing__(self, word: str) -> int:
        if len(self.states) > MAX_STATES:
            self.clear_states()
        state = total = 0
        get = self.step.get
        for byte in word.encode():
            state, emitted = get(state << 8 | byte) or self.build(state, byte)
            total += emitted
        if len(self) > MAX_WORDS:
            self.clear()
        self[word] = total
        return total


@lru_cache(maxsize=1)
def _counter(vocabulary_file: str) -> Counter:
    return Counter(_bpe.parsed(vocabulary_file))


def count_texts(counter: Counter, vocabulary: _bpe.Vocabulary, texts: list[str]) -> list[int]:
    pieces, owner, totals = [], [], [0] * len(texts)
    for i, text in enumerate(texts):
        parts = vocabulary.pieces(text)
        totals[i] = len(parts) // 2
        pieces += parts[::2]
        owner += [i] * len(parts[::2])
    words, per_piece = split_words(pieces)
    counts = np.fromiter(map(counter.__getitem__, words), np.int64, len(words))
    sums = np.concatenate([[0], np.cumsum(counts)])
    ends = np.cumsum(per_piece)
    for i, n in zip(owner, (sums[ends] - sums[ends - per_piece]).tolist()):
        totals[i] += n
    return totals


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters; a longer text is its own run."""
    run, chars = [], 0
    for text in texts:
        if run and chars + len(text) > most:
            yield run
            run, chars = [], 0
        run.append(text)
        chars += len(text) + 1
    if run:
        yield run


def token_count_udf(spark, tokenizer_path: str):
    """A column function: text -> number of tokens (long)."""
    held = _bpe.broadcast_vocabulary(spark, tokenizer_path)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter, vocabulary = _counter(held.value), _bpe.parsed(held.value)
        for batch in batches:
            out: list[int] = []
            for run in slices([t or "" for t in batch]):
                out += count_texts(counter, vocabulary, run)
            yield pd.Series(out, dtype="int64")

    return n_tokens


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", result: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text.

    No shuffle: one pass over the rows, one Arrow column to Python and one back.
    """
    return in_small_batches(docs).withColumn(result, token_count_udf(docs.sparkSession, tokenizer_path)(F.col(text)))
