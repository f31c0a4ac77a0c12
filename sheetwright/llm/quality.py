"""Quality rules as a short-circuit cascade.

Every rule is a test over a batch of texts. On a sample each rule is timed and its rejections counted; rules then run in
the order of rejections per second, and each sees only what the rules before it left. The order changes the time, never
the verdict: a text is kept if no rule rejects it.

Counts are exact. Words, lines and windows are compared as what they are, through dictionaries of their bytes, not by
hashes that could meet.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwright.llm.wordsets import pieces_of

#: Texts of the sample and bytes of its longest; one of SPREAD texts, by hash, is a candidate.
SAMPLE, SAMPLE_BYTES, SPREAD = 512, 64 << 10, 16
#: Least words of a text, and the percentage of words in repeated windows beyond which it goes: the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Fewer lines that repeat earlier ones are no pattern, whatever their share of a short text.
LEAST_DUP_LINES = 3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS = (np.arange(256) & 0xC0) != 0x80  # the first byte of a character
_UPPER, _ALPHA = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA[65:91] = _ALPHA[97:123] = True
_LETTER = _ALPHA.copy()
_LETTER[128:] = True


def _codes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each stretch of bytes, equal for equal bytes, and how many numbers there are."""
    if not len(begins):
        return np.zeros(0, np.int64), 0
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begins] += 1
    inside[ends] -= 1
    packed = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.append(0, np.cumsum(ends - begins)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


class Texts:
    """Texts as UTF-8 bytes and offsets; what is counted of them is counted when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, rows: np.ndarray) -> Texts:
        """Those of ``rows``, with what is counted of them already."""
        sizes = np.diff(self.offsets)
        out = Texts(self.data[np.repeat(rows, sizes)], np.append(0, np.cumsum(sizes[rows])))
        out.__dict__.update({k: v[rows] for k, v in self.__dict__.items() if k in _COUNTED})
        return out

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each text has."""
        total = np.append(0, np.cumsum(marks, dtype=np.int64))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end."""
        space = _SPACE[self.data]
        begins, ends = ~space, ~space
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(self.data))]
        begins[edges], ends[edges - 1] = ~space[edges], ~space[edges - 1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where lines that hold a word begin and end, and the text of each."""
        stops = np.flatnonzero(self.data == 10)
        begins = np.sort(np.concatenate([self.offsets[:-1], stops + 1]))
        ends = np.sort(np.concatenate([stops, self.offsets[1:]]))
        solid = np.append(0, np.cumsum(~_SPACE[self.data], dtype=np.int64))
        full = solid[ends] > solid[np.minimum(begins, ends)]
        begins, ends = begins[full], ends[full]
        return begins, ends, np.searchsorted(self.offsets, begins, "right") - 1

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(np.searchsorted(self._words[0], self.offsets))

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.per_text(_STARTS[self.data] & ~_SPACE[self.data])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.per_text(_SYMBOL[self.data])

    @cached_property
    def n_lines(self) -> np.ndarray:
        """Lines with a word."""
        return np.bincount(self._lines[2], minlength=len(self))

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        begins, ends, texts = self._lines
        codes, many = _codes(self.data, begins, ends)
        different = np.unique(texts * max(1, many) + codes)
        return self.n_lines - np.bincount(different // max(1, many), minlength=len(self))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        codes, many = _codes(self.data, *self._words)
        out = np.zeros(len(self), np.int64)
        if len(codes) < 4:
            return out
        windows = codes[:-2] * many + codes[1:-1]  # many is below 2**31
        if many > 1 << 21:
            windows = np.unique(windows, return_inverse=True)[1]  # numbers of pairs, below 2**31 too
        windows = windows * many + codes[2:]
        at = 0
        for i, n in enumerate(self.n_words.tolist()):
            if n >= 4:
                own = windows[at : at + n - 2]
                order = np.sort(own)
                same = order[1:] == order[:-1]
                if same.any():
                    again = np.isin(own, order[1:][same])
                    covered = np.zeros(n, bool)
                    for j in range(3):
                        covered[j : j + len(again)] |= again
                    out[i] = covered.sum()
            at += n
        return out

    @cached_property
    def letter_words(self) -> np.ndarray:
        """Words with a letter: A-Z, a-z, or a character beyond ASCII."""
        begins, ends = self._words
        letters = np.append(0, np.cumsum(_LETTER[self.data], dtype=np.int64))
        total = np.append(0, np.cumsum(letters[ends] > letters[begins], dtype=np.int64))
        return np.diff(total[np.searchsorted(begins, self.offsets)])

    @cached_property
    def capitals(self) -> np.ndarray:
        """Capital and all letters of A-Z in any case."""
        return np.stack([self.per_text(_UPPER[self.data]), self.per_text(_ALPHA[self.data])], axis=1)


_COUNTED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "letter_words", "capitals")


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Texts], np.ndarray]


#: The rules. Each compares whole numbers, so a text at a limit is kept for sure.
RULES = (
    Rule("few_words", lambda t: t.n_words < LEAST_WORDS),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > MOST_REPEATED * t.n_words),
    Rule("symbols", lambda t: 100 * t.n_symbols > 10 * t.n_words),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)),
    Rule("repeated_lines", lambda t: (t.n_dup_lines >= LEAST_DUP_LINES) & (100 * t.n_dup_lines > 30 * t.n_lines)),
    Rule("no_letters", lambda t: 100 * t.letter_words < 80 * t.n_words),
    Rule("capitals", lambda t: 100 * t.capitals[:, 0] > 60 * t.capitals[:, 1]),
)
BASE = 2  # so many of them are base rules


def measure(texts: list[str], names: list[str]) -> dict[str, tuple[float, int]]:
    """For each rule alone over ``texts``: seconds, rejections."""
    rules, found = {r.name: r for r in RULES}, dict.fromkeys(names, (0.0, 0))
    for _, _, data, offsets in pieces_of(pa.array(texts, pa.string())):
        for name in names:
            fresh, begin = Texts(data, offsets), time.perf_counter()
            rejected = int(rules[name].rejects(fresh).sum())
            found[name] = (found[name][0] + time.perf_counter() - begin, found[name][1] + rejected)
    return found


def order_rules(docs: DataFrame, text: str = "text", names: list[str] | None = None) -> list[str]:
    """Names of the rules by rejections per second on a sample of ``docs``, the best first.

    The sample holds at most SAMPLE texts of at most SAMPLE_BYTES, one of SPREAD by hash, from the first partitions
    that have so many; it decides the order only, which no verdict depends on. Without a sample rules keep their order.
    """
    names = names or [r.name for r in RULES]
    whole = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    picked = whole.where((F.octet_length("text") <= SAMPLE_BYTES) & (F.pmod(F.xxhash64("text"), F.lit(SPREAD)) == 0)).limit(SAMPLE).collect()  # 32 MB at most
    found = measure([r["text"] for r in picked], names)
    return sorted(names, key=lambda n: -found[n][1] / max(found[n][0], 1e-9))


def cascade(texts: Texts, names: list[str]) -> np.ndarray:
    """Which texts no rule rejects; each rule sees only what is left."""
    rules = {r.name: r for r in RULES}
    left, now = np.arange(len(texts)), texts
    for name in names:
        if not len(left):
            break
        bad = rules[name].rejects(now)
        if bad.any():
            left, now = left[~bad], now.take(~bad)
    kept = np.zeros(len(texts), bool)
    kept[left] = True
    return kept


def _digest(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Base counts of all texts; the cascade runs over those that the base rules left."""
    for batch in batches:
        for at, end, data, offsets in pieces_of(batch.column(1)):
            t = Texts(data, offsets)
            failed = RULES[0].rejects(t) | RULES[1].rejects(t)
            kept = ~failed
            kept[kept] = cascade(t.take(kept), names)
            counts = [pa.array(c.astype(np.int64)) for c in (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *counts, pa.array(failed), pa.array(kept)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of each text.

    Words are runs of characters other than space and \\x09-\\x0D; ``word_chars`` are their code points, ``n_symbols``
    the characters of ``#*$%&|<>``, ``n_dup_lines`` the lines (cut at \\n) with a word that equal an earlier line, and
    ``n_repeat_words`` the words that lie in a window of three words found twice or more. ``base_failed``: fewer than
    LEAST_WORDS words, or more than MOST_REPEATED percent of them repeated. ``kept``: no rule of RULES rejects the text.

    A null text has no words and fails. Every row has a result, repeated and null ids included; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = order_rules(rows, names=[r.name for r in RULES[BASE:]])
    return rows.mapInArrow(partial(_digest, names=names), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def _filter(batches: Iterator[pa.RecordBatch], names: list[str], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in pieces_of(batch.column(column)):
            yield batch.slice(at, end - at).filter(pa.array(cascade(Texts(data, offsets), names)))


def good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; counts stop at a text's first rejection.

    Rows with a null text go (no words). Repeated rows are judged alike; an empty table gives an empty result.
    """
    names = order_rules(docs, text)
    return docs.mapInArrow(partial(_filter, names=names, column=docs.columns.index(text)), docs.schema)
