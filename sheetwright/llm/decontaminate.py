"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with k = floor(rate * m) edits. Split into k + 1 pieces, at least one
piece occurs unchanged, so one Aho-Corasick pass over a text finds every place that can match. Such places are
verified with Myers' bit-parallel edit distance, which gives the item's least distance in the text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwright.llm.common import saved

#: Edits allowed for a character of an item; characters of items that one pass over the texts carries.
RATE, BLOCK_CHARS = 0.06, 8 << 20


def normalised(text: str | None) -> str:
    """Lower case, each run of white space one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece) of the error budget plus one nearly equal pieces of ``item``."""
    n = min(int(rate * len(item)) + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_distance(item: str, text: str) -> int:
    """Edits between ``item`` and the substring of ``text`` that needs fewest (Myers 1999)."""
    m = len(item)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    mask, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(across | plus) & mask, plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up, down = up << 1 & mask, down << 1 & mask
        plus, minus = down | ~(eq | minus | up) & mask, up & (eq | minus)
    return best


class Matcher:
    """The pieces of all items in one automaton."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float) -> None:
        self.items = items
        self.budget = [int(rate * len(text)) for _, text in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text) in enumerate(items):
            for offset, piece in pieces(text, rate):
                places[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int]]:
        """(item id, least distance) of every item within its budget in ``text``, by item id."""
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                begin = end + 1 - size - offset
                windows[i].append((begin - self.budget[i], begin + len(self.items[i][1]) + self.budget[i]))
        out: dict[int, int] = {}
        for i, spans in windows.items():
            name, item = self.items[i]
            if item in text:
                best = 0
            else:
                best, (a, b) = len(item), spans[0]
                for c, d in [*spans[1:], (1 << 62, 1 << 62)]:  # begins don't fall by more than an item's length
                    if a <= c <= b:
                        b = max(b, d)
                    else:
                        best = min(best, least_distance(item, text[max(0, a) : b]))
                        a, b = c, d
            if best <= self.budget[i]:
                out[name] = min(best, out.get(name, best))
        return sorted(out.items())


@lru_cache(maxsize=1)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    """A worker builds a block's automaton once, not in every task."""
    return Matcher(items, rate)


def _match(batches: Iterator[pa.RecordBatch], items: tuple[tuple[int, str], ...], rate: float) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text, items, edits) with this block's matches appended."""
    matcher = _matcher(items, rate)
    for batch in batches:
        names, edits = [], []
        for text, old, cost in zip(*batch.columns[1:], strict=True):
            hits = matcher.found(normalised(text.as_py()))
            names.append([*old.as_py(), *(i for i, _ in hits)])
            edits.append([*cost.as_py(), *(e for _, e in hits)])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, kind), pa.array(edits, kind)], batch.schema.names)


def _keep(batches: Iterator[pa.RecordBatch], items: tuple[tuple[int, str], ...], rate: float, column: int) -> Iterator[pa.RecordBatch]:
    """The rows whose text holds no item of this block."""
    matcher = _matcher(items, rate)
    for batch in batches:
        yield batch.filter(pa.array([not matcher.found(normalised(text.as_py())) for text in batch.column(column)], pa.bool_()))


def _by_blocks(docs: DataFrame, benchmark: DataFrame, step) -> DataFrame:
    """``docs`` after ``step(docs, items)`` for each block of items, one block after another."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and trim(text) <> ''").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-chars // BLOCK_CHARS)
    for block in range(blocks):  # one, unless the items outgrow what a task should carry
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        held = tuple((r["item_id"], text) for r in rows if (text := normalised(r["text"])))
        if held:
            docs = step(docs, held)
            if blocks > 1:  # the next block starts from a table, so neither driver nor task holds more than one block
                docs = saved(docs, "leaks")
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Test items in every whole text: doc_id, contaminated, n_items, item_ids (ascending), edits (of each).

    Both sides are lower-cased and white space is collapsed. An item occurs where a substring lies within
    floor(rate * length) edits of it; ``edits`` is the least distance in the text. Items that are null or
    blank, or have no id, take no part; rows of an item id count as one item, found if any of them is. Null
    and empty texts hold nothing. Null doc_ids are passed on, repeated rows judged alike, other columns are
    ignored, whatever their names. Empty tables: no documents give no rows, no items give clean documents.

    Items travel to the tasks in blocks of at most about ``BLOCK_CHARS`` characters, one after another.
    """
    none = F.array().cast("array<bigint>")
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), none.alias("items"), none.alias("costs"))
    out = _by_blocks(kept, benchmark, lambda df, items: df.mapInArrow(partial(_match, items=items, rate=rate), "doc_id long, text string, items array<bigint>, costs array<bigint>"))
    ids = F.array_sort(F.array_distinct("items"))
    edits = F.transform(ids, lambda i: F.array_min(F.transform(F.filter("pairs", lambda p: p["items"] == i), lambda p: p["costs"])))
    out = out.withColumn("pairs", F.arrays_zip("items", "costs"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), edits.alias("edits"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with the columns of ``docs``, whatever they are called."""
    column = docs.columns.index("text")
    return _by_blocks(docs, benchmark, lambda df, items: df.mapInArrow(partial(_keep, items=items, rate=rate, column=column), docs.schema))
