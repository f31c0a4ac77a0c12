"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted for each cell of (source, language, topic). The table of cells is bounded, since whatever isn't
listed is one category; raking fits it to the target margins in turn until they hold, with no cell above the weight
at which all its documents are kept. A document's chance is the kept share times its cell's fitted weight over its
natural one; a hash of the document decides. So kept tokens have the target margins in expectation, as far as there
are tokens for them; ``achieved`` shows what a sample has and ``rake`` warns where a margin can't be met.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright.llm.common import saved

OTHER = "(other)"
#: Without stated targets, values with at least one LISTED-th of all tokens are listed (so at most LISTED of them):
#: sources in equal parts, languages and topics by their share to the power of LEVEL, which at most doubles a share.
#: On each axis what isn't listed keeps its natural share, and listed ones share the rest.
LISTED, LEVEL = 200, 0.87
TOLERANCE, ROUNDS = 1e-10, 2000
#: Share of all tokens that is kept in expectation.
KEEP = 0.5
_AXES = ("source", "lang", "topic")
_CELL = "source string, lang string, topic string, chance double"


def words(text: Column) -> Column:
    """How many words a text has: the pieces between white space, but for empty ones at its ends."""
    whole = F.coalesce(text, F.lit(""))
    ends = whole.rlike(r"^\s").cast("int") + F.substring(whole, -1, 1).rlike(r"\s").cast("int")
    return F.when(whole.rlike(r"\S"), F.size(F.split(whole, r"\s+")) - ends).otherwise(0).cast("long")


def topic(text: Column) -> Column:
    """The form of a text, the topic of documents without such a column.

    short (fewer than 60 words), tables (a column mark for every eight words), code (a brace, bracket, semicolon
    or equals sign for every six words), figures (a digit for every twelve words), or prose: the first that holds.
    """
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9|\t{}\[\];=]+", "")
    # One array of one value, so that words and marks are counted once for all cases.
    facts = F.array(F.struct(words(text).alias("words"), marks.alias("marks")))
    often = lambda f, other, each: F.length(F.regexp_replace(f["marks"], other, "")) * each >= f["words"]
    form = lambda f: F.when(f["words"] < 60, "short").when(often(f, r"[^|\t]", 8), "tables").when(often(f, r"[^{}\[\];=]", 6), "code").when(often(f, "[^0-9]", 12), "figures").otherwise("prose")
    return F.transform(facts, form)[0]


def rake(mass: np.ndarray, targets: list[np.ndarray], keep: float = KEEP) -> np.ndarray:
    """Scale ``mass`` until its margins are ``targets`` (each summing to 1), no cell above ``mass / keep``.

    Categories without mass are left out. A category whose cells are all at their bound stays short of its
    target; the next axis then shares out what is missing. A warning says which margins are off in the end.
    """
    natural = mass / mass.sum()
    most = natural / keep
    fitted = natural.copy()
    wants = []
    for axis, target in enumerate(targets):
        want = np.where(natural.sum(axis=tuple(i for i in range(mass.ndim) if i != axis)) > 0, target, 0)
        wants.append(want / want.sum())
    for _ in range(ROUNDS):
        before = fitted
        for axis, want in enumerate(wants):
            rest = tuple(i for i in range(mass.ndim) if i != axis)
            shape = [-1 if i == axis else 1 for i in range(mass.ndim)]
            for _ in range(50):  # scale the cells of each category that are below their bound
                free = fitted < most
                held, open_ = np.where(free, 0, fitted).sum(axis=rest), np.where(free, fitted, 0).sum(axis=rest)
                factor = np.divide(np.maximum(want - held, 0), open_, out=np.ones_like(want), where=open_ > 0)
                fitted = np.where(free, np.minimum(fitted * factor.reshape(shape), most), fitted)
                if not ((fitted >= most) & free).any():
                    break
            over = fitted.sum(axis=rest)
            fitted = fitted * np.where(over > want, want / np.where(over > 0, over, 1), 1).reshape(shape)
        if np.abs(fitted - before).max() < TOLERANCE:
            break
    off = [(axis, int(i), float(want[i]), float(got)) for axis, want in enumerate(wants) for i, got in enumerate(fitted.sum(axis=tuple(j for j in range(mass.ndim) if j != axis))) if abs(got - want[i]) > 1e-4]
    if off:
        warnings.warn(f"margins that can't be met while keeping {keep:g} of the tokens (axis, category, target, fitted): {off[:20]}", stacklevel=2)
    return fitted


def _category(column: Column, listed: Mapping[str, float]) -> Column:
    return F.when(column.isin(list(listed)), column).otherwise(F.lit(OTHER))


def _found(rows: DataFrame, axis: str) -> dict[str, int]:
    """Tokens of the values of ``axis`` that have at least one LISTED-th of all tokens."""
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    large = rows.where(F.col(axis).isNotNull()).groupBy(axis).agg(F.sum("tokens").alias("tokens")).where(F.col("tokens") * LISTED >= max(total, 1))
    return {r[axis]: r["tokens"] for r in large.orderBy(axis).collect()}


def _measured(topic_column: Column | None) -> Column:
    """What mixing needs of a document: its values on the axes, tokens, and the number it draws."""
    text = F.col("text").cast("string")
    kind = topic(text) if topic_column is None else topic_column
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), kind.alias("topic"), words(text).alias("tokens"), _draw().alias("draw"))


def calibrated(rows: DataFrame, sources: Mapping[str, float] | None = None, languages: Mapping[str, float] | None = None, topics: Mapping[str, float] | None = None, keep: float = KEEP) -> tuple[DataFrame, tuple[Mapping[str, float], ...]]:
    """(a row for each cell with its chance, the targets of each axis) of measured rows, a stored table."""
    if sources is None:
        sources = dict.fromkeys(_found(rows, "source"), 1.0)
    levelled = lambda axis: {k: float(n) ** LEVEL for k, n in _found(rows, axis).items()}
    listed = (sources, levelled("lang") if languages is None else languages, levelled("topic") if topics is None else topics)
    cells = _categorised(rows, listed).groupBy(*_AXES).agg(F.sum("tokens").alias("tokens")).collect()  # at most the product of the lists
    chance = chances({tuple(r[a] for a in _AXES): r["tokens"] for r in cells}, listed, keep)
    return rows.sparkSession.createDataFrame([(*cell, p) for cell, p in sorted(chance.items())], _CELL), listed


def _categorised(rows: DataFrame, listed: tuple[Mapping[str, float], ...]) -> DataFrame:
    return rows.withColumns({a: _category(F.col(a), names) for a, names in zip(_AXES, listed, strict=True)})


def wanted(natural: np.ndarray, names: Mapping[str, float]) -> np.ndarray:
    """Target shares of the listed categories and, last, of all others, which keep their natural share."""
    weights = np.array([*names.values(), 0.0])
    if not weights.sum():
        return natural
    want = weights / weights.sum() * (1 - natural[-1])
    want[-1] = natural[-1]
    return want


def chances(cells: Mapping[tuple[str, ...], int], listed: tuple[Mapping[str, float], ...], keep: float = KEEP) -> dict[tuple[str, ...], float]:
    """The sampling chance of each cell. Cells without tokens are kept whole: they weigh nothing."""
    if not sum(cells.values()):
        return dict.fromkeys(cells, 1.0)
    axes = [[*names, OTHER] for names in listed]
    place = [{x: i for i, x in enumerate(a)} for a in axes]
    mass = np.zeros([len(a) for a in axes])
    for cell, tokens in cells.items():
        mass[tuple(p[x] for p, x in zip(place, cell, strict=True))] = tokens
    margins = [mass.sum(axis=tuple(i for i in range(mass.ndim) if i != axis)) / mass.sum() for axis in range(mass.ndim)]
    fitted = rake(mass, [wanted(m, names) for m, names in zip(margins, listed, strict=True)], keep)
    chance = np.minimum(keep * np.divide(fitted, mass / mass.sum(), out=np.zeros_like(fitted), where=mass > 0), 1)
    return {cell: float(chance[tuple(p[x] for p, x in zip(place, cell, strict=True))]) if tokens else 1.0 for cell, tokens in cells.items()}


def _draw() -> Column:
    """A number in [0, 1) that a document's id and text decide."""
    return F.pmod(F.xxhash64(F.lit("draw"), F.col("doc_id").cast("long"), F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))), F.lit(1 << 53)) / float(1 << 53)


def sampled(docs: DataFrame, topic_column: Column | None = None, **targets) -> DataFrame:
    """A row for each document: doc_id, source, lang, topic (as categories), tokens, chance, kept.

    Null or unlisted categories are one category, ``(other)``, with its natural share. Null and blank texts
    have no tokens. Rows that repeat id and text share their draw. Targets of categories without tokens go to
    the others in proportion. Empty tables give empty results; more columns are ignored, whatever their names.
    """
    rows = saved(docs.select(_measured(topic_column).alias("m")).select("m.*"), "cells")
    cells, listed = calibrated(rows, **targets)
    return _categorised(rows, listed).join(F.broadcast(cells), list(_AXES)).select("doc_id", *_AXES, "tokens", "chance", (F.col("draw") < F.col("chance")).alias("kept"))


def achieved(sample: DataFrame) -> DataFrame:
    """What ``sampled`` gave: axis, category, tokens, kept_tokens, natural_share and kept_share of each category."""
    kept = sample.withColumn("kept_tokens", F.when(F.col("kept"), F.col("tokens")).otherwise(0))
    cells = kept.groupBy(*_AXES).agg(F.sum("tokens").alias("tokens"), F.sum("kept_tokens").alias("kept_tokens"))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("category")) for a in _AXES]))
    rows = cells.select(pairs.alias("p"), "tokens", "kept_tokens").groupBy("p.axis", "p.category").agg(F.sum("tokens").alias("tokens"), F.sum("kept_tokens").alias("kept_tokens"))
    whole = cells.agg(F.sum("tokens").alias("all_tokens"), F.sum("kept_tokens").alias("all_kept"))  # one row
    share = lambda part, total: F.col(part) / F.nullif(F.col(total), F.lit(0))
    return rows.join(F.broadcast(whole)).select("axis", "category", "tokens", "kept_tokens", share("tokens", "all_tokens").alias("natural_share"), share("kept_tokens", "all_kept").alias("kept_share"))


def mixed(docs: DataFrame, topic_column: Column | None = None, **targets) -> DataFrame:
    """The sampled rows of ``docs``, with the columns of ``docs``, whatever they are called.

    Documents are written once with what was measured of them, so that no text is measured twice.
    """
    name = next(f"mix_{i}" for i in range(len(docs.columns) + 1) if f"mix_{i}" not in {c.lower() for c in docs.columns})
    table = saved(docs.withColumn(name, _measured(topic_column)), "mixing")
    cells, listed = calibrated(table.select(f"{name}.*"), **targets)
    cells = F.broadcast(cells.toDF(*(f"{name}_{a}" for a in (*_AXES, "chance"))))
    meets = [_category(F.col(f"{name}.{a}"), names) == cells[f"{name}_{a}"] for a, names in zip(_AXES, listed, strict=True)]
    return table.join(cells, meets).where(F.col(f"{name}.draw") < cells[f"{name}_chance"]).select(*[table[c] for c in docs.columns])
