"""Toxicity by a linear-chain conditional random field.

Tokens are tagged toxic or not. Document labels give token labels first: in a toxic training document, tokens
whose word or beginning is far more frequent in toxic than in clean training documents count as toxic. The
chain is trained on those by gradient ascent; forward-backward marginals of a document's tokens add up to its
expected number of toxic tokens, from which a fitted logistic curve makes the score. Tokens with a marginal of
at least one half are the offending offsets.

With two states, forward and backward messages are one odds value each, and a token turns one value into the next
by a fraction of linear terms. Such steps compose, so texts laid end to end are cut into pieces that run side by
side: the composed steps of each piece give the values at its edge, then all pieces are filled in. A text of any
length takes about twice the square root of the number of tokens in numpy steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.llm.common import on_table, saved
from sheetwright.llm.wordsets import _LOWER, _power, mix, pieces_of

#: Labelled documents and bytes of their texts to learn from at most (ids of the smallest hash first), and feature weights.
SAMPLE, SAMPLE_BYTES, WEIGHTS = 6000, 64 << 20, 1 << 18
EPOCHS, BATCHES, RATE = 5, 40, 0.5
#: A word or beginning counts as toxic from this share of toxic documents and this ratio of the shares on.
SUPPORT, RATIO = 0.01, 20.0
PREDICTED = 0.7
_LETTER = np.zeros(256, bool)
_LETTER[128:] = _LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Tokens:
    """Tokens (runs of letters) of many texts: features (3 x tokens), byte spans, tokens of each text."""

    features: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


@dataclass
class Model:
    """Feature weights, log transition scores (0->0 is 0), log start score, and the document curve."""

    weights: np.ndarray
    moves: np.ndarray
    start: float
    curve: np.ndarray


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """The features of a token are its word and its first 4 and 5 bytes, A-Z as a-z, hashed to weights."""
    letter = _LETTER[data]
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    starts[edge] = letter[edge]
    first = np.flatnonzero(starts)
    if not len(first):
        none = np.zeros(0, np.int64)
        return Tokens(np.zeros((3, 0), np.int32), none, none, np.zeros(len(offsets) - 1, np.int64))
    at = np.arange(len(data), dtype=np.int64)
    place = at - np.maximum.accumulate(np.where(starts, at, 0))
    place[~letter] = 0
    value = np.where(letter, _LOWER[data] * _power(int(place.max()) + 1)[place], np.uint64(0))
    # A token ends where a text ends, even if the next one begins with a letter.
    stops = letter.copy()
    stops[:-1] &= ~letter[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    stops[edge] = letter[edge]
    ends = np.flatnonzero(stops) + 1
    hashes = [np.add.reduceat(value, first)]
    start = np.zeros(len(first), np.uint64)
    for i in range(5):  # beginnings of four and five bytes
        start += np.where(first + i < ends, value[np.minimum(first + i, len(data) - 1)], np.uint64(0))
        if i >= 3:
            hashes.append(start.copy())
    features = np.stack([(mix(h + np.uint64(i)) % np.uint64(WEIGHTS)).astype(np.int32) for i, h in enumerate(hashes)])
    return Tokens(features, first, ends, np.diff(np.searchsorted(first, offsets)))


def _chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (a[t] + b[t] x[t - 1]) / (c[t] + d[t] x[t - 1]) for all t; the first step must not depend on x (b = d = 0)."""
    size = len(a)
    length = max(1, int(size**0.5))
    lanes = -(-size // length)
    fill = lambda v, x: np.ascontiguousarray(np.append(v, np.full(lanes * length - size, x)).reshape(lanes, length).T)
    a, b, c, d = fill(a, 0.0), fill(b, 1.0), fill(c, 1.0), fill(d, 0.0)
    p, q, r, s = np.zeros(lanes), np.ones(lanes), np.ones(lanes), np.zeros(lanes)  # each lane's steps so far, composed
    for t in range(length):
        p, q, r, s = a[t] * r + b[t] * p, a[t] * s + b[t] * q, c[t] * r + d[t] * p, c[t] * s + d[t] * q
        if t % 4 == 3:
            scale = 1 / (p + q + r + s)
            p, q, r, s = p * scale, q * scale, r * scale, s * scale
    edge, x = np.empty(lanes), 1.0
    for i, (pi, qi, ri, si) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        edge[i] = x
        x = (pi + qi * x) / (ri + si * x)
    out = np.empty_like(a)
    for t in range(length):
        edge = (a[t] + b[t] * edge) / (c[t] + d[t] * edge)
        out[t] = edge
    return out.T.ravel()[:size]


def marginals(emit: np.ndarray, counts: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """(chance that each token is toxic, expected moves 00, 01, 10, 11) by forward-backward over all texts."""
    total = np.zeros(4)
    if not len(emit):
        return emit, total
    odds = np.exp(np.clip(emit, -30, 30))
    t00, t01, t10, t11 = np.exp(moves)
    ends = np.cumsum(counts)[counts > 0]
    begin, close = np.zeros(len(emit), bool), np.zeros(len(emit), bool)
    begin[np.append(0, ends[:-1])] = True
    close[ends - 1] = True
    ahead = _chain(odds * np.where(begin, np.exp(start), t01), odds * np.where(begin, 0, t11), np.where(begin, 1, t00), np.where(begin, 0, t10))
    after = np.append(odds[1:], 1.0)
    back = _chain(*(x[::-1] for x in (np.where(close, 1, t10), np.where(close, 0, t11 * after), np.where(close, 1, t00), np.where(close, 0, t01 * after))))[::-1]
    m = ahead * back
    now = np.flatnonzero(~begin)
    if len(now):
        r, x = ahead[now - 1], odds[now] * back[now]
        w = np.stack([np.full(len(now), t00), t01 * x, r * t10, r * t11 * x])
        total = (w / w.sum(0)).sum(1)
    return m / (1 + m), total


def _labelled(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Toxic tokens of the training documents, from what sets toxic documents apart."""
    doc = np.repeat(np.arange(len(toxic)), tokens.counts)
    # Near copies of a document would make its rare words look frequent: of those only one is counted.
    two = mix(tokens.features[0, :-1].astype(np.uint64) * np.uint64(WEIGHTS) + tokens.features[0, 1:].astype(np.uint64))
    least = np.full(len(toxic), np.uint64(0))
    full = tokens.counts > 1
    if full.any():
        least[full] = np.minimum.reduceat(np.append(two, two[-1:]), (np.cumsum(tokens.counts) - tokens.counts)[full])
    own = np.zeros(len(toxic), bool)
    own[np.unique(least, return_index=True)[1]] = True
    n1, n0 = int((toxic & own).sum()), int((~toxic & own).sum())
    out = np.zeros(len(doc), bool)
    for row in tokens.features:
        pair = np.unique((doc * WEIGHTS + row)[own[doc]])
        held, of = pair % WEIGHTS, toxic[pair // WEIGHTS]
        c1, c0 = np.bincount(held[of], minlength=WEIGHTS), np.bincount(held[~of], minlength=WEIGHTS)
        ratio = ((c1 + 0.5) / (n1 + 1)) / ((c0 + 0.5) / (n0 + 1))
        out |= ((c1 >= max(4, SUPPORT * n1)) & (ratio >= RATIO))[row]
    return out & toxic[doc]


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; ``x`` has a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 0.01 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def _summary(p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected toxic tokens of each text, the curve's inputs)."""
    total = np.zeros(len(counts))
    np.add.at(total, np.repeat(np.arange(len(counts)), counts), p)
    return total, np.stack([np.ones(len(counts)), np.minimum(total, 4), np.log1p(total)], 1)


def train(texts: pa.Array, toxic: np.ndarray) -> Model:
    """Fit the chain and the document curve to labelled texts. Without texts of both kinds every score is 0."""
    y = np.asarray(toxic, bool)
    if not y.any() or y.all():
        return Model(np.zeros(WEIGHTS, np.float32), np.zeros(4), -5.0, np.array([-30.0, 0, 0]))
    runs = [(r.counts, r.features) for _, _, data, offsets in pieces_of(texts) if (r := tokens_of(data, offsets))]
    counts = np.concatenate([r[0] for r in runs])
    features = np.concatenate([r[1] for r in runs], 1)
    del runs
    label = _labelled(Tokens(features, counts, counts, counts), y)
    ends = np.cumsum(counts)
    weights, moves, start = np.zeros(WEIGHTS), np.zeros(4), -5.0
    weights -= 1.0  # a token is seldom toxic: three features make an odds of e to the -3
    g_weights, g_moves = np.full(WEIGHTS, 1e-8), np.full(4, 1e-8)
    order, rng = np.arange(len(y)), np.random.default_rng(7)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        cut = np.cumsum(counts[order]) * BATCHES // (counts.sum() + 1)
        for group in np.split(order, np.flatnonzero(np.diff(cut)) + 1):
            n = counts[group]
            if not n.sum():
                continue
            place = np.concatenate([np.arange(e - c, e) for e, c in zip(ends[group], n, strict=True)])
            f, t = features[:, place], label[place]
            p, seen = marginals(weights[f].sum(0), n, moves, start)
            gap = t - p
            g = sum(np.bincount(row, gap, WEIGHTS) for row in f)
            g_weights += g * g
            weights += RATE * g / np.sqrt(g_weights)
            inner = np.ones(len(t), bool)
            inner[(np.cumsum(n) - n)[n > 0]] = False
            now = np.flatnonzero(inner)
            true = np.bincount(2 * t[now - 1].astype(int) + t[now], minlength=4)
            g = true - seen - 0.1 * moves
            g_moves += g * g
            moves = moves + RATE * g / np.sqrt(g_moves)
            moves = moves - moves[0]
    parts = []
    for group in np.split(np.arange(len(y)), np.flatnonzero(np.diff(np.cumsum(counts) * BATCHES // (counts.sum() + 1))) + 1):
        part = features[:, ends[group[0]] - counts[group[0]] : ends[group[-1]]]
        parts.append(marginals(weights[part].sum(0), counts[group], moves, start)[0])
    p = np.concatenate(parts)
    return Model(weights.astype(np.float32), moves, start, _curve(_summary(p, counts)[1], y.astype(float)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents whose crc32(doc_id as text) mod 3 isn't 1.

    Those with the smallest hash of doc_id are taken, whole, up to ``SAMPLE_BYTES`` bytes of text together. A doc_id with several labels counts as toxic if
    one says so; null labels and ids are left out, and of rows that repeat a doc_id the smallest text counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where("crc32(cast(doc_id as string)) % 3 <> 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = saved(texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # of ``sample`` rows
    within = rows.select("doc_id", F.coalesce(so_far, F.lit(0)).alias("before")).where(F.col("before") < SAMPLE_BYTES).select("doc_id")
    rows = rows.join(F.broadcast(within), "doc_id")
    # The sample is bounded, so one task learns from it; the driver gets the weights only.
    learned = rows.groupBy(F.lit(0).alias("all")).applyInArrow(on_table(_learn), "weights binary, moves binary, start double, curve binary").first()
    if learned is None:
        return train(pa.array([], pa.string()), np.zeros(0, bool))
    return Model(np.frombuffer(learned["weights"], np.float32), np.frombuffer(learned["moves"]), learned["start"], np.frombuffer(learned["curve"]))


def _learn(table: pa.Table) -> pa.Table:
    table = table.sort_by("doc_id")
    model = train(table["text"], table["toxic"].to_numpy() > 0)
    return pa.table({"weights": [model.weights.tobytes()], "moves": [model.moves.astype(float).tobytes()], "start": [float(model.start)], "curve": [model.curve.astype(float).tobytes()]}, schema=pa.schema([("weights", pa.binary()), ("moves", pa.binary()), ("start", pa.float64()), ("curve", pa.binary())]))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in pieces_of(batch.column(2)):
            tokens = tokens_of(data, offsets)
            p, _ = marginals(model.weights[tokens.features].sum(0, dtype=np.float64), tokens.counts, model.moves, model.start)
            total, x = _summary(p, tokens.counts)
            score = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
            spans = [""] * (end - at)
            flagged = np.bincount(np.repeat(np.arange(end - at), tokens.counts)[p >= 0.5], minlength=end - at) if len(p) else np.zeros(end - at, np.int64)
            last = np.cumsum(tokens.counts)
            for i in np.flatnonzero(flagged).tolist():
                raw = data[offsets[i] : offsets[i + 1]]
                points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                out: list[list[int]] = []
                for j in range(last[i] - tokens.counts[i], last[i]):
                    if p[j] >= 0.5:
                        if out and j and out[-1][2] == j - 1:
                            out[-1][1], out[-1][2] = tokens.ends[j] - offsets[i], j
                        else:
                            out.append([tokens.begins[j] - offsets[i], tokens.ends[j] - offsets[i], j])
                spans[i] = ",".join(f"{points[a]}:{points[min(b, len(raw))]}" for a, b, _ in out)
            ids, held = batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at)
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(score), pa.array((score >= PREDICTED).astype(np.int32)), pa.array(total), pa.array(spans, pa.string())], ["doc_id", "held_out", "score", "predicted", "toxic_tokens", "spans"])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text: a row for each row of ``docs``.

    Columns: doc_id, held_out (its crc32 mod 3 is 1; false for a null id), score (0 to 1), predicted (1 from
    0.7 on), toxic_tokens (expected number), spans (offending ``start:end`` in code points, comma-joined, runs
    of tokens joined). Only the text makes the score. Null and empty texts have no tokens and get the score
    of such texts. Repeated rows are scored alike; other columns are ignored; an empty table gives an empty
    result.
    """
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).select("doc_id", held.alias("held_out"), "text")
    return kept.mapInArrow(partial(_score, model=model), "doc_id long, held_out boolean, score double, predicted int, toxic_tokens double, spans string")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the chain doesn't reject, with the columns of ``docs``; labels teach it.

    Scores depend on the text alone, so every row is judged where it lies and no id is needed.
    """
    model = fit(docs, labels)
    return docs.mapInArrow(partial(_keep, model=model, column=docs.columns.index("text")), docs.schema)


def _keep(batches: Iterator[pa.RecordBatch], model: Model, column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = pa.nulls(batch.num_rows, pa.int64())
        judged = _score(iter([pa.RecordBatch.from_arrays([ids, ids, batch.column(column)], ["doc_id", "held_out", "text"])]), model)
        keep = np.concatenate([b.column(3).to_numpy() == 0 for b in judged] or [np.zeros(0, bool)])
        yield batch.filter(pa.array(keep))
