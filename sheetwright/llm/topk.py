"""Exact top-k search by pivot-table elimination.

Every vector has a row of distances to many pivots. By the triangle inequality the largest difference of two
rows is a lower bound of the vectors' distance, and with their lengths an upper bound of their inner product.
A query evaluates candidates in the order of that bound and stops once no bound reaches its k-th score, so the
result is exact whatever the pivots are.

Vectors lie in buckets of bounded bytes by their nearest pivot, queries likewise in blocks. A block first meets
one bucket of its own pivot, which gives its queries a k-th score to beat. Buckets keep the least and greatest
distance to each pivot, so a whole bucket has a bound too: only buckets that can still beat a query's score are
read for its block. The best of all buckets are merged by a window.

Vectors too long for exact float64 lie in buckets and blocks of their own, so they change nothing for the others.
Where one takes part, float64 products with intervals for their rounding shortlist the candidates, and integers of any
size decide among those.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetwright.llm.common import on_table, saved

#: Pivots at least and at most: one for every PER_PIVOT components, since a bound must cost less than the inner
#: product that it saves.
PIVOTS, MOST_PIVOTS, PER_PIVOT = 16, 128, 8
#: Vectors from which pivots are chosen, bytes of a bucket's vectors, queries of a block, buckets whose bounds travel
#: in one row.
SAMPLE, BUCKET_BYTES, BLOCK, CHUNK = 512, 8 << 20, 512, 256
#: Candidates evaluated first, and in a further step at most; queries that are evaluated together.
FIRST, STEP, GROUP = 256, 4096, 64
#: Squared lengths below which sums of products of whole numbers are exact in float64; the cell of longer vectors.
_EXACT, _LONG_CELL = 2.0**50, -1
_LONG = (1 << 63) - 1


def _matrix(vectors: list) -> np.ndarray:
    """The components as float64; shorter vectors end in zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(64 x), a whole number in float64, or infinite beyond its range."""
    with np.errstate(over="ignore"):
        return np.floor(x * 64.0)


def _integers(row: np.ndarray) -> list[int]:
    """floor(64 x) as Python integers, exact for any finite x: from 2**53 on, x is a whole number itself."""
    return [int(x) * 64 if abs(x) >= 2.0**53 else int(np.floor(x * 64.0)) for x in row.tolist()]


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before it."""
    if not len(vectors):
        return vectors
    far = np.linalg.norm(vectors - vectors.mean(0), axis=1)
    chosen: list[int] = []
    near = np.full(len(vectors), np.inf)
    for _ in range(min(count, len(vectors))):
        at = int(np.argmax(near if chosen else far))
        chosen.append(at)
        near = np.minimum(near, np.linalg.norm(vectors - vectors[at], axis=1))
    return vectors[chosen]


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _squares(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.einsum("ij,ij->i", x, x)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of whole numbers to pivots; exact squares where lengths are below the limit."""
    width = max(x.shape[1], pivots.shape[1])
    x, p = _fit(x, width), _fit(pivots, width)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum(_squares(x)[:, None] + _squares(p)[None, :] - 2 * (x @ p.T), 0))


def _place(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Append each vector's cell, its nearest pivot of those given or the cell of long vectors, and its width."""
    for batch in batches:
        whole = _whole(_matrix(batch.column(1).to_pylist()))
        cell = np.argmin(_distances(whole, pivots), axis=1) if len(pivots) and len(whole) else np.zeros(len(whole), int)
        cell = np.where(_squares(whole) < _EXACT, cell, _LONG_CELL)
        width = pc.list_value_length(batch.column(1)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), width], ["vec_id", "vector", "cell", "width"])


_PARTS = ("ids", "rows", "vectors", "far", "floors", "squares", "low", "high")
_PACK = "bucket long, " + ", ".join(f"{c} binary" for c in _PARTS) + ", most double"


def _pack(table: pa.Table, pivots: np.ndarray) -> pa.Table:
    """One row for a bucket or a block: ids, rows, vectors, distances to pivots, scores to beat, squared lengths, and its bounds."""
    table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    x = _matrix(table["vector"].to_pylist())
    whole = _whole(x)
    squares = _squares(whole)
    short = bool((squares < _EXACT).all())  # of long vectors distances say nothing
    far = _distances(whole, pivots) if len(pivots) and short else np.zeros((len(x), len(pivots)))
    low, high = (far.min(0), far.max(0)) if short else (np.zeros(far.shape[1]), np.full(far.shape[1], np.inf))
    found = {"ids": table["vec_id"].to_numpy(), "rows": table["row"].to_numpy(), "vectors": x, "far": far, "floors": table["floor"].to_numpy().astype(float), "squares": squares, "low": low, "high": high}
    row = {"bucket": table["bucket"][:1], **{c: [found[c].tobytes()] for c in _PARTS}, "most": [float(squares.max(initial=0))]}
    return pa.table(row, schema=pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in _PARTS), ("most", pa.float64())]))


def _chunk(table: pa.Table) -> pa.Table:
    """The bounds of up to CHUNK buckets in one row."""
    joined = lambda c: [b"".join(table[c].to_pylist())]
    return pa.table({"chunk": table["chunk"][:1], "buckets": [table["bucket"].to_numpy().tobytes()], "lows": joined("low"), "highs": joined("high"), "mosts": [table["most"].to_numpy().tobytes()]}, schema=pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("buckets", "lows", "highs", "mosts"))]))


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bucket) where a query of the block may still find a vector of the bucket; the bucket met first is left out."""
    for batch in batches:
        blocks, found = [], []
        for r in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
            buckets, mosts, floors = np.frombuffer(r["buckets"], np.int64), np.frombuffer(r["mosts"]), np.frombuffer(r["floors"])
            far = np.frombuffer(r["far"]).reshape(len(floors), -1)
            lows, highs = (np.frombuffer(r[c]).reshape(len(buckets), -1) for c in ("lows", "highs"))
            q2 = np.frombuffer(r["squares"])
            for j, bucket in enumerate(buckets.tolist()):
                with np.errstate(invalid="ignore", over="ignore"):
                    gap = np.maximum(np.maximum(far - highs[j], lows[j] - far), 0).max(1, initial=0)
                    gap = np.where(q2 < _EXACT, gap, 0)
                    # The lesser of two bounds of a product: by distances, and by lengths.
                    both = q2 + mosts[j]
                    bound = np.fmin((both - gap * gap) / 2 + 1e-12 * both, np.sqrt(q2) * np.sqrt(mosts[j]) * (1 + 1e-9)) + 1
                if bucket != r["first"] and not (bound < floors).all():
                    blocks.append(r["block"])
                    found.append(bucket)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(found, pa.int64())], ["block", "bucket"])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _by_intervals(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """The best where vectors are long: float64 products shortlist, Python's integers decide; scores are held to the range of long."""
    own, whole = _whole(q), _whole(x)
    with np.errstate(over="ignore", invalid="ignore"):
        score = whole @ own
        # Rounding of a sum of n products: gamma(n) times the lengths, whatever the order; lengths are rounded up.
        error = (len(own) + 2) * 2.0**-52 * np.sqrt(_squares(own[None])[0]) * np.sqrt(_squares(whole)) * 1.001 + 1
        low, high = score - error, score + error
    unsure = ~(np.isfinite(low) & np.isfinite(high))
    low = np.where(unsure, -_LONG, np.clip(low, -_LONG, _LONG))
    high = np.where(unsure, _LONG, np.clip(high, -_LONG, _LONG))
    listed = np.flatnonzero(high >= np.partition(low, len(low) - k)[len(low) - k]) if len(low) > k else np.arange(len(low))
    mine = _integers(q)
    exact = [max(-_LONG, min(_LONG, sum(a * b for a, b in zip(mine, _integers(x[i]), strict=True)))) for i in listed.tolist()]
    order = sorted(zip(exact, ids[listed].tolist(), strict=True), key=lambda s: (-s[0], s[1]))[:k]
    return [i for _, i in order], [s for s, _ in order]


def _bounds(q_far: np.ndarray, far: np.ndarray, q2: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """An upper bound of each query's product with each candidate, in float32: slack keeps it above what it bounds."""
    low = np.zeros((len(q2), len(x2)), np.float32)
    gap = np.empty_like(low)
    for p in range(far.shape[1]):
        np.subtract(q_far[:, p, None].astype(np.float32), far[None, :, p].astype(np.float32), out=gap)
        np.abs(gap, out=gap)
        np.maximum(low, gap, out=low)
    low -= np.float32(3e-7 * (q_far.max(initial=0) + far.max(initial=0)))  # distances were rounded
    np.maximum(low, 0, out=low)
    both = (q2[:, None] + x2[None, :]).astype(np.float32)
    low *= low
    return (both - low) * np.float32(0.5) + both * np.float32(2e-6) + np.float32(1)


def _by_bounds(q: np.ndarray, x: np.ndarray, ids: np.ndarray, bounds: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the best that reach its floor, for each of some queries.

    Candidates are evaluated in the order of what they can gain over the queries' k-th scores, a step of them with one
    product for all queries; those that can't reach any k-th score any more are left out, and the rest ends the search.
    Sums of products below 2**24 are exact in float32, others in float64.
    """
    small = bool(np.sqrt(_squares(q).max(initial=0)) * np.sqrt(_squares(x).max(initial=0)) < 2**24 - 1)
    kind = np.float32 if small else np.float64
    own, held = q.T.astype(kind), x.astype(kind)
    best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in q]
    least = floors.copy()
    reach = (bounds - np.where(np.isfinite(least), least, 0)[:, None]).max(axis=0)
    order = np.flatnonzero((bounds >= least[:, None]).any(axis=0))
    order = order[np.argsort(-reach[order], kind="stable")]
    step = FIRST
    while len(order):
        now, order = order[:step], order[step:]
        score = held[now] @ own
        for i, (found, scores) in enumerate(best):
            good = np.flatnonzero((score[:, i] >= least[i]) & (bounds[i, now] > -np.inf))
            if len(good):
                both_ids, both = np.append(found, ids[now[good]]), np.append(scores, score[good, i].astype(np.float64))
                top = _best(both, both_ids, k)
                best[i] = both_ids[top], both[top]
                if len(top) == k:
                    least[i] = max(least[i], both[top[-1]])
        order = order[(bounds[:, order] >= least[:, None]).any(axis=0)]
        step = min(step * 4, STEP)
    return best


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query, query_id, vec_id, score): the best of a bucket for each query row of a block."""
    for r in (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
        q_ids, q_rows, ids, rows = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "q_rows", "ids", "rows"))
        floors, q2, x2 = (np.frombuffer(r[c]) for c in ("floors", "q_squares", "squares"))
        q_raw, x_raw = np.frombuffer(r["q_vectors"]).reshape(len(q_ids), -1), np.frombuffer(r["vectors"]).reshape(len(ids), -1)
        q_far, far = np.frombuffer(r["q_far"]).reshape(len(q_ids), -1), np.frombuffer(r["far"]).reshape(len(ids), -1)
        width = max(q_raw.shape[1], x_raw.shape[1])
        q_raw, x_raw = _fit(q_raw, width), _fit(x_raw, width)
        q, x = _whole(q_raw), _whole(x_raw)
        short = max(q2.max(initial=0), x2.max(initial=0)) < _EXACT
        out: tuple[list, list, list, list] = ([], [], [], [])
        for at in range(0, len(q), GROUP):
            part = slice(at, at + GROUP)
            if short:
                bounds = _bounds(q_far[part], far, q2[part], x2)
                bounds[rows[None, :] == q_rows[part, None]] = -np.inf  # a row is no candidate of its own
                best = [(i.tolist(), s.astype(np.int64).tolist()) for i, s in _by_bounds(q[part], x, ids, bounds, floors[part], k)]
            else:
                others = [np.flatnonzero(rows != row) for row in q_rows[part]]
                best = [_by_intervals(raw, x_raw[mine], ids[mine], k) for raw, mine in zip(q_raw[part], others, strict=True)]
            for row, q_id, (found, score) in zip(q_rows[part].tolist(), q_ids[part].tolist(), best, strict=True):
                out[0].extend([row] * len(found))
                out[1].extend([q_id] * len(found))
                out[2].extend(found)
                out[3].extend(score)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of each query: query_id, rank (from 1), vec_id, score.

    Components count as floor(64 x). Queries are the rows whose id is divisible by ``every``, candidates all
    other rows; ties go to the smaller vec_id. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id. A shorter vector counts as ending in zeros, an empty
    one as zero. Rows that repeat an id are candidates each, for each other too, and queries each: their ranks stand
    under one query_id. Scores beyond long are held to its range. Other columns are ignored; an empty table gives an
    empty result.

    ``pivots``: their number, by default between PIVOTS and MOST_PIVOTS by the vectors' width. They come from
    ``SAMPLE`` vectors at most (those of smallest hash); all rows are indexed.
    """
    usable = "vec_id is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).where(usable)
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    short = "aggregate(vector, 0D, (a, x) -> a + 4096D * x * x) < 5e14"  # below _EXACT for sure
    sample = rows.where(short).orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).collect()
    found = choose_pivots(_whole(_matrix([r["vector"] for r in sample])), pivots or min(MOST_PIVOTS, max(PIVOTS, width // PER_PIVOT))) if sample else np.zeros((0, 0))
    # As many pivots part the vectors as there will be full buckets.
    near = found[: max(1, count * width * 8 // BUCKET_BYTES)]
    placed = rows.mapInArrow(partial(_place, pivots=near), "vec_id long, vector array<double>, cell int, width long")
    placed = saved(placed.withColumn("row", F.monotonically_increasing_id()), "placed")  # rows keep their number from here on
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("width").alias("width")).orderBy("cell").collect()  # one row for each pivot

    def dealt(df: DataFrame, sizes: dict[int, int]) -> DataFrame:
        """``df`` with a bucket: each cell has its own ones, as many as its size asks for."""
        begin, at = {}, 0
        for cell, n in sorted(sizes.items()):
            begin[cell], at = at, at + n
        lookup = lambda d: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in d.items() for v in pair]), F.col("cell")), F.lit(0)) if d else F.lit(0)
        return df.withColumn("bucket", (lookup(begin) + F.pmod(F.xxhash64("row"), F.greatest(lookup(sizes), F.lit(1)))).cast("long"))

    many = {r["cell"]: -(-r["n"] * max(1, r["width"]) * 8 // BUCKET_BYTES) for r in cells}
    run = on_table(_pack, pivots=found)
    buckets = saved(dealt(placed, many).withColumn("floor", F.lit(0.0)).groupBy("bucket").applyInArrow(run, _PACK), "buckets")
    asked = placed.where(F.col("vec_id") % every == 0)
    own = {r["cell"]: -(-r["count"] // BLOCK) for r in asked.groupBy("cell").count().collect()}
    blocked = dealt(asked, own)
    firsts = {cell: sum(n for c, n in many.items() if c < cell) for cell in many}  # each cell's first bucket
    cell_of = [(sum(n for c, n in own.items() if c < cell) + i, firsts[cell]) for cell in own for i in range(own[cell])]
    spark = vectors.sparkSession
    first = spark.createDataFrame(cell_of, "block long, first long")

    def blocks_with(floors: DataFrame | None) -> DataFrame:
        rows = blocked.withColumn("floor", F.lit(float("-inf"))) if floors is None else blocked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        packed = rows.groupBy("bucket").applyInArrow(run, _PACK)
        return packed.select(F.col("bucket").alias("block"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "vectors", "far", "squares")], "floors").join(F.broadcast(first), "block")

    def met(pairs: DataFrame) -> DataFrame:
        rows = pairs.hint("shuffle_hash").join(buckets.select("bucket", "ids", "rows", "vectors", "far", "squares"), "bucket")
        return rows.select("q_ids", "q_rows", "q_vectors", "q_far", "q_squares", "floors", "ids", "rows", "vectors", "far", "squares").mapInArrow(partial(_search, k=k), "query long, query_id long, vec_id long, score long")

    home = saved(met(blocks_with(None).withColumn("bucket", F.col("first"))), "home")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    ranked = lambda best: best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if sum(many.values()) <= 1:  # every block has met the only bucket
        return ranked(home)
    kth = home.groupBy(F.col("query").alias("row")).agg(F.min("score").alias("least"), F.count("*").alias("n"))
    # Rounded down, since a floor must never be above the score that it stands for.
    floors = kth.select("row", F.when((F.col("n") >= k) & (F.col("least") > -_LONG), F.col("least").cast("double") - F.abs(F.col("least").cast("double")) * 1e-15).alias("floor"))
    blocks = saved(blocks_with(floors), "blocks")
    chunks = buckets.select("bucket", "low", "high", "most", F.expr(f"bucket div {CHUNK}").alias("chunk")).groupBy("chunk").applyInArrow(on_table(_chunk), "chunk long, buckets binary, lows binary, highs binary, mosts binary")
    bounds = blocks.select("block", "first", "floors", F.col("q_far").alias("far"), F.col("q_squares").alias("squares"))
    bounds = bounds.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sum(many.values()) // CHUNK).cast("long")))).join(chunks, "chunk")
    pairs = saved(bounds.mapInArrow(_reach, "block long, bucket long"), "pairs")
    rest = met(pairs.repartition("block", "bucket").join(blocks.drop("first"), "block"))
    return ranked(saved(home.unionByName(rest), "best"))
