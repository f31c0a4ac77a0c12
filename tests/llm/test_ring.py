"""The sharding ring against a ring in plain Python."""

import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sheetwright.llm.sharding import CELLS, NODES, shard


def _hashed(*values):
    """Spark's xxhash64 of strings and longs in turn; nulls are skipped."""
    out = 42
    for v in values:
        if v is not None:
            out = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed=out)
    return out - (1 << 64) if out >> 63 else out


def _plain_ring(rows, shards):
    """(doc_id, crc, shard, slot) of each row (doc_id, text): own shards first, arc by arc, then overflow clockwise."""
    nodes = {}
    for i in range(shards * NODES):
        cell = _hashed("node", i) % CELLS
        nodes[cell] = min(nodes.get(cell, shards), i // NODES)
    cells = sorted(nodes)
    held = {}
    for doc_id, text in rows:
        blob = (text or "").encode()
        h = _hashed(doc_id, zlib.crc32(blob))
        arc = int(np.searchsorted(cells, h % CELLS)) % len(cells)
        held.setdefault(arc, []).append((h % CELLS, h, doc_id is not None, doc_id or 0, zlib.crc32(blob), len(blob) + 1, doc_id))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    filled, out, left = [0] * shards, [], []

    def give(waiting, s):
        n = min(len(waiting), room[s] - filled[s])
        for k, row in enumerate(waiting[:n]):
            out.append((row[-1], row[4], s, filled[s] + k))
        filled[s] += n
        return waiting[n:]

    for arc in sorted(held):
        left.append((arc, give(sorted(held[arc], key=lambda r: r[:6]), nodes[cells[arc]])))
    for arc, waiting in left:
        turn = [nodes[c] for c in cells[arc:] + cells[:arc]]
        for s in dict.fromkeys([*turn, *range(shards)]):
            waiting = give(waiting, s)
    return out


def test_ring_against_plain_ring(spark):
    docs = spark.range(3001).select(F.when(F.col("id") % 100 != 99, F.col("id")).alias("doc_id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("ş text "), F.col("id") % 900)).alias("text"))
    docs = docs.union(docs.where("doc_id = 5"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for shards in (1, 8, 9):
        got = sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in shard(docs, shards).collect())
        assert got == sorted((str(d), c, s, k) for d, c, s, k in _plain_ring(rows, shards))


def test_movement_is_limited(spark):
    """From 8 to 9 shards a ninth of the rows has to move; the bounded ring moves less than twice that."""
    docs = spark.range(20000).selectExpr("id as doc_id", "concat('t', id) as text")
    eight, nine = (shard(docs, n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (8, 9))
    moved = eight.join(nine, "doc_id").agg(F.avg((F.col("s8") != F.col("s9")).cast("int"))).first()[0]
    assert moved < 2 / 9
