"""N-gram Jaccard join by a token-group matrix, exact for every pair of texts.

1. Each document becomes its set of ``k``-word shingles; documents with equal sets form one class.
2. Partition: two sets with similarity of at least ``num/den`` differ in at most
   ``d = (n1 + n2)(den - num)/(den + num)`` shingles, so of more than ``d`` hash pieces one is equal, whatever
   the sizes. Pairs that share a piece are candidates. A bitmap of each set's parities is a lower bound of how
   much two sets differ, so candidates beyond ``d`` go; what is left chains sets into clusters, and no link
   leaves a cluster.
3. Token-group matrix: inside a cluster (cut into blocks of bounded size, every two blocks meeting in
   one task) similar sets form small groups, each with its token union. A query's overlap with the union
   bounds its overlap with every member, and only groups whose bound reaches the needed overlap open.
4. Opened pairs are counted exactly; links become components by Spark joins.

Nothing is capped and nothing is left to chance: a large cluster only makes more block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwright.llm.common import beside, components, on_table, saved
from sheetwright.llm.wordsets import U, mix, prints, sets_of

#: Pieces beyond the pigeonhole's count, so that so many empty pieces need not be written; see ``piece_counts``.
SPARE = 2
#: Signatures in one part of the piece join, and shingles in one block of a cluster.
PART_SIGNATURES, BLOCK_TOKENS = 1_500_000, 1_000_000
#: Representatives (eight numbers each: 26 MB at most) up to which a lookup of their texts is broadcast; beyond,
#: it is a shuffled join with the same result.
BROADCAST_ROWS = 400_000
#: Members of one group of the token-group matrix.
GROUP = 32
#: Sets that share a piece up to which their pairs are listed; more of them meet as one group of bitmaps.
LISTED = 16
#: Sets in one block of those that share a piece; each two blocks meet in one task.
CROWD = 2048
#: 64-bit words of a set's bitmap.
WORDS = 8
#: Differences from which on sets need a second bitmap, of four bits for each shingle: unrelated sets differ in half of
#: the first one's 512 places at most, so there large sets look all alike.
WIDE = 160
_BITS = [f"b{i}" for i in range(WORDS)]
_MAPS = ", ".join([*(f"{b} long" for b in _BITS), "wide binary"])


def size_classes(most: int, num: int, den: int) -> np.ndarray:
    """Lower ends of size classes such that linked sets lie in one class or in neighbours."""
    ends, low = [], 1
    while low <= most * den // num + 1:
        ends.append(low)
        low = low * den // num + 1
    return np.array([*ends, low, low * den // num + 1], np.int64)


def piece_counts(differ: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, spare pieces) for sets of at least ``least`` shingles that differ in at most ``differ``.

    With ``differ + 1 + spare`` pieces more than ``spare`` are equal in two linked sets, so a set with up to
    ``spare`` empty pieces needs to write none of them: one equal piece that isn't empty is left. ``spare`` is
    what a set has of empty pieces with few exceptions, and those write their empty pieces too.
    """
    spare = np.full_like(differ, SPARE)
    for _ in range(4):
        empty = (differ + 1 + spare) * np.exp(-least / (differ + 1 + spare))
        spare = SPARE + np.ceil(empty + 5 * np.sqrt(empty)).astype(np.int64)
    return differ + 1 + spare, spare


def signatures(flat: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the hash pieces of each set, under its own size class and the next."""
    lows = size_classes(int(sizes.max(initial=1)), num, den)
    own = np.searchsorted(lows, sizes, "right") - 1
    spread = mix(flat ^ U(0x5851F42D4C957F2D))
    rows, marks = [], []
    for step in (0, 1):
        scheme = np.minimum(own + step, len(lows) - 2)
        differ = 2 * (lows[scheme + 1] - 1) * (den - num) // (den + num)
        # The scheme's sets lie in its size class or in the one below.
        pieces, spare = piece_counts(differ, lows[np.maximum(scheme - 1, 0)])
        parts = np.where((sizes > 0) & (differ > 0), pieces, 0)
        use = np.repeat(parts > 0, sizes)
        row = np.repeat(np.arange(len(sizes)), np.where(parts > 0, sizes, 0))
        base = np.cumsum(parts) - parts
        place = base[row] + (flat[use] % parts[row].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(total, place, spread[use])
        filled = np.bincount(place, minlength=len(total)) > 0
        owner = np.repeat(np.arange(len(sizes)), parts)
        blank = np.bincount(owner[~filled], minlength=len(sizes))
        filled |= (blank > spare)[owner]
        index = np.arange(len(total)) - base[owner]
        mark = mix(total + mix((scheme[owner] * 1_000_003 + 7).astype(np.uint64)) + mix(index.astype(np.uint64) + U(1)) * U(3))
        rows.append(owner[filled])
        marks.append(mark[filled])
    return np.concatenate(rows), np.concatenate(marks)


def bitmaps(flat: np.ndarray, sizes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """For each set, for each of ``words * 64`` classes of hashes, whether it holds an odd number of them."""
    out = np.zeros(len(sizes) * words, np.uint64)
    bit = flat >> U(64 - 6 - (words - 1).bit_length())
    np.bitwise_xor.at(out, np.repeat(np.arange(len(sizes)) * words, sizes) + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return out.reshape(-1, words)


def wide_from(num: int, den: int) -> int:
    """Sets of more shingles than this have a second bitmap."""
    return WIDE * (den + num) // (2 * (den - num)) if den > num else 1 << 62


def wide_bitmaps(flat: np.ndarray, sizes: np.ndarray, least: int) -> list[bytes | None]:
    """The second bitmap of each set of more than ``least`` shingles; null for others."""
    out: list[bytes | None] = [None] * len(sizes)
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes > least).tolist():
        words = 1 << (int(sizes[i]) * 4 // 64).bit_length()
        out[i] = bitmaps(flat[ends[i] - sizes[i] : ends[i]], sizes[i : i + 1], words).tobytes()
    return out


def wide_apart(x: bytes, y: bytes) -> int:
    """Places in which two second bitmaps differ; the longer one is folded to the other's length."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    # Classes are the first bits of a hash, so neighbours fall together.
    b = np.bitwise_xor.reduce(_spread(b).reshape(len(a) * 64, -1), axis=1)
    return int(np.count_nonzero(_spread(a) != b))


def _spread(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(x.view(np.uint8), bitorder="little")


def _near(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of large sets whose second bitmaps allow a link."""
    for batch in batches:
        most = (batch.column(2).to_numpy() * (den - num)) // (den + num)
        keep = [wide_apart(x.as_buffer(), y.as_buffer()) <= m for x, y, m in zip(batch.column(3), batch.column(4), most.tolist(), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _describe(batches: Iterator[pa.RecordBatch], k: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, flat, sizes in sets_of(batch.column(1), k):
            hi, lo = prints(flat, sizes)
            maps = [*(pa.array(np.ascontiguousarray(b).view(np.int64)) for b in bitmaps(flat, sizes).T), pa.array(wide_bitmaps(flat, sizes, least), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(sizes), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), *maps], ["doc_id", "n", "hi", "lo", *_BITS, "wide"])


def _packed(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width]


def _unpacked(x: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(x), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view(np.uint64).ravel()


def _grouped(key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (mark, key) in order, and where each mark begins and how many keys it has."""
    order = np.lexsort((key, mark))
    mark, key = mark[order], key[order]
    new = np.append(True, (mark[1:] != mark[:-1]) | (key[1:] != key[:-1])) if len(mark) else np.zeros(0, bool)
    mark, key = mark[new], key[new]
    begins = np.flatnonzero(np.append(True, mark[1:] != mark[:-1])) if len(mark) else np.zeros(0, int)
    return key, mark, begins, np.diff(np.append(begins, len(mark)))


#: What a row of packed signatures is: signatures, pieces known to be hot, or the sets that share such pieces.
_PLAIN, _HOT, _MEMBERS = 0, 1, 2
_PIECE_ROW = "at int, part int, kind int, marks binary, keys binary"


def _pieces(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Signatures with the 48-bit key of their set, packed by part. A set seen before in this task is not repeated.

    Of a piece that more than LISTED sets of one run (a million signatures) share, only the name goes to its part
    and the sets are spread over other tasks. So a part gets at most LISTED sets of a piece from each run, however
    many share it.
    """
    seen: set[int] = set()
    keys, marks, held, runs = [], [], 0, 0

    def packed(key: np.ndarray, mark: np.ndarray, kind: int) -> pa.RecordBatch:
        part = (mark >> U(40)) % U(parts)
        order = np.argsort(part, kind="stable")
        part, key, mark = part[order].astype(np.int64), _packed(key[order], 6), _packed(mark[order], 5)
        ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
        begins = np.append(0, ends[:-1])
        at = part[begins] if kind != _MEMBERS else parts + (part[begins] + TaskContext.get().partitionId() * 7919 + runs) % parts
        bytes_of = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(part[begins].astype(np.int32)), pa.array(np.full(len(begins), kind, np.int32)), bytes_of(mark), bytes_of(key)], ["at", "part", "kind", "marks", "keys"])

    def flush() -> Iterator[pa.RecordBatch]:
        key, mark, begins, counts = _grouped(np.concatenate(keys), np.concatenate(marks))
        many = np.repeat(counts > LISTED, counts)
        if not many.all():
            yield packed(key[~many], mark[~many], _PLAIN)
        if many.any():
            first = begins[counts > LISTED]
            yield packed(key[first], mark[first], _HOT)
            yield packed(key[many], mark[many], _MEMBERS)

    for batch in batches:
        for _, _, flat, sizes in sets_of(batch.column(0), k):
            lo = prints(flat, sizes)[1]
            fresh = np.zeros(len(lo), bool)
            for i, x in enumerate(lo.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            if not fresh.all():
                flat, sizes, lo = flat[np.repeat(fresh, sizes)], sizes[fresh], lo[fresh]
            row, mark = signatures(flat, sizes, num, den)
            keys.append(lo[row] & U((1 << 48) - 1))
            marks.append(mark)
            held += len(row)
            if held >= 1_000_000:
                yield from flush()
                keys, marks, held, runs = [], [], 0, runs + 1
    if held:
        yield from flush()


def _rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) over edges (a, b), for nodes that aren't their own root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _meet(table: pa.Table) -> pa.Table:
    """Sets that share a piece, within one part of the signatures: (a, b, null) pairs, or (key, null, piece) rows."""
    kind, lengths = table["kind"].to_numpy(), pc.binary_length(table["marks"]).to_numpy() // 5
    mark, key = _unpacked(table["marks"].to_pylist(), 5), _unpacked(table["keys"].to_pylist(), 6)
    name = mark ^ (np.repeat(table["part"].to_numpy().astype(np.uint64), lengths) << U(40))
    kind = np.repeat(kind, lengths)
    if kind[:1].sum() == _MEMBERS:  # those come to tasks of their own
        pairs, hot_key, hot_name = np.zeros((0, 2), np.uint64), key, name
    else:
        known = np.unique(name[kind == _HOT])
        key, name, begins, counts = _grouped(key[kind == _PLAIN], name[kind == _PLAIN])
        hot = (counts > LISTED) | np.isin(name[begins], known)
        left, right = [], []
        few = (counts > 1) & ~hot
        first, size = begins[few], counts[few]
        for step in range(1, int(size.max(initial=1))):  # the pairs (i, i + step) of all groups at once
            some = size > step
            at, n = first[some], size[some] - step
            i = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            left.append(key[i])
            right.append(key[i + step])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0) if left else np.zeros((0, 2), np.uint64)
        hot = np.repeat(hot, counts)
        hot_key, hot_name = key[hot], name[hot]
    a = np.concatenate([pairs[:, 0], hot_key]).astype(np.int64)
    is_pair = np.arange(len(a)) < len(pairs)
    b = pa.array(np.concatenate([pairs[:, 1], np.zeros(len(hot_key), np.uint64)]).astype(np.int64), mask=~is_pair)
    group = pa.array(np.concatenate([np.zeros(len(pairs), np.uint64), hot_name]).astype(np.int64), mask=is_pair)
    return pa.table({"a": pa.array(a), "b": b, "hot": group})


def _crowd(table: pa.Table, num: int, den: int) -> pa.Table:
    """A spanning chain of the pairs in a group of sets that share a piece whose bitmaps allow a link."""
    table = table.sort_by("n")
    key, n = table["key"].to_numpy(), table["n"].to_numpy()
    bits, wide = np.stack([table[b].to_numpy().view(np.uint64) for b in _BITS], 1), table["wide"].to_pylist()
    label = np.arange(len(key))
    for at in range(0, len(key), 256):
        end = int(np.searchsorted(n, n[min(at + 255, len(n) - 1)] * den // num, "right"))
        rows, others = np.arange(at, min(at + 256, len(key))), np.arange(at, end)
        main = np.bincount(label[rows]).argmax()
        inside = label[rows] == main
        # Pairs that are connected already need no test: near copies of the most common group skip each other.
        for some, rest in ((rows[inside], others[label[others] != main]), (rows[~inside], others)):
            apart = np.zeros((len(some), len(rest)), np.uint16)
            for w in range(WORDS):
                apart += np.bitwise_count(bits[some, w, None] ^ bits[None, rest, w])
            most = (n[some, None] + n[None, rest]) * (den - num) // (den + num)
            i, j = np.nonzero(apart <= most)
            i, j = some[i], rest[j]
            if (large := (n[i] > wide_from(num, den)) & (n[j] > wide_from(num, den)) & (i != j)).any():
                fits = [not w or wide_apart(wide[a], wide[b]) <= (n[a] + n[b]) * (den - num) // (den + num) for a, b, w in zip(i.tolist(), j.tolist(), large.tolist(), strict=True)]
                i, j = i[fits], j[fits]
            while len(i):  # join the groups that these pairs connect
                low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                split = low != high
                if not split.any():
                    break
                np.minimum.at(label, high[split], low[split])
                label = label[label]
        while (label != label[label]).any():
            label = label[label]
    moved = label != np.arange(len(key))
    return pa.table({"a": pa.array(key[moved]), "b": pa.array(key[label[moved]])})


def crowded(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that chain all sets of each hot piece that may link: ``rows`` of key, hot, n and bitmap.

    A piece's sets are dealt to blocks of about CROWD, and to the pairs (i, j) of blocks; each pair is a task's group.
    """
    sizes = rows.groupBy("hot").count().select("hot", F.ceil(F.col("count") / CROWD).alias("blocks"))
    dealt = beside(rows, sizes, "hot", "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("block", "other", "blocks")
    return dealt.groupBy("hot", "i", "j").applyInArrow(on_table(_crowd, num=num, den=den), "a long, b long")


def _need(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap with a set of unknown size that a set of ``n`` needs."""
    return -(-n * num // den)


class _Cluster:
    """Sets of one cluster over the shingles that at least two of them hold."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, num: int, den: int):
        _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1
        column = np.cumsum(shared) - 1
        keep = shared[inverse]
        self.width = int(shared.sum())
        self.sizes, self.num, self.den = sizes, num, den
        row = np.repeat(np.arange(len(sizes)), sizes)[keep]
        self.columns = column[inverse[keep]]
        self.held = np.bincount(row, minlength=len(sizes))
        self.begins = np.cumsum(self.held) - self.held

    def own(self, i: int) -> np.ndarray:
        return self.columns[self.begins[i] : self.begins[i] + self.held[i]]

    def pairs(self, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs of a set of ``left`` and one of ``right`` (with ``same``: each pair of ``left`` once)."""
        least = _need(self.sizes, self.num, self.den)
        able = self.held >= least
        left, right = left[able[left]], right[able[right]]
        if not len(left) or not len(right):
            return
        # Groups: sets in the order of their smallest shared shingle hash.
        low = np.array([self.columns[self.begins[i]] if self.held[i] else -1 for i in right])
        right = right[np.lexsort((right, low))]
        place = np.full(len(self.sizes), -1)
        place[right] = np.arange(len(right))
        flat = np.concatenate([self.own(i) for i in left])
        edges = np.cumsum(self.held[left]) - self.held[left]
        local = np.full(self.width, -1, np.int64)
        for at in range(0, len(right), GROUP):
            group = right[at : at + GROUP]
            union = np.unique(np.concatenate([self.own(i) for i in group]))
            local[union] = np.arange(len(union))
            bound = np.add.reduceat((local[flat] >= 0).astype(np.int64), edges)
            sizes, of = self.sizes[left], self.sizes[group]
            open_ = (bound >= least[left]) & (sizes * self.den >= of.min() * self.num) & (of.max() * self.den >= sizes * self.num)
            if same:
                open_ &= place[left] < at + len(group) - 1
            query = left[open_]
            if len(query):
                members = np.zeros((len(group), len(union)), np.float32)
                for r, i in enumerate(group):
                    members[r, local[self.own(i)]] = 1
                step = max(1, (4 << 20) // max(1, len(union)))
                for q in range(0, len(query), step):
                    part = query[q : q + step]
                    rows = np.zeros((len(part), len(union)), np.float32)
                    for r, i in enumerate(part):
                        c = local[self.own(i)]
                        rows[r, c[c >= 0]] = 1
                    inter = (rows @ members.T).astype(np.int64)
                    n = self.sizes[part][:, None] + self.sizes[group][None, :]
                    hit = inter * self.den >= self.num * (n - inter)
                    if same:
                        hit &= place[part][:, None] < place[group][None, :]
                    a, b = np.nonzero(hit)
                    if len(a):
                        yield part[a], group[b]
            local[union] = -1


def _verify(table: pa.Table, k: int, num: int, den: int) -> pa.Table:
    """Links inside the clusters, or between the two blocks, that one task holds: a spanning chain and link counts."""
    table = table.sort_by([(c, "ascending") for c in ("root", "rep", "hi", "lo")]).combine_chunks()
    rep, mult, side, root, own_hi, own_lo = (table[c].to_numpy() for c in ("rep", "mult", "side", "root", "hi", "lo"))
    # Rows of one block only also come to (i, j) where block j holds no set: there no pair is counted.
    same = table["i"][0].as_py() == table["j"][0].as_py()
    flats, sizes = [], []
    for _, _, flat, size in sets_of(table["text"].combine_chunks(), k):
        flats.append(flat)
        sizes.append(size)
    flat, sizes = np.concatenate(flats), np.concatenate(sizes)
    hi, lo = prints(flat, sizes)
    # Rows that share an id come with each other's text, and copies of a row come twice: one row of a set stays.
    right = np.flatnonzero((hi.view(np.int64) == own_hi) & (lo.view(np.int64) == own_lo))
    new = np.append(True, np.any([x[right][1:] != x[right][:-1] for x in (root, own_hi, own_lo)], axis=0))[: len(right)]
    kept = np.zeros(len(sizes), bool)
    kept[right[new]] = True
    flat, sizes = flat[np.repeat(kept, sizes)], sizes[kept]
    rep, mult, side, root, own_hi, own_lo = (x[kept] for x in (rep, mult, side, root, own_hi, own_lo))
    degree = np.zeros(len(rep), np.int64)
    tops = []
    ends = np.flatnonzero(np.append(root[1:] != root[:-1], True)) + 1 if len(root) else []
    offsets = np.append(0, np.cumsum(sizes))
    begin = 0
    for end in ends:
        if end - begin > 1:
            cluster = _Cluster(flat[offsets[begin] : offsets[end]], sizes[begin:end], num, den)
            here = np.arange(end - begin)
            first = here[side[begin:end] == 0]
            for a, b in cluster.pairs(first, here if same else here[side[begin:end] == 1], same):
                a, b = a + begin, b + begin
                np.add.at(degree, a, mult[b])
                np.add.at(degree, b, mult[a])
                # A query's links keep its first member; members that a query shares are chained.
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.append(True, a[1:] != a[:-1])
                lead = b[np.flatnonzero(new)][np.cumsum(new) - 1]
                tops.append(np.stack([a[new], b[new]], 1))
                if (~new).any():
                    tops.append(np.unique(np.stack([lead[~new], b[~new]], 1), axis=0))
        begin = end
    linked = np.flatnonzero(degree)
    up = np.arange(len(rep))
    if tops:
        edge = np.concatenate(tops)
        # Nodes are numbered by the rank of rep, so that a root is the smallest one.
        rank = np.argsort(np.argsort(rep, kind="stable"), kind="stable")
        back = np.argsort(rep, kind="stable")
        node, top = _rooted(rank[edge[:, 0]], rank[edge[:, 1]])
        up[back[node]] = back[top]
    return pa.table({"rep": pa.array(rep[linked]), "hi": pa.array(own_hi[linked]), "lo": pa.array(own_lo[linked]), "top": pa.array(rep[up[linked]]), "degree": pa.array(degree[linked])})


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Link documents whose ``k``-word shingle sets have ``den * |A & B| >= num * |A | B|``.

    Returns a row for each row of ``docs``: doc_id long, n_shingles long, component_id long (smallest doc_id
    reachable by links, itself included), n_links long (other rows it links with).

    Null, empty and blank texts have the empty set and link with nothing. Texts of any length count whole.
    A text of fewer than ``k`` words has one shingle, its whole word sequence. Rows with a null doc_id come
    back with their own doc_id (null) as component unless an equal set has one; sets that only such rows have
    link with nothing. Repeated rows are rows like others: they link with each other. Rows that share a doc_id
    and differ in text share a component. Other columns are ignored, whatever their names; an empty table gives
    an empty result.

    Memory of a task is bounded by PART_SIGNATURES, two blocks of CROWD sets or two blocks of BLOCK_TOKENS. Work inside a
    cluster of different near copies grows with the square of its size, as does the number of links to count.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = saved(docs.mapInArrow(partial(_describe, k=k, least=wide_from(num, den)), "doc_id long, n long, hi long, lo long, " + _MAPS), "sets")
    tokens = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = int(tokens * 2.5 * (den - num) / (den + num)) // PART_SIGNATURES + 8
    packed = docs.select("text").mapInArrow(partial(_pieces, k=k, num=num, den=den, parts=parts), _PIECE_ROW)
    met = saved(packed.groupBy("at").applyInArrow(on_table(_meet), "a long, b long, hot long"), "met")
    classes = sets.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in (*_BITS, "wide")])
    classes = saved(classes, "classes")
    key = classes["lo"].bitwiseAND(F.lit((1 << 48) - 1))
    maps = classes.select(key.alias("key"), "n", *_BITS, "wide")
    pairs = met.where("hot is null").select("a", "b").distinct()
    narrow = classes.select(key.alias("key"), F.struct("n", *_BITS).alias("x"))
    both = pairs.join(narrow.select(F.col("key").alias("a"), "x"), "a").join(narrow.select(F.col("key").alias("b"), F.col("x").alias("y")), "b")
    apart = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in _BITS), F.lit(0))
    close = both.where(apart * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num))
    close = saved(close.select("a", "b", (F.col("x.n") + F.col("y.n")).alias("n"), (F.least("x.n", "y.n") > wide_from(num, den)).alias("large")), "close")
    wides = maps.where("wide is not null")  # only pairs that are left, of large sets, meet in their second bitmaps
    large = close.where("large").join(wides.select(F.col("key").alias("a"), "wide"), "a").join(wides.select(F.col("key").alias("b"), F.col("wide").alias("other")), "b")
    fits = large.select("a", "b", "n", "wide", "other").mapInArrow(partial(_near, num=num, den=den), "a long, b long")
    close = close.where("not large").select("a", "b").unionByName(fits)
    crowds = met.where("hot is not null").select(F.col("a").alias("key"), "hot").distinct().join(maps, "key")
    clusters = components(close.unionByName(crowded(crowds, num, den)))

    member = classes.where("rep is not null").join(clusters, key == clusters["node"]).select("rep", "hi", "lo", "mult", "n", "root")
    blocks = member.groupBy("root").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets")).where("sets > 1").withColumn("blocks", F.ceil(F.col("tokens") / BLOCK_TOKENS))
    member = saved(beside(member, blocks, "root", "rep").withColumn("block", F.expr("pmod(xxhash64(rep), blocks)")), "members")
    size = member.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bins = size[0] // BLOCK_TOKENS + 1
    wanted = member.select("root", F.col("rep").alias("doc_id"), "hi", "lo", "mult", "block", "blocks")
    texts = docs.join(F.broadcast(wanted) if size[1] <= BROADCAST_ROWS else wanted, "doc_id")
    dealt = texts.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("bin"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("block", "other")).alias("i"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.greatest("block", "other")).alias("j"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"),
        "root", F.col("doc_id").alias("rep"), "mult", "hi", "lo", "text",
    )
    links = saved(dealt.groupBy("bin", "i", "j").applyInArrow(on_table(_verify, k=k, num=num, den=den), "rep long, hi long, lo long, top long, degree long"), "links")
    found = components(links.select(F.col("rep").alias("a"), F.col("top").alias("b")))
    more = links.groupBy("hi", "lo").agg(F.sum("degree").alias("degree"))
    known = classes.join(found, classes["rep"] == found["node"], "left").join(more, ["hi", "lo"], "left")
    known = known.select("hi", "lo", F.coalesce("root", "rep").alias("top"), (F.col("mult") - 1 + F.coalesce("degree", F.lit(0))).alias("links"))
    out = sets.join(known, ["hi", "lo"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("top", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Rows with a null doc_id all stay, since no group can name them. Of rows that repeat a doc_id one stays. Columns and their order are those of ``docs``.
    """
    parts = jaccard_components(docs, k, num, den)
    keep = parts.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").select(docs.columns)
    again = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    once = kept.join(again, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])).unionByName(docs.where("doc_id is null"))
