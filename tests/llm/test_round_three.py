"""Centroid clustering, source divergence and quality rules against brute force, and on awkward inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


# --- centroid clustering ---------------------------------------------------------------------------------------------
def _lloyd(rows, k=16, rounds=3, width=64):
    """Plain Lloyd with Python's integers; rows of (id, vector)."""
    kept = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
    if not centroids:
        return []
    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            if mine:
                centroids[c] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    at = assign()
    most = (1 << 63) - 1
    distance = [min(far(v, centroids[a]), most) for (_, v), a in zip(kept, at, strict=True)]
    own = Counter()
    for a, d in zip(at, distance, strict=True):
        own[a] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), a, d, min(own[a], most), min(sum(own.values()), most), sha[a]) for (i, _), a, d in zip(kept, at, distance, strict=True))


def _clustered(df, **more):
    from sheetwright.llm.clustering import cluster

    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in cluster(df, **more).collect())


def test_clustering(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
    assert _clustered(vectors) == _lloyd(rows)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e8, 1e18, 1e30, 1e306])
def test_clustering_of_any_size(spark, scale):
    """Ties, repeated rows and ids, rows without an id, and components that no machine number holds."""
    rng = random.Random(int(math.log10(scale)) + 1)
    rows = [(i % 40, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(70)]
    rows += [(None, [1.0, 0.0, 0.0, 0.0]), (7, None), (8, [1.0]), (9, [1.0, None, 0.0, 0.0]), (10, [math.nan] * 4), (11, [math.inf, 0.0, 0.0, 0.0]), (12, []), (13, [0.5] * 5)]
    rows += [(100 + i, [rng.choice([-1.3, 0.7, 1.9]) * scale for _ in range(4)]) for i in range(20)] + [(200, [scale, 0.0, -scale, 0.1])] * 3
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(5)
    assert _clustered(df, k=6, rounds=3, width=4) == _lloyd(rows, 6, 3, 4)


def test_clustering_of_few(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [2.0, 1.0])], "vec_id long, embedding array<float>")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert _clustered(df, width=2) == _lloyd(rows, width=2)
    assert _clustered(df.limit(0), width=2) == []
    assert _clustered(df.selectExpr("cast(null as long) as vec_id", "embedding"), width=2) == []


def test_screening_interval():
    """The true distance lies in the interval, the shortlist is never without the nearest, and most are sure at once."""
    from sheetwright.llm.clustering import Centroids

    rng = np.random.default_rng(3)
    for scale in (1.0, 300.0, 1e6):
        raw = np.floor(rng.normal(size=(300, 64)) * scale * 64) / 64
        centroids = Centroids([[int(v) for v in row] for row in np.floor(rng.normal(size=(16, 64)) * scale * 64)])
        x = np.floor(raw * 64)
        low, high = centroids.intervals(x)
        own = [[int(v) for v in row] for row in x]
        true = np.array([[float(sum(c * c for c in r) - 2 * sum(a * c for a, c in zip(o, r, strict=True))) for r in centroids.rows] for o in own])
        assert (low <= true).all() and (true <= high).all()
        best, far, again = centroids.nearest(raw)
        want = [min((sum((a - c) ** 2 for a, c in zip(o, r, strict=True)), i) for i, r in enumerate(centroids.rows)) for o in own]
        assert list(zip(far.tolist(), best.tolist(), strict=True)) == want
        assert again < 30


# --- source divergence -----------------------------------------------------------------------------------------------
def _audit(rows, least=3, top=200):
    """Plain audit with Python's integers; rows of (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        groups[lang].add(source)
        lower = text.translate({c: c + 32 for c in range(65, 91)})
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        every = Counter()
        for s in sources:
            every.update(counts[lang, s])

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(every)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, i) for i, (v, o) in enumerate(pairs, 1)] + [(lang, s, "term", t, v, i) for i, (v, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    """Several shards, merged counts, long texts in pieces, and awkward rows."""
    from sheetwright.llm import divergence

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    rows += [(None, None, None), ("en", "src0", None), ("en", "none", ""), ("en", None, "12 34 !"), ("zz", "one", "A a É é"), ("zz", "two", ""), ("en", "src0", "the And É" * 3)] * 2
    rows += [("en", "long", ("word été naïve x" + "\n") * 3000 + "y" * 5000), ("xx", "a", "same same"), ("xx", "a", "same same"), ("xx", "b", "SAME other"), ("xx", "c", "other")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, n int, term string, shard int")
    got = lambda **k: sorted(tuple(r) for r in divergence.audit(df, **k).collect())
    want = _audit(rows)
    assert got() == want
    monkeypatch.setattr(divergence, "SHARD_ROWS", 500)
    assert got(top=5) == _audit(rows, top=5)
    assert got(least=10**6) == _audit(rows, least=10**6)
    assert divergence.audit(df.limit(0)).count() == 0


def test_counts_in_pieces(monkeypatch):
    """Small pieces and merges change nothing."""
    import pyarrow as pa

    from sheetwright.llm import divergence

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "Ab", "é", "éé", "x1y", "long" * 30]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 60), pa.array([f"s{i % 3}" for i in range(60)]), pa.array(texts)], ["lang", "source", "text"])

    def totals():
        n, docs = Counter(), Counter()
        for part in divergence._count(iter([batch, batch])):
            for r in part.to_pylist():
                n[r["source"], r["term"]] += r["n"]
                docs[r["source"], r["term"]] += r["docs"]
        return n, docs

    whole = totals()
    monkeypatch.setattr(divergence, "PIECE", 300)
    monkeypatch.setattr(divergence, "MERGE_ROWS", 4)
    assert totals() == whole


# --- quality rules ---------------------------------------------------------------------------------------------------
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _judge(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    lettered = sum(bool(re.search(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]", w)) for w in words)
    dup = len(lines) - len(set(lines))
    bad = 100 * symbols > 10 * len(words) or chars < 2 * len(words) or chars > 15 * len(words) or (dup >= 3 and 100 * dup > 30 * len(lines)) or 100 * lettered < 80 * len(words) or 100 * upper > 60 * letters
    return len(words), chars, symbols, dup, len(covered), failed, not failed and not bad


def _texts():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "\n\n", "a", "a b c", "a b c a b c", "one two three " * 17, "x\x0by\x0cz " * 20, "word " * 49, "word" + " w" * 49, "é ü " * 60, "\n".join(["line of words"] * 40), "\n".join([" ".join(f"w{i}{j}" for j in range(30)) for i in (1, 2, 1, 3)]), "\n".join([" ".join(f"w{i}{j}" for j in range(30)) for i in (1, 2, 1, 2, 3, 4, 5, 5)]), "big " * 20000]
    parts = ["a", "B", "é", "#", "12", "word", " ", "  ", "\n", "\n\n", "\t", "longer", "THE", "|", "ß", "日本"]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    plain = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    return texts + [" ".join(plain() + rng.choice(["", "", "", "!!", "#"]) for _ in range(rng.randint(40, 200))) for _ in range(100)]


def test_quality(spark):
    from sheetwright.llm.quality import good, judge

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + _texts() * 2
    df = spark.createDataFrame([(i % 400 or None, "x", t, 9) for i, t in enumerate(texts)], "doc_id long, kept string, text string, n_words int")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted((str(r.doc_id), *(r[c] for c in columns)) for r in judge(df).collect())
    assert got == sorted((str(i % 400 or None), *_judge(t)) for i, t in enumerate(texts))
    kept = good(df)
    assert kept.columns == df.columns
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(str((i % 400 or None, "x", t, 9)) for i, t in enumerate(texts) if _judge(t)[-1])
    assert judge(df.limit(0)).count() == good(df.limit(0)).count() == 0


def test_cascade_order():
    """Any order gives the same verdict; a rule sees only what those before it left; the order follows rejections per second."""
    import pyarrow as pa

    from sheetwright.llm import quality
    from sheetwright.llm.wordsets import pieces_of

    texts = [t or "" for t in _texts()]
    (_, _, data, offsets), *none = pieces_of(pa.array(texts))
    assert not none
    names = [r.name for r in quality.RULES]
    want = [_judge(t)[-1] for t in texts]
    rng = random.Random(1)
    for _ in range(6):
        rng.shuffle(names)
        assert quality.cascade(quality.Texts(data, offsets), names).tolist() == want
    seen = []
    rules = (quality.Rule("first", lambda t: seen.append(len(t)) or np.arange(len(t)) % 2 == 0), quality.Rule("second", lambda t: seen.append(len(t)) or np.zeros(len(t), bool)))
    before, quality.RULES = quality.RULES, rules
    try:
        quality.cascade(quality.Texts(data, offsets), ["first", "second"])
        assert seen == [len(texts), len(texts) // 2]
        assert quality.measure(texts, ["second"])["second"][1] == 0
    finally:
        quality.RULES = before


def test_rule_order(spark):
    from sheetwright.llm import quality

    calm = spark.range(2000).selectExpr("concat(repeat(concat('w', id, ' x', id * 7, ' '), 1), repeat(' ###', 60)) as text")
    names = quality.order_rules(calm)
    assert sorted(names) == sorted(r.name for r in quality.RULES)
    assert names.index("symbols") < names.index("repeated_lines")
    assert quality.order_rules(calm.limit(0)) == [r.name for r in quality.RULES]


def test_big_vocabulary(monkeypatch):
    """Windows are told apart where a text has more different words than two codes fit beside a third."""
    import pyarrow as pa

    from sheetwright.llm.quality import Texts
    from sheetwright.llm.wordsets import pieces_of

    text = " ".join(map(str, range((1 << 21) + 5))) + " 5 6 7 8"
    ((_, _, data, offsets),) = pieces_of(pa.array([text]))
    assert Texts(data, offsets).n_repeat_words.tolist() == [8]


# --- exact top-k: long vectors and repeated ids ----------------------------------------------------------------------
def _nearest(rows, every=20, k=20):
    """The best of each query row by Python's integers."""
    most = (1 << 63) - 1
    own = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows]
    out = []
    for a, (i, v) in enumerate(own):
        if i % every == 0:
            best = sorted((-max(-most, min(most, sum(p * q for p, q in zip(v, w, strict=True)))), j) for b, (j, w) in enumerate(own) if b != a)[:k]
            out += [(i, r, j, -score) for r, (score, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [400, 8 << 20])
def test_top_k_of_long_vectors(spark, monkeypatch, size):
    """Long vectors, whose scores no machine number holds, lie apart; ids repeat; zeros and ties."""
    from sheetwright.llm import topk

    monkeypatch.setattr(topk, "BUCKET_BYTES", size)
    monkeypatch.setattr(topk, "BLOCK", 7)
    rng = random.Random(4)
    rows = [(i % 150, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(260)]
    rows += [(300 + i, [rng.choice([1e6, -1e7, 1e8, 3e17, 1e30, 1e307]) * rng.uniform(0.5, 1), *[rng.uniform(-2, 2) for _ in range(5)]]) for i in range(45)]
    rows += [(20, [0.0] * 6), (340, [1e8, 0.0, 0.0, 0.0, 0.0, 0.0]), (340, [1e8, 0.0, 0.0, 0.0, 0.0, 0.0])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == _nearest(rows)


def test_long_vectors_keep_pivots(spark, monkeypatch):
    """One long vector leaves the others on the pivot path: integers of any size are used for its own pairs only."""
    from sheetwright.llm import topk

    rows = [(i, [math.sin(i * j) for j in range(1, 9)]) for i in range(400)]
    pairs = []
    by_bounds, by_intervals = topk._by_bounds, topk._by_intervals
    monkeypatch.setattr(topk, "_by_bounds", lambda q, x, *more: pairs.append(("bounds", len(q) * len(x))) or by_bounds(q, x, *more))
    monkeypatch.setattr(topk, "_by_intervals", lambda q, x, *more: pairs.append(("intervals", len(x))) or by_intervals(q, x, *more))
    import pyarrow as pa

    def packed(part, bucket):
        table = pa.table({"bucket": [bucket] * len(part), "vec_id": [i for i, _ in part], "row": [i for i, _ in part], "vector": [v for _, v in part], "floor": [float("-inf")] * len(part)})
        return topk._pack(table, topk.choose_pivots(topk._whole(np.array([v for _, v in rows])), 16)).to_pylist()[0]

    long = packed([(1000, [1e8] + [0.0] * 7)], 1)
    for q, x in ((packed(rows[:20], 0), packed(rows, 0)), (packed(rows[:20], 0), long)):
        met = {**{f"q_{c}": q[c] for c in ("ids", "rows", "vectors", "far", "squares")}, "floors": q["floors"], **{c: x[c] for c in ("ids", "rows", "vectors", "far", "squares")}}
        list(topk._search(iter([pa.RecordBatch.from_pylist([met])]), 20))
    assert sum(n for kind, n in pairs if kind == "intervals") == 20
    assert sum(n for kind, n in pairs if kind == "bounds") == 20 * 400


def test_top_k_stops(monkeypatch):
    """Bounds end a search early, are never below a score, and large sums are exact too."""
    from sheetwright.llm import topk

    rng, seen, best = np.random.default_rng(8), [], topk._best
    monkeypatch.setattr(topk, "_best", lambda scores, *more: seen.append(len(scores)) or best(scores, *more))
    for scale in (40, 3000):
        x = np.floor(rng.normal(size=(3000, 8)) * scale) + rng.integers(0, 2, (3000, 1)) * 40 * scale
        q = x[:9]
        pivots = topk.choose_pivots(x[:200], 16)
        far, x2 = topk._distances(x, pivots), topk._squares(x)
        bounds = topk._bounds(far[:9], far, x2[:9], x2)
        exact = q @ x.T
        assert (bounds >= exact).all()
        ids = rng.permutation(3000)
        seen.clear()
        got = topk._by_bounds(q, x, ids, bounds, np.full(9, -np.inf), 5)
        for i, (found, scores) in enumerate(got):
            order = np.lexsort((ids, -exact[i]))[:5]
            assert found.tolist() == ids[order].tolist() and scores.tolist() == exact[i][order].tolist()
        assert sum(seen) < 9 * 1500


@pytest.mark.parametrize("broadcast", [200_000, -1])
def test_warc_without_ids(spark, monkeypatch, broadcast):
    """Rows without an id revisit the smallest id; without any id all are responses. SQL says the same."""
    import duckdb

    from sheetwright.llm import warc
    from sheetwright.llm.queries import ORACLE_SQL

    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    rows = [(9, "x" * 200), (5, "x" * 200), (None, "x" * 200), (None, "x" * 200), (5, "x" * 200), (None, "y" * 200), (None, "y" * 200), (3, "z" * 200), (None, "short"), (4, "short"), (None, None), (7, None)]
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.intact) for r in warc.round_trip(df).collect())
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    want = sorted((str(i), n, d, t, str(f), ok) for i, n, d, t, f, ok in con.execute(ORACLE_SQL["op5_warc"]).fetchall())
    assert got == want
    kinds = {(i, t, f) for i, _, _, t, f, _ in got}
    assert ("None", "revisit", "5") in kinds and ("9", "revisit", "5") in kinds and ("5", "response", "None") in kinds and ("5", "revisit", "5") not in kinds
