"""Link counts of the Jaccard join against brute force."""

import numpy as np


def test_links_of_small_clusters_in_blocks(spark, monkeypatch):
    from sheetwright.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 40)
    rng = np.random.default_rng(6)
    rows = []
    for c in range(40):  # clusters of 2 to 4 near copies: blocks often hold no set
        words = [f"c{c}w{i}" for i in range(50)]
        for _ in range(2 + c % 3):
            own = list(words)
            own[int(rng.integers(0, 50))] = "x"
            rows.append((len(rows), " ".join(own)))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    want = [sum(100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    assert max(want) == 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_components(docs, 3, 80, 100).collect()}
    assert [got[i] for i in range(len(rows))] == want


def _brute(rows, k, num):
    """(links, component) of each row by its position, by all pairs."""
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for _, t in rows)]
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= num * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    return links, [root(i) for i in range(len(rows))]


def test_large_sets_near_the_threshold(spark):
    """Sets of 800 to 3,000 shingles whose similarity lies just above or below the threshold: no link may be missed."""
    from sheetwright.llm.jaccard import jaccard_components

    rng = np.random.default_rng(11)
    rows = []
    for c, n in enumerate((800, 1000, 1400, 2000, 2600, 3000) * 4):
        words = [f"c{c}w{i}" for i in range(n)]
        rows.append((len(rows), " ".join(words)))
        for off in (-2, 0, 2, 12):  # each changed word costs three shingles on either side
            own, changes = list(words), int(n * 10 / 190 * 0.5 * 2 / 3) + off
            for at in rng.choice(n // 4, changes, replace=False) * 4:
                own[at] = f"y{len(rows)}_{at}"
            rows.append((len(rows), " ".join(own)))
    links, tops = _brute(rows, 3, 90)
    assert 0 < sum(x > 0 for x in links) < len(rows)
    got = {r.doc_id: (r.n_links, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert [got[i] for i in range(len(rows))] == list(zip(links, tops, strict=True))


def test_hot_pieces(spark, monkeypatch):
    """A passage that all texts share and a crowd of near copies, over several runs and blocks."""
    from sheetwright.llm import jaccard

    monkeypatch.setattr(jaccard, "LISTED", 3)
    monkeypatch.setattr(jaccard, "CROWD", 9)
    rng = np.random.default_rng(12)
    shared = [f"s{i}" for i in range(60)]
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(70):
        own = [*shared, *(f"u{i}_{j}" for j in range(int(rng.integers(2, 30))))] if i % 2 else list(base)
        for at in rng.integers(0, len(own), int(rng.integers(0, 4))):
            own[at] = f"x{i}"
        rows.append((i, " ".join(own)))
    for num in (80, 90):
        links, tops = _brute(rows, 3, num)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_links, r.component_id) for r in jaccard.jaccard_components(docs, 3, num, 100).collect()}
        assert [got[i] for i in range(len(rows))] == list(zip(links, tops, strict=True))


def test_rows_that_share_an_id(spark):
    """Two linked texts under one id count as two rows of one component."""
    from sheetwright.llm.jaccard import jaccard_components

    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join([*words[:-1], "z"])), (2, " ".join([*words[:-1], "q"])), (None, " ".join(words))]
    got = sorted((str(r.doc_id), r.n_links, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect())
    assert got == [("1", 3, 1), ("1", 3, 1), ("2", 3, 1), ("None", 3, 1)]
