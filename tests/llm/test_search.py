import math
from collections import Counter

import numpy as np

from conftest_llm import ALNUM, LOWER
from spectroloom.llm import lexical_search as L


def brute(docs, items, best=50):
    """``(item, rank, doc, score)`` by scoring every document for every item."""
    terms = lambda t: ALNUM.findall((t or "").translate(LOWER))
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(1 for _, _, k in held if k), sum(k for _, _, k in held)
    df = Counter(w for _, c, _ in held for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in asked.items():
        found = []
        for doc, c, k in held:
            if k:
                m = 100 - 50 + 50 * k * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 20 * m)) for w in words if w in c)
                if score > 0:
                    found.append((-score, doc is None, doc or 0, doc))
        out += [(i, r + 1, doc, -score) for r, (score, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:best])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def items_of(rows):
    texts = [r[1] for r in rows]
    return [(1, texts[0]), (2, texts[3]), (3, "NARI nari sota-loMO kéri"), (3, "üta"), (4, ""), (5, None), (6, "not there at all"), (None, texts[4]), (7, texts[64]), (8, texts[66]), (8, texts[66])]


def test_search_matches_brute_force(spark, docs, rows, tmp_path):
    items = items_of(rows)
    queries = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, score string")
    plain = [(r[0], r[1]) for r in rows]
    assert got(L.ranked_search(docs, queries)) == brute(plain, items)
    index = L.build_index(docs, str(tmp_path / "index"))
    assert got(L.search(index, queries, best=3)) == brute(plain, items, 3)
    names = queries.selectExpr("CAST(item_id AS string) AS item_id", "text")
    assert got(L.search(index, names, best=2)) == brute(plain, [(None if i is None else str(i), t) for i, t in items], 2)


def test_blocks_of_items(spark, docs, rows, tmp_path, monkeypatch):
    items = items_of(rows)
    queries = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(L, "BLOCK_TERMS", 60)
    assert got(L.search(L.build_index(docs, str(tmp_path / "index")), queries, best=5)) == brute([(r[0], r[1]) for r in rows], items, 5)


def test_repeated_rows_null_ids_and_no_rows(spark, odd_docs, no_docs):
    items = [(1, "w1 w2 w3"), (2, "words five")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert got(L.ranked_search(odd_docs, queries)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    assert got(L.ranked_search(no_docs, queries)) == []
    assert got(L.ranked_search(odd_docs, queries.limit(0))) == []


def test_hybrid_offers_all_that_reach_the_floor(monkeypatch):
    g = np.random.default_rng(1)
    for trial in range(150):
        monkeypatch.setattr(L, "WINDOW", int(g.integers(1, 60)))
        monkeypatch.setattr(L, "SHORT_POSTINGS", int(g.integers(0, 40)))
        n = int(g.integers(1, 300))
        lists, want = [], np.zeros(n, np.int64)
        for _ in range(int(g.integers(1, 9))):
            docs = np.flatnonzero(g.random(n) < g.random())
            if len(docs):
                scores = g.integers(1, int(g.choice([3, 100, 10000])), len(docs))
                want[docs] += scores
                lists.append((docs, scores, int(scores.max())))
        if not lists:
            continue
        top, k = None, int(g.integers(1, 12))
        top = L.Best(k, 1)
        seen = []
        L.hybrid(lists, n, lambda: top.floor, lambda d, v: (seen.append(len(d)), top.offer(v, d, np.zeros(len(d), bool))))
        order = sorted((-want[i], i) for i in range(n) if want[i])[:k]
        assert list(zip((-top.scores).tolist(), top.ids.tolist())) == order


def test_norms_beyond_64_bits():
    lengths = np.array([0, 1, 10**7, 10**9])
    n, total = 10**11, 3 * 10**14
    assert L.length_norms(lengths, n, total).tolist() == [100 - 50 + 50 * int(v) * n // total for v in lengths]
    assert L.length_norms(lengths[:2], 5, 7).tolist() == [50, 50 + 250 // 7]
