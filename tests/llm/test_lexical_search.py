"""Lexical search against scores of every document, and the treap against a dense grid."""

import math
import random
import re
from collections import Counter

import fixtures as fx
import numpy as np
import pytest

from riskspark.llm import lexical_search
from riskspark.llm.k2_treap import K2Treap

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(1, "The harbour bells ring at dusk"), (2, None), (3, ""), (4, "zebra xylophone"), (5, "two WORDS, two words!"),
         (6, "漢字 é 😀"), (7, "row-same id"), (7, "repeated"), (None, "one"), (8, "..."), (9, fx.PROSE), (9, fx.PROSE)]


def expected(docs, items, most=10):
    found = [(i, Counter(TERM.findall(fx.lowered(t or "")))) for i, t in docs]
    n_docs, total = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(fx.lowered(t or "")))
    out = set()
    for item, terms in asked.items():
        scores = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n_docs // total if total else 10
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out |= {(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:most], 1)}
    return out


def items_of(spark, some=None):
    return spark.createDataFrame(ITEMS if some is None else some, "item_id long, text string")


def got(frame):
    rows = [tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block_terms,shard_docs", [(200_000, 8192), (7, 3)])
def test_search_by_brute_force(spark, monkeypatch, block_terms, shard_docs):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard_docs)
    docs = fx.documents(spark)
    out = got(lexical_search.ranked(docs, items_of(spark), block_terms=block_terms))
    assert out == expected([(r[0], r[1]) for r in fx.rows()], ITEMS)


def test_ties_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 16)
    monkeypatch.setattr(lexical_search, "SHARD_CELLS", 60)
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(rng.randrange(150) if rng.random() < 0.9 else None, " ".join(rng.choices(words, k=rng.choice([1, 5, 30]))))
            for _ in range(300)] + [(i, "w1 w2 w3") for i in range(1000, 1200)]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(20)] + [(50, "w1 w2 w3")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for most in (1, 10):
        assert got(lexical_search.ranked(frame, items_of(spark, items), most)) == expected(rows, items, most)


def test_empty_tables(spark):
    docs, items = fx.documents(spark), items_of(spark)
    assert lexical_search.ranked(docs.limit(0), items).count() == 0
    assert lexical_search.ranked(docs, items.limit(0)).count() == 0
    assert lexical_search.ranked(docs, items_of(spark, [(1, None)])).count() == 0


def test_treap_against_a_grid():
    rng = np.random.default_rng(8)
    for rows, columns, share in ((1, 1, 1.0), (30, 70, 0.2), (200, 33, 0.02), (64, 64, 0.9), (5, 300, 0.0)):
        grid = rng.integers(1, 50, (rows, columns)) * (rng.random((rows, columns)) < share)
        r, c = np.nonzero(grid)
        treap = K2Treap(r, c, grid[r, c])
        for _ in range(20):
            path = rng.choice(rows, rng.integers(1, min(rows, 9) + 1), replace=False)
            sums = grid[path].sum(0)
            floor = int(rng.integers(0, 80))
            plain = sorted((-int(s), k) for k, s in enumerate(sums) if s >= max(floor, 1))[:7]
            assert treap.best(path, 7, floor) == [(-s, k) for s, k in plain]
