import math
import re
from collections import Counter

import numpy as np
import pytest

from mailsieve.llm import search
from tests.llm.test_llm import docs, edge, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k):
    """By the definition: every document against every item."""
    counts = [Counter(terms(t)) for _, t in rows]
    n, length, df = sum(1 for c in counts if c), sum(c.total() for c in counts), Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        wanted, found = Counter(terms(text)), []
        for (key, _), c in zip(rows, counts, strict=True):
            m = 75 + 25 * c.total() * n // length if length else 75
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in wanted.items() if c[t])
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, r, key, -s) for r, (s, _, _, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def same(spark, rows, items, k=20):
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 as item", "'x' as terms", "2 as batch")
    got = search.ranked(docs(spark, rows), table, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items, k)


@pytest.fixture
def small(monkeypatch):
    """Blocks and batches as small as they get, so that lists, bounds and items are cut."""
    monkeypatch.setattr(search, "BLOCK_DOCS", 7)
    monkeypatch.setattr(search, "TERMS_AT_ONCE", 12)


@pytest.mark.parametrize("k", [1, 5, 20])
def test_equals_brute_force(spark, small, k):
    r = np.random.default_rng(k)
    words = [f"w{i}" for i in range(60)] + ["Straße", "漢字", "É", "42"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda n: ", ".join(r.choice(words, n, p=p / p.sum()))
    rows = [(i, text(r.integers(1, 40))) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties
    items = [(i, text(r.integers(1, 9))) for i in range(12)] + [(3, rows[5][1]), (3, rows[5][1]), (50, "nowhere"), (None, "w1 w1 W1 w2")]
    same(spark, rows, items, k)


def test_edges(spark):
    rows = [(r["doc_id"], r["text"]) for r in edge(spark).collect()]
    same(spark, rows, [(1, None), (2, ""), (3, "same WORDS"), (4, "words " * 5000 + "river3 漢字 no"), (5, "!!!"), (5, "id")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert search.ranked(edge(spark), none).count() == 0 and search.ranked(empty(spark), none).count() == 0
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.ranked(empty(spark), some).count() == 0


def test_terms():
    text = "Ab-c1_É\x7f漢 [x] {y} `z` @q"
    assert [t.decode() for t in search.terms_of(text)] == terms(text) == ["ab", "c1", "É", "漢", "x", "y", "z", "q"]
