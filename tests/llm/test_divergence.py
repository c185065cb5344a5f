import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mailsieve.llm import divergence
from tests.llm.test_llm import DOCS, edge, empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least_docs, most):
    """Every group with every kept term, by the definition."""
    df, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        df[lang].update({*found})
        counts[lang, source].update(found)
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= least_docs]
        whole = sum((counts[lang, s] for s in sources), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, own = p(whole), {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode()) for o in sources - {s})
            terms = sorted((q[t] - own[s][t], t.encode()) for t in kept if counts[lang, s][t] and own[s][t] > q[t])[:most]
            out += [(lang, s, part, i.decode(), -v, r) for part, found in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, 1, "n", False, 0, "c") for i, (lang, s, t) in enumerate(rows)], DOCS)


def same(spark, rows, least_docs=3, most=50):
    got = divergence.audit(table(spark, rows), least_docs=least_docs, most_terms=most)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least_docs, most)


@pytest.fixture
def small(monkeypatch):
    """Slices, chunks and tiles as small as they get."""
    for name, n in (("TERMS_AT_ONCE", 20), ("CHUNK", 5), ("TILE", 2), ("HELD", 10)):
        monkeypatch.setattr(divergence, name, n)


@pytest.mark.parametrize("most", [4, 50])
def test_equals_brute_force(spark, small, most):
    r = np.random.default_rng(most)
    words = [a + b for a in "abcdefgh" for b in "xyzé漢ß"] + ["Straße", "ÉA"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda n: "1 ".join(r.choice(words, n, p=p / p.sum()))
    rows = [(r.choice(["en", "de"]), f"s{min(r.integers(0, 9), 5)}", text(r.integers(0, 30))) for _ in range(200)]
    rows += [("en", "rare", "zzz"), ("xx", "one", text(9)), (None, None, text(9)), ("", "two", text(9)), ("en", None, None)] + rows[:20]
    same(spark, rows, most=most)


def test_edges(spark):
    rows = [(r["lang"], r["source"], r["text"]) for r in edge(spark).collect()]
    same(spark, rows, 1)
    same(spark, rows, 100)
    same(spark, [("en", "a", "x" * 100_000), ("en", "b", "x " * 100_000), ("en", "b", "x " * 100_000)], 1)
    assert divergence.audit(empty(spark)).count() == 0


def test_shares_are_exact(spark):
    r = np.random.default_rng(1)
    counts, totals = r.integers(0, 1 << 46, 500), r.integers(1, 1 << 47, 500)
    want = [1 + 10**9 * (int(c) + 5) // int(t) for c, t in zip(counts, totals, strict=True)]
    fine = [i for i, w in enumerate(want) if w < 1 << 62]
    assert [int(x) for x in divergence.shares(counts[fine], totals[fine])] == [want[i] for i in fine]
    rows = spark.createDataFrame([(i, int(counts[i]), int(totals[i])) for i in fine], "i int, c long, t long")
    got = rows.withColumn("p", divergence.share(rows["c"], rows["t"])).orderBy("i").collect()
    assert [x["p"] for x in got] == [want[i] for i in fine]
