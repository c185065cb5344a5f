import hashlib
import html as entities
import re
import textwrap
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mailsieve.llm import ann, bpe, cotrain, html, licences, packing, queries, rules, simhash, tokens, warc
from mailsieve.llm.graph import components
from mailsieve.llm.tree import decide, grow
from tests.conftest import SF, same_as_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, keep boolean, part int, content string"
WORDS = "the river bridge council winter stone garden letter morning paper window road field market school music light water summer story"


def docs(spark, texts):
    """Extra columns have the names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, None, 1, "n", False, 0, "c") for i, t in texts], DOCS)


def edge(spark):
    long = " ".join(f"{w}{i % 97}" for i in range(3000) for w in WORDS.split())
    return docs(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "Same words here"), (5, "same  WORDS here"), (5, "same  WORDS here"), (None, "no id"), (6, long), (7, "é 漢字 😀 <|endoftext|> x y"), (8, "Same words here")])


def empty(spark):
    return docs(spark, [])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    same_as_sql(spark, name)


def test_quality_edges(spark):
    got = rules.judge(edge(spark)).collect()
    assert len(got) == 10 and all(r["base_failed"] for r in got if r["doc_id"] != 6)
    assert rules.judge(empty(spark)).count() == 0 and rules.filter_documents(empty(spark)).columns == empty(spark).columns
    text = "one two three one two three " + " ".join(f"w{i}" for i in range(60))
    row = rules.judge(docs(spark, [(1, text)])).first()
    assert (row["n_words"], row["n_repeat_words"], row["base_failed"]) == (66, 6, False)


def test_filter_keeps_vowel_signs(spark):
    words = "हिन्दी में लिखी हुई किताबें पढ़ने की इच्छा थी और बूढ़े दुकानदार ने मुझे पुरानी कहानियों की सूची दिखाई".split()
    hindi = " ".join(f"{w}, {k}" if k % 3 == 0 else w for k, w in enumerate(np.random.default_rng(3).choice(words, 120)))
    rows = [(1, hindi), (2, " ".join(f"a{i} 77{i}," for i in range(60)))]
    kept = {r["doc_id"] for r in rules.filter_documents(docs(spark, rows)).collect()}
    assert kept == {1} == {r["doc_id"] for r in rules.judge(docs(spark, rows)).where("kept").collect()}


def test_cascade_order_and_names(spark):
    """The same order on every run, cheap rules that reject first; tables may hold the operator's own column names."""
    rows = [(i, "word " * 10 if i % 2 else " ".join(chr(97 + k // 26) + chr(97 + k % 26) + "ab" for k in range(80))) for i in range(5000)]
    table = docs(spark, rows)
    orders = [rules.cascade(table.repartition(n, "doc_id"), "text", "x")[1] for n in (4, 4)]
    assert orders[0] == orders[1] and set(orders[0]) == {r.name for r in rules.RULES} and orders[0].index("few_words") < orders[0].index("few_letters")
    clash = table.withColumns({"rejected_by": F.lit("a"), "__rejected_by": F.lit("b"), "Rejected_By_": F.lit("c")})
    kept = rules.filter_documents(clash)
    assert kept.columns == clash.columns and kept.count() == 2500 and kept.select("rejected_by").distinct().count() == 1
    assert {r["kept"] for r in rules.judge(clash).where("doc_id % 2 = 0").collect()} == {True}


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_bpe_equals_library(spark, texts):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    library = bpe.vocabulary(path).library
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df, rows in ((spark.read.parquet(f"{SF}/documents.parquet"), texts), (edge(spark), [(r["doc_id"], r["text"]) for r in edge(spark).collect()])):
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in tokens.encode_decode(df, path, digests=True).collect())
        want = []
        for i, t in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        assert got == sorted(want)
    assert tokens.encode_decode(empty(spark), path).count() == 0


def test_token_counts_equal_library(spark, texts):
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    library = bpe.vocabulary(path).library
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(spark.read.parquet(f"{SF}/documents.parquet"), path).collect())
    assert got == sorted((i, len((t or "").encode()), n := count(t), n > 512) for i, t in texts)
    text = "It's 12 o'clock,  and the café wasn't  open.\n\n naïve 漢字 😀 <|endoftext|>tail"
    assert bpe.PrefixCounter(bpe.vocabulary(path)).prefixes(text).tolist() == [count(text[:p]) for p in range(len(text) + 1)]
    assert {r["n_tokens"] for r in tokens.count_tokens(edge(spark), path).where("doc_id in (1, 2)").collect()} == {0}


def test_co_training(spark):
    bad, good = (np.random.default_rng(s) for s in (1, 2))
    rows = [(i, " ".join((good if i % 2 else bad).choice((WORDS if i % 2 else "zz1 qq## 77$ buy!! click >>> win$$$ free").split(), 80))) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = cotrain.score(docs(spark, rows), labels).collect()
    held = [r for r in got if r["doc_id"] >= 300]
    assert len(got) == 600 and np.mean([r["keep"] == bool(r["doc_id"] % 2) for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    kept = cotrain.filter_documents(edge(spark), labels)
    assert kept.columns == edge(spark).columns
    none = cotrain.score(edge(spark), labels.where("quality = 1"))
    assert none.count() == 10 and none.where("keep and score is null").count() == 10 and cotrain.score(empty(spark), labels).count() == 0


def test_co_training_uses_the_whole_pool(spark):
    source = docs(spark, [(i, (WORDS if i % 2 else "zz1 qq## 77$ buy!! click >>> win$$$ free") + f" w{i % 7}") for i in range(5000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    hot = source.unionByName(source.where("doc_id = 1").crossJoin(spark.range(300).select()))
    model = cotrain.fit(hot, labels)
    assert (model[3]["pool"], model[3]["labelled"], model[3]["held_out"]) == (4900, 80, 20)
    assert min(model[3]["to_text"], model[3]["to_meta"]) >= 0 and model[3]["to_meta"] > 400
    again = cotrain.fit(hot.repartition(3, "text"), labels)
    assert all((a.w == b.w).all() and a.b == b.b for a, b in zip(model[:2], again[:2]))


def test_co_training_learns_from_the_whole_table(spark):
    """Filtered documents hold no bad labels any more; fitted on the table before, the classifier still finds bad rows."""
    r = np.random.default_rng(4)
    bad = lambda: " ".join(r.choice("zz1 qq## 77$ buy!! click >>> win$$$ free".split(), 80))
    good = lambda: " ".join(r.choice(WORDS.split(), 80))
    raw = docs(spark, [(i, good() if i % 4 else bad()) for i in range(800)])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 800, 2)], "doc_id long, quality int")
    left = raw.where("doc_id % 4 > 0 or doc_id > 750").withColumns({"view": F.lit(1), "view_": F.lit(2)})
    kept = cotrain.filter_documents(left, labels, fit_on=raw)
    assert kept.columns == left.columns and sorted(x["doc_id"] for x in kept.collect()) == [i for i in range(800) if i % 4]
    with pytest.warns(UserWarning):
        assert cotrain.filter_documents(left, labels.where("quality = 1")).count() == left.count()
    long = "same" * 50
    assert (cotrain.text_features(pa.array([long + "a"])).slots != cotrain.text_features(pa.array([long + "b"])).slots).any()


def plain_features(text):
    """Slots and weights of one text, word by word."""
    words, rows = (text or "").split(), []
    for w in {*words}:
        h = sum((b + 1) * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k, b in enumerate(w.encode())) % (1 << 64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * factor % (1 << 64)
        rows.append(((h ^ h >> 31) >> 49, 1 + np.log(words.count(w))))
    norm = np.sqrt(sum(x * x for _, x in rows))
    kinds = (str.isalpha, str.isupper, str.isdigit, lambda w: not w.isalnum() and not w[:-1].isalpha(), lambda w: not any(map(str.isalnum, w)))
    chars, n = max(1, sum(map(len, words))), max(1, len(words))
    shapes = [*(sum(len(w) for w in words if k(w)) / chars for k in kinds), len({*words}) / n, max(map(words.count, words), default=0) / n, min(1, len(words) / 1000), float(not words), min(2, chars / n / 10)]
    return sorted((s, round(x / norm, 5)) for s, x in rows), [round(float(x), 5) for v in shapes for x in (v > 0.05, v > 0.2, v > 0.5, v)]


def test_text_features_equal_plain_ones(monkeypatch):
    texts = [None, "", " \n ", "a b a", "  lead 12 3a ?! Été, ÉTÉ x.y 漢字 '7", "word " * 3000, "x" * 100_000, "a b a", *((WORDS + " ") * 3 + str(i) for i in range(20))]
    for most in (4 << 20, 50):
        monkeypatch.setattr(cotrain, "TEXT_BYTES", most)
        rows, start = cotrain.text_features(pa.array(texts)), 0
        slots, weights = (x.to_pylist() for x in rows.binaries())
        for i, (text, end) in enumerate(zip(texts, rows.ends, strict=True)):
            own, last = slice(start, end - 40), slice(end - 40, end)
            words, shapes = plain_features(text)
            got = sorted((int(s), float(w)) for s, w in zip(rows.slots[own], rows.weights[own], strict=True))
            assert [s for s, _ in got] == [s for s, _ in words] and np.allclose([w for _, w in got], [w for _, w in words], atol=1e-4)
            assert np.allclose(rows.weights[last], shapes, atol=1e-4)
            assert np.frombuffer(slots[i], np.int16).tolist() == rows.slots[start:end].tolist() and np.frombuffer(weights[i], np.float32).tolist() == rows.weights[start:end].tolist()
            start = end
    assert cotrain.text_features(pa.array([], pa.string())).ends.tolist() == []


def test_packing(spark, texts):
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    library = bpe.vocabulary(path).library
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), path).collect()
    own = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        piece = own[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(own[r["doc_id"]])
    for i, ids in own.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(map(len, own.values())) > 0.9 * 2048 * len(by_sequence)
    assert packing.pack(empty(spark), path).count() == 0 and packing.pack(edge(spark), path).where("start = 0").count() == 10


def _roots(n, pairs):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_equals_brute_force(spark, texts):
    texts = sorted(texts)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    def slow(t):
        h = simhash.shingle_hashes(t, 3)
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [slow(t) for _, t in texts]
    top = _roots(len(texts), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    for (i, _), f, k in zip(texts, fps, top, strict=True):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{f:016x}", texts[k][0])
    edges = simhash.near_duplicates(edge(spark)).collect()
    assert len(edges) == 10 and {r["component_id"] for r in edges if r["doc_id"] in (1, 2, 3)} == {1} and simhash.near_duplicates(empty(spark)).count() == 0


def _variants(n, seed=5):
    """Groups of near copies, some chained, some alike but under the similarity."""
    random, out = np.random.default_rng(seed), []
    for g in range(3):
        base = [f"{w}{random.integers(900)}" for w in random.choice(WORDS.split(), 150)]
        for _ in range(n):
            words = list(base)
            for k in random.choice(150, random.integers(0, 7), replace=False):
                words[k] = f"x{random.integers(10**6)}"
            out.append(" ".join(words))
    return list(enumerate(out)) + [(10_000, None), (10_001, " ")]


@pytest.mark.parametrize("block", [512, 8])
def test_dedupe_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rows = _variants(60)
    sets = [{*simhash.shingle_hashes(t, 5)} for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if not sets[i] and not sets[j] or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {rows[k][0] for k in _roots(len(rows), pairs)}
    found = simhash.dedupe(docs(spark, rows))
    assert {r["doc_id"] for r in found.collect()} == want and found.columns == docs(spark, []).columns
    assert simhash.dedupe(empty(spark)).count() == 0
    assert sorted(str(r["doc_id"]) for r in simhash.dedupe(edge(spark)).collect()) == ["1", "4", "6", "7", "None"]
    clash = docs(spark, rows).withColumns({"row": F.lit(1), "fp": F.lit("a"), "best": F.lit(2), "m": F.create_map(F.lit("k"), F.lit(1))})
    assert {r["doc_id"] for r in simhash.dedupe(clash).collect()} == want and simhash.dedupe(clash).columns == clash.columns


def test_dedupe_of_repeated_and_null_ids(spark):
    """Nodes are texts: unlike texts under one id both stay, and null ids take part."""
    one, two, three = (" ".join(f"{w}{k}" for w in WORDS.split() for _ in range(2)) for k in "abc")
    rows = [(1, one), (1, two), (1, one), (2, one.upper()), (None, two), (None, three), (None, three), (3, three + " end")]
    got = sorted((str(r["doc_id"]), r["text"][:6]) for r in simhash.dedupe(docs(spark, rows)).collect())
    assert got == [("1", one[:6]), ("1", two[:6]), ("3", three[:6])]
    assert simhash.dedupe(docs(spark, [("x", "a")][:0])).count() == 0


def test_dedupe_of_repeated_lines(spark):
    body, line = " ".join(f"u{i}" for i in range(400)), "the same line once more"
    texts = [(i, "\n".join([body] + [line] * n)) for i, n in enumerate((1, 20, 40))]
    assert [r["doc_id"] for r in simhash.dedupe(docs(spark, texts)).collect()] == [0]


def test_tiles_skip_and_keep(spark):
    random = np.random.default_rng(3)
    base = random.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    near = base ^ (np.int64(1) << random.integers(0, 63, 300))
    values = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(v), [int(v)]) for v in values], "node long, fp array<bigint>")
    far = simhash.distances(values.view(np.uint64)[:, None], values.view(np.uint64)[:, None])
    want = _roots(len(values), [(i, j) for i, j in zip(*np.nonzero(np.triu(far <= 2, 1)), strict=True)])
    for blocks, tile in ((4, 4), (1, 50)):
        at = {r["node"]: r["component"] for r in components(simhash.links(df, 2, 1, blocks, tile)).collect()}
        assert [at.get(int(v), int(v)) for v in values] == [int(values[k]) for k in want]


def test_warc_parts(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 200, 9), (2, None, "x" * 200, 9), (3, "http://b/ c", None, 9), (4, "u", "é", 9), (None, "u", "x" * 200, 9), (1, "http://a/", "x" * 200, 9)], "page_id long, url string, html string, digest int")
    got = sorted(((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages, f"file://{tmp_path}/w").collect()), key=str)
    assert got == [("1", 200, "response", None), ("1", 200, "response", None), ("2", 200, "revisit", 1), ("3", 0, "response", None), ("4", 2, "response", None), ("None", 200, "revisit", 1)]
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    one = warc.record(1, "u", b"ab\r\n\r\n", "d", None, "response")
    assert [*warc.records_of(iter([one[:7], one[7:] + one[:30], one[30:]]))] == [one, one]
    with pytest.raises(ValueError):
        list(warc.records_of(iter([one[:-9]])))


def test_revisits_by_filter(spark, monkeypatch):
    """Many repeated payloads: by broadcast, by filter and join, and with hot digests the same decisions; a long payload survives."""
    rows = [(i, "u", f"{'x' * 100}{i % 400 if i % 3 else 7}", i) for i in range(3000)] + [(3000 + i, "u", f"{'y' * 120}{i}", i) for i in range(500)] + [(9000, "u", "z" * 3_000_000, 0), (9001, None, None, 1), (9002, "u", "short", 1), (9003, "u", "short", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    decided = lambda: sorted((r["page_id"], -1 if r["refers_to"] is None else r["refers_to"], r["record_type"]) for r in warc.with_revisits(pages).select("page_id", "refers_to", "record_type").collect())
    want = decided()
    seen = {}
    for i, _, html_, _ in rows:
        seen.setdefault(html_, i)
    assert want == [(i, seen[h] if h and len(h) >= 100 and seen[h] != i else -1, "revisit" if h and len(h) >= 100 and seen[h] != i else "response") for i, _, h, _ in rows]
    monkeypatch.setattr(warc, "MOST_TWICE", 0)
    assert decided() == want
    from mailsieve.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    assert decided() == want
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    assert got[9000]["payload_bytes"] == 3_000_000 and len(got) == len(rows)


def test_main_text():
    page = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy now and save a lot of money today.</div><article><h1>Title &amp; more</h1><p>First  line\nof text. ' + "It goes on for a while with many words in it. " * 4 + '<p>Second.</article><section class="comments"><p>I do not agree with this at all.</p></section><footer>All rights reserved</footer></body>'
    got = html.main_text(page).split("\n\n")
    assert got[0] == "Title & more" and got[1].startswith("First line of text.") and got[2] == "Second." and len(got) == 3
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ""


def test_main_text_of_unclosed_and_wrapped_pages():
    long = "The council met on Tuesday to decide how the old bridge over the river should be repaired before the winter. " * 3
    body = f"<article><h1>Bridge repairs</h1><p>{long}</p><p>{long}</p></article>"
    want = html.main_text(f"<html><head><title>T</title></head><body>{body}</body></html>")
    assert want.count("Tuesday") == 6
    pages = [
        f"<html><head><title>T</title><body>{body}", f"<head><script>var x = '<head>';</script></head><body>{body}", f"<head><meta charset=utf-8><title>T</title>{body}",
        f"<body><form id=aspnetForm action=/><nav><a href=/>Home</a></nav><main>{body}</main></form>", f"<body><form>{body}</form>",
        *(f"<body><div><{tag}></div>{body}" for tag in ("button", "select", "svg", "object", "map")),
        *(f"<body><div><{tag}></div>{body}<div><{tag}></{tag}></div>" for tag in ("button", "select", "svg", "object", "map")),
        f"<body><svg><style>a:after {{ content: '<svg>' }}</style></svg>{body}",
    ]
    assert [html.main_text(p) for p in pages] == [want] * len(pages)
    plain = f"<p>{long}</p><p>{long}</p>"
    assert html.main_text(f"<body><form><div>{plain}</div></form>") == html.main_text(f"<body><div><div>{plain}</div></div>") == f"{long}\n\n{long}".replace(" \n", "\n").strip()
    hidden = "<form><p>Subscribe to our newsletter and get the best stories every week in your mail.</p></form><select><option>One</select><button>Go <div>now</div></button>"
    assert html.main_text(f"<body>{body}{hidden}") == want


def test_main_text_of_pages_with_telling_names():
    """Names of parts beside the text may stand on the whole page, the article or a wrapper of it."""
    long = "The council met on Tuesday to decide how the old bridge over the river should be repaired before the winter. " * 3
    body = f"<h1>Bridge repairs</h1><p>{long}</p><p>{long}</p>"
    first, last = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News and events</a></li></ul></nav>", "<footer>Copyright 2020 The Paper. All rights reserved.</footer>"
    want = "\n\n".join(["Bridge repairs", long.strip(), long.strip()])
    for page in (
        f'<body class="single comments-open">{first}<article>{body}</article>{last}', f'{first}<article class="post comments-closed">{body}</article>{last}', f"<form id=f>{first}<article>{body}</article>{last}</form>",
        f'{first}<div class="responses-to-war">{body}</div>{last}', f'{first}<div id="legal-news">{body}</div>{last}', f'{first}<div class="discussion"><article>{body}</article></div>{last}',
        f'{first}<article>{body}</article><section class="comments"><h3>Comments</h3><p>{long * 4}</p><p>I agree.</p></section>{last}', f'{first}<article>{body}<div class="ad">Buy two pairs of shoes and get the third one free today.</div></article>{last}',
    ):
        assert html.main_text(page) == want, page[:80]
    assert html.main_text(f'<div class="page with-sidebar"><p>{long}</p><p>{long}</p></div>') == "\n\n".join([long.strip()] * 2)
    assert html.main_text("<article><h1>Sums</h1><p>Here <math><mi>x</mi></math> is <object>a number</object> of things that we count.</p></article>") == "Sums\n\nHere x is a number of things that we count."


def test_main_text_is_linear():
    for page in ("<a" * 500_000, "<div>" * 100_000 + "</p>" * 100_000, "<nav>" * 50_000 + "x", "<form>" * 50_000 + "</form>" * 50_000, '<a href="' * 100_000, "<svg>" * 50_000, "<!" * 500_000):
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 10, page[:20]


def test_block_tree_uses_its_features():
    """Held-out made pages; without a group of features the tree gets worse."""
    x, y = html.labelled_table()
    rows, labels = html.labelled_table(80, 99)
    def accuracy(drop):
        own = [k for k in range(x.shape[1]) if k not in drop]
        tree = grow(x[:, own], y, depth=10, least=5)
        return np.mean([decide(tree, r) == bool(v) for r, v in zip(rows[:, own], labels, strict=True)])

    whole = accuracy(())
    assert whole > 0.98 and accuracy(range(6)) < whole - 0.01 and accuracy((6, 7)) < whole and accuracy((8, 9, 10)) < whole - 0.1


def _article(page):
    """The blocks of <article>, by a plain cut at the tags that the pages table has."""
    inside = page.split("<article>", 1)[1].split("</article>")[0] if page and "<article>" in page else ""
    found = [" ".join(entities.unescape(re.sub("</?(?:b|a)(?: [^>]*)?>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inside)]
    return "\n\n".join(x for x in found if x)


def test_main_text_equals_a_plain_cut(spark):
    for sf in (SF, SF.replace("0.001", "0.1")):
        pages = spark.read.parquet(f"{sf}/pages.parquet")
        want = {r["page_id"]: _article(r["html"]) for r in pages.collect()}
        got = {r["page_id"]: r for r in html.extract(pages).collect()}
        assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_main_text_edges(spark):
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, "v", "<p>" + "word " * 300_000, 3)], "page_id long, url string, html string, text int")
    assert sorted(r["n_chars"] for r in html.extract(odd).collect()) == [0, 0, 0, 1_499_999]
    assert html.extract(odd.limit(0)).count() == 0


def _recall(ids, data, found):
    """Share of the true 10 nearest of all ids divisible by 100 that were found; also holds ranks and distances against brute force."""
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((data - data[ids == q][0]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, far)) if ids[k] != q][:10]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, len(order) + 1)) and all(np.isclose(s, far[ids == v][0], rtol=1e-12) for _, v, s in own)
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        hit, total = hit + len({v for _, v, _ in own} & {*ids[order]}), total + len(order)
    return hit / total


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_neighbours_recall(spark, sf):
    folder = SF.replace("0.001", sf)
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"] is not None]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    assert _recall(np.array([i for i, _ in rows]), np.stack([v for _, v in rows]), queries.op10_neighbours(spark, folder)) >= 0.9


def test_neighbours_of_two_levels(spark, monkeypatch):
    """Lists under upper centres, several blocks and chunks a list, clustered vectors and a third of them equal."""
    for name, value in (("SAMPLE", 512), ("BLOCK", 64), ("CHUNK", 8), ("BOUND_ROWS", 64)):
        monkeypatch.setattr(ann, name, value)
    r = np.random.default_rng(8)
    data = np.concatenate([r.normal(size=(40, 24))[r.integers(0, 40, 4000)] + 0.3 * r.normal(size=(4000, 24)), np.ones((2000, 24))])
    ids = r.permutation(6000)
    table = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, data)], "vec_id long, embedding array<double>")
    assert _recall(ids, data, ann.nearest(table)) >= 0.9


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(7), "row": F.lit("x"), "vec": F.lit(None)})
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 5, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 5, 1.0)]
    assert ann.nearest(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [5.0, 0.0]), (7, [9.0, 0.0]), (7, [9.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(twice).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 1, 4.0), (3, 7, 8.0), (4, 7, 8.0)]


BRITISH = {"license": "licence", "sublicense": "sublicence", "authorized": "authorised", "acknowledgment": "acknowledgement"}


def _forms(text, width):
    """A licence as people keep it: under a copyright line, wrapped, in capitals, with British spellings, inside a document."""
    wrapped = "\n\n".join(textwrap.fill(" ".join(x.split()), width) for x in text.split("\n") if x.strip())
    whole = f"Copyright (c) 2020 Someone, Inc. All rights reserved.\n\n{wrapped}"
    british = re.sub(r"\w+", lambda m: BRITISH.get(m[0], m[0]), whole)
    return [(whole, True), (whole.upper(), True), (british, True), (f"Some words first.\n{whole}\nThe end.", False)]


def test_licences_in_all_forms(spark):
    rows = [(licence, form, whole) for licence, text in licences.TEXTS for width in range(40, 101, 6) for form, whole in _forms(text, width)]
    one = "Copyright (c) 2020 X. " + " ".join(licences.TEXTS[0][1].split())
    rows += [("MIT", x, True) for x in (one, textwrap.fill(one, 60))]
    rows += [(x, f"A page.\n{line}\nMore.", False) for x, line in (("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-2.0", "Released under the GPLv2!"), ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0"), ("Apache-2.0", "  SPDX-License-Identifier: Apache-2.0"))]
    for licence, name in (("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("LGPL-2.1", "LGPL-2.1")):
        if (path := Path("/usr/share/common-licenses", name)).exists():
            rows += [(licence, path.read_text().upper(), True), (licence, f"First.\n{path.read_text()}\nLast.", False)]
    got = {r["doc_id"]: r for r in licences.scan(docs(spark, [(i, x) for i, (_, x, _) in enumerate(rows)])).collect()}
    assert [i for i, (x, _, whole) in enumerate(rows) if got[i]["licence"] != (x if whole else None) or x not in got[i]["notices"]] == []
    assert not {*licences.SPELLINGS.values()} & {*licences.SPELLINGS}


def test_licence_edges(spark):
    for text in ("Copyright holders are named below, in the software.", "THE SOFTWARE IS PROVIDED AS IS", None, ""):
        row = licences.scan(docs(spark, [(1, text)])).first()
        assert row["licence"] is None and row["notices"] == []
    digest = lambda t: licences.scan(docs(spark, [(1, t)])).first()["digest"]
    assert digest("a\ncopyright notice b") != digest("a") == digest("Copyright 2001 Y\n A!") == digest("(c) 1999 Z\na")
    assert licences.scan(empty(spark)).count() == 0 and licences.scan(edge(spark)).count() == 10
    own = licences.known_texts(spark, [("own", "these very words")])
    assert licences.scan(docs(spark, [(1, "These VERY words.")]), own).first()["licence"] == "own"


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "packing"]
    before = spark.read.parquet(f"{SF}/documents.parquet")
    step = before
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, step, SF).checkpoint()
        assert after.columns == before.columns and 0 < after.count() <= step.count() and after.join(step, "doc_id", "left_anti").count() == 0
        step = after
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in step.select("doc_id").collect()}
    assert got.agg(F.sum("length")).first()[0] == got.dropDuplicates(["doc_id"]).agg(F.sum("doc_tokens")).first()[0]


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, clashing names, and empty tables."""
    odd = edge(spark).withColumns({"rejected_by": F.lit("a"), "view": F.lit(1), "row": F.lit(None).cast("int"), "ids_crc32": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        kept, none = stage(spark, odd, SF), stage(spark, odd.limit(0), SF)
        assert none.count() == 0 and kept.columns == none.columns, name
        if name != "packing":
            assert kept.columns == odd.columns and kept.count() <= 10
        else:
            assert kept.where("start = 0").count() == 10


def test_runs_of_one_word_lines_are_fast():
    """A million lines of a word list that mentions software once: only runs near it are hashed."""
    known = licences.FULL
    counts, digests = np.unique([n for _, _, n in known]), {d: licence for licence, d, _ in known}
    lines = [f"w{i}" for i in range(1_000_000)]
    lines[500_000] = "software"
    began = time.perf_counter()
    assert licences.runs(lines, digests, counts) == [] and time.perf_counter() - began < 10
    text = ["this work is free", "software for all"]
    digest = hashlib.sha256(" ".join(text).encode()).hexdigest()
    assert licences.runs(["x", *text, "y"], {digest: "own"}, np.array([7])) == ["own"]


def test_copies_of_a_row_are_ranked_in_parts(spark):
    """One row many times over: parts hold about equally many, and all pieces fit."""
    rows = docs(spark, [(1, "same words again")]).crossJoin(spark.range(3000).select())
    got = packing.pack(rows, bpe.vocabulary_path("byte_bpe_50k.json"), deal=500).collect()
    assert len(got) == 3000 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3000 and max(r["offset"] + r["length"] for r in got) <= 2048


def test_checkpoints_go_with_the_driver(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/c").getOrCreate()
from mailsieve.llm.common import cut
cut(spark.range(5)).count()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2], capture_output=True, timeout=200)
    assert not [p for p in tmp_path.rglob("rdd-*")]


def test_whole_pipeline_on_odd_tables(spark, tmp_path):
    """run() as a whole: odd rows, no rows, labels without classes."""
    r = np.random.default_rng(6)
    clean = " ".join(f"{w}," if i % 9 == 8 else w for i, w in enumerate(a + b for a, b in zip(r.choice(WORDS.split(), 300), r.choice(["s", "ed", "ing", "er", ""], 300), strict=True)))
    for name, table in (("odd", edge(spark).union(docs(spark, [(70, clean), (70, clean), (80, clean.upper())]))), ("none", empty(spark))):
        path = f"{tmp_path}/{name}"
        table.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(6, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        with pytest.warns(UserWarning, match="no two classes"):
            got = corpus_pipeline.run(spark, path).collect()
        assert {r["doc_id"] for r in got} == ({70} if name == "odd" else set()) and sum(r["length"] for r in got) == (got[0]["doc_tokens"] if got else 0)


def test_warc_long_payload(spark):
    """Payloads of megabytes, equal ones among them, come back by digest."""
    big = "<p>" + "long text " * 300_000
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, "u", big + "x"), (4, "u", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    assert [got[i]["refers_to"] for i in (1, 2, 3, 4)] == [None, 1, None, None] and got[3]["payload_bytes"] == len(big) + 1
    assert got[2]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest()


def test_components_of_ascending_chains(spark):
    """Each node's only smaller neighbour is the one before it: rounds must not follow the length of the chain."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(39)] + [(101, 100)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(chain, max_rounds=9).collect()} == {**dict.fromkeys(range(40), 0), 100: 100, 101: 100}
