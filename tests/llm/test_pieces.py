import hashlib
import random
import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F

from mailsieve.llm import pieces
from mailsieve.llm.bpe import vocabulary_path
from tests.conftest import SF
from tests.llm.test_llm import edge, empty

MODEL = "piece_bpe_32k.model"
ODD = [
    "", " ", "  a  b ", "Hello  world\n\tx", "a\xa0b", "ﬁ ½ Å", "▁x", "a▁ b▁▁c ", "<s> hi</s><unk>", "\x00a", "a\r\nb", "ｆｕｌｌ", "<0x41>", "漢字 😀 é", "x" * 500 + " " * 40 + "y", "..." * 300,
    "が が ​ ​ b", "① ¨ \xad⁠end ", " 　 mid　 ", "é" * 99 + "é", "a​", "​ a",
]


def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def same_as_library(path, texts):
    other, own = library(path), pieces.PieceEncoder(pieces.PieceModel(path))
    for text in texts:
        want = other.encode(text, add_bos=True, add_eos=True)
        raw, decoded = own.encode(text)
        ids, spans = own.spans(text)
        assert ids == want and [*struct.unpack(f"<{len(raw) // 4}I", raw)] == want and decoded == other.decode(want), text
        assert spans[1:-1] == [(p.begin, p.end) for p in other.encode(text, return_type="proto").pieces], text


def field(number, value):
    def count(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return count(number << 3 | 2) + count(len(value)) + value if isinstance(value, bytes) else count(number << 3) + count(value)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_pieces_equal_library(texts):
    same_as_library(vocabulary_path(MODEL), ODD + [t for _, t in texts if t][:60])


@pytest.mark.parametrize("rule, dummy, squeeze, fallback", [("nmt_nfkc", 1, 1, 1), ("nmt_nfkc", 0, 1, 0), ("nfkc_cf", 1, 0, 0), ("identity", 1, 1, 0), ("identity", 0, 0, 1)])
def test_character_maps_equal_library(tmp_path, texts, rule, dummy, squeeze, fallback):
    """The public pieces under the compiled maps that come with the library: ids, decoded text and byte spans."""
    with open(vocabulary_path(MODEL), "rb") as f:
        spec = [*pieces.fields(f.read())]
    compiled = dict(pieces.fields(dict(pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3])).get(2, b"")
    rules = field(1, rule.encode()) + (field(2, compiled) if compiled else b"") + field(3, dummy) + field(4, squeeze) + field(5, 1)
    trainer = next(v for n, v in spec if n == 2) + field(35, fallback)
    path = str(tmp_path / "m.model")
    plain = lambda v: v if fallback or dict(pieces.fields(v)).get(3) != pieces.BYTE else field(1, dict(pieces.fields(v))[1] + b"-") + field(2, 0)
    with open(path, "wb") as f:
        f.write(b"".join(field(n, {2: trainer, 3: rules}.get(n, plain(v) if n == 1 else v)) for n, v in spec if fallback or n != 1 or dict(pieces.fields(v)).get(3) != pieces.BYTE))
    same_as_library(path, ODD + [t for _, t in texts if t][:20])


def test_op11_equals_library(spark, texts):
    path = vocabulary_path(MODEL)
    other = library(path)
    for df, rows in ((spark.read.parquet(f"{SF}/documents.parquet"), texts), (edge(spark), [(r["doc_id"], r["text"]) for r in edge(spark).collect()])):
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.encode_pieces(df, path, digests=True).collect())
        want = []
        for i, t in rows:
            ids = other.encode(t or "", add_bos=True, add_eos=True)
            want.append((str(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(other.decode(ids).encode()).hexdigest()))
        assert got == sorted(want)
    assert pieces.encode_pieces(empty(spark), path).count() == 0


def test_op11_projects_every_text(spark, texts):
    """The query's spans are the library's, of texts looked up chunk by chunk as of whole ones."""
    other, rows = library(vocabulary_path(MODEL)), [(i, t) for i, t in enumerate(ODD + [t for _, t in texts if t][:60])]
    want = {}
    for i, t in rows:
        spans = [(p.begin, p.end) for p in other.encode(t, return_type="proto").pieces]
        flat = [0, 0, *[x for s in spans for x in s], *[len(t.encode())] * 2]
        want[i] = hashlib.sha256(struct.pack(f"<{len(flat)}I", *flat)).hexdigest()
    got = pieces.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary_path(MODEL), digests=True)
    assert {r["doc_id"]: r["spans_sha256"] for r in got.collect()} == want


def test_chunks_whose_first_character_goes_are_whole_texts(tmp_path):
    """A rule that deletes spaces moves the end of the piece before them."""
    model = pieces.PieceModel(vocabulary_path(MODEL))
    own, plain = pieces.PieceEncoder(model), model.normalise

    def without_spaces(text, first=True, last=True):
        shown, source = plain(text, first, last)
        kept = [i for i, c in enumerate(shown) if c != pieces.SPACE or i == 0 and first]
        return "".join(shown[i] for i in kept), [*[source[i] for i in kept], source[len(shown)]]

    model.normalise = without_spaces
    cut = own.spans("ab cd  ef")
    model.cuttable = False
    assert cut == pieces.PieceEncoder(model).spans("ab cd  ef")


def test_plain_texts_are_normalised_whole_and_words_merged_once():
    """Marks and digits after a word make no new work: one pass of normalising a text, and each word is merged once."""
    model = pieces.PieceModel(vocabulary_path(MODEL))
    own, calls = pieces.PieceEncoder(model), []
    for name in ("normalise", "merged"):
        setattr(model, name, lambda *a, name=name, f=getattr(model, name): (calls.append(name), f(*a))[1])
    words, marks = ["anin", "thblesh", "ñieí", "Öung", "шипка"], [",", ".", "!!", "7", "42", "\n", "漢"]
    text = " ".join(w + m for m in marks for w in words)
    for t in (text, text):
        own.encode(t)
    assert calls.count("normalise") == 2 and calls.count("merged") <= len(words) + len({c for m in marks for c in m}) + 1


def test_mixed_signs_equal_library():
    signs, draw = [*" ▁\n\t\r.,!!--——'’“0189abceéñßAБгыј漢字ال😀\x00═\u0301\xa0", "the", "ing ", " of", "  "], random.Random(5)
    same_as_library(vocabulary_path(MODEL), ["".join(draw.choices(signs, k=draw.randint(0, 200))) for _ in range(1000)])


def test_bytes_that_are_no_characters():
    model = pieces.PieceModel(vocabulary_path(MODEL))
    a, other = model.ids["▁the"], library(vocabulary_path(MODEL))
    for raw in (b"\xc3", b"\xc3\xa9", b"\xe2\x82", b"\xff\x41\xf0\x9f\x98\x80\x80"):
        for ids in ([*map(model.bytes.get, raw)], [a, *map(model.bytes.get, raw), a], [model.begin, *[a] * 60, *map(model.bytes.get, raw), a, model.end]):
            assert model.decode(pieces.np.array(ids)) == other.decode(ids), ids


def test_spans_cover_the_text(spark):
    rows = pieces.encode_pieces(edge(spark), vocabulary_path(MODEL)).join(edge(spark).select("doc_id", "text").distinct(), "doc_id").where(F.length("text") > 0).collect()
    assert len(rows) == 7
    for r in rows:
        raw = r["text"].encode()
        assert b"".join(raw[a:b] for a, b in zip(r["starts"], r["ends"], strict=True)) == raw and len(r["ids"]) == r["n_tokens"] == len(r["starts"])


def test_long_texts_are_linear():
    own = pieces.encoder(vocabulary_path(MODEL))
    for text in ("the" * 300_000, "a" * 1_000_000, " " * 500_000, "é漢" * 200_000):
        raw, decoded = own.encode(text)
        assert decoded == text and len(raw) > 8


def test_other_models_are_errors(tmp_path):
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(field(1, field(1, b"<unk>") + field(3, 2)) + field(2, field(3, 1)) + field(3, b""))
    with pytest.raises(ValueError, match="byte-pair"):
        pieces.PieceModel(path)
