"""What passes through: ids, other columns, bytes, requests under way, kept answers."""

import re
import threading
import time
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailsieve.functions import normalize, rx
from mailsieve.operators import agents, score
from mailsieve.operators.agents import Transient, ask, llm_flow
from mailsieve.operators.preprocess import preprocess
from mailsieve.plans.queries import QUERIES, Echo
from mailsieve.plans.router import OWN, extract
from mailsieve.sources import readers
from mailsieve.sources.answers import Answers
from mailsieve.sources.history import History
from mailsieve.sources.providers import Chat, retry_after
from mailsieve.sources.readers import eml_files, spread, text_files
from mailsieve.streaming.events import agent_events

BIG = 9007199254740993


def rows(spark):
    data = [(BIG, "Hello there.\n\nMore", {"a": 1}, Decimal("1.10"), bytearray(b"\x00\xff")), (None, "Second", None, None, None), (BIG + 1, None, {}, Decimal("-2.00"), bytearray())]
    return spark.createDataFrame(data, "id long, content string, m map<string,long>, d decimal(20,2), b binary").coalesce(1)


def test_other_columns_pass_as_they_are(spark):
    df = rows(spark)
    want = sorted(map(str, df.select("id", "m", "d", "b").collect()))
    for got in (llm_flow(df, Echo, "content"), extract(df, "llm", provider=Echo), extract(df, "auto", provider=Echo)):
        assert sorted(map(str, got.select("id", "m", "d", "b").collect())) == want
    assert {r["id"] for r in agent_events(df, Echo, "id").collect()} == {BIG, None, BIG + 1}


@pytest.mark.parametrize("name", ["confidence", "metadata", "success", "Latest_Message", "__mode", "llm_text", "text", "__raw"])
def test_clashing_columns_are_errors(spark, name):
    with pytest.raises(ValueError, match="already"):
        extract(rows(spark).withColumn(name, F.lit(1)), "auto", provider=Echo)
    assert name.lower() in (*OWN, "text", "__raw")


def test_files_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"ab\xff\xfecd")
    assert text_files(spark, str(tmp_path)).first()["content"] == "ab��cd"
    (tmp_path / "a.eml").write_bytes("Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\nCafé au lait, s'il vous plaît.".encode("latin-1"))
    assert preprocess(eml_files(spark, str(tmp_path)), eml="is_eml").first()["text"] == "Café au lait, s'il vous plaît."
    nested = (
        b"MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: multipart/alternative; boundary=i\n\n"
        b"--i\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\nR3LDvMOfZQ==\n--i\nContent-Type: text/html; charset=windows-1252\nContent-Transfer-Encoding: quoted-printable\n\n"
        b"<p>Gr=FC=DFe</p>\n--i--\n--o\nContent-Type: text/plain\n\nlater\n--o--\n"
    )
    df = spark.createDataFrame([(1, nested, True), (2, b"plain \xe9", False), (3, None, True), (4, b"Content-Type: text/plain\n\n\xff", True)], "id int, content binary, is_eml boolean")
    got = {r["id"]: r["text"] for r in preprocess(df, eml="is_eml").collect()}
    assert got == {1: "Grüße", 2: "plain �", 3: "", 4: "�"}


class Slow(Echo):
    """Answers after a while, and counts who asks at once."""

    lock, now, most, calls = threading.Lock(), 0, 0, 0

    def invoke(self, prompt, system_message):
        with Slow.lock:
            Slow.now, Slow.calls = Slow.now + 1, Slow.calls + 1
            Slow.most = max(Slow.most, Slow.now)
        time.sleep(0.02)
        with Slow.lock:
            Slow.now -= 1
        return super().invoke(prompt, system_message)


def test_requests_under_way(spark):
    df = spark.createDataFrame([(i, f"Message {i}") for i in range(80)], "id int, text string").coalesce(1)
    spent = {}
    for n in (1, 8):
        began = time.perf_counter()
        got = llm_flow(df, Slow, in_flight=n).collect()
        spent[n] = time.perf_counter() - began
        assert [(r["id"], r["llm_text"]) for r in got] == [(i, f"Message {i}") for i in range(80)]
    assert spent[8] < spent[1] / 3


def test_pace_and_retry_after():
    now, waited = [0.0], []
    pace = agents.Pace(10, clock=lambda: now[0], wait=waited.append)
    for _ in range(4):
        pace()
    assert [round(x, 6) for x in waited] == [0.1, 0.2, 0.3]

    class Busy(Echo):
        left = 2

        def invoke(self, prompt, system_message):
            Busy.left -= 1
            if Busy.left >= 0:
                raise Transient("busy", after=7.5 if Busy.left else None)
            return super().invoke(prompt, system_message)

    waits = []
    assert "a" in ask(Busy(), "cleanup", "a", waits.append) and waits == [7.5, 2.0]


def test_answers_are_asked_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    class Counted(Echo):
        def invoke(self, prompt, system_message):
            (log / f"{time.time_ns()}-{threading.get_ident()}").touch()
            return super().invoke(prompt, system_message)

    df = spark.createDataFrame([(BIG, "Same text"), (None, "Same text"), (3, "Other"), (4, None)], "id long, content string")
    kept = Answers(spark, f"{tmp_path}/answers", model="m")
    got = extract(df, "llm", provider=Counted, answers=kept)
    first = sorted(map(str, got.collect()))
    assert len([*log.iterdir()]) == 2 * 4  # four requests for each of two texts; the empty one is an error before
    assert sorted(map(str, got.collect())) == first and sorted(map(str, extract(df, "llm", provider=Counted, answers=kept).collect())) == first
    assert len([*log.iterdir()]) == 2 * 4
    plain = extract(df, "llm", provider=Echo)
    assert sorted(map(str, plain.collect())) == first

    def broken():
        raise OSError("down")

    other = Answers(spark, f"{tmp_path}/more")
    assert {r["error"] for r in extract(df, "llm", provider=broken, answers=other).collect()} == {"no answer", "Empty content after preprocessing"} and other.load().count() == 0


def test_spread_goes_by_splits(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).repartition(1).write.parquet(f"{tmp_path}/one")
    spark.range(1000).repartition(2 * cores).write.parquet(f"{tmp_path}/many")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(spread(spark.read.parquet(f"{tmp_path}/one")))
    old = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert "Repartition" not in plan(spread(spark.read.parquet(f"{tmp_path}/one"))) and "Repartition" not in plan(spread(spark.read.parquet(f"{tmp_path}/many")))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[1])


def test_history_of_a_stream(spark, tmp_path):
    """A batch that is played again adds nothing; ids stay; compaction keeps the newest; a failing save only warns."""
    (tmp_path / "in").mkdir()
    kept = History(spark, f"{tmp_path}/h")
    save = kept.sink()

    def twice(batch, number):
        save(batch, number)
        save(batch, number)

    for k in range(3):
        spark.createDataFrame([(f"Message {k} is here.\nAnd {i}.",) for i in range(4)], "content string").select("content", F.col("content").alias("raw")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("content string, raw string").parquet(f"{tmp_path}/in")
        extract(stream, "non_llm").writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    rows = kept.load().collect()
    assert len(rows) == 12 and len({r["id"] for r in rows}) == 12
    batch = extract(spark.createDataFrame([("Once more.", "Once more.")], "content string, raw string"), "non_llm")
    save(batch, 7)
    save(batch, 7)
    assert kept.load().count() == 13
    kept.compact(5)
    assert kept.load().count() == 5 and "Once more." in {r["latest_message"] for r in kept.load().collect()}
    kept.save(batch)
    assert kept.load().count() == 6
    with pytest.warns(UserWarning, match="not saved"):
        assert kept.try_save(batch, content="nowhere") is False
    kept.clear()
    assert kept.load().count() == 0


def test_a_service_says_when_to_come_back():
    """Over a socket: busy with a Retry-After, then down, then the answer; other refusals aren't tried again."""
    replies = [(429, "0.25"), (503, None), (200, None), (401, None)]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            code, after = replies.pop(0)
            self.send_response(code)
            if after:
                self.send_header("Retry-After", after)
            self.end_headers()
            if code == 200:
                self.wfile.write(b'{"choices": [{"message": {"content": "fine"}}]}')

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        chat, waits = Chat("own", "m", "k", f"http://127.0.0.1:{server.server_port}/"), []
        assert ask(chat, "cleanup", "text", waits.append) == "fine" and waits == [0.25, 2.0]
        with pytest.raises(RuntimeError, match="401"):
            ask(chat, "cleanup", "text", waits.append)
    finally:
        server.shutdown()
    assert retry_after("Thu, 01 Jan 1970 00:01:40 GMT", now=lambda: 40.0) == 60.0 and retry_after("soon") is None and retry_after("-3") == 0.0 and retry_after("1e9") == 120.0


def test_cheaper_counts_are_exact(spark):
    """Words, special signs, stripping and line guards on odd white space, accents and signs, against Python."""
    odd = ["a b\nc\n\nd", "a  b", "a \nb", "a\n b", "a\n\n\nb", "a　b c", "a\x1cb\x85c\xa0d", "x", "###€ a×b é́ 名_١ \U0001f600%", "?!?\n\n\n\n!", " \x1f a b  \n", "a​b ᠎ c"]
    space = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
    t = F.col("t")
    special = F.length(F.regexp_replace(F.regexp_replace(t, f"[{score.PLAIN}]++", ""), score.OTHERS, ""))
    df = spark.createDataFrame([(x,) for x in odd], "t string").select("t", rx.strip(t).alias("s"), rx.words(rx.strip(t)).alias("w"), special.alias("n"), F.regexp_count(t, F.lit(rx.java(score.SPECIAL))).alias("m"), score.counts(t, score.QUALITY).alias("q"))
    for r in df.collect():
        x = r["t"].strip(space)
        assert r["s"] == x and r["w"] == len(re.findall(f"[^{space}]+", x)) and r["n"] == r["m"], r
        assert r["q"][1] == r["t"].count("\n\n") and r["q"][3] == r["t"].count("?") + r["t"].count("!"), r


@pytest.mark.parametrize("name", ["html_tree_text", "agent_traces", "extract_event_errors", "agent_event_rows", "extract_llm"])
def test_queries_hold_small_batches(spark, name):
    """Whatever the session had before: a worker gets few rows at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_large_batches_are_cut(spark):
    """The agents' operators make pieces of a session's large batches; rows, order and columns stay."""
    batch = pa.record_batch({"a": list(range(1203))})
    cut = [*readers.slices(iter([batch, batch.slice(0, 0), batch.slice(5, 2)]))]
    assert [b.num_rows for b in cut] == [500, 500, 203, 2] and sum((b.column(0).to_pylist() for b in cut), []) == [*range(1203), 5, 6]


@pytest.mark.parametrize("text", ["", "a b\nc\n\nd", " a", "a ", "\na", "a\n", "a  b", "a \nb", "a\n b", "a\n\n\nb", "a\tb", "a\x00b", "a\xa0b", "a　b", "é", "a\x85b", "a\r\nb"])
def test_loose_texts(spark, text):
    old = r"[\x00\t\x0b-\r\x1c-\x1f\x85\p{Z}&&[^ ]]| [ \n]|\n |\n{3}|\A[ \n]|[ \n]\z"
    r = spark.range(1).select(F.lit(text).rlike(normalize.LOOSE).alias("a"), F.lit(text).rlike(old).alias("b")).first()
    assert r["a"] == r["b"]
