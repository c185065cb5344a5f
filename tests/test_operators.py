import duckdb
import pytest
from pyspark.sql import functions as F

from mailsieve.operators import disclaimer, html, mime, preprocess, reply, score, signature
from mailsieve.operators.agents import ASK, Transient, flow, llm_flow, parse_confidence, parse_text, parse_validation
from mailsieve.plans.pipeline import REPLIES, column_step, run_pipeline
from mailsieve.plans.queries import QUERIES, SQL, Echo
from mailsieve.plans.router import extract
from mailsieve.sources.history import History
from mailsieve.sources.providers import NotConfigured, azure_url, provider, providers_df, resolve
from mailsieve.sources.readers import requests, text_files
from mailsieve.sources.threads import as_eml
from mailsieve.streaming.events import agent_events, deterministic_events


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def clean(spark, text, **more):
    return run_pipeline(spark.createDataFrame([(text,)], "text string"), **more).first()


@pytest.mark.parametrize("text, out", [
    ("Dinner on Tuesday is fine.\n\nOn Monday\nBob wrote:\n> ok", "Dinner \n> ok"),
    ("nothing here on Monday", "nothing here on Monday"),
    ("ON X WROTE: tail on y", " tail on y"),
])
def test_attributions(spark, text, out):
    assert one(spark, preprocess.strip_attributions, text) == out


def test_preprocess_cases(spark):
    rows = [(1, "a\r\n\r\n\r\n\r\nb\x00 \t c\r"), (2, None), (3, " \n "), (4, "é"), (5, "<div>Hi <b>Bob</b>,<!-- x -->ok<script>var a</script></div>"), (6, "Hello\n\nDISCLAIMER: none of this\ncounts\n\nBye"), (7, "<p>x")]
    got = {r["id"]: r for r in preprocess.preprocess(spark.createDataFrame(rows, "id int, content string")).collect()}
    assert [got[i]["text"] for i in range(1, 8)] == ["a\n\nb c", "", "", "é", "Hi Bob ,ok", "Hello\n\nBye", "<p>x"]
    assert [got[i]["error"] for i in (1, 2, 3)] == [None, preprocess.EMPTY, preprocess.EMPTY]


def test_eml(spark):
    assert mime.bodies("Content-Type: text/plain; charset=nope\n\nhé") == ("hé", None)
    two = "MIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=b\n\n--b\nContent-Type: text/plain\n\nplain\n--b\nContent-Type: text/html\n\n<p>rich</p>\n--b--\n"
    df = spark.createDataFrame([(1, two, True), (2, "just text", False), (3, None, True)], "id int, content string, is_eml boolean")
    got = {r["id"]: r["text"] for r in preprocess.preprocess(df, eml="is_eml").collect()}
    assert got == {1: "rich", 2: "just text", 3: ""}
    row = spark.range(1).select(mime.mime_bodies(as_eml(F.lit("body"))).alias("m")).first()["m"]
    assert row["text"].strip() == "body" and row["html"] is None


def test_html_quotes():
    assert html.parse('<div>new</div><div class="gmail_quote">old<p>x</div><blockquote class="reply-1">old</blockquote>end')[0] == "new end"
    assert html.parse("<p>a<p>b<br>c&amp;d")[0] == "a b c&d"
    assert html.parse("")[0] == ""


def test_references_without_semicolon(spark, tmp_path):
    """Plain text in html_tree_plain, as in its SQL; references in the tree, as in HTML."""
    same = [(1, "<h1>a &amp; b&amp</h1><p>&am</p>&copy;&amp;&amp"), (2, "AT&T & Co &copy; &middot;&quot;&#39;&"), (3, None)]
    spark.createDataFrame(same, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.sql(SQL["html_tree_plain"]).project("page_id, text").fetchall())
    got = {r["page_id"]: r["text"] for r in QUERIES["html_tree_plain"](spark, str(tmp_path)).collect()}
    assert got == want and got[1] == "a & b&amp &am ©&&amp"
    tree = {r["page_id"]: r["text"] for r in QUERIES["html_tree_text"](spark, str(tmp_path)).collect()}
    assert tree[1] == "a & b& &am ©&&" and tree[3] is None


@pytest.mark.parametrize("text, kept", [
    ("Fine.\n\nOn Mon, 3 Mar 2025, Ann wrote:\n> old text", "Fine."), ("Hi\n> quoted\n\nrest", "Hi\n\n> quoted\n\nrest"), ("one\ntwo", "one\ntwo"), ("> all\n> quoted", ""), ("", ""),
])
def test_visible_fragments(spark, text, kept):
    assert one(spark, reply.visible_fragments, text) == kept


def test_reply_steps(spark):
    assert one(spark, reply.without_quoted_lines, "a\n > q\n\n\nb\n\nc") == "a\nb\n\nc"
    assert one(spark, reply.without_reply_headers, "x\nFrom: a\nSent: b\nTo: c\nSubject: d\nrest") == "x\n\nrest"
    assert one(spark, reply.without_reply_headers, "a\n-----\nb") == "ab"
    row = clean(spark, "Sure, works.\n\nOn Mon, 3 Mar 2025, Ann wrote:\n> Are you free?\n> Ann")
    assert row["text"] == "Sure, works." and row["steps_executed"] == ["reply_removal", "confidence_scoring"]


@pytest.mark.parametrize("text, body", [
    ("We can start on Friday then.\n\nBest regards,\nIda", "We can start on Friday then."), ("See you there.\n--\nBob\nBoss", "See you there."), ("Ok then.\nSent from my iPhone", "Ok then."),
    ("Only one line here", "Only one line here"), ("All good.\nThanks,\nCarol", "All good."),
])
def test_signatures(spark, text, body):
    row = clean(spark, text)
    assert row["text"] == body and ("signature_removal" in row["steps_executed"]) == (text != body)


def test_signature_patterns(spark):
    assert one(spark, signature.cut_at_lines, "a\n—\nb") == "a"
    assert one(spark, signature.cut_at_lines, "a\nCheers\nlower") == "a\nCheers\nlower"
    assert one(spark, signature.cut_at_lines, "a\nGet Outlook for iOS\nb") == "a"
    assert one(spark, signature.cut_at_pattern, "a\nTel: +1 555\nb") == "a"


def test_disclaimers(spark):
    assert one(spark, disclaimer.by_position, "body\n----------\nnote\n\nWARNING: x") == "body"
    assert one(spark, disclaimer.by_position, "😀ab\n\nDISCLAIMER: x") == "😀ab"
    assert one(spark, disclaimer.by_phrase, "a\n\nIf you have received this email, go.\n\nb") == "a\n\nb"
    assert one(spark, disclaimer.by_position, "no header") == "no header"


@pytest.mark.parametrize("text, value, sure", [("OK", 0.675, False), ("Fine by me, we meet near gate 7.", 0.82, False), ("Hello, that is a short note from me.", 0.838, False), ("", 0.0, False), (None, 0.0, False)])
def test_score(spark, text, value, sure):
    row = score.score(spark.createDataFrame([(text,)], "text string")).first()
    assert row["score"] == value and row["is_reliable"] is sure


def test_score_guards_and_clashes(spark):
    """A guard never hides a match; a table with a result's name is an error, as long as no prefix is given."""
    for text in ("see HTTP://a.b", "a@b.org <i>", "> q", "FORWARDED BY me", "-- ORIGINAL MESSAGE", "  SENT FROM MY phone", "Confidential. Disclaimer? NOTICE!", "a\n\nb", "hey. Dear all, good morning", "thanks, best regards. Cheers! sincerely yours, thank you"):
        row = spark.createDataFrame([(text,)], "t string").select(score.counts(F.col("t"), score.NOISE + score.QUALITY).alias("a"), score.counts(F.col("t"), score.NOISE + score.QUALITY, F.lower("t")).alias("b")).first()
        assert row["a"] == row["b"] and sum(row["a"]) > 0, text
    own = spark.createDataFrame([("a", 1)], "text string, score int")
    with pytest.raises(ValueError):
        score.score(own)
    assert score.score(own, prefix="x_").columns[:3] == ["text", "score", "x_score"]


def test_thresholds_and_injection(spark):
    assert clean(spark, "OK", threshold=0.0)["is_reliable"] and not clean(spark, "OK", threshold=1.0)["is_reliable"] and not clean(spark, " ", threshold=0.0)["is_reliable"]
    row = clean(spark, "abc", steps=[REPLIES, column_step("upper", F.upper)])
    assert row["text"] == "ABC" and row["steps_executed"] == ["upper", "confidence_scoring"]


def test_long_and_empty_tables(spark):
    assert clean(spark, "on " * 20_000)["score"] > 0
    empty = spark.createDataFrame([], "content string, extra int")
    assert extract(empty, "auto").count() == 0 and deterministic_events(spark.createDataFrame([], "doc_id long, content string")).count() == 0


def test_agents():
    assert parse_text('```json\n{"extracted_message": "x"}\n```', "extracted_message") == "x" and parse_text(" raw ", "a") == "raw"
    assert parse_validation("this is invalid")["is_valid"] is False and parse_validation('{"is_valid": true}')["is_valid"]
    assert [parse_confidence(x) for x in ('{"confidence_score": 0.7}', "85", "0,5", "none", "9 out of 10")] == [0.7, 0.85, 0.5, 0.5, 0.09]

    class Never:
        calls = 0

        def invoke(self, prompt, system_message):
            self.calls += 1
            raise Transient("busy")

    own = Never()
    got = flow(own, "text", wait=lambda s: None)
    assert got["llm_text"] == "text" and got["llm_confidence"] == 0.5 and own.calls == 12 and [t["success"] for t in got["llm_trace"]] == [False, False, True, True]

    class Doubtful(Echo):
        def invoke(self, prompt, system_message):
            return "invalid" if "is_valid" in system_message else super().invoke(prompt, system_message)

    assert flow(Doubtful(), "a")["llm_iterations"] == 2


def broken():
    raise ValueError("no key")


def test_router(spark):
    long = "This is the answer. It is short, and we have all that we need to go on. Would you like to see it? Hello and thanks! It was a good day."
    df = spark.createDataFrame([(1, "OK", "auto", 7), (2, long, "auto", 8), (3, " ", "auto", 9), (4, "x", "llm", 1), (5, "x", "odd", 2), (6, "OK", "non_llm", 3), (7, "OK", None, 4)], "id int, content string, mode string, score_ int")
    got = {r["id"]: r for r in extract(df, None, provider=Echo).collect()}
    assert [got[i]["flow_used"] for i in range(1, 8)] == ["llm (auto mode)", "non_llm (auto mode)", "", "llm", "", "non_llm", "llm (auto mode)"]
    assert (got[1]["metadata"]["non_llm_fallback"]["non_llm_text"], got[1]["metadata"]["non_llm_fallback"]["non_llm_confidence"]) == ("OK", 0.675) and got[2]["metadata"]["non_llm_fallback"] is None is got[4]["metadata"]["non_llm_fallback"]
    assert [got[i]["success"] for i in range(1, 8)] == [True, True, False, True, False, True, True] and got[5]["error"] == "Unknown mode: odd"
    got = {r["id"]: r for r in extract(df, None, provider=broken).collect()}
    assert got[1]["flow_used"] == "non_llm (auto mode, llm failed)" and got[1]["success"] and not got[4]["success"] and got[4]["error"] == "no key"
    assert llm_flow(df.select(F.col("content").alias("text")), Echo).where("llm_text is null").count() == 0


def test_history(spark, tmp_path):
    kept = History(spark, f"{tmp_path}/h")
    assert kept.load().count() == 0
    df = spark.createDataFrame([(f"Message {i} is here.\nYes",) for i in range(5)], "content string").select("content", F.col("content").alias("raw"))
    kept.save(extract(df, "non_llm"), content="raw")
    got = kept.load(3).collect()
    assert len(got) == 3 and all(len(r["id"]) == 8 and "\n" not in r["content_preview"] for r in got)
    kept.clear()
    assert kept.load().count() == 0


def test_providers(spark):
    assert resolve("Azure-OpenAI") == "azure_openai" and azure_url("https://a.com/") == "https://a.com/openai/v1/" and azure_url("https://a.com/openai/v1/") == "https://a.com/openai/v1/"
    with pytest.raises(ValueError):
        resolve("x")
    with pytest.raises(NotConfigured):
        provider("openai", env={})
    assert providers_df(spark, env={"GEMINI_API_KEY": "k"}).where("is_default").first()["name"] == "gemini"


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"content": "a"}\n{"content": "b", "mode": "llm", "is_eml": true}\n')
    assert [tuple(r) for r in requests(spark, f"{tmp_path}/r.json").orderBy("content").collect()] == [("a", "auto", None, False), ("b", "llm", None, True)]
    (tmp_path / "t.txt").write_text("whole\nfile")
    assert text_files(spark, f"{tmp_path}/t.txt").first()["content"] == "whole\nfile"


def test_events(spark):
    df = spark.createDataFrame([(1, "Hello there friend"), (2, "")], "doc_id long, content string")
    got = sorted((r["doc_id"], r["seq"], r["type"]) for r in deterministic_events(df).collect())
    assert got == [(1, 0, "start"), (1, 1, "token"), (1, 2, "done"), (2, 0, "error")]
    kinds = [r["type"] for r in sorted(agent_events(df, Echo).where("doc_id = 1").collect(), key=lambda r: r["seq"])]
    assert kinds == ["start", "token", "token", "token", "agent_done", "start", "agent_done", "start", "agent_done", "done"]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"Hello {i}.\n\nOn Mon, 3 Mar 2025, Ann wrote:\n> x") for i in range(20)], "doc_id long, content string")
    df.write.parquet(f"{tmp_path}/in")
    stream = extract(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "auto")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
    pick = lambda d: sorted((r["doc_id"], r["latest_message"], r["confidence"]) for r in d.collect())
    assert pick(spark.read.parquet(f"{tmp_path}/out")) == pick(extract(df, "auto"))


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame([(i, f"Text {i}. Thanks,\nBob{i}\n") for i in range(30)], "doc_id long, content string")
    pick = lambda n: sorted((r["doc_id"], r["latest_message"]) for r in extract(df.repartition(n), "non_llm").collect())
    assert pick(1) == pick(7)


def test_sequential_agents_hand_the_fix_on():
    class Strict:
        def invoke(self, prompt, system_message):
            text = prompt.partition("\n\n")[2]
            return {"extraction": text, "cleanup": text, "validation": '{"is_valid": false, "suggested_fix": "shorter"}', "confidence": "0.4"}[next(k for k, v in ASK.items() if prompt.startswith(v))]

    graph, sequential = flow(Strict(), "Hello"), flow(Strict(), "Hello", strategy="sequential")
    assert (graph["llm_text"], graph["llm_iterations"]) == ("Hello", 2)
    assert (sequential["llm_text"], sequential["llm_iterations"]) == ("Hello" + "\n\n[Fix needed: shorter]" * 3, 3)
    assert [t["agent"] for t in sequential["llm_trace"]] == ["extraction", *["cleanup", "validation"] * 3, "confidence"]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="Unknown strategy"):
        llm_flow(spark.range(1).selectExpr("'x' text"), lambda: None, strategy="other")


def test_steps_with_udfs(spark):
    """A UDF may stand before and behind the steps of columns."""
    upper = column_step("upper", F.pandas_udf(lambda s: s.str.upper(), "string"))
    text = "Héllo there.\n\nOn Mon, 3 Mar 2025, Ann wrote:\n> old"
    for steps in ([REPLIES, upper], [upper, REPLIES]):
        assert clean(spark, text, steps=steps)["text"] == "HÉLLO THERE."
