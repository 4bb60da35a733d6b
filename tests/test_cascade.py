"""Retrieval on small packs, the cascade, remote and cached completions, setups and metrics."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from attestra.config import Config
from attestra.functions import lexicon as lx
from attestra.operators.index import Index
from attestra.operators.metrics import metrics, metrics_by_language
from attestra.operators.retrieve import rank, retrieve
from attestra.plans import cascade
from attestra.plans.benchmark import gate_records, gate_sweep, judge_records, raw_stage, run_benchmark
from attestra.plans.cascade import ask
from attestra.plans.service import answer_requests
from attestra.sources import reports
from attestra.sources.cache import COMPLETION, CompletionCache
from attestra.sources.completions import RemoteSource, TableSource
from attestra.sources.files import read_traces

PACK = [
    (0, "DOC_EN_01", "Seed Grant", "Every registered grower gets 6000 rupees of seed grant each spring.", "en"),
    (1, "DOC_HI_01", "बीज भत्ता", "पंजीकृत किसान को हर वसंत में ₹6,000 का बीज भत्ता मिलता है।", "hi"),
    (2, "DOC_MR_01", "बियाणे भत्ता", "नोंदणीकृत शेतकऱ्याला दर वसंतात ६,००० रुपयांचा बियाणे भत्ता मिळतो.", "mr"),
    (3, "DOC_EN_02", "Lamp Rebate", "The rebate pays 90% of a lamp for each village school.", "en"),
    (4, "DOC_MR_02", "दिवा सवलत", "गावातील शाळेला दिव्यासाठी ९०% सवलत मिळते.", "mr"),
]
MODELS = {t: {"nvidia": "small", "openrouter": "small-b"} for t in ("tier1", "judge")}
MODELS["tier2"] = {"nvidia": "large", "openrouter": "large-b"}
KEYS = {"nvidia": "k1", "openrouter": "k2"}
FAST = replace(Config(), requests_per_minute=0, min_score=0.5)
Q = "How much seed grant does a registered grower get?"
GOOD = "Every registered grower gets 6000 rupees of seed grant each spring."


@pytest.fixture(scope="module")
def pack(spark):
    return spark.createDataFrame(PACK, "pos long, id string, title string, text string, lang string")


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "qid long, question string")


def reply(answer, sources=("DOC_EN_01",), refuse=False):
    text = json.dumps({"answer": answer, "sources": list(sources), "refuse": refuse})
    return 200, {"choices": [{"finish_reason": "stop", "message": {"content": text}}]}, None, 0.25


def remote(transport, cfg=FAST, **kw):
    return RemoteSource(MODELS, KEYS, cfg, transport=transport, connections=1, **kw)


def test_top_passages(spark, pack):
    questions = asked(
        spark,
        Q,
        "नोंदणीकृत शेतकऱ्याला किती बियाणे भत्ता मिळते?",
        "किसान को कितना बीज भत्ता मिलता है?",
        "बियाणे भत्ता",
        "the of and",
    )
    rows = {r.qid: r for r in retrieve(questions, pack, replace(Config(), top_k=2)).collect()}
    firsts = [rows[i].retrieved[0].id for i in range(4)]
    assert firsts == ["DOC_EN_01", "DOC_MR_01", "DOC_HI_01", "DOC_MR_01"]
    assert rows[3].candidates == ["hi", "mr"] and rows[3].resolved_lang == "mr"
    assert all(rows[i].top_score > 1.0 and rows[i].precheck_passed for i in range(4))
    # no terms: the pool in pack order with zero scores
    assert [p.id for p in rows[4].retrieved] == ["DOC_EN_01", "DOC_EN_02"]
    assert rows[4].top_score == 0.0 and not rows[4].precheck_passed


def test_fill_fallback_and_empty(spark, pack):
    wide = replace(Config(), top_k=4)
    questions = asked(spark, "lamp rebate", "किसान को कितना भत्ता मिलता है?")
    got = {}
    for r in rank(questions, pack.where("lang <> 'hi'"), wide).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.pos))
    assert sorted(got[0]) == [(1, 3), (2, 0)]
    assert len(got[1]) == 4  # no Hindi passages: all are candidates
    assert rank(questions, pack.limit(0), wide).count() == 0
    empty = retrieve(questions, pack.limit(0)).collect()
    assert [(r.retrieved, r.top_score, r.precheck_passed) for r in empty] == [([], 0.0, False)] * 2
    assert rank(questions.limit(0), pack, wide).count() == 0


def test_index_and_salting_agree(spark, pack, tmp_path):
    questions = asked(spark, Q, "lamp rebate school", "बियाणे भत्ता", "zzz")
    plain = sorted(map(tuple, rank(questions, pack).withColumn("score", F.round("score", 9)).collect()))
    index = Index.build(pack)
    index.save(str(tmp_path / "index"))
    loaded = Index.load(spark, str(tmp_path / "index"))
    for cfg, idx in ((Config(), index), (Config(), loaded), (replace(Config(), broadcast_max_rows=1, salt_blocks=3), None)):
        found = rank(questions, pack, cfg, idx).withColumn("score", F.round("score", 9))
        assert sorted(map(tuple, found.collect())) == plain


def test_precheck_makes_no_calls(spark, pack):
    def forbidden(*args):
        raise RuntimeError("no call expected")

    cfg = replace(FAST, min_score=100.0)
    questions = asked(spark, "Which bridge is the longest of all?", "बियाणे भत्ता")
    rows = sorted(ask(questions, pack, remote(forbidden, cfg), cfg).collect(), key=lambda r: r.qid)
    assert [(r.outcome, r.model_calls, r.escalated) for r in rows] == [("refused", 0, False)] * 2
    assert [r.answer for r in rows] == [lx.SAFE_REFUSALS["en"], lx.SAFE_REFUSALS["mr"]]
    assert rows[1].trace.detected_language == "mr" and rows[0].trace.attempts == []


def test_pass_refuse_escalate_fail(spark, pack):
    def transport(url, payload, key, timeout):
        text = payload["messages"][1]["content"]
        if "refuse me" in text:
            return reply("Sorry, nothing found.", [], True)
        if "always wrong" in text:
            return reply("The grower gets 6000 rupees.", ["DOC_NON_EXISTENT_99"])
        if "first wrong" in text and payload["model"] == "small":
            return reply("Every registered grower gets 15000 rupees.")
        return reply(GOOD)

    questions = asked(spark, Q, f"{Q} refuse me", f"{Q} first wrong", f"{Q} always wrong")
    rows = sorted(ask(questions, pack, remote(transport), FAST).collect(), key=lambda r: r.qid)
    assert [r.outcome for r in rows] == ["passed", "refused", "passed", "failed"]
    assert [r.model_calls for r in rows] == [1, 1, 2, 2]
    assert [r.escalated for r in rows] == [False, False, True, True]
    assert rows[0].sources == ["DOC_EN_01"] and "6000" in rows[0].answer
    assert rows[1].answer == rows[3].answer == lx.SAFE_REFUSALS["en"] and rows[3].sources == []
    assert [a.model for a in rows[2].trace.attempts] == ["small", "large"]
    assert "15000" in rows[2].trace.attempts[0].gate_failures[0]


def test_provider_errors_and_fallback_to_recorded(spark, pack):
    def down(url, payload, key, timeout):
        return 500, None, '{"error": {"message": "Upstream 500"}}', 0.1

    row = ask(asked(spark, Q), pack, remote(down), FAST).first()
    assert row.outcome == "failed" and row.model_calls == 0
    assert "nvidia: HTTP 500: Upstream 500; openrouter: HTTP 500" in row.trace.provider_error
    down_row = answer_requests(asked(spark, Q), pack, remote(down), cfg=FAST).first()
    assert (down_row.status, down_row.outcome, down_row.is_cached_example) == ("ok", "failed", False)


def test_replay_misses_fall_back_to_recorded_runs(spark, pack, tmp_path):
    path, replay = str(tmp_path / "runs.json"), replace(FAST, replay_only=True)
    run = {"question": f" {Q.upper()} ", "answer": "recorded answer", "sources": ["DOC_EN_01"], "outcome": "passed", "escalated": False, "model_calls": 1, "trace": {"x": 1}}
    with open(path, "w") as f:
        json.dump([run, {**run, "answer": "a later run"}], f)
    cache = CompletionCache(spark, str(tmp_path / "cache"))
    requests = asked(spark, f"  {Q}", "  ", "x" * 501, "lamp rebate school?")
    rows = answer_requests(requests, pack, TableSource(cache, MODELS, replay), read_traces(spark, path), replay).collect()
    rows.sort(key=lambda r: r.qid)
    assert rows[0].answer == "recorded answer" and rows[0].is_cached_example and rows[0].notice == lx.FALLBACK_NOTICE
    assert json.loads(rows[0].recorded_trace) == {"x": 1} and rows[0].status == "ok"
    assert rows[1].status == "Question cannot be empty." and rows[2].status.startswith("Question is longer")
    assert (rows[3].status, rows[3].answer) == ("unavailable", None)
    questions = spark.createDataFrame([(0, Q, "en", True)], "qid long, question string, lang string, answerable boolean")
    records = run_benchmark(questions, pack, TableSource(cache, MODELS, replay), replay).records.collect()
    assert {(r.setup, r.outcome) for r in records} == {("raw", "error"), ("llm_judge", "error"), ("gate", "error")}
    assert all("replay only" in r.error_details for r in records)


def test_limits_of_requests(spark, pack, tmp_path):
    rows = [(i, Q, f"2024-01-01 00:00:{i:02d}", "10.0.0.1" if i < 4 else "10.0.0.2", "9.9.9.9, 1.1.1.1") for i in range(6)]
    requests = spark.createDataFrame(rows, "qid long, question string, ts string, peer string, forwarded string").withColumn("ts", F.to_timestamp("ts"))
    cache = CompletionCache(spark, str(tmp_path / "cache"))
    for trust, full in ((False, {2, 3}), (True, {2, 3, 4, 5})):
        cfg = replace(FAST, hits_per_window=2, trust_proxy=trust)
        found = answer_requests(requests, pack, TableSource(cache, MODELS, cfg), cfg=cfg).collect()
        assert {r.qid for r in found if r.status == "window_full"} == full and len(found) == 6


def test_equal_requests_are_asked_once(spark, pack, tmp_path):
    log = tmp_path / "calls"

    def transport(url, payload, key, timeout):
        with open(log, "a") as f:
            f.write("x")
        return reply(GOOD)

    cache = CompletionCache(spark, str(tmp_path / "cache"))
    rows = ask(asked(spark, Q, Q, Q), pack, remote(transport, cache=cache), FAST).collect()
    assert [r.outcome for r in rows] == ["passed"] * 3 and log.read_text() == "x"
    assert cache.entries().count() == 1


def test_remote_retries(spark, pack, tmp_path):
    log = tmp_path / "calls"

    def transport(url, payload, key, timeout):
        with open(log, "a") as f:
            f.write(json.dumps([url.split("/")[2], payload["max_tokens"], "extra_body" in payload]) + "\n")
        calls = len(open(log).readlines())
        if calls == 1:
            return 400, None, "Unrecognized field", 0.0
        if calls == 2:
            return 429, None, "Too many", 0.0
        if calls in (3, 4):
            return 200, {"choices": [{"finish_reason": "length", "message": {"content": "cut"}}]}, None, 0.1
        if "nvidia" in url:
            return 0, None, "timed out", 0.0
        return reply(GOOD)

    cfg = replace(FAST, reasoning_effort="medium")
    cache = CompletionCache(spark, str(tmp_path / "cache"))
    row = ask(asked(spark, Q), pack, remote(transport, cfg, cache=cache), cfg).first()
    assert row.outcome == "passed" and row.trace.attempts[0].provider == "openrouter"
    calls = [json.loads(line) for line in open(log)]
    assert [c[1] for c in calls] == [1024, 1024, 1024, 4096, 1024]
    assert [c[2] for c in calls[:2]] == [True, False]

    def forbidden(*args):
        raise RuntimeError("must be answered from the cache")

    again = ask(asked(spark, Q), pack, remote(forbidden, cfg, cache=cache), cfg).first()
    assert again.answer == row.answer
    replay = replace(FAST, replay_only=True)
    table = TableSource(cache, MODELS, replay)
    assert ask(asked(spark, Q), pack, table, replay).first().outcome == "passed"
    with pytest.raises(Exception, match="replay only"):
        ask(asked(spark, "lamp rebate school?"), pack, table, replay).collect()
    missing = ask(asked(spark, "lamp rebate school?"), pack, TableSource(cache, MODELS, FAST), FAST).first()
    assert missing.trace.provider_error == "no cached completion"
    cache.clear()
    assert cache.entries().count() == 0


def test_cache_write_failures_are_silent(spark):
    rows = spark.createDataFrame(
        [("nvidia", "m", [("user", "hi")], (1024, 42, 0.0), ("t", "nvidia", "m", 1.25, "stop"))],
        f"provider string, model string, messages array<struct<role:string,content:string>>, params struct<max_tokens:int,seed:int,temperature:double>, completion {COMPLETION}",
    )
    broken = CompletionCache(spark, "/proc/nowhere/cache")  # can't be made, and isn't there to read
    assert broken.put(rows) is False and broken.entries().count() == 0


RECORDS = [
    ("gate", "en", True, "passed", ["T01_EN"], ["T01_EN", "T02_EN"], 1, 1.0, False, True),
    ("gate", "en", True, "passed", ["FAKE_99"], ["T01_EN"], 2, 2.0, True, False),
    ("gate", "hi", False, "refused", [], [], 0, 0.1, False, True),
    ("gate", "hi", False, "passed", ["T02_EN"], ["T02_EN"], 1, 0.9, False, False),
]
FIELDS = "setup string, lang string, answerable boolean, outcome string, sources array<string>, retrieved_passage_ids array<string>, model_calls int, latency double, escalated boolean, is_grounded boolean"


def test_metrics(spark):
    records = spark.createDataFrame(RECORDS, FIELDS)
    m = metrics(records, "setup").first()
    assert (m.citation_valid_rate, m.ungrounded_answer_rate) == (0.667, 0.667)
    assert (m.wrong_answer_rate_on_traps, m.correct_refusal_rate_on_traps, m.refusal_rate_on_answerable) == (0.5, 0.5, 0.0)
    assert (m.avg_model_calls, m.avg_extra_model_calls, m.avg_latency, m.escalation_rate) == (1.0, 0.25, 1.0, 0.25)
    rows = {r.lang: r for r in metrics_by_language(records).collect()}
    assert set(rows) == {"all", "en", "hi", "mr"} and rows["mr"].total_questions == 0
    error = spark.createDataFrame([("raw", "en", True, "error", [], [], 0, 0.0, False, False)], FIELDS)
    e = metrics(error, "setup").first()
    assert (e.total_questions, e.valid_questions, e.errors, e.avg_latency) == (1, 0, 1, 0.0)


def test_benchmark_and_reports(spark, pack, tmp_path):
    def transport(url, payload, key, timeout):
        text = payload["messages"][1]["content"]
        if "Candidate Answer:" in text:
            return 200, {"choices": [{"finish_reason": "stop", "message": {"content": '{"grounded": true}'}}]}, None, 0.5
        return reply("The lamp costs 123 rupees." if "lamp" in text.split("Question: ")[1] else GOOD)

    questions = spark.createDataFrame(
        [(0, Q, "en", True), (1, "lamp rebate school", "en", False)],
        "qid long, question string, lang string, answerable boolean",
    )
    result = run_benchmark(questions, pack, remote(transport), FAST, sweep=True)
    rows = {(r.setup, r.lang): r for r in result.metrics.collect()}
    assert rows["raw", "all"].ungrounded_answer_rate == 0.5 and rows["raw", "all"].wrong_answer_rate_on_traps == 1.0
    assert rows["llm_judge", "all"].avg_model_calls == 2.0
    assert rows["gate", "all"].ungrounded_answer_rate == 0.0 and rows["gate", "all"].correct_refusal_rate_on_traps == 1.0
    assert rows["gate", "all"].escalation_rate == 0.5
    text = reports.markdown_report(result)
    assert "| raw | 2 | 0 | 100.0% | 50.0% |" in text and "### Setup: gate" in text and "| 0.40 |" in text
    assert "llm_judge" in reports.console_report(result.metrics)
    reports.write_results(result, str(tmp_path / "out"), questions="2")
    summary = spark.read.json(str(tmp_path / "out" / "summary")).first()
    assert len(summary.summary) == 12 and summary.metadata.questions == "2"
    assert spark.read.json(str(tmp_path / "out" / "details")).count() == 6


def test_sources_that_are_no_list(spark, pack):
    def transport(url, payload, key, timeout):
        given = {"one": None, "two": 7, "three": ["DOC_EN_01"]}[payload["messages"][1]["content"].split()[-1]]
        text = json.dumps({"answer": GOOD, "sources": given, "refuse": False})
        return 200, {"choices": [{"finish_reason": "stop", "message": {"content": text}}]}, None, 0.25

    questions = spark.createDataFrame(
        [(i, f"{Q} {w}", "en", True) for i, w in enumerate(("one", "two", "three"))], "qid long, question string, lang string, answerable boolean"
    )
    records = {r.id: r for r in run_benchmark(questions, pack, remote(transport), FAST, setups=("raw",)).records.collect()}
    assert [records[i].outcome for i in range(3)] == ["error", "error", "passed"]
    assert records[0].error_details == "sources: NoneType is not a list" and records[1].model_calls == 0


def test_recorded_runs(spark, pack, tmp_path):
    questions = asked(spark, Q).withColumn("lang", F.lit("en"))
    answered = ask(questions, pack, remote(lambda *a: reply(GOOD)), FAST)
    runs = reports.recorded_runs(answered)
    assert runs.first().title == "English question: answered and verified"
    assert runs.first().scenario == "The first model's answer passed all checks (calls: 1)."
    assert reports.write_runs(runs, str(tmp_path / "runs")) and not reports.write_runs(runs.limit(0), str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 1


class _Fixed:
    """The same reply to each question and tier, by ``qid``; keeps the requests it gets."""

    def __init__(self, replies):
        self.replies, self.asked = replies, []

    def complete(self, requests, tier):
        self.asked.append((tier, requests.where("wanted")))
        text = F.lit(None).cast("string")
        for (qid, at), reply in self.replies.items():
            text = F.when((F.col("qid") == qid) & (F.lit(tier) == at), F.lit(reply)).otherwise(text)
        fields = {"text": text, "provider": F.lit("p"), "model": F.lit("m"), "latency": F.lit(1.0), "finish_reason": F.lit("stop")}
        completion = F.struct(*[c.alias(n) for n, c in fields.items()])
        return requests.withColumns({"completion": F.when(F.col("wanted"), completion), "error": F.lit(None).cast("string")})


def test_sweep_asks_once_for_like_failures(spark, pack):
    def told(answer):
        return json.dumps({"answer": answer, "sources": ["DOC_EN_01"], "refuse": False})

    half = "Every registered grower dragons unicorns goblins."
    replies = {(0, "tier1"): "no json", (0, "tier2"): told(half), (1, "tier1"): told(half), (1, "tier2"): told(GOOD)}
    questions = asked(spark, Q, Q + " Tell me.").withColumns({"lang": F.lit("en"), "answerable": F.lit(True)})
    source, retrieved = _Fixed(replies), retrieve(questions, pack, FAST)
    completed = cascade.first_attempt(retrieved, source)
    swept = {r.overlap_threshold: r for r in gate_sweep(completed, source, (0.4, 0.5, 0.6, 0.7)).collect()}
    # one request for the invalid JSON at all thresholds, and one for each threshold the other answer misses
    per_question = {r.qid: r.n for r in source.asked[-1][1].groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert per_question == {0: 1, 1: 2}
    for limit, row in swept.items():
        answered = cascade.resolve(retrieved, _Fixed(replies), replace(FAST, overlap_threshold=limit))
        alone = metrics(gate_records(answered), "setup").first().asDict()
        assert {k: v for k, v in alone.items() if k != "setup"} == {k: v for k, v in row.asDict().items() if k != "overlap_threshold"}


def test_setups_share_what_was_measured(spark, pack):
    """The judge's audit and the gate use the measures of the raw audit; without them, and with unread sources, they agree."""
    told = {"answer": GOOD, "sources": ["DOC_EN_01"], "refuse": False}
    replies = {(0, "tier1"): json.dumps(told), (1, "tier1"): json.dumps({**told, "sources": 7}), (2, "tier1"): json.dumps({**told, "refuse": True})}
    replies |= {(q, "judge"): '{"grounded": true}' for q in range(3)} | {(1, "tier2"): json.dumps(told)}
    questions = asked(spark, Q, Q + " Tell me.", Q + " Now.").withColumns({"lang": F.lit("en"), "answerable": F.lit(True)})
    source = _Fixed(replies)
    completed = cascade.first_attempt(retrieve(questions, pack, FAST), source)
    raw = raw_stage(completed)

    def gated(frame):
        done = cascade.second_attempt(cascade.attempt_one(frame, 0.6), source, 0.6)
        return {r.id: r for r in gate_records(cascade.decide(done)).collect()}

    fresh = gated(completed)
    assert gated(raw) == fresh and [fresh[q].outcome for q in range(3)] == ["passed", "passed", "refused"]
    altered = raw.withColumn(cascade.MEASURED, F.col(cascade.MEASURED).withField("overlap", F.lit(0.125).cast("double")))
    assert gated(altered)[0].model_calls == 2 and fresh[0].model_calls == 1
    judged = [{r.id: r for r in judge_records(f, source).collect()} for f in (raw, altered)]
    assert [j[0].is_grounded for j in judged] == [True, False]
    assert [judged[0][q].outcome for q in range(3)] == ["passed", "error", "refused"]
