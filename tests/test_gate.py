"""Contract parsing and the grounding checks on literal cases."""

import json
import time

import pytest
from pyspark.sql import functions as F

from attestra.functions import contract as ct
from attestra.operators import gate

EN = "Every registered grower gets a seed grant of 6,000 rupees each spring, paid as three parts of 2,000 rupees."
MR = "नोंदणीकृत शेतकऱ्यांना दर वसंतात ६,००० रुपये बियाणे भत्ता मिळतो, प्रत्येकी २,००० रुपयांचे तीन भाग."
PACK = [
    {"rank": 1, "pos": 1, "id": "DOC_EN_01", "lang": "en", "title": "Seed Grant", "text": EN},
    {"rank": 2, "pos": 2, "id": "DOC_MR_01", "lang": "mr", "title": "बियाणे भत्ता", "text": MR},
]
SCHEMA = "raw_output string, question string, retrieved array<struct<rank:int,pos:long,id:string,lang:string,title:string,text:string>>"


def verify(spark, *cases, **kw):
    rows = [(c if isinstance(c, str) else json.dumps(c, ensure_ascii=False), q, PACK) for c, q in cases]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    return [r.gate for r in gate.verify(df, **kw).select("gate").collect()]


def completion(answer, sources=("DOC_EN_01",), refuse=False):
    return {"answer": answer, "sources": list(sources), "refuse": refuse}


GOOD = "A registered grower gets 6000 rupees of seed grant each spring season."
Q = "What does a registered grower get?"


def test_clean_answer_passes(spark):
    (g,) = verify(spark, (completion(GOOD), Q))
    assert g.passed and g.outcome == "passed" and g.failures == []
    assert all(g.checks.asDict().values())
    assert g.details.token_overlap_ratio >= 0.6 and g.details.ungrounded_numbers == []


def test_parsing_variants(spark):
    body = json.dumps(completion(GOOD))
    fenced = f"```json\n{body}\n```"
    wrapped = f"Here you are:\n{body}\nHope it helps."
    plain_fence = f"  ```\n{body}\n```\n"
    for g in verify(spark, (fenced, Q), (wrapped, Q), (plain_fence, Q), (f"[{body}]", Q)):
        assert g.outcome == "passed"
    broken = [f"{body} {body}", "no json", "[1, 2]", '"text"', "{'answer': 1}", "", "{", body + "}"]
    for g in verify(spark, *[(b, Q) for b in broken]):
        assert g.outcome == "failed" and g.failures[0].startswith("Invalid JSON")
        assert not any(g.checks.asDict().values()) and g.details.error


def test_contract_types(spark):
    text, number, source, null, missing = verify(
        spark,
        ({**completion(GOOD), "refuse": "false"}, Q),
        ({**completion(GOOD), "answer": 6000}, Q),
        ({**completion(GOOD), "sources": [123, "DOC_EN_01"]}, Q),
        ({"answer": None, "sources": None, "refuse": None}, Q),
        ({"answer": "x", "sources": []}, Q),
    )
    assert text.failures == [
        "Contract field 'refuse' must be a boolean (True/False), got str (value: 'false')."
    ]
    assert number.failures == ["Contract field 'answer' must be str, got int."]
    assert source.failures == ["Contract field 'sources' must be a list of strings, got list."]
    assert [f.split(", got ")[1] for f in null.failures] == ["NoneType.", "NoneType.", "NoneType (value: None)."]
    assert "missing required" in missing.failures[0]
    assert all(g.outcome == "failed" and not g.checks.json_valid for g in (text, number, source, null, missing))


def test_citations(spark):
    fake, none, blank, mixed = verify(
        spark,
        (completion(GOOD, ["DOC_EN_01", "DOC_UNKNOWN_99", "A_1"]), Q),
        (completion(GOOD, []), Q),
        (completion(GOOD, [" ", ""]), Q),
        (completion(GOOD, [" DOC_EN_01 ", ""]), Q),
    )
    assert fake.failures == ["Cited source ID(s) not in retrieved passages: ['A_1', 'DOC_UNKNOWN_99']."]
    assert none.failures[0] == "Answer cites no sources (sources list is empty)."
    assert none.failures[2] == "Token overlap (0.0%) is below threshold (60.0%)."
    assert len(none.failures) == 3 and none.checks.language_match
    assert blank.failures[0] == "Answer contains only empty or whitespace source citations."
    assert mixed.passed


@pytest.mark.parametrize(
    "answer, cited, loose",
    [
        ("Each part is 2 rupees.", "Each part is 2,000 rupees.", ["2"]),
        ("Half of it, 50 percent.", "The town pays 50% of it.", []),
        ("Growers get 10,000 rupees.", "The grant is 6,000 rupees.", ["10000"]),
        ("त्यांना ६००० रुपये.", "भत्ता ६,००० रुपये.", []),
        ("त्यांना 6000 रुपये.", "भत्ता ६,००० रुपये.", []),
        ("7% then 7 then 8%", "6", ["7%", "7", "8%"]),
        ("no figures", "", []),
    ],
)
def test_numbers_grounded(spark, answer, cited, loose):
    df = spark.createDataFrame([(answer, cited)], "a string, c string")
    assert df.select(gate.ungrounded_numbers(F.col("a"), F.col("c"))).first()[0] == loose


def test_token_overlap(spark):
    passage = "Every registered grower gets 6000 rupees of seed grant each spring."
    good = "A registered grower gets 6000 rupees each spring."
    bad = "Trains leave from the northern platform before noon."
    df = spark.createDataFrame([(0, good, passage), (1, bad, passage), (2, "the", passage), (3, good, "")], "i int, a string, c string")
    ratio = gate.overlap_ratio(gate.content_words(F.col("a")), gate.content_words(F.col("c")))
    got = [r[1] for r in sorted(df.select("i", ratio).collect())]
    assert got[0] >= 0.6 and got[1] < 0.6 and got[2:] == [None, None]


def test_scripts(spark):
    mr_q = "शेतकऱ्यांना किती बियाणे भत्ता मिळतो?"
    same, switched, other = verify(
        spark,
        (completion("शेतकऱ्यांना दर वसंतात ६,००० रुपये मिळतो.", ["DOC_MR_01"]), mr_q),
        (completion(GOOD), mr_q),
        (completion("शेतकऱ्यांना दर वसंतात ६,००० रुपये मिळतो.", ["DOC_MR_01"]), Q),
    )
    assert same.checks.language_match and same.details.question_devanagari_ratio == 1.0
    assert switched.failures == [
        "Question was in Devanagari script (100.0%), but answer is in Latin script (0.0%)."
    ]
    assert other.failures == [
        "Question was in Latin script, but answer is in Devanagari script (100.0%)."
    ]


def test_refusals(spark):
    text = "I cannot answer this question based on the provided sources."
    plain, mismatch = verify(
        spark,
        (completion(text, [], True), "Who pays for the harbour lights?"),
        (completion(text, [], True), "बंदरातील दिवे कोण बसवतो?"),
    )
    for g in (plain, mismatch):
        assert g.passed and g.outcome == "refused" and g.failures == [] and g.checks.refusal_ok
        assert not g.checks.sources_real and not g.checks.numbers_grounded
    assert plain.details.warnings is None
    assert mismatch.details.warnings[0].startswith("Refusal script mismatch")


def test_invented_number_and_threshold(spark):
    answer = "A registered grower gets 15000 rupees each spring."
    (g,) = verify(spark, (completion(answer), Q))
    assert g.outcome == "failed" and not g.checks.numbers_grounded
    assert g.failures == ["Answer contains ungrounded number(s) not found in cited sources: ['15000']"]
    (strict,) = verify(spark, (completion(GOOD), Q), overlap_threshold=0.99)
    assert strict.outcome == "failed" and strict.details.overlap_threshold == 0.99


def test_lenient_reads(spark):
    cases = [
        ('{"refuse": "false", "answer": 5, "sources": [1, null, "a"]}', True, "5", ["1", "None", "a"]),
        ('{"refuse": "", "answer": null}', False, "None", []),
        ('{"refuse": 0, "answer": true, "sources": "ab"}', False, "True", []),
        ('{"refuse": [], "sources": []}', False, "", []),
        ('{"refuse": [0], "answer": "x"}', True, "x", []),
        ('{"refuse": true}', True, "", []),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    df = df.withColumn("d", ct.parse_object(F.col("raw")))
    rows = df.select("i", ct.truthy(F.col("d"), "refuse"), ct.lenient_text(F.col("d"), "answer"), ct.lenient_list(F.col("d"), "sources")).collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == [c[1:] for c in cases]


def test_prompts(spark):
    df = spark.createDataFrame([("raw", Q, PACK)], SCHEMA)
    row = df.select(
        ct.format_context(F.col("retrieved")).alias("context"),
        ct.answer_messages(F.col("question"), F.col("retrieved")).alias("ask"),
        ct.escalation_messages(
            F.col("question"), F.col("retrieved"), F.col("raw_output"), F.array(F.lit("one"), F.lit("two"))
        ).alias("again"),
        ct.format_context(F.slice("retrieved", 1, 0)).alias("nothing"),
        ct.safe_refusal(F.lit("MR")).alias("mr"),
        ct.safe_refusal(F.lit("fr")).alias("other"),
    ).first()
    assert row.context == f"[DOC_EN_01] Seed Grant\n{EN}\n\n[DOC_MR_01] बियाणे भत्ता\n{MR}"
    assert row.ask[1].content == f"Reference Context:\n{row.context}\n\nQuestion: {Q}"
    assert "Verification failures identified:\n- one\n- two\n\nCorrection" in row.again[1].content
    assert row.nothing == "No reference passages available."
    assert row.mr.startswith("उपलब्ध") and row.other.startswith("I cannot")


def test_quoted_lists(spark):
    from attestra.functions.contract import quoted_list

    for items in (["a", "b"], ["it's", 'say "x"'], ["both ' and \"", "back\\slash"], []):
        df = spark.createDataFrame([(items,)], "v array<string>")
        assert df.select(quoted_list(F.col("v")).alias("q")).first().q == str(items)


def test_known_numbers_are_read_once(spark):
    """The numbers of the cited text are bound outside of the filter, which would read the text again for each number."""
    rows = spark.createDataFrame([("7 and 8, 9%", "8 of 9"), ("5", None), (None, "5")], "a string, c string")
    loose = rows.select(gate.ungrounded_numbers(F.col("a"), F.col("c")).alias("loose"))
    assert [r.loose for r in loose.collect()] == [["7"], ["5"], []]
    plan = loose._jdf.queryExecution().analyzed().toString()
    assert "array_contains(lambda" in plan and "array_contains(transform" not in plan


def test_open_braces_without_end(spark):
    """One look at each brace: the text was searched again from each of them to its end."""
    many = "{" * 300_000
    rows = spark.createDataFrame([(many,), ("a } " + many + "}b",), (None,), ("```json\n{}\n```",)], "raw string").coalesce(1)
    began = time.monotonic()
    found = [r.s for r in rows.select(ct.json_slice(F.col("raw")).alias("s")).collect()]
    assert found == [many, many + "}", None, "{}"]
    assert time.monotonic() - began < 30


def test_json_text_is_stripped_once(spark):
    plan = spark.createDataFrame([("{}",)], "raw string").select(ct.json_slice(F.col("raw")).alias("s"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("trim(raw") == 1


def test_measures_are_used_again(spark):
    """A second verification gives the same with the measures of the first, for equal and for other citations."""
    answers = [completion(GOOD), completion(GOOD, ("DOC_MR_01",)), completion("Grants of 2,000 and 77."), "no json"]
    rows = [(json.dumps(a, ensure_ascii=False), json.dumps(b, ensure_ascii=False), Q, PACK) for a in answers for b in answers]
    df = spark.createDataFrame(rows, SCHEMA.replace("raw_output", "one string, two")).coalesce(1)
    first = gate.verify(df, raw="one", output="g1", carry="seen")
    both = gate.verify(gate.verify(first, raw="two", output="again", reuse="seen"), raw="two", output="fresh")
    assert all(r.again == r.fresh for r in both.select("again", "fresh").collect())


def test_an_answer_kept_word_for_word_is_not_measured_again(spark):
    kept, other = completion(GOOD), completion("Grants of 2,000 and 77.")
    rows = [(json.dumps(kept), json.dumps(two), Q, PACK) for two in (kept, other)]
    df = spark.createDataFrame(rows, SCHEMA.replace("raw_output", "one string, two")).coalesce(1)
    first = gate.verify(df, raw="one", output="g1", carry="seen")
    told = first.withColumn("seen", F.col("seen").withField("overlap", F.lit(0.125).cast("double")))
    again = gate.verify(told, raw="two", output="g2", reuse="seen").select("g2.details.token_overlap_ratio").collect()
    fresh = gate.verify(first, raw="two", output="g2").select("g2.details.token_overlap_ratio").collect()
    assert again[0][0] == 0.125 != fresh[0][0] and again[1] == fresh[1]


def test_levels_with_like_failures(spark):
    levels = (0.2, 0.5, 1.0)
    rows = [(json.dumps(completion("Grower dragons")), Q, PACK), ("no json", Q, PACK), (json.dumps(completion("Dragons")), Q, PACK)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    spread = gate.verify(df, F.get("l", F.lit(0)), levels=("l", levels)).select("l", "gate.outcome").collect()
    assert [(r.l, r.outcome) for r in spread] == [
        ([0.2, 0.5], "passed"), ([1.0], "failed"), (list(levels), "failed"), ([0.2], "failed"), ([0.5], "failed"), ([1.0], "failed"),
    ]
