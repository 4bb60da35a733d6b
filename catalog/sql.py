"""DuckDB expressions the oracle queries are composed of."""

from __future__ import annotations

from collections.abc import Callable

from attestra.functions import lexicon as lx
from attestra.operators.index import POOLS


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "(" + ", ".join(quote(w) for w in items) + ")"


def array(items: list[str]) -> str:
    return "[" + ", ".join(quote(w) for w in items) + "]"


SP = lx.SPACE.replace(r"\s", r"\s")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: 26 Devanagari consonants standing in for the Latin letters
CONSONANTS = "".join(chr(0x0915 + i) for i in range(26))
#: words of the test texts that stand in for marker words
STAND_INS = [(" the ", " आहे "), (" of ", " के "), (" and ", " शेतकरी "), (" de ", " है ")]


def deva(text: str) -> str:
    """Latin text as Devanagari text."""
    out = f"lower({text})"
    for old, new in STAND_INS:
        out = f"replace({out}, {quote(old)}, {quote(new)})"
    return f"translate({out}, '{LETTERS}0123456789', '{CONSONANTS}{lx.DEVANAGARI_DIGITS}')"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^{SP}+|{SP}+\z', '', 'g')"


def strip_zero_width(text: str) -> str:
    return f"regexp_replace({text}, '[{lx.ZERO_WIDTH}]', '', 'g')"


def ascii_digits(text: str) -> str:
    return f"translate({text}, '{lx.DEVANAGARI_DIGITS}', '0123456789')"


def normalize(text: str) -> str:
    return ascii_digits(strip_zero_width(f"nfc_normalize(coalesce({text}, ''))"))


def raw_tokens(text: str) -> str:
    # two passes remove the commas of neighbouring one-digit groups
    lowered = rf"lower(replace({normalize(text)}, 'İ', ' '))"
    joined = lowered
    for _ in range(2):
        joined = rf"regexp_replace({joined}, '(\p{{Nd}}),(\p{{Nd}})', '\1\2', 'g')"
    return f"regexp_extract_all({joined}, '[ऀ-ॣ०-ॿ]+|[a-z0-9]+')"


def stop(lang: str | None = None, token: str = "t") -> str:
    """Stopword test; ``lang`` is an SQL expression or None for all lists."""
    if lang is None:
        return f"{token} IN {words(lx.STOPWORDS_ANY)}"
    cases = " ".join(
        f"WHEN {lang} = '{code}' THEN {token} IN {words(items)}"
        for code, items in lx.STOPWORDS.items()
    )
    return f"CASE {cases} ELSE {token} IN {words(lx.STOPWORDS_ANY)} END"


def keep(tokens: str, lang: str | None = None) -> str:
    return f"list_filter({tokens}, lambda t: NOT ({stop(lang)}))"


def tokens(text: str, lang: str | None = None) -> str:
    return keep(raw_tokens(text), lang)


def grams(token_list: str) -> str:
    return (
        f"flatten(list_transform({token_list}, lambda w: CASE WHEN length(w) < 3 THEN [w] "
        "ELSE list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)) END))"
    )


def features(token_list: str) -> str:
    return f"list_concat({token_list}, {grams(token_list)})"


def numbers(text: str) -> str:
    marker = rf"(?m)^{SP}*(?:\(?\p{{Nd}}+[.)\-:]|\p{{Nd}}+\.){SP}+"
    body = f"regexp_replace({normalize(text)}, '{marker}', ' ', 'g')"
    pattern = rf"\b{lx.NUMBER_BODY}(?:%\B|\b)"
    found = f"regexp_extract_all({body}, '{pattern}')"
    return f"list_transform({found}, lambda n: replace(n, ',', ''))"


def ratio(text: str) -> str:
    deva_chars = rf"length(regexp_replace({text}, '[^\x{{0900}}-\x{{097f}}]', '', 'g'))"
    letters = rf"length(regexp_replace({text}, '[^\p{{L}}\x{{0900}}-\x{{097f}}]', '', 'g'))"
    return f"coalesce({deva_chars}::DOUBLE / nullif({letters}, 0), 0.0)"


def candidates(text: str) -> str:
    """'en', 'hi', 'mr' or 'hi_mr'."""
    found = raw_tokens(text)

    def hits(markers: list[str]) -> str:
        return f"len(list_intersect(list_distinct({found}), {array(markers)}))"

    mr, hi = hits(lx.MARKERS_MR), hits(lx.MARKERS_HI)
    return (
        f"CASE WHEN {ratio(text)} < 0.25 THEN 'en' WHEN {mr} > {hi} THEN 'mr' "
        f"WHEN {hi} > {mr} THEN 'hi' ELSE 'hi_mr' END"
    )


def exact_round(x: str, digits: int) -> str:
    """Round to nearest by the exact binary value, ties to even (two-double product)."""
    p = f"{10**digits}.0::DOUBLE"
    x = f"({x})::DOUBLE"
    c = f"({x} * 134217729.0::DOUBLE)"
    high = f"({c} - ({c} - {x}))"
    head, tail = f"({high} * {p})", f"(({x} - {high}) * {p})"
    floor = f"floor({head} + {tail})"
    over = f"(({head} - {floor} - 0.5::DOUBLE) + {tail})"
    return (
        f"((CASE WHEN {over} > 0 OR ({over} = 0 AND {floor}::BIGINT % 2 = 1) "
        f"THEN {floor} + 1 ELSE {floor} END) / {p})"
    )


def percent(x: str) -> str:
    return f"printf('%.1f%%', {exact_round(f'({x}) * 100.0::DOUBLE', 1)})"


def quoted_list(items: str) -> str:
    return f"('[''' || array_to_string({items}, ''', ''') || ''']')"


def refusal(lang: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in lx.SAFE_REFUSALS.items())
    return f"CASE lower({lang}) {cases} ELSE {quote(lx.SAFE_REFUSALS['en'])} END"


def bm25(
    docs: str, questions: str, k: int = 3, filter_language: bool = True, k1=1.5, b=0.75
) -> str:
    """CTEs from ``docs(pos, lang, body)`` and ``questions(qid, question)`` to ``ranked``."""
    pools = ", ".join(f"('{pool}', '{g}')" for pool, groups in POOLS.items() for g in groups)
    wanted = "cand" if filter_language else "'all'"
    return f"""
docs AS MATERIALIZED ({docs}),
questions AS MATERIALIZED ({questions}),
pools(pool, grp) AS (VALUES {pools}),
doc_tokens AS MATERIALIZED (
  SELECT pos, CASE WHEN lang IN ('en', 'hi', 'mr') THEN lang ELSE 'other' END AS grp,
         {tokens('body', 'lang')} AS toks FROM docs),
doc_features AS MATERIALIZED (SELECT pos, grp, {features('toks')} AS feats FROM doc_tokens),
doc_terms AS (SELECT pos, grp, len(feats) AS dl, unnest(feats) AS term FROM doc_features),
tf AS MATERIALIZED (SELECT pos, grp, dl, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
stats AS MATERIALIZED (
  SELECT pool, count(*) AS n, sum(len(feats)) / count(*)::DOUBLE AS avgdl
  FROM doc_features JOIN pools USING (grp) GROUP BY pool),
routed AS MATERIALIZED (SELECT qid, question, {candidates('question')} AS cand FROM questions),
asked AS MATERIALIZED (
  SELECT qid, question, cand,
         CASE WHEN {wanted} IN (SELECT pool FROM stats) THEN {wanted} ELSE 'all' END AS pool
  FROM routed),
q_terms AS (
  SELECT qid, pool, unnest({features(tokens('question', 'cand'))}) AS term FROM asked),
qtf AS MATERIALIZED (SELECT qid, pool, term, count(*) AS qtf FROM q_terms GROUP BY ALL),
dfs AS (SELECT pool, term, count(*) AS df FROM tf JOIN pools USING (grp)
        WHERE term IN (SELECT term FROM qtf) GROUP BY ALL),
weights AS (
  SELECT qid, term, pool, n, avgdl, qtf * ln(1.0 + (n - df + 0.5) / (df + 0.5)) AS w
  FROM qtf JOIN dfs USING (pool, term) JOIN stats USING (pool)),
scored AS (
  SELECT qid, pos,
         sum(w * (tf * ({k1} + 1.0)::DOUBLE
             / (tf + {k1}::DOUBLE * ((1.0 - {b})::DOUBLE + {b}::DOUBLE * (dl / avgdl))))) AS score
  FROM weights JOIN pools USING (pool) JOIN tf USING (grp, term) GROUP BY qid, pos),
pairs AS (
  SELECT a.qid, d.pos, coalesce(s.score, 0.0) AS score
  FROM asked a JOIN pools USING (pool) JOIN doc_features d USING (grp)
  LEFT JOIN scored s ON s.qid = a.qid AND s.pos = d.pos),
ranked AS MATERIALIZED (
  SELECT qid, pos, score,
         row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pos) AS rank
  FROM pairs QUALIFY rank <= {k})"""


# ---- completions derived from passages (the same SQL text runs in both engines) ------------
#: the whole text, without what JSON would have to escape
PLAIN = "translate({text}, '\"' || chr(92) || chr(9) || chr(13) || chr(10), '     ')"


def plain(text: str) -> str:
    return PLAIN.format(text=text)


def plain_java(text: str) -> str:
    """``plain`` as Spark runs it: one pass of a character class, as its ``translate`` looks up each character."""
    return rf"""regexp_replace({text}, '["\\\\\\t\\r\\n]', ' ')"""


def case_question(variant: str, text: str, plain: Callable[[str], str] = plain) -> str:
    first = plain(text)
    return f"CASE WHEN {variant} IN (7, 9) THEN {deva(first)} ELSE {first} || '?' END"


def completion(variant: str, text: str, pid: str, plain: Callable[[str], str] = plain) -> str:
    """Completion text: clean or with one of fifteen defects, about the whole text."""
    first = plain(text)

    def body(answer: str, sources: str, refuse: str = "false") -> str:
        return (
            f"'{{\"answer\": \"' || {answer} || '\", \"sources\": ' || {sources} || "
            f"', \"refuse\": {refuse}}}'"
        )

    one = f"'[\"' || {pid} || '\"]'"
    clean = body(first, one)
    variants = [
        clean,
        f"'```json' || chr(10) || {clean} || chr(10) || '```'",
        f"'Here is the answer: ' || {clean} || ' Hope it helps.'",
        body(first, one, '"false"'),
        body(first, f"'[\"' || {pid} || '\", \"FAKE_99\", \"A_1\"]'"),
        body(f"{first} || ' 987,654 units and 5%.'", one),
        body("'Solar panels power rooftop buildings across the state.'", one),
        body("'I cannot answer this.'", "'[]'", "true"),
        body(deva(first), one),
        clean,
        f"'{{\"answer\": \"' || {first} || '\", \"refuse\": false}}'",
        f"'{{\"answer\": 6000, \"sources\": [123, \"' || {pid} || '\"], \"refuse\": null}}'",
        body(first, "'[]'"),
        body(first, "'[\" \", \"\"]'"),
        f"'The answer is ' || {first}",
        f"{clean} || ' ' || {clean}",
    ]
    cases = " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(variants))
    return f"CASE {variant} {cases} END"


#: variant of the second attempt: two defects stay, one turns into a refusal, the rest are cured
SECOND = "CASE WHEN {v} IN (4, 10) THEN {v} WHEN {v} = 12 THEN 7 ELSE 0 END"


def gate(source: str, prefix: str = "g", limit: str = "0.6") -> str:
    """CTEs checking ``source(key, question, raw, ids, texts)``; the last is ``{prefix}_gated``."""
    fence = rf"(?s)\A```(?:json)?{SP}*(.*?){SP}*```(?:\n|\z)"
    p = prefix
    strip_x = strip("x")
    return rf"""
{p}_cut AS (SELECT *, {strip('raw')} AS s FROM {source}),
{p}_inner AS (SELECT *, CASE WHEN regexp_matches(s, '{fence}') THEN regexp_extract(s, '{fence}', 1)
                        ELSE s END AS inside FROM {p}_cut),
{p}_body AS (SELECT *, CASE WHEN regexp_extract(inside, '(?s)\{{.*\}}') <> ''
             THEN regexp_extract(inside, '(?s)\{{.*\}}') ELSE inside END AS body FROM {p}_inner),
{p}_obj AS (SELECT *, CASE WHEN json_valid(body) THEN
              CASE WHEN json_type(body) = 'OBJECT' THEN body END END AS j FROM {p}_body),
{p}_kinds AS (SELECT *, json_type(j, '$.answer') AS ka, json_type(j, '$.sources') AS ks,
                json_type(j, '$.refuse') AS kr,
                len(list_filter(json_extract(j, '$.sources[*]'),
                                lambda e: json_type(e) <> 'VARCHAR')) AS odd FROM {p}_obj),
{p}_contract AS (SELECT *, list_filter(
   CASE WHEN j IS NULL THEN ['Invalid JSON: no JSON object could be parsed']
        WHEN ka IS NULL OR ks IS NULL OR kr IS NULL
        THEN ['JSON missing required contract fields: ''answer'', ''sources'', ''refuse''.']
        ELSE [CASE WHEN ka <> 'VARCHAR' THEN 'Contract field ''answer'' must be str, got int.' END,
              CASE WHEN ks <> 'ARRAY' OR odd > 0
                   THEN 'Contract field ''sources'' must be a list of strings, got list.' END,
              CASE WHEN kr = 'VARCHAR' THEN 'Contract field ''refuse'' must be a boolean (True/False), got str (value: ''' || json_extract_string(j, '$.refuse') || ''').'
                   WHEN kr = 'NULL' THEN 'Contract field ''refuse'' must be a boolean (True/False), got NoneType (value: None).' END]
   END, lambda m: m IS NOT NULL) AS contract FROM {p}_kinds),
{p}_typed AS (SELECT *, len(contract) = 0 AS valid,
   CASE WHEN len(contract) = 0 THEN {strip("json_extract_string(j, '$.answer')")} END AS answer,
   CASE WHEN len(contract) = 0 THEN json_extract_string(j, '$.sources[*]') END AS sources,
   CASE WHEN len(contract) = 0 THEN json_extract_string(j, '$.refuse') = 'true' ELSE false END AS refused
   FROM {p}_contract),
{p}_cited AS (SELECT *,
   list_distinct(list_filter(list_transform(sources, lambda x: {strip_x}), lambda x: x <> '')) AS cited,
   array_to_string(list_filter(list_transform(sources, lambda x:
     CASE WHEN list_contains(ids, {strip_x}) THEN texts[list_position(ids, {strip_x})] END),
     lambda t: t IS NOT NULL), ' ') AS cited_text,
   {ratio('question')} AS q_ratio, {ratio("coalesce(answer, '')")} AS a_ratio FROM {p}_typed),
{p}_words AS (SELECT *,
   list_sort(list_filter(cited, lambda x: NOT list_contains(ids, x))) AS fake,
   list_transform({numbers('cited_text')}, lambda n: trim(n, '%')) AS known_numbers,
   {numbers('answer')} AS answer_numbers,
   list_distinct({tokens('answer')}) AS words, list_distinct({tokens('cited_text')}) AS known
   FROM {p}_cited),
{p}_measured AS (SELECT *,
   list_filter(answer_numbers, lambda n: NOT list_contains(known_numbers, trim(n, '%'))) AS loose,
   coalesce(CASE WHEN len(known) > 0 AND len(words) > 0
            THEN len(list_intersect(words, known))::DOUBLE / len(words) END, 0.0) AS overlap,
   CASE WHEN len(sources) = 0 THEN 'Answer cites no sources (sources list is empty).'
        WHEN len(cited) = 0 THEN 'Answer contains only empty or whitespace source citations.'
        WHEN len(fake) > 0 THEN 'Cited source ID(s) not in retrieved passages: ' || {quoted_list('fake')} || '.'
   END AS source_fault,
   CASE WHEN q_ratio >= 0.30 AND a_ratio < 0.20
        THEN 'Question was in Devanagari script (' || {percent('q_ratio')} || '), but answer is in Latin script (' || {percent('a_ratio')} || ').'
        WHEN q_ratio < 0.30 AND a_ratio >= 0.30
        THEN 'Question was in Latin script, but answer is in Devanagari script (' || {percent('a_ratio')} || ').'
   END AS script_fault, CAST({limit} AS DOUBLE) AS lim FROM {p}_words),
{p}_gated AS (SELECT *,
   valid AND NOT refused AS answered,
   CASE WHEN NOT valid THEN contract WHEN refused THEN CAST([] AS VARCHAR[]) ELSE list_filter([
     source_fault,
     CASE WHEN len(loose) > 0 THEN 'Answer contains ungrounded number(s) not found in cited sources: ' || {quoted_list('loose')} END,
     CASE WHEN overlap < lim OR len(known) = 0 OR len(words) = 0
          THEN 'Token overlap (' || {percent('overlap')} || ') is below threshold (' || {percent('lim')} || ').' END,
     script_fault], lambda m: m IS NOT NULL) END AS failures,
   CASE WHEN len(failures) > 0 THEN 'failed' WHEN refused THEN 'refused' ELSE 'passed' END AS outcome
   FROM {p}_measured)"""
