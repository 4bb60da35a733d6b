"""Text functions over whole tables, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import lexicon as lx
from attestra.functions import records as rc
from attestra.functions import text as tx
from attestra.functions.contract import safe_refusal
from attestra.functions.rounding import exact_round

from . import sql
from .inputs import deva, table


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id")


def _text_digest(df: DataFrame, key: str, text: Column) -> DataFrame:
    return df.select(key, text.alias("out")).select(
        key, F.length("out").cast("long").alias("n_chars"), F.md5("out").alias("digest")
    )


def _list_digest(df: DataFrame, key: str, items: Column) -> DataFrame:
    return df.select(key, items.alias("out")).select(
        key,
        F.size("out").cast("long").alias("n_items"),
        F.size(F.array_distinct("out")).cast("long").alias("n_distinct"),
        F.md5(F.array_join("out", " ")).alias("digest"),
    )


def _sql_text(source: str, key: str, text: str) -> str:
    return (
        f"SELECT {key}, CAST(length(out) AS BIGINT) AS n_chars, md5(out) AS digest "
        f"FROM (SELECT {key}, {text} AS out FROM {source})"
    )


def _sql_list(source: str, key: str, items: str) -> str:
    return (
        f"SELECT {key}, CAST(len(out) AS BIGINT) AS n_items, "
        f"CAST(len(list_distinct(out)) AS BIGINT) AS n_distinct, "
        f"md5(array_to_string(out, ' ')) AS digest FROM (SELECT {key}, {items} AS out FROM {source})"
    )


# documents with zero-width characters, decomposed accents or other scripts worked in
_ZW = [("e ", "e\u200b "), ("th", "t\u200dh"), ("on", "o\u00adn"), (". ", ".\ufeff ")]
_MARKS = [
    ("e", "e\u0301"),
    ("a", "a\u0300\u0323"),
    ("n", "\u0928\u093c"),
    ("k", "\u0958"),
    ("r", "\u212a"),
]


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _sql_replaced(text: str, pairs) -> str:
    for old, new in pairs:
        text = f"replace({text}, {sql.quote(old)}, {sql.quote(new)})"
    return text


def strip_zero_width(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return _text_digest(docs, "doc_id", tx.strip_zero_width(_replaced(F.col("text"), _ZW)))


def devanagari_digits(spark, sf_dir):
    digits = F.translate("text", "etaoinshrd", lx.DEVANAGARI_DIGITS)
    return _text_digest(_docs(spark, sf_dir), "doc_id", tx.ascii_digits(digits))


def normalize_text(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(
        "doc_id", _replaced(_replaced(F.col("text"), _ZW), _MARKS).alias("text")
    )
    return _text_digest(docs, "doc_id", tx.normalize_text(F.col("text")))


def nfc(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", _replaced(F.col("text"), _MARKS).alias("text"))
    return _text_digest(docs, "doc_id", tx.nfc(F.col("text")))


def tokenize(spark, sf_dir):
    return _list_digest(_docs(spark, sf_dir), "doc_id", tx.tokenize(F.col("text"), False))


def tokenize_stopwords(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", tx.raw_tokens(F.col("text")).alias("raw"), "lang")
    kept = F.expr(f"filter(raw, t -> NOT ({tx.stopword_sql('t', 'lang')}))")
    return _list_digest(docs, "doc_id", kept)


def tokenize_devanagari(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", deva(F.col("text")).alias("text"))
    return _list_digest(docs, "doc_id", tx.tokenize(F.col("text"), True, "mr"))


def char_ngrams(spark, sf_dir):
    return _list_digest(_docs(spark, sf_dir), "doc_id", tx.char_ngrams(F.col("text"), 3, "en"))


def feature_bag(spark, sf_dir):
    return _list_digest(_docs(spark, sf_dir), "doc_id", tx.extract_features(F.col("text")))


def extract_numbers(spark, sf_dir):
    return _list_digest(_docs(spark, sf_dir), "doc_id", tx.extract_numbers(F.col("text")))


# order lines as numbered lists with grouped numbers, decimals and percentages
_ORDER_TEXT = (
    "l_linenumber || '. Part ' || l_partkey || ': 1,' || lpad(cast(l_suppkey AS string), 3, '0') "
    "|| ',00 units of ' || l_quantity || ' at ' || l_discount || '%, a' || l_orderkey || ' v'"
    " || l_tax || '\n' || l_orderkey || ') (' || l_suppkey || ',' || l_partkey || ')'"
)


def number_formats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey")
    found = lines.select(
        "l_orderkey", "l_linenumber", F.expr(_ORDER_TEXT).alias("line")
    ).withColumn("found", tx.extract_numbers(F.col("line")))
    return found.select(
        "l_orderkey",
        "l_linenumber",
        F.array_join("found", " ").alias("numbers"),
        F.array_join(F.transform("found", tx.bare_number), " ").alias("bare_numbers"),
    )


def _script_texts(spark, sf_dir):
    """Conversation turns with growing Devanagari shares."""
    turns = table(spark, sf_dir, "conversations")
    part = F.floor(F.length("text") * F.pmod("conv_id", F.lit(5)) / 4).cast("int")
    mixed = F.concat(deva(F.left("text", part)), F.right("text", F.length("text") - part))
    return turns.select("conv_id", "turn", mixed.alias("text"))


_SQL_SCRIPT = (
    "(SELECT conv_id, turn, "
    f"{sql.deva('left(text, CAST(floor(length(text) * (conv_id % 5) / 4) AS INT))')} || "
    "right(text, length(text) - CAST(floor(length(text) * (conv_id % 5) / 4) AS INT)) AS text "
    "FROM conversations)"
)


def detect_script(spark, sf_dir):
    texts = _script_texts(spark, sf_dir)
    ratio = texts.select("conv_id", "turn", tx.devanagari_ratio(F.col("text")).alias("r"))
    return ratio.select("conv_id", "turn", exact_round("r", 3).alias("ratio"))


def candidate_languages(spark, sf_dir):
    texts = _script_texts(spark, sf_dir)
    return texts.select(
        "conv_id",
        "turn",
        F.array_join(tx.candidate_languages(F.col("text")), "_").alias("candidates"),
        tx.detect_language(F.col("text")).alias("language"),
    )


def question_key(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    spaced = F.concat(F.lit(" \t"), F.replace("text", F.lit(" "), F.lit(" \n ")))
    return turns.select("conv_id", "turn", F.md5(tx.normalize_question(spaced)).alias("question_key"))


def refusal_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lang = F.when(F.col("lang") == "de", "MR").when(F.col("lang") == "es", "Hi").otherwise(F.col("lang"))
    return docs.select("doc_id", safe_refusal(lang).alias("refusal"))


def answer_preview(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", rc.preview(F.col("text")).alias("preview")
    )


_SPACED = "' \t' || replace(text, ' ', ' \n ')"
_SQL_LINES = _ORDER_TEXT.replace("cast(l_suppkey AS string)", "CAST(l_suppkey AS VARCHAR)")

QUERIES = {
    "strip_zero_width": (
        strip_zero_width,
        _sql_text("documents", "doc_id", sql.strip_zero_width(_sql_replaced("text", _ZW))),
    ),
    "devanagari_digits": (
        devanagari_digits,
        _sql_text(
            "documents",
            "doc_id",
            sql.ascii_digits(f"translate(text, 'etaoinshrd', '{lx.DEVANAGARI_DIGITS}')"),
        ),
    ),
    "nfc": (
        nfc,
        _sql_text("documents", "doc_id", f"nfc_normalize({_sql_replaced('text', _MARKS)})"),
    ),
    "normalize_text": (
        normalize_text,
        _sql_text(
            "documents", "doc_id", sql.normalize(_sql_replaced(_sql_replaced("text", _ZW), _MARKS))
        ),
    ),
    "tokenize": (tokenize, _sql_list("documents", "doc_id", sql.raw_tokens("text"))),
    "tokenize_stopwords": (
        tokenize_stopwords,
        _sql_list("documents", "doc_id", sql.tokens("text", "lang")),
    ),
    "tokenize_devanagari": (
        tokenize_devanagari,
        _sql_list(
            f"(SELECT doc_id, {sql.deva('text')} AS text FROM documents)",
            "doc_id",
            sql.tokens("text", "'mr'"),
        ),
    ),
    "char_ngrams": (
        char_ngrams,
        _sql_list(
            f"(SELECT doc_id, {sql.tokens('text', chr(39) + 'en' + chr(39))} AS toks FROM documents)",
            "doc_id",
            sql.grams("toks"),
        ),
    ),
    "feature_bag": (
        feature_bag,
        _sql_list(
            f"(SELECT doc_id, {sql.tokens('text')} AS toks FROM documents)",
            "doc_id",
            sql.features("toks"),
        ),
    ),
    "extract_numbers": (
        extract_numbers,
        _sql_list("documents", "doc_id", sql.numbers("text")),
    ),
    "number_formats": (
        number_formats,
        f"""SELECT l_orderkey, l_linenumber, array_to_string(nums, ' ') AS numbers,
            array_to_string(list_transform(nums, lambda n: trim(n, '%')), ' ') AS bare_numbers
            FROM (SELECT l_orderkey, l_linenumber, {sql.numbers('line')} AS nums
                  FROM (SELECT l_orderkey, l_linenumber, {_SQL_LINES} AS line FROM lineitem))""",
    ),
    "detect_script": (
        detect_script,
        f"SELECT conv_id, turn, {sql.exact_round('r', 3)} AS ratio "
        f"FROM (SELECT conv_id, turn, {sql.ratio('text')} AS r FROM {_SQL_SCRIPT})",
    ),
    "candidate_languages": (
        candidate_languages,
        f"SELECT conv_id, turn, cand AS candidates, left(cand, 2) AS language "
        f"FROM (SELECT conv_id, turn, {sql.candidates('text')} AS cand FROM {_SQL_SCRIPT})",
    ),
    "question_key": (
        question_key,
        f"SELECT conv_id, turn, md5(lower({sql.strip(f'regexp_replace({_SPACED}, {sql.quote(sql.SP + chr(43))}, {sql.quote(chr(32))}, {sql.quote(chr(103))})')})) "
        "AS question_key FROM conversations",
    ),
    "safe_refusal": (
        refusal_text,
        "SELECT doc_id, "
        + sql.refusal("CASE lang WHEN 'de' THEN 'MR' WHEN 'es' THEN 'Hi' ELSE lang END")
        + " AS refusal FROM documents",
    ),
    "answer_preview": (
        answer_preview,
        "SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN substring(text, 1, 60) || '...' "
        "ELSE text END AS preview FROM conversations",
    ),
}
