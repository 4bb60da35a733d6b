"""Text columns: normalisation, tokens, character grams, numbers, script and language routing.

Everything is a ``Column -> Column`` function built from Spark SQL expressions. Pass plain columns
where possible: inputs are used more than once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import lexicon as lx


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def strip_space(text: Column) -> Column:
    """Trim all Unicode whitespace (``F.trim`` removes spaces only)."""
    return F.btrim(text, F.lit(lx.SPACES))


def strip_zero_width(text: Column) -> Column:
    """Remove zero-width spaces and joiners, byte-order marks and soft hyphens."""
    return F.translate(F.coalesce(text, F.lit("")), lx.ZERO_WIDTH, "")


def ascii_digits(text: Column) -> Column:
    """Map Devanagari digits to ASCII digits."""
    return F.translate(F.coalesce(text, F.lit("")), lx.DEVANAGARI_DIGITS, lx.ASCII_DIGITS)


def _beyond_latin(text: Column) -> Column:
    """Characters from U+0300 on; as a range of the plane that surrogates lie in, java.util.regex compares char by char."""
    return text.rlike("[\u0300-\uffff]")


def nfc(text: Column) -> Column:
    """Canonical composition. Text below U+0300 is composed already and is passed through.

    Spark has no built-in for this; the ICU library Spark ships is called through ``java_method``,
    which keeps the rows in the JVM.
    """
    composed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )
    return F.when(_beyond_latin(text), composed).otherwise(text)


def normalize_text(text: Column) -> Column:
    """NFC, then zero-width characters removed, then ASCII digits; NULL becomes ''."""
    text = F.coalesce(text, F.lit(""))
    composed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )
    cleaned = F.translate(composed, lx.DEVANAGARI_DIGITS + lx.ZERO_WIDTH, lx.ASCII_DIGITS)
    # only the soft hyphen can occur below U+0300
    return (
        F.when(is_ascii(text), text)
        .when(_beyond_latin(text), cleaned)
        .when(F.contains(text, F.lit("\u00ad")), F.replace(text, F.lit("\u00ad"), F.lit("")))
        .otherwise(text)
    )


def raw_tokens(text: Column) -> Column:
    """Lower-cased Devanagari or ASCII-alphanumeric runs, digit-group commas removed first."""
    # the dotted capital I is the one letter whose lower case would start with an ASCII letter
    lowered = F.lower(F.replace(normalize_text(text), F.lit("\u0130"), F.lit(" ")))
    joined = F.regexp_replace(lowered, r",(?=\p{Nd})(?<=\p{Nd},)", "")
    return F.regexp_extract_all(joined, F.lit(lx.WORD), F.lit(0))


_literal_cache: dict[tuple[int, tuple[str, ...]], list[Column]] = {}


def _literals(words: list[str]) -> list[Column]:
    """Literal columns of a word list, made once per Spark context (each one is a JVM call)."""
    context = SparkSession.active().sparkContext
    key = (id(context), tuple(words))
    if key not in _literal_cache:
        _literal_cache[key] = [F.lit(w) for w in words]
    return _literal_cache[key]


def is_stopword(token: Column, lang: str | None = None) -> Column:
    """Stopword test by language; any other or no language uses all lists together."""
    return token.isin(_literals(lx.STOPWORDS.get(lang, lx.STOPWORDS_ANY)))


def stopword_sql(token: str, lang: str) -> str:
    """The same test as SQL text, with the language read from a column."""

    def member(words: list[str]) -> str:
        return f"{token} IN ({', '.join(repr(w) for w in words)})"

    branches = "".join(f" WHEN '{code}' THEN {member(ws)}" for code, ws in lx.STOPWORDS.items())
    return f"CASE {lang}{branches} ELSE {member(lx.STOPWORDS_ANY)} END"


def tokenize(text: Column, remove_stopwords: bool = True, lang: str | None = None) -> Column:
    """Token array, in text order, duplicates kept."""
    tokens = raw_tokens(text)
    if not remove_stopwords:
        return tokens
    return F.filter(tokens, lambda t: ~is_stopword(t, lang))


def token_grams(token: Column, n: int = 3) -> Column:
    """Character n-grams of one token; a token shorter than ``n`` is its own gram."""
    starts = F.sequence(F.lit(1), F.length(token) - (n - 1))
    return F.when(F.length(token) < n, F.array(token)).otherwise(
        F.transform(starts, lambda i: F.substring(token, i, F.lit(n)))
    )


def grams_of(tokens: Column, n: int = 3) -> Column:
    return F.flatten(F.transform(tokens, lambda t: token_grams(t, n)))


def char_ngrams(text: Column, n: int = 3, lang: str | None = None) -> Column:
    """Per-word character n-grams of the non-stopwords."""
    return grams_of(tokenize(text, True, lang), n)


def features_of(tokens: Column) -> Column:
    """Words followed by their 3-grams; words of up to three characters therefore count twice."""
    return F.concat(tokens, grams_of(tokens))


def extract_features(text: Column, lang: str | None = None) -> Column:
    return features_of(tokenize(text, True, lang))


def feature_count(tokens: Column) -> Column:
    """Length of the feature bag of a token array, without building the bag."""
    return F.aggregate(
        tokens, F.lit(0), lambda n, t: n + 1 + F.greatest(F.lit(1), F.length(t) - 2)
    )


def extract_numbers(text: Column) -> Column:
    """Numbers as canonical strings (commas dropped, '%' kept), list markers at line starts ignored.

    Text without a digit is not searched.
    """
    body = F.regexp_replace(normalize_text(text), "(?md)" + lx.LIST_MARKER, " ")
    # the digit is looked for first, since it is what most places lack
    pattern = rf"(?=\p{{Nd}})(?<![a-zA-Z0-9_]){lx.NUMBER_BODY}%?(?![a-zA-Z0-9_])"
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    numbers = F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.when(text.rlike(r"\p{Nd}"), numbers).otherwise(F.array().cast("array<string>"))


def bare_number(number: Column) -> Column:
    """A number without leading or trailing percent signs."""
    return F.btrim(number, F.lit("%"))


def devanagari_ratio(text: Column) -> Column:
    """Share of Devanagari-block characters among Devanagari and alphabetic ones; 0.0 if none.

    Text without a Devanagari character is not counted: its share is 0.
    """
    deva = F.length(F.regexp_replace(text, "[^\u0900-\u097f]+", ""))
    alpha = F.length(F.regexp_replace(text, "[^\\p{L}\u0900-\u097f]+", ""))
    share = F.coalesce(F.try_divide(deva, alpha), F.lit(0.0))
    none = is_ascii(text) | ~text.rlike("[\u0900-\u097f]")
    return F.when(none, F.lit(0.0)).otherwise(share)


def word_array(words: list[str]) -> Column:
    """A constant array of words, folded from one literal."""
    return F.split(F.lit(" ".join(words)), " ")


def candidate_languages(text: Column) -> Column:
    """['en'], ['hi'], ['mr'], or ['hi', 'mr'] when the marker words do not decide."""
    tokens = raw_tokens(text)
    marathi = F.size(F.array_intersect(tokens, word_array(lx.MARKERS_MR)))
    hindi = F.size(F.array_intersect(tokens, word_array(lx.MARKERS_HI)))
    lead = F.when(devanagari_ratio(text) < lx.ROUTING_RATIO, F.lit(None)).otherwise(marathi - hindi)
    # one comparison value, bound once
    pick = F.transform(
        F.array(lead),
        lambda d: F.when(d.isNull(), word_array(["en"]))
        .when(d > 0, word_array(["mr"]))
        .when(d < 0, word_array(["hi"]))
        .otherwise(word_array(["hi", "mr"])),
    )
    return F.get(pick, F.lit(0))


def detect_language(text: Column) -> Column:
    """Single language; undecided Devanagari text counts as Hindi."""
    return F.get(candidate_languages(text), F.lit(0))


def normalize_question(text: Column) -> Column:
    """Lookup key of a question: whitespace collapsed, lower case."""
    return F.lower(strip_space(F.regexp_replace(text, f"{lx.SPACE}+", " ")))
