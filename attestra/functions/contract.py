"""Prompt text, refusals, and the strict JSON contract of a completion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import bound, strip_space

# fixed values: the three contract fields
FIELDS = ("answer", "sources", "refuse")


# ---- prompts ------------------------------------------------------------------------------
def safe_refusal(lang: Column) -> Column:
    """Canonical refusal in a language; unknown languages get the English one."""
    key = F.lower(lang)
    text = F.when(F.lit(False), F.lit(""))
    for code, refusal in lx.SAFE_REFUSALS.items():
        text = text.when(key == code, F.lit(refusal))
    return text.otherwise(F.lit(lx.SAFE_REFUSALS["en"]))


def format_context(passages: Column) -> Column:
    """Passages (array of structs with id, title, text) as one context text."""

    def block(p: Column) -> Column:
        title = strip_space(F.coalesce(p["title"], F.lit("")))
        head = F.concat(F.lit("["), F.coalesce(p["id"], F.lit("UNKNOWN")), F.lit("]"))
        head = F.concat(head, F.when(title != "", F.concat(F.lit(" "), title)).otherwise(""))
        return F.concat(head, F.lit("\n"), strip_space(F.coalesce(p["text"], F.lit(""))))

    joined = F.array_join(F.transform(passages, block), "\n\n")
    return F.when(F.size(passages) > 0, joined).otherwise(F.lit(lx.NO_CONTEXT))


def _messages(system: str, user: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", user))


def answer_messages(question: Column, passages: Column) -> Column:
    """Messages of the first attempt."""
    user = F.concat(
        F.lit("Reference Context:\n"), format_context(passages), F.lit("\n\nQuestion: "), question
    )
    return _messages(lx.SYSTEM_PROMPT, user)


def escalation_messages(
    question: Column, passages: Column, previous: Column, failures: Column
) -> Column:
    """Messages of the second attempt: prior output and why it failed."""
    # fixed values: the wording of this request
    bullets = F.array_join(F.transform(failures, lambda f: F.concat(F.lit("- "), f)), "\n")
    user = F.concat(
        F.lit("Reference Context:\n"),
        format_context(passages),
        F.lit("\n\nQuestion: "),
        question,
        F.lit("\n\nA previous attempt generated the following output, which FAILED verification:\n"),
        previous,
        F.lit("\n\nVerification failures identified:\n"),
        bullets,
        F.lit(
            "\n\nCorrection instructions:\n"
            "Carefully correct the output. Ensure every number and claim is strictly verified\n"
            "in the reference passages. Cite only valid passage IDs. If the passages do not\n"
            "support the claim, set 'refuse': true. Return raw JSON."
        ),
    )
    return _messages(lx.SYSTEM_PROMPT, user)


def judge_messages(question: Column, passages: Column, answer: Column) -> Column:
    """Messages asking whether an answer is grounded in the passages."""
    # fixed values: the wording of this request
    user = F.concat(
        F.lit("Reference Context:\n"),
        format_context(passages),
        F.lit("\n\nQuestion:\n"),
        question,
        F.lit("\n\nCandidate Answer:\n"),
        answer,
        F.lit(
            "\n\nIs the Candidate Answer completely grounded in the Reference Context "
            "without hallucinated facts or numbers?"
        ),
    )
    return _messages(lx.JUDGE_PROMPT, user)


# ---- JSON contract ------------------------------------------------------------------------
def json_slice(raw: Column) -> Column:
    """The part of an output to parse: outer fence removed, first '{' to last '}'."""
    fence = rf"(?s)\A```(?:json)?{lx.SPACE}*(.*?){lx.SPACE}*```(?=\n|\z)"

    def unfenced(text: Column) -> Column:
        fenced = F.startswith(text, F.lit("```")) & text.rlike(fence)
        return F.when(fenced, F.regexp_extract(text, fence, 1)).otherwise(text)

    def braced(text: Column) -> Column:
        braces = F.regexp_extract(text, r"(?s)\A[^{]*+(\{.*\})", 1)
        return bound(braces, lambda found: F.when(found != "", found).otherwise(text))

    return bound(bound(strip_space(raw), unfenced), braced)


def parse_object(raw: Column) -> Column:
    """VARIANT of the JSON object in an output, or NULL.

    The text is parsed as the only element of an array, so content after the object is an error.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), json_slice(raw), F.lit("]")))
    kept = F.transform(
        F.array(boxed),
        lambda v: F.when(
            F.try_variant_get(v, "$[1]", "variant").isNull()
            & F.startswith(
                F.schema_of_variant(F.try_variant_get(v, "$[0]", "variant")), F.lit("OBJECT")
            ),
            F.try_variant_get(v, "$[0]", "variant"),
        ),
    )
    return F.get(kept, F.lit(0))


def field_kind(data: Column, field: str) -> Column:
    """Type text of a field, 'VOID' for JSON null, NULL when the field is absent."""
    return F.schema_of_variant(F.try_variant_get(data, f"$.{field}", "variant"))


def type_name(kind: Column) -> Column:
    """Short type name used in failure messages."""
    return (
        F.when(kind == "STRING", F.lit("str"))
        .when(kind == "BOOLEAN", F.lit("bool"))
        .when(kind == "BIGINT", F.lit("int"))
        .when(kind == "VOID", F.lit("NoneType"))
        .when(F.startswith(kind, F.lit("ARRAY")), F.lit("list"))
        .when(F.startswith(kind, F.lit("OBJECT")), F.lit("dict"))
        .otherwise(F.lit("float"))
    )


def string_list(data: Column, field: str) -> Column:
    """ARRAY<STRING> of a field holding only JSON strings, else NULL."""
    items = F.try_variant_get(data, f"$.{field}", "array<variant>")
    all_text = F.forall(
        items, lambda e: F.coalesce(F.schema_of_variant(e), F.lit("VOID")) == "STRING"
    )
    typed = F.try_variant_get(data, f"$.{field}", "array<string>")
    return F.when(all_text, typed)


def quoted_list(items: Column) -> Column:
    """['a', 'b'] as it appears in failure messages; a text with a single quote stands in double ones, or escaped."""

    def quoted(item: Column) -> Column:
        plain = F.replace(item, F.lit("\\"), F.lit("\\\\"))
        escaped = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.contains(item, F.lit("'")) & ~F.contains(item, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(escaped)

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def type_failures(data: Column) -> Column:
    """One message per contract field of the wrong type."""
    answer, sources, refuse = (field_kind(data, f) for f in FIELDS)
    value = F.try_variant_get(data, "$.refuse", "string")
    shown = (
        F.when(refuse == "STRING", F.concat(F.lit("'"), value, F.lit("'")))
        .when(refuse == "VOID", F.lit("None"))
        .otherwise(value)
    )
    return F.array_compact(
        F.array(
            F.when(
                answer != "STRING",
                F.concat(
                    F.lit("Contract field 'answer' must be str, got "), type_name(answer), F.lit(".")
                ),
            ),
            F.when(
                string_list(data, "sources").isNull(),
                F.concat(
                    F.lit("Contract field 'sources' must be a list of strings, got "),
                    type_name(sources),
                    F.lit("."),
                ),
            ),
            F.when(
                refuse != "BOOLEAN",
                F.concat(
                    F.lit("Contract field 'refuse' must be a boolean (True/False), got "),
                    type_name(refuse),
                    F.lit(" (value: "),
                    shown,
                    F.lit(")."),
                ),
            ),
        )
    )


def truthy(data: Column, field: str) -> Column:
    """Lenient truth value: absent, null, false, 0, '' and empty containers are false."""
    kind = field_kind(data, field)
    text = F.try_variant_get(data, f"$.{field}", "string")
    return (
        F.when(kind.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(data, f"$.{field}", "boolean"))
        .when(kind == "STRING", text != "")
        .when(F.startswith(kind, F.lit("ARRAY")), text != "[]")
        .when(F.startswith(kind, F.lit("OBJECT")), text != "{}")
        .otherwise(F.try_variant_get(data, f"$.{field}", "double") != 0)
    )


def lenient_text(data: Column, field: str) -> Column:
    """Any field value as text; '' when absent."""
    kind = field_kind(data, field)
    text = F.try_variant_get(data, f"$.{field}", "string")
    return (
        F.when(kind.isNull(), F.lit(""))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def lenient_list(data: Column, field: str) -> Column:
    """Any list field as strings; empty when absent."""
    items = F.try_variant_get(data, f"$.{field}", "array<variant>")
    texts = F.transform(
        items, lambda e: F.coalesce(F.try_variant_get(e, "$", "string"), F.lit("None"))
    )
    return F.coalesce(texts, F.array().cast("array<string>"))
