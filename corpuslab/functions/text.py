"""Text cleaning as column expressions. Python runs for Unicode forms and HTML entities only."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches define the results.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?:(?:\+\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)?\d{3}[-.\s]?\d{4})|(?:\d{3}[-.\s]\d{3}[-.\s]\d{4})"
URL = r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+[/\w\-.?=%&#+]*"
CITATIONS = (
    r"\[\d+(?:[-,]\s*\d+)*\]",
    r"\(\s*[A-Z][a-zA-Z]*(?:\s+(?:et\s+al\.?|and\s+[A-Z][a-zA-Z]*))?(?:,?\s*\d{4}[a-z]?)\s*\)",
    r"\[[A-Z][a-zA-Z]*\d{2,4}[a-z]?\]",
)
HTML_LINK = r"""<a\s[^>]*href=["']([^"']*)["'][^>]*>([^<]*)</a>"""
HTML_TAG = r"<[^>]+>"
CODE = r"```[\s\S]*?```|`[^`]+`"
# Characters and what stands for them.
REPLACEMENTS = (
    ("“", '"'),
    ("”", '"'),
    ("‘", "'"),
    ("’", "'"),
    ("–", "-"),
    ("—", "-"),
    ("…", "..."),
    ("\u00a0", " "),
    ("\u2002", " "),
    ("\u2003", " "),
    ("\u2009", " "),
    ("\ufeff", ""),
)
#: Python's white space: Java's Unicode class and four separators that it leaves out.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def fixed_places(value: Column, places: int) -> Column:
    """A number with so many places as C prints it: its exact binary value is rounded, halves to even; null is ``null``.

    ``format_string`` rounds the shortest decimal digits instead, halves up: 0.0625 would become 0.063.
    """
    return F.coalesce(F.call_function("format_number", value, F.lit("0." + "0" * places)), F.lit("null"))


def redact_emails(text: Column, placeholder: str = "[EMAIL]") -> Column:
    return F.regexp_replace(text, EMAIL, placeholder)


def redact_phones(text: Column, placeholder: str = "[PHONE]") -> Column:
    return F.regexp_replace(text, PHONE, placeholder)


def remove_pii(text: Column, redact: bool = True) -> Column:
    """Emails, then phone numbers: a placeholder each, or nothing."""
    return redact_phones(redact_emails(text, "[EMAIL]" if redact else ""), "[PHONE]" if redact else "")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, "(?iU)" + URL, "")


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?iU)" + URL), F.lit(0))


def strip_citations(text: Column, custom: tuple[str, ...] = ()) -> Column:
    """Built-in forms in order, then custom patterns; patterns that do not compile are skipped."""
    for pattern in CITATIONS + tuple(p for p in custom if _compiles(p)):
        text = F.regexp_replace(text, pattern, "")
    return text


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def apply_pattern(text: Column, pattern: str) -> Column:
    """A trusted pattern's matches go; an invalid pattern changes nothing."""
    return F.regexp_replace(text, pattern, "") if _compiles(pattern) else text


def apply_untrusted_pattern(text: Column, pattern: str, replacement: str = "", seconds: float = 1.0) -> Column:
    """An untrusted pattern's matches are replaced, in each text within a time limit.

    A text that takes longer (a pattern may take exponential time) stays as it is, and so do all
    where the pattern is invalid. Runs in Python, whose ``regex`` module can be interrupted.
    """
    import regex

    try:
        regex.compile(pattern)
    except regex.error:
        return text

    def replace(texts: pd.Series) -> pd.Series:
        compiled = regex.compile(pattern)

        def one(value: str | None) -> str | None:
            try:
                return None if value is None else compiled.sub(replacement, value, timeout=seconds)
            except TimeoutError:
                return value

        return texts.map(one)

    return F.pandas_udf(replace, "string")(text)


def strip_page_numbers(text: Column) -> Column:
    text = F.regexp_replace(text, r"\n\s*\d+\s*\n", "\n")
    return F.regexp_replace(text, r"(?m)^\s*\d+\s*$", "")


def strip_short_lines(text: Column, longest: int = 30) -> Column:
    """Lines of at most ``longest`` characters go, blank ones stay."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: (F.length(x) > longest) | (trimmed(x) == ""))
    return F.array_join(kept, "\n")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def squeeze_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def replace_typography(text: Column) -> Column:
    for old, new in REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _normal_form(form: str):
    def normalize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return F.pandas_udf(normalize, "string")


def normalize_unicode(text: Column, form: str = "NFC") -> Column:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown form {form}")
    # ASCII texts are in every form, so only the others go through Python.
    ascii_only = F.octet_length(text) == F.length(text)
    return replace_typography(F.when(ascii_only, text).otherwise(_normal_form(form)(text)))


def unescape_entities(text: Column) -> Column:
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else html.unescape(x))

    return F.when(F.contains(text, F.lit("&")), F.pandas_udf(unescape, "string")(text)).otherwise(text)


def strip_html(text: Column, entities: bool = True) -> Column:
    """Links keep their text and target, entities are decoded, tags go, white space is squeezed."""
    text = F.regexp_replace(text, "(?i)" + HTML_LINK, "$2 ($1)")
    text = unescape_entities(text) if entities else text
    return squeeze_whitespace(F.regexp_replace(text, HTML_TAG, " "))


def outside_code(text: Column, clean) -> Column:
    """Applies ``clean`` to what lies outside code fences and inline code."""
    code = F.regexp_extract_all(text, F.lit(CODE), F.lit(0))
    rest = F.transform(F.split(text, CODE, -1), clean)
    zipped = F.transform(rest, lambda x, i: F.concat(x, F.coalesce(F.get(code, i), F.lit(""))))
    return F.array_join(zipped, "")


def clean(
    text: Column,
    html_markup: bool = False,
    unicode_form: str | None = None,
    urls: bool = True,
    citations: bool = True,
    pii: bool = True,
    preserve_code: bool = False,
) -> Column:
    """The fixed order: markup, Unicode, URLs, citations, personal data; code apart if asked for.

    Steps that need Python (entities, Unicode forms) cannot run inside an array expression, so
    they see the whole text, code included.
    """
    if html_markup:
        text = strip_html(text)
    if unicode_form:
        text = normalize_unicode(text, unicode_form)

    def rest(x: Column) -> Column:
        x = strip_urls(x) if urls else x
        x = strip_citations(x) if citations else x
        return remove_pii(x, redact=False) if pii else x

    return outside_code(text, rest) if preserve_code else rest(text)


def hash_normal(text: Column) -> Column:
    """Lower case, words joined by one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def content_hash(question: Column, answer: Column) -> Column:
    return F.sha2(F.concat_ws("|||", F.lower(F.trim(question)), F.lower(F.trim(answer))), 256)


def word_set(text: Column) -> Column:
    """Distinct words of the lower-cased text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))


def parse_json_answer(text: Column, schema: str) -> Column:
    """JSON of a model's answer: the whole text, else its first greedy list or object."""
    whole = F.from_json(text, schema)
    part = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\]|\{.*\})", 1), schema)
    return F.coalesce(whole, part)
