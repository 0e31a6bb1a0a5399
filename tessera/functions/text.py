"""Text expressions: cleaning, word splitting, HTML to text, URL
classification, code-block extraction and answer checking.

All are ``Column -> Column`` builders over built-in regex functions, so they
run inside whole-stage codegen.  Java regexes get ``(?U)`` where Python's
Unicode ``\\s`` / ``\\S`` semantics matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must equal the reference's behaviour.
TAG_RE = r"<[^>]+>"
URL_RE = r"(?U)https?://\S+"
SPECIAL_RE = r"[^a-zA-Z0-9\s.,!?'-]"
SPECIAL_UNICODE_RE = r"(?U)[^\p{L}\p{N}\s.,!?'-]"
EDGE_SPACE_RE = r"(?U)\A\s+|\s+\z"
SCRIPT_RE = r"(?s)<script[^>]*>.*?</script>"
STYLE_RE = r"(?s)<style[^>]*>.*?</style>"
SPACE_RUN_RE = r"(?U)\s+"
TITLE_RE = r"<title>(.*?)</title>"
CODE_TAG_RE = r"(?s)<code>(.*?)</code>"
FENCE_RE = r"(?s)```(?:python)?\n(.*?)```"
NUMBER_RE = r"-?\d+\.?\d*"
ARXIV_RE = r"arxiv\.org/(?:abs|pdf)/(\d+\.\d+)"
S2_RE = r"semanticscholar\.org/paper/([a-f0-9]+)"
OPENREVIEW_ID_RE = r"id=([A-Za-z0-9_-]+)"
MIN_FENCED_CHARS = 50


def strip(c: Column) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return F.regexp_replace(c, EDGE_SPACE_RE, "")


def clean(c: Column, strip: bool = True, lowercase: bool = True, remove_html: bool = False,
          remove_urls: bool = False, remove_special: bool = False, unicode: bool = False) -> Column:
    """The ``text_clean`` steps, in the reference's order."""
    if strip:
        c = globals()["strip"](c)
    if lowercase:
        c = F.lower(c)
    if remove_html:
        c = F.regexp_replace(c, TAG_RE, "")
    if remove_urls:
        c = F.regexp_replace(c, URL_RE, "")
    if remove_special:
        c = F.regexp_replace(c, SPECIAL_UNICODE_RE if unicode else SPECIAL_RE, "")
    return c


def words(c: Column) -> Column:
    """Python ``str.split()``: runs of whitespace, no empty words."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != F.lit(""))


def html_clean_text(html: Column) -> Column:
    """Whole-page text: scripts and styles dropped, tags to spaces,
    whitespace squeezed."""
    t = F.regexp_replace(html, SCRIPT_RE, "")
    t = F.regexp_replace(t, STYLE_RE, "")
    t = F.regexp_replace(t, TAG_RE, " ")
    return strip(F.regexp_replace(t, SPACE_RUN_RE, " "))


def html_to_text(html: Column, cap: int | None = None) -> Column:
    """The whole-page text; ``cap`` asks for a preview of so many characters."""
    t = html_clean_text(html)
    return t if cap is None else F.substring(t, 1, cap)


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, TITLE_RE, 1)


def url_source(url: Column) -> Column:
    return (F.when(url.rlike(ARXIV_RE), F.lit("arxiv"))
            .when(url.rlike(S2_RE), F.lit("semanticscholar"))
            .when(url.contains("openreview.net"), F.lit("openreview"))
            .otherwise(F.lit("generic")))


def url_paper_id(url: Column) -> Column:
    return (F.when(url.rlike(ARXIV_RE), F.regexp_extract(url, ARXIV_RE, 1))
            .when(url.rlike(S2_RE), F.regexp_extract(url, S2_RE, 1))
            .when(url.contains("openreview.net") & url.rlike(OPENREVIEW_ID_RE),
                  F.regexp_extract(url, OPENREVIEW_ID_RE, 1)))


def code_blocks(text: Column) -> Column:
    """ARRAY<STRUCT<source, content>>: ``<code>`` spans first, then fenced
    blocks longer than 50 characters, each in text order."""
    tags = F.transform(F.regexp_extract_all(text, F.lit(CODE_TAG_RE), 1),
                       lambda s: F.struct(F.lit("code_tag").alias("source"), strip(s).alias("content")))
    fenced = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(FENCE_RE), 1),
                    lambda s: F.struct(F.lit("markdown").alias("source"), strip(s).alias("content"))),
        lambda b: (F.length(b["content"]) > MIN_FENCED_CHARS))
    return F.concat(tags, fenced)


def _number_forms(n: Column) -> Column:
    return F.when(n.contains("."), F.regexp_replace(F.regexp_replace(n, "0+$", ""), r"\.$", "")).otherwise(n)


def answer_matches(generated: Column, expected: Column) -> Column:
    """Case-insensitive containment, or equality with a number found in the
    generation (trailing zeros of decimals dropped).  ``17`` contains ``7``
    is a match, as in the reference."""
    gen = F.lower(strip(generated))
    exp = F.lower(strip(expected))
    nums = F.regexp_extract_all(gen, F.lit(NUMBER_RE), 0)
    return (F.coalesce(gen.contains(exp), F.lit(False))
            | F.coalesce(F.exists(nums, lambda n: (_number_forms(n) == exp) | (n == exp)), F.lit(False)))
