"""Text functions as native column expressions; only HTML entities need Python (no built-in has the full table)."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..runtime import ship

# The results must equal those of other builds of the same index.
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "that", "is", "was", "it", "for", "with", "as", "his", "on", "be", "at", "by", "not"]
DIVISION = "(?iU)\\b(chapter|book|part|canto|volume|act|scene)\\b"
EDITORIAL = "(?iU)\\[\\s*(?:illustration|sidenote|footnote|transcriber|blank page|greek|hebrew|music)[^\\]]*\\]"
CODE_SYMBOLS = "{}[]<>;=|\\/*&^~`$"
C1_SINGLE = {0x82: ",", 0x84: '"', 0x8B: "<", 0x91: "'", 0x92: "'", 0x93: '"', 0x94: '"', 0x95: "*", 0x96: "-", 0x97: "-", 0x9B: ">"}
C1_LONGER = {0x85: "...", 0x99: "(TM)"}
SPACE_BEFORE = "(?U)\\s+([,.;:!?%)\\]])"
SQL_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\xa0", "&copy;": "\xa9", "&middot;": "\xb7", "&amp;": "&"}  # of html_strip, in its order
SQL_BLANK = "\\t\\n\\f\\r "
# End of fixed values.


def collapse(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, "(?U)[\\s\\x1c-\\x1f]+", " "))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def strip_html(h: Column, entities: dict[str, str] | None = None, blank: str = "\\s") -> Column:
    """Code blocks and block ends become blank lines, other tags spaces; entities are decoded last, so escaped tags stay text.
    entities: what is decoded, in order, natively; None: all of HTML5, with or without semicolon. blank: the characters that
    are blank in end tags and, with U+00A0, around punctuation."""
    t = F.regexp_replace(h, "(?is)<pre\\b.*?</pre>", "\n\n")
    t = F.regexp_replace(t, f"(?i)</(p|div|li|pre|blockquote|h[1-6])[{blank}]*>|<br[{blank}]*/?>", "\n\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    if entities is None:
        ship(SparkSession.getActiveSession())
        t = unescape(t)
    for name, to in (entities or {}).items():
        t = F.replace(t, F.lit(name), F.lit(to))
    around = f"[{blank}\\xa0]"
    t = F.regexp_replace(F.regexp_replace(t, SPACE_BEFORE.replace("\\s", around), "$1"), f"(?U)([(\\[]){around}+", "$1")
    return F.regexp_replace(t, "[ \\t]+", " ")


def clean_plain_text(t: Column) -> Column:
    t = F.translate(t, "".join(map(chr, C1_SINGLE)), "".join(C1_SINGLE.values()))
    for code, to in C1_LONGER.items():
        t = F.replace(t, F.lit(chr(code)), F.lit(to))
    t = F.regexp_replace(t, EDITORIAL, "")
    t = F.regexp_replace(t, "(?U)\\[\\d{1,3}\\]", "")
    t = F.regexp_replace(t, "_([^_\\n]{1,80})_", "$1")
    t = F.regexp_replace(t, "(?U)(\\w)\\{(\\w{1,3})\\}", "$1$2")
    t = F.regexp_replace(t, "(?U)([a-z])-\\s+(?!(?:and|or|nor|but|to|the)\\b)([a-z])", "$1$2")
    return F.regexp_replace(F.regexp_replace(t, SPACE_BEFORE, "$1"), "[ \\t]{2,}", " ")


def words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit("([A-Za-z][A-Za-z'-]*)"), 1)


def title_case_ratio(t: Column) -> Column:
    """Share of words that are capitalised, not in capitals, and don't begin a sentence (those are marked first)."""
    marked = F.regexp_replace(t, "(?U)(^|[.!?]\\s*[\"'(]?\\s*)([A-Za-z])", "$1\u0001$2")
    inner = F.filter(F.regexp_extract_all(marked, F.lit("(\u0001?[A-Za-z][A-Za-z'\u0001-]*)"), 1), lambda w: ~w.startswith("\u0001"))
    upper = F.size(F.filter(inner, lambda w: w.rlike("^[A-Z]") & (F.upper(w) != w)))
    return F.when(F.size(inner) > 0, upper / F.size(inner)).otherwise(0.0)


def is_prose(t: Column) -> Column:
    """Gates in their order; cheap ones on the text alone come first, and each word gate works on one array of words."""
    table = (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))) >= 3
    stops = F.length(t) - F.length(F.translate(t, ".?!", ""))

    def by_words(w: Column) -> Column:
        n = F.size(w)
        known = F.size(F.array_intersect(F.transform(w, F.lower), F.array(*map(F.lit, FUNCTION_WORDS))))
        caps = F.size(F.filter(w, lambda x: (F.length(x) > 1) & (F.upper(x) == x)))
        return F.when((n < 20) | (n < 9 * stops), False).when(known < 3, False).otherwise(caps / n <= 0.2)

    words_pass = F.element_at(F.transform(F.array(words(t)), by_words), 1)  # the array is made once, as a lambda's argument
    return F.when(t.isNull(), F.lit(None).cast("boolean")).when(table | t.contains("..") | (stops < 1), False).when(~words_pass, False).when(title_case_ratio(t) > 0.35, False).otherwise(F.regexp_count(t, F.lit(DIVISION)) < 2)


def looks_like_code(t: Column) -> Column:
    symbols = F.length(t) - F.length(F.translate(t, CODE_SYMBOLS, ""))
    return F.when(F.length(t) < 40, False).when(t.rlike('(?U)"\\s*:\\s*["\\d{\\[]'), True).otherwise(symbols / F.length(t) > 0.04)


def _cut(t: Column, limit: int) -> Column:
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), " [^ ]*$", ""), F.lit("...")))


def trim(t: Column, limit: int) -> Column:
    return _cut(collapse(t), limit)


def _sentences(t: Column) -> Column:
    return F.split(t, "(?U)(?<=[.!?])\\s+")


def headline(t: Column, limit: int = 110, ask: int = 35) -> Column:
    s = _sentences(collapse(t))
    asked = F.aggregate(F.filter(s, lambda x: x.endswith("?")), F.lit(""), lambda b, x: F.when(F.length(x) > F.length(b), x).otherwise(b))
    return _cut(F.when(F.length(asked) < ask, F.element_at(s, 1)).otherwise(asked), limit)


def chunk(t: Column, target: int = 480, least: int = 120) -> Column:
    """Array of passages: paragraphs, long ones packed by sentence; pieces shorter than `least` are dropped."""
    paragraphs = F.filter(F.transform(F.split(t, "(?U)\n\\s*\n"), collapse), lambda p: F.length(p) >= least)
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        full = (F.length(a["buf"]) + F.length(s) + 1 > target) & (F.length(a["buf"]) >= least)
        return F.when(full, F.struct(s.alias("buf"), F.concat(a["out"], F.array(a["buf"])).alias("out"))).otherwise(F.struct(F.trim(F.concat(a["buf"], F.lit(" "), s)).alias("buf"), a["out"].alias("out")))

    def done(a):
        return F.when(F.length(a["buf"]) >= least, F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"])

    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= target, F.array(p)).otherwise(F.aggregate(_sentences(p), start, step, done))))


def paragraphs(t: Column, least: int = 60, most: int = 512) -> Column:
    """The plain loader's pieces: paragraphs, collapsed, at least `least` long, cut at `most`."""
    p = F.transform(F.split(t, "(?U)\n\\s*\n"), collapse)
    return F.transform(F.filter(p, lambda x: F.length(x) >= least), lambda x: F.substring(x, 1, most))


def lower_host(url: Column) -> Column:
    head = F.regexp_extract(url, "^(https?://[^/]+)", 1)
    scheme = F.regexp_extract(url, "^(https?://)", 1)
    return F.when(F.length(head) > 0, F.concat(scheme, F.lower(F.regexp_extract(url, "^https?://([^/]+)", 1)), F.regexp_replace(url, "^https?://[^/]+", ""))).otherwise(url)


def safe_link(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))


def strip_title(t: Column) -> Column:
    return F.regexp_replace(t, "(?U)^[,\\s*]+|[,;:\\s*]+$", "")


# Labels and patterns of the passage audit.
ARTIFACTS = {
    "html leftover": r"<[a-zA-Z/][^>]{0,40}>|&[a-z]{2,8};",
    "underscore italics": r"(?<![A-Za-z])_[A-Za-z][^_\n]{1,60}_",
    "footnote marker": r"\[\d{1,3}\]",
    "brace superscript": r"\w\{\w{1,3}\}",
    "broken hyphenation": r"[a-z]-\s+[a-z]",
    "cp1252 mojibake": r"[\x80-\x9f]",
    "space before punctuation": r"\s[,.;:!?]",
    "dot leaders": r"\.{4,}|(?:\.\s){3,}",
    "ascii table": r"\|.*\|",
    "run of capitals": r"(?:\b[A-Z]{2,}\b[ ,.]+){4,}",
    "code": r"[{};]\s*$|\b(?:function|def|SELECT|printf)\s*\(",
}
# End of fixed values.

ATOMIC = {"run of capitals": r"(?:\b[A-Z]{2,}+\b[ ,.]++){4,}+"}  # the same matches; Java takes stack for each word otherwise
# In order; what Java has otherwise, also without (?U). A \b stands before letters in the first two, after letters else.
ASCII = {r"\s": r"[\t\n\f\r ]", r"\b[A-Z]": r"(?=[A-Z])(?<!\w)[A-Z]", r"\b(?:": r"(?<!\w)(?:", r"\b": r"(?!\w)"}


def artifact_patterns(ascii: bool = False) -> dict[str, str]:
    """The audit's patterns for Java, where only \\n ends a line. Classes and word boundaries are of Unicode, or ascii as in RE2."""
    out = {k: ATOMIC.get(k, p) for k, p in ARTIFACTS.items()}
    for c, to in ASCII.items() if ascii else ():
        out = {k: p.replace(c, to) for k, p in out.items()}
    return {k: ("(?d)" if ascii else "(?dU)") + p for k, p in out.items()}


def artifacts(t: Column, ascii: bool = False) -> Column:
    """Array of the labels whose pattern occurs."""
    return F.filter(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in artifact_patterns(ascii).items()]), lambda x: x.isNotNull())
