"""The text queries in SQL. Its patterns have no look-around, so a sentinel character marks what must not match, or where to cut."""

from ..functions import text as T

CHUNK = r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 120) ps FROM documents),
s AS (SELECT doc_id, list_transform(ps, lambda q: {'p': q, 's': string_split(regexp_replace(q, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))}) ps FROM p),
f AS (SELECT doc_id, list_transform(ps, lambda q: CASE WHEN length(q.p) <= 480 THEN {'buf': '', 'out': [q.p]} ELSE
  list_reduce(list_transform(q.s, lambda x: {'buf': x, 'out': CAST([] AS VARCHAR[])}), lambda a, x:
    CASE WHEN length(a.buf) + length(x.buf) + 1 > 480 AND length(a.buf) >= 120 THEN {'buf': x.buf, 'out': list_append(a.out, a.buf)}
    ELSE {'buf': trim(a.buf || ' ' || x.buf), 'out': a.out} END, {'buf': '', 'out': CAST([] AS VARCHAR[])}) END) fs FROM s),
o AS (SELECT doc_id, flatten(list_transform(fs, lambda a: CASE WHEN length(a.buf) >= 120 THEN list_append(a.out, a.buf) ELSE a.out END)) pieces FROM f)
SELECT doc_id, CAST(unnest(range(len(pieces))) AS INTEGER) AS at, unnest(pieces) AS piece FROM o
"""

PROSE = rf"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*') w, length(text) - length(translate(text, '.?!', '')) stops,
  regexp_replace(text, '(^|[.!?]\s*["''(]?\s*)([A-Za-z])', '\1' || chr(1) || '\2', 'g') marked FROM documents),
i AS (SELECT *, list_filter(regexp_extract_all(marked, '\x01?[A-Za-z][A-Za-z''\x01-]*'), lambda x: NOT starts_with(x, chr(1))) words FROM w),
t AS (SELECT *, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: regexp_matches(x, '^[A-Z]') AND upper(x) <> x)) / len(words) ELSE 0.0 END tc FROM i)
SELECT doc_id, CASE WHEN length(text) - length(replace(text, '|', '')) >= 3 OR contains(text, '..') THEN false WHEN len(w) < 20 THEN false
  WHEN len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), {T.FUNCTION_WORDS})) < 3 THEN false
  WHEN len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x)) / len(w) > 0.2 THEN false
  WHEN stops < 1 THEN false WHEN len(w) / stops < 9 THEN false WHEN tc > 0.35 THEN false
  ELSE len(regexp_extract_all(text, '(?i)\b(?:chapter|book|part|canto|volume|act|scene)\b')) < 2 END AS prose, round(tc, 9) AS title_case FROM t
"""

HEADLINE = r"""
WITH s AS (SELECT conv_id, turn, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) s FROM conversations),
a AS (SELECT conv_id, turn, s, list_reduce(list_filter(s, lambda x: ends_with(x, '?')), lambda b, x: CASE WHEN length(x) > length(b) THEN x ELSE b END, '') q FROM s),
h AS (SELECT conv_id, turn, CASE WHEN length(q) < 35 THEN s[1] ELSE q END h FROM a)
SELECT conv_id, turn, CASE WHEN length(h) <= 110 THEN h ELSE regexp_replace(h[1:110], ' [^ ]*$', '') || '...' END AS headline FROM h
"""


def _replaced(expression: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        expression = f"regexp_replace({expression}, '{pattern}', {to}, 'g')"
    return expression


_c1 = f"translate(text, {' || '.join(f'chr({c})' for c in T.C1_SINGLE)}, {' || '.join(f'chr({ord(x)})' for x in T.C1_SINGLE.values())})"
for _code, _to in T.C1_LONGER.items():
    _c1 = f"replace({_c1}, chr({_code}), '{_to}')"
_CLEANED = _replaced(_c1, [
    (r"(?i)\[\s*(?:illustration|sidenote|footnote|transcriber|blank page|greek|hebrew|music)[^\]]*\]", "''"), (r"\[\d{1,3}\]", "''"), (r"_([^_\n]{1,80})_", r"'\1'"), (r"(\w)\{(\w{1,3})\}", r"'\1\2'"),
    (r"([a-z])-(\s+(?:and|or|nor|but|to|the)\b)", r"'\1' || chr(2) || '\2'"), (r"([a-z])-\s+([a-z])", r"'\1\2'"), (r"\x02", "'-'"), (r"\s+([,.;:!?%)\]])", r"'\1'"), (r"[ \t]{2,}", "' '"),
])
CLEAN = f"SELECT doc_id, sha256({_CLEANED}) AS clean_sha256 FROM documents"

_plain = _replaced("html", [(r"(?is)<pre\b.*?</pre>", "chr(10) || chr(10)"), (r"(?i)</(p|div|li|pre|blockquote|h[1-6])\s*>|<br\s*/?>", "chr(10) || chr(10)"), ("<[^>]+>", "' '")])
for _from, _to in {"&lt;": "'<'", "&gt;": "'>'", "&quot;": "'\"'", "&#39;": "chr(39)", "&nbsp;": "chr(160)", "&copy;": "chr(169)", "&middot;": "chr(183)", "&amp;": "'&'"}.items():
    _plain = f"replace({_plain}, '{_from}', {_to})"
HTML = "SELECT page_id, " + _replaced(_plain, [("[\\s ]+([,.;:!?%)\\]])", r"'\1'"), ("([(\\[])[\\s ]+", r"'\1'"), (r"[ \t]+", "' '")]) + " AS text FROM pages"
