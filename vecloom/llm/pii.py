"""Personal data by base patterns and a semi-Markov conditional random field.

Base spans (email, ip, card, phone) come from fixed patterns with their checks and always stay. Tokens within MOST_TOKENS
of one with a hint (a digit, an at sign, or at followed by dot) form regions; in them, whole-span features (digit count and grouping, separators, Luhn,
octet ranges, at/dot spelled out, neighbouring cue words) score candidate segments of up to MOST_TOKENS tokens with each
type, and a dynamic program over tokens chooses boundaries and types jointly, base spans being walls. A chosen segment is
added when its score clears `margin`. Weights are trained here, by conditional likelihood with forward-backward over
the same segments, on sentences made from a seed (`TRAIN_SENTENCES` of them): entities in spellings that the patterns
miss, and numbers that are no personal data. Tokens are parted by blanks; one of more than LONG_TOKEN characters is parted
at every character that no spelling has, too, and no segment reaches across such a place.

Memory: a region is never cut. Its segments are scored and dropped token by token, so that a region keeps offsets, scores
and back pointers of its tokens only; cost is linear in the text.

Defined cases: null text is empty and has no span; digests of no spans are of the empty string; repeated rows are
scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, table

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, MARGIN, TRAIN_SENTENCES = 7, 1.5, 1500
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive runs: a start inside a digit run can't match where the run's first digit doesn't
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_HINT = re.compile(r"[0-9@]|\(at\)|\[at\]")
_AT = re.compile(r"@|[(\[]at[)\]]|^[^a-z]*at[^a-z]*$", re.IGNORECASE)  # in a token of every segment with an at feature
_DOT = re.compile(r"\[\.\]|dot", re.IGNORECASE)
_SPELLED_AT = re.compile(r"(?<!\S)at(?=\s+(?:\S+\s+){1,%d}dot(?!\S))" % (MOST_TOKENS - 4), re.IGNORECASE)  # a segment has a token before at, two around dot
_SHORT_IP = re.compile(r"[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(dot\)|\[dot\]| dot )\s?[0-9]{1,3}){3}")
_TOKEN = re.compile(r"[^\s]+")
LONG_TOKEN = 200
_PIECE = re.compile(r"[A-Za-z0-9._%+@()\[\]/-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_TAIL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40:
                d = re.sub("[ -]", "", m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


CUES = {
    "mail": 0, "email": 0, "e-mail": 0, "correo": 0, "courriel": 0, "write": 0,
    "ip": 1, "host": 1, "server": 1, "address": 1,
    "card": 2, "visa": 2, "tarjeta": 2, "carte": 2, "karte": 2, "pay": 2,
    "phone": 3, "tel": 3, "call": 3, "fax": 3, "telefon": 3, "mobile": 3,
}
_EDGE = ",;:!?\"'»«)(]["


def _short_ip(span: str) -> bool:
    """Four octets of few digits, at least one dot spelled out: 1. 2. 3. 4 is a list."""
    return bool(_SHORT_IP.fullmatch(span)) and ("[" in span or "dot" in span)


def _features(tokens: list[str], i: int, j: int) -> list[str]:
    """Features of the segment tokens[i:j] as a whole; none where it can't be an entity."""
    span = " ".join(tokens[i:j]).strip(_EDGE + ".")
    low = span.lower()
    digits = re.sub("[^0-9]", "", span)
    at = "@" in low or "(at)" in low or "[at]" in low or " at " in f" {low} "
    if len(digits) < 7 and not at and not (len(digits) >= 4 and _short_ip(low)):
        return []
    letters = re.sub(r"\(at\)|\[at\]|\(dot\)|\[dot\]", "", low)
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    dotted = bool(re.search(r"\.[a-z]{2,}$|(\(dot\)|\[dot\]| dot )\s?[a-z]{2,}$", low))
    before = tokens[i - 1].lower().strip(_EDGE + ".") if i else ""
    out = [f"n={min(len(digits), 20)}", f"g={'.'.join(map(str, groups[:6]))}", f"len={j - i}", f"seps={''.join(sorted(set(re.sub('[0-9A-Za-z]', '', span))))[:6]}", f"alpha={min(3, sum(c.isalpha() for c in letters) // 2)}"]
    if at:
        out += ["at", f"at+dot={dotted}"]
    if 14 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    parts = re.split(r"\s?(?:\.|\[\.\]|\(dot\)|\[dot\]| dot )\s?", span)
    if len(parts) == 4:
        out.append(f"octets={all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)}")
    if before in CUES:
        out.append(f"cue={KINDS[CUES[before]]}")
    if i and (_DIGIT.search(tokens[i - 1]) or tokens[i - 1] in ("+", "at", "dot")):
        out.append("cut-left")
    if j < len(tokens) and (_DIGIT.search(tokens[j]) or tokens[j] in ("at", "dot", "(at)", "(dot)", "[at]", "[dot]")):
        out.append("cut-right")
    return out


def _arcs(tokens: list[str]) -> list[list[tuple[int, list[str]]]]:
    """Per end, the segments (start, features) that could be entities."""
    return [[], *_arcs_by_end(tokens)]


def _arcs_by_end(tokens: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
    digits = [0, *accumulate(len(_DIGIT.findall(t)) for t in tokens)]
    last_at = last_dot = -1
    for j in range(1, len(tokens) + 1):
        if _AT.search(tokens[j - 1]):
            last_at = j - 1
        if _DOT.search(tokens[j - 1]):
            last_dot = j - 1
        starts = (i for i in range(max(0, j - MOST_TOKENS), j) if last_at >= i or digits[j] - digits[i] >= (4 if last_dot >= i else 7))  # others have no features
        yield [(i, f) for i in starts if (f := _features(tokens, i, j))]


def _sum(w: dict, f: list[str], k: int) -> float:
    return w.get(("bias", k), 0.0) + sum(w.get((x, k), 0.0) for x in f)


def _lse(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def best_segments(tokens: list[str], w: dict, margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """(start token, end token, kind) of the best segmentation."""
    top, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j, arcs in enumerate(_arcs_by_end(tokens), 1):
        top[j] = top[j - 1]
        for i, f in arcs:
            for k in range(len(KINDS)):
                s = top[i] + _sum(w, f, k) - margin
                if s > top[j]:
                    top[j], back[j] = s, (i, k)
    out, j = [], len(tokens)
    while j:
        if back[j]:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def _sentences(seed: int, n: int) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    r = random.Random(seed)
    syl = ["an", "er", "on", "ti", "la", "de", "ver", "ion", "que", "sch", "ent", "os", "ra", "mi"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(sep):
        while not luhn(x := "4" + d(15)):
            pass
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    def entity():
        k = r.randrange(4)
        if k == 0:
            a, o = r.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), ("(at)", ".")])
            return k, f"{word()}{r.choice(['', '.' + word(), d(2)])}{a}{word()}{o}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"
        if k == 1:
            return k, r.choice(["[.]", " dot ", "(dot)", "[dot]"]).join(str(r.randint(0, 255)) for _ in range(4))
        if k == 2:
            return k, card(r.choice([". ", ".", " - ", "/"]))
        a, b, c = d(3), d(3), d(4)
        return k, r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"00{d(2)} {a} {b} {c}", f"({a}) {b} {c}"])

    def other():
        return r.choice([d(r.randint(1, 6)), d(r.randint(7, 13)), d(16) if not luhn("1") else "2", f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1950, 2030)}", f"{r.randint(1950, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(3)},{d(3)},{d(3)}", "".join(r.choice("0123456789abcdef") for _ in range(40)), f"{d(1)}.{d(7)}", f"@{word()}", f"{d(4)} {d(4)}", f"at {d(4)}", f"look at {word()}", f"{d(2)}:{d(2)}:{d(2)} {d(6)}", f"{word()}@", f"{d(3)} {d(2)} {d(4)} {d(5)} {d(6)}", f"n={d(9)}"])

    out = []
    for _ in range(n):
        tokens, gold = [word() for _ in range(r.randint(1, 4))], []
        for _ in range(r.randint(0, 2)):
            if r.random() < 0.5:
                k, s = entity()
                if r.random() < 0.3:
                    tokens.append(r.choice([c for c, x in CUES.items() if x == k]))
                got = s.split()
                gold.append((len(tokens), len(tokens) + len(got), k))
                got[-1] += r.choice(["", "", ".", ","])
                tokens += got
            else:
                tokens += other().split()
            tokens += [word() for _ in range(r.randint(1, 4))]
        out.append((tokens, gold))
    return out


def train(seed: int = 7, sentences: int = TRAIN_SENTENCES, rounds: int = 8, rate: float = 0.3, decay: float = 1e-3) -> dict:
    """Weights of (feature, kind) by stochastic gradient of the conditional likelihood."""
    data = [(t, {(i, j): k for i, j, k in g}, _arcs(t)) for t, g in _sentences(seed, sentences)]
    w: dict = defaultdict(float)
    for r in range(rounds):
        step = rate / (1 + 0.5 * r)
        for tokens, gold, arcs in data:
            n = len(tokens)
            if not any(arcs):
                continue
            scored = [[(i, k, _sum(w, f, k), f) for i, f in arcs[j] for k in range(len(KINDS))] for j in range(n + 1)]
            ahead = [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = _lse([ahead[j - 1], *(ahead[i] + s for i, _, s, _ in scored[j])])
            behind = [0.0] * (n + 1)
            starts: list[list] = [[] for _ in range(n + 1)]
            for j in range(n + 1):
                for i, k, s, _ in scored[j]:
                    starts[i].append((j, s))
            for i in range(n - 1, -1, -1):
                behind[i] = _lse([behind[i + 1], *(behind[j] + s for j, s in starts[i])])
            for j in range(1, n + 1):
                for i, k, s, f in scored[j]:
                    g = (1.0 if gold.get((i, j)) == k else 0.0) - math.exp(ahead[i] + s + behind[j] - ahead[n])
                    if abs(g) > 1e-4:
                        for x in (*f, "bias"):
                            w[(x, k)] += step * (g - decay * w[(x, k)])
    return dict(w)


_trained: dict = {}


def weights() -> dict:
    if "w" not in _trained:
        _trained["w"] = train()
    return _trained["w"]


def _before(text: str, at: int, hint: int) -> int:
    """Where the region of a hint begins: MOST_TOKENS tokens before the hint's own, at `at` (the end of a token) at least."""
    reach = 128
    while True:
        lo = max(at, hint - reach)
        starts = [m.start() for m in _TOKEN.finditer(text, lo, hint)]
        if lo > at:
            starts = starts[1:]  # the first may be the rest of a token
        own = bool(starts) and not text[hint - 1].isspace()
        if len(starts) >= MOST_TOKENS + own:
            return starts[-MOST_TOKENS - own]
        if lo == at:
            return starts[0] if starts else hint
        reach *= 2


def _regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Offsets of the tokens within MOST_TOKENS of one with a hint, in maximal sequences."""
    spelled = [m.start() for m in _SPELLED_AT.finditer(text)] if "dot" in text.lower() else []
    known, at, next_at = set(spelled), 0, 0
    while True:
        while next_at < len(spelled) and spelled[next_at] < at:
            next_at += 1
        hint = _HINT.search(text, at, *spelled[next_at : next_at + 1])
        if not hint and next_at == len(spelled):
            return
        first = hint.start() if hint else spelled[next_at]
        tokens, last = [], 0
        for m in _TOKEN.finditer(text, _before(text, at, first)):
            tokens.append(m.span())
            if m.end() <= first:
                continue
            if m.start() in known or _HINT.search(text, *m.span()):
                last = len(tokens)
            elif len(tokens) - last > 2 * MOST_TOKENS:  # no later hint reaches back to this one's region
                break
        del tokens[last + MOST_TOKENS :]
        yield tokens
        at = tokens[-1][1]


def _runs(text: str, tokens: list[tuple[int, int]], walls: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int]]]:
    """The tokens of a region between its walls; long tokens by their pieces."""
    wall, run = bisect_right(walls, tokens[0][0], key=lambda x: x[2]), []
    for s, e in tokens:
        pieces = [(s, e)] if e - s <= LONG_TOKEN else [m.span() for m in _PIECE.finditer(text, s, e)]
        if not pieces or pieces[0][0] > s:
            yield run
            run = []
        for n, (a, b) in enumerate(pieces):
            while wall < len(walls) and walls[wall][2] <= a:
                wall += 1
            walled = wall < len(walls) and walls[wall][0] < b
            if n or walled:
                yield run
                run = []
            if not walled:
                run.append((a, b))
        if pieces and pieces[-1][1] < e:
            yield run
            run = []
    yield run


def all_spans(text: str, w: dict) -> tuple[list, list]:
    """(base spans, base and added spans), each (start, kind, end) sorted."""
    base = base_spans(text)
    added = []
    for run in (run for tokens in _regions(text) for run in _runs(text, tokens, base)):
        for i, j, k in best_segments([text[s:e] for s, e in run], w):
            s, e = run[i][0], run[j - 1][1]
            while s < e and text[s] in _EDGE.replace("(", "") + ".":
                s += 1
            while e > s and text[e - 1] in _EDGE.replace(")", "").replace("]", "") + ".":
                e -= 1
            added.append((s, k, e))
    return base, sorted(base + added)


def _written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _finder(w: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: list[list] = [[] for _ in KINDS]
            sha, spans = [], []
            for t in b["t"]:
                base, every = all_spans(t.as_py() or "", w)
                for k in range(len(KINDS)):
                    n[k].append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(every))
            yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(x, pa.int64()) for x in n), pa.array(sha), pa.array(spans)], schema=OUT)

    return run


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of base spans by kind, digest of base spans, and all spans. Offsets are code points."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(_finder(weights()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op10_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
