"""Toxicity by compression distance: one zstandard dictionary from toxic, one from ordinary training text.

Both dictionaries end with the same frequent ordinary words; the toxic one begins with the segments (5 to 8 characters)
that mark toxic training documents, chosen by document frequency against ordinary documents, each pick discounting the
words that earlier picks explain. A window of words is compressed with both; how many bytes the toxic dictionary saves
is the window's distance. A document's score comes from its windows' three largest savings through a logistic curve
that is calibrated by cross-fitting: each third of the sample is scored with dictionaries of the other two. The same scores
choose how marked a segment must be (`LEAST_ODDS`). Every window of every text is compressed.

Dictionaries that zstandard trains on toxic and on ordinary text apart don't find toxic words here: ordinary windows differ
by as many bytes between them as toxic ones (figures in the README). So both share their ordinary part.

Training uses a bounded sample of labelled rows of the learning fold (`toxic_docs`, `ordinary_docs`, those of the lowest
hashes of the id, up to `sample_chars` characters of each) and only their text and label.

Defined cases: null and empty texts score as a text without any saving; without labelled rows of both kinds all score
0; a null label is no label; repeated rows are scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import memo, ship, table
from .language_id import fold_of

TOXIC_DOCS, ORDINARY_DOCS, SAMPLE_CHARS, WINDOW_WORDS, THRESHOLD = 1500, 3000, 100_000, 8, 0.7
#: Log odds that every five characters of a marking segment need: cross-fitting takes the best of these.
LEAST_ODDS = (4.0, 3.5, 3.0)


def _words(text: str) -> list[str]:
    return text.lower().split()


def _grams(word: str, fives: set[str] | None = None) -> set[str]:
    """The word's segments; with `fives` those that begin with one of these."""
    s = " " + word
    starts = [i for i in range(len(s) - 4) if fives is None or s[i : i + 5] in fives]
    return {s[i : i + n] for i in starts for n in (5, 6, 7, 8) if i + n <= len(s)}


class _Counts:
    """Document frequencies of words and segments in one set of training rows (hash, text, label)."""

    def __init__(self, rows: list[tuple], least_share: float = 0.02):
        self.words: Counter = Counter()
        ordinary: Counter = Counter()
        for _, t, y in rows:
            (self.words if y else ordinary).update(set(_words(t)))
        self.toxic_rows = sum(1 for _, _, y in rows if y)
        self.ordinary_rows = len(rows) - self.toxic_rows
        self.least = max(2.0, least_share * self.toxic_rows)
        fives: Counter = Counter()
        for w, c in self.words.items():
            for g in {(" " + w)[i : i + 5] for i in range(len(w) - 3)}:
                fives[g] += c
        self.fives = {g for g, c in fives.items() if c >= self.least}  # a longer segment is no more frequent than its beginning
        count: Counter = Counter()
        for w, c in self.words.items():
            for g in _grams(w, self.fives):
                count[g] += c
        self.count = {g: c for g, c in count.items() if c >= self.least}
        seen: Counter = Counter()
        for w, c in ordinary.items():
            for g in _grams(w, self.fives) & self.count.keys():
                seen[g] += c
        self.odds = {g: math.log((c + 0.5) / max(1, self.toxic_rows)) - math.log((seen[g] + 0.5) / max(1, self.ordinary_rows)) for g, c in self.count.items()}
        self.common = " ".join(w for w, _ in sorted(ordinary.items(), key=lambda x: (-x[1], x[0]))[:600])

    def segments(self, least_odds: float, most: int = 400) -> list[str]:
        """Marking segments, best first."""
        # zstandard matches 5 bytes of a segment too, so no 5 characters of it may be ordinary
        often = {g for g in self.odds if all(self.odds.get(g[i : i + 5], -1.0) >= least_odds for i in range(len(g) - 4))}
        fives, where = {g[:5] for g in often}, {}
        for w in self.words:
            for g in _grams(w, fives) & often:
                where.setdefault(g, []).append(w)
        left = {g: self.count[g] for g in often}
        chosen, explained = [], set()
        while left and len(chosen) < most:
            g = max(left, key=lambda x: (left[x] * self.odds[x], len(x), x))
            if left[g] < self.least:
                break
            chosen.append(g)
            for w in where[g]:
                if w not in explained:
                    explained.add(w)
                    for x in _grams(w, fives) & left.keys():
                        left[x] -= self.words[w]
            del left[g]
        return chosen

    def dictionaries(self, least_odds: float) -> dict:
        ordinary = self.common.encode("utf-8", "replace")
        return {"toxic": "\n".join(self.segments(least_odds)).encode("utf-8", "replace") + b"\n" + ordinary, "ordinary": ordinary}


def _compressor(content: bytes) -> zs.ZstdCompressor:
    p = zs.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=4, target_length=8, min_match=5, strategy=zs.STRATEGY_GREEDY, write_checksum=0, write_content_size=0, write_dict_id=0)
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p)


def _pair(model: dict):
    kept = memo("toxicity")
    key = (hash(model["toxic"]), hash(model["ordinary"]))
    if key not in kept:
        kept.clear()
        kept[key] = (_compressor(model["ordinary"]), _compressor(model["toxic"]))
    return kept[key]


def savings(text: str | None, model: dict) -> tuple[int, int, int]:
    """The three largest savings of the text's windows."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    a, b = _pair(model)
    top = [0, 0, 0]
    for i in range(0, len(words), WINDOW_WORDS):
        w = b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" "
        d = len(a.compress(w)) - len(b.compress(w))
        if d > top[2]:
            top = sorted([*top[:2], d], reverse=True)
    return top[0], top[1], top[2]


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> list[float]:
    """Logistic regression by Newton steps, lightly regularised."""
    x1 = np.c_[np.ones(len(x)), x]
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(h, x1.T @ (p - y) + 0.1 * w)
    return w.tolist()


def score(text: str | None, model: dict | None) -> float:
    if not model:
        return 0.0
    w = model["weights"]
    s = savings(text, model)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + sum(a * b for a, b in zip(w[1:], s))))))


def _loss(x: np.ndarray, y: np.ndarray, w: list[float]) -> float:
    z = np.clip(w[0] + x @ np.array(w[1:]), -30, 30)
    return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))


def fit(rows: list[tuple], folds: int = 3, least_odds: tuple[float, ...] = LEAST_ODDS) -> dict | None:
    """rows (hash, text, label) -> model. The curve is calibrated on savings of each fold with dictionaries of the others; of
    `least_odds` that with the least logarithmic loss there is taken, the first of equal ones."""
    rows = sorted({t: (h, t, y) for h, t, y in rows}.values())
    whole = _Counts(rows)
    if not whole.toxic_rows or not whole.ordinary_rows:
        return None
    x, y = {odds: [] for odds in least_odds}, []
    for k in range(folds):
        part = _Counts([r for i, r in enumerate(rows) if i % folds != k])
        if part.toxic_rows and part.ordinary_rows:
            y += [float(label) for _, _, label in rows[k::folds]]
            for odds in least_odds:
                model = part.dictionaries(odds)
                x[odds] += [savings(t, model) for _, t, _ in rows[k::folds]]
    if not y:
        y = [float(label) for _, _, label in rows]
        for odds in least_odds:
            model = whole.dictionaries(odds)
            x[odds] = [savings(t, model) for _, t, _ in rows]
    y, x = np.array(y), {odds: np.array(v, float).reshape(-1, 3) for odds, v in x.items()}
    weights = {odds: _fit(v, y) for odds, v in x.items()}
    best = min(least_odds, key=lambda odds: _loss(x[odds], y, weights[odds]))
    return whole.dictionaries(best) | {"weights": weights[best]}


def train(docs: DataFrame, labels: DataFrame, learns, toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict | None:
    """learns: a condition on doc_id that holds for the learning fold. The driver holds the sampled texts."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learns).select("doc_id", (F.col("toxic") > 0).alias("y"), F.xxhash64("doc_id").alias("h")).distinct()
    text = F.substring("text", 1, sample_chars)
    rows = []
    for y, most in ((True, toxic_docs), (False, ordinary_docs)):
        sample = marked.where(F.col("y") == y).orderBy("h", "doc_id").limit(most)  # bounded, so the broadcast is
        found = docs.where("text is not null").select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id")
        rows += [(r["h"], r["text"], r["y"]) for r in found.orderBy("h", "text").limit(most).collect()]
    return fit(rows)


def _scorer(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([score(t.as_py(), model) for t in b["text"]], pa.float64())], ["doc_id", "score"])

    return run


def score_rows(docs: DataFrame, model: dict | None) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), "doc_id long, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 3) != 1)
    return score_rows(docs, model).select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
