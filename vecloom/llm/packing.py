"""Best-fit packing through a configuration linear program.

1. Tokens: each document becomes ids and the end id; only documents longer than a sequence are cut. A task counts its
   pieces per length, so a piece knows its rank among the task's pieces of its length. Stored once in the shared folder.
2. Plan, on the driver, from the length histogram alone (at most `capacity` numbers, whatever the corpus): the
   configuration program (fewest sequences, each filled by a pattern of lengths, so that every length is covered) is
   solved by multiplicative weights, a knapsack dynamic program being the pricing. Every round rounds its patterns to whole
   sequences; patterns that would leave room aren't used. What is left is placed best-fit, on counted groups of equal
   sequences. The program runs for a few curves of its prices; of these plans, taken whole or in part, and best-fit
   alone, the one of fewest sequences is used, and among those the one that owes most to the program.
3. Assignment: pieces of one length are interchangeable, so a piece's place follows from its rank among all pieces of
   its length: rank in its task plus the counts of earlier tasks. The plan (ranges of ranks per length) is a closed
   object of a size bounded by the number of lengths; no texts or ids are shuffled, no group is gathered.

Defined cases: null and empty texts have the end id alone; repeated rows are packed each; ids may be null; texts of any
length are cut into pieces of `capacity`; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import lookup, memo, ship, stored, table

CAPACITY, END_ID = 2048, 0
#: Pre-tokens a worker remembers the ids of (about 200 bytes each); it starts over when full, which costs time, not results.
REMEMBERED = 600_000
# Texts of these characters alone are cut into pre-tokens here (case and normal forms are settled char by char in them);
# any other text goes through the tokenizer whole.
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-©«-±¶-¸»¿-ÿ]")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


def _tokenizer(path: str):
    """(tokenizer, its remembered pre-tokens) of this worker."""
    kept = memo(f"pack {path}")
    if "tokenizer" not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        kept |= {"tokenizer": Tokenizer.from_file(path), "ids": {}}
    return kept["tokenizer"], kept["ids"]


def encode(text: str, path: str) -> bytes:
    """The tokenizer's ids (add_special_tokens=False) as little-endian unsigned 32-bit integers, through remembered
    pre-tokens where that is the same."""
    tok, known = _tokenizer(path)
    if _OTHER.search(text) or "<|" in text:
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    words = _SPLIT.findall(text.lower())
    found = list(map(known.get, words))
    if None in found:
        new = list(dict.fromkeys(w for w, ids in zip(words, found) if ids is None))
        made = {w: struct.pack(f"<{len(e.ids)}I", *e.ids) for w, e in zip(new, tok.encode_batch_fast(new, add_special_tokens=False))}
        found = [made[w] if ids is None else ids for w, ids in zip(words, found)]
        if len(known) + len(made) > REMEMBERED:
            known.clear()
        known.update((w, ids) for w, ids in made.items() if len(w) <= 64)
    return b"".join(found)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("rank_in_task", pa.int64())])


def _piece_maker(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, end = TaskContext.get().partitionId(), Counter(), end_id.to_bytes(4, "little")
        for b in batches:
            cols: list[list] = [[] for _ in PIECES]
            for doc, text in zip(b["id"].to_pylist(), b["t"]):
                raw = encode(text.as_py() or "", path) + end
                size = len(raw) // 4
                for i, start in enumerate(range(0, size, capacity)):
                    n = min(capacity, size - start)
                    for c, v in zip(cols, (doc, i, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), task, seen[n])):
                        c.append(v)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES)], schema=PIECES)

    return run


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank_in_task long"
    return stored(rows.mapInArrow(_piece_maker(tokenizer_path, capacity, end_id), schema), "pieces")


def price(values: np.ndarray, lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each room up to `room`, the highest value and the position of a length it ends with (-1: none)."""
    order = np.argsort(lengths, kind="stable")
    u, v = lengths[order], values[order]
    top, took = np.zeros(room + 1), np.full(room + 1, -1)
    ends = np.searchsorted(u, np.arange(room + 1), side="right").tolist()
    for c in range(int(u[0]), room + 1):
        gain = top[c - u[: ends[c]]] + v[: ends[c]]
        j = int(gain.argmax())
        top[c], took[c] = gain[j], order[j]
    return top, took


def configuration_program(stock: dict[int, int], capacity: int, curve: float, rounds: int = 40, share: float = 0.25, step: float = 1e-4) -> list[tuple[tuple, int]]:
    """Patterns ((length, how often), ...) of full sequences, and how many of each; they use no more than the stock.

    Prices are lengths, bent a little so that long ones are used first, times a weight. Each round, one knapsack gives every
    length the dearest sequence that holds it; of those that are full, whole sequences for a `share` of what is left of the
    length are taken; then the weights of lengths that lag behind the others grow."""
    lengths = np.array(sorted(stock, reverse=True))
    need = np.array([stock[n] for n in lengths.tolist()], np.int64)
    left, weight, out = need.copy(), 1 + 1e-5 * np.random.Generator(np.random.PCG64(1)).random(len(need)), []
    for _ in range(rounds):
        live = np.flatnonzero(left > 0)
        if not len(live):
            break
        u = lengths[live]
        _, took = price(u / capacity * (1 + curve * u / capacity) * weight[live], u, capacity)
        before = len(out)
        for at, i in enumerate(live.tolist()):
            pattern, room = Counter([i]), capacity - int(u[at])
            while room > 0 and took[room] >= 0:
                j = int(took[room])
                pattern[int(live[j])] += 1
                room -= int(u[j])
            if room:
                continue
            n = min(min(int(left[j]) // k for j, k in pattern.items()), -(-int(share * left[i]) // pattern[i]) or 1)
            if n > 0:
                for j, k in pattern.items():
                    left[j] -= n * k
                out.append((tuple((int(lengths[j]), k) for j, k in sorted(pattern.items())), n))
        if len(out) == before:
            break
        weight *= np.exp(step * (left / need - left.sum() / need.sum()))
    return out


def best_fit(groups: list[tuple[tuple, int, int]], stock: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Place all of stock (length -> count), longest first, each into the fullest sequence with room, on groups
    (lengths in it, free room, how many such sequences). Returns (lengths, how many)."""
    by_free: dict[int, dict[tuple, int]] = defaultdict(Counter)
    for held, free, n in groups:
        by_free[free][held] += n
    for length in sorted(stock, reverse=True):
        left = stock[length]
        free = length
        while left and free <= capacity:
            while left and by_free.get(free):
                held, n = by_free[free].popitem()
                fits = free // length
                full = min(n, left // fits)
                rest = left - full * fits if full < n else 0
                if full:
                    by_free[free - fits * length][held + ((length, fits),)] += full
                if rest:
                    by_free[free - rest * length][held + ((length, rest),)] += 1
                if n - full - (rest > 0):
                    by_free[free][held] += n - full - (rest > 0)
                left -= full * fits + rest
            free += 1
        fits = capacity // length
        if left >= fits:
            by_free[capacity - fits * length][((length, fits),)] += left // fits
        if left % fits:
            by_free[capacity - left % fits * length][((length, left % fits),)] += 1
    return [(held, n) for free in sorted(by_free) for held, n in by_free[free].items() if n]


CURVES, PARTS = (1e-3, 1e-2, 1e-1), (1.0, 0.75, 0.5, 0.25)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Groups of equal sequences ((length, how often), ...), how many: packs exactly the pieces of the histogram."""
    stock = {n: c for n, c in histogram.items() if c and n < capacity}
    done = [(((capacity, 1),), histogram[capacity])] if histogram.get(capacity) else []
    if not stock:
        return done
    tried = [(best_fit([], stock, capacity), 0)]
    for curve in CURVES:
        patterns = configuration_program(stock, capacity, curve)
        for part in PARTS:
            used = patterns[: int(part * len(patterns))]
            left = Counter(stock)
            for held, n in used:
                for length, k in held:
                    left[length] -= n * k
            tried.append((best_fit([(held, 0, n) for held, n in used], {n: c for n, c in left.items() if c}, capacity), sum(n for _, n in used)))
    return done + min(tried, key=lambda x: (sum(n for _, n in x[0]), -x[1]))[0]


def ranges(groups: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, per sequence, first sequence, first offset), by first rank."""
    at: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    sequence = 0
    for held, n in groups:
        offset = 0
        for length, k in held:
            out[length].append((at[length], k, sequence, offset))
            at[length] += k * n
            offset += k * length
        sequence += n
    return {n: np.array(r, np.int64) for n, r in out.items()}


def _placer(table_: dict[int, np.ndarray]):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(part):
                    continue
                n = int(length[part[0]])
                r = table_[n]
                hit = r[np.searchsorted(r[:, 0], rank[part], side="right") - 1]
                inside = rank[part] - hit[:, 0]
                seq[part], off[part] = hit[:, 2] + inside // hit[:, 1], hit[:, 3] + inside % hit[:, 1] * n
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["piece"], b["start"], b["length"], b["ids_crc32"], pa.array(seq), pa.array(off)], schema=schema)

    return run


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces() -> plus sequence_id and offset."""
    counts = stored(made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table_ = ranges(plan(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = stored(counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    ranked = made.join(lookup(bases), ["task", "length"]).withColumn("rank", F.col("base") + F.col("rank_in_task")).drop("task", "rank_in_task", "base")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placer(table_), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(df, id_col, text_col, tokenizer_path or default_tokenizer(), capacity, end_id), capacity)


def op4_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
