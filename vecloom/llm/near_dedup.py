"""MinHash near-dedup as a chosen-path set similarity join.

A document's set is its distinct shingles (64-bit hashes). Documents of equal sets form a class and go on as its
smallest id, so copies never meet pairwise. Each class has TOKENS minwise tokens. A tree starts by branching classes on
one token; TREES independent trees give the recall.

1. The first FIRST trees deal each node to blocks of about CROWD classes, which are compared exhaustively. That connects
   nearly everything that is alike, and large groups of near copies almost wholly.
2. In the other trees, nodes within one component are done. Of an open node, the classes outside its largest component
   go to every block of that component, if there are at most FEW of them (so a node's rows at most treble). Otherwise
   the node branches again on further tokens: on one, and for one node in four on two (1.25 on average, one over the
   similarity). Nodes that are still crowded after STEPS are compared by pairs of blocks, so nothing is dropped.

A block is compared in its task, in two passes. The first compares sketches (one byte a token) of classes of different
components and yields the rows that may be similar to another one, in clusters; a cluster that several trees find is
taken once. The second has the whole texts of a cluster, counts all intersections of full sets, and returns a forest of
the links that hold. So no pair of documents is ever a row, and each pass gives at most a row for each of its rows.
A sketch rules a pair out where under CUT of its tokens agree (a true pair fails that about once in 10^5).

Scale: blocks are bounded in classes and in shingles; nodes are counted by partial aggregates and joined back by a
checked broadcast or a skew-splitting join; components are found by alternating large and small stars until a round
changes nothing; every table goes to the shared folder; the driver sees counts only.

Defined cases: null and empty texts, or texts without a word, have an empty set: component_id = doc_id, kept; fewer
words than a shingle: the sequence is one shingle; rows with one id are one document (repeated rows are copies of each
other, and different texts of one id all link it); a null id is only ever a copy (component of its class, or null) and is
kept by `drop_near_copies`, which of the repeated rows of a kept id keeps one; an empty table gives no rows; extra
columns are carried by `drop_near_copies` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._shared import dropped, memo, ship, stored, table, whole_row

TREES, FIRST, TOKENS, CUT = 16, 2, 96, 0.62
#: Classes and shingles of a block (one class with more is a block of its own), and classes that may go to every block.
CROWD, CROWD_SHINGLES, FEW = 256, 1_000_000, 512
#: Tokens that an open node branches on before it is looked at again.
STEPS = (1, 1, 1, 1, 1, 1, 2, 4, 4, 4)
#: This operator joins many tables in turn, so each is broadcast only while it is small; executors keep them for a while.
MOST_BROADCAST = 40_000
#: Rows (of 24 bytes) of clusters up to which they are broadcast to the texts; beyond it texts are shuffled to them.
MOST_MET = 400_000
REMEMBERED = 300_000
_P = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_rng = np.random.Generator(np.random.PCG64(20_231))
_A = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of `width` words."""
    if not text:
        return np.zeros(0, np.uint64)
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, and white space as U+0020, U+0009 to U+000D
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    known = memo("shingle words")
    try:
        h = np.array([known[w] for w in words], np.uint64)
    except KeyError:
        if len(known) > REMEMBERED:
            known.clear()
        own = {w: known.get(w) or xxhash.xxh3_64_intdigest(w) for w in words}
        known.update((w, x) for w, x in own.items() if len(w) <= 64)
        h = np.array([own[w] for w in words], np.uint64)
    n = len(h) - width + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(_P[0]) + h[i : i + n]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(_mixed(mixed))


def minwise(s: np.ndarray) -> np.ndarray:
    """TOKENS minwise values (32 bits) of a set that isn't empty."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        x = s[at : at + 2048][None, :] * _A[:, None] + _B[:, None]
        x ^= x >> np.uint64(32)
        np.minimum(low, (x * np.uint64(_P[5])).min(axis=1), out=low)
    return (low >> np.uint64(16)).astype(np.uint32)


FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("tokens", pa.binary()), ("sketch", pa.binary())])
ROWS = "node long, tree int, rep long, c long, n long"
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _featurer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sig, tok, sketch = [], [], [], []
            for t in b["t"]:
                s = shingles(t.as_py(), width)
                low = minwise(s).astype("<u4") if len(s) else None
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                tok.append(low.tobytes() if len(s) else None)
                sketch.append(low.astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (sig, tok, sketch))], schema=FEATURES)

    return run


def _brancher(depth: int, steps: int):
    """Rows of open nodes with their tokens -> the rows of their nodes `steps` tokens deeper."""

    def child(node, tree, tok, at, d):
        return _mixed(node * np.uint64(_P[0]) + tok[np.arange(len(tree)), at] * np.uint64(_P[1]) + (at + TOKENS * d).astype(np.uint64) * np.uint64(_P[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, tree = b["node"].to_numpy().view(np.uint64), b["tree"].to_numpy()
            tok = np.frombuffer(b"".join(b["tokens"].to_pylist()), "<u4").reshape(-1, TOKENS).astype(np.uint64)
            row = np.arange(b.num_rows)
            for d in range(depth, depth + steps):
                layer, t = TREES * (d % (TOKENS // TREES)), tree[row]
                two = np.flatnonzero(_mixed(node + np.uint64(_P[3])) % np.uint64(4) == 0)
                first = child(node, t, tok[row], (t + 5 * d) % TREES + layer, d)
                second = child(node[two], t[two], tok[row[two]], (t[two] + 5 * d + TREES // 2) % TREES + layer, d)
                node, row = np.concatenate([first, second]), np.concatenate([row, row[two]])
            cols = [pa.array(node.view(np.int64)), *(b[c].take(pa.array(row)) for c in ("tree", "rep", "c", "n"))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "tree", "rep", "c", "n"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of equal keys; the rows come sorted by them."""
    held: dict = {}
    for b in batches:
        if not b.num_rows:
            continue
        cols = {n: b[n].to_numpy(zero_copy_only=False) for n in b.schema.names}
        if held:
            cols = {n: np.concatenate([held[n], x]) for n, x in cols.items()}
        new = np.any([cols[k][1:] != cols[k][:-1] for k in keys], axis=0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for s, e in zip(cuts, cuts[1:]):
            yield {n: x[s:e] for n, x in cols.items()}
        held = {n: x[cuts[-1] :] for n, x in cols.items()}
    if held:
        yield held


class _Forest:
    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _clusters(c: np.ndarray, n: np.ndarray, part: np.ndarray, sketch: np.ndarray, percent: int) -> list[np.ndarray]:
    """Rows of a block that may be similar to one of another component (and part, if the block has two parts)."""
    found, across = _Forest(), len(np.unique(part)) > 1
    for i in range(len(c) - 1):
        ok = (c[i + 1 :] != c[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))
        if across:
            ok &= part[i + 1 :] != part[i]
        at = np.flatnonzero(ok) + i + 1
        if len(at):
            for j in at[(sketch[at] == sketch[i]).sum(1) >= CUT * TOKENS].tolist():
                found.join(i, j)
    out: dict[int, list] = {}
    for i in sorted(found.parent):
        out.setdefault(found.root(i), []).append(i)
    return [np.array(x) for x in out.values()]


MET = "cluster long, rep long, c long"


def _meeter(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, ["node", "block"]):
            if len(g["c"]) < 2 or (g["c"] == g["c"][0]).all():
                continue
            sketch = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(-1, TOKENS)
            for at in _clusters(g["c"], g["n"], g["part"], sketch, percent):
                rep = g["rep"][at]
                name = xxhash.xxh3_64_intdigest(np.unique(rep).tobytes()) - (1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name)), pa.array(rep), pa.array(g["c"][at])], ["cluster", "rep", "c"])

    return run


def links(c: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the links between rows of different components c whose sets (none empty) are similar: all pairs are counted."""
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(size)))
    forest, mark, left, out = _Forest(), np.zeros(len(code), bool), len(np.unique(c)), []
    for i in range(len(sets) - 1):
        if left == 1:
            break
        own = code[starts[i] : starts[i + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[code[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1], dtype=np.int64)
        mark[own] = False
        for j in (np.flatnonzero((100 * both >= percent * (size[i] + size[i + 1 :] - both)) & (c[i + 1 :] != c[i])) + i + 1).tolist():
            if forest.join(int(c[i]), int(c[j])):
                out.append((max(int(c[i]), int(c[j])), min(int(c[i]), int(c[j]))))
                left -= 1
    return out


def _linker(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, ["cluster"]):
            sets = [shingles(t, width) for t in g["text"]]
            some = [i for i, s in enumerate(sets) if len(s)]
            if found := links(g["c"][some], [sets[i] for i in some], percent):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=LINK)

    return run


def lookup(df: DataFrame) -> DataFrame:
    """The shared one at this operator's bound; single columns of ids take the shared bound."""
    return _shared.lookup(df, MOST_BROADCAST)


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach. Alternating large and small stars, each round stored, until
    one changes nothing; with `rounds`, it raises where so many don't suffice."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    for n in count() if before[0] else ():
        if n == rounds:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).persist()
        large = both.join(lookup(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().persist()
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).persist()
        joined = large.join(lookup(low2), "u").select("u", "v", "m")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, e = e, stored(small, "small")
        for d in (low2, large, low):  # kept while the round runs; a lost part is computed again from the round's stored edges
            d.unpersist()
        dropped(old)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class _Join:
    """One run of the join over the rows of a table."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        ship(df.sparkSession)
        self.width, self.percent = width, percent
        self.rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
        self.features = stored(self.rows.mapInArrow(_featurer(width), "doc_id long, n_shingles long, sig binary, tokens binary, sketch binary"), "features")
        with_set = self.features.where("sig is not null").groupBy("sig")
        self.classes = stored(with_set.agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "classes")
        self.reps = self.classes.where("rep is not null").select("rep", "n", "tokens", "sketch")
        twice = self.features.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
        self.repeated = stored(twice, "repeated")
        self.any_repeated = bool(self.repeated.limit(1).count())

    def first_rows(self, reps: DataFrame, trees: range) -> DataFrame:
        """reps(rep, c, n, tokens) -> ROWS of the trees' first nodes."""
        node = lambda t: F.xxhash64(F.lit(t), F.substring("tokens", t * 4 + 1, 4))
        each = F.explode(F.array(*[F.struct(node(t).alias("node"), F.lit(t).alias("tree")) for t in trees])).alias("x")
        return reps.select(each, "rep", "c", "n").select("x.node", "x.tree", "rep", "c", "n")

    def dealt(self) -> DataFrame:
        """The first trees' rows in blocks."""
        rows = self.first_rows(self.reps.withColumn("c", F.col("rep")), range(FIRST))
        nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("weight")).where("total > 1")
        nodes = stored(nodes.select("node", _blocks(F.col("total"), F.col("weight")).alias("blocks")), "first")
        rows = rows.join(lookup(nodes), "node")
        return rows.select("node", F.pmod(F.xxhash64("rep", "node"), F.col("blocks")).alias("block"), F.lit(0).cast("long").alias("part"), "rep", "c", "n")

    def opened(self, rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """The rows of nodes of several components, and (node, top, blocks, few): a node's largest component, its blocks, and whether few classes lie outside it."""
        ends = rows.groupBy("node").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("node")
        rows = rows.join(_shared.lookup(stored(ends, f"open{level}")), "node", "left_semi")
        rows = stored(rows, f"opened{level}")
        per = rows.groupBy("node", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
        node = per.groupBy("node").agg(F.sum("k").alias("total"), F.sum("w").alias("weight"), F.max(F.struct("k", "c", "w")).alias("top"))
        few = (F.col("total") - F.col("top.k") <= FEW) & (F.col("weight") - F.col("top.w") <= CROWD_SHINGLES)
        blocks = F.when(few, _blocks(F.col("top.k"), F.col("top.w"))).otherwise(_blocks(F.col("total"), F.col("weight")))
        return rows, stored(node.select("node", F.col("top.c").alias("top"), blocks.alias("blocks"), few.alias("few")), f"nodes{level}")

    def branched(self, comps: DataFrame) -> list[DataFrame]:
        """Blocks of the other trees: what lies in open nodes."""
        known = self.reps.join(lookup(comps).select(F.col("node").alias("rep"), F.col("component")), "rep", "left")
        known = known.select("rep", F.coalesce("component", "rep").alias("c"), "n", F.substring("tokens", 1, 4 * TREES).alias("tokens"))
        rows, out, depth = self.first_rows(stored(known, "known"), range(FIRST, TREES)), [], 1
        block = F.pmod(F.xxhash64("rep", "node"), F.col("blocks"))
        every = F.expr("sequence(0L, blocks - 1)")
        for level, steps in enumerate((*STEPS, 0)):
            rows, nodes = self.opened(rows, level)
            opened = rows.join(lookup(nodes), "node")
            few = opened.where("few").withColumn("block", F.explode(F.when(F.col("c") == F.col("top"), F.array(block)).otherwise(every)))
            out.append(few.select("node", "block", F.lit(0).cast("long").alias("part"), "rep", "c", "n"))
            if not nodes.where("not few").limit(1).count():
                return out
            opened = opened.where("not few")
            if steps:
                many = opened.select("node", "tree", "rep", "c", "n").join(self.reps.select("rep", "tokens"), "rep")
                rows = stored(many.mapInArrow(_brancher(depth, steps), ROWS), f"rows{level}")
                depth += steps
        pairs = opened.withColumn("part", block).withColumn("other", F.explode(every))
        pair = F.least("part", "other") * F.col("blocks") + F.greatest("part", "other")
        return [*out, pairs.select("node", pair.alias("block"), "part", "rep", "c", "n")]

    def linked(self, blocks: list[DataFrame], name: str) -> DataFrame:
        """Blocks (node, block, part, rep, c, n) -> components of the components c that their links connect."""
        rows = reduce(DataFrame.unionByName, blocks).join(self.reps.select("rep", "sketch"), "rep")
        met = rows.repartition("node", "block").sortWithinPartitions("node", "block", "rep").mapInArrow(_meeter(self.percent), MET)
        met = stored(met.distinct(), f"met_{name}")
        texts = self.rows.select(F.col("id").alias("rep"), F.col("t").alias("text"))
        full = texts.join(_shared.lookup(met, MOST_MET), "rep")  # texts move once, to their clusters, while met is small
        if self.any_repeated:
            full = full.dropDuplicates(["cluster", "rep", "text"])
        found = full.repartition("cluster").sortWithinPartitions("cluster", "rep").select("cluster", "c", "text").mapInArrow(_linker(self.width, self.percent), "a long, b long")
        return stored(components(found), f"components_{name}")

    def run(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id."""
        comps = self.linked([self.dealt()], "first")
        more = self.linked(self.branched(comps), "more")
        f, of = self.features, self.classes.select("sig", "rep")
        for n, known in enumerate((comps, more)):
            of = of.join(lookup(known).select(F.col("node").alias("rep"), F.col("component").alias(f"c{n}")), "rep", "left").select("sig", F.coalesce(f"c{n}", "rep").alias("rep"))
        out = f.where("sig is not null").join(lookup(stored(of, "of_class")), "sig").select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
        return out.unionByName(f.where("sig is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _blocks(classes: F.Column, weight: F.Column) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(classes / CROWD), F.ceil(weight / CROWD_SHINGLES)).cast("long")


def _groups(join: _Join) -> DataFrame:
    return join.run().withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links are 100 * intersection >= percent * union."""
    return _groups(_Join(df, id_col, text_col, width, percent))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns."""
    join = _Join(df, id_col, text_col, width, percent)
    gone = _groups(join).where("not kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    rows = df.select(whole_row(df), F.col(id_col).cast("long").alias("id")).join(_shared.lookup(stored(gone, "gone")), "id", "left_anti")
    if join.any_repeated:
        again = lookup(join.repeated)
        rows = rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").dropDuplicates(["id"]))
    return rows.select("doc.*")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=4, percent=80)
