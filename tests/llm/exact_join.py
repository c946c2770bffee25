"""Exact components of similar texts, written apart from the operator: a prefix-filter join on one machine.

`python tests/llm/exact_join.py TABLE RESULT WIDTH` compares a result of op3 (Parquet: doc_id, n_shingles, component_id)
with the components of the documents in TABLE, and prints how many documents lie in another component."""

import hashlib
import re
import sys
from collections import defaultdict
from concurrent.futures import ProcessPoolExecutor
from functools import partial
from itertools import chain

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    got = {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return np.fromiter((int.from_bytes(hashlib.blake2b("\x00".join(s).encode("utf-8", "replace"), digest_size=8).digest(), "little") for s in got), np.uint64, len(got))


def components(ids, sets, percent=80):
    """id -> smallest id that links reach."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(x, y):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)

    first, of = {}, []
    for i, s in zip(ids, sets):
        if len(s):
            key = np.sort(s).tobytes()
            if key in first:
                join(i, first[key])
            else:
                first[key] = i
                of.append((i, s))
    if of:
        every, inverse, n = np.unique(np.concatenate([s for _, s in of]), return_inverse=True, return_counts=True)
        rank = np.empty(len(every), np.int64)
        rank[np.lexsort((every, n))] = np.arange(len(every))  # rare ones first
        cuts = np.cumsum([len(s) for _, s in of])[:-1]
        ranked = [np.sort(x) for x in np.split(rank[inverse], cuts)]
        seen = defaultdict(list)
        for at in sorted(range(len(of)), key=lambda a: len(ranked[a])):
            s = ranked[at]
            tried = {at}
            for t in s[: len(s) - -(-percent * len(s) // 100) + 1].tolist():
                for other in seen[t]:
                    if other not in tried:
                        tried.add(other)
                        if root(of[at][0]) != root(of[other][0]) and 100 * len(ranked[other]) >= percent * len(s):
                            both = len(np.intersect1d(s, ranked[other], assume_unique=True))
                            if 100 * both >= percent * (len(s) + len(ranked[other]) - both):
                                join(of[at][0], of[other][0])
                seen[t].append(at)
    return {i: root(i) for i in ids}


def exact(ids, texts, width, percent=80):
    with ProcessPoolExecutor(8) as pool:
        sets = list(pool.map(partial(shingle_set, width=width), texts, chunksize=500))
    return components(ids, sets, percent), dict(zip(ids, map(len, sets)))


if __name__ == "__main__":
    import pyarrow.dataset as ds

    docs, got = (ds.dataset(p).to_table() for p in sys.argv[1:3])
    want, n = exact(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), int(sys.argv[3]))
    rows = list(zip(*(got[c].to_pylist() for c in ("doc_id", "n_shingles", "component_id"))))
    wrong = [d for d, _, c in rows if want[d] != c]
    print(f"{len(rows)} documents, {len(set(want.values()))} components; {len(wrong)} in another component, {sum(n[d] != k for d, k, _ in rows)} with another set size, {len(set(chain(want)) - {d for d, _, _ in rows})} missing", wrong[:10])
