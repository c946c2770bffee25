"""The training-data operators on a fixture of nulls, empty and long texts, ties, repeated rows and clashing columns."""

import gzip
import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import exact_join
from vecloom.llm import chat, exact_dedup, language_id, mixing, near_dedup, packing, pii, registry, topk, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, group_size int, doc string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def base(n):
    r = np.random.default_rng(n)
    return " ".join("".join(r.choice(list("abcdeé"), 4)) for _ in range(60))


@pytest.fixture(scope="module")
def rows():
    near = base(1).split()
    texts = [None, "", "   ", "a", "one two three", base(1), base(1), " ".join([*near[:59], "zz"]), " ".join(["Zz", *near[1:]]), base(2).upper(), base(2), base(3) * 400, "x" * 100_000, "é" * 50, "<|endoftext|> İΣ x́", base(4)]
    out = [(i, t, None if i % 5 == 4 else "de", None if i % 7 == 3 else f"s{i % 3}", None, "no", 1, "d") for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, base(9), None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, empty, rows):
    top = defaultdict(list)
    for r in rows:
        top[r[1] or ""].append(r[0])
    for most in (1_000_000, 0):  # by broadcast, and without
        got = exact_dedup.exact_groups(docs, digest_all=True, max_broadcast_rows=most).collect()
        assert len(got) == len(rows)
        assert sorted(map(repr, ((r["id"], r["keep_id"], r["group_size"], r["sha"]) for r in got))) == sorted(repr((r[0], max((x for x in top[r[1] or ""] if x is not None), default=None), len(top[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest())) for r in rows)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(top)
    assert exact_dedup.exact_groups(empty).count() == exact_dedup.drop_exact_copies(empty).count() == 0


def shingles(t, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[i : i + n]) for i in range(len(w) - n + 1)))


def brute_components(rows, n):
    sets = [(r[0], shingles(r[1], n)) for r in rows if r[0] is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, a in sets:
        for e, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    return {d: (find(d), len(s)) for d, s in sets}


def near_result(df, **options):
    return {x["doc_id"]: (x["component_id"], x["n_shingles"]) for x in near_dedup.near_groups(df, **options).collect() if x["doc_id"] is not None}


def test_near(docs, empty, rows):
    got = near_dedup.near_groups(docs, width=4).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None} == brute_components(rows, 4)
    kept = near_dedup.drop_near_copies(docs)
    one_each = [d for d, (c, _) in brute_components(rows, 5).items() if c == d]  # and the row without an id
    assert kept.columns == docs.columns and sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, [*one_each, None]))
    assert near_dedup.near_groups(empty).count() == near_dedup.drop_near_copies(empty).count() == 0


def test_near_large_group_chain_and_repeated_rows(spark):
    r, words = np.random.default_rng(5), base(7).split()
    rows, chain = [], list(words)
    for i in range(200):  # a group in which most are alike
        w = list(words)
        w[int(r.integers(60))] = f"q{i}"
        rows.append((i, " ".join(w)))
    for i in range(200, 260):  # a chain whose ends differ
        chain[i % 60] = f"c{i}"
        rows.append((i, " ".join(chain)))
    want = brute_components(rows, 4)
    rows += [rows[3]] * 200 + [rows[259]] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_result(df, width=4) == want
    assert sorted(x["doc_id"] for x in near_dedup.drop_near_copies(df, width=4).collect()) == sorted(d for d, (c, _) in want.items() if c == d)


@pytest.mark.parametrize("crowd,steps", [(128, near_dedup.STEPS), (8, (1, 2)), (8, ())])
def test_near_around_a_passage(spark, monkeypatch, crowd, steps):
    """Documents around one passage, nearly all too different to link: their nodes hardly shrink. As one block, branched, and as pairs of blocks."""
    r, passage = np.random.default_rng(6), [f"p{i}" for i in range(100)]
    rows = [(i, " ".join([*passage, *(f"w{x}" for x in r.integers(0, 10**9, 26))])) for i in range(90)]
    for i in range(90, 100):  # each is linked to one other only
        rows.append((i, " ".join([*rows[i - 60][1].split()[:-10], *(f"v{x}" for x in r.integers(0, 10**9, 10))])))
    want = brute_components(rows, 4)
    assert sum(c != d for d, (c, _) in want.items()) == 10
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "FEW", crowd)
    monkeypatch.setattr(near_dedup, "STEPS", steps)
    assert near_result(spark.createDataFrame(rows, "doc_id long, text string"), width=4) == want


def test_near_recall_on_a_table_with_hot_groups(spark, sf):
    """Against an exact join: the documents of sf0.1, copies of a text, near copies of one around the limit, and a common passage."""
    r, words, passage = np.random.default_rng(9), base(8).split(), " ".join(f"p{i}" for i in range(40))
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").collect()][::4]
    docs += [(10**6 + i, base(3)) for i in range(600)] + [(2 * 10**6 + i, f"{passage} {base(1000 + i)[:200]}") for i in range(600)]
    for i in range(600):
        docs.append((3 * 10**6 + i, " ".join(w if r.random() > 0.03 else f"n{r.integers(10**9)}" for w in words)))
    want, sizes = exact_join.exact(*zip(*docs), 4)
    got = near_result(spark.createDataFrame(docs, "doc_id long, text string"), width=4)
    assert all(got[d][1] == n for d, n in sizes.items())
    linked = [d for d, c in want.items() if c != d]
    assert len(linked) > 900 and sum(got[d][0] == want[d] for d in linked) >= 0.99 * len(linked)
    assert all(got[d][0] == d for d, c in want.items() if c == d)


def test_pack(docs, empty, rows):
    path = packing.default_tokenizer()
    tok = packing._tokenizer(path)[0]
    want = []
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for i, s in enumerate(range(0, len(ids), 2048)):
            b = ids[s : s + 2048]
            want.append(repr((r[0], i, s, len(b), zlib.crc32(np.array(b, "<u4").tobytes()))))
    got = packing.pack_documents(docs).collect()
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(want)
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 2048
    assert packing.pack_documents(empty).count() == 0


def draws(name):
    r = np.random.default_rng(3)
    return {"many sizes": r.lognormal(6, 1, 50_000), "short": r.lognormal(5, 1.5, 50_000), "medium": r.lognormal(6.8, 0.5, 50_000), "even": r.integers(300, 2048, 20_000), "few": np.full(30, 700), "one": np.array([5])}[name]


@pytest.mark.parametrize("name", ["many sizes", "short", "medium", "even", "few", "one"])
def test_pack_plan(name):
    """Never more sequences than best-fit alone; where the histogram allows full sequences, most come from the program."""
    h = {int(n): int(k) for n, k in zip(*np.unique(np.clip(draws(name), 1, 2048).astype(int), return_counts=True))}
    groups = packing.plan(h)
    packed = defaultdict(int)
    for held, n in groups:
        assert sum(a * b for a, b in held) <= 2048
        for length, k in held:
            packed[length] += k * n
    assert packed == h
    full = {(2048, 1): h.pop(2048)} if 2048 in h else {}
    total, alone = sum(n for _, n in groups) - sum(full.values()), sum(n for _, n in packing.best_fit([], h, 2048))
    assert -(-sum(a * b for a, b in h.items()) // 2048) <= total <= alone
    if name in ("many sizes", "short", "medium", "even"):
        patterns = {p for c in packing.CURVES for p, _ in packing.configuration_program(h, 2048, c)}
        assert sum(n for held, n in groups if held in patterns) >= 0.45 * total


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "u+61", "a|>b", "<|x"])
@pytest.mark.parametrize("text", ["", " ", "\\", "a\\", "\\\\<", chat.TRAP, "[INST] hi", "<<SYS>>x<</SYS>>", "<|user|>", "|>", "<s>", " [/INST]", "é\n😀"])
def test_chat_round_trip(role, text):
    s = chat.render_turn(role, text)
    assert chat.parse_conversation(chat.BEGIN + s + chat.render_turn("user", "x")) == [(role, text), ("user", "x")]


def test_chat_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, None), (2, 5, "assistant", chat.TRAP)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[2]["loss_sha256"] == hashlib.sha256(chat.TRAP.encode()).hexdigest() and got[2]["loss_chars"] == len(chat.TRAP)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_mix(docs, empty, rows, spark, sf):
    big = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    take = lambda: mixing.mix(mixing._sizes(big, "doc_id", "text", "source"), block_rows=16)
    got = take()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, take().collect()))
    per = got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] and r["most"] <= 2 for r in per)
    small = mixing.mix(mixing._sizes(docs, "doc_id", "text", "source"))
    assert small.count() == len(rows)
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.mix(mixing._sizes(empty, "doc_id", "text", "source")).count() == 0


def test_warc(spark, tmp_path):
    long_ = "p" * 1200
    pages = spark.createDataFrame([(1, "http://a/\r\nx", long_), (2, None, long_), (3, "http://b", "s"), (4, "http://c", "s"), (5, "http://d", None), (None, "http://e", long_ + "é")], "page_id long, url string, html string")
    for gz in ("gzip", "none"):
        path = f"file://{tmp_path}/{gz}"
        warc.write_warc(warc.with_revisits(pages, "page_id", "url", "html", 1000), path, compression=gz)
        back = warc.read_warc(spark, path)
        got = {r["record_id"]: r for r in back.collect()}
        assert got["urn:page:1"]["record_type"] == "revisit" and got["urn:page:1"]["refers_to"] == "urn:page:2" and got["urn:page:1"]["payload_length"] == 1200
        assert bytes(got["urn:page:2"]["payload"]) == long_.encode() and got["urn:page:4"]["record_type"] == "response" and bytes(got[None]["payload"]) == (long_ + "é").encode()
        assert got["urn:page:1"]["target_uri"] == "http://a/\r\nx"
        assert back.where("record_type = 'revisit'").count() == 1
        assert back.where("target_uri like 'http://b%'").count() == 1
        assert warc.read_warc(spark, path, payload="false").where("payload is not null").count() == 0
    nothing = f"file://{tmp_path}/nothing"
    warc.write_warc(warc.with_revisits(pages.limit(0), "page_id", "url", "html", 1000), nothing)
    assert warc.read_warc(spark, nothing).count() == 0


def test_topk(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(50)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (None, [1.0] * 8), (1003, [1e30] * 8), (1050, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = topk.exact_topk(df, df.where("vec_id % 50 = 0"), 5, "vec_id", "embedding", fan_in=2).collect()
    codes = {i: np.floor(256 * np.array(v)).clip(-9.2233720368547e18, 9.2233720368547e18).astype(np.int64).astype(object) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in codes:
        if q % 50 == 0:
            s = sorted((-max(topk.LOW + 1, min(-topk.LOW - 1, int((codes[q] * c).sum()))), i) for i, c in codes.items() if i != q and len(c) == len(codes[q]))[:5]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.exact_topk(df.limit(0), df.limit(0), 5, "vec_id", "embedding").count() == 0


def test_toxicity(spark, docs, empty):
    r = np.random.default_rng(2)
    texts = [(int(i), " ".join(base(100 + i).split()[:50] + (["grumble", "vexation"] * (i % 4 == 0)))) for i in range(300)]
    labels = [(i, int(i % 4 == 0)) for i, _ in texts] + [(None, 1), (5000, None)]
    d, lab = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab, F.col("doc_id") % 2 == 0)
    got = {x["doc_id"]: x["score"] for x in toxicity.score_rows(d, model).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i, _ in texts]) > 0.95
    assert toxicity.score_rows(docs, model).count() == docs.count() and toxicity.train(empty, lab, F.lit(True)) is None
    assert all(x["score"] == 0 for x in toxicity.score_rows(docs, None).collect()) and r is not None


def test_language(spark, sf, docs, empty):
    big = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    out = registry.QUERIES["op9_language_id"](spark, sf.replace("0.001", "0.01")).join(big.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang_pred = lang").count() / out.count() > 0.97
    model = language_id._train_documents(big)
    assert {language_id.identify(t, model)[0] for t in (None, "", " ", "123 !")} == {"und"}
    assert language_id.keep_identified(docs).columns == docs.columns
    assert language_id.keep_identified(empty).count() == 0


UNSPACED = {"zh": "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", "ja": "いろはにほへとちりぬるをわかよたれそつねならむ", "th": "กขคงจชซดตถทธนบปผพฟมยรลวสหอ"}


def test_language_of_scripts_without_blanks(spark):
    r, rows = np.random.default_rng(4), []
    for lang, letters in UNSPACED.items():
        words = ["".join(r.choice(list(letters), 2)) for _ in range(60)]
        rows += [(f"{lang}{i}", "".join(r.choice(words, 80)), lang) for i in range(60)]
    rows += [(f"xx{i}", base(i), "xx") for i in range(60)]
    df = spark.createDataFrame(rows, "key string, text string, lang string").withColumn("learns", F.crc32("key") % 3 != 0)
    model = language_id.train(df.where("learns"), "text", "lang", F.col("key"))
    assert set(model) == {*UNSPACED, "xx"} and all(len(d) > 100 for d in model.values())
    held = df.where("not learns").collect()
    assert np.mean([language_id.identify(x["text"], model)[0] == x["lang"] for x in held]) > 0.97
    again = language_id.train(df.where("learns").unionByName(df.where("learns")).repartition(7), "text", "lang", F.col("key"), sample_docs=200)
    assert again == language_id.train(df.where("learns").unionByName(df.where("learns")), "text", "lang", F.col("key"), sample_docs=200)
    twice = language_id.identify_rows(spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1]), (None, None)], "doc_id long, text string"), "doc_id", "text", model).collect()
    assert sorted(x["lang_pred"] for x in twice) == ["und", "zh", "zh"]
    same = language_id.dictionary([base(0), base(1)])
    assert language_id.identify(base(5), {"b": same, "a": same}) == ("a", 0.0, 0.0)  # ties go to the first by name


def test_toxicity_query_on_held_out_rows(spark, sf):
    """The query itself against the labels it may not learn from, and against a direct computation."""
    d = sf.replace("0.001", "0.1")
    labels, docs = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("labels", "documents"))
    out = registry.QUERIES["op8_toxicity"](spark, d).join(labels, "doc_id").where("held_out and toxic is not null").cache()
    hit, said, toxic = (out.where(c).count() for c in ("predicted = 1 and toxic = 1", "predicted = 1", "toxic = 1"))
    assert toxic > 50 and hit >= 0.5 * toxic and hit >= 0.8 * said  # 305 toxic rows to learn from in four languages; README has larger tables
    rows = [(r["doc_id"], r["text"], r["toxic"]) for r in docs.join(labels, "doc_id").where("toxic is not null and text is not null").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    h = {r["doc_id"]: r["h"] for r in labels.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    kinds = [sorted((h[i], t, bool(y)) for i, t, y in rows if bool(y) == k)[:n] for k, n in ((True, toxicity.TOXIC_DOCS), (False, toxicity.ORDINARY_DOCS))]
    model = toxicity.fit([(a, t[: toxicity.SAMPLE_CHARS], y) for a, t, y in kinds[0] + kinds[1]])
    some = out.join(docs.select("doc_id", "text"), "doc_id").orderBy("doc_id").limit(50).collect()
    assert all(abs(toxicity.score(r["text"], model) - r["score"]) < 1e-9 for r in some)


def test_components_are_settled(spark):
    order = np.random.default_rng(3).permutation(300).tolist()
    edges = spark.createDataFrame([*zip(order[:200], order[1:200]), *zip(order[200:], order[201:])], "a long, b long")
    want = {n: min(part) for part in (order[:200], order[200:]) for n in part}
    assert {r["node"]: r["component"] for r in near_dedup.components(edges).collect()} == want
    with pytest.raises(RuntimeError, match="not settled"):
        near_dedup.components(edges, rounds=1)


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))), ("card", "[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))), ("phone", "\\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15)]


def test_pii_base_is_the_patterns():
    r = np.random.default_rng(8)
    alphabet = list("ab@.+-() 0123456789%é_") + ["4111111111111111", "10.0.0.1", "a@b.c", "+1 (523) 555-1055"]
    w = pii.weights()
    for _ in range(3000):
        t = "".join(r.choice(alphabet, int(r.integers(1, 30))))
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, t) if ok(m.group()))
        b, every = pii.all_spans(t, w)
        assert b == want, t
        assert set(b) <= set(every)


def test_pii_adds_and_is_linear(docs, empty):
    w = pii.weights()
    assert [x[1] for x in pii.all_spans("please call (523) 555-1055 now", w)[1]] == [3]
    assert pii.all_spans("on 2020-01-02 version 2.10 of 12345 rows", w)[1] == []
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1 " * 100_000, "@" * 50_000, "+1(" * 50_000):
        pii.all_spans(t, w)
    assert pii.find_personal_data(docs).count() == docs.count() and pii.find_personal_data(empty).count() == 0


def test_pii_regions_are_not_cut():
    w = pii.weights()
    found = lambda t: [t[s:e] for s, _, e in pii.all_spans(t, w)[1]]
    assert found("5 a b c john (at) x (dot) com") == ["john (at) x (dot) com"]
    for gap in range(20):  # words between the hints of two entities
        assert found(f"call (523) 555-1055 {'la ' * gap}mira (at) ver (dot) com") == ["(523) 555-1055", "mira (at) ver (dot) com"], gap
    for n in range(140):  # tokens before the entity, dense with digits
        for e in ("(523) 555-1055", "mira (at) ver (dot) com"):
            t = " ".join(("12", "la")[i % 2] for i in range(n)) + f" la {e} la" + " 12 la" * 40
            assert found(t) == [e], n


def test_pii_scores_every_trained_spelling():
    w = pii.weights()
    text, gold, at = [], [], 0
    for tokens, spans in pii._sentences(99, 1000):
        arcs = pii._arcs(tokens)
        assert all(i in [x for x, _ in arcs[j]] for i, j, _ in spans), tokens
        text += tokens
        gold += [" ".join(tokens[i:j]).rstrip(".,") for i, j, _ in spans]
    text = " ".join(text)
    every = [text[s:e] for s, _, e in pii.all_spans(text, w)[1]]
    assert sum(g in every for g in gold) > 0.99 * len(gold) and sum(e in gold for e in every) > 0.99 * len(every)
    card = "4111 1111 1111 1111".split()
    spelled = [x.join(["10", "0", "0", "1"]) for x in ("[.]", " dot ", "(dot)", "[dot]")] + [x.join(card) for x in (". ", ".", " - ", "/")]
    spelled += [f"anna{a}example{o}com" for a, o in ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), ("(at)", "."))]
    for e in spelled:
        t = "mira ver la " * 20 + e + " la mira" * 20
        assert [t[s:f] for s, _, f in pii.all_spans(t, w)[1]] == [e]
        if " " not in e:  # in text without blanks
            t = "mira,ver;" * 40 + e + "," + "la,mira;" * 40
            assert [t[s:f] for s, _, f in pii.all_spans(t, w)[1]] == [e]
    for t in ("look at mira la", "1. 2. 3. 4. 5. la", "1234567.².3.4 la", "at la dot la 12"):
        assert pii.all_spans(t, w)[1] == [], t


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    e = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in e.description]
    cols = sorted(names)
    assert sorted(df.columns) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in cols) for r in e.fetchall()), key=repr)


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """source -> target: pour into the sources by weight until all is given, those that are full stepping out."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, out, due = set(names), {}, share * sum(sizes.values())
    while open_:
        level = due / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            due -= out[s]
        open_ -= full
    return out


def sizes_of(rows):
    out = defaultdict(int)
    for r in rows:
        out[r[3]] += len(WORD.findall(r[1] or ""))
    return dict(out)


def near_targets(rows, taken):
    """taken: source -> words. Near: by no more than a middling document of the source, or 2 %."""
    size = defaultdict(list)
    for r in rows:
        size[r[3]].append(len(WORD.findall(r[1] or "")))
    for s, t in filled(sizes_of(rows)).items():
        assert abs(taken.get(s, 0) - t) <= max(0.02 * t, sorted(size[s])[len(size[s]) // 2], 1 if max(size[s]) < 2 else max(size[s]) / 2 if len(size[s]) < 20 else 0), s


def test_mix_query_against_direct_targets(spark, sf, rows, docs):
    for d in (sf, sf.replace("0.001", "0.1")):
        got = registry.QUERIES["op6_mix_sources"](spark, d).collect()
        want = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
        of = {r[0]: r for r in want}
        sizes, target = sizes_of(want), filled(sizes_of(want))
        assert sorted(r["doc_id"] for r in got) == sorted(of)
        taken = defaultdict(int)
        for r in got:
            n, s = len(WORD.findall(of[r["doc_id"]][1] or "")), of[r["doc_id"]][3]
            assert r["size"] == n and r["taken"] in (0, n, 2 * n) and r["source_size"] == sizes[s]
            assert r["target"] == pytest.approx(target[s])
            taken[s] += r["taken"]
        near_targets(want, taken)
    many = spark.createDataFrame([(i % 7, "a b c" if i % 3 else "d", f"host{i % 500}") for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.mix(mixing._sizes(many, "doc_id", "text", "source"), block_rows=16).collect()  # repeated rows, and many sources
    per = {s: sum(r["size"] for r in got if r["source"] == s) for s in {r["source"] for r in got}}
    target = filled(per)
    assert len(got) == 4000 and all(r["target"] == pytest.approx(target[r["source"]]) for r in got)
    one = spark.createDataFrame([(1, "a b", "x")] * 3000, "doc_id long, text string, source string")
    assert sum(r["copies"] * r["size"] for r in mixing.mix(mixing._sizes(one, "doc_id", "text", "source"), block_rows=64).collect()) == pytest.approx(9000, abs=10)


def test_warc_appends_and_reads_foreign_files(spark, tmp_path):
    path = f"file://{tmp_path}/twice"
    pages = spark.createDataFrame([(i, f"http://{i}", "x" * i) for i in range(5)], "page_id long, url string, html string")
    for _ in range(2):
        warc.write_warc(warc.with_revisits(pages, "page_id", "url", "html", 1000), path)
    assert sorted(r["record_id"] for r in warc.read_warc(spark, path).collect()) == sorted(f"urn:page:{i}" for i in range(5) for _ in range(2))
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nabcd\r\n3;x=y\r\nefg\r\n0\r\n\r\n"
    plain = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nnot chunked"
    out = b""
    for i, b in enumerate((body, plain)):
        out += b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID:\r\n <urn:%d>\r\nContent-Type: application/http;\r\n\tmsgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(b), b)
    for name, data in (("a.warc", out), ("b.warc.gz", gzip.compress(out))):
        (tmp_path / name).write_bytes(data)
        got = {r["record_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()}
        assert got == {"urn:0": b"abcdefg", "urn:1": b"not chunked"}
    (tmp_path / "c.warc").write_bytes(out[:-20])
    with pytest.raises(Exception, match="ends early"):
        warc.read_warc(spark, f"file://{tmp_path}/c.warc").collect()


@pytest.mark.parametrize("which", ["documents", "fixture"])
def test_pipeline_stages_against_brute_force(spark, sf, docs, which):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    before = spark.read.parquet(f"{sf}/documents.parquet") if which == "documents" else docs
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    take = lambda name: stages[name](spark, before, sf).cache()

    model, after = language_id._train_documents(before), take("language_id")
    kept = [r for r in plain(before) if language_id.identify(r[1], model)[2] >= language_id.LEAST_MARGIN]
    assert after.columns == before.columns and plain(after) == kept and len(kept) > 0.5 * before.count()

    before, after = after, None
    after, top = take("exact_dedup"), {}
    for r in plain(before):
        if r[1] not in top or top[r[1]][0] is None or (r[0] is not None and r[0] > top[r[1]][0]):
            top[r[1]] = r
    assert plain(after) == sorted(top.values(), key=repr)

    before = after
    after, want = take("near_dedup"), brute_components(plain(before), 5)
    assert plain(after) == [r for r in plain(before) if r[0] is None or want[r[0]][0] == r[0]]

    before = after
    after, times = take("mix_sources"), defaultdict(int)
    for r in plain(after):
        times[r] += 1
    taken = defaultdict(int)
    for r, n in times.items():
        taken[r[3]] += n * len(WORD.findall(r[1] or ""))
    assert set(times) <= set(plain(before)) and max(times.values()) <= 2
    near_targets(plain(before), taken)

    before = after
    got, want = take("pack").collect(), []
    tok = packing._tokenizer(packing.default_tokenizer())[0]
    for r in plain(before):
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want += [repr((r[0], i, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()))) for i, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(want)
    h = defaultdict(int)
    for r in got:
        h[r["length"]] += 1
    assert len({r["sequence_id"] for r in got}) <= sum(n for _, n in packing.best_fit([], h, 2048))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack"]
    assert corpus_pipeline.run(spark, sf).count() > 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
