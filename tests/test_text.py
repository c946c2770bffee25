import json
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.sources import corpora, index_store
from vecloom.operators import audit
from vecloom.operators.search import build_index, from_codes, search
from vecloom.plans import reports  # noqa: F401  (registers its queries)
from vecloom.plans.catalog import ORACLE_SQL, QUERIES


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t")).alias("x")).collect()]


def test_html(spark):
    got = one(spark, T.strip_html, "<p>Use <b>this</b> .</p>", "a <pre>x=1</pre> b", "&lt;c&gt; &amp; more", None)
    assert got[0].strip() == "Use this." and "x=1" not in got[1] and got[2] == "<c> & more" and got[3] is None


def test_clean_and_trim(spark):
    assert one(spark, T.clean_plain_text, "_so_ it was [12] ready- made , y{e} pre- and post", "a\x97b\x85", "[Illustration: x] y") == ["so it was readymade, ye pre- and post", "a-b...", " y"]
    assert one(spark, lambda c: T.trim(c, 10), "one two  three", "short") == ["one two...", "short"]
    assert one(spark, T.lower_host, "https://Stack.Example.COM/Q/1", "x") == ["https://stack.example.com/Q/1", "x"]


def test_headline(spark):
    got = one(spark, T.headline, "I have a printer. Why does the extruder stop after some minutes of work? Thanks.", "It is broken. Any clues?")
    assert got == ["Why does the extruder stop after some minutes of work?", "It is broken."]


def test_chunk(spark):
    sentence = "This is a sentence about the sea and the wind. "
    pieces = one(spark, T.chunk, sentence * 40, "short", "")
    assert all(len(p) <= 520 for p in pieces[0]) and sum(map(len, pieces[0])) > 1500
    assert pieces[1:] == [[], []]


PROSE = "The sea was calm and the wind was in the east when he came to the harbour, and it was not long before the boat was at the pier with all that he had brought."


@pytest.mark.parametrize("text,want", [(PROSE, True), ("CHAPTER I. THE SEA. CHAPTER II. THE WIND.", False), (PROSE.replace(".", ""), False), ("a | b | c | d " + PROSE, False), ("The Game Warden, the Forest Ranger, the Tall Rider, the Old Cook, the Young Clerk, the Best Hand and the First Mate Of That Boat In The Bay Was It.", False)])
def test_prose(spark, text, want):
    assert one(spark, T.is_prose, text) == [want]


def test_adapters_and_store(spark, tmp_path):
    answers = [("<p>" + PROSE + "</p>", False, 3), ("<p>other</p>", False, 3), (None, None, None)]
    se = spark.createDataFrame([(["https://A.example.com/q/1"], "<p>Why?</p>", answers), (["https://x.meta.example.com/1"], "q", answers), ([], "q", answers)], f"metadata array<string>, question string, answers {corpora.ANSWERS}")
    got = corpora.stackexchange(se).collect()
    assert [r["url"] for r in got] == ["https://a.example.com/q/1"] and got[0]["text"].startswith("The sea")
    book = "Project Gutenberg eBook of Sea Tales,\n*** START OF THE PROJECT GUTENBERG EBOOK SEA ***" + ("\n\n" + PROSE) * 30 + "*** END OF THE PROJECT GUTENBERG EBOOK"
    books = corpora.gutenberg(spark.createDataFrame([("12-0", book)], "id string, text string"))
    assert books.first()["title"] == "Sea Tales" and books.first()["url"].endswith("/12")
    assert corpora.arxiv(spark.createDataFrame([("1", "t", "x" * 119), ("2", "t", "y" * 130)], "id string, title string, abstract string")).count() == 1
    assert corpora.wikipedia(spark.createDataFrame([("t", "u", PROSE.replace(",", " ,"))], "title string, url string, text string")).first()["text"] == PROSE
    rows = books.limit(1).withColumn("id", F.lit(0).cast("long")).join(build_index(spark.createDataFrame([(0, [1.0, 0.5])], "id long, v array<float>"), "id", "v"), "id")
    rows = rows.select("id", "codes", "scale", "text", "title", "url", "source", "licence").withColumn("title", F.lit("Sea *** "))
    path = f"file://{tmp_path}/index"
    index_store.write_index(rows, path)
    index_store.write_manifest(index_store.manifest(rows), path)
    back, manifest = index_store.read_index(spark, path)
    assert back.count() == 1 and manifest.first()["dpad"] == 16
    assert index_store.repair_titles(spark, path, f"file://{tmp_path}/fixed") == 1


def test_stream_shards_and_faults(spark, tmp_path):
    a, b, c = (spark.createDataFrame([(f"{n}{i}", i) for i in range(k)], "text string, ord long") for n, k in (("z", 3), ("a", 1), ("m", 0)))
    got = corpora.stream({"z": a, "m": c, "a": b}, "ord")
    assert [(r["id"], r["text"]) for r in got.orderBy("id").collect()] == [(0, "z0"), (1, "a0"), (2, "z1"), (3, "z2")]
    assert [r["text"] for r in corpora.stream({"z": a, "a": b}, "ord", 2).orderBy("id").collect()] == ["z0", "a0", "z1"]
    path = f"file://{tmp_path}/shards"
    spark.range(100).repartitionByRange(4, "id").write.parquet(path)
    (tmp_path / "shards" / "bad.parquet").write_bytes(b"no parquet")
    shards = corpora.read_shards(spark, path, "id long", seed=1)
    first, every = ([r["id"] for r in corpora.take_shards(shards, n).collect()] for n in (30, None))
    assert sorted(every) == list(range(100)) and len(first) == 30 and first[:20] == list(range(first[0], first[0] + 20))
    assert first == [r["id"] for r in corpora.take_shards(corpora.read_shards(spark, path, "id long", seed=1), 30).collect()]
    broken = a.withColumn("text", F.raise_error(F.lit("gone")).cast("string"))
    assert list(corpora.write_each({"good": a, "bad": broken}, f"file://{tmp_path}/each")) == ["bad"]
    assert spark.read.parquet(f"file://{tmp_path}/each/source=good").count() == 3


def test_build_search_and_response(spark, tmp_path):
    passages = spark.createDataFrame([(i, t, f"T{i}", f"u{i}", "web", "x") for i, t in enumerate(["sea", "wind", "sea"])], "id long, text string, title string, url string, source string, licence string")
    embed = lambda t: F.when(t == "sea", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>")
    m = index_store.build(passages, embed, f"file://{tmp_path}/built", "toy").first()
    assert (m["n"], m["dim"], m["dpad"], m["model"], m["bytes_per_vector"], m["per_source"]["web"]) == (3, 2, 16, "toy", 20, 3)
    rows, _ = index_store.read_index(spark, f"file://{tmp_path}/built")
    q = build_index(spark.createDataFrame([(7, [1.0, 0.1])], "qid long, v array<float>"), "qid", "v").withColumnRenamed("id", "qid")
    hits = search(rows, q, 2)
    full = index_store.passages_of(hits, rows)
    got = json.loads(index_store.search_response(full).first()["json"])["results"]
    assert [(r["rank"], r["id"], r["text"], r["title"]) for r in got] == [(1, 0, "sea", "T0"), (2, 2, "sea", "T2")] and got[0]["score"] == 1.0
    adopted = from_codes(rows.select("id", "codes", "scale"), 2)
    assert search(adopted, q, 2).collect() == hits.collect()
    with pytest.raises(Exception, match="invalid codes"):
        from_codes(rows.select("id", "codes", "scale"), 3).collect()
    empty = index_store.build(passages.limit(0), embed, f"file://{tmp_path}/none").first()
    assert empty["n"] == 0


def test_wheel_objects(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p-1.whl", "w") as z:
        z.writestr("p/a.so", b"ELF1")
        z.writestr("p/lib.so.3", b"ELF2")
        z.writestr("p/x.py", b"pass")
    assert sorted((r["wheel"], r["object"], bytes(r["content"])) for r in corpora.wheel_objects(spark, f"file://{tmp_path}").collect()) == [("p-1.whl", "p/a.so", b"ELF1"), ("p-1.whl", "p/lib.so.3", b"ELF2")]


def test_audit(spark):
    rows = [(1, "u1", "clean text"), (2, "u1", "a [12] b"), (3, "u2", "x" * 80 + " &amp; " + "y" * 80), (4, "u1", "c [3]"), (5, "u3", "[4]"), (6, "u2", None)]
    df = spark.createDataFrame(rows, "ord long, url string, text string")
    got = {r["label"]: r for r in audit.audit(df, "ord", "url", "text").collect()}
    assert len(got) == 11 and (got["footnote marker"]["hits"], got["footnote marker"]["first"], got["footnote marker"]["example"]) == (3, 2, "a [12] b")
    assert got["html leftover"]["example"] == "x" * 49 + " &amp; " + "y" * 49 and got["code"]["hits"] == 0 and got["code"]["example"] is None
    assert (got["code"]["passages"], got["code"]["documents"]) == (6, 3)
    some = {r["label"]: r for r in audit.audit(df, "ord", "url", "text", docs=2, per_doc=2).collect()}  # stops at u3, takes two of u1
    assert (some["footnote marker"]["hits"], some["code"]["passages"], some["code"]["documents"]) == (1, 3, 2)


def by_both(spark, tmp_path, name, df, table):
    """The rows of a named query and of its SQL, over df as its only table."""
    df.coalesce(1).write.parquet(f"file://{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    e = con.execute(ORACLE_SQL[name])
    return sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*[d[0] for d in e.description]).collect()), key=repr), sorted(e.fetchall(), key=repr)


def test_html_strip_against_sql(spark, tmp_path):
    cut = ["<title>und&amp;&amp</title>", "x &lt y &quot", "&amp;lt; &eacute; &#39;s&nbsp;", "a\u2003, ( \u2003b", "a \xa0.", "x</p\x0b>y</p >z", "", None]
    got, want = by_both(spark, tmp_path, "html_strip", spark.createDataFrame(list(enumerate(cut)), "page_id long, html string"), "pages")
    assert got == want and got[0] == (0, " und&&amp ")
    assert one(spark, T.strip_html, *cut[:4]) == [" und&& ", 'x < y "', "&lt; é 's\xa0", "a, (b"]  # the adapters decode all


ODD = ["ÉAI POUR AN AUX ", "ÉAI POUR AN AUX LE ", "a | b\r| c", "mot\xa0!", "x\x0b,", "é{é}", "e{12}", "[\u0663]", "a-\u2003b", "a- b", "édef (", "def (", ";\u2028", "; \n", ". . . ", ".\xa0.\xa0.\xa0", "SS " * 20_000, "", None]


def test_audit_against_sql(spark, tmp_path):
    for i, texts in enumerate([ODD, *[[t] for t in ODD[:6]]]):
        rows = [(None if t == "e{12}" else at, t, f"s{at % 3}") for at, t in enumerate(texts)]  # a null id is no first
        got, want = by_both(spark, tmp_path / str(i), "text_artifact_audit", spark.createDataFrame(rows, "doc_id long, text string, source string"), "documents")
        assert got == want


def test_audit_patterns_as_in_python(spark):
    """The default: classes of Unicode, and only a line feed ends a line."""
    got = one(spark, T.artifacts, *ODD)
    assert got[:-1] == [[k for k, p in T.ARTIFACTS.items() if re.search(p, t)] for t in ODD[:-1]] and got[-1] == []
