import pytest
from pyspark.sql import functions as F

from gleaner.functions import html, urls
from gleaner.functions import text as T
from gleaner.operators import agreement, chunk, crawl, evaluate, qa


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*(c.alias(n) for n, c in columns.items())).collect()]


def test_normalize(spark):
    rows = [("The the a an THE.",), ("U.S. the",), ("a_the_b",), ("“The” theory’s a",), ("",), (None,)]
    got = values(spark, rows, "t string", a=T.normalize_answer(F.col("t")), b=T.normalize_iaa(F.col("t")))
    assert [g[0] for g in got] == ["", "us", "atheb", "“ ” theory’s", "", ""]
    assert got[1][1] == "us the" and got[5][1] == ""


def test_scores(spark):
    rows = [("x x y", "x y y"), ("", "the")]
    got = values(spark, rows, "p string, g string", em=T.exact_match(F.col("p"), F.col("g")), f1=T.token_f1(F.col("p"), F.col("g")))
    assert got == [(False, pytest.approx(2 / 3)), (True, 0.0)]


def test_golds_short_validity_answer(spark):
    assert values(spark, [("Gina | Bob",), ("x|",)], "t string", g=T.split_golds(F.col("t"))) == [(["Gina", "Bob"],), (["x", ""],)]
    assert values(spark, [("w" * 141,)], "t string", s=T.short(F.col("t")))[0][0] == "w" * 137 + "..."
    rows = [(" Valid ",), ("supported",), ("0",), ("maybe",), (None,)]
    assert [v for (v,) in values(spark, rows, "t string", v=T.parse_validity(F.col("t")))] == [1, 1, 0, None, None]
    rows = [(" x\ny",), ("z" * 100,), ("",), (None,)]
    assert [v for (v,) in values(spark, rows, "t string", v=T.clean_answer(F.col("t")))] == ["x", "z" * 80, "UNKNOWN", "UNKNOWN"]


def test_extract_json(spark):
    one = '{"question": "q", "answer": "a"}'
    rows = [(f"ok {one} bye",), (f"{one} {one}",), ("none",), (None,)]
    assert [v for (v,) in values(spark, rows, "t string", v=T.extract_qa(F.col("t"))["question"])] == ["q", None, None, None]


@pytest.mark.parametrize(("n", "spans"), [(0, []), (1, [(0, 1)]), (150, [(0, 150)]), (151, [(0, 150), (110, 151)]), (260, [(0, 150), (110, 260)]), (261, [(0, 150), (110, 260), (220, 261)])])
def test_chunks(spark, n, spans):
    df = spark.createDataFrame([(1, " ".join(map(str, range(n))))], "k int, t string")
    got = [r.chunk.split() for r in chunk.chunk_table(df, "k", F.col("t")).orderBy("chunk_id").collect()]
    assert [(int(g[0]), int(g[-1]) + 1) for g in got] == spans


def test_chunk_overlap_must_be_smaller():
    with pytest.raises(ValueError, match="overlap"):
        chunk.chunks(F.lit(None), 10, 10)


def test_urls(spark):
    host = r"(?:www\d*\.)?eecs\.example\.edu"
    rows = [("https://eecs.example.edu/a",), ("https://www2.eecs.example.edu/a.PDF",), ("ftp://eecs.example.edu",), ("https://inst.eecs.example.edu/",), ("https://eecs.example.edu.evil.com/",)]
    got = values(spark, rows, "u string", p=urls.allowed(F.col("u"), host), s=urls.allowed(F.col("u"), host, True))
    assert got == [(True, True), (False, False), (False, False), (False, False), (True, False)]
    page = '<a href="/x?y#z">1</a><a class="c" href="b.html">2</a><a href="http://o.org/q">3</a><a href="//p.org/r">4</a><a href="/x">5</a>'
    got = values(spark, [("http://h.org/d/e.html", page)], "u string, h string", links=urls.links(F.col("u"), F.col("h")))
    assert got[0][0] == ["https://h.org/x", "https://h.org/d/b.html", "https://o.org/q", "https://p.org/r"]


def test_html():
    page = "<html><head><title> T </title><meta name='description' content=' d '></head><body><header>top</header><nav>n</nav><main><p>One  two</p><table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table><p>x &amp; y</p></main></body></html>"
    assert html.text_v1(page) == ("T", "One  two\nA\nB\n1\nx & y")
    title, text, meta = html.text_v2(page)
    assert (title, meta) == ("T", "d")
    assert text == "One two\n\n| A | B |\n| --- | --- |\n| 1 | |\n\nx & y".replace("| 1 | |", "| 1 | |")
    assert html.text_v1("") == ("", "") and html.text_v2("<table></table>") == ("", "", "")


def test_agreement(spark):
    rows = [(1, 1)] * 24 + [(1, 0)] * 3 + [(0, 0)] * 3
    df = spark.createDataFrame(rows, "a int, b int")
    k, a = agreement.kappa(df, "a", "b").first(), agreement.alpha(df, "a", "b").first()
    assert (round(k.kappa, 6), k.band, round(a.alpha, 6)) == (0.615385, "low", 0.607843)
    same = spark.createDataFrame([(1, 1)] * 5, "a int, b int")
    assert agreement.kappa(same, "a", "b").first().kappa == 1 and agreement.alpha(same, "a", "b").first().alpha == 1


def test_joined_needs_equal_counts(spark):
    a, b = spark.range(3).withColumnRenamed("id", "qid"), spark.range(2).withColumnRenamed("id", "qid")
    with pytest.raises(ValueError, match="3 predictions"):
        evaluate.joined(a, b)


def test_first_wins(spark):
    df = spark.createDataFrame([(2, "b"), (1, "B"), (3, "c")], "pos int, q string")
    assert sorted(r.pos for r in qa.first_wins(df, F.lower("q"), "pos").collect()) == [1, 3]


def test_crawl(spark, tmp_path):
    pages = spark.createDataFrame([("http://h.org/a", '<a href="/b">b</a>'), ("https://h.org/b", '<a href="/c">c</a>'), ("https://h.org/c", ""), ("https://h.org/d", "")], "url string, html string")
    seeds = spark.createDataFrame([("https://h.org/a#top",)], "url string")
    got = crawl.crawl(seeds, pages, 5, str(tmp_path))
    assert sorted(r.url for r in got.collect()) == ["https://h.org/a", "https://h.org/b", "https://h.org/c"]
    assert [crawl.backoff(k) for k in range(3)] == [5.0, 10.0, 20.0] and crawl.worth_retrying(503) and not crawl.worth_retrying(404)


def test_files(spark, tmp_path):
    from gleaner.sources import readers, sinks

    (tmp_path / "r.jsonl").write_text('{"question": "q1", "answer": "a | b"}\n{"question": "q2", "answer": "c", "url": "u"}\n')
    (tmp_path / "p.txt").write_text("one\n\n two \n")
    refs = readers.references(spark, str(tmp_path / "r.jsonl")).orderBy("qid").collect()
    assert [(r.golds, r.url) for r in refs] == [(["a", "b"], ""), (["c"], "u")]
    preds = readers.predictions(spark, str(tmp_path / "p.txt"))
    assert [r.pred for r in preds.orderBy("qid").collect()] == ["one", "", "two"]
    assert [r.question for r in readers.questions(spark, str(tmp_path / "p.txt")).orderBy("qid").collect()] == ["one", "two"]
    sinks.answers(preds, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == "one\n\ntwo\n"
    sinks.replace(preds, str(tmp_path / "t"))
    sinks.replace(spark.read.parquet(str(tmp_path / "t")).where("pred <> ''"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_stream(spark, tmp_path):
    from gleaner.streaming import chunks

    page = "<body><p>" + "w " * 200 + "</p></body>"
    rows = spark.createDataFrame([(1, "http://h.org/a#x", page), (2, "https://h.org/a", page)], "page_id long, url string, html string").withColumn("fetched", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    rows.write.parquet(str(tmp_path / "in"))
    q = chunks.chunks(chunks.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("chunked").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("chunked").count() == 2
