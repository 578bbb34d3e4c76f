import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions import urls
from gleaner.operators import agreement, best, bm25, crawl, evaluate, generate, index
from gleaner.sources import folders, readers, sinks


def test_best_follows_its_rule():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, k in ((1, 3), (5, 5), (40, 3), (40, 60)):
        s, ords = np.round(rng.random((7, n)), 1), rng.permutation(n) * 3
        s[rng.random((7, n)) < 0.2] = -np.inf
        row, column = best.best(s, ords, k)
        want = [(q, c) for q in range(7) for c in sorted((c for c in range(n) if s[q, c] > -np.inf), key=lambda c: (-s[q, c], -ords[c]))[:k]]
        assert list(zip(row.tolist(), column.tolist(), strict=True)) == want


def test_scores_in_small_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [f"w{j % (k + 2)}" for j in range(k + 1)]) for k in range(50)], "ord long, tokens array<string>").withColumn("dl", F.size("tokens"))
    asked = bm25.ask_of(rows, spark.createDataFrame([(q, [f"w{q}", "w1", "w1"]) for q in range(9)] + [(99, ["nothing"])], "qid long, tokens array<string>"))
    whole = {(r.qid, r.ord): round(r.bm25, 9) for r in bm25.scores(rows, asked).collect()}
    monkeypatch.setattr(bm25, "SCORES_AT_ONCE", 20)
    monkeypatch.setattr(bm25, "QUESTION_BLOCK", 4)
    assert {(r.qid, r.ord): round(r.bm25, 9) for r in bm25.scores(rows, asked).collect()} == whole
    top = {(r.qid, r.ord) for r in bm25.top(bm25.scores(rows, asked, 3), "bm25", 3).collect()}
    assert top == {(r.qid, r.ord) for r in bm25.top(spark.createDataFrame([(*k, v) for k, v in whole.items()], "qid long, ord long, bm25 double"), "bm25", 3).collect()}


def test_strip_is_linear(spark):
    text = "a" + " " * 500_000 + "b" + "\u2028 "
    began = time.time()
    assert spark.createDataFrame([(text,)], "t string").select(T.strip(F.col("t"))).first()[0] == text.strip()
    assert time.time() - began < 30


def test_links_with_dots(spark):
    cases = {"../b": "https://h.org/x/b", "./c": "https://h.org/x/y/c", "../../../d/./e": "https://h.org/d/e", "f/..": "https://h.org/x/y/", "/g/../h?q=../i": "https://h.org/h?q=../i", "#top": "https://h.org/x/y/z#top", "https://o.org/a/../b": "https://o.org/b", "mailto:a@b": "mailto:a@b"}
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    assert [r[0] for r in df.select(urls.resolve(F.lit("https://h.org/x/y/z"), F.col("h"))).collect()] == list(cases.values())


def page(url, *links):
    return (url, "".join(f'<a href="{x}">x</a>' for x in links))


def test_crawl_stops_and_goes_on(spark, tmp_path):
    pages = spark.createDataFrame([page("http://h/a", "/b", "/c"), page("https://h/b", "/d?x"), page("https://h/c", "/d", "/gone"), page("https://h/d", "/e"), page("https://h/e", "/a")], "url string, html string")
    seeds, state = spark.createDataFrame([("http://h/a#x",)], "url string"), f"file://{tmp_path}/s"
    names = lambda df: sorted(r.url[-1] for r in df.collect())
    assert names(crawl.crawl(seeds, pages, 9, f"file://{tmp_path}/whole")) == list("abcde")
    assert names(crawl.crawl(seeds, pages, 2, state)) == list("abc")
    written = (tmp_path / "s/round=0/frontier/_SUCCESS").stat().st_mtime_ns
    (tmp_path / "s/round=1/done/_SUCCESS").unlink()  # as if it had stopped in the second round
    assert names(crawl.crawl(seeds, pages, 9, state, resume=True)) == list("abcde")
    assert (tmp_path / "s/round=0/frontier/_SUCCESS").stat().st_mtime_ns == written
    assert names(crawl.crawl(seeds, pages, 9, f"file://{tmp_path}/few", most_pages=2)) == list("ab")
    assert not (tmp_path / "few/round=2").exists()
    known = spark.createDataFrame([("http://h/a",)], "url string")
    assert names(crawl.crawl(seeds, pages, 9, f"file://{tmp_path}/known", resume=True, corpus=known)) == []
    found, lost = crawl.second_chance(spark.createDataFrame([("http://h/x", 5), ("https://h/d", 2), (" ", 1), ("http://h/x", 3)], "url string, pos long"), pages)
    assert names(found) == ["d"] and [(r.url, r.pos) for r in lost.collect()] == [("http://h/x", 3)]
    assert crawl.checkpoint_path("a.b/c.json") == "a.b/c.checkpoint.json" and crawl.checkpoint_path("a.b/c") == "a.b/c.checkpoint"


def test_generators_fail_alone(spark):
    class Odd:
        def __call__(self, prompt):
            if "bad" in prompt:
                raise RuntimeError("no answer")
            return " first line \nsecond" if prompt else ""

    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None), (4, "")], "qid long, prompt string")
    assert [r.pred for r in generate.predict(rows, Odd()).orderBy("qid").collect()] == ["first line", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    calls = []
    assert generate.tried(lambda p: calls.append(p) or ("" if len(calls) < 3 else "x"), "p", 3, 0) == "x" and len(calls) == 3
    assert generate.is_pair('so {"question": "q", "answer": "a"} it is') and not generate.is_pair("{} {}") and not generate.is_pair('{"question": "q"}') and not generate.is_pair("none")


def test_chat_over_http():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"choices": [{"message": {"content": f"{asked['model']}:{asked['messages'][-1]['content']}:{self.headers['Authorization']}"}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    chat = generate.Chat(f"http://127.0.0.1:{server.server_port}/", "k", "m", "be brief", ("m",))
    assert chat("hi") == "m:hi:Bearer k"
    server.shutdown()
    with pytest.raises(ValueError):
        generate.Chat("u", "k", "other", allowed=("m",))


def test_readers_go_by_content(spark, tmp_path):
    rows = [{"id": "1", "validity_label": "valid"}, {"id": "2", "validity_label": "no"}]
    (tmp_path / "array.jsonl").write_text(json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    for name in ("array.jsonl", "lines.json"):
        assert [(r.pos, r.id) for r in readers.annotations(spark, f"{tmp_path}/{name}").orderBy("pos").collect()] == [(0, "1"), (1, "2")]
    (tmp_path / "refs.json").write_text(json.dumps(["a", ["b", "c"], "d|e"]))
    assert [(r.qid, r.golds) for r in readers.reference_lists(spark, f"{tmp_path}/refs.json").orderBy("qid").collect()] == [(0, ["a"]), (1, ["b", "c"]), (2, ["d|e"])]
    (tmp_path / "q.jsonl").write_text('{"question": "x"}\n{"question": " "}\n{"answer": "y"}\n')
    assert [r.question for r in readers.question_column(spark, f"{tmp_path}/q.jsonl").orderBy("qid").collect()] == ["x", " ", ""]
    assert [r.question for r in readers.questions(spark, f"{tmp_path}/q.jsonl").collect()] == ["x"]
    assert readers.read_env("# no\nA=b=c\n\nnothing\n B = 2 ") == {"A": "b=c", "B": "2"}
    assert [readers.clamped(i, 3) for i in (-1, 0, 2, 9)] == [0, 0, 2, 2]


def test_rewrites_survive_crashes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    n = lambda: spark.read.parquet(path).count()
    sinks.replace(spark.range(3), path)
    sinks.replace(spark.read.parquet(path).unionByName(spark.range(2)), path)
    assert n() == 5
    folders.rename(spark, path, path + ".old")  # a crash after the old one was put aside
    spark.range(7).write.parquet(path + ".new")
    sinks.recover(spark, path)
    assert n() == 7 and not folders.exists(spark, path + ".new") and not folders.exists(spark, path + ".old")
    for k in (1, 2):
        sinks.replace_all({"a": spark.range(k), "b": spark.range(10 * k)}, f"file://{tmp_path}/pair")
    now = sinks.current(spark, f"file://{tmp_path}/pair")
    assert [spark.read.parquet(f"file://{tmp_path}/pair/{now}/{t}").count() for t in "ab"] == [2, 20]
    assert len(list((tmp_path / "pair").glob("v*"))) == 1


def test_index_is_loaded_or_built(spark, tmp_path):
    pages = spark.createDataFrame([(1, "A title", "some words about ships"), (2, None, "more words about sheep"), (3, "", None)], "key long, title string, text string")
    folder = f"file://{tmp_path}/i"
    found = index.load_or_build(pages, folder, "v1")
    stamp = (tmp_path / "i/chunks/_SUCCESS").stat().st_mtime_ns
    asked = spark.createDataFrame([(5, "the ships")], "qid long, question string")
    assert found.n == 2 and found.retrieve(asked, 1).first().ord == 1 << 20
    again = index.load_or_build(pages, folder, "v1")
    assert (tmp_path / "i/chunks/_SUCCESS").stat().st_mtime_ns == stamp and again.avgdl == found.avgdl
    assert [r.ord >> 20 for r in again.retrieve(asked, 5, pad=True).orderBy("rank").collect()] == [1, 2]
    index.load_or_build(pages, folder, "v2")
    assert (tmp_path / "i/chunks/_SUCCESS").stat().st_mtime_ns != stamp
    (tmp_path / "i/done/_SUCCESS").unlink()
    assert index.load(spark, folder, index.Settings(), index.Settings().fingerprint("v2")) is None


def test_agreement_modes(spark):
    row = lambda k, label=None, answered=None, answer=None: (str(k), f"q{k}", answer, label, answered, None, k)
    of = lambda rows: spark.createDataFrame(rows, "id string, question string, answer string, validity_label string, annotated_answer string, corrected_answer string, pos long")
    a = of([row(1, "valid", "The cat"), row(2, "valid", "x"), row(3, "no"), row(4, "maybe", "y"), row(9, "yes", "old"), row(9, "yes", "z")])
    b = of([row(1, "yes", "the cat"), row(2, "no", "x"), row(3, "no"), row(4, "yes", ""), row(9, "yes", "w z")])
    got = agreement.compare(a, b)
    s = got["summary"].first()
    assert (s.mode, s.shared, s.comparable, s.skipped, s.joint_valid, s.agreement, s.exact_match) == ("annotation", 5, 4, 1, 2, 0.75, 50.0)
    assert [r.key for r in got["labels"].collect()] == ["2"] and [(r.key, round(r.f1, 3)) for r in got["answers"].collect()] == [("9", 0.667)]
    s = agreement.compare(a, b, answer_only=True)["summary"].first()
    assert (s.mode, s.shared, s.skipped, s.n, round(s.exact_match, 3)) == ("answer-only", 5, 2, 3, 66.667)
    old = of([row(k, None, None, t) for k, t in enumerate(("a", "b"))])
    assert agreement.compare(old, old)["summary"].first().exact_match == 100
    for bad in ((old, old.limit(1)), (a, of([row(77, "yes")])), (of([row(1, "?", "x")]), b)):
        with pytest.raises(ValueError):
            agreement.compare(*bad)


def test_overlaps_and_heads(spark):
    rows = spark.createDataFrame([(1, ["x", "x", "y"], ["x", "y", "y"]), (2, [], ["x"]), (3, ["a"] * 3000, ["a"] * 2000 + ["b"])], "qid long, a array<string>, b array<string>")
    assert [tuple(r) for r in evaluate.overlaps(rows, "qid", "a", "b").orderBy("qid").collect()] == [(1, 2, 3, 3), (2, 0, 0, 1), (3, 2000, 3000, 2001)]
    scored = spark.createDataFrame([(k, "p", False, 0.0, "✗") for k in range(13)] + [(99, "q", True, 1.0, "✓")], "qid long, pred string, em boolean, f1 double, mark string")
    rows, more = evaluate.zero_f1_head(scored)
    assert [r.qid for r in rows.collect()] == list(range(10)) and more == 3
    lines = [r.line for r in sinks.report(evaluate.summary(scored), scored).orderBy("part", "qid").collect()]
    assert lines[0].startswith("n=14") and lines[-1] == "13 without overlap" and len(lines) == 1 + 14 + 10 + 1
