"""Edge cases of every operator: nulls, empty and odd texts, repeated rows, empty tables, clashing extra columns."""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import common, components, decontaminate, hamming, media, mixing, pii, repair, simhash, tokencount, toxicity, urlfilter, warc
from gleaner.llm.tokenizing import ids_of, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, node long, size long, copies long, score double"
TEXTS = [None, "", "  \n ", "one", "one two three four five six seven", "one two three four five six seven", "Ünï ﬁ 𝒳 — ok", "x " * 4000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None if k % 3 == 0 else "s", 1, "f", 7, 8, 9, 0.5) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "one", None, None, None, None, None, None, None, None)], SCHEMA)


def counted(df, docs):
    rows = df.collect()
    assert len(rows) == docs.count()
    return rows


def test_fingerprints(docs):
    rows = counted(simhash.fingerprint_components(docs), docs)
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == by[1].fingerprint == by[2].fingerprint == "0" * 16
    assert by[2].component_id == 0 and by[5].component_id == 4 and by[None].component_id == 3
    assert by[4].fingerprint == f"{simhash.simhash(simhash.hashes(TEXTS[4].encode(), 3)):016x}"
    assert counted(simhash.fingerprint_components(docs.limit(0)), docs.limit(0)) == []


def test_fingerprints_keep_few_rows_in_few_files(spark, monkeypatch):
    """Where Spark doesn't join small partitions: a file for each of them would cost a task, and executors fork for files."""
    texts = ["a b c d e", "a b c d f", *(f"w{k} v{k} u{k} t{k}" for k in range(30)), *(" ".join([*(f"n{j}" for j in range(300)), f"end{k}"]) for k in range(8)), "a b c d e"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    files = []
    for module in (simhash, components):
        monkeypatch.setattr(module, "checkpoint", lambda df: (out := common.checkpoint(df), files.append(out._jdf.queryExecution().toRdd().getNumPartitions()))[0])
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        by = {r.doc_id: r for r in simhash.fingerprint_components(docs).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(files) >= 6 and max(files) <= common.FEW_FILES
    x = [int(by[k].fingerprint, 16) for k in range(len(texts))]
    label = list(range(len(x)))
    for _ in x:
        label = [min(label[j] for j in range(len(x)) if (x[i] ^ x[j]).bit_count() <= 3) for i in range(len(x))]
    assert [by[k].component_id for k in range(len(x))] == label and label[-1] == 0
    assert any(x[i] != x[label[i]] for i in range(len(x)))  # so there were rounds of components


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(12):
        base = list(rng.choice(words, 80))
        for changes in (0, 1, 2, 3, 5):
            t = list(base)
            for k in rng.integers(0, 80, changes):
                t[k] = f"new{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(df).collect()}
    sets, label = [set(simhash.shingles(t.encode(), 5)) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert got == dict(enumerate(label))


def linked(spark, rows):
    return {(r.doc_id, r.group_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_prefixes_miss_no_link():
    """Pairs just at the similarity: bands of minimum hashes miss about two of a thousand of them."""
    rng, counts = np.random.default_rng(17), np.zeros(1 << simhash.COUNT_BITS, np.int32)
    counts[: 1 << 18] = rng.integers(0, 9, 1 << 18)
    for _ in range(20_000):
        n = int(rng.integers(1, 41))
        common, rest = 4 * n, rng.integers(0, 1 << 63, 5 * n, dtype=np.uint64)
        only = int(rng.integers(0, n + 1))
        a, b = np.unique(rest[: common + only]), np.unique(np.r_[rest[:common], rest[common + only :]])
        assert len(np.intersect1d(simhash.prefix(a, counts), simhash.prefix(b, counts)))


def test_near_duplicates_of_null_and_repeated_ids(spark):
    base = [f"w{k}" for k in range(100)]
    near = " ".join([*base[:99], "new"])
    far = " ".join(f"z{k}" for k in range(80))
    rows = [(None, " ".join(base)), (5, near), (None, " ".join([*base, "more"])), (5, far), (6, far + " end"), (9, "x y z")]
    got = linked(spark, rows)
    assert got == {(None, 5), (5, 5), (6, 5), (9, 9)}


def test_near_duplicates_through_texts_without_ids(spark):
    base = [f"w{k}" for k in range(40)]
    step = lambda a: " ".join(["h", *base, *[f"v{j}" for j in range(a)]])
    a, b = set(simhash.shingles(step(0).encode(), 5)), set(simhash.shingles(step(16).encode(), 5))
    assert len(a & b) < 0.8 * len(a | b)
    assert linked(spark, [(1, step(0)), (None, step(8)), (2, step(16))]) == {(1, 1), (None, 1), (2, 1)}


def shuffles_and_checkpoints(spark):
    """How many shuffles have files, and the folders of checkpoints that do."""
    folder = common.shared_dir(spark)
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    return tracker.shuffleStatuses().size(), {d for d, _, files in os.walk(folder.removeprefix("file://")) if any("part-" in f for f in files)}


def test_near_duplicates_leave_little_on_disk(spark):
    """Shuffle files go with the checkpoint that they were for, checkpoints with the last step that reads them."""
    rows = [(k, " ".join(f"w{k // 3}x{j}" for j in range(60)) + f" end{k % 3}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    common.settle(spark)
    shuffles, folders = shuffles_and_checkpoints(spark)
    result = simhash.near_duplicates(docs)
    after, left = shuffles_and_checkpoints(spark)
    assert after - shuffles <= 10 and len(left - folders) <= 6
    assert {(r.doc_id, r.group_id) for r in result.collect()} == {(k, k - k % 3) for k in range(30)}


def test_near_duplicates_give_the_drivers_memory_back(spark, monkeypatch):
    calls = []
    for module in (simhash, components):
        monkeypatch.setattr(module, "settle", lambda session, name=module.__name__: (calls.append(name), common.settle(session)))
    assert linked(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "z")]) == {(1, 1), (2, 1), (3, 3)}
    assert calls.count("gleaner.llm.simhash") >= 4 and "gleaner.llm.components" in calls


def test_stars_of_keys():
    """Nodes that share a key in like ranges are linked, whatever the batches; a key of all nodes costs a row a batch."""
    rng = np.random.default_rng(23)
    nodes = np.unique(rng.integers(-(1 << 62), 1 << 62, 300))
    ranges = rng.integers(0, 4, len(nodes)).astype(np.int32)
    keys = [np.unique(np.r_[7, rng.integers(100, 400, 2)]) for _ in nodes]
    listed = pa.array([k.tolist() for k in keys], pa.list_(pa.int64()))
    batches = [pa.RecordBatch.from_arrays([pa.array(nodes[s]), pa.array(ranges[s]), listed[s.start : s.stop]], names=["node", "range", "keys"]) for s in (slice(0, 120), slice(120, 300))]
    table = pa.Table.from_batches(list(simhash._key_rows(batches))).sort_by([("key", "ascending"), ("range", "ascending"), ("node", "ascending")])
    own = table.filter(pc.and_(pc.equal(table["key"], 7), pc.is_null(table["other"])))
    assert own.num_rows <= 2 * 4  # of 300 nodes, in two batches and four ranges
    edges = [e for b in simhash._stars(table.to_batches(max_chunksize=50)) for e in b.to_pylist()]
    got, want = {}, {}
    for e in edges:
        for at in (e["range"], e["range"] - 1)[: 1 + e["below"]]:
            got.setdefault(at, []).append((e["a"], e["b"]))
    for at in range(-1, 4):
        here = [k for k in range(len(nodes)) if ranges[k] in (at, at + 1)]
        for key in range(400):
            same = [int(nodes[k]) for k in here if key in keys[k]]
            want.setdefault(at, []).extend((same[0], x) for x in same[1:])
    names = {int(n): k for k, n in enumerate(nodes)}
    for at, pairs in want.items():
        labels = []
        for found in (pairs, got.get(at, [])):
            a, b = (np.array([names[p[k]] for p in found], np.int64) for k in (0, 1))
            labels.append(hamming.merge(np.arange(len(nodes)), a, b).tolist())
        assert labels[0] == labels[1]


def test_near_duplicate_stage_keeps_columns(docs):
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: -1 if x is None else x) == [None, 0, 3, 4, 4, 6, 7]


def test_hamming_index_finds_every_pair():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (5, 60, 3), dtype=np.uint64), axis=2)
    x = np.unique(np.r_[(centre[:, None] ^ flips).ravel(), rng.integers(0, 1 << 63, 300, dtype=np.uint64)])
    got = {(min(a, b), max(a, b)) for i, j in hamming.HammingIndex(x).pairs(3) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if int(x[a] ^ x[b]).bit_count() <= 3}


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 100), (200, 201), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 200: 200, 201: 200}


def test_toxicity(spark, docs):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join([*rng.choice(["alpha", "beta", "gamma", "delta"], 20), *(["vilelout"] if k % 4 == 0 else [])])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert all(r.predicted == (k % 4 == 0) for k, r in got.items())
    for l in (labels, labels.limit(0)):
        assert all(0 <= r.score <= 1 for r in counted(toxicity.toxicity(docs, l), docs))


def test_toxicity_counts_of_many_words():
    rng = np.random.default_rng(16)
    words = {"".join(map(chr, rng.integers(0x4E00, 0x4E00 + 3000, 6))): [1, 0] for _ in range(60_000)} | {"vilelout": [0, 50]}
    rows = [tuple(r.values()) for b in toxicity._count_rows(words) for r in b.to_pylist()]
    assert len({r[:2] for r in rows if r[0] == 5}) == len({w[a : a + 5] for w in (f"\2{x}\3" for x in words) for a in range(len(w) - 4)})
    model = toxicity.model_of(pa.Table.from_batches(toxicity._count_rows(words)))
    for g in ("vilel", "elout"):
        _, place, grams = toxicity._grams([g])
        share = model.values_of(5, grams[5])[np.flatnonzero(place == 5)][:, :2]
        assert share[0, 0] == 0 and share[0, 1] == pytest.approx((50 - toxicity.DISCOUNT) / 50)


def test_toxicity_lower_orders_count_what_comes_before():
    words = {"xabcd": [0, 9], "yabcd": [0, 1], "zabce": [0, 1], "xabce": [3, 0], "abcq": [0, 4]}
    model = toxicity.model_of(pa.Table.from_batches(toxicity._count_rows(words)))
    _, place, grams = toxicity._grams(["abcd"])
    (share,) = model.values_of(4, grams[4])[np.flatnonzero(place == 4)]
    # toxic: "abcd" after x and y, "abce" after z, "abcq" at the beginning of its word: after its mark
    assert share[1] == pytest.approx((2 - toxicity.DISCOUNT) / 4) and share[0] == 0


def test_leaks(spark, docs):
    rng = np.random.default_rng(5)
    item = [f"q{k}" for k in range(30)]
    noise = lambda n: [f"z{k}" for k in rng.integers(0, 500, n)]
    changed = [w if k % 9 else "other" for k, w in enumerate(item)]
    rows = [(1, " ".join(noise(50) + item + noise(70))), (2, " ".join(noise(9) + changed)), (3, " ".join(noise(90) + item[:12])), (4, None), (5, "")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, ""), (9, None), (None, "q1 q2")], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == {(1, 7), (2, 7)}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(df, bench).collect()) == [3, 4, 5]
    assert decontaminate.leaks(docs, bench).count() == 0 and decontaminate.without_leaks(docs, bench.limit(0)).columns == docs.columns


def test_leaks_of_many_items(spark):
    rng = np.random.default_rng(15)
    items = [[f"q{k}" for k in rng.integers(0, 20_000, n)] for n in rng.integers(5, 60, 2500)]
    noise = lambda n: [f"q{k}" for k in rng.integers(0, 20_000, n)]
    rows, want = [(0, " ".join(noise(3000)))], set()
    for d, k in enumerate(rng.choice(2500, 300, replace=False).tolist(), 1):
        changed = [w if d % 2 or (j + 1) % 6 else "other" for j, w in enumerate(items[k])]
        rows.append((d, " ".join(noise(int(rng.integers(0, 1100))) + changed + noise(int(rng.integers(0, 60))))))
        want.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(-1 <= r.cosine <= 1.0001 for r in got)


def test_lcs():
    assert [decontaminate.lcs(a.split(), b.split()) for a, b in (("a b c d", "a x c d"), ("", "a"), ("a a b", "b a a"))] == [3, 0, 2]
    assert decontaminate.answer_of("Who? Ada L.") == ["ada", "l"] and decontaminate.answer_of("none here") == []


def test_mix(docs):
    rows = counted(mixing.mix(docs), docs)
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    by = {r.doc_id: r for r in rows}
    assert (by[1].size, by[4].size, by[7].size) == (0, 7, 4000)
    assert sum({r.source_size: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))
    assert counted(mixing.mix(docs.limit(0)), docs.limit(0)) == []


def test_mix_stage_keeps_null_and_repeated_ids(spark):
    text = lambda k, n: " ".join(f"w{k}" for _ in range(n))
    rows = [(None, text(k, 10 + k % 3), "a") for k in range(40)] + [(7, text(k, 5 + k % 2), "b") for k in range(30)]
    rows += [(k, text(k, 20), "c") for k in range(100, 150)] + [(7, text(1, 12), None), (None, None, "c"), (None, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("kept"))
    got = corpus_pipeline.mix_sources(spark, df, "")
    assert got.columns == df.columns
    words = lambda rows, n: {s: sum(n(r) for r in rows if r[0] == s) for s in ("a", "b", "c", None)}
    planned = mixing._copies(df).collect()
    taken = [(r.source, len((r.text or "").split())) for r in got.collect()]
    assert words(taken, lambda r: r[1]) == words([(r.source, r.taken) for r in planned], lambda r: r[1])
    assert len(taken) == sum(r.copies for r in planned)
    most = got.groupBy("doc_id", "text", "source").count().agg(F.max("count")).first()[0]
    assert most <= mixing.MOST and all(abs(words(taken, lambda r: r[1])[r.source] - r.target) < 20 for r in planned)


def test_allot_meets_its_target():
    rng = np.random.default_rng(6)
    size, n = np.arange(0, 900), rng.integers(1, 9, 900)
    for share in (0.1, 0.9, 1.0, 2.2, 3.0):
        target = share * float((size * n).sum())
        copies = mixing.allot(size, n, target)
        assert (copies <= 3 * n).all() and abs((copies * size).sum() - target) <= 2


def test_urls(spark):
    rows = [(1, None), (2, "no url"), (3, "http://X.Example.ORG/en/12?q"), (4, "https://a.com"), (5, "http://a.net/free-sex"), (6, "x://porn.net"), (7, "x://essex.net/sex"), (8, "http://notorg/"), (8, "http://notorg/")]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    assert got[:4] == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "x.example.org", "/en/12", "example.org/en/1", "block"), (4, "a.com", "", None, "allow")]
    assert [g[4] for g in got[4:]] == ["block", "block", "allow", "allow", "allow"]


def test_url_words(spark):
    cases = {"x://p%6Frn.net/": "block", "x://a.net/Glu%CC%88cksspiel": "allow", "x://a.net/gl%C3%BCcksspiel/Erotik": "block", "x://a.net/sex-sex-sex": "allow", "x://a.net/érotique?nues": "block", "x://a.net/aporn_b": "allow", "x://a.net/%zz%": "allow", "": "allow", "x://a.net/" + "y" * 500_000 + "/xxx": "block"}
    df = spark.createDataFrame([(k, u, 1.0, "t") for k, u in enumerate(cases)], "page_id long, url string, weight double, host string")
    assert [r.verdict for r in urlfilter.judge(df).orderBy("page_id").collect()] == list(cases.values())
    table = spark.createDataFrame([("Zeppelin", 0.6), ("ship", 0.4), ("ship", 0.5), ("", 9.0), (None, 9.0), ("air", None)], "term string, weight double")
    own = urlfilter.Vocabulary.of(table, 1.0)
    assert own.weights == (("ship", 0.5), ("zeppelin", 0.6))
    urls = spark.createDataFrame([(1, "x://a/zeppelin/ship"), (2, "x://a/ship/ship"), (3, "x://a/airship zeppelin")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.judge(urls, vocabulary=own).orderBy("page_id").collect()] == ["block", "allow", "allow"]
    assert urlfilter.judge(urls, vocabulary=urlfilter.Vocabulary.of(table.limit(0))).where("verdict = 'block'").count() == 0
    assert urlfilter.judge(urls.limit(0)).count() == 0


def test_urls_equal_brute_force(spark):
    rng, pieces = np.random.default_rng(21), ["://", "http", "example", ".", "org", "com", "/", "es/", "en/1", "fr/", "de/", "?", "#", "A", "xxx", "free", "hot", "-", "Ö"]
    urls = ["".join(rng.choice(pieces, int(rng.integers(0, 12)))) for _ in range(3000)] + [None, "", "://", "a://", "://x"]
    rules = urlfilter.Rules().rows
    for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect():
        _, there, rest = (urls[r.page_id] or "").partition("://")
        rest = re.split("[?#]", rest)[0] if there else ""
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
        fit = max((x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])), key=lambda x: len(x[0] + x[1]), default=None)
        words = set(re.findall(r"[^\W_]+", (urls[r.page_id] or "").lower()))
        own = "block" if sum(w for t, w in urlfilter.Vocabulary().weights if t in words) >= 2 else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, fit and fit[0] + fit[1], fit[2] if fit else own), urls[r.page_id]


def test_pii(spark, docs):
    counted(pii.digest(docs), docs)
    text = "a@b.co, 10.0.0.256 1.2.3.4; 4111 1111 1111 1111; +1 (499) 555-6503 é𝒳 GB82 WEST 1234 5698 7654 32 x@y.zz_q@r.st" + " 9.9.9.9" * 300
    (r,) = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    spans = []
    for k in pii.KINDS[:4]:
        for m in re.finditer(k.plain, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k.name != "ip" or all(int(p) < 256 for p in m[0].split(".")), "card": d == "4111111111111111", "phone": 9 <= len(d) <= 15}[k.name]
            spans += [f"{k.name}:{m.start()}:{m.end()}"] if ok else []
    assert [s for s in r.spans.split(",") if not s.startswith("iban")] == spans and "iban" in r.spans
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (3, 301, 1, 1)


def test_ibans_before_other_words(spark):
    de, gb, odd = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "XX" + "{:02d}" + "ABCDE1234567"
    odd = next(t for t in (odd.format(k) for k in range(2, 99)) if int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1)
    spaced = "DE89 3704 0044 0532 0130 00"
    cases = [(f"{de} Please pay", [de]), (f"to {spaced} Bank", [spaced]), (f"{spaced} BIC COBADEFF", [spaced]), (f"{spaced} 2024.", [spaced]), (f"{spaced} {gb} {de}", [spaced, gb, de]), (f"{odd} Ask", [odd]), (f"AB12 3456 7890 123 {spaced} X", [spaced]), (f"{odd} BIC {gb}", [odd, gb]), (f"{de}1 x{de}", []), ("DE88370400440532013000 Please", [])]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in pii.spans(df).collect():
        text, want = cases[r.doc_id]
        assert [x.found for x in r.iban] == want and all(text[x.start : x.end] == x.found for x in r.iban)


def test_pii_equals_brute_force(spark):
    """Every base kind by its definition, on texts made of pieces that its patterns meet at their edges."""
    rng, pieces = np.random.default_rng(8), ["0.0.0.0", "10.0.0.1", "00.1.2.3", "010.1.2.3", "256.1.1.1", "1.2.3.4.5", "0", "00", "255", ".", "@", "a", "a.b", "b-c", "+", "+1 (0) 23", "4111 1111-1111 1111", "4111111111111112", " ", "-", "(", ")", "é", "𝒳", "9", "x@y.zz", "..", ",", "_%"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 14)))) for _ in range(3000)] + [None, "", "10.0.0.1", "127.0.0.1 0.0.0.0"]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    fits = {"email": lambda m, d: True, "ip": lambda m, d: all(int(p) <= 255 for p in m.split(".")), "card": lambda m, d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 9 <= len(d) <= 15}
    got = pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        spans, n = [], {}
        for k in pii.KINDS[:4]:
            found = [m for m in re.finditer(k.plain, texts[r.doc_id] or "") if fits[k.name](m[0], re.sub("[^0-9]", "", m[0]))]
            spans += [f"{k.name}:{m.start()}:{m.end()}" for m in found]
            n[f"n_{k.name}"] = len(found)
        assert {c: r[c] for c in n} == n and r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), texts[r.doc_id]


def test_token_counts_equal_the_library():
    from gleaner.llm.tokenizing import PieceCounts, TextIds

    rng, word, byte = np.random.default_rng(12), vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
    pieces = ["a", " ", "  ", "\n", "\n\n", "\t", "\r\n", "Word", "word.", "x,", "é", "e\u0301", "ñandú", "İ", "ǅ", "ß", "1", "12a", "'s", "it's", "I'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|", "_", "...", "—", "\u00a0", "\u2009", "\x1c", "\x85", "日本", "🙂", "ﬁ", "Ⅷ", "Ċ", "Ġ", "’s", ".", ",", "\x00", "Σ", "ς", "Ж", "ب"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 14)))) for _ in range(4000)] + ["", "<|ENDOFTEXT|>", " " * 300_000 + "b", "a" * 50_000]
    assert PieceCounts(word).count(pa.array(texts)).tolist() == [len(x) for x in ids_of(word, texts)]
    ids = TextIds(byte)
    assert ids.fast is not None and [ids.encode(t).tolist() for t in texts] == ids_of(byte, texts)
    assert TextIds(word).fast is None and TextIds(word).encode("Two words").tolist() == ids_of(word, ["Two words"])[0]


def test_token_counts_use_the_cache(spark, docs, tmp_path):
    path, cache = vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    rows = counted(tokencount.token_counts(docs, path, cache), docs)
    assert all(r.n_tokens == len(ids_of(path, [t or ""])[0]) and r.n_bytes == len((t or "").encode()) for t, r in ((TEXTS[r.doc_id], r) for r in rows if r.doc_id is not None))
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in TEXTS}) and counted(tokencount.token_counts(docs, path, cache), docs)
    assert spark.read.parquet(cache).count() == stored


def test_shards(docs, tmp_path):
    path = vocabulary("byte_bpe_50k.json")
    manifest = repair.write_shards(docs, path, f"file://{tmp_path}/s", shard_ids=3000)
    rows = sorted(counted(repair.read_shards(manifest), docs), key=lambda r: r.start)
    at = 0
    for r, t in zip(rows, ["one", *TEXTS[:5], TEXTS[4], *TEXTS[5:]], strict=True):
        ids = np.array([*ids_of(path, [t or ""])[0], 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert repair.write_shards(docs.limit(0), path, f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("vocabulary_size", [50_257, 100_000])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 5000])
def test_grammar(n, vocabulary_size):
    for kinds in (2, 40, 5000, vocabulary_size):
        ids = vocabulary_size - 1 - np.random.default_rng(n).zipf(1.3, n) % kinds
        symbols, rules = repair.compress(ids, vocabulary_size)
        assert np.array_equal(repair.expand(symbols, *repair.expansions(vocabulary_size, rules)), ids)
    with pytest.raises(ValueError):
        repair.compress(np.array([vocabulary_size]), vocabulary_size)


def test_grammar_goes_on_while_it_can():
    ids = np.random.default_rng(3).zipf(1.2, 60_000) % 3000 + 1
    symbols, rules = repair.compress(ids, 50_257)
    pairs = symbols[:-1].astype(np.int64) << 16 | symbols[1:]
    most = np.unique(pairs, return_counts=True)[1].max()
    assert most < repair.LEAST or len(rules) == (1 << 16) - 50_257
    assert len(rules) > 500


def test_sizes_equal_a_plain_count(spark):
    import time

    rng, pieces = np.random.default_rng(9), ["a", "é", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x85", "\u2028", "\u2029", "\u00a0", "\x1c"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 9)))) for _ in range(2000)] + [None, "", "abc \u0085", "abc \u2028", "a" + " " * 1_000_000 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.n for r in df.select("doc_id", mixing.size_of(F.col("text")).alias("n")).collect()}
    assert time.time() - began < 60
    assert got == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}


def test_packages(spark, tmp_path):
    long = "<p>" + "y" * 2000
    rows = [(1, "u1", long), (5, "u5", long), (3, None, None), (4, "u\n4", "é" * 400), (6, "u6", "short"), (7, "u7", "short"), (5, "u5", long), (None, "n", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    made = warc.write_packages(pages, f"file://{tmp_path}/w", package_bytes=3000)
    got = sorted(warc.read_packages(made).collect(), key=str)
    assert len(got) == len(rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(1, "revisit", 5), (5, "response", None), (3, "response", None), (4, "response", None), (6, "response", None), (7, "response", None), (None, "revisit", 5)}
    assert {r.payload_bytes for r in got if r.page_id in (1, 5)} == {2003} and next(r for r in got if r.page_id == 4).payload_bytes == 800
    paths = [r.path for r in made.collect()]
    assert b"short" in warc.find(paths, 6) and warc.find(paths, 99) is None


def test_zip64_directory(tmp_path):
    import struct

    from gleaner.llm import files

    body, name = b"stored bytes", b"big.bin"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, len(local) + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (tmp_path / "z.zip").write_bytes(local + central + end64 + locator + end)
    file = files.Ranges(f"file://{tmp_path}/z.zip")
    (member,) = warc.directory(file).values()
    assert file.read(warc.data_start(file, member), member.size) == body


def test_media(docs):
    rows = counted(media.features(media.to_media(docs)), docs)
    texts = dict(enumerate(TEXTS)) | {None: "one"}
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({r.media_sha256 for r in rows}) == len({t or "" for t in TEXTS})
    assert counted(media.features(media.to_media(docs.limit(0))), docs.limit(0)) == []
    one = media.pixel_arrays(media.to_media(docs.where("doc_id = 3"))).first()
    assert one.pixels.samples == b"".join(bytes([c, c, c, 255]) for c in b"one" + bytes(61)) and (one.pixels.height, one.pixels.width) == (1, 64)
