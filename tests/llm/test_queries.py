import pytest

from gleaner.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.same import assert_same


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SMALL), duck.sql(ORACLES[name]))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    out = corpus_pipeline.run(spark, SMALL)
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "mixing", "token-ids"]
    assert rows and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert docs.join(out.select("doc_id").distinct(), "doc_id").count() == out.agg(F.countDistinct("doc_id")).first()[0]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, ties and columns with the names that stages use inside."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    inner = ["doc_id_", "copies_", "copy_", "gone_", "node", "score", "n", "size", "group_id", "rank_"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in inner)
    texts = [None, "", " \n", "one", "one two three four five six", "one two three four five six", "x " * 3000]
    rows = [(k if k % 3 else None, t, None, "s" if k % 2 else None, None, *inner) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4], rows[4]], schema)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "one two three four")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            assert out.columns == docs.columns
            n = out.count()
            assert n == 0 if given is not docs else n > 0, name
            if given is docs and name in ("toxicity", "decontamination"):
                assert n == docs.count()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert ids.count() == docs.count() and ids.agg(F.sum("n_tokens")).first()[0] > docs.count()


def test_fingerprint_groups_beyond_the_limit(spark, monkeypatch):
    """Hot groups are dealt anew, level after level, and lose no link."""
    import numpy as np

    from gleaner.llm import hamming

    rng = np.random.default_rng(23)
    centre = rng.integers(0, 1 << 62, 3)
    flips = np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 62, (3, 40, 3)), axis=2)
    x = np.unique(np.r_[(centre[:, None] ^ flips).ravel(), rng.integers(0, 1 << 62, 60)])
    got = hamming.hamming_links(spark.createDataFrame([(int(v), int(v)) for v in x], "id long, print long"), limit=4).collect()
    label = {int(v): int(v) for v in x}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for r in got:
        label[max(root(r.a), root(r.b))] = min(root(r.a), root(r.b))
    mine = {v: root(v) for v in label}
    label = {v: v for v in label}
    for i, a in enumerate(x.tolist()):
        for b in x.tolist()[:i]:
            if (a ^ b).bit_count() <= 3:
                label[max(root(a), root(b))] = min(root(a), root(b))
    assert mine == {v: root(v) for v in label}
