"""The registered queries against their SQL on the smallest tables, and the pipeline."""

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from gaugeflow.llm import oracle, quality, queries
from tests.llm.test_text_operators import WORD, lower, plain_features, similar_components, targets

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, str(DATA))
    rows = df.collect()
    assert rows
    sql = oracle.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'").fetchall()
        cursor = c.execute(sql)
        columns = sorted(d[0] for d in cursor.description)
        place = [[d[0] for d in cursor.description].index(k) for k in columns]
        assert columns == sorted(df.columns)
        assert sorted(repr(tuple(r[i] for i in place)) for r in cursor.fetchall()) == sorted(repr(tuple(r[k] for k in columns)) for r in rows)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, str(DATA))
        assert found.columns == docs.columns
    kept = found.select("doc_id").distinct().count()
    assert 0.5 * docs.count() < kept < docs.count()
    assert corpus_pipeline.run(spark, str(DATA)).count() == found.count()


def mixture(rows):
    """Copies of (doc_id, text, source) by ranks, plain: an offset per source, a copy per whole number crossed."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    total = Counter()
    for i, _, source in rows:
        total[source] += size[i]
    want = targets(dict(total))
    copies = {}
    for source in total:
        key = "n" if source is None else "s" + source
        digits = lambda text, n: int(hashlib.md5(text.encode()).hexdigest()[:n], 16)
        step = lambda n: n if n < 64 else 32 * n.bit_length() + n // 2 ** (n.bit_length() - 6)
        ids = sorted((step(size[i]), digits(str(i), 2), size[i], i) for i, _, s in rows if s == source)
        offset, rate = digits("mix:" + key, 8) / 2**32, want[source] / total[source] if total[source] else 0.0
        for rank, (*_, i) in enumerate(ids):
            copies[i] = math.floor(offset + rate * (rank + 1)) - math.floor(offset + rate * rank)
    return Counter({i: n for i, n in copies.items() if n})


def test_pipeline_by_reference(spark):
    """Every stage against plain Python on the smallest tables."""
    import numpy as np

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    x = np.array([plain_features(t or "") for _, t, _ in rows], np.float32)
    z = np.clip((x - model.mean) * model.scale, -6, 6) @ model.weight + model.bias
    good = {r[0] for r, v in zip(rows, z) if 1 / (1 + math.exp(-v)) >= 0.3}
    found = stages[0](spark, docs, str(DATA))
    assert ids(found) == sorted(good)

    rows = [r for r in rows if r[0] in good]
    rows = [r for place, (r, (n, first)) in enumerate(zip(rows, similar_components([t for _, t, _ in rows], 5, 80))) if first == place]
    found = stages[1](spark, found, str(DATA))
    assert ids(found) == [i for i, _, _ in rows]

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    rows = [r for r in rows if not hit(split(r[1]))]
    found = stages[2](spark, found, str(DATA))
    assert ids(found) == [i for i, _, _ in rows]

    mixed = mixture(rows)
    found = stages[3](spark, found, str(DATA))
    assert Counter(ids(found)) == mixed

    out = corpus_pipeline.run(spark, str(DATA)).collect()
    assert Counter(r.doc_id for r in out) == mixed
    text = {i: t or "" for i, t, _ in rows}
    held = Counter()
    for r in out:
        assert r.size == len(text[r.doc_id].encode()) + 16 and 0 <= r.shard < 40
        held[r.shard] += r.size
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in Counter(r.shard for r in out).items())


@pytest.mark.parametrize("case", ["empty", "nulls"])
def test_stages_on_odd_tables(spark, tmp_path, case):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [] if case == "empty" else [(None, None, None, None, None), (None, "some words here", None, None, None), (1, "some words here", "en", "s", 3), (1, "some words here", "en", "s", 3), (2, "", "en", None, 0), (3, "x " * 30_000, None, "s", None)]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([] if case == "empty" else [(1, 1, 0), (None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([] if case == "empty" else [(1, None), (None, "rare phrase")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [k.split()[0] for k in kinds.split(", ")]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
