"""The index in buckets: what a sync reads and rewrites, growth, empty buckets, lost jobs, repeated batches."""

import pytest
from pyspark.sql import functions as F
from test_engine import records, report

from lodestone.operators import models
from lodestone.operators.index import VectorIndex
from lodestone.streaming import sync_stream


@pytest.fixture
def store(spark, tmp_path):
    return VectorIndex(spark, str(tmp_path / "i"), bucket_rows=10)


def files(tmp_path):
    return {str(p.relative_to(tmp_path / "i")): p.stat().st_mtime_ns for p in (tmp_path / "i/rows").glob("bucket=*/*.parquet")}


def shown(store):
    return sorted((r.record_id, r.title, r.text, list(r.embedding)) for r in store.rows().collect())


def expected(texts, titles=None):
    return sorted((i, (titles or {}).get(i, f"title {i}"), t, [float(len(t)), 1.0]) for i, t in texts.items())


def test_a_sync_touches_only_its_buckets(spark, store, tmp_path):
    e, texts = models.length_embedder(), {f"r{k}": "x" * k for k in range(100)}
    assert report(store.sync(records(spark, texts), e)) == (100, 0, 0, 100, False)
    before = files(tmp_path)
    assert len(before) == 10 and shown(store) == expected(texts)
    texts["r7"] = "changed"
    assert report(store.sync(records(spark, texts), e)) == (1, 99, 0, 100, False)
    after = files(tmp_path)
    assert len(after) == 10 and len(before.items() - after.items()) == 1  # one file went, one came
    assert shown(store) == expected(texts)
    assert report(store.sync(records(spark, texts), e)) == (0, 100, 0, 100, False) and files(tmp_path) == after  # nothing to do, nothing written
    # a title alone: the row is rewritten, the text isn't embedded again
    counted = models.Embedder(e.name, e.fingerprint, 2, lambda t: F.raise_error(F.lit("embedded")).cast("array<float>"), e.questions)
    moved = records(spark, texts).withColumn("title", F.when(F.col("record_id") == "r9", "new").otherwise(F.col("title")))
    assert report(store.sync(moved, counted)) == (0, 100, 0, 100, False)
    assert len(after.items() - files(tmp_path).items()) == 1 and shown(store) == expected(texts, {"r9": "new"})


def test_lookups_read_only_their_buckets(spark, store):
    store.sync(records(spark, {f"r{k}": "x" for k in range(100)}), models.length_embedder())
    touched, part = store._part(spark.createDataFrame([("r3",)], "record_id string"), 10)
    assert len(touched) == 1 and f"(bucket#" in part._jdf.queryExecution().toString() and part.count() < 40
    text = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text or "PartitionFilters: [(bucket" in text or f"= {touched[0]})" in text


def test_buckets_that_become_empty(spark, store, tmp_path):
    e = models.length_embedder()
    texts = {f"r{k}": "x" for k in range(40)}
    store.sync(records(spark, texts), e)
    assert report(store.sync(records(spark, {"r1": "x"}), e)) == (0, 1, 39, 1, False)
    assert shown(store) == expected({"r1": "x"}) and store.count() == 1
    store.delete(spark.createDataFrame([("r1",), ("none",)], "record_id string"))
    assert store.count() == 0 and store.exists()
    store.upsert(store.rows().unionByName(spark.createDataFrame([("n", None, "text", "t", 1, 1, "x", "h", [1.0])], store.rows().schema)))
    assert [r.record_id for r in store.rows().collect()] == ["n"]


def test_growth_makes_more_buckets(spark, store, tmp_path):
    e = models.length_embedder()
    store.sync(records(spark, {"a": "x"}), e)
    assert len(files(tmp_path)) == 1
    texts = {f"r{k}": "x" * (k % 5) for k in range(60)}
    assert report(store.sync(records(spark, texts), e)) == (60, 0, 1, 60, False)
    assert len(files(tmp_path)) == 6 and shown(store) == expected(texts)


def test_a_lost_sync_leaves_the_index(spark, store):
    e, texts = models.length_embedder(), {f"r{k}": "x" for k in range(30)}
    store.sync(records(spark, texts), e)
    bad = models.Embedder(e.name, e.fingerprint, 2, lambda t: F.raise_error(F.lit("no model")).cast("array<float>"), e.questions)
    with pytest.raises(Exception, match="no model"):
        store.sync(records(spark, texts | {"r1": "other"}), bad)
    assert shown(store) == expected(texts)
    assert report(store.sync(records(spark, texts | {"r1": "other"}), e)) == (1, 29, 0, 30, False)


def test_batches_that_run_twice(spark, store, tmp_path):
    e = models.length_embedder()
    src = str(tmp_path / "in")
    records(spark, {"a": "x", "b": "yy"}).write.parquet(src)
    stream = lambda mark: sync_stream(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), store, e, str(tmp_path / mark)).awaitTermination(60)
    stream("one")
    first = shown(store)
    stream("two")  # all batches again
    assert shown(store) == first == expected({"a": "x", "b": "yy"})
    twice = records(spark, {"a": "zzz"}).unionByName(records(spark, {"a": "zz"}))
    twice.write.mode("append").parquet(src)
    stream("one")
    assert shown(store) == expected({"a": "zzz", "b": "yy"})
