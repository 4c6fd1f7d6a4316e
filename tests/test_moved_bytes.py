"""What steps shuffle: rows of unique keys stay where they are, and a text is moved no more often than it must be."""

import hashlib
import time

from pyspark.sql import functions as F

from jobs import passages as job
from lodestone import streaming
from lodestone.operators import corpus, index, models, passages


def shuffled(spark, run):
    """Bytes that are written for shuffles while run() runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        time.sleep(1)
        seen = store.executorList(False)
        return sum(seen.apply(k).totalShuffleWrite() for k in range(seen.size()))

    before = total()
    run()
    return total() - before


def records(spark, n=1500):
    """Texts that don't compress well, 2 KB each."""
    text = lambda k: " ".join(hashlib.sha256(f"{k}:{j}".encode()).hexdigest() for j in range(32))
    rows = [(str(k), None, "text", f"t{k}", [1], text(k)) for k in range(n)]
    return spark.createDataFrame(rows, "record_id string, parent_id string, content_type string, title string, pages array<int>, text string"), sum(len(r[5]) for r in rows)


def test_unique_is_lookup(spark):
    rows = [(1, "a"), (2, "b"), (2, "c"), (2, None), (None, "x"), (None, "y"), (3, None), (4, "d"), (4, "d")]
    df = spark.createDataFrame(rows, "k long, v string")
    key = lambda r: (r.k is None, r.k or 0)
    assert sorted(corpus.unique(df, "k").collect(), key=key) == sorted(corpus.lookup(df, "k").collect(), key=key)
    alone = df.where("k in (1, 3)")
    assert corpus.unique(alone, "k") is alone


def test_passages_move_a_text_twice(spark):
    docs = spark.createDataFrame([(1, "a b\n \nc"), (2, "\t  ")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    plan = passages.cut(docs, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 3  # the window's, the grouping's that the join shares, and the documents' other columns
    assert [tuple(r) for r in passages.cut(docs, 2).orderBy("passage_no").select("passage_no", "text").collect()] == [(1, "a b"), (2, "c")]


def test_words_are_not_counted_to_find_one(spark):
    rows = [(1, "a"), (2, " 　\n"), (3, ""), (4, None), (None, "a"), (5, " \u0000")]
    x = spark.createDataFrame(rows, "doc_id long, text string").withColumn("reason", job.faulty())
    assert "regexp_count" not in x._jdf.queryExecution().analyzed().toString()
    assert {(r.doc_id, r.reason) for r in x.collect()} == {(1, None), (2, "no_words"), (3, "no_words"), (4, "no_words"), (None, "no_id"), (5, None)}


def test_current_moves_no_passage_without_newer_versions(spark, tmp_path):
    r, size = records(spark)
    docs = r.select(F.col("record_id").cast("long").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"))
    job.write_batch(docs, 0, f"{tmp_path}/out", 10)
    assert shuffled(spark, lambda: job.current(spark, f"{tmp_path}/out").write.format("noop").mode("overwrite").save()) < size / 4
    job.write_batch(docs.where("doc_id < 3").withColumn("text", F.when(F.col("doc_id") > 0, F.lit("new")).otherwise(" ")), 1, f"{tmp_path}/out", 10)
    got = job.current(spark, f"{tmp_path}/out")
    assert [r.text for r in got.where("doc_id < 3").collect()] == ["new", "new"] and got.select("doc_id").distinct().count() == 1499


def test_sync_moves_texts_three_times(spark, tmp_path):
    r, size = records(spark)
    store, e = index.VectorIndex(spark, f"{tmp_path}/index", 500), models.length_embedder()
    assert shuffled(spark, lambda: store.sync(r, e)) < 1.5 * size
    two = r.where("record_id % 10 <> 9").withColumn("text", F.when(F.expr("record_id % 7 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("title", F.when(F.expr("record_id = 5"), "new").otherwise(F.col("title")))
    assert shuffled(spark, lambda: store.sync(two, e)) < 2.8 * size
    got = {x.record_id: (x.title, x.text, x.embedding[0]) for x in store.rows().collect()}
    assert got == {x.record_id: (x.title, x.text, float(len(x.text))) for x in two.collect()}


def test_stream_moves_texts_once_a_batch(spark, tmp_path):
    r, size = records(spark)
    store, e = index.VectorIndex(spark, f"{tmp_path}/index", 500), models.length_embedder()

    def run():
        streaming.sync_stream(spark.readStream.schema(r.schema).parquet(f"{tmp_path}/records"), store, e, f"{tmp_path}/mark").awaitTermination()

    r.write.parquet(f"{tmp_path}/records")
    assert shuffled(spark, run) < 1.5 * size
    r.where("record_id % 3 = 0").withColumn("text", F.concat("text", F.lit("!"))).write.mode("append").parquet(f"{tmp_path}/records")
    assert shuffled(spark, run) < 1.8 * size
    assert store.rows().where("text like '%!'").count() == 500 and store.count() == 1500
