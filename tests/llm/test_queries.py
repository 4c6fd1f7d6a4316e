import pytest
from conftest import rows_of

from lodestone.llm import queries

N = {"documents": 200, "pages": 50}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    if name in queries.ORACLE_SQL:
        assert rows_of(got) == rows_of(duck.execute(queries.ORACLE_SQL[name]))
    else:
        assert got.count() == {"op3_nearest_neighbours": 50, "op7_url_filter": 50}.get(name, 200)


def test_one_of_each_group_of_odd_rows(spark):
    """Copies go also where doc_ids are null or repeat."""
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a, "u"), (2, a + " end", "u"), (None, a, "u"), (None, b, "u"), (None, b, "u"), (None, b + " end", "u"), (3, c, "u"), (3, c, "u"), (4, d, "u"), (4, c, "u"), (5, "short", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    got = corpus_pipeline.one_of_each_group(spark, docs, None)
    assert got.columns == docs.columns
    got = sorted(((r.doc_id, r.text[:2], r.doc) for r in got.collect()), key=str)
    assert got == [(1, "a0", "u"), (3, "c0", "u"), (4, "d0", "u"), (5, "sh", "u"), (None, "b0", "u")]


def test_pipeline(spark, sf):
    """Each stage against what its operator's brute force says of that stage's input."""
    import corpus_pipeline
    from test_operators import groups_of, repeats

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
        after = stage(spark, docs, sf)
        if name != "pieces":
            assert after.columns == docs.columns
        rows = after.collect()
        ids = sorted(r.doc_id for r in rows)
        if name == "near_duplicates":
            assert ids == sorted(i for i, (_, c) in groups_of(before).items() if i == c)
        if name == "repeats":
            want = repeats(before)
            assert ids == sorted(i for i, x in want.items() if x[1] < x[0])
            assert all(r.n_chars == len(r.text) for r in rows if want[r.doc_id][1])
        if name == "quality":
            assert 0 < len(ids) < len(before)
        if name == "mix":
            assert set(ids) < {i for i, _ in before}
        if name == "pieces":
            assert len(ids) == len(before)
        docs = spark.createDataFrame(rows, after.schema) if rows else after
