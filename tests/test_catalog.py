import pytest
from conftest import rows_of

from lodestone.plans import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE:
        assert rows_of(got) == rows_of(duck.execute(catalog.ORACLE[name]))
    else:
        assert got.count() > 0


def test_whole_funnel(spark, sf, tmp_path):
    """Every benchmark item is asked, also those of 40 and more, and every hundredth vector; against brute force."""
    import numpy as np

    for name in ("embeddings", "documents", "benchmark"):
        x = spark.read.parquet(f"{sf}/{name}.parquet")
        (x.withColumn("item_id", x["item_id"] * 7) if name == "benchmark" else x).write.parquet(f"{tmp_path}/{name}.parquet")
    sf = str(tmp_path)

    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet").collect()
    v = {r.vec_id: np.array(r.embedding, dtype=float) for r in read("embeddings")}
    ids, x = np.array(sorted(v)), np.array([v[i] for i in sorted(v)])

    def nearest(q):
        d = ((x - v[q]) ** 2).sum(axis=1)
        return ids[np.lexsort((ids, d))[:20]].tolist()

    got = {}
    for r in sorted(catalog.QUERIES["knn_topk"](spark, sf).collect(), key=lambda r: (r.q, r["rank"])):
        got.setdefault(r.q, []).append(r.vec_id)
    assert got == {q: nearest(q) for q in v if q % 100 == 0}
    texts, asked = {r.doc_id: r.text for r in read("documents")}, {r.item_id: r.text for r in read("benchmark")}
    terms = lambda t: set((t or "").lower().split()) - {""}
    best = {}
    for q in asked.keys() & v.keys():
        score = lambda d: len(terms(asked[q]) & terms(texts[d])) / max(len(terms(asked[q])), 1)  # noqa: B023, E731
        found = [d for d in nearest(q) if d in texts]
        best[q] = sorted(found, key=lambda d: (-score(d), nearest(q).index(d)))[:8]  # noqa: B023
    got = {}
    for r in sorted(catalog.QUERIES["lexical_rerank"](spark, sf).collect(), key=lambda r: (r.item_id, r["rank"])):
        got.setdefault(r.item_id, []).append(r.doc_id)
    want = {q: b for q, b in best.items() if b}
    assert got == want and max(want) >= 40
    for name in ("funnel_sources", "budget_prompt", "prompt_citations", "generated_answers"):
        assert {r.item_id for r in catalog.QUERIES[name](spark, sf).select("item_id").collect()} == set(want), name


def test_entry_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())


def test_entry_without_llm():
    """The entry works where the folder of the corpus operators and the pipeline are gone."""
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "lodestone.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "knn_topk" in e.queries() and "pipeline" not in e.queries() and not any(k.startswith("op") and k[2].isdigit() for k in e.oracle_sql())
"""
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)
