import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.config import HOME, Settings
from lodestone.errors import ConfigurationError, CorpusError, IndexNotBuiltError, IndexStaleError, ModelError
from lodestone.functions import text as T
from lodestone.operators import models, retrieval, tables
from lodestone.operators.index import VectorIndex
from lodestone.plans.engine import Engine, build_engine


def records(spark, texts):
    return spark.createDataFrame([(i, None, "text", "d", f"title {i}", [1], t, 1) for i, t in texts.items()], "record_id string, parent_id string, content_type string, document_id string, title string, pages array<int>, text string, token_count int")


def report(df):
    return tuple(df.select("embedded", "unchanged", "deleted", "total", "rebuilt").first())


def test_index_sync(spark, tmp_path):
    store, e = VectorIndex(spark, str(tmp_path / "i")), models.length_embedder()
    assert not store.exists() and store.count() == 0 and store.metadata() == {}
    with pytest.raises(IndexNotBuiltError):
        store.guard(e)
    assert report(store.sync(records(spark, {"a": "x", "b": "yy", "c": "z"}), e)) == (3, 0, 0, 3, False)
    assert report(store.sync(records(spark, {"a": "x", "b": "yy", "c": "z"}), e)) == (0, 3, 0, 3, False)
    assert report(store.sync(records(spark, {"a": "x!", "b": "yy"}), e)) == (1, 1, 1, 2, False)
    store.guard(e)
    from dataclasses import replace

    other = replace(e, fingerprint="other")
    with pytest.raises(IndexStaleError):
        store.guard(other)
    assert report(store.sync(records(spark, {"a": "x!", "b": "yy"}), other)) == (2, 0, 0, 2, True)
    assert report(store.sync(records(spark, {"a": "x!"}), other, rebuild=True)) == (1, 0, 0, 1, True)
    assert sorted(r.embedding for r in store.rows().collect()) == [[2.0, 1.0]]
    store.upsert(store.rows().withColumn("record_id", F.lit("n")))
    assert store.count() == 2
    store.delete(spark.createDataFrame([("a",)], "record_id string"))
    assert [r.record_id for r in store.rows().collect()] == ["n"]
    store.reset()
    assert not store.exists() and store.count() == 0


def candidates(spark, rows):
    return spark.createDataFrame([(1, *r, i) for i, r in enumerate(rows, 1)], "qid long, record_id string, parent_id string, content_type string, title string, start_page int, end_page int, text string, rerank_rank int")


def test_context(spark):
    c = candidates(spark, [("r1", None, "text", "old", 1, 1, "passage"), ("t1", "p", "table_child", "k", 2, 2, "rows"), ("t2", "p", "table_child", "k", 2, 2, "more rows"), ("t3", "gone", "table_child", "k", 3, 3, "alone")])
    live = spark.createDataFrame([("r1", "new")], "record_id string, title string")
    parents = spark.createDataFrame([("p", "Whole", [5, 7], "the table")], "record_id string, title string, pages array<int>, text string")
    kept = retrieval.first_distinct(c, "qid", retrieval.source_key(), 4)
    got = {r.record_id: r for r in retrieval.context(kept, live, parents).collect()}
    assert set(got) == {"r1", "t1", "t3"}
    assert got["r1"].title == "new" and not got["r1"].expanded
    assert (got["t1"].title, got["t1"].start_page, got["t1"].end_page, got["t1"].section, got["t1"].expanded) == ("Whole", 5, 7, "the table", True)
    assert got["t3"].section == "alone" and got["t3"].parent_id == "gone" and not got["t3"].expanded
    assert retrieval.first_distinct(c, "qid", retrieval.source_key(), 2).count() == 2


def test_budget_fold_matches_a_plain_loop(spark):
    rng, rows, want = random.Random(4), [], {}
    for q in range(120):
        budget, left, out = rng.choice([0, 30, 90, 200, 600]), None, []
        left = budget
        for n in range(1, rng.randint(2, 5)):
            section, passage, expanded = "s" * rng.randint(0, 200) + " " * rng.randint(0, 3), "p" * rng.randint(0, 60), rng.random() < 0.5
            rows.append((q, budget, n, f"t{n}", n, n + n % 2, "text", f"r{n}", None, passage, section, expanded))
        for _, _, n, title, a, b, _, rid, _, passage, section, expanded in [r for r in rows if r[0] == q]:
            if left <= 0:
                break
            pages = str(a) if a == b else f"{a} - {b}"
            head = f"[Source {len(out) + 1}] {title} (pages {pages})\n" + (f"Matched rows:\n{passage}\nWhole table:\n" if expanded else "")
            if len(head) >= left:
                break
            room = left - len(head)
            body = section if len(section) <= room else T.NOTE[:room] if room <= len(T.NOTE) else section[: room - len(T.NOTE)].rstrip() + T.NOTE
            out.append((rid, head + body, len(section) > room))
            left -= len(head + body)
        want[q] = out
    df = spark.createDataFrame(rows, "qid long, budget int, source_no int, title string, start_page int, end_page int, content_type string, record_id string, parent_id string, passage string, section string, expanded boolean")
    got = {r.qid: [(s.record_id, s.text, s.cut) for s in r.sources] for r in retrieval.budgeted(df, ["qid", "budget"], F.col("budget")).collect()}
    assert got == {q: x for q, x in want.items() if q in got} and len(got) == len({r[0] for r in rows})


def test_rerank_is_stable(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, None), (1, "c", 3, 0.5), (1, "d", 4, 0.9)], "qid long, record_id string, rank int, s double")
    assert [r.record_id for r in retrieval.rerank(df, F.col("s"), 3).orderBy("rerank_rank").collect()] == ["d", "a", "c"]


def envelope(rid, kind, text, parent=None, pages=(1,), caption=(), heads=()):
    return {
        "schema_version": "1.0.0", "record_id": rid, "parent_id": parent, "content_type": kind, "source": {"document_id": "d", "source_filename": "f", "pages": list(pages), "locators": {}},
        "content": {"text": text, "markdown": None}, "metadata": {"token_count": 3, "tokenizer_name": "words", "caption": list(caption), "headings": list(heads)},
    }


@pytest.fixture
def engine(spark, tmp_path):
    rows = [envelope(f"d:text:{i:06d}", "text", t, heads=["H", str(i)]) for i, t in enumerate(["data quality rules", "metadata", "who owns the data", "a table of costs"])]
    rows.append(envelope("d:table:000:child:001", "table_child", "row one costs 5", "d:table:000:parent:000", caption=["Costs"]))
    (tmp_path / "r.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    (tmp_path / "p.jsonl").write_text(json.dumps(envelope("d:table:000:parent:000", "table_parent", "| all | costs |", caption=["Costs"])) + "\n")
    s = Settings({"paths.records": str(tmp_path / "r.jsonl"), "paths.parents": str(tmp_path / "p.jsonl"), "paths.index": str(tmp_path / "index")})
    return build_engine(spark, s)


def test_engine(engine):
    with pytest.raises(IndexNotBuiltError):
        engine.search(engine.questions("costs"))
    assert report(engine.index()) == (5, 0, 0, 5, False)
    q = engine.questions("row costs", "什麼是資料")
    assert engine.search(q, 3).groupBy("qid").count().collect()[0][1] == 3
    got = {r.qid: r for r in engine.answer(q).collect()}
    assert "Whole table:\n| all | costs |" in got[1].prompt and "English" in got[1].prompt and "Traditional Chinese" in got[2].prompt
    assert [c.source_id for c in got[1].citations] == [f"Source {i}" for i in range(1, 5)]
    assert got[1].answer.endswith("[Source 1]")
    with pytest.raises(ValueError):
        engine.questions(" \n")


def test_orphans_and_bad_lines(spark, tmp_path, engine):
    (tmp_path / "p.jsonl").write_text(json.dumps(envelope("other:table:000:parent:000", "table_parent", "x")) + "\n")
    with pytest.raises(CorpusError):
        build_engine(spark, engine.settings)
    (tmp_path / "r.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="bad JSON"):
        build_engine(spark, engine.settings)


def test_no_answer_is_an_error(spark):
    with pytest.raises(Exception, match="no answer"):
        models.generate(spark.createDataFrame([("q",)], "prompt string"), models.LanguageModel("mute", lambda p: "")).collect()
    assert issubclass(ModelError, Exception)


def test_settings():
    s = Settings.from_env({"LODESTONE_RETRIEVAL_RETRIEVE_K": "30", "LODESTONE_EMBEDDING_NORMALIZE": "no", "LODESTONE_EMBEDDING_MAX_LENGTH": "0", "LODESTONE_PROMPT_ANSWER_LANGUAGE": ""})
    assert s.retrieval.retrieve_k == 30 and not s.embedding.normalize and s.embedding.max_length is None and s.prompt.answer_language == "auto"
    with pytest.raises(ConfigurationError):
        Settings.from_env({"LODESTONE_RETRIEVAL_RETRIEVE_K": "x"})
    with pytest.raises(ConfigurationError):
        Settings({"retrieval.retrieve_k": 4, "retrieval.rerank_k": 8})
    with pytest.raises(ConfigurationError):
        Settings({"retrieval.no_such": 1})
    assert s.replace(prompt__max_context_chars=10).prompt.max_context_chars == 10 and s.describe()["retrieval.max_sources"] == 4


def test_places(tmp_path, monkeypatch):
    """Defaults lie beside the package wherever a job starts; a given relative path begins at the working directory."""
    monkeypatch.chdir(tmp_path)
    s = Settings.from_env({"LODESTONE_PATHS_INDEX": "own/index", "LODESTONE_PATHS_PARENTS": "file:///x/y"})
    assert s.paths.records == f"{HOME}/data/records" and s.paths.index == str(tmp_path / "own/index") and s.paths.parents == "file:///x/y"


def test_split_row():
    text = "alpha beta " + "x" * 30 + " gamma"
    count = len
    parts = tables.split_row(text, "", 12, count)
    assert "".join(parts).replace(" ", "") == text.replace(" ", "") and all(len(p) <= 12 for p in parts)
    with pytest.raises(ValueError):
        tables.split_row("a", "p" * 20, 12, count)


def test_cli(capsys, monkeypatch, engine, spark):
    from lodestone import cli

    assert cli.main(["info"]) == 0 and "retrieval.retrieve_k" in capsys.readouterr().out
    for k, v in (("RECORDS", engine.settings.paths.records), ("PARENTS", engine.settings.paths.parents), ("INDEX", engine.settings.paths.index)):
        monkeypatch.setenv(f"LODESTONE_PATHS_{k}", v)
    assert cli.main(["doctor"]) == 1 and "no vectors" in capsys.readouterr().out
    assert cli.main(["search", "costs"]) == 1
    assert cli.main(["index"]) == 0 and cli.main(["doctor"]) == 0
    assert cli.main(["ask", "row costs", "--language", "en", "--json"]) == 0 and "Source 1" in capsys.readouterr().out


def test_streams(spark, tmp_path, engine):
    from lodestone.streaming import answer_stream, sync_stream

    src = tmp_path / "in"
    engine.records.write.parquet(str(src))
    sync_stream(spark.readStream.schema(engine.records.schema).parquet(str(src)), engine.store, engine.embedder, str(tmp_path / "c1")).awaitTermination(60)
    assert engine.store.count() == 5
    engine.questions("row costs").write.parquet(str(tmp_path / "q"))
    answer_stream(spark.readStream.schema("qid long, question string").parquet(str(tmp_path / "q")), engine, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_empty_questions(spark, engine):
    engine.index()
    assert isinstance(engine, Engine) and engine.search(spark.createDataFrame([], "qid long, question string")).count() == 0
