"""The jobs: two runs over growing input, reruns, failures half-way, odd rows, command lines."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import rows_of

from jobs import answers, passages, queries
from lodestone.operators import answers as asking
from lodestone.operators import models


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, duck, name):
    assert rows_of(queries.QUERIES[name](spark, sf)) == rows_of(duck.execute(queries.ORACLE_SQL[name]))


def docs(spark, rows):
    return spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def texts(df):
    return sorted((r.doc_id, r.passage_no, r.text, r.lang) for r in df.collect())


def test_passages_of_growing_input(spark, tmp_path):
    source, target, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    run = lambda: passages.run(spark, source, target, mark, 4)
    docs(spark, [(1, "a b c\nd e\n\nf g h i j k", "en", "s"), (2, "  \n ", "en", "s"), (3, None, "en", "s"), (None, "lost", "en", "s"), (4, "é  ü", None, None)]).coalesce(1).write.mode("append").parquet(source)
    assert run() == {"batches": 1, "documents": 2, "passages": 5, "words": 13, "rejected": 3}
    first = texts(passages.current(spark, target))
    assert first == [(1, 1, "a b c", "en"), (1, 2, "d e", "en"), (1, 3, "f g h i", "en"), (1, 4, "j k", "en"), (4, 1, "é ü", "und")]
    written = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.glob("out/**/*.parquet"))
    assert run()["batches"] == 0 and texts(passages.current(spark, target)) == first  # nothing new
    # one document changes, one loses its text, one is new and there twice
    docs(spark, [(1, "now this", "fr", "s"), (4, "", "en", "s"), (5, "z", "en", "s"), (5, "z", "en", "s")]).coalesce(1).write.mode("append").parquet(source)
    assert run() == {"batches": 1, "documents": 2, "passages": 2, "words": 3, "rejected": 1}
    assert texts(passages.current(spark, target)) == [(1, 1, "now this", "fr"), (5, 1, "z", "en")]
    assert set(written) <= {str(p.relative_to(tmp_path)) for p in tmp_path.glob("out/**/*.parquet")}  # the old batch was left alone
    reasons = {(r.doc_id, r.reason, r.batch) for r in spark.read.parquet(f"{target}/rejected").collect()}
    assert reasons == {(2, "no_words", 0), (3, "no_words", 0), (None, "no_id", 0), (4, "no_words", 1)}
    # a batch that is run again replaces its own files
    before = texts(passages.current(spark, target))
    passages.write_batch(docs(spark, [(1, "now this", "fr", "s"), (4, "", "en", "s"), (5, "z", "en", "s")]), 1, target, 4)
    assert texts(passages.current(spark, target)) == before


def test_passages_after_a_failure(spark, tmp_path, monkeypatch):
    """A run that fails in its second batch goes on there; the result is that of one run."""
    source = f"file://{tmp_path}/in"
    for k in range(3):
        docs(spark, [(k, f"text {k}", "en", "s"), (9, f"version {k}", "en", "s")]).coalesce(1).write.mode("append").parquet(source)
    real = passages.write_batch

    def failing(batch, number, target, words):
        got = real(batch, number, target, words)
        if number == 1:
            raise RuntimeError("lost")
        return got

    monkeypatch.setattr(passages, "write_batch", failing)
    with pytest.raises(Exception, match="lost"):
        passages.run(spark, source, f"{tmp_path}/out", f"{tmp_path}/mark", 5, files=1)
    monkeypatch.setattr(passages, "write_batch", real)
    assert passages.run(spark, source, f"{tmp_path}/out", f"{tmp_path}/mark", 5, files=1)["batches"] == 2
    passages.run(spark, source, f"{tmp_path}/out2", f"{tmp_path}/mark2", 5, files=1)
    assert texts(passages.current(spark, f"{tmp_path}/out")) == texts(passages.current(spark, f"{tmp_path}/out2"))
    assert len(texts(passages.current(spark, f"{tmp_path}/out"))) == 4


def counting(path, fail_on=None):
    """A model that writes down each call, in whatever process."""

    def complete(prompt):
        with open(path, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        if fail_on and fail_on in prompt:
            raise OSError("gone")
        return prompt.upper()[-20:]

    return models.LanguageModel("counting", complete)


def calls(path):
    return [json.loads(x) for x in Path(path).read_text().splitlines()] if Path(path).exists() else []


def test_asking_goes_on_after_a_failure(spark, tmp_path):
    prompts = spark.createDataFrame([(k, f"prompt {k % 30:03d}") for k in range(60)], "item_id long, prompt string")
    log, path = str(tmp_path / "calls"), str(tmp_path / "asked")
    with pytest.raises(Exception, match="gone"):
        asking.ask(prompts, counting(log, "prompt 017"), path, round_size=5)
    kept = {r.key for r in spark.read.parquet(path).collect()} if (tmp_path / "asked").exists() else set()
    n = len(calls(log))
    assert asking.ask(prompts, counting(log), path, round_size=5) == 30 - len(kept)
    assert len(calls(log)) - n == 30 - len(kept)
    assert asking.ask(prompts, counting(log), path) == 0  # a rerun asks nothing
    got = asking.answered(prompts, counting(log), path).collect()
    assert len(got) == 60 and all(r.answer == r.prompt.upper()[-20:] and r.model == "counting" for r in got)
    more = prompts.union(spark.createDataFrame([(99, "one more")], prompts.schema))
    assert asking.ask(more, counting(log), path) == 1 and calls(log)[-1] == "one more"


def test_answers_of_growing_input(spark, tmp_path):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(12)], "vec_id long, embedding array<float>")
    d = spark.createDataFrame([(k, f"document {k} speaks" if k != 3 else None, "src") for k in range(12)], "doc_id long, text string, source string")
    v.write.parquet(f"{tmp_path}/v")
    d.write.parquet(f"{tmp_path}/d")
    asked = lambda rows: spark.createDataFrame(rows, "item_id long, text string").write.mode("append").parquet(f"{tmp_path}/q")
    asked([(1, " what of document 2 "), (2, "資料"), (3, "  "), (4, None), (77, "no vector")])
    log = str(tmp_path / "calls")
    run = lambda: answers.run(spark, f"{tmp_path}/q", f"{tmp_path}/v", f"{tmp_path}/d", f"{tmp_path}/out", 300, 5, 3, 2, llm=counting(log))
    assert run() == {"questions": 3, "cut": 0, "asked": 3, "answers": 3}
    rows = {r.item_id: r for r in answers.current(spark, f"{tmp_path}/out").collect()}
    assert {k: r.language for k, r in rows.items()} == {1: "en", 2: "zh-hant", 77: "en"}
    assert rows[1].question == "what of document 2" and [c.record_id for c in rows[1].citations] == ["2", "1"] and rows[77].citations == []
    assert run()["asked"] == 0 and len(calls(log)) == 3
    assert {r.item_id: r for r in answers.current(spark, f"{tmp_path}/out").collect()} == rows
    asked([(5, "document 5")])
    assert run() == {"questions": 4, "cut": 0, "asked": 1, "answers": 4}


def test_command_line(tmp_path, spark):
    source = tmp_path / "in"
    docs(spark, [(1, "a b c", "en", "s")]).write.parquet(str(source))
    (tmp_path / "own.json").write_text(json.dumps({"source": str(source), "target": "", "checkpoint": f"{tmp_path}/mark", "words": 2, "files": 10}))
    where = Path(queries.__file__).parent.parent
    call = [sys.executable, "-m", "jobs.passages", "--config", str(tmp_path / "own.json")]
    done = subprocess.run([*call, "--target", f"{tmp_path}/out"], cwd=where, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0 and json.loads(done.stdout.splitlines()[-1]) == {"batches": 1, "documents": 1, "passages": 2, "words": 3, "rejected": 0}
    assert "wrote" in done.stderr
    assert [r.text for r in passages.current(spark, f"{tmp_path}/out").orderBy("passage_no").collect()] == ["a b", "c"]
    wrong = subprocess.run(call, cwd=where, capture_output=True, text=True, timeout=60)
    assert wrong.returncode and "target" in wrong.stderr


def test_a_stream_of_questions_asks_once(spark, tmp_path):
    """Batches that are run again from the start call no model again; answers are the same."""
    from lodestone.config import Settings
    from lodestone.plans.engine import Engine
    from lodestone.streaming import answer_stream

    records = spark.createDataFrame([(f"r{k}", None, "text", "d", f"t{k}", [1], "word " * k, k) for k in range(5)], "record_id string, parent_id string, content_type string, document_id string, title string, pages array<int>, text string, token_count int")
    parents = spark.createDataFrame([], "record_id string, title string, pages array<int>, text string")
    log = str(tmp_path / "calls")
    engine = Engine(spark, Settings({"paths.index": str(tmp_path / "index")}), records, parents, models.length_embedder(), models.lexical_reranker(), counting(log))
    engine.index()
    spark.createDataFrame([(1, "a word"), (2, "two words"), (3, "a word")], "qid long, question string").write.parquet(str(tmp_path / "q"))
    run = lambda mark: answer_stream(spark.readStream.schema("qid long, question string").parquet(str(tmp_path / "q")), engine, str(tmp_path / "out"), str(tmp_path / mark), str(tmp_path / "asked")).awaitTermination(120)
    run("one")
    first = sorted((r.qid, r.answer, r.latency) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(first) == 3 and first[0][1] == first[2][1] and len(calls(log)) == 2
    run("two")
    assert sorted((r.qid, r.answer, r.latency) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == first and len(calls(log)) == 2
