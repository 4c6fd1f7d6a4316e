"""Ingestion step by step on a small document, its checks, and the command line around it."""

import csv
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from test_engine import envelope

from lodestone import cli, schemas
from lodestone.config import Settings
from lodestone.errors import ConfigurationError, CorpusError, ModelError
from lodestone.operators import checks, envelopes, models
from lodestone.plans import ingest
from lodestone.sources import files


def cell(text, row, col, head=False):
    return {"text": text, "row_span": 1, "col_span": 1, "start_row_offset_idx": row, "end_row_offset_idx": row + 1, "start_col_offset_idx": col, "end_col_offset_idx": col + 1, "column_header": head, "row_header": False, "row_section": False}


def table(ref, rows, page, caption):
    cells = [cell(t, r, c, r == 0) for r, row in enumerate(rows) for c, t in enumerate(row)]
    return {"self_ref": ref, "captions": [{"$ref": caption}], "footnotes": [], "prov": [{"page_no": page, "bbox": {"l": 1.0, "t": 2.0, "r": 3.0, "b": 4.0, "coord_origin": "x"}}], "data": {"num_rows": len(rows), "num_cols": len(rows[0]), "orientation": "rot_0", "grid": [[{"text": t} for t in row] for row in rows], "table_cells": cells}}


@pytest.fixture
def source(tmp_path):
    text = lambda n, label, value, page, parent="#/body", heads=(): {"self_ref": f"#/texts/{n}", "label": label, "text": value, "headings": list(heads), "parent": {"$ref": parent}, "prov": [{"page_no": page}]}
    texts = [
        text(0, "text", "front matter", 1), text(1, "section_header", "Data Quality", 21), text(2, "section_header", "1. Introduction", 21), text(3, "text", "one two three four", 22, heads=["Data Quality", "1. Introduction"]),
        text(4, "text", "five six", 22, heads=["Data Quality", "1. Introduction"]), text(5, "caption", "Costs", 23), text(6, "text", "in a picture", 23, "#/pictures/0"), text(7, "section_header", "Index", 30), text(8, "text", "a, 5", 31),
    ]
    tables = [table("#/tables/0", [["name", "cost"], ["paper", "5"], ["w" * 40 + " " + "v " * 30, "6"]], 23, "#/texts/5"), table("#/tables/1", [["Contents", ""]] + [[f"part {i}", str(i)] for i in range(12)], 3, "#/texts/99"), table("#/tables/2", [["a", "b"], ["c", "d"]], 24, "#/texts/99")]
    doc = {"name": "My Book!", "origin": {"filename": "book.pdf"}, "texts": texts, "tables": tables, "pictures": [{"self_ref": "#/pictures/0", "captions": [], "footnotes": []}]}
    (tmp_path / "doc.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "reviews.csv").write_text("table_index,reason,note\n2,layout,no data\n")
    (tmp_path / "captions.json").write_text(json.dumps({"0": ["All costs"]}))
    return tmp_path


def lines(path):
    return sorted((json.loads(x) for f in path.glob("part-*") for x in f.read_text().splitlines()), key=lambda r: r["record_id"])


def test_steps(source, monkeypatch, capsys, spark):
    p = lambda name: str(source / name)
    monkeypatch.setenv("LODESTONE_CHUNKS_TARGET_TOKENS", "12")
    monkeypatch.setenv("LODESTONE_CHUNKS_MAX_TOKENS", "20")
    own = ["--document", p("doc.json"), "--reviews", p("reviews.csv"), "--overrides", p("captions.json")]
    assert cli.main(["ingest", "inventory", *own, "--parents", p("parents"), "--report", p("r1"), "--review-table", p("review")]) == 0
    assert json.loads(next((source / "r1").glob("part-*")).read_text()) == {"exclude/automatic": 1, "exclude/review": 1, "include/accepted": 1}
    (parent,) = lines(source / "parents")
    assert parent["record_id"] == "my-book:table:000:parent:000" and parent["metadata"]["caption"] == ["All costs"] and parent["content"]["text"].startswith("name\tcost\npaper\t5")
    assert [c["text"] for c in parent["content"]["structured"]["cells"]][:3] == ["name", "cost", "paper"] and parent["source"]["locators"]["bounding_boxes"][0]["l"] == 1.0
    review = next((source / "review").glob("part-*")).read_bytes().decode()
    assert review.startswith("﻿ref,table_index,pages,decision,classification,review_source,note\n") and list(csv.reader(review.splitlines()))[3] == ["#/tables/2", "2", "24", "exclude", "layout", "review", "no data"]
    assert cli.main(["ingest", "view", "--document", p("doc.json"), "--target", p("view"), "--report", p("r2"), "--start-page", "20"]) == 0
    got = json.loads(next((source / "r2").glob("part-*")).read_text())
    assert (got["index_page"], got["items_before"], got["items_after"], got["labels_after"]) == (30, 9, 4, {"section_header": 2, "text": 2})
    assert cli.main(["ingest", "texts", "--view", p("view"), "--target", p("texts"), "--report", p("r3")]) == 0
    texts = lines(source / "texts")
    assert [t["record_id"] for t in texts] == [f"my-book:text:{i:06d}" for i in range(1, len(texts) + 1)] and texts[-1]["metadata"]["chapter"] == "Data Quality"
    assert texts[-1]["content"]["text"] == "Data Quality\n1. Introduction\none two three four\nfive six" and texts[-1]["source"] == {"document_id": "my-book", "source_filename": "book.pdf", "pages": [22], "locators": {"refs": ["#/texts/3", "#/texts/4"]}}
    assert cli.main(["ingest", "tables", *own, "--target", p("tables"), "--report", p("r4")]) == 0
    children = lines(source / "tables")
    assert [c["record_id"][-3:] for c in children] == [f"{i:03d}" for i in range(len(children))] and all(c["metadata"]["token_count"] <= 20 for c in children)
    assert children[0]["content"]["text"] == "Table: All costs\n\nRow 1:\nname: paper\ncost: 5" and not children[0]["metadata"]["row_fragmented"] and all(c["metadata"]["row_fragmented"] for c in children[1:])
    assert "".join(c["content"]["text"] for c in children[1:]).count("v") >= 30 and children[1]["content"]["structured"]["row_fragment"]["fragments"] == len(children) - 1
    both = ["--texts", p("texts"), "--tables", p("tables"), "--parents", p("parents"), "--target", p("all"), "--report", p("r5")]
    assert cli.main(["ingest", "combine", *both]) == 0
    assert [r["record_id"] for r in lines(source / "all")] == sorted(r["record_id"] for r in [*texts, *children])
    assert json.loads(next((source / "r5").glob("part-*")).read_text())["records"] == len(texts) + len(children)
    capsys.readouterr()
    assert cli.main(["ingest", "combine", *both[:5], p("nowhere"), *both[6:]]) == 1 and "there is no" in capsys.readouterr().err
    for k, name in (("RECORDS", "all"), ("PARENTS", "parents"), ("INDEX", "index")):
        monkeypatch.setenv(f"LODESTONE_PATHS_{k}", p(name))
    asked = iter(["what costs paper?", "", "EXIT"])
    monkeypatch.setattr("builtins.input", lambda prompt: next(asked))
    assert cli.main(["chat"]) == 0 and "[Source 1]" in capsys.readouterr().out
    monkeypatch.setenv("LODESTONE_PATHS_RECORDS", p("nowhere"))
    assert cli.main(["doctor"]) == 1 and "corpus:" in capsys.readouterr().out


def test_convert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    ingest.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda path, raw: json.dumps({"name": raw.decode(), "origin": {"filename": "a.bin"}}))
    assert [(r.document_id, r.source_filename) for r in ingest.document(spark, str(tmp_path / "out")).collect()] == [("abc", "a.bin")]
    with pytest.raises(CorpusError, match="there is no"):
        ingest.document(spark, str(tmp_path / "nowhere"))


def corpus_of(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").select(F.from_json("value", schemas.ENVELOPE).alias("r")).select("r.*")


def test_combined_checks(spark):
    text, child = envelope("d:text:000001", "text", "t"), envelope("d:table:000:child:001", "table_child", "c", "d:table:000:parent:000")
    parents = spark.createDataFrame([("d:table:000:parent:000",)], "record_id string")
    got = checks.validate_combined(corpus_of(spark, [text, child]), parents, 512)
    assert (got["records"], got["text_records"], got["table_child_records"], got["schema_errors"]) == (2, 1, 1, 0)
    other = lambda **new: json.loads(json.dumps(text)) | new
    wrong = {
        "no records": [], "there twice": [text, text], "content_type": [other(content_type="table_parent")], "empty_text": [other(content={"text": " \n"})], "over_limit": [other(metadata={"tokenizer_name": "words"})],
        "of 2 tokenizers": [text, other(record_id="d:text:000002", metadata={"token_count": 1, "tokenizer_name": "other"})], "of 1 tokenizers, 1": [other(metadata={"token_count": 1})], "of 2 documents": [text, other(record_id="e:text:000002", source={"document_id": "e", "pages": [1]})],
        "parents are missing": [child | {"parent_id": "d:table:009:parent:000"}], "schema_version": [other(schema_version="2")],
    }
    for message, rows in wrong.items():
        with pytest.raises(CorpusError, match=message):
            checks.validate_combined(corpus_of(spark, rows), parents, 512)
    with pytest.raises(ConfigurationError):
        checks.require_parameters(513, 512)
    checks.require_parameters(512, 512)


def test_children_checks(spark):
    kids = spark.createDataFrame([("a", "x: 1", False, ["x: 1"]), ("b", "cut", True, ["x: 2"])], "record_id string, text string, is_fragment boolean, pairs array<string>")
    rows, numbers = spark.createDataFrame([("t", 1), ("t", 2)], "key string, row_no int"), spark.createDataFrame([("t", 1), ("t", 2)], "key string, fragment_no int")
    checks.validate_children(kids, rows, rows, numbers)
    for bad, message in (((kids.withColumn("is_fragment", F.lit(False)), rows, rows, numbers), "pairs"), ((kids, rows.limit(1), rows, numbers), "rows are missing"), ((kids, rows, rows, numbers.where("fragment_no = 2")), "don't follow")):
        with pytest.raises(CorpusError, match=message):
            checks.validate_children(*bad)


def test_last_record_wins(spark, tmp_path):
    rows = [envelope("d:text:000001", "text", t) for t in ("old", "new")] + [envelope("d:table:000:child:001", "table_child", "c", "d:table:000:parent:000")]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(envelope("d:table:000:parent:000", "table_parent", t)) for t in ("first", "last")))
    records, parents = files.load_corpus(spark, str(tmp_path / "r.jsonl"), str(tmp_path / "p.jsonl"))
    assert {r.text for r in records.collect()} == {"new", "c"} and [p.text for p in parents.collect()] == ["last"]


def test_split_row_by_its_definition():
    from lodestone.operators.tables import split_row

    # a word and the blank after it are one unit; a cut word's last piece is a fragment of its own
    assert split_row("aa bb " + "x" * 9 + " cc dd", "", 6, len) == ["aa bb", "xxxxxx", "xxx", "cc dd"]
    assert split_row("", "", 5, len) == [] and split_row("xxxxxx", "pp", 5, len) == ["xxx", "xxx"]


def test_per_record_files(spark, tmp_path):
    df = spark.createDataFrame([("a:1", "| m |", None)], "record_id string, markdown string, gone string")
    files.write_each(df, str(tmp_path / "each"), F.col("record_id"), md=F.col("markdown"))
    assert next((tmp_path / "each/name=a_1/kind=md").glob("part-*")).read_text() == "| m |\n"
    assert json.loads(next((tmp_path / "each/name=a_1/kind=json").glob("part-*")).read_text()) == {"record_id": "a:1", "markdown": "| m |", "gone": None}


def test_http_model():
    asked = []

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"message": {"content": " " if asked[-1][1]["messages"][0]["content"] == "mute" else "yes"}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = models.http_model(Settings({"generation.host": f"http://127.0.0.1:{server.server_port}", "generation.model": "m"}).generation)
    assert model.complete("why?") == "yes" and asked[0][0] == "/api/chat" and asked[0][1]["options"] == {"temperature": 0.0, "num_ctx": 32768} and asked[0][1]["think"] is False
    with pytest.raises(ModelError, match="no answer"):
        model.complete("mute")
    server.shutdown()
    server.server_close()
    with pytest.raises(ModelError, match="failed"):
        model.complete("why?")


def test_loaded_models(spark):
    e = models.loaded_embedder("mine", 2, lambda: lambda texts: [[len(t), 2] for t in texts], Settings({"embedding.document_prompt": "p:", "embedding.batch_size": 2}).embedding)
    r = models.loaded_reranker("mine", lambda: lambda q, p: [float(len(a) - len(b)) for a, b in zip(q, p)], 2)
    df = spark.createDataFrame([("abc", "x"), ("de", "yyyy"), ("f", "")], "q string, p string").coalesce(1)
    assert [tuple(x) for x in df.select(e.documents(F.col("q")), e.questions(F.col("q")), r.score(F.col("q"), F.col("p"))).collect()] == [([5.0, 2.0], [3.0, 2.0], 2.0), ([4.0, 2.0], [2.0, 2.0], -2.0), ([3.0, 2.0], [1.0, 2.0], 1.0)]
    assert models.device("cuda", ("cuda", "cpu")) == "cuda" and models.device("cuda") == "cpu" and models.device(None, ("mps", "cpu")) == "mps"


def test_envelopes_keep_the_schema(spark):
    chunks = spark.createDataFrame([("d", "f", 1, None, None, None, ["#/texts/1"], [2, 1, 2], "t", 3)], "document_id string, source_filename string, number int, headings array<string>, captions array<string>, chapter string, refs array<string>, pages array<int>, text string, token_count int")
    r = envelopes.texts(chunks, "words", 480, 512)
    assert checks.violations(r, checks.envelope_rules()).where("n > 0").count() == 0 and r.select("source.pages").first()[0] == [1, 2]
