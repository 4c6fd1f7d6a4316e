"""Operators against plain loops, at shapes that a single task or a fixed limit would not bear."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ingest import table

from lodestone import schemas
from lodestone.errors import CorpusError
from lodestone.operators import checks, counters, retrieval, tables, textview
from lodestone.plans import ingest
from lodestone.sources import files
from lodestone.stage import numbered


def plan_of(df):
    return df._jdf.queryExecution().toString()


# trees -----------------------------------------------------------------------------------------------------------------


def below(items, roots):
    up = {(d, r): (d, p) for d, r, p in items}
    out = set(roots)
    for node in up:
        seen, x = [], node
        while x in up and x not in out and x not in seen:
            seen.append(x)
            x = up[x]
        if x in out:
            out |= set(seen)
    return out


def test_subtree_of_random_forests(spark):
    rng = random.Random(3)
    for _ in range(4):
        n = rng.randint(1, 60)
        items = [(d, f"n{k}", rng.choice([None, "gone", f"n{rng.randrange(n)}"])) for d in ("a", "b") for k in range(n)]  # circles too
        roots = [(d, f"n{rng.randrange(n)}") for d in ("a", "b", "b")] + [("a", "picture")]
        df = spark.createDataFrame(items, "document_id string, self_ref string, parent_ref string")
        got = {(r.document_id, r.ref) for r in textview.subtree(df, spark.createDataFrame(roots, "document_id string, ref string"), ["document_id"]).collect()}
        assert got == below(items, roots)


def test_subtree_deep_and_wide(spark):
    """1,000 levels, and more than a million rows under one root."""
    chain = spark.range(1000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("self_ref"), F.when(F.col("id") > 0, F.concat(F.lit("c"), (F.col("id") - 1).cast("string"))).alias("parent_ref"))
    wide = spark.range(2_000_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("self_ref"), F.when(F.col("id") % 2 == 0, "c999").otherwise("other").alias("parent_ref"))
    got = textview.subtree(chain.unionByName(wide), spark.createDataFrame([("c10",)], "ref string"))
    assert got.count() == 990 + 1_000_000


# numbers ---------------------------------------------------------------------------------------------------------------


def test_numbers(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.random(), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, k long").repartition(7)
    got = numbered(df, ["g"], ["v", "k"], "n", 1)
    want = {}
    for g in {r[0] for r in rows}:
        want |= {k: i for i, (_, k) in enumerate(sorted((v, k) for h, v, k in rows if h == g), 1)}
    assert {r.k: r.n for r in got.collect()} == want
    assert got.columns == ["g", "v", "k", "n"] and "SinglePartition" not in plan_of(got)
    assert [r.n for r in numbered(df, [], ["v", "k"], "n").orderBy("v", "k").collect()] == list(range(500))
    assert numbered(df.limit(0), ["g"], ["v"], "n").count() == 0


def test_lines_of_many_files(spark, tmp_path):
    """Files of unlike sizes, blocks of one file, blank lines: numbers are those of the files."""
    rng, want = random.Random(1), []
    (tmp_path / "in").mkdir()
    for k, n in enumerate([3, 400, 1, 0, 90]):
        own = [rng.choice(["", " "]) if rng.random() < 0.1 else f"{k}:{i}:" + "x" * rng.randint(0, 300) for i in range(n)]
        (tmp_path / "in" / f"part-{k:05d}").write_text("".join(f"{x}\n" for x in own))
        want += [(f"part-{k:05d}", i, x) for i, x in enumerate(own, 1)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4096", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = files.lines(spark, str(tmp_path / "in"))
            assert sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in got.collect()) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bad_line_is_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{broken\n')
    with pytest.raises(Exception, match=r"bad JSON line: file:.*a\.jsonl:4: \{broken"):
        files.read_lines(spark, str(tmp_path / "a.jsonl"), "a int", True).collect()
    with pytest.raises(Exception, match=r"bad JSON line: file:.*a\.jsonl: \{broken"):
        files.read_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()


def test_combine_keeps_the_order_of_lines(spark, tmp_path):
    line = lambda rid, kind, parent=None: json.dumps({"schema_version": "1.0.0", "record_id": rid, "parent_id": parent, "content_type": kind, "source": {"document_id": "d", "source_filename": "f", "pages": [1], "locators": {}}, "content": {"text": "t", "markdown": None}, "metadata": {"token_count": 3, "tokenizer_name": "words"}})
    texts = {"part-00000": [f"d:text:{i:06d}" for i in (3, 1, 2)], "part-00001": [f"d:text:{i:06d}" for i in range(400, 200, -1)], "part-00002": ["d:text:000999"]}
    kids = {"part-00000": ["d:table:000:child:001"], "part-00001": ["d:table:000:child:000"]}
    for name, rows, kind, parent in (("texts", texts, "text", None), ("kids", kids, "table_child", "d:table:000:parent:000")):
        (tmp_path / name).mkdir()
        for f, ids in rows.items():
            (tmp_path / name / f).write_text("".join(line(i, kind, parent) + "\n" for i in ids))
    (tmp_path / "parents").write_text(line("d:table:000:parent:000", "table_parent"))
    got = ingest.combine(spark, str(tmp_path / "texts"), str(tmp_path / "kids"), str(tmp_path / "parents"), str(tmp_path / "all"), 512)
    assert got["records"] == 206
    written = [json.loads(x)["record_id"] for p in sorted((tmp_path / "all").glob("part-*")) for x in p.read_text().splitlines()]
    assert written == [i for rows in (texts, kids) for f in sorted(rows) for i in rows[f]]


# two documents ---------------------------------------------------------------------------------------------------------


def a_document(name, words):
    text = lambda n, label, value, page, parent="#/body", heads=(): {"self_ref": f"#/texts/{n}", "label": label, "text": value, "headings": list(heads), "parent": {"$ref": parent}, "prov": [{"page_no": page}]}
    texts = [text(0, "section_header", words[0], 21), text(1, "text", f"{words[1]} one two", 22, heads=[words[0]]), text(2, "caption" if words[0] > "m" else "text", f"costs of {words[1]}", 23), text(3, "text", "hangs", 23, "#/pictures/0" if words[0] > "m" else "#/body"), text(4, "section_header", "Index", 30 if words[0] > "m" else 60), text(5, "text", "late", 40)]
    return {"name": name, "origin": {"filename": f"{name}.pdf"}, "texts": texts, "tables": [table("#/tables/0", [["name", words[1]], [words[1], "5"]], 23, "#/texts/2")], "pictures": [{"self_ref": "#/pictures/0", "captions": [], "footnotes": []}]}


def test_two_documents_give_what_each_gives(spark, tmp_path):
    docs = {"one": a_document("one", ["zeta", "paper"]), "two": a_document("two", ["alpha", "ink"])}
    for name, doc in docs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "doc.json").write_text(json.dumps(doc))
    (tmp_path / "both").mkdir()
    for name, doc in docs.items():
        (tmp_path / "both" / f"{name}.json").write_text(json.dumps(doc))
    reviews = spark.createDataFrame([("two", 0, "layout", "own")], "document_id string, table_index int, reason string, note string").limit(0)
    overrides = spark.createDataFrame([("two", 0, ["All ink"]), (None, 5, ["no such"])], "document_id string, table_index int, caption array<string>")

    def steps(name):
        parsed = ingest.document(spark, str(tmp_path / name))
        kept, _ = ingest.view(parsed, 20)
        decided = ingest.inventory(parsed, reviews, overrides)
        made = (kept, decided.drop("cells", "boxes"), ingest.text_records(kept, 12, 20), ingest.table_records(decided, 12, 20))
        return [sorted(map(str, df.toJSON().collect())) for df in made]

    one, two, both = steps("one"), steps("two"), steps("both")
    assert both == [sorted(a + b) for a, b in zip(one, two)]
    assert all(one) and all(two) and len(one[0]) == 2 and len(two[0]) == 4  # the table's caption goes by its ref


def test_a_review_of_one_document(spark):
    t = spark.createDataFrame([("a", 0), ("b", 0)], "document_id string, table_index int").withColumn("caption", F.array(F.lit("c"))).withColumn("toc_reason", F.lit(None).cast("string"))
    said = spark.createDataFrame([("b", 0, "layout", "n"), (None, 0, "other", "any")], "document_id string, table_index int, reason string, note string")
    captions = spark.createDataFrame([(0, ["new"])], "table_index int, caption array<string>")
    got = {r.document_id: (r.classification, r.note, r.caption) for r in tables.decide(t, said, captions).collect()}
    assert got == {"a": ("other", "any", ["new"]), "b": ("layout", "n", ["new"])}


# checks while writing --------------------------------------------------------------------------------------------------


def test_faulty_rows_fail_or_are_parted(spark, tmp_path):
    rows = [(1, "good", 3, [1], ["#/texts/1"], ["A"]), (2, " ", 600, [1], ["#/texts/1"], ["A"]), (3, "index", 3, [], [], ["Index"]), (None, "x", 1, [1], ["#/tables/1", "#/texts/1"], ["A"])]
    df = spark.createDataFrame(rows, "k long, text string, token_count int, pages array<int>, refs array<string>, headings array<string>")
    with pytest.raises(CorpusError, match="^(2: empty_text|3: no_pages|null: table_refs)$"):
        checks.write_checked(df, str(tmp_path / "all"), checks.text_rules(512), "k")
    assert not list(tmp_path.glob("all/part-*"))
    got = checks.write_checked(df, str(tmp_path / "good"), checks.text_rules(512), "k", str(tmp_path / "bad"))
    assert {k: v for k, v in got.items() if v} == {"records": 1, "quarantined": 3, "empty_text": 1, "over_limit": 1, "no_pages": 1, "no_refs": 1, "table_refs": 1, "navigation": 1}
    assert [r.k for r in spark.read.json(str(tmp_path / "good")).collect()] == [1]
    assert {(r.k, tuple(r.broken)) for r in spark.read.json(str(tmp_path / "bad")).collect()} == {(2, ("empty_text", "over_limit")), (3, ("no_pages", "no_refs", "navigation")), (None, ("table_refs",))}
    assert checks.write_checked(df.where("k = 1"), str(tmp_path / "one"), checks.text_rules(512), "k")["records"] == 1
    assert checks.write_checked(df.limit(0), str(tmp_path / "none"), checks.text_rules(512), "k")["records"] == 0


def test_each_step_checks_what_it_writes(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps(a_document("one", ["zeta", "paper"])))
    docs = ingest.document(spark, str(tmp_path / "doc.json"))
    kept, _ = ingest.view(docs, 20)
    with pytest.raises(CorpusError, match="before"):
        ingest.write_view(kept.withColumn("pages", F.array(F.lit(3), F.lit(25))), str(tmp_path / "v"), 20, None)
    records = ingest.text_records(kept, 12, 20)
    with pytest.raises(CorpusError, match="over_limit"):
        ingest.write_texts(records, str(tmp_path / "t"), 2)
    parted = ingest.write_texts(records, str(tmp_path / "t"), 2, str(tmp_path / "tq"))
    assert (parted["records"], parted["quarantined"], parted["over_limit"]) == (1, 1, 1)
    none = spark.createDataFrame([], "table_index int, reason string, note string")
    decided = ingest.inventory(docs, none, spark.createDataFrame([], "table_index int, caption array<string>"))
    children = ingest.table_records(decided, 12, 20)
    assert ingest.write_children(children, decided, str(tmp_path / "c"), 20)["records"] == children.count() > 0
    with pytest.raises(CorpusError, match="rows are missing"):
        ingest.write_children(children.limit(0), decided, str(tmp_path / "c"), 20)
    changed = children.withColumn("content", F.struct(F.lit("other words").alias("text"), "content.markdown", "content.structured"))
    with pytest.raises(CorpusError, match="pairs"):
        ingest.write_children(changed, decided, str(tmp_path / "c"), 20)


# chunks, counters ------------------------------------------------------------------------------------------------------


def by_fours():
    """A count that doesn't add up: characters by four, rounded up. Made here, so that workers get it by value."""

    def half(text):
        return -(-len(text) // 4)

    return half


half = by_fours()


def plain_chunks(items, target, count):
    out, path, held, refs = [], None, "", []
    for ref, heads, text in items:
        text = text.strip()
        if not text:
            continue
        if heads != path:
            out += [(path, refs, held)] if held else []
            path, held, refs = heads, "", []
        lead = "".join(f"{h}\n" for h in path)
        for p in [text] if count(lead + text) <= target else tables.split_row(text, lead, target, count):
            if held and count(f"{lead}{held}\n{p}") > target:
                out.append((path, refs, held))
                held, refs = "", []
            held = f"{held}\n{p}" if held else p
            refs = refs if ref in refs else [*refs, ref]
    return out + ([(path, refs, held)] if held else [])


@pytest.mark.parametrize("count", [counters.words, half])
def test_chunks_are_a_stream(spark, count):
    rng, items = random.Random(8), {}
    for d in "abc":
        items[d] = [(f"r{k}", [rng.choice(["Part", "Other head"])], " ".join(rng.choice(["w", "word", "longer"]) for _ in range(rng.choice([0, 3, 9, 60])))) for k in range(40)]
    rows = [(d, k, r, h, t, [k + 1]) for d, own in items.items() for k, (r, h, t) in enumerate(own)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "d string, ordinal long, self_ref string, headings array<string>, text string, pages array<int>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = textview.chunk(df, "d", 20, count).orderBy("d", "number").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    for d, own in items.items():
        mine = [r for r in got if r.d == d]
        assert [(r.headings, r.refs, r.text) for r in mine] == plain_chunks(own, 20, count)
        assert [r.number for r in mine] == list(range(1, len(mine) + 1))
        assert all(r.token_count == count("".join(f"{h}\n" for h in r.context) + r.text) <= 20 for r in mine)


def test_headings_that_leave_no_room(spark):
    df = spark.createDataFrame([("d", 0, "r", ["a b c d e f", "g h"], "x y z", [1]), ("d", 1, "s", ["a b c d e f"], "x y z", [1]), ("d", 2, "t", None, None, None)], "d string, ordinal long, self_ref string, headings array<string>, text string, pages array<int>")
    got = textview.chunk(df, "d", 5).orderBy("number").collect()
    assert [(r.headings, r.context, r.text, r.token_count) for r in got] == [(["a b c d e f", "g h"], ["g h"], "x y z", 5), (["a b c d e f"], [], "x y z", 3)]


@pytest.mark.parametrize("count", [half, counters.public("word_bpe_49k.json")])
def test_packs_of_whole_texts(spark, count):
    rng = random.Random(2)
    rows = [(k, i, " ".join(rng.choice(["tokenizer", "a", "Straße", "資料", "12345"]) for _ in range(rng.randint(0, 30))), f"Head {k}\n\n") for k in range(6) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, i long, text string, lead string").repartition(3)
    got = {(r.k, r.i): r.group_no for r in tables.pack_texts(df, "k", ["i"], "text", "lead", 40, count).collect()}
    want = {}
    for k in range(6):
        group, held = 0, None
        for _, i, text, lead in [r for r in rows if r[0] == k]:
            if held is None or count(f"{lead}{held}\n\n{text}") > 40:
                group, held = group + 1, text
            else:
                held = f"{held}\n\n{text}"
            want[k, i] = group
    assert got == want and len(set(want.values())) > 2


def test_the_longest_that_fits():
    for n in range(40):
        for most in range(45):
            asked = []
            assert counters.longest(lambda k: asked.append(k) or k <= most, n) == min(n, most)  # noqa: B023
            assert len(asked) <= 2 * max(1, n).bit_length() + 2


def test_tables_by_subwords(spark, tmp_path):
    """No part of a table is over the limit by the tokenizer that the records name."""
    doc = a_document("one", ["zeta", "paper"])
    rows = [["name", "cost"]] + [[f"incomprehensible item {k} " * (1 + 12 * (k == 3)), str(k)] for k in range(8)]
    doc["tables"] = [table("#/tables/0", rows, 23, "#/texts/2")]
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    docs = ingest.document(spark, str(tmp_path / "doc.json"))
    count = counters.public("word_bpe_49k.json")
    decided = ingest.inventory(docs, spark.createDataFrame([], "table_index int, reason string, note string"), spark.createDataFrame([], "table_index int, caption array<string>"))
    made = ingest.table_records(decided, 60, 60, count)
    ingest.write_children(made, decided, str(tmp_path / "c"), 60)
    got = made.select("content.text", "metadata.token_count", "metadata.tokenizer_name", "metadata.row_fragmented").collect()
    assert len(got) > 3 and any(r.row_fragmented for r in got) and any(r.text.count("Row ") > 1 for r in got)
    assert all(r.token_count == count(r.text) <= 60 and r.tokenizer_name == "word_bpe_49k.json" for r in got)


# nearest ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_nearest_is_a_grid(spark, monkeypatch, block):
    """Many question blocks, repeated vectors, ties, nulls, string ids; against all pairs."""
    monkeypatch.setattr(retrieval, "NUMBERS", 4 * block)
    g = np.random.default_rng(6)
    x = g.integers(0, 3, (300, 4)).astype(float)  # few values: many ties and copies
    q = g.integers(0, 3, (40, 4)).astype(float)
    index = spark.createDataFrame([(f"r{k:03d}", v.tolist()) for k, v in enumerate(x)] + [("none", None)], "record_id string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)] + [(99, None)], "qid long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 29)
    try:
        rows = retrieval.nearest(asked, index, 7).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    got = {}
    for r in sorted(rows, key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append((r.record_id, r.distance))
    want = {}
    for k, v in enumerate(q):
        d = ((x - v) ** 2).sum(axis=1)
        want[k] = [(f"r{j:03d}", d[j]) for j in np.lexsort((np.arange(300), d))[:7]]
    assert got == want
    assert retrieval.nearest(asked.limit(0), index, 7).count() == 0 and retrieval.nearest(asked, index.limit(0), 7).count() == 0


def test_nearest_asks_the_driver_nothing(spark, monkeypatch):
    """No job runs before the result's own; the index is scanned once."""
    df = spark.range(50).select(F.col("id").alias("qid"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    ran = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("nearest", "plan")
    got = retrieval.nearest(df, df.withColumnRenamed("qid", "record_id"), 3)
    assert not ran("nearest")
    assert got.count() == 150
    text = plan_of(got).split("Physical Plan")[1]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and text.count("MapInPandas") == 1


def test_steps_by_a_tokenizer(spark, tmp_path, monkeypatch):
    """The tokenizer of the settings counts in the steps of the command line, and records name it."""
    from lodestone import cli

    count = counters.public("word_bpe_49k.json")
    monkeypatch.setenv("LODESTONE_CHUNKS_TOKENIZER", count.path)
    monkeypatch.setenv("LODESTONE_CHUNKS_TARGET_TOKENS", "30")
    monkeypatch.setenv("LODESTONE_CHUNKS_MAX_TOKENS", "30")
    items = [{"document_id": "d", "source_filename": "d.pdf", "ordinal": k, "self_ref": f"#/texts/{k}", "label": "text", "text": "incomprehensibilities " * (k + 1), "parent_ref": "#/body", "pages": [k + 1], "headings": ["Head"]} for k in range(8)]
    (tmp_path / "view.json").write_text("\n".join(map(json.dumps, items)))
    assert cli.main(["ingest", "texts", "--view", str(tmp_path / "view.json"), "--target", str(tmp_path / "out"), "--report", str(tmp_path / "report")]) == 0
    got = files.read_lines(spark, str(tmp_path / "out"), schemas.ENVELOPE).select("content.text", "metadata.token_count", "metadata.tokenizer_name").collect()
    assert len(got) > 3 and all(r.token_count == count(r.text) <= 30 and r.tokenizer_name == "word_bpe_49k.json" for r in got)
    assert sum(r.text.count("incomprehensibilities") for r in got) == 36
