"""Command line: info, doctor, index, search, context, ask, chat, ingest. Exit codes: 0, 1 for a known error, 130 when interrupted."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from lodestone.config import PREFIX, Settings
from lodestone.errors import LodestoneError


#: The steps from parsed documents to the corpus, and what each reads and writes.
STEPS = {
    "inventory": ("document", "parents", "report", "reviews", "overrides", "review-table", "each"), "view": ("document", "target", "report", "start-page", "index-page", "quarantine"), "texts": ("view", "target", "report", "quarantine"),
    "tables": ("document", "target", "report", "reviews", "overrides", "quarantine"), "combine": ("texts", "tables", "parents", "target", "report"), "convert": ("source", "target", "parser"),
}
#: What ends a conversation, in any case.
LEAVE = ("exit", "quit", ":q")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info")
    sub.add_parser("doctor")
    sub.add_parser("index").add_argument("--rebuild", action="store_true")
    sub.add_parser("chat")
    p.add_argument("--log-level", default=None)
    steps = sub.add_parser("ingest").add_subparsers(dest="step", required=True)
    for name, flags in STEPS.items():
        step = steps.add_parser(name)
        for flag in flags:
            step.add_argument(f"--{flag}", required=flag not in ("reviews", "overrides", "index-page", "quarantine", "each"), type=int if flag in ("start-page", "index-page") else str)
    for name in ("search", "context", "ask"):
        c = sub.add_parser(name)
        c.add_argument("question", nargs="*" if name == "ask" else 1)
        c.add_argument("--json", action="store_true")
        if name == "search":
            c.add_argument("-k", type=int)
        if name == "context":
            c.add_argument("--prompt", action="store_true")
        if name == "ask":
            c.add_argument("--language", default=None)
    return p


def show(df, as_json: bool) -> None:
    for row in df.toJSON().collect():  # one question's rows
        print(row if as_json else "\t".join(str(v)[:160] for v in json.loads(row).values()))


def problems(engine) -> list[str]:
    """What is wrong with the index, seen from the corpus and the models that are set."""
    from pyspark.sql import functions as F

    from lodestone.operators.corpus import index_problems

    meta = engine.store.metadata()
    row = [(engine.store.count(), engine.records.count(), meta.get("embedding_model"), meta.get("embedding_fingerprint"), meta.get("embedding_dimension"), engine.embedder.name, engine.embedder.fingerprint)]
    state = engine.spark.createDataFrame(row, "vector_count long, corpus_count long, model string, fingerprint string, dimension int, expected_model string, expected_fingerprint string")
    return index_problems(state).select(F.col("problems")).first()[0]


def doctor(spark, settings: Settings) -> list[str]:
    """All that keeps questions from being answered: the corpus, then the index. Prints what there is."""
    from pyspark.errors import PySparkException

    from lodestone.operators.models import device
    from lodestone.plans.engine import build_engine

    print(f"device\t{device(settings.run.device or None)}")
    try:
        engine = build_engine(spark, settings)
    except (LodestoneError, PySparkException) as e:
        return [f"corpus: {str(e).splitlines()[0]}"]
    print(f"records\t{engine.records.count()}\nmodel\t{engine.llm.name}")
    found = [f"index: {p}" for p in problems(engine)]
    try:
        engine.llm.complete("Answer with one word: ready.")
    except LodestoneError as e:
        found.append(f"model: {e}")
    return found


def step(spark, args) -> dict:
    """Runs a step of ingestion; gives its report, which it has written too."""
    from importlib import import_module

    from pyspark.sql import functions as F

    from lodestone.operators import counters
    from lodestone.plans import ingest
    from lodestone.sources import files
    from lodestone.stage import stash

    chunks = Settings.from_env().chunks
    count = counters.chosen(chunks.tokenizer)
    if args.step == "convert":  # parser: module:function of (path, bytes) -> JSON text
        module, _, name = args.parser.partition(":")
        ingest.convert(spark, args.source, args.target, getattr(import_module(module), name))
        return {}
    if args.step == "combine":
        got = ingest.combine(spark, args.texts, args.tables, args.parents, args.target, chunks.max_tokens)
    elif args.step == "texts":
        from lodestone.operators.checks import require_inputs

        require_inputs(spark, args.view)
        kept = spark.read.schema("document_id string, source_filename string, ordinal long, self_ref string, label string, text string, parent_ref string, pages array<int>, headings array<string>").json(args.view)
        got = ingest.write_texts(ingest.text_records(kept, chunks.target_tokens, chunks.max_tokens, count), args.target, chunks.max_tokens, args.quarantine)
    else:
        docs = ingest.document(spark, args.document)
        if args.step == "view":
            kept, got = ingest.view(docs, args.start_page, args.index_page)
            got |= ingest.write_view(kept, args.target, args.start_page, args.index_page, args.quarantine)
        else:
            reviews = files.read_reviews(spark, args.reviews) if args.reviews else spark.createDataFrame([], "table_index int, reason string, note string")
            overrides = files.read_overrides(spark, args.overrides) if args.overrides else spark.createDataFrame([], "table_index int, caption array<string>")
            decided = stash(ingest.inventory(docs, reviews, overrides), "inventory")
            if args.step == "tables":
                got = ingest.write_children(ingest.table_records(decided, chunks.target_tokens, chunks.max_tokens, count), decided, args.target, chunks.max_tokens, args.quarantine)
            else:
                from lodestone.operators.envelopes import table_parents

                parents = table_parents(decided)
                files.write_lines(parents, args.parents, "overwrite")
                if args.each:
                    files.write_each(parents, args.each, F.col("record_id"), md=F.col("content.markdown"))
                files.write_review(ingest.review(decided), args.review_table)
                got = {f"{r.decision}/{r.review_source}": r["count"] for r in decided.groupBy("decision", "review_source").count().orderBy("decision", "review_source").collect()}
    return files.write_report(got, spark, args.report)


def chat(engine) -> int:
    """Questions until one says to leave; the index is built if there is none. An error ends a question, not the talk."""
    if not engine.store.exists() or not engine.store.count():
        show(engine.index(), True)
    for q in iter(lambda: input("question> ").strip(), None):
        if q.lower() in LEAVE:
            return 0
        if q:
            try:
                show(engine.answer(engine.questions(q)).select("answer", "citations", "latency"), False)
            except LodestoneError as e:
                print(f"error: {e}", file=sys.stderr)
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        settings = Settings.from_env()
        if args.command == "info":
            for k, v in settings.describe().items():
                print(f"{k}\t{v}")
            return 0
        from pyspark.sql import SparkSession

        from lodestone.plans.engine import build_engine

        spark = SparkSession.builder.appName("lodestone").getOrCreate()
        spark.sparkContext.setLogLevel(args.log_level or settings.run.log_level)
        if args.command == "ingest":
            print(json.dumps(step(spark, args), default=str))
            return 0
        if args.command == "doctor":
            found = doctor(spark, settings)
            print("\n".join(found) or "all well")
            return int(bool(found))
        if args.command == "ask" and args.language:
            settings = settings.replace(prompt__answer_language=args.language)
        if args.command == "chat":  # one conversation needs less: these are defaults that a variable overrides
            settings = settings.replace(**{k.replace(".", "__", 1): v for k, v in (("prompt.max_context_chars", 18_000), ("generation.num_ctx", 8192)) if not os.environ.get(PREFIX + k.replace(".", "_").upper())})
        engine = build_engine(spark, settings)
        if args.command == "chat":
            return chat(engine)
        if args.command == "index":
            show(engine.index(args.rebuild), True)
            return 0
        if args.command == "search":
            show(engine.search(engine.questions(*args.question), args.k).orderBy("rerank_rank"), args.json)
        elif args.command == "context":
            show(engine.build_prompt(engine.questions(*args.question)).select("prompt") if args.prompt else engine.context(engine.questions(*args.question)).orderBy("source_no"), args.json)
        else:
            asked = iter(args.question) if args.question else iter(lambda: input("question> ").strip(), "exit")
            for q in asked:
                if q.strip():
                    show(engine.answer(engine.questions(q)).select("question", "answer", "citations", "model", "latency"), args.json)
        return 0
    except (LodestoneError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except (KeyboardInterrupt, EOFError):
        return 130


if __name__ == "__main__":
    sys.exit(main())
