"""The engine: questions in, candidates, context, prompts or answers out, all as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.text import strip
from lodestone.operators import answers, models, retrieval
from lodestone.operators.index import VectorIndex
from lodestone.sources import files
from lodestone.stage import stash


class Engine:
    """search, context, build_prompt and answer over questions (qid, question); index() keeps the index in step."""

    def __init__(self, spark: SparkSession, settings: Settings, records: DataFrame, parents: DataFrame, embedder: models.Embedder, reranker: models.Reranker, llm: models.LanguageModel | None) -> None:
        self.spark, self.settings, self.records, self.parents = spark, settings, records, parents
        self.embedder, self.reranker, self.llm = embedder, reranker, llm
        self.store = VectorIndex(spark, settings.paths.index)
        self._checked = False

    def index(self, rebuild: bool = False) -> DataFrame:
        self._checked = False
        return self.store.sync(self.records, self.embedder, rebuild)

    def questions(self, *texts: str) -> DataFrame:
        if not all(t.strip() for t in texts):
            raise ValueError("a question is blank")
        return self.spark.createDataFrame(list(enumerate(texts, 1)), "qid long, question string")

    def search(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """The reranked candidates: k of them, by default rerank_k, never more than retrieve_k. Blank questions are left out."""
        if not self._checked:
            self.store.guard(self.embedder)
            self._checked = True
        r = self.settings.retrieval
        asked = questions.where(strip("question") != "").select("qid", strip("question").alias("question"))
        rows = self.store.rows()
        found = retrieval.nearest(asked.withColumn("embedding", self.embedder.questions(F.col("question"))), rows, r.retrieve_k)
        full = found.join(rows.drop("embedding", "content_hash"), "record_id").join(asked, "qid").withColumnRenamed("distance", "vector_distance")
        return retrieval.rerank(full, self.reranker.score(F.col("question"), F.col("text")), k if k and k > 0 else r.rerank_k)

    def context(self, questions: DataFrame) -> DataFrame:
        kept = retrieval.first_distinct(self.search(questions), "qid", retrieval.source_key(), self.settings.retrieval.max_sources)
        return retrieval.context(kept, self.records, self.parents)

    def build_prompt(self, questions: DataFrame) -> DataFrame:
        """qid, question, sources, prompt, citations, truncated, prompt_chars; questions without sources too."""
        p = self.settings.prompt
        sources = retrieval.budgeted(self.context(questions), "qid", p.max_context_chars)
        asked = questions.where(strip("question") != "").select("qid", strip("question").alias("question"))
        both = asked.join(sources, "qid", "left").withColumn("sources", F.coalesce("sources", F.array().cast(f"array<{retrieval.CITED}>")))
        return retrieval.prompts(both, "question", p.answer_language)

    def answer(self, questions: DataFrame, asked: str | None = None) -> DataFrame:
        """Adds answer, model and latency. Write the result once; reading it twice would ask the model twice. With a path `asked` answers are kept
        there by prompt: the model is called now, for what it was never asked, and the result can be read as often as wanted."""
        if self.llm is None:
            raise ValueError("the engine was built without a language model")
        if asked is None:
            return models.generate(self.build_prompt(questions), self.llm)
        prompts = stash(self.build_prompt(questions), "prompts")
        answers.ask(prompts, self.llm, asked)
        return answers.answered(prompts, self.llm, asked)


def build_engine(spark: SparkSession, settings: Settings | None = None, *, embedder: models.Embedder | None = None, reranker: models.Reranker | None = None, llm: models.LanguageModel | None = None, with_llm: bool = True) -> Engine:
    settings = settings or Settings.from_env()
    records, parents = files.load_corpus(spark, settings.paths.records, settings.paths.parents)
    return Engine(spark, settings, records, parents, embedder or models.length_embedder(settings.embedding), reranker or models.lexical_reranker(), (llm or (models.http_model(settings.generation) if settings.generation.host else models.extractive_model())) if with_llm else None)
