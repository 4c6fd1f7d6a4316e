"""Pluggable models: embedders, rerankers, language models. Defaults need nothing but Spark."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.errors import ModelError
from lodestone.functions.text import overlap


def fingerprint(settings) -> str:
    """What a document's vector depends on; the question's prompt is no part of it."""
    own = {"model": settings.model, "normalize": settings.normalize, "max_length": settings.max_length, "document_prompt": settings.document_prompt}
    return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def decorated(text: Column, prompt: str) -> Column:
    return F.concat(F.lit(prompt), text) if prompt else text


@dataclass(frozen=True)
class Embedder:
    """name, fingerprint and dimension, and columns of the vectors of documents and questions."""

    name: str
    fingerprint: str
    dimension: int
    documents: Callable[[Column], Column]
    questions: Callable[[Column], Column]


def length_embedder(settings=None) -> Embedder:
    """[characters, 1]: the deterministic offline embedder."""
    settings = settings or Settings().embedding
    vector = lambda prompt: lambda t: F.array(F.length(decorated(t, prompt)).cast("float"), F.lit(1.0).cast("float"))
    return Embedder("length-2d", fingerprint(settings), 2, vector(settings.document_prompt), vector(settings.query_prompt))


def loaded_embedder(name: str, dimension: int, load: Callable[[], Callable[[list[str]], list]], settings=None) -> Embedder:
    """A model that load() gives once per Python worker, applied to Arrow batches: encode(texts) -> vectors."""
    settings = settings or Settings({"embedding.model": name}).embedding

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            got: list = []
            for at in range(0, len(texts), settings.batch_size):
                got += [list(map(float, v)) for v in encode(texts.iloc[at : at + settings.batch_size].tolist())]
            yield pd.Series(got)

    return Embedder(name, fingerprint(settings), dimension, lambda t: embed(decorated(t, settings.document_prompt)), lambda t: embed(decorated(t, settings.query_prompt)))


@dataclass(frozen=True)
class Reranker:
    """A column of how well a passage answers a question; comparable within one question."""

    name: str
    score: Callable[[Column, Column], Column]


def lexical_reranker() -> Reranker:
    return Reranker("lexical", overlap)


def loaded_reranker(name: str, load: Callable[[], Callable[[list[str], list[str]], list[float]]], batch_size: int = 8) -> Reranker:
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rate = load()
        for q, p in batches:
            got: list[float] = []
            for at in range(0, len(q), batch_size):
                got += list(rate(q.iloc[at : at + batch_size].tolist(), p.iloc[at : at + batch_size].tolist()))
            yield pd.Series(got, dtype="float64")

    return Reranker(name, score)


@dataclass(frozen=True)
class LanguageModel:
    """complete(prompt) -> text, called once for each prompt."""

    name: str
    complete: Callable[[str], str]


def first_source(prompt: str) -> str:
    """The offline model: the first line of the first source, with its number."""
    head, _, rest = prompt.partition("[Source 1]")
    line = next((x.strip() for x in rest.split("\n")[1:] if x.strip()), "")
    return f"{line} [Source 1]" if line else "No source says."


def extractive_model() -> LanguageModel:
    return LanguageModel("extractive", first_source)


def http_model(settings, timeout: float = 600.0) -> LanguageModel:
    """A chat model behind HTTP: posts JSON to `host`/api/chat, once for each prompt and without trying again. A failed call or an
    empty answer is a ModelError, which generate() raises."""
    import urllib.request

    host, options = (settings.host or "http://127.0.0.1:11434").rstrip("/"), {"temperature": settings.temperature, "num_ctx": settings.num_ctx}
    fixed = {"model": settings.model, "stream": False, "think": settings.think, "options": options}

    def complete(prompt: str) -> str:
        body = json.dumps(fixed | {"messages": [{"role": "user", "content": prompt}]}).encode()
        request = urllib.request.Request(f"{host}/api/chat", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as got:
                said = json.load(got)["message"]["content"]
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise ModelError(f"{settings.model} at {host} failed: {e}") from e
        if not said.strip():
            raise ModelError(f"{settings.model} gave no answer")
        return said

    return LanguageModel(settings.model, complete)


def generate(prompts: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds answer, model and latency (seconds, 3 digits). Each prompt's call is made once where Spark runs its task
    once: write the result before using it twice, and leave speculation off."""

    def run(frames):
        import time

        for pdf in frames:
            answers, took = [], []
            for p in pdf["prompt"]:
                began = time.monotonic()
                try:
                    said = model.complete(p)
                except ModelError:
                    raise
                except Exception as e:
                    raise ModelError(f"{model.name}: {e}") from e
                if not (said or "").strip():
                    raise ModelError(f"{model.name} gave no answer")
                answers.append(said.strip())
                took.append(round(time.monotonic() - began, 3))
            yield pdf.assign(answer=answers, model=model.name, latency=took)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{fields}, answer string, model string, latency double")


def device(preference: str | None = None, available: tuple[str, ...] = ("cpu",)) -> str:
    """The preferred device if there is one, else the first of mps, cuda, cpu that there is."""
    return preference if preference in available else next(d for d in ("mps", "cuda", "cpu") if d in available or d == "cpu")
