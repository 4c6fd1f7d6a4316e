"""Settings: one table of what can be set, its kind, default and check; values come from environment variables."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from types import SimpleNamespace
from typing import Any, NamedTuple

from .errors import ConfigurationError

PREFIX = "LODESTONE_"
#: Default places lie beside the package, wherever a job is started.
HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def text(value: str) -> str:
    return value


def switch(value: str) -> bool:
    return value.strip().lower() in ("1", "true", "yes", "on")


def place(value: str) -> str:
    """A given path: of any store that Spark reads, else from the working directory."""
    return value if "://" in value else os.path.abspath(value)


def limit(value: str) -> int | None:
    """No limit if not positive."""
    return n if (n := int(value)) > 0 else None


class Setting(NamedTuple):
    key: str
    kind: Callable[[str], Any]
    default: Any
    check: Callable[[Any], bool] = lambda value: True

    def read(self, value: str) -> Any:
        try:
            return self.kind(value)
        except ValueError:
            raise ConfigurationError(f"{self.key} is no {self.kind.__name__}: {value!r}") from None


# The funnel's sizes, the context's characters, batch sizes and lengths are those that results depend on.
TABLE = (
    Setting("paths.records", place, f"{HOME}/data/records"),
    Setting("paths.parents", place, f"{HOME}/data/parents"),
    Setting("paths.index", place, f"{HOME}/data/index"),
    Setting("retrieval.retrieve_k", int, 20, lambda n: n > 0),
    Setting("retrieval.rerank_k", int, 8, lambda n: n > 0),
    Setting("retrieval.max_sources", int, 4, lambda n: n > 0),
    Setting("prompt.max_context_chars", int, 60_000),
    Setting("prompt.answer_language", text, "auto"),
    Setting("embedding.model", text, "length-2d"),
    Setting("embedding.normalize", switch, True),
    Setting("embedding.max_length", limit, 1024),
    Setting("embedding.batch_size", int, 8, lambda n: n > 0),
    Setting("embedding.query_prompt", text, ""),
    Setting("embedding.document_prompt", text, ""),
    Setting("rerank.model", text, "lexical"),
    Setting("rerank.batch_size", int, 8, lambda n: n > 0),
    Setting("rerank.max_length", int, 1024, lambda n: n > 0),
    Setting("generation.model", text, "extractive"),
    Setting("generation.host", text, ""),
    Setting("generation.temperature", float, 0.0),
    Setting("generation.num_ctx", int, 32_768, lambda n: n > 0),
    Setting("generation.think", switch, False),
    Setting("chunks.target_tokens", int, 480, lambda n: n > 0),
    Setting("chunks.max_tokens", int, 512, lambda n: n > 0),
    Setting("chunks.tokenizer", text, ""),
    Setting("run.device", text, ""),
    Setting("run.log_level", text, "WARN"),
)
#: What must hold between values.
RELATIONS = (("retrieval.rerank_k", "retrieval.retrieve_k"), ("chunks.target_tokens", "chunks.max_tokens"))


class Settings:
    """Checked values by section and name (`settings.retrieval.rerank_k`); without arguments the defaults. They don't change."""

    def __init__(self, values: Mapping[str, Any] | None = None) -> None:
        known = {s.key: s for s in TABLE}
        if wrong := set(values or ()) - set(known):
            raise ConfigurationError(f"no such setting: {sorted(wrong)}")
        own = {k: s.default for k, s in known.items()} | dict(values or {})
        for key, s in known.items():
            if not s.check(own[key]):
                raise ConfigurationError(f"{key} is out of range: {own[key]!r}")
        for less, more in RELATIONS:
            if own[less] > own[more]:
                raise ConfigurationError(f"{less} is over {more}")
        self._values = own

    def __getattr__(self, section: str) -> SimpleNamespace:
        own = {k.partition(".")[2]: v for k, v in self.__dict__.get("_values", {}).items() if k.startswith(f"{section}.")}
        if not own:
            raise AttributeError(section)
        return SimpleNamespace(**own)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """A setting's variable is PREFIX, section and name; an empty one counts as unset."""
        env = os.environ if env is None else env
        return cls({s.key: s.read(env[name]) for s in TABLE if env.get(name := PREFIX + s.key.replace(".", "_").upper())})

    def replace(self, **values: Any) -> Settings:
        """Other values for some: section__name=value."""
        return Settings(self._values | {k.replace("__", ".", 1): v for k, v in values.items()})

    def describe(self) -> dict[str, Any]:
        return dict(self._values)
