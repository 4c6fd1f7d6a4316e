"""What can go wrong, by kind."""


class LodestoneError(Exception):
    """The base of all errors of this library."""


class ConfigurationError(LodestoneError):
    """A setting is missing or out of range."""


class CorpusError(LodestoneError):
    """Records are missing, malformed or don't belong together."""


class IndexNotBuiltError(LodestoneError):
    """There is no vector index at a place."""

    def __init__(self, place: str) -> None:
        super().__init__(f"no index at {place}: build it first")


class IndexStaleError(LodestoneError):
    """The index was built with another model or other settings."""

    def __init__(self, built: str, now: str) -> None:
        super().__init__(f"the index was built with {built}, questions would be asked with {now}: build it again")


class ModelError(LodestoneError):
    """A language model failed or gave no answer."""
