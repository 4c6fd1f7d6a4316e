"""Token counts of whole texts, for packing, splitting and budgets. They need not add up over parts of a text."""

from __future__ import annotations

import os
from collections.abc import Callable

Counter = Callable[[str], int]


def words(text: str) -> int:
    """Runs without white space: the offline stand-in for a tokenizer."""
    return len(text.split())


class Subwords:
    """Ids that a tokenizer file of the tokenizers library gives; the file is read once in each Python worker. name: what records say."""

    _loaded: dict[str, object] = {}

    def __init__(self, path: str, name: str) -> None:
        self.path, self.name = path, name

    def __call__(self, text: str) -> int:
        if self.path not in Subwords._loaded:
            from tokenizers import Tokenizer

            Subwords._loaded[self.path] = Tokenizer.from_file(self.path)
        return len(Subwords._loaded[self.path].encode(text, add_special_tokens=False).ids)


def chosen(setting: str) -> Counter:
    """words() for an empty setting, else the tokenizer file at this path, which every worker must have; records name its last part."""
    return Subwords(setting, os.path.basename(setting)) if setting else words


def public(name: str) -> Subwords:
    """A public tokenizer's file: in the folder LODESTONE_TOKENIZERS if set, else of the installed package."""
    if (folder := os.environ.get("LODESTONE_TOKENIZERS")) and os.path.exists(f"{folder}/{name}"):
        return Subwords(f"{folder}/{name}", name)
    import public_tokenizers

    return Subwords(public_tokenizers.path(name), name)


def name_of(count: Counter) -> str:
    return getattr(count, "name", "words")


def longest(fits: Callable[[int], bool], n: int) -> int:
    """The most of n parts that fit, by steps that double and then halve: counts of a few long texts, not of all prefixes. Where counts are not
    monotone the answer still fits, but for 0."""
    step, low = 1, 0
    while low + step <= n and fits(low + step):
        low, step = low + step, 2 * step
    while step:
        if low + step <= n and fits(low + step):
            low += step
        step //= 2
    return low
