"""Which rules a text can match, found in one pass over it for all their literals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _automaton(guards: tuple[tuple[str, ...], ...]):  # noqa: ANN202
    """An automaton whose words give the numbers of the rules they guard."""
    import ahocorasick

    owners: dict[str, list[int]] = {}
    for number, words in enumerate(guards):
        for word in words:
            owners.setdefault(word, []).append(number)
    machine = ahocorasick.Automaton()
    for word, numbers in owners.items():
        machine.add_word(word, tuple(numbers))
    if owners:
        machine.make_automaton()
    return machine if owners else None


def guarded(text: str, guards: tuple[tuple[str, ...], ...]) -> list[int]:
    """Numbers of the rules of whose literals one stands in a lower-case text, in order; rules without literals are not named."""
    machine = _automaton(guards)
    if machine is None:
        return []
    # Every occurrence counts, also one inside another: ``sk-`` and ``sk-ant-``.
    return sorted({n for _, numbers in machine.iter(text) for n in numbers})


def keyword_hits(lowered: Column, guards: Sequence[Sequence[str]]) -> Column:
    """array<int> of the rules whose literals a lower-case text holds; null for null."""
    fixed = tuple(tuple(words) for words in guards)

    @F.pandas_udf("array<int>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else guarded(t, fixed) for t in texts], dtype="object")

    return hits(lowered)
