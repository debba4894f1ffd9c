"""The predicate registry: a fold over the names in order, in which the first spelling of a measure becomes its canonical one."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import MEASURE_MODIFIERS, RESTATEMENTS

THRESHOLD = 0.86

#: New names that one fold takes; the order of the fold is global, so it runs on the driver over distinct names only.
MAX_NAMES = 200_000


def hashed_words(name: str, width: int = 256) -> np.ndarray:
    """A deterministic encoder: words and their letter trigrams hashed into a unit vector."""
    v = np.zeros(width)
    for word in name.split("_"):
        v[zlib.crc32(word.encode()) % width] += 1.0
        for i in range(len(word) - 2):
            v[zlib.crc32(word[i : i + 3].encode()) % width] += 0.5
    n = np.linalg.norm(v)
    return v / n if n else v


def contrasting(left: str, right: str) -> bool:
    """Whether two names are one head under modifiers that make different measures of it."""

    def split(name: str) -> tuple[str, str | None]:
        head, _, rest = name.partition("_")
        return (rest, head) if head in MEASURE_MODIFIERS and rest else (name, None)

    (lh, lm), (rh, rm) = split(left), split(right)
    return lh == rh and lm != rm and (bool(lm and rm) or (lm or rm) not in RESTATEMENTS)


class Registry:
    """Entries by canonical name, with aliases, counts and vectors."""

    def __init__(self, entries: list[tuple[str, list[str]]] = (), encode: Callable[[str], np.ndarray] = hashed_words, confirm: Callable[[str, str], bool] | None = None, threshold: float = THRESHOLD):
        self.encode, self.confirm, self.threshold = encode, confirm, threshold
        self.names: list[str] = []
        self._vectors = np.empty((64, len(encode("x"))))  # room for more, doubled when it is full
        self.of: dict[str, str] = {}
        self.counts: dict[str, int] = {}
        for canonical, aliases in entries:
            self._add(canonical)
            self.of.update(dict.fromkeys(aliases, canonical))

    @property
    def vectors(self) -> np.ndarray:
        return self._vectors[: len(self.names)]

    def _add(self, name: str) -> None:
        if len(self.names) == len(self._vectors):
            self._vectors = np.concatenate([self._vectors, np.empty_like(self._vectors)])
        self._vectors[len(self.names)] = self.encode(name)
        self.names.append(name)
        self.of[name] = name
        self.counts[name] = self.counts.get(name, 0) + 1

    def observe(self, name: str) -> tuple[str, str, str | None, float | None]:
        """(event_type, subject, target, similarity); without a confirming callable, near names stay separate."""
        if not name:
            return "seen", name, None, None
        if (known := self.of.get(name)) is not None:
            self.counts[known] = self.counts.get(known, 0) + 1
            return "seen", name, known, None
        if not self.names:
            self._add(name)
            return "registered", name, None, None
        similar = self.vectors @ self.encode(name)
        best = int(np.argmax(similar))
        target, score = self.names[best], float(similar[best])
        if score < self.threshold:
            self._add(name)
            return "registered", name, None, score
        if not contrasting(name, target) and self.confirm is not None and self.confirm(name, target):
            self.of[name] = target
            self.counts[target] = self.counts.get(target, 0) + 1
            return "confirmed", name, target, score
        self._add(name)
        return "rejected", name, target, score


def fold(facts: DataFrame, registry: Registry) -> list[tuple[str, str, str | None, float | None]]:
    """Events of the facts' distinct new measures, in their order; raises above MAX_NAMES instead of dropping names."""
    fresh = facts.where(F.col("measure").isNotNull()).select("measure").distinct()
    names = [r["measure"] for r in fresh.limit(MAX_NAMES + 1).collect()]
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} distinct names")
    return [registry.observe(n) for n in sorted(names)]


def aliases(registry: DataFrame) -> DataFrame:
    """(alias, canonical) of a registry table: every entry's aliases and the entry itself."""
    listed = registry.select("canonical", F.explode(F.array_union(F.from_json(F.coalesce("aliases_json", F.lit("[]")), "array<string>"), F.array("canonical"))).alias("alias"))
    return listed.where("alias is not null").groupBy("alias").agg(F.min("canonical").alias("canonical"))
