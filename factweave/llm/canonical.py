"""Mapping freely worded names to a reference list: tries of the entries searched by a Levenshtein automaton.

Entries and their aliases are bags of words. Their words form one trie, with short forms of each word (its consonants, its
beginnings) and the words that aliases put in its place as alias paths that end at the same word. A query word is read against the trie by a
Levenshtein automaton, kept as the rows of the edit matrix along the trie's edges, which returns every word within a distance that depends on
the query word's length; where that leads to no entry, a second automaton reads it as letters of a longer word in their order. The words read are assigned
to the words of each entry that has as many, so that word order doesn't matter, and the entry reached at the least cost is the answer; two entries at one cost are no answer.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

UNMATCHED = "unmatched"

#: Reference entries, and names, that one task holds; longer lists are searched block by block, with the same answers.
ENTRIES_PER_BLOCK, NAMES_PER_TASK = 20_000, 50_000

#: What the later ways cost more: letters of a word in their order, and words run together or cut in two.
SHORTENED, APART = 10.0, 20.0

# Words around a measure that don't change which measure it is.
FILLERS = frozenset({"the", "a", "an", "of", "in", "for", "from", "year", "amount", "value", "figure", "reported"})
# Fillers that an entry may be written without, and initials used as a word.
CONNECTIVES = frozenset({"the", "a", "an", "of", "in", "for", "from"})
INITIALS = {"tat": "turnaround"}

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z0-9]+")
_VOWELS = re.compile(r"(?<=.)[aeiou]")


def words_of(name: str) -> list[str]:
    """Lower-case words: cut at separators and, where a name has small and capital letters, at capitals inside it."""
    plain = unicodedata.normalize("NFKC", name)
    return _WORD.findall(_CAMEL.sub(" ", plain).lower())


def allowed_distance(word: str) -> int:
    """Edits allowed for a query word; a swap of two neighbours is one edit."""
    n = len(word)
    return 0 if n <= 3 else 1 if n <= 7 else 2


class WordTrie:
    """Words by letters; alias paths lead to the same words at a cost of their own. Every node knows the letters below it."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.below: dict[int, set[str]] = {}

    def add(self, path: str, word: str, cost: float = 0.0) -> None:
        node = self.root
        for i, c in enumerate(path):
            self.below.setdefault(id(node), set()).update(path[i:])
            node = node.setdefault(c, {})
        ends = node.setdefault("", {})
        ends[word] = min(cost, ends.get(word, cost))

    def within(self, query: str, most: int) -> dict[str, float]:
        """Every word within `most` edits, with its least cost; alias paths must match exactly."""
        found: dict[str, float] = {}

        def end(node: dict, edits: int) -> None:
            for word, cost in node.get("", {}).items():
                if not (cost and edits):
                    total = cost + edits
                    if total < found.get(word, 99):
                        found[word] = total

        def walk(node: dict, row: list[int], before: list[int] | None, last: str) -> None:
            for c, child in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for i, q in enumerate(query, 1):
                    x = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (q != c))
                    if before is not None and i > 1 and q == last and query[i - 2] == c:
                        x = min(x, before[i - 2] + 1)
                    new.append(x)
                if min(new) <= most:
                    if new[-1] <= most:
                        end(child, new[-1])
                    walk(child, new, row, c)

        walk(self.root, list(range(len(query) + 1)), None, "")
        return found


    def shortened(self, query: str) -> list[str]:
        """Every word that begins with the query's first letter and has its other letters in their order, as typed abbreviations have."""
        found: list[str] = []
        if len(query) < 2 or query[0] not in self.root:
            return found

        def walk(node: dict, i: int) -> None:
            if i == len(query):
                found.extend(w for w, cost in node.get("", {}).items() if not cost and len(query) <= 0.75 * len(w))
            elif query[i] not in self.below.get(id(node), ()):
                return
            for c, child in node.items():
                if c:
                    walk(child, i + (i < len(query) and c == query[i]))

        walk(self.root[query[0]], 1)
        return found


def swapped_words(entries: list[tuple[str, list[str]]]) -> set[tuple[str, str]]:
    """(word of an alias, word of the entry) where an alias differs from its entry in one word."""
    out = set()
    for canonical, aliases in entries:
        own = words_of(canonical)
        for alias in map(words_of, aliases):
            if len(alias) == len(own) and len(odd := [(x, y) for x, y in zip(alias, own) if x != y]) == 1:
                out.add(odd[0])
    return out


class Matcher:
    """One block of reference entries: [(canonical, aliases)].

    Of all entries, those of other blocks included: `optional`, the fillers that are words of an entry, and `swaps`, the swapped words whose
    second one is a word of this block.
    """

    def __init__(self, entries: list[tuple[str, list[str]]], optional: frozenset[str] | None = None, swaps: set[tuple[str, str]] | None = None, fillers: frozenset[str] = FILLERS):
        self.trie, self.bags, self.fillers = WordTrie(), {}, fillers
        for canonical, aliases in entries:
            for name in (canonical, *aliases):
                words = words_of(name)
                for bag in {tuple(sorted(words)), tuple(sorted(w for w in words if w not in CONNECTIVES))}:
                    if bag:
                        self.bags.setdefault(bag, set()).add(canonical)
        own = {w for bag in self.bags for w in bag}
        self.swaps: dict[str, set[str]] = defaultdict(set)
        for x, y in swapped_words(entries) if swaps is None else swaps:
            if y in own:
                self.swaps[x].add(y)
        for word in own | set(self.swaps):
            self.trie.add(word, word)
            if len(word) >= 5:
                if len(bare := _VOWELS.sub("", word)) >= 3:
                    self.trie.add(bare, word, 1.0)
                for n in range(3, len(word) - 1):
                    self.trie.add(word[:n], word, 1.2)
        for short, word in INITIALS.items():
            if word in own:
                self.trie.add(short, word, 1.0)
        self.optional = frozenset(fillers & own) if optional is None else optional
        # by number of words: word -> bags that have it
        self.having: dict[int, dict[str, set[tuple]]] = {}
        for bag in self.bags:
            for w in bag:
                self.having.setdefault(len(bag), {}).setdefault(w, set()).add(bag)
        self.cache: dict[str, list[tuple[float, str]]] = {}
        self._read: dict[tuple[str, bool], list[tuple[float, str]]] = {}

    def readings(self, word: str, short: bool = False) -> list[tuple[float, str]]:
        """Words that a query word may stand for, cheapest first; words that aliases put in place of others stand for these too."""
        if (known := self._read.get((word, short))) is None:
            found = self.trie.within(word, allowed_distance(word))
            for w in self.trie.shortened(word) if short else ():
                found[w] = min(1.5, found.get(w, 99))
            for w, cost in list(found.items()):
                for other in self.swaps.get(w, ()):
                    found[other] = min(found.get(other, 99), cost + 0.05)
            known = sorted((c, w) for w, c in found.items())
            if len(self._read) > 200_000:
                self._read.clear()
            self._read[word, short] = known
        return known

    def _reach(self, options: list[list[tuple[float, str]]]) -> dict[str, float]:
        """Every canonical entry that one reading of each word makes up, with its least cost: the best assignment to each entry's words."""
        having = self.having.get(len(options))
        if having is None or not all(options):
            return {}
        bags: set[tuple] | None = None
        for choices in sorted(options, key=len):
            some = set().union(*(having.get(w, ()) for _, w in choices))
            bags = some if bags is None else bags & some
            if not bags:
                return {}
        out: dict[str, float] = {}
        for bag in bags or ():
            places: dict[str, list[int]] = defaultdict(list)
            for i, w in enumerate(bag):
                places[w].append(i)
            states = {0: 0.0}
            for choices in options:
                after: dict[int, float] = {}
                for taken, cost in states.items():
                    for c, w in choices:
                        free = next((i for i in places.get(w, ()) if not taken >> i & 1), None)
                        if free is not None and cost + c < after.get(taken | 1 << free, 99):
                            after[taken | 1 << free] = cost + c
                states = after
            for cost in states.values():
                for canonical in self.bags[bag]:
                    out[canonical] = min(cost, out.get(canonical, 99))
        return out

    def candidates(self, name: str | None) -> list[tuple[float, str]]:
        """The two cheapest entries of this block, (cost, canonical), by the first way that leads to any."""
        if name is None:
            return []
        if (known := self.cache.get(name)) is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[name] = known = sorted((c, w) for w, c in self._candidates(words_of(name)).items())[:2]
        return known

    def match(self, name: str | None) -> str:
        return decided(self.candidates(name))

    def _candidates(self, words: list[str]) -> dict[str, float]:
        kept = [w for w in words if w not in self.fillers or w in self.optional]
        longest = max(self.having, default=0)
        # fillers that are also words of entries may be either
        loose = [i for i, w in enumerate(kept) if w in self.optional]
        if not kept or len(kept) - max(1, len(loose)) > longest:
            return {}
        bags = [kept] + [kept[:i] + kept[i + 1 :] for i in loose] + ([[w for w in kept if w not in self.optional]] if len(loose) > 1 else [])
        for short in (False, True):
            best: dict[str, float] = {}
            for bag in bags:
                if len(bag) in self.having:
                    for canonical, cost in self._reach([self.readings(w, short) for w in bag]).items():
                        best[canonical] = min(cost + SHORTENED * short, best.get(canonical, 99))
            if best:
                return best
        return self._apart(kept) if len(kept) - 1 <= longest else {}

    def _apart(self, words: list[str]) -> dict[str, float]:
        """Words run together, or cut in two, are tried where nothing else matches."""
        best: dict[str, float] = {}
        for i, w in enumerate(words):
            tries = [words[:i] + [w[:k], w[k:]] + words[i + 1 :] for k in range(3, len(w) - 2)] if len(words) + 1 in self.having else []
            if i + 1 < len(words):
                tries.append(words[:i] + [w + words[i + 1]] + words[i + 2 :])
            for bag in tries:
                for canonical, cost in self._reach([[x for x in self.readings(y) if x[0] <= 1.1] for y in bag]).items():
                    best[canonical] = min(cost + APART, best.get(canonical, 99))
        return best


def decided(candidates: list[tuple[float, str]]) -> str:
    """The cheapest entry; none where another one costs the same. Candidates are sorted, the two cheapest at least."""
    if not candidates or (len(candidates) > 1 and candidates[1][0] - candidates[0][0] < 0.01):
        return UNMATCHED
    return candidates[0][1]


def match_names(names: DataFrame, reference: DataFrame, *, id_col: str, name_col: str, block: int = ENTRIES_PER_BLOCK, fillers: frozenset[str] = FILLERS) -> DataFrame:
    """(id_col, canonical): the reference entry of every name, or 'unmatched'.

    `reference` has `canonical` and `aliases_json`, a JSON array or null. Null and blank names, and all names where the reference is
    empty, are unmatched. Repeated rows stay repeated; other columns are dropped. `fillers` are words that don't change which measure a name is. A task
    holds at most `block` entries: a shorter reference is sent along and names are matched where they are read, a longer one is searched in
    blocks by each different name, and the candidates of all blocks are decided on together, so that answers don't depend on `block`.
    """
    ship(names.sparkSession)
    kind = names.schema[id_col].dataType.simpleString()
    listed = reference.where("canonical is not null").select("canonical", F.coalesce("aliases_json", F.lit("[]")).alias("aliases_json"))
    n = listed.count()
    source = names.select(id_col, name_col)
    if n <= block:
        return source.mapInArrow(_matching(id_col, _entries(listed.orderBy("canonical").toArrow()), fillers), f"`{id_col}` {kind}, canonical string")
    blocks = -(-n // block)
    placed = cut(listed.withColumn("block", F.pmod(F.xxhash64("canonical"), F.lit(blocks))))
    words = placed.mapInArrow(_words, "block long, word string").distinct()
    swaps = placed.mapInArrow(_swaps, "x string, word string").distinct().join(words, "word").select("block", "x", F.col("word").alias("y"))
    optional = frozenset(r.word for r in words.where(F.col("word").isin(*fillers)).select("word").distinct().collect()) if fillers else frozenset()
    asked = cut(source.select(F.col(name_col).alias("name")).where("name is not null").distinct())
    salts = max(1, -(-asked.count() // NAMES_PER_TASK))
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = asked.select("name", F.pmod(F.xxhash64("name"), F.lit(salts)).alias("salt"), each(blocks).alias("block"))
    right = placed.select("block", "canonical", "aliases_json", F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y")).unionByName(swaps, allowMissingColumns=True).withColumn("salt", each(salts))
    found = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(_block_matching(optional, fillers), "name string, cost double, canonical string")
    # two rows of each block at most
    best = found.groupBy("name").agg(F.slice(F.array_sort(F.collect_list(F.struct("cost", "canonical"))), 1, 2).alias("c"))
    tie = (F.size("c") > 1) & (F.get("c", F.lit(1))["cost"] - F.get("c", F.lit(0))["cost"] < 0.01)
    answers = best.select(F.col("name").alias("_name"), F.when(tie, F.lit(UNMATCHED)).otherwise(F.get("c", F.lit(0))["canonical"]).alias("canonical"))
    return source.join(answers, F.col(name_col) == F.col("_name"), "left").select(id_col, F.coalesce("canonical", F.lit(UNMATCHED)).alias("canonical"))


def _entries(rows: pa.Table | pa.RecordBatch) -> list[tuple[str, list[str]]]:
    out = []
    for canonical, text in zip(rows.column("canonical").to_pylist(), rows.column("aliases_json").to_pylist()):
        try:
            aliases = json.loads(text)
        except ValueError:
            aliases = []
        out.append((canonical, [a for a in aliases if isinstance(a, str)] if isinstance(aliases, list) else []))
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(b, w) for b, (c, aliases) in zip(batch.column("block").to_pylist(), _entries(batch)) for w in {w for x in (c, *aliases) for w in words_of(x)}]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())], ["block", "word"])


def _swaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = sorted(swapped_words(_entries(batch)))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.string())], ["x", "word"])


def _matching(id_col: str, entries: list[tuple[str, list[str]]], fillers: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries, fillers=fillers)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([matcher.match(x) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "canonical"])

    return run


def _block_matching(optional: frozenset[str], fillers: frozenset[str]):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        entry = pc.is_valid(held.column("canonical"))
        pairs = held.filter(pc.invert(entry))
        matcher = Matcher(_entries(held.filter(entry)), optional, set(zip(pairs.column("x").to_pylist(), pairs.column("y").to_pylist())), fillers)
        rows = [(name, cost, canonical) for name in asked.column("name").to_pylist() for cost, canonical in matcher.candidates(name)]
        return pa.table({"name": pa.array([r[0] for r in rows], pa.string()), "cost": pa.array([r[1] for r in rows], pa.float64()), "canonical": pa.array([r[2] for r in rows], pa.string())})

    return run


def canonical_predicates(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """(fact_id, canonical) of every fact without a canonical predicate, repeated deliveries once."""
    wanted = facts.where("predicate_canonical is null").select("fact_id", "predicate").dropDuplicates(["fact_id"])
    return match_names(wanted, registry, id_col="fact_id", name_col="predicate")
