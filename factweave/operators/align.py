"""Locating quotes in texts: exactly near a place, exactly anywhere, with white space folded, or as the most similar window.

The first three are expressions in the JVM; only quotes that none of them finds go to Python, with the part of the text that may hold them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

MARGIN, LEAST_SCORE = 2_000, 88.0


def folded(text: str) -> tuple[str, list[int]]:
    """The text with white space as single blanks, and each character's place in the text."""
    parts, places, at = [], [], 0
    for m in re.finditer(r"\s+|\S+", text):
        if m.group()[0].isspace():
            parts.append(" ")
            places.append(m.start())
        else:
            parts.append(m.group())
            places.extend(range(m.start(), m.end()))
    return "".join(parts), places


def indel_similarity(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths, by bit-parallel matching."""
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        m = row & masks.get(c, 0)
        row = (row + m) | (row - m)
        row &= (1 << len(a)) - 1
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def nearest_end(needle: str, text: str) -> tuple[int, int]:
    """(edits, end) of the substring with the fewest edits to the needle, by bit-parallel approximate search; any start is free."""
    masks: dict[str, int] = {}
    for i, c in enumerate(needle):
        masks[c] = masks.get(c, 0) | 1 << i
    every, top = (1 << len(needle)) - 1, 1 << len(needle) - 1
    up, down, edits = every, 0, len(needle)
    best = (edits, 0)
    for j, c in enumerate(text, 1):
        same = masks.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(across | up)), up & across
        edits += bool(more & top) - bool(less & top)
        more, less = more << 1 & every, less << 1 & every
        up, down = less | (every & ~(same | down | more)), more & (same | down)
        if edits < best[0]:
            best = (edits, j)
    return best


def _grams(text: str) -> np.ndarray:
    """A number below 2^16 for every three characters in a row; equal ones have equal numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)


def within_reach(needle: str, text: str, edits: int) -> list[tuple[int, int]]:
    """Spans of the text that hold all its substrings with at most so many edits to the needle; most texts have none.

    An edit touches three of the needle's grams, so such a substring keeps the others, and it is at most `edits` longer than the needle.
    """
    least, width = len(needle) - 2 - 3 * edits, len(needle) + edits - 2  # grams that are kept, and grams of the longest substring
    if least <= 0:
        return [(0, len(text))]
    known = np.zeros(1 << 16, dtype=bool)
    known[_grams(needle)] = True
    total = np.concatenate(([0], np.cumsum(known[_grams(text)])))
    kept = total[width:] - total[:-width] if len(total) > width else total[-1:]  # of the windows; substrings that begin behind the last lie in it
    starts = np.flatnonzero(kept >= least)
    if not len(starts):
        return []
    ends = np.flatnonzero(np.diff(starts) > width + 2)
    return [(int(s), min(int(e) + width + 2, len(text))) for s, e in zip(starts[np.append(0, ends + 1)], starts[np.append(ends, len(starts) - 1)])]


def most_similar(quote: str, text: str) -> tuple[float, int, int]:
    """(score, start, end) of the text's part that is most similar to the quote, white space folded in both; score 0 where none reaches LEAST_SCORE.

    A part of that score has few edits, so the end comes from the search for the fewest, in the spans that can hold them; its starts are tried
    within as many places.
    """
    plain, needle = re.sub(r"\s+", " ", text), " ".join(quote.split())
    most = int((100 - LEAST_SCORE) / 50 * len(needle))
    found = [(edits, s + end) for s, e in (within_reach(needle, plain, most) if needle and plain else []) for edits, end in [nearest_end(needle, plain[s:e])] if end]
    edits, end = min(found, default=(0, 0))
    if not end or edits > most:
        return 0.0, -1, -1
    places = folded(text)[1]
    first = range(max(0, end - len(needle) - edits), min(end - 1, end - len(needle) + edits) + 1)
    score, start = max(((indel_similarity(needle, plain[s:end]), s) for s in first), default=(0.0, -1))
    return (score, places[start], places[end - 1] + 1) if score >= LEAST_SCORE else (0.0, -1, -1)


def _exactly(text: Column, quote: Column) -> Column:
    """struct(at, size) of the quote in the text, null where it isn't there."""
    at = F.instr(text, quote)
    return F.when(at > 0, F.struct((at - 1).cast("long").alias("at"), F.length(quote).cast("long").alias("size")))


def _loosely(text: Column, quote: Column) -> Column:
    """The same with any white space between the quote's words."""
    words = F.transform(F.split(F.trim(F.regexp_replace(quote, r"(?U)\s+", " ")), " "), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit("(?U)"), F.array_join(words, r"\s+"))
    found = F.call_function("regexp_extract", text, pattern, F.lit(0))
    before = F.get(F.call_function("split", text, pattern, F.lit(2)), F.lit(0))
    return F.when(F.length(found) > 0, F.struct(F.length(before).cast("long").alias("at"), F.length(found).cast("long").alias("size")))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [most_similar(q or "", t or "") for q, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        moved = [(s, a + o, b + o) if a >= 0 else (0.0, -1, -1) for (s, a, b), o in zip(found, batch.column(3).to_pylist())]
        columns = [pa.array(["fuzzy" if m[1] >= 0 else "unlocated" for m in moved], pa.string()), *(pa.array([m[i] for m in moved], k) for i, k in ((1, pa.int64()), (2, pa.int64()), (0, pa.float64())))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["quote_id", "status", "start", "end", "score"])


def align(quotes: DataFrame, documents: DataFrame, *, strict: bool = False) -> DataFrame:
    """quotes (quote_id, doc_id, quote[, near_start, near_end]) with status, start, end and score.

    A quote is sought near its place first, then, unless `strict`, in the whole text; the most similar part is sought near the place where there is
    one. Quotes of unknown documents and blank ones are unlocated.
    """
    ship(quotes.sparkSession)
    near = all(c in quotes.columns for c in ("near_start", "near_end"))
    lo, hi = (F.col("near_start"), F.col("near_end")) if near else (F.lit(None), F.lit(None))
    met = quotes.select("quote_id", "doc_id", F.trim("quote").alias("quote"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).join(documents.select("doc_id", "text"), "doc_id", "left")
    begin = F.when(F.col("lo").isNull(), F.lit(0)).otherwise(F.greatest(F.col("lo") - MARGIN, F.lit(0))).cast("int")
    window = F.when(F.col("lo").isNull(), F.col("text")).otherwise(F.substring(F.col("text"), begin + 1, (F.col("hi") + MARGIN - begin).cast("int")))
    sought = met.select("quote_id", "quote", begin.alias("begin"), window.alias("window"), F.when(F.col("lo").isNotNull() & F.lit(not strict), F.col("text")).alias("whole"))
    quote, inside, whole = F.col("quote"), F.col("window"), F.col("whole")
    shifted = lambda found: F.when(found.isNotNull(), F.struct((found["at"] + F.col("begin")).alias("at"), found["size"].alias("size")))
    steps = [shifted(_exactly(inside, quote)), _exactly(whole, quote), shifted(_loosely(inside, quote)), _loosely(whole, quote)]
    placed = sought.withColumn("found", F.when(quote != "", F.coalesce(*steps))).select("quote_id", "quote", "begin", "window", "found")
    exact = placed.where("found is not null").select("quote_id", F.lit("exact").alias("status"), F.col("found.at").alias("start"), F.expr("found.at + found.size").alias("end"), F.lit(100.0).alias("score"))
    kind = quotes.schema["quote_id"].dataType.simpleString()
    rest = placed.where("found is null").select("quote_id", "quote", "window", "begin").mapInArrow(_similar, f"quote_id {kind}, status string, start bigint, end bigint, score double")
    return exact.unionByName(rest)
