"""Splitting oversized texts at natural boundaries, in the JVM: bounded-quantifier regex extraction and array functions.

One pattern consumes the text from left to right. Its alternatives are ordered by the strength of the boundary they end at
(rest of the text, blank line, line, sentence, word, character), and each takes at most `limit - overlap` code points, so that
a piece with its look-back never exceeds `limit`. Lengths of the extracted bodies summed up give the offsets; the look-back of
a piece starts at the first natural boundary within the `overlap` code points before its body. Pieces and headings are made
from the bodies beside each other, never from the text's start, so that the work is linear in a text's length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lets import let

LIMIT, OVERLAP = 4_000, 500

#: Look-behinds for the ends of a body, strongest first: blank line, line, sentence, word.
_ENDS = (
    r"(?<=\n[ \t\r]{0,4}\n)",
    r"(?<=[\n\r\u2028\u2029])",
    r"(?<=[.!?;।…。！？][\"'”’)\]]{0,2}\s)",
    r"(?<=\s)",
)
#: A line of 3 to 80 characters and at most 12 words that starts with a letter and ends like no sentence is a heading.
_HEADING = r"(?=[^\n]{3,80}(?:\n|\z))(?![^\n]*[|<>\t])\p{L}[^\s]*(?:[ ]+[^\s]+){0,11}(?<![.,;:!?।])"


def body_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """The pattern for texts longer than `limit`; bodies that end at a boundary fill at least half of what they may."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    most = limit - overlap
    least = max(1, most // 2)
    ends = [rf".{{{least},{most}}}{end}" for end in _ENDS]
    # (?!\p{M}) and the joiner keep a letter with its accents where that is possible at all
    return "(?s)" + "|".join([rf".{{1,{most}}}+\z", *ends, rf".{{{least},{most}}}(?![\p{{M}}\u200D])", rf".{{1,{most}}}"])


def _look_back(window: Column) -> Column:
    """How much of the window before a body is not taken: up to its first line or sentence, else word, else character."""
    size = F.length(window)
    strong = F.length(F.regexp_extract(window, r"(?s)^.*?(?:[\n\r]+|[.!?;।…][\"'”’)\]]{0,2}\s+)", 0))
    word = F.length(F.regexp_extract(window, r"(?s)^.*?\s+", 0))
    return F.when((strong > 0) & (strong < size), strong).when((word > 0) & (word < size), word).otherwise(F.length(F.regexp_extract(window, r"^[\p{M}\u200D]*", 0)))


def _last(text: Column, n: Column | int) -> Column:
    """The last n code points of a text."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n <= 0, F.lit("")).otherwise(F.substring(text, F.greatest(F.length(text) - n, F.lit(0)) + 1, n))


#: Code points that a heading line, its line break and the one before it take.
_LINE = 90


def _last_heading(text: Column) -> Column:
    """The last heading line that ends in the text and begins behind a line break in it, or null."""
    return F.nullif(F.regexp_extract(text, rf"(?s)^.*\n({_HEADING})[ \r]{{0,6}}\n", 1), F.lit(""))


def split_oversized(
    items: DataFrame, *, id_col: str, text_col: str = "text", heading_col: str | None = None, base_col: str | None = None,
    kind: str = "item", limit: int = LIMIT, overlap: int = OVERLAP,
) -> DataFrame:
    """Pieces of every text longer than `limit` code points: item_kind, item_id, piece_no, n_pieces, body_start, piece_start, piece_end,
    source_start, heading_path, piece.

    Offsets are half-open, in code points of the item's text; `piece_start .. body_start` is the overlap with the piece before.
    `source_start` adds `base_col` (where the item itself begins in its document). Bodies concatenate to the text. `heading_path` is
    `heading_col` without nulls, blanks and doubled entries, or else the text's first line, with the last heading line before the piece.
    Null, empty and short texts give no row; repeated items give repeated rows; other columns are dropped. Each row is processed
    alone: no shuffle, and an item's pieces come from its own row.
    """
    text = F.col("_text")
    src = items.select(
        F.col(id_col).alias("item_id"),
        F.col(text_col).alias("_text"),
        (F.coalesce(F.col(base_col).cast("long"), F.lit(0)) if base_col else F.lit(0)).cast("long").alias("_base"),
        *([F.array_distinct(F.filter(F.coalesce(F.col(heading_col), F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) > 0)).alias("_path")] if heading_col else []),
    ).where(F.length("_text") > limit)
    if not heading_col:
        src = src.withColumn("_path", F.filter(F.array(F.regexp_extract(text, r"^\s*([^\n\r]{1,120})", 1)), lambda x: F.length(x) > 0))
    bodies = src.select("item_id", "_base", "_path", F.regexp_extract_all(text, F.lit(body_pattern(limit, overlap)), F.lit(0)).alias("_bodies"))
    # bodies that may hold the overlap and a heading line before a body
    behind = -(-(overlap + _LINE) // max(1, (limit - overlap) // 2)) + 1
    all_ = F.col("_bodies")
    before = lambda i: F.array_join(F.slice(all_, F.greatest(i - behind, F.lit(0)) + 1, F.least(i, F.lit(behind))), "")

    def piece(i: Column) -> Column:
        return let(before(i), lambda t: F.struct(t.alias("tail"), F.when(i == 0, F.lit(0)).otherwise(F.length(_last(t, overlap)) - _look_back(_last(t, overlap)) if overlap else F.lit(0)).alias("back")))

    backs = bodies.withColumn("_back", F.transform(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: piece(i)["back"]))

    def heading(i: Column) -> Column:
        """The last heading line that ends after the piece before begins and not after this one does; the text's start is a line's."""
        back, was = F.get(F.col("_back"), i), F.get(F.col("_back"), i - 1)
        body = F.get(all_, i - 1)
        start = F.when(i == 1, F.lit("\n")).otherwise(F.lit(""))
        return F.when(i > 0, let(F.concat(start, _last(before(i - 1), was + _LINE), body), lambda t: _last_heading(F.substring(t, F.lit(1), F.length(t) - back))))

    numbered = backs.withColumn("_heads", F.transform(F.sequence(F.lit(0), F.size(all_) - 1), heading))
    rows = numbered.select("item_id", "_base", "_path", "_bodies", "_back", "_heads", F.size(all_).alias("n_pieces"), F.expr("aggregate(_bodies, array(0), (s, b) -> concat(s, array(element_at(s, -1) + length(b))))").alias("_ends"),
                           F.aggregate("_heads", F.array().cast("array<string>"), lambda s, h: F.concat(s, F.array(F.coalesce(h, F.element_at(F.concat(F.array(F.lit(None).cast("string")), s), -1))))).alias("_held"))
    each = F.transform(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: F.struct(
        i.alias("piece_no"), F.get(F.col("_ends"), i).alias("body_start"), (F.get(F.col("_ends"), i) - F.get(F.col("_back"), i)).alias("piece_start"), F.get(F.col("_ends"), i + 1).alias("piece_end"),
        F.get(F.col("_held"), i).alias("heading"), F.concat(_last(before(i), F.get(F.col("_back"), i)), F.get(all_, i)).alias("piece"),
    ))
    out = rows.select("item_id", "_base", "_path", "n_pieces", F.explode(each).alias("p"))
    return out.select(
        F.lit(kind).alias("item_kind"),
        F.col("item_id"),
        F.col("p.piece_no").alias("piece_no"),
        F.col("n_pieces"),
        F.col("p.body_start").alias("body_start"),
        F.col("p.piece_start").alias("piece_start"),
        F.col("p.piece_end").alias("piece_end"),
        (F.col("_base") + F.col("p.piece_start")).alias("source_start"),
        F.array_distinct(F.concat("_path", F.array_compact(F.array("p.heading")))).alias("heading_path"),
        F.col("p.piece").alias("piece"),
    )


def oversized_items(pieces: list[DataFrame]) -> DataFrame:
    """(item_kind, item_id) of the items that were cut, each once; pieces: results of split_oversized."""
    all_pieces = reduce(DataFrame.unionByName, pieces)
    return all_pieces.where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("item_kind", F.col("item_id").cast("long").alias("item_id")).distinct()
