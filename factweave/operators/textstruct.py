"""Structure of document texts: lines, pages, furniture, headings, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..session import ship

CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_PAGES = 4_000, 500, 2
TOP_BAND, BOTTOM_BAND = 0.18, 0.88


def lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line_no, text, start, end): non-blank lines with half-open code-point offsets; line_no counts blank ones too."""
    rows = documents.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "text"))
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long"))
    return placed.withColumn("end", F.col("start") + F.length("text")).where(F.rlike("text", F.lit(r"(?U)\S")))


def page_of(offsets: DataFrame, pages: DataFrame, id_col: str = "doc_id", offset_col: str = "offset") -> DataFrame:
    """offsets with page: the page [start, end) that holds the offset (of overlapping ones the last begun), else the document's last one, 0 without pages.

    An as-of join by one window over both tables: the last page begun at an offset.
    """
    marked = offsets.withColumn("_point", F.lit(True)).unionByName(
        pages.select(id_col, F.col("start").cast("long").alias(offset_col), F.struct(F.col("page").alias("page"), F.col("end").cast("long").alias("end")).alias("_page")), allowMissingColumns=True
    )
    w = Window.partitionBy(id_col).orderBy(offset_col, F.col("_point").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marked.withColumn("_begun", F.last("_page", ignorenulls=True).over(w)).withColumn("_last", F.max("_page.page").over(Window.partitionBy(id_col))).where("_point")
    holds = F.when(F.col("_begun.end") > F.col(offset_col), F.col("_begun.page"))
    return seen.withColumn("page", F.coalesce(holds, "_last", F.lit(0))).drop("_point", "_page", "_begun", "_last")


def body_size(of: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, body): the size, to a tenth, that most characters have."""
    sized = of.where("size is not null").groupBy(id_col, F.round("size", 1).alias("s")).agg(F.sum(F.length("text")).alias("n"))
    return sized.groupBy(id_col).agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))


def in_band(y: Column, height: Column) -> Column:
    """Near the top or the foot of its page."""
    return F.coalesce((height > 0) & ((y / height <= TOP_BAND) | (y / height >= BOTTOM_BAND)), F.lit(False))


def furniture(of: DataFrame, unit: str, group: str, units: DataFrame, least: int = 3, share: float = 0.25) -> DataFrame:
    """(group, shape, n_units): shapes of at least 4 characters on at least max(least, share of all) different units (pages) of the group."""
    total = units.groupBy(group).agg(F.countDistinct(unit).alias("total"))
    counted = of.withColumn("shape", S.shape(F.col("text"))).where(F.length("shape") >= 4).groupBy(group, "shape").agg(F.countDistinct(unit).alias("n_units"))
    return counted.join(total, group).where(F.col("n_units") >= F.greatest(F.lit(least), F.floor(F.col("total") * share))).select(group, "shape", "n_units")


def page_frames(of: DataFrame, found: DataFrame, unit: str, group: str) -> DataFrame:
    """(group, unit, frame): a unit's different furniture lines in the order in which they first occur."""
    shaped = of.withColumn("shape", S.shape(F.col("text"))).join(found.select(group, "shape"), [group, "shape"], "left_semi")
    first = shaped.groupBy(group, unit, "text").agg(F.min("start").alias("at"))
    return first.groupBy(group, unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("frame"))


def bullet_starts(of: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines with bulleted: they begin with a bullet glyph, or the line before on the same page is nothing else, at most 6 points away where y is known.

    A hyphen is no bullet: a line that is nothing but a hyphen is a table's nil.
    """
    w = Window.partitionBy(id_col).orderBy("line_no")
    page, y = (F.col(c) if c in of.columns else F.lit(None).cast("double") for c in ("page", "y"))
    text = F.trim("text")
    own = S.is_bullet(F.substring(text, 1, 1)) & (F.length(text) > 1)
    before = S.is_bullet(F.trim(F.lag("text").over(w))) & F.lag(page).over(w).eqNullSafe(page) & F.coalesce(F.abs(F.lag(y).over(w) - y) <= 6.0, F.lit(True))
    return of.withColumn("bulleted", F.coalesce(own | before, F.lit(False)))


def headings(of: DataFrame, id_col: str = "doc_id", found: DataFrame | None = None) -> DataFrame:
    """(id_col, line_no, text, start, level) of heading-shaped lines.

    With sizes: lines at least 1.15 times the body size, the document's three largest sizes as levels; bold lines of body size one
    level below, unless 40 % and more of the lines are bold. Without sizes (null): the first line is level 1, others are level 2.
    """
    shaped = of.where(S.heading_shaped(F.trim("text")) & ~S.is_bullet(F.trim("text")))
    if found is not None:
        shaped = shaped.withColumn("shape", S.shape(F.col("text"))).join(found.select(id_col, "shape"), [id_col, "shape"], "left_anti")
    if "size" not in of.columns:
        w = Window.partitionBy(id_col).orderBy("line_no")
        first = of.groupBy(id_col).agg(F.min("line_no").alias("_first"))
        plain = shaped.where(~F.contains("text", F.lit("|")) & F.rlike("text", F.lit(r"^\s*\p{L}"))).select(id_col, "line_no", "text", "start")
        title = of.join(first, id_col).where("line_no = _first").select(id_col, "line_no", "text", "start")
        return title.withColumn("level", F.lit(1)).unionByName(plain.join(first, id_col).where("line_no > _first").drop("_first").withColumn("level", F.lit(2))).withColumn("line_no", F.col("line_no"))
    sized = shaped.join(body_size(of, id_col), id_col)
    large = sized.where(F.round("size", 1) >= F.col("body") * 1.15)
    ranked = large.withColumn("level", F.dense_rank().over(Window.partitionBy(id_col).orderBy(F.round("size", 1).desc()))).where("level <= 3")
    levels = ranked.groupBy(id_col).agg(F.max("level").alias("levels"))
    bold_rate = of.groupBy(id_col).agg(F.avg(F.col("bold").cast("double")).alias("rate"))
    bold = sized.where(F.col("bold") & (F.abs(F.col("size") - F.col("body")) < 1.0) & (F.round("size", 1) < F.col("body") * 1.15)).join(bold_rate, id_col).where("rate < 0.4").join(levels, id_col, "left")
    columns = [id_col, "line_no", "text", "start"]
    return ranked.select(*columns, "level").unionByName(bold.select(*columns, (F.coalesce("levels", F.lit(0)) + 1).alias("level")))


def heading_paths(points: DataFrame, of: DataFrame, id_col: str = "doc_id", at: str = "start", max_level: int = 4) -> DataFrame:
    """points with heading_path: the open headings at each offset, outermost first; a heading closes those of its level and below.

    An as-of join by one window over both tables: the last heading of every level, kept if no later one of a smaller level intervenes.
    """
    marked = points.withColumn("_point", F.lit(True)).unionByName(
        of.select(id_col, F.col("start").alias(at), F.col("text").alias("_heading"), F.col("level").alias("_level")), allowMissingColumns=True
    )
    w = Window.partitionBy(id_col).orderBy(at, F.col("_point").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.last(F.when(F.col("_level") == k, F.struct(F.col(at).alias("at"), F.col("_heading").alias("text"))), ignorenulls=True).over(w) for k in range(1, max_level + 1)]
    seen = marked.withColumn("_last", F.array(*last)).where("_point")
    open_ = F.filter(F.transform("_last", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h["x"].isNotNull() & ~F.exists(F.slice(F.col("_last"), F.lit(1), h["i"]), lambda o: o["at"] >= h["x"]["at"]))
    return seen.withColumn("heading_path", F.transform(open_, lambda h: h["x"]["text"])).drop("_last", "_point", "_heading", "_level")


def sole_basis(text: Column) -> Column:
    """consolidated or standalone where the text names exactly one of them."""
    named = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b(consolidated|standalone)\b")), lambda x: x))
    return F.when(F.size(named) == 1, named[0])


def inherited_qualifiers(path: Column, frame: Column) -> Column:
    """Conditions that a place in a document gives: the basis of its innermost heading that names one, else of its page frame; its section."""
    bases = F.filter(F.transform(F.reverse(path), sole_basis), lambda b: b.isNotNull())
    basis = F.coalesce(F.get(bases, F.lit(0)), sole_basis(F.concat_ws(" ", frame)))
    segment = F.get(F.filter(F.transform(F.reverse(path), S.scope_label), lambda s: s.isNotNull()), F.lit(0))
    return F.map_filter(F.map_from_arrays(F.array(F.lit("consolidation"), F.lit("segment")), F.array(basis, segment)), lambda _, v: v.isNotNull())


def windows(starts: list[int], ends: list[int], pages: list[int], target: int, overlap: int, most_pages: int) -> list[tuple[int, int]]:
    """(first, last) lines of greedy windows: a window ends at `target` characters or `most_pages` pages, the next starts at most `overlap` back."""
    out, at, n = [], 0, len(starts)
    while at < n:
        last = at
        while last < n - 1 and ends[last] - starts[at] < target and pages[last] - pages[at] < most_pages:
            last += 1
        out.append((at, last))
        if last >= n - 1:
            break
        back, step = ends[last] - overlap, last
        if back > starts[at]:
            while step > at + 1 and starts[step] > back:
                step -= 1
        at = max(step, at + 1)  # a single line above the target moves on too
    return out


def chunk_texts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(id_col, chunk_no, char_start, char_end, text, pages): overlapping windows of whole lines, cut where each document is read.

    A form feed begins a page; a window spans CHUNK_PAGES page breaks at most. The window after the next depends on where the last one ended, so a document is walked in one piece; no shuffle is needed for that.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans, at, page = [], 0, 1
                for line in (text or "").split("\n"):
                    page += line.startswith("\f")
                    if line.strip():
                        spans.append((at, at + len(line), page))
                    page += line.count("\f", 1)
                    at += len(line) + 1
                cuts = windows([a for a, _, _ in spans], [b for _, b, _ in spans], [p for _, _, p in spans], target, overlap, CHUNK_PAGES)
                out += [(key, i, spans[a][0], spans[b][1], text[spans[a][0] : spans[b][1]], list(range(spans[a][2], spans[b][2] + 1))) for i, (a, b) in enumerate(cuts)]
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], [id_col, "chunk_no", "char_start", "char_end", "text", "pages"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, chunk_no int, char_start bigint, char_end bigint, text string, pages array<int>")


def context_text(path: Column, frame: Column, text: Column) -> Column:
    """What a reader of a chunk is given: its page frame and headings above its text."""
    return F.concat_ws("\n", F.concat_ws(" | ", frame), F.concat_ws(" > ", path), text)


def batches(chunks: DataFrame, id_col: str = "doc_id", size: int = 16) -> DataFrame:
    """chunks with batch_no: `size` chunks of a document in a row."""
    w = Window.partitionBy(id_col).orderBy("chunk_no")
    return chunks.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
